"""Conversation repair, collocations and decontamination against plain Python written apart from them."""

from __future__ import annotations

import hashlib
import heapq
import random
import re
import sys
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))

from entitymill.llm import collocations, decontaminate, queries, repair  # noqa: E402

BLANK = re.compile(r"[\x20\x09-\x0D]+")
TURNS = "conv_id long, turn long, role string, text string"


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# --- conversations --------------------------------------------------------------------------------


def cheapest(roles, faults):
    """Smallest (cost, audit, kept turns) by best-first search over (row, roles so far in the grammar)."""
    names, step = {0: "user", 1: "user", 2: "assistant", 3: "user"}, {0: 2, 1: 2, 2: 3, 3: 2}
    moves = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (2, "a"): 3}
    queue, seen = [(0, "", 0, 0, ())], set()
    while queue:
        cost, audit, i, q, out = heapq.heappop(queue)
        if i == len(roles) and q in (0, 3):
            return cost, audit, out
        if (i, q) in seen:
            continue
        seen.add((i, q))
        heapq.heappush(queue, (cost + 3, audit + "I", i, step[q], (*out, (names[q], None))))
        if i == len(roles):
            continue
        heapq.heappush(queue, (cost + 4, audit + "D", i + 1, q, out))
        if faults[i] in ("blank", "duplicate"):
            continue
        extra = 3 * (faults[i] == "truncated")
        heapq.heappush(queue, (cost + 3 + extra, audit + "R", i + 1, step[q], (*out, (names[q], i))))
        to = moves.get((q, roles[i][:1]))
        if to is not None:
            heapq.heappush(queue, (cost + extra, audit + "K", i + 1, to, (*out, (None, i))))
    raise AssertionError


def repaired(rows):
    """What is asked for of one conversation's (turn, role, text)."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
    faults, seen = [], set()
    for _, role, text in rows:
        bare = BLANK.sub("", text)
        fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else ""
        seen.add((role, text))
        faults.append(fault)
    roles = [r[1] for r in rows]
    cost, audit, out = cheapest(roles, faults)
    turns = [t for t, _, _ in rows if t is not None]
    left = "\n".join(f"{name or roles[i]}:{'' if i is None else rows[i][2]}" for name, i in out)
    illegal = sum(a[:1] + b[:1] not in ("su", "ua", "au") for a, b in zip(roles, roles[1:]))
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    return gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, sha(left)


def damage(rows):
    out = defaultdict(list)
    for conv, turn, role, text in rows:
        out[conv]
        rest = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if rest:
            text = "" if rest == 1 else re.sub("[.!?]", "", text) if rest == 2 else text
            out[conv] += [(turn, "user" if rest == 4 else role, text)] * (2 if rest == 3 else 1)
    return out


def conversations(seed=3, n=150):
    rng = random.Random(seed)
    rows = []
    for conv in range(n):
        for turn in range(rng.choice([1, 2, 3, 5, 9])):
            role = rng.choice(["user", "assistant"] if rng.random() < 0.3 else [["user", "assistant"][turn % 2]] * 9 + ["system", "tool", "", None, "Ü", "sage"])
            text = rng.choice(["Yes.", "No!", "Is it?", "cut", "", " \n", None, "a. ", "é." + "x" * 40, "Line\none.", "Yes."])
            rows.append((conv * 7, rng.choice([turn, turn, turn, None, turn - 1]), role, text))
    rows += [(None, t, r, x) for t, r, x in ((None, "user", "a."), (3, "assistant", "b."), (-5, "system", "c."))]
    rows += [(9999, i, ["user", "assistant"][i % 2], f"{i}{'.' if i % 5 else ''}") for i in range(90)]
    rows += [(9998, 2, "user", "same.")] * 40
    return rows


FIELDS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


@pytest.mark.parametrize("size", [(4096, 1 << 20), (7, 1 << 20), (3, 60)])
def test_repairs(spark, size):
    rows = conversations()
    left = damage(rows)
    df = spark.createDataFrame([(c, *r, 1) for c, rs in left.items() for r in rs], TURNS + ", piece int").repartition(5)
    found = {r["conv_id"]: tuple(r[k] for k in FIELDS[1:]) for r in repair.repaired(df, piece_rows=size[0], piece_chars=size[1]).collect()}
    assert found == {c: repaired(rs)[1:] for c, rs in left.items() if rs}


def test_repair_query(spark, tmp_path):
    rows = conversations(5)
    spark.createDataFrame(rows, TURNS).withColumn("conv", F.lit(1)).write.parquet(f"{tmp_path}/conversations.parquet")
    out = queries.op11_repair(spark, str(tmp_path))
    found = {r["conv_id"]: tuple(r[k] for k in FIELDS) for r in out.collect()}
    assert found == {c: repaired(rs) if rs else (0, 0, 0, 0, 0, 0, "", sha("")) for c, rs in damage(rows).items()}
    assert out.count() == len(found) and dict(out.dtypes)["cost"] == dict(out.dtypes)["gaps"] == "bigint"


def test_repair_of_nothing_and_far_turns(spark, tmp_path):
    assert repair.repaired(spark.createDataFrame([], TURNS)).count() == 0
    spark.createDataFrame([], TURNS).write.parquet(f"{tmp_path}/conversations.parquet")
    assert queries.op11_repair(spark, str(tmp_path)).count() == 0
    far = spark.createDataFrame([(1, -(2**63), "user", "a."), (1, 2**63 - 1, "assistant", "b.")], TURNS)
    assert repair.repaired(far).first()["audit"] == "KK" and repair.turn_gaps(far).first()["gaps"] is None


def test_equal_ends_are_one_node(spark):
    """Every signature's costs are those of a search of its own, whatever stands beside it."""
    rng = random.Random(2)
    signs = sorted({"".join(rng.choice("suaoSUAObd") for _ in range(rng.randrange(7))) for _ in range(400)})
    end = F.array(*[F.lit(x).cast("long") for x in repair.END])
    got = repair.automaton(spark.createDataFrame([(s,) for s in signs], "signature string").withColumn("after", end)).collect()
    assert len(got) == len(signs)
    for r in got:
        faults = ["blank" if c in "bd" else "truncated" if c.isupper() else "" for c in r["signature"]]
        cost, audit, _ = cheapest([c.lower() for c in r["signature"]], faults)
        assert (r["costs"][0], r["audits"][0] + repair.CLOSING[r["states"][0]]) == (cost, audit), r["signature"]


# --- phrases --------------------------------------------------------------------------------------


def phrases(docs, least, longest, top):
    """By language the rows asked for, from counts of all phrases."""
    counts = defaultdict(Counter)
    for lang, text in docs:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower(text)):
            words = re.findall(r"[^\x20\x09]+", piece)
            for k in range(1, longest + 1):
                counts["und" if lang is None else lang].update(tuple(words[i:i + k]) for i in range(len(words) - k + 1))
    out = {}
    for lang, f in counts.items():
        n = sum(c for g, c in f.items() if len(g) == 1)
        often = {g: c for g, c in f.items() if len(g) > 1 and c >= least}
        gone = {g[i:i + k] for g, c in often.items() for k in range(2, len(g)) for i in range(len(g) - k + 1) if 100 * c >= 100 * f[g[i:i + k]]}
        rows = []
        for g, a in often.items():
            if g not in gone:
                score, k = min((1000 * a * n // (f[g[:k]] * f[g[k:]]), k) for k in range(1, len(g)))
                rows.append((-score, -a, " ".join(g).encode(), f[g[:k]], f[g[k:]]))
        out[lang] = [(i + 1, p.decode(), -a, l, r, n, -s) for i, (s, a, p, l, r) in enumerate(sorted(rows)[:top])]
    return {lang: rows for lang, rows in out.items() if rows}


def texts(seed=4, n=120):
    rng = random.Random(seed)
    common = ["The", "of", "salon", "é", "x1"]
    out = []
    for i in range(n):
        words = [rng.choice(common if rng.random() < 0.7 else ["w%d" % rng.randrange(300)]) + rng.choice(["", "", "", "", ".", ",\n", "\t"]) for _ in range(rng.choice([0, 1, 4, 30, 90]))]
        out.append((rng.choice(["en", "fr", None, "und"]), " ".join(words)))
    line = "All rights reserved by the very same people as always under one licence"
    out += [("en", line)] * 8 + [("en", "before " + line + " after")] * 3 + [("fr", "la la la la la la la la")] * 4
    out += [("en", None), (None, ""), ("de", " \n.,"), ("en", "a b " * 5000), ("", "of of\x0bof of\x0cof")]
    return out


@pytest.mark.parametrize("least,longest,cells", [(5, 5, 1 << 20), (5, 3, 64), (2, 4, 1 << 24), (1, 5, 1 << 14), (300, 5, 1 << 16)])
def test_collocations(spark, least, longest, cells):
    rows = texts()
    df = spark.createDataFrame([(i, lang, t, 1, "x") for i, (lang, t) in enumerate(rows)], "doc_id long, lang string, text string, n long, gram string").repartition(4)
    got = defaultdict(list)
    for r in collocations.collocations(df, least=least, longest=longest, top=50, n_cells=cells).orderBy("lang", "rank").collect():
        got[r["lang"]].append(tuple(r)[1:])
    assert dict(got) == phrases(rows, least, longest, 50)


def test_collocations_of_nothing(spark):
    assert collocations.collocations(spark.createDataFrame([], "lang string, text string")).count() == 0
    with pytest.raises(ValueError):
        collocations.collocations(spark.createDataFrame([], "lang string, text string"), longest=2)


def test_collocations_pass_64_bits(spark):
    """1000 * a * n does not fit 64 bits."""
    big = 10**10
    counts = spark.createDataFrame([("en", "a b", 2, big), ("en", "a", 1, big), ("en", "b", 1, 4 * big)], "lang string, gram string, size int, f long")
    real = collocations.phrase_counts
    try:
        collocations.phrase_counts = lambda *a, **k: counts
        row = collocations.collocations(spark.createDataFrame([], "lang string, text string")).first()
    finally:
        collocations.phrase_counts = real
    assert (row["n"], row["score"]) == (5 * big, 1000 * big * 5 * big // (big * 4 * big))


# --- benchmark passages ---------------------------------------------------------------------------

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def leaks(docs, items, span):
    windows = defaultdict(set)
    for item, text in items:
        words = WORD.findall(lower(text))
        m = min(span, len(words))
        for i in range(len(words) - m + 1 if words else 0):
            windows[tuple(words[i:i + m])].add(item)
    sizes, out = {len(w) for w in windows}, []
    for text in docs:
        words, hit, met = WORD.findall(lower(text)), set(), set()
        for m in sizes:
            for i in range(len(words) - m + 1):
                if found := windows.get(tuple(words[i:i + m])):
                    hit |= set(range(i, i + m))
                    met |= found
        out.append((len(words), hit, met))
    return out


def passages(seed=6):
    rng = random.Random(seed)
    word = lambda: rng.choice(["the", "Of", "a", "Größe", "漢字", "x1", "9", "it"])
    items = [(f"i{i}", " ".join(word() for _ in range(rng.choice([10, 11, 14, 40])))) for i in range(12)]
    items += [("short", "Only four words, here"), ("one", "unicorn"), ("two", "zebra... crossing"), ("none", "..."), ("null", None), ("i0", "another text of the item of ten words and a few more"),
              (None, "an item without any id but with words enough to be met"), ("long", " ".join(f"w{i}" for i in range(700))), ("again", items[3][1])]
    docs = []
    for i in range(60):
        parts = [" ".join(word() for _ in range(rng.choice([0, 3, 30])))]
        for _ in range(rng.randrange(4)):
            body = WORD.findall(rng.choice(items)[1] or "")
            a = rng.randrange(max(len(body), 1))
            parts += [rng.choice([" ", ", ", "\n- "]).join(body[a:a + rng.choice([5, 9, 10, 25, 300])]), word()]
        docs.append(" / ".join(parts))
    docs += [None, "", "...", "unicorn", "UNICORN unicorn", " ".join(f"w{i}" for i in range(700)), " ".join(["the"] * 3000), docs[0], docs[0]]
    return docs, items


@pytest.mark.parametrize("span,gram,limit", [(10, 4, 1 << 25), (10, 4, 0), (10, 10, 1 << 25), (3, 1, 0), (1, 1, 1 << 25), (25, 4, 1 << 25)])
def test_leaks(spark, span, gram, limit):
    docs, items = passages()
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(docs)], "doc_id long, text string, key string, start int").repartition(3)
    bench = spark.createDataFrame([(*x, 1) for x in items], "item_id string, text string, print int")
    got = {r["doc_id"]: r for r in decontaminate.contaminated(df, bench, span=span, gram=gram, broadcast_bytes=limit).collect()}
    assert len(got) == len(docs)
    for i, (n, hit, met) in enumerate(leaks(docs, items, span)):
        r = got[i]
        covered = [p for s in r["spans"] or [] for p in range(s["start"], s["end"])]
        assert (r["n_words"], covered) == (n, sorted(hit)), (i, docs[i])
        assert len(r["items"] or []) == len(met) and set(r["items"] or []) == met


def test_leaks_of_nothing_and_repeated_rows(spark, tmp_path):
    none, bench = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([(1, "a b c d e f g h i j")], "item_id long, text string")
    assert decontaminate.contaminated(none, bench).count() == 0
    same = spark.createDataFrame([(1, "x a b c d e f g h i j"), (1, "x a b c d e f g h i j"), (None, "a b"), (1, "q")], "doc_id long, text string")
    rows = sorted((r["doc_id"] or 0, r["n_words"], [tuple(s) for s in r["spans"] or []]) for r in decontaminate.contaminated(same, bench).collect())
    assert rows == [(0, 2, []), (1, 1, []), (1, 11, [(1, 11)]), (1, 11, [(1, 11)])]
    assert decontaminate.contaminated(same, bench.limit(0)).filter("spans is null").count() == 4
    same.write.parquet(f"{tmp_path}/documents.parquet")
    bench.write.parquet(f"{tmp_path}/benchmark.parquet")
    got = sorted((r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) for r in queries.op13_decontaminate(spark, str(tmp_path)).collect())
    assert got == sorted([(0, 0, sha(""), False)] * 2 + [(10, 1, sha("1"), True)] * 2)
