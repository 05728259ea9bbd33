"""Operators against plain Python, with nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

from __future__ import annotations

import collections
import random
import re
import sys
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))

import brute  # noqa: E402
from entitymill.llm import bpe, chat, components, exact, groups, langid, lattice, mixing, queries, secrets, simhash, substrings, urls  # noqa: E402

public_tokenizers = pytest.importorskip("public_tokenizers")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng, n):
    return " ".join(rng.choice(["the", "of", "salon", "Über", "café", "x1", "-", "nineteen", "漢字"]) + rng.choice(["", "s", "ly", "\n"]) for _ in range(n))


def documents(seed=1, n=60):
    """Texts with copies, near copies, nulls, empties, one very long."""
    rng = random.Random(seed)
    out = []
    for i in range(n):
        text = words(rng, rng.choice([0, 1, 2, 5, 40, 120, 300]))
        if i % 5 == 4:
            text = out[rng.randrange(i)][1]
        if i % 7 == 6 and out[-1][1]:
            at = out[-1][1].split(" ")
            at[rng.randrange(len(at))] = "changed"
            text = " ".join(at)
        out.append((i * 3, text))
    out += [(500, None), (501, ""), (502, " \n\t"), (503, "long " * 30000), (504, "A b c"), (505, "a B C"), (506, "​!!! ???")]
    return [(i, t, rng.choice(["en", "fr", None]), rng.choice(["s0", "s0", "s1", "é", None]), None) for i, t in out]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(documents(), DOCS).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def got(df, *key):
    return {tuple(r[k] for k in key) if len(key) > 1 else r[key[0]]: r for r in df.collect()}


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """The small tables as a test folder, all operators' queries read it."""
    place = tmp_path_factory.mktemp("sf")
    spark.createDataFrame(documents(), DOCS).write.parquet(f"{place}/documents.parquet")
    return str(place)


# --- links and components -----------------------------------------------------------------------


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(1000 + i, 1001 + i) for i in range(60)] + [(2000, 2001 + i) for i in range(50)]
    want = brute.roots(sorted({n for e in edges for n in e}), edges)
    rows = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(edges + [(None, 3)], "u long, v long")).collect()}
    assert all(rows.get(n, n) == c for n, c in want.items()) and set(rows) <= set(want)


def test_components_of_nothing(spark):
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0


# --- 1: SimHash -----------------------------------------------------------------------------------


@pytest.mark.parametrize("pairs_up_to", [32, 1])
def test_simhash_equals_brute_force(spark, folder, monkeypatch, pairs_up_to):
    monkeypatch.setattr(simhash, "PAIRS_UP_TO", pairs_up_to)
    monkeypatch.setattr(simhash.links, "__defaults__", (pairs_up_to,))
    rows = got(queries.op1_simhash(spark, folder), "doc_id")
    want = brute.simhash([(i, t) for i, t, *_ in documents()])
    assert {i: (r["fingerprint"], r["component_id"]) for i, r in rows.items()} == want
    assert want[500][0] == "0" * 16 and want[504] == want[505][:1] + (504,)


@pytest.mark.parametrize("pairs_up_to", [32, 1])
def test_links_within_two_bits(spark, pairs_up_to):
    rng = random.Random(5)
    base = [rng.getrandbits(64) for _ in range(4)]
    prints = set(base)
    for b in base:
        for _ in range(30):
            x = b
            for _ in range(rng.randrange(4)):
                x ^= 1 << rng.randrange(64)
            prints.add(x)
    prints = sorted(p - 2**64 if p >= 2**63 else p for p in prints)
    mask = 2**64 - 1
    linked = [(a, b) for i, a in enumerate(prints) for b in prints[i + 1:] if ((a ^ b) & mask).bit_count() <= 2]
    df = spark.createDataFrame([(p, p) for p in prints], "node long, f0 long")
    found = {tuple(sorted((r["u"], r["v"]))) for r in simhash.links(df, 2, 32, pairs_up_to).collect()}
    assert found <= set(linked) and brute.roots(prints, found) == brute.roots(prints, linked)
    if pairs_up_to == 32:
        assert found == set(linked)


@pytest.mark.parametrize("rounds, block", [(1, 4), (3, 256)])
def test_every_pair_of_a_group_is_compared(spark, rounds, block):
    """One group of strangers and families whose ends are in no family."""
    rng = random.Random(8)
    nodes = [-2**62, *rng.sample(range(-2**61, 2**61), 40), 2**62]
    family = {n: (i % 9 if i % 4 == 1 else 100 + i) for i, n in enumerate(nodes)}
    met = spark.createDataFrame([(7, n) for n in nodes] + [(8, nodes[3]), (9, nodes[4]), (9, nodes[5])], "key long, node long")
    of = spark.createDataFrame(list(family.items()), "node long, family long")

    def near(pairs):
        a, b = of.select(F.col("node").alias("u"), F.col("family").alias("fu")), of.select(F.col("node").alias("v"), F.col("family").alias("fv"))
        return pairs.join(a, "u").join(b, "v").filter("fu = fv").select("u", "v")

    linked = [(a, b) for a in nodes for b in nodes if a > b and family[a] == family[b]]
    found = {(r["u"], r["v"]) for r in groups.links_within(met, near, rounds, block).collect()}
    assert linked and found <= set(linked) and brute.roots(nodes, found) == brute.roots(nodes, linked)


def test_only_members_of_large_groups_go_to_the_rest(spark):
    """One large group of strangers and many small ones: these are compared directly, whatever the large one has."""
    met = [(7, n) for n in range(60)] + [(100 + g, 1000 + 10 * g + i) for g in range(20) for i in range(3)]
    met = spark.createDataFrame(met, "key long, node long")
    sent, asked = [], []

    def near(pairs):
        asked.extend((r["u"], r["v"]) for r in pairs.collect())
        return pairs.filter("u = 0 and v = 1")

    def rest(open_):
        sent.extend(r["node"] for r in open_.collect())
        return spark.createDataFrame([], "u long, v long")

    assert groups.links_within(met, near, 1, 16, rest).collect() == []
    assert sorted(sent) == list(range(60))
    small = {(1000 + 10 * g + j, 1000 + 10 * g + i) for g in range(20) for j in range(3) for i in range(j)}
    assert {p for p in asked if p[0] >= 1000} == small


def test_the_near_copy_stage_links_by_fingerprints(spark, monkeypatch):
    rng, rows = random.Random(5), []
    for i in range(6):
        text = [f"w{rng.randrange(10**6)}" for _ in range(4000)]
        rows.append((i, " ".join(text), "en", "s", None))
        text[rng.randrange(4000)] = "other"
        rows.append((100 + i, " ".join(text), "en", "s", None))
    # what the bands find is left out, the fingerprints' links stay
    monkeypatch.setattr(simhash, "similar_links", lambda met, sets: spark.createDataFrame([], "u long, v long"))
    kept = {r["doc_id"] for r in simhash.one_of_each(spark.createDataFrame(rows, DOCS)).collect()}
    prints = {i: simhash.majority(np.unique(simhash.shingle_hashes(t, 5))) for i, t, *_ in rows}
    near = {100 + i for i in range(6) if (prints[i] ^ prints[100 + i]).bit_count() <= 2}
    assert len(near) >= 4 and kept == {i for i, *_ in rows} - near


def test_fingerprints_alone_link_no_unlike_texts(spark, monkeypatch):
    rows = [(i, f"a b c d {i}", "en", "s", None) for i in range(50)]
    monkeypatch.setattr(simhash, "fingerprint_pairs", lambda nodes: nodes.select("node", F.lit(0).alias("k")).alias("x").join(
        nodes.select("node", F.lit(0).alias("k")).alias("y"), "k").filter("x.node > y.node").select(F.col("x.node").alias("u"), F.col("y.node").alias("v")))
    assert simhash.one_of_each(spark.createDataFrame(rows, DOCS)).count() == 50


def test_near_copies_leave_and_clean_texts_stay(spark):
    rng = random.Random(3)
    vocabulary = ["".join(rng.choices("abcdefghij", k=6)) for _ in range(4000)]
    rows, near = [], []
    for i in range(60):
        text = rng.choices(vocabulary, k=400)
        rows.append((i, " ".join(text), "en", "s", None))
        if i % 2:
            for _ in range(3):
                text[rng.randrange(400)] = rng.choice(vocabulary)
            near.append((100 + i, " ".join(text), "en", "s", None))
    kept = {r["doc_id"] for r in simhash.one_of_each(spark.createDataFrame(rows + near, DOCS)).collect()}
    assert kept >= set(range(60)) and len(kept & {i for i, *_ in near}) <= 2


def _copy(rng, base, share):
    """A text whose five-word shingles have a similarity of ``share`` or just above with those of ``base``: new words at the end."""
    n = len(base) - 4
    return base + [f"w{rng.getrandbits(40)}" for _ in range(int(n / share) - n)]


def _similarity(a, b):
    a, b = ({tuple(t[i:i + 5]) for i in range(len(t) - 4)} for t in (a, b))
    return len(a & b) / len(a | b)


def test_no_near_copy_below_the_similarity(spark):
    """Pairs of 0.6 to 0.79, and texts that share nothing but one line repeated very often."""
    rng, rows = random.Random(21), []
    for i in range(120):
        base = [f"w{rng.getrandbits(40)}" for _ in range(300)]
        rows += [(2 * i, base), (2 * i + 1, _copy(rng, base, 0.81) if i < 40 else _copy(rng, base, rng.choice([0.6, 0.7, 0.75, 0.78])))]
    line = "all rights reserved by the owner".split()
    rows += [(1000 + i, line * 200 + [f"w{rng.getrandbits(40)}" for _ in range(150)]) for i in range(4)]
    assert all(_similarity(rows[2 * i][1], rows[2 * i + 1][1]) < 0.8 for i in range(40, 120))
    kept = {r["doc_id"] for r in simhash.one_of_each(spark.createDataFrame([(i, " ".join(t), "en", "s", None) for i, t in rows], DOCS)).collect()}
    assert kept >= {i for i, _ in rows if i >= 80}


@pytest.mark.parametrize("share", [0.8, 0.85, 0.9])
def test_near_copies_found_at_each_similarity(spark, share):
    """Of lone pairs nine in ten at least are found, against the similarity counted in plain Python."""
    rng, rows = random.Random(int(share * 100)), []
    for i in range(150):
        base = [f"w{rng.getrandbits(40)}" for _ in range(300)]
        rows += [(2 * i, base), (2 * i + 1, _copy(rng, base, share))]
    assert all(share <= _similarity(rows[2 * i][1], rows[2 * i + 1][1]) < share + 0.01 for i in range(150))
    kept = {r["doc_id"] for r in simhash.one_of_each(spark.createDataFrame([(i, " ".join(t), "en", "s", None) for i, t in rows], DOCS)).collect()}
    assert kept >= set(range(0, 300, 2)) and len(kept) <= 150 + 15


# --- 2: exact copies ------------------------------------------------------------------------------


@pytest.mark.parametrize("bits", [64, 3])
def test_exact_copies(spark, docs, bits):
    more = docs.unionByName(spark.createDataFrame([(7000, "A b c", None, None, None)] * 2 + [(None, "only null", None, None, None), (None, None, None, None, None)], DOCS))
    want = brute.exact([(r["doc_id"], r["text"]) for r in more.collect()])
    by_sha = {brute.sha(t): v for t, v in want.items()}
    rows = exact.exact_duplicates(more, least=20, most=90, bits=bits).collect()
    assert len(rows) == more.count()
    assert all((r["keep_id"], r["group_size"]) == by_sha[r["text_sha256"]] for r in rows)
    kept = collections.Counter(r["text_sha256"] for r in rows if r["kept"])
    assert set(kept) == set(by_sha) and set(kept.values()) == {1}


def test_chunks_join_to_the_text(spark, docs):
    out = docs.filter("text != ''").select("text", exact.chunks(F.col("text"), 30, 200).alias("c")).collect()
    assert all("".join(r["c"]) == r["text"] and max(map(len, r["c"])) <= 200 for r in out)


def test_without_copies_keeps_columns_and_repeated_rows_once(spark):
    df = spark.createDataFrame([(1, "a", 1), (1, "a", 1), (2, "a", 2), (2, "b", 3), (None, None, 4)], "doc_id long, text string, n long")
    assert sorted(exact.without_copies(df).collect(), key=str) == sorted(df.filter("n in (2, 3, 4)").collect(), key=str)


# --- 3: BPE ---------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def coder():
    return bpe.WordBpe.read(public_tokenizers.path(queries.TOKENIZER))


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    out = Tokenizer.from_file(public_tokenizers.path(queries.TOKENIZER))
    out.no_truncation()
    out.no_padding()
    return out


def odd_texts():
    rng = random.Random(2)
    letters = "aAbBé ßΣσςİıǅ漢字か̧́\x1c\x1f\x85\xa0 ​'sS'LLl dD0١½Ⅻ\x00퟿😀!?.,\n\tﬁaaaaaaa   "
    made = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(800)]
    return made + ["<|endoftext|>x<|startoftext|><|ENDOFTEXT|>", " ", "", "a" * 20000, "'s't're", "ab<|endoftext|>'ll c", "\0<|endoftext|>", None, "it's " * 5000]


def test_encoding_equals_the_library(coder, library):
    texts = odd_texts()
    ids, ends = coder.encode(texts)
    mine = [ids[a:b].tolist() for a, b in zip([0, *ends[:-1].tolist()], ends.tolist())]
    assert mine == [library.encode(t or "", add_special_tokens=False).ids for t in texts]


def test_bpe_over_a_table(spark, coder, library):
    texts = odd_texts()[-60:]
    df = spark.createDataFrame([(i, t, [9], "x") for i, t in enumerate(texts)], "doc_id long, text string, ids array<int>, decoded string")
    both = bpe.decode(bpe.encode(df, coder, part_chars=500), coder)
    assert both.columns == ["doc_id", "text", "ids", "decoded"]
    for r in both.collect():
        ids = library.encode(r["text"] or "", add_special_tokens=False).ids
        assert r["ids"] == ids and r["decoded"] == library.decode(ids, skip_special_tokens=False)
    rows = got(bpe.digests(df, coder), "doc_id")
    assert rows[3]["n_tokens"] == len(library.encode(texts[3] or "", add_special_tokens=False).ids)
    assert rows[3]["ids_sha256"] == brute.sha(" ".join(map(str, library.encode(texts[3] or "", add_special_tokens=False).ids)))


def test_decoding_of_null_and_foreign_ids(spark, coder):
    df = spark.createDataFrame([(1, None), (2, []), (3, [-1, 0, 10**6])], "doc_id long, ids array<int>")
    assert [r["decoded"] for r in bpe.decode(df, coder).orderBy("doc_id").collect()] == [None, "", "!"]


# --- 4: conversations -----------------------------------------------------------------------------


MESSAGES = "conv_id long, message_id long, parent_id long, role string, text string, score double"


def test_reply_tree(spark):
    rows = [
        (1, 1, None, "user", "hi", None), (1, 2, 1, "assistant", "a", 1.0), (1, 3, 1, "assistant", "b", 3.0), (1, 4, 2, "user", "c", 5.0), (1, 5, 3, "user", "d", 1.0),
        (1, 6, 5, "assistant", "e", None), (2, 1, 99, "user", "lost parent", 0.0), (3, 1, 2, "user", "circle", 0.0), (3, 2, 1, "user", "circle", 0.0), (3, 3, 2, "user", "behind", 0.0),
        (None, 1, None, "user", "no conversation", 0.0),
    ]
    df = spark.createDataFrame(rows, MESSAGES)
    paths = chat.best_paths(chat.root_paths(df))
    assert sorted((r["conv_id"], r["leaf_id"], r["rank"], r["path_score"], r["path"]) for r in paths.collect()) == [
        (1, 4, 1, 6.0, [1, 2, 4]), (1, 6, 2, 4.0, [1, 3, 5, 6]), (2, 1, 1, 0.0, [1])]
    done = chat.format_paths(chat.best_paths(chat.root_paths(df), 1), df).filter("conv_id = 1").first()
    assert done["formatted"] == "### User: hi</turn>\n### Assistant: a</turn>\n### User: c</turn>\n"
    assert [done["formatted"][s["start"]:s["end"]] for s in done["loss_spans"]] == ["a"]


def test_long_thread_and_control_strings(spark):
    rng = random.Random(4)
    pieces = ["</turn>", "\n", "\\", "### Assistant: ", "#", "<\\/turn>", "é😀", "", ": ", "\\#", "x"]
    roles = ["user", "assistant", "system", "tool: \\#</turn>", "", None]
    rows = [(c, t, rng.choice(roles), None if rng.random() < 0.1 else "".join(rng.choices(pieces, k=rng.randint(0, 9)))) for c, n in ((1, 70), (2, 1), (3, 9)) for t in range(n)]
    messages = chat.linear_messages(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    out = chat.format_paths(chat.best_paths(chat.root_paths(messages)), messages)
    read = got(out.select("conv_id", chat.read_turns(F.col("formatted")).alias("t"), chat.read_loss(F.col("formatted"), F.col("loss_spans")).alias("l")), "conv_id")
    for c in (1, 2, 3):
        assert [tuple(t) for t in read[c]["t"]] == [(r or "", x or "") for k, _, r, x in rows if k == c]
        assert read[c]["l"] == "".join(x or "" for k, _, r, x in rows if k == c and r == "assistant")


def test_op4_keeps_the_null_conversation(spark, tmp_path):
    rows = [(None, 0, "user", "a"), (None, 1, "assistant", "bc"), (None, 2, "user", "d"), (5, 0, "user", "e"), (5, 1, "assistant", "f")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    out = got(queries.op4_chat(spark, str(tmp_path)), "conv_id")
    assert {c: (r["n_turns"], r["loss_chars"], r["turns_sha256"]) for c, r in out.items() if c != -7} == {
        None: (3, 2, brute.sha("user\na\nassistant\nbc\nuser\nd\n")), 5: (2, 1, brute.sha("user\ne\nassistant\nf\n"))}


# --- 5: URLs --------------------------------------------------------------------------------------


def test_urls(spark):
    rules = spark.createDataFrame([
        ("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("b.com", "/x", "allow"), ("b.com", "/x", "block"), (None, "/", "block"), ("c.com", "", "block"),
    ], "host string, path string, verdict string")
    cases = {
        "http://Sub.EXAMPLE.org/es/1": ("sub.example.org", "/es/1", "example.org/es/", "block"), "https://example.org/en/17?q": ("example.org", "/en/17", "example.org/en/1", "block"),
        "https://example.org": ("example.org", "", None, "allow"), "https://notexample.org/es/": ("notexample.org", "/es/", "org/", "allow"), "x://b.com/xyz#f": ("b.com", "/xyz", "b.com/x", "block"),
        None: ("", "", None, "allow"), "no scheme/es/": ("", "", None, "allow"), "a://c.com?/": ("c.com", "", "c.com", "block"), "://org/": ("org", "/", "org/", "allow"),
        "a://b://c": ("b:", "//c", None, "allow"), "a\n://org/\n/": ("org", "/\n/", "org/", "allow"), "http://" + "a." * 300 + "org/" + "s/" * 300: ("a." * 300 + "org", "/" + "s/" * 300, "org/", "allow"),
    }
    pages = spark.createDataFrame([(i, u, "x", "y") for i, u in enumerate(cases)] + [(0, "https://example.org", "x", "y")], "page_id long, url string, host string, rule string")
    rows = urls.judge(pages, rules).collect()
    assert len(rows) == len(cases) + 1
    by = collections.defaultdict(set)
    for r in rows:
        by[r["page_id"]].add((r["host"], r["path"], r["rule"], r["verdict"]))
    assert all(want in by[i] for i, want in enumerate(cases.values()))


# --- 6: mixing ------------------------------------------------------------------------------------


def test_mix(spark, docs, folder):
    rows = queries.op6_mixing(spark, folder).collect()
    sizes, own = collections.Counter(), {}
    for i, t, _, s, _ in documents():
        sizes[s] += len(brute.WORD.findall(t or ""))
        own[i] = (s, len(brute.WORD.findall(t or "")))
    order = sorted((s for s in sizes if s is not None)) + [None]
    want = brute.targets(sizes, order)
    taken = collections.Counter()
    for r in rows:
        s, n = own[r["doc_id"]]
        assert (r["size"], r["source_size"]) == (n, sizes[s]) and r["target"] == pytest.approx(want[s]) and 0 <= r["taken"] <= 2 * n
        taken[s] += r["taken"]
    assert len(rows) == len(own) and all(abs(taken[s] - want[s]) <= 1 for s in sizes)
    again = got(queries.op6_mixing(spark, folder), "doc_id")
    assert all(again[r["doc_id"]] == r for r in rows)


def test_curriculum_positions(spark):
    df = spark.createDataFrame([(i, s, 10) for s in ("a", "b", "c") for i in range(300)], "doc_id long, source string, size long")
    rows = mixing.in_training_order(mixing.mix(df, ["doc_id"]), ["doc_id"]).collect()
    at = [r["position"] for r in rows]
    assert at == sorted(at) and 0 <= at[0] and at[-1] <= 1
    early = collections.Counter(r["source"] for r in rows if r["position"] < 0.5)
    all_ = collections.Counter(r["source"] for r in rows)
    # weights 2 to 1 by the middle, then to a half: two thirds of its words are due by then; the mirror has a third
    assert early["a"] / all_["a"] == pytest.approx(2 / 3, abs=0.01) and early["b"] / all_["b"] == pytest.approx(1 / 2, abs=0.01) and early["c"] / all_["c"] == pytest.approx(1 / 3, abs=0.01)


def test_mixed_documents_are_read_whole_twice_or_in_part(spark, docs):
    repeated = docs.unionByName(docs.filter("doc_id = 503"))
    out = mixing.mixed_documents(repeated).collect()
    assert out and list(out[0].asDict()) == docs.columns
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert all(texts[r["doc_id"]].startswith(r["text"]) for r in out)
    words_taken = sum(len(brute.WORD.findall(r["text"])) for r in out)
    sizes = sum(len(brute.WORD.findall(r["text"] or "")) for r in repeated.collect())
    assert abs(words_taken - 1.5 * sizes) <= 5


# --- 7: secrets -----------------------------------------------------------------------------------


def secret_texts():
    rng = random.Random(9)
    pieces = [
        "password: hunter2hunter2", "PassWD='abc'", "token = token: abcdefghijkl", "api_key:=x", "apikey=\"A1b2C3d4E5\"", "AKIA" + "A" * 12, "AKIA" + "A" * 11, "AKIA\u00e9AKIA1234567890123",
        "0123456789abcdef" * 2, "0123456789abcdef" * 2 + "g" + "f" * 31, "secret:secret=12345678", "é漢😀", " ", "\n", "deadbeef", "ſecret=abcdefgh1", "toKen=abcdefghij", "api_KEY : 'q.w.e.r.t.y.'",
    ]
    return [None, ""] + ["".join(rng.choices(pieces, k=rng.randint(1, 12))) for _ in range(150)] + ["x " * 40000 + "password=abcdefgh1"]


def test_base_secrets(spark):
    df = spark.createDataFrame(list(enumerate(secret_texts())), "doc_id long, text string").withColumn("base", F.lit(1))
    for r in secrets.scan(df, [F.col("doc_id")]).collect():
        want = brute.base_spans(secret_texts()[r["doc_id"]])
        assert [tuple(s) for s in r["base"]] == want and {tuple(s) for s in r["spans"]} >= set(want)


def test_random_tokens_are_found_and_names_are_not(spark):
    rng = random.Random(12)
    letters = secrets.ENCODINGS["base64"]
    made = ["".join(rng.choices(letters, k=40)) for _ in range(60)]
    names = ["the_quick_brown_fox_jumps_over_2_dogs", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa1", "abcdefghijklmnopqrstuvwxyz0123456789", "internationalization-of-applications1", "1111111122222222333333334444a", "https/www/example/com/page1/page2/page3"]
    df = spark.createDataFrame([(i, f"é key {t} end") for i, t in enumerate(made + names * 5)], "doc_id long, text string")
    rows = got(secrets.scan(df, [F.col("doc_id")]), "doc_id")
    hits = [any(s["kind"] == "random" and (s["start"], s["end"]) == (6, 46) for s in rows[i]["spans"]) for i in range(60)]
    assert sum(hits) >= 54
    assert sum(any(s["kind"] == "random" for s in rows[i]["spans"]) for i in range(60, len(rows))) <= 5


# --- 8: vectors -----------------------------------------------------------------------------------


def test_lattice_points():
    rng = np.random.default_rng(1)
    y = rng.normal(size=(200, 8)) * 2
    p = lattice.decode(y)
    twice = np.rint(p * 2).astype(int)
    assert ((twice % 2 == 0).all(1) | (twice % 2 != 0).all(1)).all() and (np.rint(p.sum(1)).astype(int) % 2 == 0).all()
    near = lattice.roots()
    assert len(near) == 240 and np.allclose((near**2).sum(1), 2)
    # no neighbour is nearer
    assert (((y - p) ** 2).sum(1)[:, None] <= ((y[:, None] - p[:, None] - near) ** 2).sum(2) + 1e-9).all()


@pytest.mark.parametrize("dims", [64, 5])
def test_vectors(spark, dims):
    rng = np.random.default_rng(dims)
    rows = []
    for i in range(150):
        v = rng.normal(size=dims)
        rows.append((i, v.tolist(), i % 3))
        if i % 3 == 0:
            rows += [(1000 + i * 5 + j, (v * 2 + rng.normal(size=dims) * np.linalg.norm(v) * 0.2 / np.sqrt(dims)).tolist(), i % 3 if j < 3 else 1) for j in range(5)]
            rows += [(3000 + i, v.tolist(), i % 3), (4000 + i, v.tolist(), i % 3), (5000 + i, v.tolist(), None)]
    rows += [(9000, None, 0), (9001, [0.0] * dims, 0), (9002, [float("nan")] * dims, 0), (9003, [None] * dims, 0), (9004, [], 0), (9005, [float("inf")] + [1.0] * (dims - 1), 0), (9006, [1.0, 2.0], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("id", F.lit("x"))
    out = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in lattice.near_vectors(df).collect()}
    want = brute.near_vectors(rows)
    links = sum(n for n, _ in want.values())
    assert set(out) == set(want) and all(out[i][0] <= want[i][0] for i in want)
    assert sum(n for n, _ in out.values()) >= (0.97 if dims == 64 else 0.9) * links and all(out[i] == (0, i) for i in range(9000, 9007))


# --- 9: languages ---------------------------------------------------------------------------------


def test_languages(spark):
    rng = random.Random(6)
    lexicon = {"aa": ["kolu", "taro", "mikata", "suni", "hokena"], "bb": ["brisch", "tzwer", "gnopf", "schlant", "drung"], "ру": ["слово", "дело", "мирно", "жизнь"]}
    rows = [(i, " ".join(rng.choices(lexicon[g], k=30)), g, None, None) for i, g in enumerate(list(lexicon) * 40)]
    model = langid.learned(spark.createDataFrame(rows, DOCS))
    assert model.languages == sorted(lexicon)
    mixed = "kolu taro mikata suni hokena taro " * 3 + "brisch tzwer gnopf schlant drung " * 3
    cases = [(1, mixed), (2, "слово дело"), (3, None), (4, " 12 !? "), (5, ""), (6, "Brisch"), (7, "漢字 slovo"), (8, "taro " * 40000), (9, "İİ kolu taro")]
    out = got(langid.identify(spark.createDataFrame(cases, "doc_id long, text string"), model, [F.col("doc_id")], part_chars=50), "doc_id")
    assert [out[i]["lang_pred"] for i in (2, 3, 4, 5, 6, 8)] == ["ру", "und", "und", "und", "bb", "aa"] and out[3]["score"] == 0.0
    spans = [(mixed[s["start"]:s["end"]], s["lang"]) for s in out[1]["spans"]]
    assert [g for _, g in spans] == ["aa", "bb"] and spans[0][0].startswith("kolu") and spans[1][0].startswith("brisch") and spans[1][0].endswith("drung")
    assert 0 < out[1]["score"] < 1
    held = got(spark.createDataFrame([(r[0],) for r in rows] + [(None,)], "doc_id long").withColumn("h", langid.held_out()), "doc_id")
    assert all(held[i]["h"] == brute.held_out(i) for i in held)


def viterbi(scores, switch):
    """One text at a time."""
    ways = [(s, (k,)) for k, s in enumerate(scores[0])]
    for row in scores[1:]:
        best = max(ways)
        ways = [max(ways[k], (best[0] - switch, best[1])) for k in range(len(row))]
        ways = [(w[0] + s, (*w[1], k)) for k, (w, s) in enumerate(zip(ways, row))]
    return max(ways)[1]


def test_labels_equal_viterbi_of_single_texts():
    rng = np.random.default_rng(3)
    counts = np.array([5, 0, 1, 30, 12, 12])
    scores = rng.normal(size=(counts.sum(), 3)).astype(np.float32) * 3
    starts = np.cumsum(counts) - counts
    labels = langid.label_words(scores, starts, counts, 2.5)
    for a, n in zip(starts, counts):
        assert not n or tuple(labels[a:a + n]) == viterbi(scores[a:a + n].astype(float), 2.5)


def test_without_labels_everything_is_undetermined(spark, empty):
    model = langid.learned(empty)
    assert model.languages == []
    df = spark.createDataFrame([(1, "words here")], "doc_id long, text string")
    assert langid.identify(df, model, [F.col("doc_id")]).first()["lang_pred"] == "und"


# --- 10: repeated passages ------------------------------------------------------------------------


def passages(seed=8):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(500)] + ["é", "漢"]
    shared = [rng.choices(vocabulary, k=k) for k in (34, 35, 36, 60, 200)]
    out = []
    for i in range(60):
        text = rng.choices(vocabulary, k=rng.choice([0, 10, 50, 200]))
        for _ in range(rng.randint(0, 2)):
            at = rng.randint(0, len(text))
            text[at:at] = rng.choice(shared)
        out.append(rng.choice([" ", "\n", "  "]).join(text))
    return out + [out[3], out[5], None, "", "a " * 100, "a b " * 60, "x\u00a0y " * 3]


@pytest.mark.parametrize("length,first", [(35, 18), (35, 9), (35, 35), (3, 2), (1, 1)])
def test_repeats(spark, length, first):
    texts = passages()
    df = spark.createDataFrame([(i // 2 if i > 4 else i, i, t) for i, t in enumerate(texts)], "doc_id long, n_words long, text string")
    rows = substrings.without_repeats(df.withColumnRenamed("n_words", "at"), [F.col("at").alias("row")], length=length, first=first).collect()
    want = brute.without_repeats(texts, length)
    assert len(rows) == len(texts)
    assert {r["row"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in rows} == dict(enumerate(want))


# --- nothing at all, and columns in the way -------------------------------------------------------


def test_empty_documents(spark, empty, tmp_path):
    empty.write.parquet(f"{tmp_path}/documents.parquet")
    for q in (queries.op1_simhash, queries.op2_exact_dedup, queries.op3_bpe, queries.op6_mixing, queries.op7_secrets, queries.op9_language, queries.op10_substrings):
        assert q(spark, str(tmp_path)).count() == 0, q.__name__
    assert urls.judge(spark.createDataFrame([], "page_id long, url string"), spark.createDataFrame([], "host string, path string, verdict string")).count() == 0
    assert lattice.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0
    assert chat.root_paths(spark.createDataFrame([], MESSAGES)).count() == 0


def test_rules_may_be_missing(spark):
    pages = spark.createDataFrame([(1, "http://a.org/x")], "page_id long, url string")
    assert urls.judge(pages, spark.createDataFrame([], "host string, path string, verdict string")).first()["verdict"] == "allow"


def test_clashing_columns(spark, docs):
    names = [
        "group", "f0", "node", "key", "_k1", "_text", "recipe", "n", "size", "taken", "passes", "spans", "lang_pred", "ids", "position", "_doc", "_own", "_n", "_id", "_sha", "_p", "_size",
        "_passes", "_rows", "_position", "_tie", "_text_hash", "row", "own", "id", "sha", "least", "meets", "bits", "elements", "_body", "_order", "hash", "hashes", "a.b",
    ]
    wide = docs.select("*", *[F.lit(f"value {n}").alias(n) for n in names])
    for out in (exact.without_copies(wide), simhash.one_of_each(wide), mixing.mixed_documents(wide)):
        assert out.columns == wide.columns
        first = out.first()
        assert [first[n] for n in names] == [f"value {n}" for n in names]
    kept = langid.in_a_language(wide)
    assert kept.columns == wide.columns and kept.filter("doc_id in (500, 501, 502, 506)").count() == 0 and kept.count() > 10
    assert substrings.without_repeats(wide, [F.col("doc_id")]).count() == wide.count()
    assert len(secrets.scan(wide, [F.col("doc_id")]).collect()) == wide.count()


# --- values at the ends of what is allowed -------------------------------------------------------


@pytest.mark.parametrize("size", [1e-200, 1e-310, 1.0, 1e200, 1.7e308])
def test_vectors_of_any_size_are_compared_by_direction(spark, size):
    """0.973 apart is no link at 0.98, 0.999 is, whatever the components' size."""
    rows = [(1, [size, 0.0]), (2, [size * 0.973, size * 0.2308]), (3, [size * 0.5, size * 0.01]), (4, [0.0, size]), (5, [-size, 0.0])]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<double>, label int")
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in lattice.near_vectors(df, tables=8, probes=240).collect()}
    assert got == {1: (1, 1), 2: (0, 2), 3: (1, 1), 4: (0, 4), 5: (0, 5)}


def test_a_role_of_a_million_letters(spark):
    role = "ro\\le:" * 150_000
    rows = spark.createDataFrame([(1, 0, role, "a"), (1, 1, "assistant", "b")], "conv_id long, turn long, role string, text string")
    messages = chat.linear_messages(rows)
    done = chat.format_paths(chat.best_paths(chat.root_paths(messages)), messages)
    turns = done.select(chat.read_turns(F.col("formatted")).alias("t")).first()["t"]
    assert [(t["role"], t["text"]) for t in turns] == [(role, "a"), ("assistant", "b")]


def test_texts_on_one_template_stay_apart(spark):
    """Texts that share bands without being near copies are not all compared with each other."""
    rng = random.Random(8)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(400):
        own = list(base)
        for at in rng.sample(range(60), 3):
            own[at] = f"x{i}y{at}"
        rows.append((i, " ".join(own), "en", "s", None))
    near = [(1000 + i, rows[i][1] + " end", "en", "s", None) for i in range(0, 400, 8)]
    real, asked = simhash.similar, []

    def counted(pairs, sets):
        asked.append(pairs.count())
        return real(pairs, sets)

    simhash.similar = counted
    try:
        kept = {r["doc_id"] for r in simhash.one_of_each(spark.createDataFrame(rows + near, DOCS)).collect()}
    finally:
        simhash.similar = real
    assert kept == set(range(400)) and sum(asked) < 12 * len(rows)


# --- long texts, threads and rule lists ------------------------------------------------------------


def test_rules_of_one_folder(spark):
    """Hundreds of rules under few folders against a search over all rules."""
    rng = random.Random(31)
    word = lambda n: "".join(rng.choices("ab/é", k=rng.randint(0, n)))
    rules = [(rng.choice(["x.org", "org", "b.X.org"]), "/f/" + word(6), rng.choice(["allow", "block", "block", None])) for _ in range(400)] + [("x.org", "", "allow")] * 3
    pages = [(i, f"http://{rng.choice(['x.org', 'b.x.org', 'c.b.x.org', 'y.org', 'xx.org'])}{rng.choice(['/f/', '/', ''])}{word(9)}{rng.choice(['', '?q/', '#'])}") for i in range(600)]
    frames = spark.createDataFrame(pages, "page_id long, url string"), spark.createDataFrame(rules, "host string, path string, verdict string")
    for limit in (urls.BROADCAST_BYTES, 0):
        with pytest.MonkeyPatch.context() as patch:
            patch.setattr(urls, "BROADCAST_BYTES", limit)
            rows = got(urls.judge(*frames), "page_id")
        for i, url in pages:
            host, path = rows[i]["host"], rows[i]["path"]
            assert url.startswith(f"http://{host}{path}")
            fits = [(h.lower() + p, v) for h, p, v in rules if v and (host == h.lower() or host.endswith("." + h.lower())) and path.startswith(p)]
            want = min(fits, key=lambda f: (-len(f[0]), f[1] != "block", f[0]), default=(None, "allow"))
            assert (rows[i]["rule"], rows[i]["verdict"]) == want, url


def test_a_thread_of_many_turns_and_a_wide_tree(spark):
    """Rows stay as many as the messages of all paths: 30,000 in one line, 2,000 leaves under one message."""
    line = spark.range(30_000).select(F.lit(1).cast("long").alias("conv_id"), "id", F.when(F.col("id") > 0, F.col("id") - 1).alias("parent_id"))
    wide = spark.range(2_003).select(F.lit(2).cast("long").alias("conv_id"), "id", F.when(F.col("id") > 0, F.least(F.col("id") - 1, F.lit(2))).alias("parent_id"))
    df = line.unionByName(wide).select("conv_id", F.col("id").alias("message_id"), "parent_id", F.lit(1.0).alias("score"))
    paths = chat.root_paths(df).select("conv_id", "leaf_id", "path_score", F.sha2(F.array_join("path", ","), 256).alias("path"), F.size("path").alias("n")).collect()
    assert [(r["leaf_id"], r["path_score"], r["n"], r["path"]) for r in paths if r["conv_id"] == 1] == [(29_999, 30_000.0, 30_000, brute.sha(",".join(map(str, range(30_000)))))]
    assert {(r["leaf_id"], r["path_score"], r["path"]) for r in paths if r["conv_id"] == 2} == {(i, 4.0, brute.sha(f"0,1,2,{i}")) for i in range(3, 2_003)}


def test_a_text_of_many_tokens(spark):
    """Positions and overlaps over 20,000 matches of one text."""
    rng = random.Random(8)
    text = " ".join(rng.choice(["é", "😀😀", ""]) + "".join(rng.choices("abcdef0123456789" if i % 2 else secrets.ENCODINGS["base64"], k=rng.choice((24, 40)))) for i in range(20_000))
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    tokens = F.transform(secrets.find(F.col("text"), secrets.CANDIDATE), lambda s: F.struct(s["start"], s["end"], s["found"]))
    assert [tuple(t) for t in df.select(tokens.alias("t")).first()["t"]] == [(m.start(), m.end(), m.group()) for m in re.finditer(secrets.CANDIDATE, text)]
    row = secrets.scan(df, [F.col("doc_id")]).first()
    base = brute.base_spans(text)
    assert [tuple(s) for s in row["base"]] == base and len(base) > 4_000
    taken = bytearray(len(text))
    for a, _, _, b in base:
        taken[a:b] = b"1" * (b - a)
    made = [s for s in row["spans"] if s["kind"] == "random"]
    assert len(made) > 8_000 and not any(any(taken[s["start"]:s["end"]]) for s in made)
