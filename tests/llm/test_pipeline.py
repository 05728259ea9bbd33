"""The pipeline against plain Python: what each stage keeps, and what comes out at the end."""

from __future__ import annotations

import collections
import random
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))

import brute  # noqa: E402

public_tokenizers = pytest.importorskip("public_tokenizers")

import corpus_pipeline  # noqa: E402

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def corpus():
    """(rows, ids that stay until the mix): clean texts, exact and near copies, texts without a letter."""
    rng = random.Random(11)
    words = {g: ["".join(rng.choices(letters, k=6)) for _ in range(3000)] for g, letters in (("aa", "kotarimuse"), ("bb", "bgdrschtzw"))}
    rows, stay = [], set()
    for i in range(60):
        g = "ab"[i % 2] * 2
        text = rng.choices(words[g], k=300)
        rows.append([i, " ".join(text), g, f"s{i % 4}" if i % 9 else None])
        stay.add(i)
        if i % 5 == 0:  # the largest id of an exact group stays
            rows.append([1000 + i, " ".join(text), g, "s1"])
            stay ^= {i, 1000 + i}
        elif i % 5 == 1:  # the smallest of a near group
            for j in range(2):
                near = list(text)
                near[rng.randrange(300)] = rng.choice(words[g])
                rows.append([2000 + 10 * i + j, " ".join(near), g, "s2"])
    rows += [[9000, None, "aa", "s0"], [9001, " 12 - 34 ", None, "s0"], [9002, "", None, None]]
    rng.shuffle(rows)
    return [(*r, len(r[1] or "")) for r in rows], stay


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """What every stage returned, by name, and the input's folder."""
    place = tmp_path_factory.mktemp("corpus")
    spark.createDataFrame(corpus()[0], DOCS).repartition(3).write.parquet(f"{place}/documents.parquet")
    docs, out = spark.read.parquet(f"{place}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, str(place)).write.parquet(f"{place}/{name}")
        docs = out[name] = spark.read.parquet(f"{place}/{name}")
    return out, str(place)


def test_order_and_columns(stages):
    assert list(stages[0]) == ["language", "exact_dedup", "near_dedup", "mix_sources", "tokens"]
    assert all(stages[0][n].columns == [c.split()[0] for c in DOCS.split(", ")] for n in list(stages[0])[:-1])


def test_what_each_stage_keeps(stages):
    rows, stay = corpus()
    ids = {n: {r["doc_id"] for r in df.select("doc_id").collect()} for n, df in stages[0].items()}
    lettered = {i for i, t, *_ in rows if any(c.isalpha() for c in t or "")}
    assert ids["language"] == lettered
    groups = collections.defaultdict(list)
    for i, t, *_ in rows:
        if i in lettered:
            groups[t].append(i)
    assert ids["exact_dedup"] == {max(g) for g in groups.values()}
    assert ids["near_dedup"] == stay


def test_mix_and_tokens(stages):
    rows, stay = corpus()
    text, source = {i: t for i, t, *_ in rows}, {i: s for i, _, _, s, _ in rows}
    sizes = collections.Counter()
    for i in stay:
        sizes[source[i]] += len(brute.WORD.findall(text[i]))
    want = brute.targets(sizes, sorted(s for s in sizes if s is not None) + [None])
    mixed = stages[0]["mix_sources"].collect()
    taken = collections.Counter()
    for r in mixed:
        assert text[r["doc_id"]].startswith(r["text"]) and r["source"] == source[r["doc_id"]]
        taken[r["source"]] += len(brute.WORD.findall(r["text"]))
    assert all(abs(taken[s] - want[s]) <= 1 for s in sizes)
    assert all(n <= 2 for n in collections.Counter(r["doc_id"] for r in mixed).values())
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path(corpus_pipeline.TOKENIZER))
    library.no_truncation()
    library.no_padding()
    made = collections.Counter((r["doc_id"], r["n_tokens"], tuple(r["ids"]), r["decoded_sha256"]) for r in stages[0]["tokens"].collect())
    known = collections.Counter()
    for r in mixed:
        ids = library.encode(r["text"], add_special_tokens=False).ids
        known[(r["doc_id"], len(ids), tuple(ids), brute.sha(library.decode(ids, skip_special_tokens=False)))] += 1
    assert made == known


def test_run_equals_the_stages(spark, stages):
    out = corpus_pipeline.run(spark, stages[1])
    key = lambda df: sorted((r["doc_id"], r["n_tokens"], r["decoded_sha256"]) for r in df.collect())
    assert key(out) == key(stages[0]["tokens"])


def test_nothing_in_nothing_out(spark, tmp_path):
    spark.createDataFrame([], DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
