"""op7 to op10 as registered, over whole tables, against plain Python and held-out labels."""

from __future__ import annotations

import os
import random
import string
import sys

import pytest

pytest.importorskip("entitymill.llm.queries")
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import brute  # noqa: E402
from entitymill.llm import queries  # noqa: E402

KINDS = ("assign", "access", "hex")


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").orderBy("doc_id").collect()


PLANTED = [
    "password = hunter2hunter2", "Token:'a.b.c.d.e.f'", "api_key=\"A1b2C3d4E5\"", "AKIA" + "Q7" * 8, "0123456789abcdef" * 2, "secret:short", "AKIA1234",
    "é漢😀 apikey:=12345678", "0123456789abcdef" * 2 + "f" * 32,
]


def test_op7_over_documents_and_planted_secrets(spark, docs, tmp_path):
    """The query's own columns against plain Python, and which random tokens the randomness tests report."""
    rng = random.Random(21)
    texts = {d["doc_id"]: d["text"] for d in docs}
    first = max(texts) + 1
    for i in range(60):
        texts[first + i] = "\n".join(rng.choices(PLANTED, k=rng.randint(1, 6)))
    made, plain = {}, {}
    for i in range(300):
        at = first + 100 + i
        made[at] = "".join(rng.choices(string.ascii_letters + string.digits, k=rng.choice((32, 40, 64))))
        texts[at] = f"the value {made[at]} was seen"
        plain[at + 1000] = "_".join(rng.choices(("user", "list", "page", "total", "count", "index", "value", "2024", "v2"), k=6))
        texts[at + 1000] = f"the value {plain[at + 1000]} was seen"
    texts[first + 3000] = None
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    rows = {r["doc_id"]: r for r in queries.op7_secrets(spark, str(tmp_path)).collect()}
    assert set(rows) == set(texts)
    seen = dict.fromkeys(KINDS, 0)
    for i, text in texts.items():
        base, r = [(kind, a, b) for a, _, kind, b in brute.base_spans(text)], rows[i]
        n = [sum(k == kind for k, _, _ in base) for kind in KINDS]
        assert [r["n_assign"], r["n_access"], r["n_hex"]] == n
        assert r["base_sha256"] == brute.sha(",".join(f"{k}:{a}:{b}" for k, a, b in base))
        assert {f"{k}:{a}:{b}" for k, a, b in base} <= set(r["spans"].split(","))
        for kind, m in zip(KINDS, n):
            seen[kind] += m
    assert all(seen.values())
    found = sum(f"random:10:{10 + len(t)}" in rows[i]["spans"].split(",") for i, t in made.items())
    wrong = sum("random" in rows[i]["spans"] for i in plain)
    print(f"random tokens: recall {found / len(made):.3f}, precision {found / max(1, found + wrong):.3f}")
    assert found >= 0.95 * len(made) and wrong <= 0.05 * len(plain)


def test_op8_links(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label").collect()
    want = brute.near_vectors([tuple(r) for r in table])
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in queries.op8_lattice(spark, sf_dir).collect()}
    assert set(got) == set(want) and all(k == (i == c) for i, (_, c, k) in got.items())
    assert all(got[i][0] <= want[i][0] for i in want)
    assert sum(n for n, _, _ in got.values()) >= 0.9 * sum(n for n, _ in want.values())


def test_op9_on_held_out_labels(spark, sf_dir, docs):
    rows = {r["doc_id"]: r for r in queries.op9_language(spark, sf_dir).collect()}
    assert set(rows) == {d["doc_id"] for d in docs}
    assert all(rows[d["doc_id"]]["held_out"] == brute.held_out(d["doc_id"]) and 0 <= rows[d["doc_id"]]["score"] <= 1 for d in docs)
    learned = {d["lang"] for d in docs if d["lang"] and d["text"] is not None and not brute.held_out(d["doc_id"])}
    assert {r["lang_pred"] for r in rows.values()} <= learned | {"und"}
    judged = [(rows[d["doc_id"]]["lang_pred"], d["lang"]) for d in docs if brute.held_out(d["doc_id"]) and d["lang"] and any(c.isalpha() for c in d["text"] or "")]
    right = sum(a == b for a, b in judged) / len(judged)
    print(f"held out: {len(judged)} documents, {right:.4f} right")
    assert len(judged) >= 20 and right >= 0.9


def test_op10_kept_words(spark, sf_dir, docs):
    want = brute.without_repeats([d["text"] for d in docs], 35)
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in queries.op10_substrings(spark, sf_dir).collect()}
    assert got == {d["doc_id"]: w for d, w in zip(docs, want)}
    assert any(w[1] for w in want)
