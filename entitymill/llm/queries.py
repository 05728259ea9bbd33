"""The operators as registered queries, with SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import bpe, chat, collocations, decontaminate, exact, langid, lattice, mixing, repair, secrets, simhash, substrings, urls

TOKENIZER = "word_bpe_49k.json"
#: (host, path, verdict): fixed values.
RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"))


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: its fingerprint of 3-word shingles and the smallest doc_id reachable over links of at most 2 differing bits; null and wordless texts have fingerprint zero and link as any other."""
    docs = _table(spark, sf_dir, "documents")
    near = simhash.near_duplicates(docs, [F.col("doc_id")], F.col("doc_id"), "text", shingle=3, words=1, max_bits=2, width=32)
    return near.select("doc_id", F.lower(F.lpad(F.hex("f0"), 16, "0")).alias("fingerprint"), F.col("least").alias("component_id"))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: the doc_id that stays of its text (the largest), the size of its group and the text's digest; a null text counts as empty."""
    return exact.exact_duplicates(_table(spark, sf_dir, "documents")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: its number of tokens and the digests of its ids and of what they decode to; a null text counts as empty."""
    return bpe.digests(_table(spark, sf_dir, "documents"), bpe.WordBpe.read(public_tokenizers.path(TOKENIZER)))


def op4_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per conversation, and conversation -7: digests of its turns and of the text under the loss mask, read back from the formatted text; null roles and texts count as empty, a null conv_id is one conversation."""
    text = "\\### Assistant: </turn> ok"
    more = spark.range(1).select(F.lit(-7).cast("long").alias("conv_id"), F.explode(F.array(
        F.struct(F.lit(0).cast("long").alias("turn"), F.lit("user").alias("role"), F.lit(text).alias("text")),
        F.struct(F.lit(1).cast("long").alias("turn"), F.lit("assistant").alias("role"), F.lit(text).alias("text")),
    )).alias("t")).select("conv_id", "t.*")
    messages = chat.linear_messages(_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(more))
    done = chat.format_paths(chat.best_paths(chat.root_paths(messages, null_conversation=True)), messages)
    read = done.withColumns({"turns": chat.read_turns(F.col("formatted")), "loss": chat.read_loss(F.col("formatted"), F.col("loss_spans"))})
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per page: host, path, the rule that decides and its verdict; a null url or one without :// has an empty host and path."""
    rules = spark.createDataFrame(list(RULES), "host string, path string, verdict string")
    return urls.judge(_table(spark, sf_dir, "pages"), rules)


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: its words, those of its source, the source's target, the words the mix takes and the training positions; a null source is one source, a null text has no words."""
    sized = mixing.sized_documents(_table(spark, sf_dir, "documents"), [F.col("doc_id")])
    mixed = mixing.mix(sized, ["doc_id"])
    return mixed.select(
        "doc_id", "size", "source_size", "target", "taken",
        F.try_element_at("passes", F.lit(1))["position"].alias("position"), F.try_element_at("passes", F.lit(2))["position"].alias("position_again"),
    ).orderBy("position", "doc_id")


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: counts and digest of the fixed patterns' spans, and all spans with the random tokens; a null text counts as empty."""
    found = secrets.scan(_table(spark, sf_dir, "documents"), [F.col("doc_id")])

    def n(kind: str) -> F.Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select(
        "doc_id", n("assign"), n("access"), n("hex"), F.sha2(secrets.written(F.col("base")), 256).alias("base_sha256"), secrets.written(F.col("spans")).alias("spans"))


def op8_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per vector: its links at cosine 0.98 within its label and the smallest vec_id reachable; vectors or labels that cannot be compared link with nothing."""
    return lattice.near_vectors(_table(spark, sf_dir, "embeddings"))


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: its predicted language, und without a letter, and the score; learned from labelled documents that are not held out."""
    docs = _table(spark, sf_dir, "documents")
    found = langid.identify(docs, langid.learned(docs), [F.col("doc_id"), langid.held_out().alias("held_out")])
    return found.select("doc_id", "held_out", "lang_pred", "score", F.size("spans").cast("long").alias("n_spans"))


def op10_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: its words, how many a repeated window of 35 words covers, and the digest of the others; a null text has no words."""
    return substrings.without_repeats(_table(spark, sf_dir, "documents"), [F.col("doc_id")])


def op11_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Damaged conversations, all of them, with the cheapest repair of each; one without a row left has zeros."""
    turns = _table(spark, sf_dir, "conversations")
    left = repair.damaged(turns)
    same = F.struct("conv_id").alias("same")  # a null conversation is one
    every = turns.select(same).distinct()
    found = every.join(repair.repaired(left).select("*", same), "same", "left").join(repair.turn_gaps(left).select("gaps", same), "same", "left")
    zero = F.lit(0).cast("long")
    return found.select(
        "same.conv_id", *[F.coalesce(c, zero).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")],
        F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every language's first 2,000 phrases of 2 to 5 words that occur 100 times or more in all documents."""
    return collocations.collocations(_table(spark, sf_dir, "documents"))


def op13_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its words that lie in a run of 10 words of a benchmark item, and the items met."""
    found = decontaminate.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    met = F.coalesce("items", F.array().cast(found.schema["items"].dataType))
    n_hit = F.aggregate(F.coalesce("spans", F.array().cast(found.schema["spans"].dataType)), F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    written = F.array_join(F.sort_array(F.transform(met, lambda i: i.cast("string"))), ",")
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size(met).cast("long").alias("n_items"), F.sha2(written, 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        op1_simhash, op2_exact_dedup, op3_bpe, op4_chat, op5_url_filter, op6_mixing, op7_secrets, op8_lattice, op9_language, op10_substrings,
        op11_repair, op12_collocations, op13_decontaminate)
}

#: Fixed text of conversation -7, in SQL.
_PLANTED = "'\\### Assistant: </turn> ok'"

ORACLES: dict[str, str] = {
    "op2_exact_dedup": """
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents)
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, sha256(t) AS text_sha256
        FROM d WINDOW w AS (PARTITION BY t)
    """,
    "op4_chat": f"""
        WITH m AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT -7, 0, 'user', {_PLANTED} UNION ALL SELECT -7, 1, 'assistant', {_PLANTED}
        ), n AS (
            SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS turns,
                coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '') AS loss,
                sum(length(CASE role WHEN 'user' THEN '### User: ' WHEN 'assistant' THEN '### Assistant: ' WHEN 'system' THEN '### System: '
                    ELSE '### role/' || role || ': ' END) + length(text) + length('</turn>') + 1
                    + (length(text) - length(replace(text, '\\', ''))) + (length(text) - length(replace(text, '#', '')))
                    + (length(text) - length(replace(text, '</turn>', ''))) / 7) AS formatted_chars
            FROM m GROUP BY conv_id
        )
        SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, cast(formatted_chars AS BIGINT) AS formatted_chars FROM n
    """,
    "op5_url_filter": r"""
        WITH rules(rh, rp, v) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
        cut AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
        parts AS (
            SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut
        ), fits AS (
            SELECT page_id, arg_max({'r': rh || rp, 'v': v}, length(rh || rp)) AS b FROM parts, rules
            WHERE (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY page_id
        )
        SELECT p.page_id, host, path, b.r AS rule, coalesce(b.v, 'allow') AS verdict FROM parts p LEFT JOIN fits USING (page_id)
    """,
    "op10_substrings": r"""
        WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
        windows AS (
            SELECT rid, p, array_to_string(ws[p:p + 34], ' ') AS gram
            FROM d, LATERAL (SELECT unnest(range(1, len(ws) - 33)) AS p) WHERE len(ws) >= 35
        ), again AS (SELECT gram FROM windows GROUP BY gram HAVING count(*) > 1),
        gone AS (SELECT DISTINCT rid, p + o AS i FROM windows JOIN again USING (gram), range(0, 35) AS t(o)),
        words AS (SELECT rid, unnest(ws) AS w, unnest(range(1, len(ws) + 1)) AS i FROM d),
        kept AS (SELECT rid, count(*) AS n_kept, string_agg(w, ' ' ORDER BY i) AS body FROM words ANTI JOIN gone USING (rid, i) GROUP BY rid)
        SELECT doc_id, len(ws) AS n_words, len(ws) - coalesce(n_kept, 0) AS n_removed, sha256(coalesce(body, '')) AS kept_sha256
        FROM d LEFT JOIN kept USING (rid)
    """,
    "op12_collocations": r"""
        WITH pieces AS (
            SELECT coalesce(lang, 'und') AS lang,
                unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
            FROM documents
        ), words AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS ws FROM pieces),
        counts AS (
            SELECT lang, k, array_to_string(ws[i:i + k - 1], ' ') AS gram, count(*) AS f
            FROM words, range(1, 6) AS t(k), LATERAL (SELECT unnest(range(1, len(ws) - k + 2)) AS i) GROUP BY ALL
        ), totals AS (SELECT lang, sum(f) AS n FROM counts WHERE k = 1 GROUP BY lang),
        candidates AS (SELECT lang, k, gram, f AS a FROM counts WHERE k > 1 AND f >= 100),
        inside AS (
            SELECT lang, array_to_string(string_split(gram, ' ')[i:i + m - 1], ' ') AS gram, max(a) AS longer
            FROM candidates, range(2, 5) AS t(m), LATERAL (SELECT unnest(range(1, k - m + 2)) AS i) WHERE m < k GROUP BY ALL
        ), cuts AS (
            SELECT c.*, j, array_to_string(string_split(c.gram, ' ')[1:j], ' ') AS head, array_to_string(string_split(c.gram, ' ')[j + 1:], ' ') AS tail
            FROM candidates c LEFT JOIN inside i ON c.lang = i.lang AND c.gram = i.gram, range(1, 5) AS t(j)
            WHERE j < c.k AND (longer IS NULL OR 100 * longer < 100 * a)
        ), scored AS (
            SELECT cuts.lang, cuts.gram AS phrase, a, x.f AS l, y.f AS r, n::BIGINT AS n, j, ((1000::HUGEINT * a * n) // (x.f::HUGEINT * y.f))::BIGINT AS score
            FROM cuts JOIN counts x ON x.lang = cuts.lang AND x.gram = head JOIN counts y ON y.lang = cuts.lang AND y.gram = tail JOIN totals ON totals.lang = cuts.lang
        ), lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1)
        SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
        FROM lowest QUALIFY rank <= 2000
    """,
    "op13_decontaminate": r"""
        WITH i AS (
            SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark
        ), windows AS (
            SELECT DISTINCT item_id, least(len(ws), 10) AS m, array_to_string(ws[p:p + least(len(ws), 10) - 1], ' ') AS gram
            FROM i, LATERAL (SELECT unnest(range(1, len(ws) - least(len(ws), 10) + 2)) AS p) WHERE len(ws) > 0
        ), d AS (
            SELECT row_number() OVER () AS rid, doc_id,
                regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
            FROM documents
        ), hits AS (
            SELECT rid, p, d.m, item_id FROM (
                SELECT rid, m, p, array_to_string(ws[p:p + m - 1], ' ') AS gram
                FROM d, (SELECT DISTINCT m FROM windows), LATERAL (SELECT unnest(range(1, len(ws) - m + 2)) AS p)
            ) d JOIN windows USING (m, gram)
        ), hit AS (SELECT rid, count(DISTINCT p + o) AS n_hit FROM hits, range(0, 10) AS t(o) WHERE o < m GROUP BY rid),
        items AS (SELECT rid, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT rid, item_id::VARCHAR AS item_id FROM hits) GROUP BY rid)
        SELECT doc_id, len(ws) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
        FROM d LEFT JOIN hit USING (rid) LEFT JOIN items USING (rid)
    """,
}
