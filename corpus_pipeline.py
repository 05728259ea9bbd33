"""From documents to token ids: language, exact and near copies, mix, tokens.

STAGES lists the stages in order; ``run`` applies them to the documents of a
folder. What a stage returns is written as Parquet in the shared folder that
spark.checkpoint.dir names and read again, so a later stage neither repeats an
earlier one nor needs its executors.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from entitymill.llm import bpe, exact, langid, mixing, simhash
from entitymill.session import ensure_checkpoint_dir

TOKENIZER = "word_bpe_49k.json"


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without a letter or text; all others have a language and stay."""
    return langid.in_a_language(docs)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest doc_id stays."""
    return exact.without_copies(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that share about 0.8 of their five-word shingles, directly or through others, the one with the smallest doc_id stays."""
    return simhash.one_of_each(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in training order, some twice, the last of a source in part; sources meet their target weights."""
    return mixing.mixed_documents(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens, ids, and the digest of the text that the ids decode to."""
    coder = bpe.WordBpe.read(public_tokenizers.path(TOKENIZER))
    both = bpe.round_trip(docs.select("doc_id", "lang", "source", "text"), coder)
    return both.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [("language", language), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup), ("mix_sources", mix_sources), ("tokens", tokens)]

#: SQL can express neither the language model nor the fingerprints; the tests hold every stage against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents in ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    place = f"{ensure_checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{place}/{name}")
        docs = spark.read.parquet(f"{place}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
