"""Evidence of the latest completed run: export side by side, read back; documents of others."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import ArrayType, StructType

from entitymill import schemas
from entitymill.operators.browse import latest_completed

SOURCE_COLUMNS = [
    "id", "run_id", "source_type", "external_id", "raw_name", "raw_address", "raw_phone",
    "raw_rating", "raw_review_count", "scraped_at",
]


def evidence_header(runs: DataFrame, businesses: DataFrame, provenance: DataFrame, sources: DataFrame) -> DataFrame:
    """The run and the sizes of its three child tables, one row."""
    run = latest_completed(runs)
    one = F.broadcast(run.select("run_id"))  # latest_completed returns at most one row
    sized = run
    for name, child in (("businesses", businesses), ("source_records", sources), ("provenances", provenance)):
        counts = child.join(one, "run_id").groupBy("run_id").agg(F.count(F.lit(1)).alias(f"{name}_count"))
        sized = sized.join(counts, "run_id", "left").fillna(0, [f"{name}_count"])
    return sized.select(
        "run_id", F.col("completed_at").cast("string").alias("verified_at"),
        F.col("city").alias("city"), "category", "requested_limit", "status",
        F.col("discovered").alias("records_discovered"), F.col("saved").alias("records_saved"),
        "businesses_count", "source_records_count", "provenances_count",
    )


def export_evidence(runs: DataFrame, businesses: DataFrame, provenance: DataFrame, sources: DataFrame, path: str) -> bool:
    """Write header, businesses and source records as one folder each; False without a completed run.

    Child rows are written where they are, one line each, whatever the size of the run.
    """
    header = evidence_header(runs, businesses, provenance, sources)
    found = header.first()
    if found is None:
        return False
    of_run = lambda df: df.filter(F.col("run_id") == found["run_id"])
    header.drop("run_id").write.mode("overwrite").json(f"{path}/header")
    of_run(businesses).select(*schemas.BUSINESS_COLUMNS).write.mode("overwrite").json(f"{path}/businesses")
    of_run(sources).select(*SOURCE_COLUMNS).write.mode("overwrite").json(f"{path}/source_records")
    return True


def _parts() -> tuple[StructType, StructType, StructType]:
    """Schemas of header, businesses and source records."""
    whole = StructType.fromDDL(schemas.EVIDENCE)
    header = StructType([f for f in whole.fields if not isinstance(f.dataType, ArrayType)])
    return header, whole["businesses"].dataType.elementType, whole["source_records"].dataType.elementType


def load_evidence(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(header, businesses, source_records) of what export_evidence wrote."""
    names = ("header", "businesses", "source_records")
    header, businesses, sources = (spark.read.schema(s).json(f"{path}/{n}") for n, s in zip(names, _parts()))
    return header, businesses, sources


def load_document(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The same three tables of one nested document, as other tools write it."""
    doc = spark.read.schema(schemas.EVIDENCE).option("multiLine", True).json(path)
    return (
        doc.drop("businesses", "source_records"),
        doc.select(F.inline("businesses")),
        doc.select(F.inline("source_records")),
    )
