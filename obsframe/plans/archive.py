"""Archive and virtualize whole tables of observations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.receipts import receipt
from ..operators import retrieve, signatures
from ..operators.archive import archive_projection, eligible, new_artifacts, sanitize, upsert_latest


def archive(
    observations: DataFrame,
    now: Column,
    existing_metadata: DataFrame | None = None,
    existing_artifacts: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame]:
    """``(metadata, artifacts)``: last record per observation id, one artifact per new content hash.

    Content travels through one exchange (by hash); metadata alone through the other (by observation).
    """
    sanitized = sanitize(eligible(observations))
    records = archive_projection(sanitized, now)
    metadata = upsert_latest(existing_metadata, records, ["project_id", "observation_id"])
    return metadata, new_artifacts(sanitized, existing_artifacts)


def write_signatures(artifacts: DataFrame, path: str) -> DataFrame:
    """Sign the texts of new artifacts, store the signatures and read them back; a search tests them before any text."""
    signatures.sign(retrieve.searchable(artifacts)).write.mode("overwrite").parquet(path)
    return read_signatures(artifacts.sparkSession, path)


def read_signatures(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(signatures.SIGNATURES).parquet(path)


def virtualize(observations: DataFrame, threshold: int = 16 * 1024, receipt_max: int = 4096) -> DataFrame:
    """Add ``output``: a receipt where the original text is over ``threshold`` bytes, else the text itself.

    The sanitized content is in the row already, so nothing is joined or shuffled.
    """
    replaced = F.col("original_bytes") > threshold
    # One pass: the preview of a text that stays is never made.
    sanitized = sanitize(eligible(observations)).withColumn("replaced", replaced).withColumn("_large", F.when(F.col("replaced"), F.col("sanitized")))
    shown = receipt(sanitized, receipt_max, "_large")
    return shown.withColumn("output", F.when(F.col("replaced"), F.col("receipt")).otherwise(F.col("text"))).drop("receipt", "_large")
