"""Continuous archive: every micro-batch writes partitions of its own, so a replay changes nothing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.receipts import receipt
from ..operators.archive import OWN_TOOL_PREFIX, archive_projection, new_artifacts, sanitize, upsert_latest
from ..params import Params
from ..schemas import METADATA
from ..sources.tables import read_artifacts, read_or_empty, write_artifacts

LOG = T.StructType(
    [*METADATA.fields, T.StructField("project_id", T.StringType()), T.StructField("seq", T.LongType()), T.StructField("batch_id", T.LongType())]
)


def invalid_reason():
    """Why an observation cannot be archived; null when it can."""
    return F.coalesce(
        F.when(F.coalesce("project_id", F.lit("")) == "", "project is empty"),
        F.when(F.coalesce("session_id", F.lit("")) == "", "session is empty"),
        F.when(F.coalesce("tool_call_id", F.lit("")) == "", "call is empty"),
        F.when(F.coalesce("tool_name", F.lit("")) == "", "tool name is empty"),
        F.when(F.col("seq").isNull(), "sequence is missing"),
    )


def _own_partition(df: DataFrame, path: str, batch_id: int) -> None:
    df.withColumn("batch_id", F.lit(batch_id).cast("long")).write.mode("overwrite").option(
        "partitionOverwriteMode", "dynamic"
    ).partitionBy("batch_id").parquet(path)


def archive_batch(batch: DataFrame, batch_id: int, root: str, params: Params) -> None:
    """One micro-batch: artifacts, metadata log, outputs, dead letters."""
    texts = batch.filter(F.col("text").isNotNull() & ~F.coalesce(F.startswith("tool_name", F.lit(OWN_TOOL_PREFIX)), F.lit(False)))
    judged = texts.withColumn("reason", invalid_reason())
    good = judged.filter(F.col("reason").isNull()).drop("reason")
    sanitized = sanitize(good).persist()
    try:
        found = new_artifacts(sanitized).withColumn("modified_at", F.current_timestamp())
        write_artifacts(found, f"{root}/artifacts", batch_id)
        _own_partition(archive_projection(sanitized, F.current_timestamp()), f"{root}/metadata_log", batch_id)
        large = sanitized.filter(F.col("original_bytes") > params.archive_threshold_bytes)
        outputs = (
            receipt(large, params.receipt_max_bytes)
            .select("project_id", "observation_id", F.col("receipt").alias("output"), F.lit(True).alias("replaced"))
            .unionByName(
                sanitized.filter(F.col("original_bytes") <= params.archive_threshold_bytes).select(
                    "project_id", "observation_id", F.col("text").alias("output"), F.lit(False).alias("replaced")
                )
            )
        )
        _own_partition(outputs, f"{root}/outputs", batch_id)
        _own_partition(judged.filter(F.col("reason").isNotNull()), f"{root}/dead_letters", batch_id)
    finally:
        sanitized.unpersist()


def archive_stream(
    observations: DataFrame, root: str, checkpoint: str, params: Params = Params(), watermark: tuple[str, str] | None = None
):
    """Writer for a stream of observations; call ``.start()`` on it.

    With ``watermark`` = (event time column, delay) repeats of an observation inside the delay are dropped before the
    sink; without it the fold on read makes repeats harmless.
    """
    rows = observations
    if watermark is not None:
        column, delay = watermark
        rows = rows.withWatermark(column, delay).dropDuplicatesWithinWatermark(
            ["project_id", "session_id", "tool_call_id"]
        )
    return rows.writeStream.option("checkpointLocation", checkpoint).foreachBatch(
        lambda batch, batch_id: archive_batch(batch, batch_id, root, params)
    )


def read_archive(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """``(metadata, artifacts)`` of an archive: the log folded to the last record per observation."""
    log = read_or_empty(spark, f"{root}/metadata_log", LOG).drop("batch_id")
    return upsert_latest(None, log, ["project_id", "observation_id"]), read_artifacts(spark, f"{root}/artifacts")


def compact_metadata(spark: SparkSession, root: str, through_batch: int) -> DataFrame:
    """The log up to a batch folded to one record per observation, ready to be written as that batch's partition."""
    log = read_or_empty(spark, f"{root}/metadata_log", LOG).filter(F.col("batch_id") <= through_batch).drop("batch_id")
    return upsert_latest(None, log, ["project_id", "observation_id"]).drop("position")
