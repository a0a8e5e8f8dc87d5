"""Expiry and quota eviction of artifacts and of map generations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordered import Running, prefix_number, row_chunks, running


def gc_candidates(metadata: DataFrame, inventory: DataFrame, referenced: DataFrame) -> DataFrame:
    """Every known artifact with its size, newest timestamp and whether something still refers to it.

    metadata: project_id, artifact_id, updated_at.  inventory: project_id, artifact_id, size, modified_at.
    """
    key = ["project_id", "artifact_id"]
    touched = newest_timestamps(metadata)
    kept = referenced.select(*key).distinct().withColumn("referenced", F.lit(True))
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp")
    return (
        touched.join(inventory.select(*key, "size", "modified_at"), key, "full_outer")
        .join(kept, key, "left")
        .select(
            *key,
            F.coalesce("size", F.lit(0)).cast("long").alias("size"),
            F.greatest(F.coalesce("modified_at", epoch), F.col("updated_at")).alias("newest"),
            F.coalesce("referenced", F.lit(False)).alias("referenced"),
        )
    )


def newest_timestamps(metadata: DataFrame) -> DataFrame:
    return metadata.groupBy("project_id", "artifact_id").agg(F.max("updated_at").alias("updated_at"))


def expire(candidates: DataFrame, days: int, now: Column) -> DataFrame:
    """Add ``expired``: unreferenced and strictly older than ``days``."""
    cutoff = now - F.make_dt_interval(F.lit(days))
    return candidates.withColumn("expired", ~F.col("referenced") & (F.col("newest") < cutoff))


def evict(candidates: DataFrame, quota: int) -> DataFrame:
    """Add ``deleted``: expired, or oldest first while the project is above ``quota``.

    Expired artifacts are the oldest, so with ``before`` = bytes of all older unreferenced artifacts the
    sequential rule "delete while remaining > quota" is ``total - before > quota``.
    """
    totals = candidates.groupBy("project_id").agg(F.sum("size").alias("_total"))
    # Microseconds lie far apart, and many artifacts may share one: those are cut by their ids.
    chunked = row_chunks(candidates, ["project_id"], F.unix_micros("newest"), prefix_number("artifact_id"))
    counted = running(
        chunked,
        ["project_id"],
        ["newest", "artifact_id"],
        {"_before": Running("sum", F.when(~F.col("referenced"), F.col("size")), before=True)},
    )
    over = F.col("_total") - F.col("_before") > quota
    return (
        counted.join(totals, "project_id")
        .withColumn("deleted", F.col("expired") | (~F.col("referenced") & over))
        .drop("_total", "_before")
    )


def gc_report(decisions: DataFrame, quota: int) -> DataFrame:
    freed = F.coalesce(F.sum(F.when(F.col("deleted"), F.col("size"))), F.lit(0))
    total = F.sum("size")
    return decisions.groupBy("project_id").agg(
        F.count_if("deleted").alias("deleted_artifacts"),
        freed.alias("bytes_freed"),
        (total - freed).alias("remaining_bytes"),
        (total - freed <= quota).alias("quota_satisfied"),
    )


def prune_generations(ledger: DataFrame, retention: int, quota: int) -> DataFrame:
    """Ledger with ``deleted``: generations below the active one, lowest first, by count and then by bytes.

    ledger: project_id, generation, bytes, is_active, is_valid.  A project without a valid active
    generation keeps everything.
    """
    valid = F.col("is_active") & F.coalesce(F.col("is_valid"), F.lit(True))
    if "is_valid" not in ledger.columns:
        valid = F.col("is_active")
    project = ledger.groupBy("project_id").agg(
        F.count(F.lit(1)).alias("_n"),
        F.sum("bytes").alias("_total"),
        F.max(F.when(valid, F.col("generation"))).alias("active_generation"),
    )
    counted = running(
        row_chunks(ledger, ["project_id"], F.col("generation")),
        ["project_id"],
        ["generation"],
        {"_rank": Running("sum", F.lit(1)), "_before": Running("sum", F.col("bytes"), before=True)},
    )
    surplus = (F.col("_rank") <= F.col("_n") - retention) | (F.col("_total") - F.col("_before") > quota)
    return (
        counted.join(project, "project_id")
        .withColumn(
            "deleted", F.coalesce(F.col("generation") < F.col("active_generation"), F.lit(False)) & surplus
        )
        .drop("_n", "_total", "_rank", "_before")
    )


def generation_report(pruned: DataFrame, quota: int) -> DataFrame:
    """Per project: what was deleted and freed, what remains, or why nothing was touched."""
    freed = F.coalesce(F.sum(F.when(F.col("deleted"), F.col("bytes"))), F.lit(0))
    remaining = F.sum("bytes") - freed
    return pruned.groupBy("project_id").agg(
        F.max("active_generation").alias("active_generation"),
        F.count_if("deleted").alias("deleted_generations"),
        freed.alias("bytes_freed"),
        F.count_if(~F.col("deleted")).alias("remaining_generations"),
        remaining.alias("remaining_bytes"),
        (remaining <= quota).alias("quota_satisfied"),
        F.when(F.max("active_generation").isNull(), "invalid active generation").alias("error"),
    )
