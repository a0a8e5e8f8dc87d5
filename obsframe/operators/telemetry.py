"""Counters, totals and last values over an operation log; status and health."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import prefix_bytes
from .ordered import Running, row_chunks, running, top_k

FAILURES_KEPT = 20
FAILURE_BYTES = 512


def _is(op: str):
    return F.col("op") == op


def _total(op: str, value: str):
    return F.coalesce(F.sum(F.when(_is(op), F.col(value))), F.lit(0))


def counters(oplog: DataFrame, by: str = "session_id") -> DataFrame:
    """Plain counts and totals: one map-side combined aggregation, also valid on a stream."""
    ok = F.coalesce(F.col("ok"), F.lit(True))
    return oplog.groupBy(by).agg(
        F.count_if(_is("capsule_build")).alias("capsule_build_count"),
        F.count_if(_is("automatic_query")).alias("map_automatic_query_count"),
        F.count_if(_is("map_query")).alias("map_query_count"),
        _total("map_query", "duration_ms").alias("map_query_duration_ms_total"),
        F.count_if(_is("ensure_fresh")).alias("ensure_fresh_count"),
        _total("ensure_fresh", "duration_ms").alias("ensure_fresh_duration_ms_total"),
        F.count_if(_is("reindex")).alias("files_reindexed"),
        F.count_if(_is("index_build")).alias("search_index_build_count"),
        F.count_if(_is("generation")).alias("generation_created_count"),
        _total("generation", "bytes").alias("generation_bytes_written"),
        F.count_if(_is("maintenance_failure")).alias("maintenance_failure_count"),
        F.count_if(_is("archive")).alias("archive_attempt_count"),
        F.count_if(_is("archive") & ok).alias("archive_success_count"),
        F.count_if(_is("archive") & ~ok).alias("archive_failure_count"),
        F.count_if(_is("archive") & ok & F.coalesce("deduplicated", F.lit(False))).alias("archive_deduplicated_count"),
        _total("archive", "duration_ms").alias("archive_duration_ms_total"),
        _total("metadata_read", "duration_ms").alias("metadata_read_duration_ms_total"),
        _total("metadata_write", "duration_ms").alias("metadata_write_duration_ms_total"),
        F.count_if(_is("reduction")).alias("reduction_invocation_count"),
        F.count_if(_is("reduction") & F.coalesce("triggered", F.lit(False))).alias("reduction_triggered_count"),
        _total("reduction", "reduced_count").alias("reduced_observation_count"),
        _total("reduction", "tokens_before").alias("estimated_tokens_before_total"),
        _total("reduction", "tokens_after").alias("estimated_tokens_after_total"),
        F.count_if(_is("reduction") & F.coalesce("target_reached", F.lit(False))).alias("target_reached_count"),
        _total("reduction", "duration_ms").alias("reduction_duration_ms_total"),
    )


def last_values(oplog: DataFrame, by: str = "session_id") -> DataFrame:
    """Most recent capsule size and insertion index (0 when none was built)."""
    at = F.when(_is("capsule_build"), F.col("seq"))
    return oplog.groupBy(by).agg(
        F.coalesce(F.max_by("bytes", at), F.lit(0)).alias("capsule_bytes"),
        F.coalesce(F.max_by("insertion_index", at), F.lit(0)).alias("capsule_insertion_index"),
    )


def hash_changes(oplog: DataFrame, by: str = "session_id") -> DataFrame:
    """Builds whose content hash differs from the build before; the first never counts."""
    builds = oplog.filter(_is("capsule_build")).select(by, "seq", "content_hash")
    marked = running(
        row_chunks(builds, [by], F.col("seq")),
        [by],
        ["seq"],
        {"_previous": Running("last", F.col("content_hash"), before=True)},
    )
    return marked.groupBy(by).agg(
        F.count_if(F.col("_previous") != F.col("content_hash")).alias("capsule_hash_change_count")
    )


def map_total_bytes(oplog: DataFrame, by: str = "session_id") -> DataFrame:
    """Last reported size on disk plus what was written after that report."""
    reported = oplog.groupBy(by).agg(
        F.max(F.when(_is("map_total"), F.col("seq"))).alias("_at"),
        F.max_by("bytes", F.when(_is("map_total"), F.col("seq"))).alias("_bytes"),
    )
    later = oplog.filter(_is("generation")).join(reported, by).filter(
        F.col("_at").isNull() | (F.col("seq") > F.col("_at"))
    )
    added = later.groupBy(by).agg(F.sum("bytes").alias("_added"))
    return reported.join(added, by, "left").select(
        by, (F.coalesce("_bytes", F.lit(0)) + F.coalesce("_added", F.lit(0))).alias("map_total_bytes")
    )


def telemetry(oplog: DataFrame, by: str = "session_id") -> DataFrame:
    """All 29 metrics per session."""
    return (
        counters(oplog, by)
        .join(last_values(oplog, by), by, "left")
        .join(hash_changes(oplog, by), by, "left")
        .join(map_total_bytes(oplog, by), by, "left")
        .fillna(0, subset=["capsule_hash_change_count", "map_total_bytes"])
    )


def bounded_failures(failures: DataFrame, keep: int = FAILURES_KEPT) -> DataFrame:
    """Last ``keep`` failures per project, messages cut to 512 bytes."""
    newest = top_k(failures, ["project_id"], [F.col("seq").desc()], keep)
    return newest.withColumn("error", prefix_bytes("error", FAILURE_BYTES))


def status(components: DataFrame, failures: DataFrame, keep: int = FAILURES_KEPT) -> tuple[DataFrame, DataFrame]:
    """``(status, failures)``.

    components: project_id, component, available, degraded, freshness, maintenance_error.  A project is
    degraded when it has a failure, a degraded or stale component, or failed maintenance.
    """
    kept = bounded_failures(failures, keep)
    bad = (
        F.coalesce("degraded", F.lit(False))
        | F.coalesce(F.col("freshness").isin("stale", "unsupported"), F.lit(False))
        | F.col("maintenance_error").isNotNull()
    )
    rolled = components.groupBy("project_id").agg(
        F.count(F.lit(1)).alias("components"), F.count_if("available").alias("available"), F.bool_or(bad).alias("_bad")
    )
    counts = kept.groupBy("project_id").agg(F.count(F.lit(1)).alias("_failures"))
    out = rolled.join(counts, "project_id", "full_outer").select(
        "project_id",
        F.coalesce("components", F.lit(0)).alias("components"),
        F.coalesce("available", F.lit(0)).alias("available"),
        F.coalesce("_failures", F.lit(0)).alias("failures"),
        (F.coalesce("_bad", F.lit(False)) | F.col("_failures").isNotNull()).alias("degraded"),
    )
    return out, kept


def health(status: DataFrame) -> DataFrame:
    return status.select("project_id", F.when(F.col("degraded"), "degraded").otherwise("healthy").alias("health"))
