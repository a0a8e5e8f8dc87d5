"""Archive operators: sanitize, deduplicate by content, project metadata, upsert."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.redaction import redact
from ..functions.text import byte_len, block_text, observation_id, sha256

OWN_TOOL_PREFIX = "obsframe_"


def eligible(df: DataFrame, own_prefix: str = OWN_TOOL_PREFIX) -> DataFrame:
    """Observations that have text and do not come from this library's own tools."""
    if "text" not in df.columns:
        df = df.withColumn("text", block_text("content")).drop("content")
    return df.filter(F.col("text").isNotNull() & ~F.startswith("tool_name", F.lit(own_prefix)))


def sanitize(observations: DataFrame) -> DataFrame:
    """Redact and derive ids and sizes.  Narrow: no shuffle.

    The ids are declared non-null, so a join on them adds no null test that would redact a second time.
    """
    return redact(observations.filter(F.col("text").isNotNull())).withColumns(
        {
            "observation_id": F.coalesce(observation_id("session_id", "tool_call_id"), F.lit("")),
            "artifact_id": F.coalesce(sha256("sanitized"), F.lit("")),
            "original_bytes": byte_len("text"),
            "sanitized_bytes": byte_len("sanitized"),
        }
    )


def new_artifacts(sanitized: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """One row per content hash that is not stored yet.  Equal content makes any copy of a group right."""
    found = sanitized
    if existing is not None:
        found = found.join(existing.select("project_id", "artifact_id"), ["project_id", "artifact_id"], "left_anti")
    return found.groupBy("project_id", "artifact_id").agg(F.first("sanitized").alias("content")).select(
        "project_id",
        "artifact_id",
        F.substring("artifact_id", 1, 2).alias("shard"),
        "content",
        byte_len("content").alias("size"),
    )


def dedup_content(sanitized: DataFrame, existing: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Artifacts to store, and observations flagged when their content was archived before them.

    The first occurrence of each hash is aggregated first (map-side), then joined back: a hash shared by
    a third of all rows is one build row, and the run-time skew split spreads its probe side.
    """
    firsts = sanitized.groupBy("project_id", "artifact_id").agg(F.min("seq").alias("_first"))
    flagged = sanitized.join(firsts, ["project_id", "artifact_id"]).withColumn(
        "deduplicated", F.col("seq") > F.col("_first")
    )
    if existing is not None:
        known = existing.select("project_id", "artifact_id", F.lit(True).alias("_known")).distinct()
        flagged = (
            flagged.join(known, ["project_id", "artifact_id"], "left")
            .withColumn("deduplicated", F.col("deduplicated") | F.coalesce("_known", F.lit(False)))
            .drop("_known")
        )
    return new_artifacts(sanitized, existing), flagged.drop("_first")


def archive_projection(observations: DataFrame, now: Column) -> DataFrame:
    """Metadata record of each sanitized observation."""
    return observations.select(
        F.lit(1).alias("schema_version"),
        "project_id",
        "artifact_id",
        "observation_id",
        "tool_call_id",
        "tool_name",
        "session_id",
        F.col("artifact_id").alias("content_hash"),
        "original_bytes",
        "sanitized_bytes",
        F.col("redactions").alias("redaction_count"),
        now.alias("created_at"),
        now.alias("updated_at"),
        "seq",
    )


def upsert_latest(
    existing: DataFrame | None, incoming: DataFrame, key: Sequence[str], seq: str = "seq"
) -> DataFrame:
    """Last record per key wins; ``position`` stays that of the first insertion."""
    if "position" not in incoming.columns:
        incoming = incoming.withColumn("position", F.col(seq))
    rows = incoming if existing is None else existing.unionByName(incoming, allowMissingColumns=True)
    values = [c for c in incoming.columns if c not in key and c != "position"]
    folded = rows.groupBy(*key).agg(
        F.max_by(F.struct(*values), seq).alias("_latest"),
        F.min(F.coalesce("position", seq)).alias("position"),
    )
    return folded.select(*key, *[F.col(f"_latest.{v}").alias(v) for v in values], "position")
