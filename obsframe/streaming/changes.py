"""Change streams: latest state per path, quiet-gap batches, running telemetry."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.ordered import Running, row_chunks, running
from ..operators.overlay import latest_per_path, open_sessions
from ..operators.telemetry import counters
from ..schemas import CHANGES
from ..session import discard, staged
from ..sources.tables import read_or_empty

KEY = ["project_id", "path"]
PENDING_CHANGES = T.StructType([*CHANGES.fields, T.StructField("queued", T.LongType()), T.StructField("batch_id", T.LongType())])
LOG = T.StructType([*CHANGES.fields, T.StructField("batch_id", T.LongType())])


def overlay_batch(batch: DataFrame, batch_id: int, root: str) -> None:
    """Fold a micro-batch to the newest event per path and store it as its own partition."""
    latest_per_path(batch).select(*CHANGES.fieldNames()).withColumn("batch_id", F.lit(batch_id).cast("long")).write.mode(
        "overwrite"
    ).option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(f"{root}/changes_log")


def overlay_stream(changes: DataFrame, root: str, checkpoint: str):
    """Writer that keeps the newest event per path.

    The fold orders by (ts, seq), so late and out-of-order events need no watermark and none is ever dropped.
    """
    return changes.writeStream.option("checkpointLocation", checkpoint).foreachBatch(
        lambda batch, batch_id: overlay_batch(batch, batch_id, root)
    )


def read_overlay(spark: SparkSession, root: str) -> DataFrame:
    """Current state per path over all batches; a path whose last event is unlink is a tombstone."""
    log = read_or_empty(spark, f"{root}/changes_log", LOG).drop("batch_id")
    return latest_per_path(log).withColumn("deleted", F.col("event") == "unlink")


def drain_batch(batch: DataFrame, batch_id: int, root: str, limit: int) -> None:
    """Apply at most ``limit`` queued paths of each project and keep the others queued.

    The queue outlives the trigger as the table ``pending``, a partition for each batch.  A batch reads the partition of the
    batch before it and replaces its own, so a batch that runs again finds what it found first.  A path that changes while it
    waits keeps its place and takes the newest event.
    """
    spark = batch.sparkSession
    values = [f.name for f in CHANGES.fields if f.name not in KEY]
    waiting = read_or_empty(spark, f"{root}/pending", PENDING_CHANGES).filter(F.col("batch_id") == batch_id - 1).drop("batch_id")
    arrived = batch.select(*CHANGES.fieldNames()).withColumn("queued", F.col("seq"))
    # The queue may be put off as a whole: both sides are folded in the map tasks.
    queue = staged(
        waiting.unionByName(arrived).groupBy(*KEY).agg(
            F.max_by(F.struct(*values), F.struct("ts", "seq")).alias("_e"), F.min("queued").alias("queued")
        ).select(*KEY, "queued", *[F.col(f"_e.{v}").alias(v) for v in values])
    )
    placed = running(row_chunks(queue.select(*KEY, "queued"), ["project_id"], F.col("queued")), ["project_id"], ["queued", "path"], {"_place": Running("sum", F.lit(1))})
    taken = queue.join(placed.filter(F.col("_place") <= limit).select(*KEY), KEY, "left_semi")
    left = queue.join(placed.filter(F.col("_place") > limit).select(*KEY), KEY, "left_semi")
    _own_partition(taken, batch_id, f"{root}/changes_log", LOG)
    _own_partition(left, batch_id, f"{root}/pending", PENDING_CHANGES)
    # Only the last batch can run again, and it reads the queue of the one before.
    discard(spark, f"{root}/pending/batch_id={batch_id - 2}")


def _own_partition(rows: DataFrame, batch_id: int, path: str, fields: T.StructType) -> None:
    """Replace the partition of a batch, also by nothing."""
    names = [f for f in fields.fieldNames() if f != "batch_id"]
    rows.select(*names).write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")


def drain_stream(changes: DataFrame, root: str, checkpoint: str, passes: int = 8, size: int = 64):
    """Writer of a bounded drain: each trigger applies ``passes`` times ``size`` queued paths a project, the rest waits."""
    return changes.writeStream.option("checkpointLocation", checkpoint).foreachBatch(
        lambda batch, batch_id: drain_batch(batch, batch_id, root, passes * size)
    )


def read_pending(spark: SparkSession, root: str) -> DataFrame:
    """Paths that still wait, with the newest event of each; their projects are stale (see ``overlay.freshness``)."""
    log = read_or_empty(spark, f"{root}/pending", PENDING_CHANGES)
    newest = log.agg(F.max("batch_id").alias("_newest"))
    # An empty partition leaves no row: the newest batch is that of the log, which every batch writes.
    applied = read_or_empty(spark, f"{root}/changes_log", LOG).agg(F.max("batch_id").alias("_applied"))
    latest = newest.crossJoin(applied).select(F.greatest("_newest", "_applied").alias("_batch"))
    return log.join(F.broadcast(latest), F.col("batch_id") == F.col("_batch")).drop("_batch", "batch_id")


def flush(spark: SparkSession, root: str) -> None:
    """Apply all that waits, as one more batch; for the end of a session, when no trigger follows."""
    waiting = staged(read_pending(spark, root))
    last = read_or_empty(spark, f"{root}/changes_log", LOG).unionByName(
        read_or_empty(spark, f"{root}/pending", PENDING_CHANGES).drop("queued")
    ).agg(F.max("batch_id")).first()[0]
    if last is None:
        return
    # Numbers of later batches stay free, and the next one finds an empty queue.
    _own_partition(waiting, -1 - last, f"{root}/changes_log", LOG)
    _own_partition(waiting.limit(0), last, f"{root}/pending", PENDING_CHANGES)


def debounce_stream(changes: DataFrame, gap: str = "300 milliseconds", delay: str = "1 minute") -> DataFrame:
    """Quiet-gap batches of a stream, emitted once the watermark has passed their end."""
    return open_sessions(changes.withWatermark("ts", delay), gap)


def telemetry_stream(oplog: DataFrame, by: str = "session_id") -> DataFrame:
    """Running counters per session for ``update`` output."""
    return counters(oplog, by)
