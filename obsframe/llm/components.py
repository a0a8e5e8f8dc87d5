"""Connected components of a link table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from obsframe.session import staged

# Rows of a link table that one task takes.
_TASK_ROWS = 100_000


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select("b", "a"))
    lowest = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(lowest, "u").filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    lowest = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(lowest, "u").filter("v > m").select(F.col("v").alias("a"), F.col("m").alias("b"))
    return moved.union(lowest.select("u", "m"))


def components(links: DataFrame) -> DataFrame:
    """Columns a, b (long, a <> b) in; id, component (smallest id reachable) out, a row for each linked id.

    Every step is written to the checkpoint folder.  Stars have one row for each node, so no task gathers a component;
    the join of a node of many links is an equi-join whose other side has one row for the node.
    """
    least = links.sparkSession.sparkContext.defaultParallelism
    edges = staged(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    rows, seen = edges.count(), None
    while True:
        # A step makes at most two rows of each: a few links are not dealt over as many files as the session has partitions.
        n = max(least, 2 * rows // _TASK_ROWS + 1)
        large = _large_star(edges.coalesce(n)).coalesce(n)
        edges = staged(_small_star(large).filter("a <> b").coalesce(n).distinct().coalesce(n))
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        rows = state[0]
        if state == seen:
            break
        seen = state
    roots = edges.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct()
    return edges.select(F.col("a").alias("id"), F.col("b").alias("component")).union(roots)
