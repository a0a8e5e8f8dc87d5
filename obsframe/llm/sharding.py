"""Shards that all hold the sources in the proportions of the whole."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from obsframe.llm.common import key_hash, positions
from obsframe.session import staged


def interleave(docs: DataFrame, shards: int = 24, seed: int = 0, ties: tuple[str, ...] = ()) -> DataFrame:
    """``docs`` (doc_id, source and more columns, none of them long) with shard and slot (from 0, gapless) added.

    Rows of a source are ranked in the order of a seeded hash of doc_id; all rows are then sorted by fractional rank
    (rank - 1/2) / rows of the source and cut into runs whose sizes differ by one at most.  So each shard holds each source
    in proportion.  Both orders are sorted in ranges over all rows: a source of a third of them is not one task.
    Null sources are one source; rows of equal doc_id follow ``ties``.
    """
    h = key_hash(F.lit(seed), F.col("doc_id"))
    inner = docs.select(F.struct("*").alias("_doc"), F.col("source").alias("_source"), h.alias("_h"), *[F.col(c).alias(f"_t{i}") for i, c in enumerate(ties)])
    tail = [F.col("_h"), F.col("_doc.doc_id"), *[F.col(f"_t{i}") for i in range(len(ties))]]
    ranked = staged(positions(inner, [F.col("_source"), *tail], "_rank"))
    sizes = ranked.groupBy("_source").agg(F.min("_rank").alias("_first"), F.count("*").alias("_n"))
    sizes = sizes.withColumnRenamed("_source", "_s")
    rows = ranked.count()
    joined = ranked.join(sizes, F.col("_source").eqNullSafe(F.col("_s")))
    fraction = (F.col("_rank") - F.col("_first") + 0.5) / F.col("_n")
    placed = positions(joined.withColumn("_fraction", fraction), [F.col("_fraction"), F.col("_source"), *tail], "_at")
    # Whole numbers only: at * shards div rows.
    shard = F.expr(f"(_at * {shards}L) div {max(rows, 1)}L")
    placed = placed.withColumn("_shard", shard.cast("int"))
    start = F.expr(f"(_shard * {max(rows, 1)}L + {shards - 1}L) div {shards}L")
    return placed.select("_doc.*", F.col("_shard").alias("shard"), (F.col("_at") - start).alias("slot"))


def write_shards(docs: DataFrame, placed: DataFrame, path: str) -> None:
    """Write ``docs`` under ``path``, a folder for each shard; ``placed`` holds (doc_id, shard, slot), a row for each doc_id."""
    where = placed.select(F.col("doc_id").alias("_id"), F.col("shard").alias("_shard"), F.col("slot").alias("_slot"))
    rows = docs.select(F.struct("*").alias("doc")).join(where, F.col("doc.doc_id").eqNullSafe(F.col("_id")))
    out = rows.select("doc", F.col("_slot").alias("slot"), F.col("_shard").alias("shard"))
    out.repartition("shard").sortWithinPartitions("shard", "slot").write.partitionBy("shard").mode("overwrite").parquet(path)
