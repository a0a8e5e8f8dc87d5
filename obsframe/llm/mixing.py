"""Mixing sources to target weights by Poisson replication."""

from __future__ import annotations

import math
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from obsframe.llm.common import key_hash, positions, unit_hash
from obsframe.llm.folds import let, walk


def _skipped(mean: Column) -> Column:
    """The first count that is weighed: what lies below it, 12 deviations and more under the mean, is less than 1e-30."""
    return F.greatest(F.lit(0.0), F.floor(mean - 12 * F.sqrt(mean) - 30).cast("double"))


def poisson_thresholds(mean: Column) -> Column:
    """P(X <= k) for k = _skipped(mean) and the counts after it, until what is left is below 1e-15.

    Terms go by their logarithms, so no mean underflows; the first by the Stirling series.  Some 24 deviations are walked, so
    the array grows with the root of the mean.
    """
    first, last = _skipped(mean), F.ceil(mean + 12 * F.sqrt(mean) + 30).cast("double")
    k = F.greatest(first, F.lit(1.0))
    off = (mean - k) / k
    series = 1 / (12 * k) - 1 / (360 * F.pow(k, F.lit(3))) + 1 / (1260 * F.pow(k, F.lit(5)))
    start = F.when(first > 0, k * (F.log1p(off) - off) - F.log(2 * math.pi * k) / 2 - series).otherwise(-mean)
    log = lambda acc, i: acc["log"] + F.log(mean) - F.log(first + i.cast("double"))
    return F.when(
        mean > 0,
        let(
            F.struct(start.alias("log"), F.exp(start).alias("sum")),
            lambda begun: F.concat(
                F.array(begun["sum"]),
                walk(
                    F.sequence(F.lit(1), (last - first).cast("int")),
                    begun,
                    lambda acc, i: F.struct(log(acc, i).alias("log"), (acc["sum"] + F.exp(log(acc, i))).alias("sum")),
                    lambda acc, i: acc["sum"] + F.exp(log(acc, i)),
                    "double",
                ),
            ),
        ),
    )


def rates(docs: DataFrame, weights: Mapping[str, float] | None = None, rows: float | None = None) -> DataFrame:
    """source, n, mean repetition: weight / sum of weights * rows / n, over the sources that ``docs`` has.

    ``weights`` names sources and their shares; a source it does not name has weight 0.  Without it all sources weigh the
    same.  ``rows`` is the expected number of rows out, by default as many as come in.
    """
    sizes = docs.groupBy("source").agg(F.count("*").alias("n"))
    if weights is not None:
        table = F.create_map(*[F.lit(v) for k, w in weights.items() for v in (k, float(w))]) if weights else None
        share = F.coalesce(table[F.col("source")], F.lit(0.0)) if table is not None else F.lit(0.0)
    else:
        share = F.lit(1.0)
    shared = sizes.withColumn("w", share)
    # One row.
    whole = shared.agg(F.sum("w").alias("_w"), F.sum("n").alias("_n"))
    target = F.lit(float(rows)) if rows is not None else F.col("_n").cast("double")
    mean = F.when((F.col("w") > 0) & (F.col("_w") > 0), F.col("w") / F.col("_w") * target / F.col("n")).otherwise(0.0)
    return shared.join(F.broadcast(whole)).select("source", "n", mean.alias("mean"))


def repetitions(docs: DataFrame, weights: Mapping[str, float] | None = None, seed: int = 0, rows: float | None = None) -> DataFrame:
    """``docs`` as column ``_row``, with source, mean, u and copies: the Poisson quantile of u, a hash of seed and doc_id.

    Rows meet the short table of rates, one row for a source, in an equi-join; a hot source is split at run time.
    A null source is a source.  Rows that repeat a doc_id repeat its count.
    """
    means = rates(docs, weights, rows)
    table = means.select(F.col("source").alias("_source"), "mean", poisson_thresholds(F.col("mean")).alias("_cdf"))
    u = unit_hash(F.lit(seed), F.col("doc_id"))
    joined = docs.select(F.struct("*").alias("_row"), F.col("source").alias("source"), u.alias("u")).join(
        table, F.col("source").eqNullSafe(F.col("_source")), "left"
    )
    copies = F.coalesce(_skipped(F.col("mean")).cast("int") + F.size(F.filter("_cdf", lambda c: c <= F.col("u"))), F.lit(0))
    return joined.select("_row", "source", "mean", "u", F.when(F.col("mean") > 0, copies).otherwise(0).alias("copies"))


def mix(docs: DataFrame, weights: Mapping[str, float] | None = None, seed: int = 0, rows: float | None = None) -> DataFrame:
    """Each document as often as its Poisson count says: columns ``_row``, copy (from 1), key (the global shuffle's order)."""
    counted = repetitions(docs, weights, seed, rows).filter("copies > 0")
    copies = counted.select("_row", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"))
    return copies.withColumn("key", key_hash(F.lit(seed), F.col("_row.doc_id"), F.col("copy")))


def shuffled(mixed: DataFrame) -> DataFrame:
    """The rows of mix() dealt to ranges of their key and sorted there: a global shuffle that is the same each time."""
    n = int(mixed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return mixed.repartitionByRange(n, "key").sortWithinPartitions("key", "copy")


def placed(mixed: DataFrame) -> DataFrame:
    """doc_id, source, copy, position: where each copy stands after the global shuffle."""
    keys = mixed.select(F.col("_row.doc_id").alias("doc_id"), F.col("_row.source").alias("source"), "copy", "key")
    return positions(keys, [F.col("key"), F.col("doc_id"), F.col("copy")], "position").drop("key")
