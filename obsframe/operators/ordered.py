"""Ordered computations over groups of any size.

A window over a session or a project puts the whole group into one task.  The helpers here cut every
group into chunks that follow the order, run the window inside a chunk, and carry one small summary row
per chunk forward, so a group that holds a third of all rows is still spread over many tasks.  The summary
rows are scanned in the same way, some thousand at a time.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import staged

CHUNK = "_chunk"
CHUNK_WIDTH = 65_536
# A chunk number holds the number of a range in its upper and a part of that range in its lower half.
_PART_BITS = 32
# Summary rows of so many ranges (a power of two) are scanned in one task.
_SCAN_BITS = 12


@dataclass(frozen=True)
class Running:
    """One running value: ``kind`` is sum, max, min or last (latest non-null); ``before`` leaves out the row itself."""

    kind: str
    value: Column
    before: bool = False


def position_chunks(position: Column | str, width: int = CHUNK_WIDTH) -> Column:
    """Chunk number for a unique integer position: a chunk can never hold more than ``width`` rows of a group.

    For positions without wide gaps (line numbers, message indexes); :func:`row_chunks` takes any others.
    """
    position = F.col(position) if isinstance(position, str) else position
    return F.shiftleft(F.floor(position / F.lit(width)).cast("long"), _PART_BITS)


def prefix_number(text: Column | str) -> Column:
    """A number that follows the binary order of texts: their first six bytes."""
    text = F.col(text) if isinstance(text, str) else text
    head = F.rpad(F.hex(F.substring(text.cast("binary"), 1, 6)), 12, "0")
    return F.conv(head, 16, 10).cast("long")


def _share(rows: Column, low: Column, high: Column, at: Column, width: int) -> Column:
    """Which of ceil(rows / width) equal ranges of low..high holds ``at``; never decreases with ``at``."""
    parts = F.ceil(rows / F.lit(width))
    span = high.cast("double") - low.cast("double") + 1
    return F.least(F.floor((at.cast("double") - low.cast("double")) / span * parts), parts - 1).cast("long")


def _attached(df: DataFrame, stats: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Join one small row a group; null keys are a group of their own."""
    renamed = stats.select(*[F.col(k).alias(f"_key_{k}") for k in keys], *[c for c in stats.columns if c not in keys])
    same = reduce(and_, [F.col(k).eqNullSafe(F.col(f"_key_{k}")) for k in keys])
    return df.join(renamed, same).drop(*[f"_key_{k}" for k in keys])


def row_chunks(df: DataFrame, keys: Sequence[str], *positions: Column, width: int = CHUNK_WIDTH) -> DataFrame:
    """Add the chunk number for rows ordered by ``positions`` (one or two numbers), however far these lie apart.

    A group of n rows has ceil(n / width) ranges of equal extent between its first and last position; a range with more than
    twice ``width`` rows is cut once more in the same way, by the second position if the first is one value there.  So the
    number of chunks follows the rows, not the positions.  Plain aggregates and joins: no job runs while the plan is built.
    """
    first, second = positions[0].cast("long"), positions[-1].cast("long")
    placed = df.withColumns({"_cut_p": first, "_cut_q": second})
    whole = placed.groupBy(*keys).agg(F.count("*").alias("_cut_n"), F.min("_cut_p").alias("_cut_low"), F.max("_cut_p").alias("_cut_high"))
    cut = _attached(placed, whole, keys).withColumn("_cut_range", _share(F.col("_cut_n"), F.col("_cut_low"), F.col("_cut_high"), F.col("_cut_p"), width))
    cut = cut.drop("_cut_n", "_cut_low", "_cut_high")
    extent = [F.min("_cut_p").alias("_cut_low"), F.max("_cut_p").alias("_cut_high"), F.min("_cut_q").alias("_cut_low_q"), F.max("_cut_q").alias("_cut_high_q")]
    ranges = cut.groupBy(*keys, "_cut_range").agg(F.count("*").alias("_cut_n"), *extent).filter(F.col("_cut_n") > 2 * width)
    again = F.when(F.col("_cut_low") < F.col("_cut_high"), _share(F.col("_cut_n"), F.col("_cut_low"), F.col("_cut_high"), F.col("_cut_p"), width)).otherwise(
        _share(F.col("_cut_n"), F.col("_cut_low_q"), F.col("_cut_high_q"), F.col("_cut_q"), width)
    )
    renamed = ranges.select(*[F.col(k).alias(f"_key_{k}") for k in [*keys, "_cut_range"]], *[c for c in ranges.columns if c not in keys and c != "_cut_range"])
    same = reduce(and_, [F.col(k).eqNullSafe(F.col(f"_key_{k}")) for k in [*keys, "_cut_range"]])
    # Few ranges are crowded: most rows meet none.
    parted = cut.join(renamed, same, "left").withColumn("_cut_again", F.coalesce(again, F.lit(0).cast("long")))
    return parted.select(*df.columns, (F.shiftleft("_cut_range", _PART_BITS) + F.col("_cut_again")).alias(CHUNK))


def range_chunks(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Chunk number for an arbitrary total order: range partitions over keys and order, fixed by staging."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(n, *keys, *order).withColumn(CHUNK, F.shiftleft(F.spark_partition_id().cast("long"), _PART_BITS))
    return staged(ranged)


def _local(r: Running, inside) -> Column:
    frame = inside.rowsBetween(Window.unboundedPreceding, -1 if r.before else 0)
    if r.kind == "last":
        return F.last(r.value, ignorenulls=True).over(frame)
    return getattr(F, r.kind)(r.value).over(frame)


def _summary(r: Running, order: Sequence[str]) -> Column:
    if r.kind == "last":
        return F.max_by(r.value, F.when(r.value.isNotNull(), F.struct(*order)))
    return getattr(F, r.kind)(r.value)


def _carry(r: Running, name: str, earlier) -> Column:
    c = F.col(name)
    return F.last(c, ignorenulls=True).over(earlier) if r.kind == "last" else getattr(F, r.kind)(c).over(earlier)


def _combine(r: Running, inner: Column, carried: Column) -> Column:
    if r.kind == "sum":
        return F.coalesce(inner, F.lit(0)) + F.coalesce(carried, F.lit(0))
    if r.kind == "max":
        return F.greatest(inner, carried)
    if r.kind == "min":
        return F.least(inner, carried)
    return F.coalesce(inner, carried)


def _scanned(summary: DataFrame, keys: Sequence[str], outputs: Mapping[str, Running]) -> DataFrame:
    """What the chunks before each chunk carry (``_from_`` columns), by blocks of chunks and then over the blocks."""
    blocks = summary.withColumn("_block", F.shiftright(CHUNK, _PART_BITS + _SCAN_BITS))
    inside = Window.partitionBy(*keys, "_block").orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    local = blocks.select(*keys, CHUNK, "_block", *[_carry(r, n, inside).alias(f"_in_{n}") for n, r in outputs.items()])
    whole = blocks.groupBy(*keys, "_block").agg(*[_summary(Running(r.kind, F.col(n)), [CHUNK]).alias(n) for n, r in outputs.items()])
    over = whole.select(*keys, "_block", *[_carry(r, n, before).alias(f"_over_{n}") for n, r in outputs.items()])
    over = over.filter(reduce(or_, [F.col(f"_over_{n}").isNotNull() for n in outputs]))
    return local.join(over, [*keys, "_block"], "left").select(
        *keys, CHUNK, *[_carried(r, F.col(f"_in_{n}"), F.col(f"_over_{n}")).alias(f"_from_{n}") for n, r in outputs.items()]
    )


def _carried(r: Running, inner: Column, outer: Column) -> Column:
    """Like :func:`_combine`, but null where nothing is carried."""
    return F.when(inner.isNotNull() | outer.isNotNull(), _combine(r, inner, outer))


def running(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    outputs: Mapping[str, Running],
    chunk: Column | None = None,
) -> DataFrame:
    """Add running values per ``keys`` in ``order``.  ``chunk`` must not decrease along the order.

    Without ``chunk`` the frame already has the column that :func:`range_chunks` or :func:`row_chunks` adds.
    """
    source = df if chunk is None else df.withColumn(CHUNK, chunk)
    part = [*keys, CHUNK]
    inside = Window.partitionBy(*part).orderBy(*order)
    summary = source.groupBy(*part).agg(*[_summary(r, order).alias(n) for n, r in outputs.items()])
    carried = _scanned(summary, keys, outputs)
    # First chunks carry nothing: ordinary groups leave this side empty.
    carried = carried.filter(reduce(or_, [F.col(f"_from_{n}").isNotNull() for n in outputs]))
    local = source.select("*", *[_local(r, inside).alias(f"_in_{n}") for n, r in outputs.items()])
    joined = local.join(carried, part, "left")
    columns = [c for c in df.columns if c not in outputs and c != CHUNK]
    return joined.select(
        *columns, *[_combine(r, F.col(f"_in_{n}"), F.col(f"_from_{n}")).alias(n) for n, r in outputs.items()]
    )


def top_k(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int | Column, rank: str = "rank"
) -> DataFrame:
    """First ``k`` rows per group.  A constant ``k`` lets Spark cut every map task to ``k`` rows per group before the shuffle."""
    ranked = df.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.filter(F.col(rank) <= k)


def ordered(df: DataFrame, *keys: str) -> DataFrame:
    """Deterministic total order (binary string comparison)."""
    return df.orderBy(*keys)


def explode_lines(df: DataFrame, text: str = "text") -> DataFrame:
    """One row per line, numbered from 1."""
    others = [c for c in df.columns if c != text]
    return df.select(*others, F.posexplode(F.split(F.col(text), "\n")).alias("line", "text")).withColumn(
        "line", (F.col("line") + 1).cast("long")
    )
