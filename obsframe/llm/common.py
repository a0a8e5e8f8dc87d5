"""What the operators share: staging on shared storage and gapless positions in a total order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from obsframe.session import staged

# monotonically_increasing_id() holds the partition above these bits and the row in it below them.
_ROW_BITS = 33


def positions(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Add ``name``: the 0-based gapless position of each row when all rows are sorted by ``order``.

    Rows are dealt to ranges, sorted there and written to the checkpoint folder, so that positions stay as they are
    when a task runs again.  Only one count for each range is gathered in one place.  Rows with equal keys may share a
    range; callers put a hash of the row's identity in ``order`` so that no key is hot.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [c.alias(f"_k{i}") for i, c in enumerate(order)]
    names = [f"_k{i}" for i in range(len(order))]
    ranged = df.select(*keys, F.struct("*").alias("_row")).repartitionByRange(n, *names).sortWithinPartitions(*names)
    at = staged(ranged.select("_row", F.monotonically_increasing_id().alias("_at")))
    part = F.shiftright("_at", _ROW_BITS)
    # One row for each range: bounded by the number of partitions, not by the data.
    sizes = at.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    local = F.col("_at") - F.shiftleft(part, _ROW_BITS)
    return at.join(F.broadcast(offsets), part == F.col("_part")).select(
        "_row.*", (F.col("_before") + local).alias(name)
    )


def unit_hash(*parts: Column) -> Column:
    """A number in [0, 1) from 52 bits of the MD5 of ``parts`` joined by colons; nulls read as empty."""
    text = F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / float(2**52)


def key_hash(*parts: Column) -> Column:
    """MD5 of ``parts`` joined by colons: a seeded order that SQL engines agree on."""
    return F.md5(F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]))
