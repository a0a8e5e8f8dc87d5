"""Sequential walks along an array inside one row, without an array that grows by one element a step."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

_WIDTH = 256


def let(value: Column, of: Callable[[Column], Column]) -> Column:
    """``of(value)`` with ``value`` computed once, however often ``of`` names it."""
    return F.get(F.transform(F.array(value), of), F.lit(0))


def blocks(items: Column) -> Column:
    """The array cut into arrays of 256; none for an empty one."""
    def cut(whole: Column) -> Column:
        starts = F.sequence(F.lit(0), F.floor((F.size(whole) - 1) / _WIDTH).cast("int"))
        return F.when(F.size(whole) > 0, F.transform(starts, lambda i: F.slice(whole, i * _WIDTH + 1, F.lit(_WIDTH)))).otherwise(F.array())

    return let(items, cut)


def walk(items: Column, start: Column, step: Callable[[Column, Column], Column], out: Callable[[Column, Column], Column], kind: str) -> Column:
    """``out(state, item)``, of type ``kind``, for each item in order; state is ``start``, then ``step(state, item)`` of the item before.

    Appending copies, so outputs gather in blocks of 256 and blocks in an array: n items copy about 128 n + n * n / 131,072.
    """
    def one(acc: Column, item: Column) -> Column:
        added = F.concat(acc["out"], F.array(out(acc["state"], item).cast(kind)))
        return F.struct(step(acc["state"], item).alias("state"), added.alias("out"))

    def block(acc: Column, held: Column) -> Column:
        empty = F.struct(acc["state"].alias("state"), F.array().cast(f"array<{kind}>").alias("out"))
        return let(
            F.aggregate(held, empty, one),
            lambda done: F.struct(done["state"].alias("state"), F.concat(acc["out"], F.array(done["out"])).alias("out")),
        )

    zero = F.struct(start.alias("state"), F.array().cast(f"array<array<{kind}>>").alias("out"))
    return F.aggregate(blocks(items), zero, block, lambda acc: F.flatten(acc["out"]))
