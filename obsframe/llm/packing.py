"""Length buckets of least padding and token-budget batches inside them."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from obsframe.llm.common import key_hash, positions
from obsframe.session import staged


@dataclass(frozen=True)
class PackingParams:
    """Lengths above ``budget`` fit no batch with others: such a document is a batch of its own, never cut."""

    buckets: int = 8
    budget: int = 16_384
    seed: int = 0


def word_count(text: Column) -> Column:
    """Words of a text, split at ASCII white space; null and empty: 0."""
    trimmed = F.regexp_replace(F.coalesce(text, F.lit("")), r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "")
    return F.when(trimmed == "", 0).otherwise(F.size(F.split(trimmed, r"[\x20\x09-\x0D]+"))).cast("long")


def _count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts = [len((t.as_py() or b"").split()) for t in batch.column("text")]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(counts, pa.int64())], names=["doc_id", "length"])


def word_lengths(docs: DataFrame) -> DataFrame:
    """doc_id, length (see word_count) of each row of ``docs``, staged: each text is read once."""
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return staged(source.mapInArrow(_count_batches, "doc_id long, length long"))


def boundaries(lengths: np.ndarray, counts: np.ndarray, buckets: int) -> list[int]:
    """Upper lengths of at most ``buckets`` buckets over sorted distinct lengths, least total padding; of ties the lowest.

    best[b][j] = min over i < j of best[b-1][i] + lengths[j-1] * (rows i..j) - (tokens i..j).  The lowest best i never falls
    as j grows, so each layer is filled by halving: O(n log n) a bucket.
    """
    n = len(lengths)
    if not n:
        return []
    rows = np.concatenate([[0], np.cumsum(counts)]).astype(np.float64)
    tokens = np.concatenate([[0], np.cumsum(lengths * counts)]).astype(np.float64)
    best = np.full(n + 1, np.inf)
    best[0] = 0.0
    cuts = []
    for _ in range(min(buckets, n)):
        new, cut = np.full(n + 1, np.inf), np.zeros(n + 1, dtype=int)
        new[0] = 0.0
        todo = [(1, n, 0, n - 1)]
        while todo:
            low, high, first, last = todo.pop()
            if low > high:
                continue
            j = (low + high) // 2
            i = np.arange(first, min(j - 1, last) + 1)
            cost = best[i] + lengths[j - 1] * (rows[j] - rows[i]) - (tokens[j] - tokens[i])
            k = int(np.argmin(cost))
            new[j], cut[j] = cost[k], first + k
            found = first + k if np.isfinite(cost[k]) else first
            todo += [(low, j - 1, first, found), (j + 1, high, found if np.isfinite(cost[k]) else first, last)]
        best = new
        cuts.append(cut)
    out, j = [], n
    for cut in reversed(cuts):
        if j == 0:
            break
        out.append(int(lengths[j - 1]))
        j = int(cut[j])
    return out[::-1]


def choose_boundaries(docs: DataFrame, length: str, p: PackingParams) -> list[int]:
    """Boundaries over the histogram of all lengths up to the budget: at most ``budget`` + 1 rows reach the driver."""
    rows = docs.filter(F.col(length) <= p.budget).groupBy(length).agg(F.count("*").alias("_n")).collect()
    rows.sort()
    return boundaries(np.array([r[0] for r in rows]), np.array([r[1] for r in rows]), p.buckets)


def bucket_column(length: Column, bounds: list[int]) -> Column:
    """Index of the first boundary that is not below the length; the number of boundaries for longer ones."""
    out = F.lit(len(bounds))
    for i in range(len(bounds) - 1, -1, -1):
        out = F.when(length <= bounds[i], i).otherwise(out)
    return out


def pack(docs: DataFrame, p: PackingParams = PackingParams()) -> DataFrame:
    """doc_id, length in; with bucket, padded_length, batch (from 0 in each bucket) and slot out, a row for each row.

    Rows of a bucket stand in the order of a seeded hash; a batch takes as many as ``budget`` holds at the padded length (a
    length of 0 counts as 1).  Longer documents come last, each alone in a batch of bucket ``buckets used``, unpadded.
    No text moves: only ids and lengths are sorted.
    """
    bounds = choose_boundaries(docs, "length", p)
    keyed = docs.select("doc_id", "length").withColumn("bucket", bucket_column(F.col("length"), bounds))
    keyed = keyed.withColumn("_h", key_hash(F.lit(p.seed), F.col("doc_id")))
    placed = positions(keyed, [F.col("bucket"), F.col("_h"), F.col("doc_id"), F.col("length")], "_pos")
    # One row for each bucket.
    starts = placed.groupBy("bucket").agg(F.min("_pos").alias("_start"))
    joined = placed.join(F.broadcast(starts), "bucket").withColumn("_at", F.col("_pos") - F.col("_start"))
    if bounds:
        tops = F.array(*[F.lit(b) for b in bounds])
        padded = F.when(F.col("bucket") < len(bounds), F.element_at(tops, F.least(F.col("bucket") + 1, F.lit(len(bounds)))).cast("long")).otherwise(F.col("length"))
    else:
        padded = F.col("length")
    joined = joined.withColumn("padded_length", padded.cast("long"))
    size = F.greatest(F.floor(F.lit(p.budget) / F.greatest("padded_length", F.lit(1))), F.lit(1))
    size = F.when(F.col("bucket") < len(bounds), size).otherwise(F.lit(1))
    return joined.select(
        "doc_id",
        "length",
        F.col("bucket").cast("int").alias("bucket"),
        "padded_length",
        F.floor(F.col("_at") / size).cast("long").alias("batch"),
        (F.col("_at") % size).cast("long").alias("slot"),
    )
