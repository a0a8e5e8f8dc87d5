"""Exact top-k by inner product over a bit-sliced index."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from obsframe.llm import bitslice as bs
from obsframe.llm.ann import usable
from obsframe.session import staged


@dataclass(frozen=True)
class TopKParams:
    """Components become floor(scale * x)."""

    k: int = 5
    scale: int = 256
    block_rows: int = 32_768
    chunk_queries: int = 64


def quantised(v: Column, p: TopKParams) -> Column:
    return F.transform(v, lambda x: F.floor(x.cast("double") * p.scale).cast("long"))


def _rows(batch: pa.RecordBatch, dim: int) -> np.ndarray:
    out = np.zeros((batch.num_rows, dim), dtype=np.int64)
    for i, v in enumerate(batch.column("v").to_pylist()):
        out[i, : len(v)] = v
    return out


def _index_batches(low: np.ndarray, widths: np.ndarray, p: TopKParams):
    """Blocks of the partition's rows, by id, so that the first rows of a tie are the smallest ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        ids, rows = [], []

        def block():
            order = np.argsort(np.concatenate(ids), kind="stable")
            sliced = bs.slices(np.concatenate(rows)[order], low, widths)
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([part], pa.int32()),
                    pa.array([np.concatenate(ids)[order].tobytes()], pa.binary()),
                    pa.array([sliced.tobytes()], pa.binary()),
                ],
                names=["part", "ids", "slices"],
            )

        for batch in batches:
            for i in range(0, batch.num_rows, p.block_rows):
                piece = batch.slice(i, p.block_rows)
                if ids and sum(map(len, ids)) + piece.num_rows > p.block_rows:
                    yield block()
                    ids, rows = [], []
                if piece.num_rows:
                    ids.append(piece.column("vec_id").to_numpy(zero_copy_only=False))
                    rows.append(_rows(piece, len(low)))
        if ids:
            yield block()

    return run


def _chunk_batches(dim: int, p: TopKParams):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, n = TaskContext.get().partitionId(), 0
        for batch in batches:
            for i in range(0, batch.num_rows, p.chunk_queries):
                piece = batch.slice(i, p.chunk_queries)
                ids = piece.column("vec_id").to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([(part << 24) + n], pa.int64()), pa.array([ids.tobytes()], pa.binary()), pa.array([_rows(piece, dim).tobytes()], pa.binary())],
                    names=["chunk", "query_ids", "queries"],
                )
                n += 1

    return run


def _search_batches(low: np.ndarray, widths: np.ndarray, p: TopKParams):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for own, sliced, asking, queries in zip(*(batch.column(c) for c in ("ids", "slices", "query_ids", "queries")), strict=True):
                ids = np.frombuffer(own.as_py(), np.int64)
                index = np.frombuffer(sliced.as_py(), np.uint64).reshape(int(widths.sum()), -1)
                present = bs.bitmap(np.ones(len(ids), dtype=bool))
                found: list[tuple[int, int, int]] = []
                asks = np.frombuffer(asking.as_py(), np.int64).tolist()
                for one, query in zip(asks, np.frombuffer(queries.as_py(), np.int64).reshape(len(asks), -1), strict=True):
                    sums, constant = bs.inner_products(index, widths, low, query)
                    first, last = np.searchsorted(ids, one), np.searchsorted(ids, one, side="right")
                    valid = present
                    if first < last:
                        valid = present & ~bs.bitmap((np.arange(len(ids)) >= first) & (np.arange(len(ids)) < last))
                    rows = bs.top(sums, valid, p.k)
                    found += [(one, int(ids[r]), s + constant) for r, s in zip(rows, bs.values_at(sums, rows), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([f[i] for f in found], pa.int64()) for i in range(3)], names=["query_id", "vec_id", "score"]
                )

    return run


def top_inner_products(vectors: DataFrame, is_query: Column, p: TopKParams = TopKParams()) -> DataFrame:
    """vec_id, embedding in; query_id, rank (from 1), vec_id, score (integer inner product) out.

    ``is_query`` picks the rows that ask, all rows but those of its id answer.  Rows are packed into blocks of bitmaps, one
    for each bit of each attribute above its smallest value; every chunk of queries visits every block, which sends its k
    best.  Work is rows x queries / 64 words and bounded in memory by one block and one chunk.  Shorter vectors count as
    padded with zeros.  Null ids and unusable vectors take no part; zero vectors do; repeated rows are each a row.
    Bitmaps of a sum are as many as it needs and their values are whole numbers of any size, so a score is exact as long as
    it fits a long itself; a result with one that does not fails.  Components of 2**62 and more are refused.
    """
    clean = vectors.filter(F.col("vec_id").isNotNull() & usable(F.col("embedding"), allow_zero=True)).select(
        F.col("vec_id").cast("long").alias("vec_id"), quantised(F.col("embedding"), p).alias("v"), is_query.alias("asks")
    )
    # One row for each attribute; 0 belongs to its range for the padding.
    ranges = clean.select(F.posexplode("v").alias("j", "x")).groupBy("j").agg(F.min("x").alias("low"), F.max("x").alias("high"), F.count("*").alias("n")).orderBy("j").collect()
    total = max((r.n for r in ranges), default=0)
    low = np.array([min(r.low, 0) for r in ranges], dtype=np.int64)
    # A component beyond 64 bits shows as the largest number of them.
    if any(max(abs(r.low), abs(r.high)) >= 1 << 62 for r in ranges):
        raise ValueError("a component leaves 64 bits")
    widths = np.array([max(1, int(max(r.high, 0) - min(r.low, 0)).bit_length()) for r in ranges], dtype=np.int64)
    blocks = max(1, -(-total // p.block_rows))
    index = staged(
        clean.select("vec_id", "v").repartition(blocks).mapInArrow(_index_batches(low, widths, p), "part int, ids binary, slices binary")
    )
    chunks = staged(
        clean.filter("asks").select("vec_id", "v").coalesce(blocks).mapInArrow(_chunk_batches(len(low), p), "chunk long, query_ids binary, queries binary")
    )
    # Chunks go to every block; few blocks are copied so that all cores have a share of the chunks.
    spread = max(1, min(-(-2 * vectors.sparkSession.sparkContext.defaultParallelism // blocks), 64))
    salted = index.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(spread - 1))))
    every = chunks.withColumn("salt", F.pmod(F.xxhash64("chunk"), F.lit(spread)).cast("int"))
    visits = every.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    met = salted.join(visits, ["part", "salt"]).select("ids", "slices", "query_ids", "queries")
    found = met.mapInArrow(_search_batches(low, widths, p), "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= p.k)
    return ranked.select("query_id", "rank", "vec_id", "score")
