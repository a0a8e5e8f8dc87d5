"""Approximate nearest neighbours: cross-polytope tables, multiprobe candidates, exact reranking."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from obsframe.llm import crosspolytope as cp
from obsframe.session import staged


@dataclass(frozen=True)
class AnnParams:
    """One hash of 2 * dimension buckets for each table.  The neighbours asked for may lie far off (a distance of 1 between
    unit vectors), so recall comes from tables and probes; for close neighbours more ``hashes`` give smaller buckets."""

    k: int = 10
    tables: int = 10
    hashes: int = 1
    probes: int = 8
    seed: int = 7
    block_rows: int = 65_536


def usable(v: Column, allow_zero: bool = False) -> Column:
    """Not null, not empty, all components finite, and not all zero unless allowed."""
    finite = F.forall(v, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    ok = v.isNotNull() & (F.size(v) > 0) & finite
    return ok if allow_zero else ok & F.exists(v, lambda x: x != 0)


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of one length as doubles."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _by_dim(batch: pa.RecordBatch) -> Iterator[tuple[int, pa.RecordBatch]]:
    dims = np.array([len(v) for v in batch.column("v")])
    for d in np.unique(dims):
        yield int(d), batch.filter(pa.array(dims == d))


_BLOCK = "dim int, tab int, bucket long, who binary, vectors binary"


def _blocks(p: AnnParams, probe: bool, width: int):
    """Pack rows into a block for each bucket they lie in (or, as queries, look into).  ``who``: ``width`` ids a row."""

    def flush(rows: list[tuple[int, np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        for dim in sorted({d for d, _, _ in rows}):
            who = np.concatenate([w for d, w, _ in rows if d == dim])
            x = np.concatenate([v for d, _, v in rows if d == dim])
            s = cp.signs(p.seed, p.tables, p.hashes, cp.padded(dim))
            unit = _unit(x)
            found = cp.probes(unit, s, p.probes) if probe else cp.codes(unit, s)[:, :, None]
            for t in range(p.tables):
                code, row = found[:, t].ravel(), np.repeat(np.arange(len(x)), found.shape[2])
                order = np.argsort(code, kind="stable")
                code, row = code[order], row[order]
                starts = np.flatnonzero(np.r_[True, code[1:] != code[:-1]])
                ends = np.r_[starts[1:], len(code)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(starts), dim), pa.int32()),
                        pa.array(np.full(len(starts), t), pa.int32()),
                        pa.array(code[starts]),
                        pa.array([who[row[a:b]].tobytes() for a, b in zip(starts, ends, strict=True)], pa.binary()),
                        pa.array([x[row[a:b]].tobytes() for a, b in zip(starts, ends, strict=True)], pa.binary()),
                    ],
                    names=["dim", "tab", "bucket", "who", "vectors"],
                )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for batch in batches:
            for dim, part in _by_dim(batch):
                # A row of fewer ids repeats its last one.
                who = np.array([ids + ids[-1:] * (width - len(ids)) for ids in part.column("ids").to_pylist()], dtype=np.int64)
                rows.append((dim, who, _matrix(part.column("v"))))
                held += len(part)
            if held >= p.block_rows:
                yield from flush(rows)
                rows, held = [], 0
        if held:
            yield from flush(rows)

    return run


def _rerank(p: AnnParams, width: int):
    """Exact distances of a block of queries to a block of vectors; the best k + 1 ids a query, kept over the task's blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, dict[int, float]] = {}
        held = 0

        def out():
            q, i, s = [], [], []
            for query, found in best.items():
                for vec, score in sorted(found.items(), key=lambda x: (x[1], x[0]))[:width]:
                    q.append(query)
                    i.append(vec)
                    s.append(score)
            return pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(i, pa.int64()), pa.array(s, pa.float64())], names=["q", "vec_id", "score"])

        for batch in batches:
            for dim, qs, qv, who, v in zip(*(batch.column(c) for c in ("dim", "queries", "query_vectors", "who", "vectors")), strict=True):
                dim = dim.as_py()
                q = np.frombuffer(qs.as_py(), np.int64)
                y = np.frombuffer(qv.as_py(), np.float64).reshape(-1, dim)
                ids = np.frombuffer(who.as_py(), np.int64).reshape(-1, width)
                x = np.frombuffer(v.as_py(), np.float64).reshape(-1, dim)
                for one, z in zip(q.tolist(), y, strict=True):
                    d = np.sqrt(((x - z) ** 2).sum(axis=1))
                    near = np.flatnonzero(d <= np.partition(d, width - 1)[width - 1]) if len(d) > width else np.arange(len(d))
                    mine = best.setdefault(one, {})
                    held -= len(mine)
                    # Ids of a row are its smallest ones: of more rows at the last distance, the smallest width ids stay.
                    mine.update({i: float(d[r]) for r in near for i in ids[r].tolist()})
                    if len(mine) > 4 * width:
                        kept = sorted(mine.items(), key=lambda x: (x[1], x[0]))[:width]
                        best[one] = mine = dict(kept)
                    held += len(mine)
                if held > 500_000:
                    yield out()
                    best.clear()
                    held = 0
        if best:
            yield out()

    return run


def nearest(vectors: DataFrame, is_query: Column, p: AnnParams = AnnParams()) -> DataFrame:
    """vec_id, embedding in; query_id, rank (from 1), vec_id, score (Euclidean distance) out.

    ``is_query`` picks the rows that ask; every other row answers.  Equal vectors are one row of the index with their
    k + 1 smallest ids (more can never be returned), so a vector that many rows share costs one.  Rows with a null vec_id
    or an unusable vector take no part; vectors of other dimensions are not compared.  Rows that repeat a vec_id with the
    same vector count once; a query never finds its own id.
    """
    width = p.k + 1
    clean = vectors.filter(F.col("vec_id").isNotNull() & usable(F.col("embedding"))).select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v")
    )
    clean = clean.withColumn("v", F.transform("v", lambda x: x + F.lit(0.0)))  # -0.0 and 0.0 are one vector
    # The limit on the rank reaches the map side, so a hot vector sends width rows from each task.
    rank = F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))
    rows = clean.distinct().withColumn("_r", rank).filter(F.col("_r") <= width)
    distinct = staged(rows.groupBy("v").agg(F.array_sort(F.collect_list("vec_id")).alias("ids")))
    asking = clean.filter(is_query).distinct()
    # Queries with equal vectors search once, under their smallest id.
    names = asking.groupBy("v").agg(F.min("vec_id").alias("q"))
    n = distinct.count()
    parts = max(1, -(-n // p.block_rows))
    index = distinct.repartition(parts).mapInArrow(_blocks(p, False, width), _BLOCK)
    searches = names.select("v", F.array("q").alias("ids")).coalesce(parts).mapInArrow(_blocks(p, True, 1), _BLOCK)
    searches = searches.select("dim", "tab", "bucket", F.col("who").alias("queries"), F.col("vectors").alias("query_vectors"))
    met = index.join(searches, ["dim", "tab", "bucket"]).mapInArrow(_rerank(p, width), "q long, vec_id long, score double")
    order = Window.partitionBy("q").orderBy("score", "vec_id")
    best = met.groupBy("q", "vec_id").agg(F.min("score").alias("score")).withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= width)
    found = asking.join(names, "v").select(F.col("vec_id").alias("query_id"), "q").join(best, "q").filter("query_id <> vec_id")
    mine = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(mine)).filter(F.col("rank") <= p.k).select("query_id", "rank", "vec_id", "score")
