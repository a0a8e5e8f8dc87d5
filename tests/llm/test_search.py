"""Neighbours and top-k searches against brute force; hashes and bitmaps on their own."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from obsframe.llm import ann, bitslice, topk
from obsframe.llm import crosspolytope as cp

SCHEMA = "vec_id long, embedding array<float>, score string, rank int"


def rows_of(x: np.ndarray, ids=None) -> list[tuple]:
    ids = range(len(x)) if ids is None else ids
    return [(int(i), [float(v) for v in r], "mine", 1) for i, r in zip(ids, x.astype(np.float32), strict=True)]


def clustered(n: int, dim: int, seed: int, spread: float = 0.35) -> np.ndarray:
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, dim))
    x = centres[rng.integers(0, 12, n)] + spread * rng.normal(size=(n, dim))
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


def brute_nearest(x: np.ndarray, ids: np.ndarray, queries: np.ndarray, k: int) -> dict:
    x = x.astype(np.float64)
    out = {}
    for q in queries:
        d = np.sqrt(((x - x[ids == q][0]) ** 2).sum(axis=1))
        order = sorted((float(d[i]), int(ids[i])) for i in range(len(x)) if ids[i] != q)[:k]
        out[int(q)] = order
    return out


def test_recall_scores_and_order(spark):
    x = clustered(1500, 24, 3)
    df = spark.createDataFrame(rows_of(x), SCHEMA)
    got: dict = {}
    for r in ann.nearest(df, F.col("vec_id") % 100 == 0).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.score, r.vec_id))
        assert r.rank == len(got[r.query_id])
    true = brute_nearest(x, np.arange(1500), np.arange(0, 1500, 100), 10)
    assert set(got) == set(true)
    hits = sum(len({i for _, i in got[q]} & {i for _, i in true[q]}) for q in true)
    assert hits >= 0.9 * sum(map(len, true.values()))
    for q, found in got.items():
        assert found == sorted(found) and len(found) == 10
        for s, i in found:
            assert math.isclose(s, float(np.linalg.norm(x[q].astype(float) - x[i].astype(float))), abs_tol=1e-12)


def test_copies_ties_and_bad_vectors(spark):
    x = clustered(40, 8, 1)
    copies = np.repeat(x[:1], 30, axis=0)
    rows = rows_of(x, range(1, 41)) + rows_of(copies, range(100, 130))
    rows += [(200, None, "", 0), (300, [0.0] * 8, "", 0), (400, [1.0, None], "", 0), (500, [float("nan")] * 8, "", 0)]
    rows += [(600, [float("inf")] * 8, "", 0), (None, [1.0] * 8, "", 0), (700, [], "", 0), (800, [1.0, 2.0, 3.0], "", 0)]
    rows += rows_of(copies[:1], [100])  # a repeated row
    got: dict = {}
    for r in ann.nearest(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 100 == 0).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    # Row 1 and the copies are one vector; the smallest ids come first, never the query's own.
    assert got[100] == [(i, 0.0) for i in (1, 101, 102, 103, 104, 105, 106, 107, 108, 109)]
    assert set(got) == {100}  # 800 has no other row of its dimension


def test_fewer_rows_than_k_and_none(spark):
    x = clustered(3, 8, 2, spread=0.01)
    x[1:] = x[0] + np.float32(0.001) * np.arange(1, 3, dtype=np.float32)[:, None]
    got = ann.nearest(spark.createDataFrame(rows_of(x), SCHEMA), F.col("vec_id") == 0).collect()
    assert [(r.rank, r.vec_id) for r in sorted(got, key=lambda r: r.rank)] == [(1, 1), (2, 2)]
    empty = spark.createDataFrame([], SCHEMA)
    assert ann.nearest(empty, F.col("vec_id") == 0).collect() == []
    assert topk.top_inner_products(empty, F.col("vec_id") == 0).collect() == []


def test_rotations_keep_lengths_and_first_probe_is_the_bucket():
    x = clustered(200, 12, 5).astype(float)
    s = cp.signs(3, 4, 2, cp.padded(12))
    assert np.allclose(np.linalg.norm(cp.rotate(x, s[0, 0]), axis=1), 1, atol=1e-6)
    assert (cp.probes(x, s, 6)[:, :, 0] == cp.codes(x, s)).all()
    for row in cp.probes(x, s, 6).reshape(-1, 6):
        assert len(set(row)) == 6


def brute_top(q: np.ndarray, ids: np.ndarray, asks, k: int) -> dict:
    out = {}
    for a in asks:
        for row in np.flatnonzero(ids == a):
            s = q @ q[row]
            out[int(a)] = sorted((-int(s[i]), int(ids[i])) for i in range(len(q)) if ids[i] != a)[:k]
    return out


def check_top(spark, rows, q, ids, p):
    got: dict = {}
    for r in topk.top_inner_products(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 50 == 0, p).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((-r.score, r.vec_id))
    assert got == brute_top(q, ids, [i for i in ids if i % 50 == 0], p.k)


def test_top_k_is_exact(spark):
    x = clustered(700, 10, 7)
    q = np.floor(256 * x.astype(float)).astype(int)
    check_top(spark, rows_of(x), q, np.arange(700), topk.TopKParams(block_rows=128, chunk_queries=3))


def test_top_k_ties_zeros_and_large(spark):
    rng = np.random.default_rng(1)
    x = rng.integers(-3, 4, (230, 5)).astype(np.float32) / 256
    x[:60] = 0
    x[60:120] = x[60]
    x[150] = [1000.5, -2000.25, 3.0, 0.0, -0.001]
    q = np.floor(256 * x.astype(float)).astype(int)
    rows = rows_of(x) + [(1000, None, "", 0), (1050, [float("nan")] * 5, "", 0), (1100, [1.0, None], "", 0)]
    check_top(spark, rows, q, np.arange(230), topk.TopKParams(block_rows=64, chunk_queries=2))


def test_bitmap_sums_equal_products():
    rng = np.random.default_rng(2)
    v = rng.integers(-300, 500, (333, 6))
    low = v.min(axis=0)
    widths = np.array([int(d).bit_length() for d in v.max(axis=0) - low])
    index = bitslice.slices(v, low, widths)
    for query in (np.array([3, -7, 0, 255, -256, 1]), np.zeros(6, int), np.array([-1] * 6)):
        sums, constant = bitslice.inner_products(index, widths, low, query)
        got = [s + constant for s in bitslice.values_at(sums, np.arange(333))]
        assert got == (v @ query).tolist()


def test_large_components_are_exact_and_too_large_ones_refused(spark):
    x = np.array([[400_000.5, 1.0], [300_000.25, 2.0], [-900_000.0, 0.5], [0.0, 3.0]])
    q = np.floor(256 * x.astype(np.float32).astype(float)).astype(np.int64)
    ids = np.array([50, 1, 2, 3])
    check_top(spark, rows_of(x, ids), q.astype(object), ids, topk.TopKParams())
    df = spark.createDataFrame(rows_of(np.array([[1e30, 1.0], [2.0, 1.0]])), SCHEMA)
    with pytest.raises(ValueError, match="64 bits"):
        topk.top_inner_products(df, F.col("vec_id") == 0)


def test_one_large_component_a_row_is_no_reason_to_refuse(spark):
    x = np.ones((64, 64)) + np.eye(64) * 2.0**21
    check_top(spark, rows_of(x), np.floor(256 * x).astype(np.int64).astype(object), np.arange(64), topk.TopKParams())


@pytest.mark.parametrize("dim", [1, 2])
def test_small_dimensions_are_searched(spark, dim):
    x = clustered(60, dim, 4)
    df = spark.createDataFrame(rows_of(x) + rows_of(clustered(60, 8, 4), range(100, 160)), SCHEMA)
    got = {r.query_id for r in ann.nearest(df, F.col("vec_id").isin(0, 100)).collect()}
    assert got == {0, 100}
    found = cp.probes(x.astype(float), cp.signs(1, 3, 1, cp.padded(dim)), 8)
    assert found.shape[2] == 4 and all(len(set(row)) == 4 for row in found.reshape(-1, 4))
