"""Packing, sharding, mixing and language model scores against plain versions."""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from obsframe.llm import lm, mixing, packing, sharding
from obsframe.llm.common import positions


def digest(*parts) -> str:
    return hashlib.md5(":".join("" if p is None else str(p) for p in parts).encode()).hexdigest()


# --- positions


def test_positions_are_gapless_and_ordered(spark):
    rng = random.Random(1)
    rows = [(rng.randrange(20), i, "x") for i in range(500)] + [(None, 1000, None)]
    df = spark.createDataFrame(rows, "k int, i int, pos string")
    got = positions(df, [F.col("k"), F.col("i")], "at").collect()
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    assert [r.i for r in sorted(got, key=lambda r: r["at"])] == [r[1] for r in order]
    assert sorted(r["at"] for r in got) == list(range(len(rows)))
    assert positions(df.limit(0), [F.col("k")], "at").collect() == []


# --- packing


def padding(lengths, counts, cuts):
    tops = sorted(cuts)
    return sum((next(t for t in tops if t >= x) - x) * n for x, n in zip(lengths, counts, strict=True))


def exhaustive(lengths, counts, buckets):
    from itertools import combinations

    best = None
    for m in range(1, min(buckets, len(lengths)) + 1):
        for inner in combinations(lengths[:-1], m - 1):
            cost = padding(lengths, counts, [*inner, lengths[-1]])
            best = cost if best is None else min(best, cost)
    return best


def test_boundaries_are_optimal():
    rng = random.Random(2)
    for _ in range(60):
        n = rng.randrange(1, 10)
        lengths = sorted(rng.sample(range(0, 60), n))
        counts = [rng.randrange(1, 9) for _ in lengths]
        for buckets in (1, 2, 3, 5):
            cuts = packing.boundaries(np.array(lengths), np.array(counts), buckets)
            assert cuts == sorted(set(cuts)) and cuts[-1] == lengths[-1] and len(cuts) <= buckets
            assert padding(lengths, counts, cuts) == exhaustive(lengths, counts, buckets)
    assert packing.boundaries(np.array([], int), np.array([], int), 3) == []


def test_pack(spark):
    rng = random.Random(3)
    lengths = [rng.choice([0, 1, 5, 17, 40, 90, 99, 100, 101, 5000]) for _ in range(300)]
    rows = [(i, n, "mine", 3) for i, n in enumerate(lengths)] + [(None, 7, "", 0), (5, 17, "", 0), (5, 17, "", 0)]
    df = spark.createDataFrame(rows, "doc_id long, length long, batch string, slot int")
    p = packing.PackingParams(buckets=3, budget=100, seed=4)
    got = packing.pack(df, p).collect()
    assert Counter((r.doc_id, r.length) for r in got) == Counter((r[0], r[1]) for r in rows)
    used = Counter(r[1] for r in rows if r[1] <= 100)
    cuts = packing.boundaries(np.array(sorted(used)), np.array([used[k] for k in sorted(used)]), 3)
    batches = defaultdict(list)
    for r in got:
        if r.length > 100:
            assert (r.bucket, r.padded_length, r.slot) == (len(cuts), r.length, 0)
        else:
            assert r.bucket == next(i for i, c in enumerate(cuts) if c >= r.length) and r.padded_length == cuts[r.bucket]
        batches[r.bucket, r.batch].append(r)
    for (bucket, _), rs in batches.items():
        assert sorted(r.slot for r in rs) == list(range(len(rs)))
        if bucket < len(cuts):
            assert len(rs) * cuts[bucket] <= 100
    for bucket in range(len(cuts)):
        own = sorted((r for r in got if r.bucket == bucket), key=lambda r: (r.batch, r.slot))
        sizes = Counter(r.batch for r in own)
        full = max(1, 100 // max(1, cuts[bucket]))
        assert all(sizes[b] == full for b in range(len(sizes) - 1))  # only the last one is short
        order = [(digest(4, r.doc_id), r.doc_id if r.doc_id is not None else -1, r.length) for r in own]
        assert order == sorted(order)
    assert packing.pack(df.limit(0), p).collect() == []


def test_word_count(spark):
    texts = [None, "", " \t", "a", " a  b\n", "é  ö", "x " * 10_000, "a b", "\x0b\x0c\rz"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = [r[0] for r in df.select(packing.word_count(F.col("text"))).collect()]
    assert got == [r.length for r in packing.word_lengths(df).orderBy("doc_id").collect()]
    assert got == [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for t in texts]


# --- sharding


def plain_interleave(rows, shards, seed):
    by = defaultdict(list)
    for r in rows:
        by[r[1]].append(r)
    ranked = []
    for source, own in by.items():
        own.sort(key=lambda r: (digest(seed, r[0]), r[0] is not None, r[0] or 0, r[2]))
        ranked += [((i + 0.5) / len(own), source is not None, source or "", digest(seed, r[0]), r) for i, r in enumerate(own)]
    ranked.sort(key=lambda x: x[:4])
    n, out, first = len(ranked), [], {}
    for at, x in enumerate(ranked):
        shard = at * shards // n
        first.setdefault(shard, at)
        out.append((x[4][0], x[4][2], shard, at - first[shard]))
    return sorted(out, key=str)


@pytest.mark.parametrize("n", [5, 100, 601])
def test_interleave(spark, n):
    rng = random.Random(n)
    rows = [(i, rng.choice(["a", "a", "a", "b", "c", None]), i * 3, "mine") for i in range(n)]
    df = spark.createDataFrame(rows, "doc_id long, source string, size long, shard string").drop("shard").withColumn("label", F.lit("x"))
    got = sharding.interleave(df, 24, 5, ties=("size",)).collect()
    assert sorted(((r.doc_id, r["size"], r.shard, r.slot) for r in got), key=str) == plain_interleave(rows, 24, 5)
    sizes = Counter(r.shard for r in got)
    assert max(sizes.values()) - min([*sizes.values(), *([0] if len(sizes) < 24 else [])]) <= 1
    # Every shard holds each source in proportion, to within two rows.
    share = Counter(r[1] for r in rows)
    for s, k in sizes.items():
        own = Counter(r.source for r in got if r.shard == s)
        assert all(abs(own[c] - share[c] * k / n) <= 2 for c in share)


def test_interleave_empty_and_repeated(spark):
    schema = "doc_id long, source string"
    assert sharding.interleave(spark.createDataFrame([], schema), 24).collect() == []
    rows = [(1, "a")] * 5 + [(None, None)] * 2
    got = sharding.interleave(spark.createDataFrame(rows, schema), 3).collect()
    assert sorted(Counter(r.shard for r in got).values()) == [2, 2, 3]
    assert sorted((r.shard, r.slot) for r in got) == [(s, i) for s, k in sorted(Counter(r.shard for r in got).items()) for i in range(k)]


def test_write_shards(spark, tmp_path):
    docs = spark.createDataFrame([(i, "s", f"text {i}") for i in range(30)], "doc_id long, source string, text string")
    placed = sharding.interleave(docs.select("doc_id", "source"), 4)
    sharding.write_shards(docs, placed, str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert {(r.doc.doc_id, r.shard, r.slot) for r in back.collect()} == {(r.doc_id, r.shard, r.slot) for r in placed.collect()}


# --- mixing


def test_poisson_of_very_large_means(spark):
    """One document that stands for ten million: the count lies where the normal approximation puts it."""
    df = spark.createDataFrame([(i, "rare", "x") for i in range(40)], "doc_id long, source string, text string")
    rows = mixing.repetitions(df, rows=4e8).select("mean", "u", "copies").collect()
    z = [(r.copies - r.mean) / r.mean**0.5 for r in rows]
    assert {r.mean for r in rows} == {1e7}
    assert all(abs(math.erf(v / 2**0.5) / 2 + 0.5 - r.u) < 1e-3 for v, r in zip(z, rows, strict=True))


def poisson_quantile(mean: float, u: float) -> int:
    if mean <= 0:
        return 0
    k, log, total = 0, -mean, math.exp(-mean)
    while total <= u and k < mean + 12 * math.sqrt(mean) + 40:
        k += 1
        log += math.log(mean) - math.log(k)
        total += math.exp(log)
    return k


@pytest.mark.parametrize("weights", [None, {"a": 0.7, "b": 0.3}, {"c": 1.0}, {}])
def test_mix(spark, weights):
    rng = random.Random(9)
    rows = [(i, rng.choice(["a", "a", "a", "b", "c", None]), f"t{i}", "mine", 5) for i in range(400)] + [(7, "a", "again", "", 0)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string, copy string, key int")
    sizes = Counter(r[1] for r in rows)
    share = {s: 1.0 if weights is None else weights.get(s, 0.0) for s in sizes}
    whole = sum(share.values())
    expected = Counter()
    for i, s, t, *_ in rows:
        u = int(digest(3, i)[:13], 16) / 2**52
        mean = share[s] / whole * len(rows) / sizes[s] if whole else 0.0
        expected[i, t] += poisson_quantile(mean, u)
    mixed = mixing.mix(df, weights, seed=3)
    got = mixed.select("_row.*", F.col("copy").alias("n"), F.col("key").alias("order")).collect()
    assert Counter((r.doc_id, r.text) for r in got) == +expected
    assert all(r.order == digest(3, r.doc_id, r.n) and r["copy"] in ("mine", "") for r in got)
    placed = mixing.placed(mixed).collect()
    assert [r.position for r in sorted(placed, key=lambda r: (digest(3, r.doc_id, r["copy"]), r.doc_id, r["copy"], r.position))] == list(range(len(placed)))
    out = [r.key for r in mixing.shuffled(mixed).select("key").collect()]
    assert out == sorted(out)


def test_mix_large_mean_and_empty(spark):
    df = spark.createDataFrame([(i, "a") for i in range(5)], "doc_id long, source string")
    got = Counter(r.doc_id for r in mixing.mix(df, rows=6000.0).select("_row.doc_id").collect())
    assert dict(got) == {i: poisson_quantile(1200.0, int(digest(0, i)[:13], 16) / 2**52) for i in range(5)}
    assert mixing.mix(df.limit(0)).collect() == []


# --- language model


def plain_scores(texts, order, alpha):
    docs = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    grams = lambda d: Counter(tuple(d[i : i + m]) for m in range(1, order + 1) for i in range(len(d) - m + 1))
    own = [grams(d) for d in docs]
    whole = sum(own, Counter())
    words = sum(map(len, docs))
    out = []
    for d, mine in zip(docs, own, strict=True):
        total, short = 0.0, 0
        rest = max(words - len(d), 1)
        for i in range(len(d)):
            top = min(order, i + 1)
            for m in range(top, 0, -1):
                g = tuple(d[i - m + 1 : i + 1])
                c = whole[g] - mine[g]
                if m == 1:
                    s = max(c, 1) / rest
                elif c > 0:
                    s = c / (whole[g[:-1]] - mine[g[:-1]])
                else:
                    continue
                total += math.log(alpha ** (top - m) * s)
                # Short: the longest n-gram of the model that fits here was not seen elsewhere.
                short += m < top and top == order
                break
        out.append((len(d), total, short))
    return out


@pytest.mark.parametrize("order", [1, 2, 3])
def test_stupid_backoff(spark, order):
    rng = random.Random(order)
    words = ["the", "of", "a", "in", "x1", "y2", "é", "Z"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.choice([1, 2, 5, 30]))) for _ in range(60)]
    texts += [None, "", "  ", "unseen", "the of", texts[0], texts[0], "the " * 3000]
    df = spark.createDataFrame([(i, t, 1.5) for i, t in enumerate(texts)], "doc_id long, text string, log_score double")
    p = lm.LmParams(order=order, chunk_docs=7, bucket_bytes=64)
    got = {r.doc_id: r for r in lm.stupid_backoff(df, p).collect()}
    for i, (n, s, short) in enumerate(plain_scores(texts, order, p.alpha)):
        assert got[i].n_words == n and math.isclose(got[i].log_score, s, rel_tol=1e-9, abs_tol=1e-9), i
        if order <= 2:
            assert got[i].n_backoff == (short if order > 1 else 0), i


def test_stupid_backoff_edges(spark):
    schema = "doc_id long, text string"
    assert lm.stupid_backoff(spark.createDataFrame([], schema)).collect() == []
    rows = [(None, "a b"), (None, "a b"), (1, None)]
    got = sorted((r.n_words, round(r.log_score, 6)) for r in lm.stupid_backoff(spark.createDataFrame(rows, schema)).collect())
    assert got == [(0, 0.0), (2, round(math.log(0.5), 6)), (2, round(math.log(0.5), 6))]


def test_key_packing_round_trip():
    rng = np.random.default_rng(1)
    keys = np.unique(rng.integers(0, 2**64, 1000, dtype=np.uint64))
    parts = [(p, lm._unpack_keys(lm._pack_keys(keys[a:b])), keys[a:b]) for p, a, b in lm._parts(keys, 8)]
    for p, low, whole in parts:
        assert ((np.uint64(p) << np.uint64(56)) | low == whole).all()
    counts = rng.integers(0, 2**40, 77)
    assert (lm._from_planes(lm._planes(counts)) == counts).all()
