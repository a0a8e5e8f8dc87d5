"""Chunked running values against plain loops, with chunks far smaller than the groups."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from obsframe.operators import ordered, overlay
from obsframe.operators.ordered import Running, position_chunks, prefix_number, range_chunks, row_chunks, running, top_k


def rows(seed=1):
    rng = random.Random(seed)
    out = []
    for key, n in (("hot", 300), ("small", 5), ("one", 1)):
        for i in range(n):
            out.append((key, i * rng.choice((1, 1, 3)) + i * 3, rng.choice([None, rng.randrange(-9, 9)]), f"{rng.randrange(10**6):06d}"))
    return [r for r in {(r[0], r[1]): r for r in out}.values()]


def expected(data, order):
    want = {}
    for key in {r[0] for r in data}:
        total, hi, last, before = 0, None, None, 0
        for r in sorted((r for r in data if r[0] == key), key=order):
            before = total
            previous = last
            if r[2] is not None:
                total += r[2]
                hi = r[2] if hi is None else max(hi, r[2])
                last = r[2]
            want[(r[0], r[1])] = (total, before, hi, previous)
    return want




def outputs():
    return {
        "total": Running("sum", F.col("v")),
        "before": Running("sum", F.col("v"), before=True),
        "hi": Running("max", F.col("v")),
        "previous": Running("last", F.col("v"), before=True),
    }


def test_position_chunks(spark):
    data = rows()
    df = spark.createDataFrame(data, "k string, pos long, v long, tag string")
    got = running(df, ["k"], ["pos"], outputs(), position_chunks("pos", 16)).collect()
    assert {(r.k, r.pos): (r.total, r.before, r.hi, r.previous) for r in got} == expected(data, lambda r: r[1])
    assert len(got) == len(data)


def test_range_chunks(spark):
    data = rows(2)
    df = spark.createDataFrame(data, "k string, pos long, v long, tag string").withColumn("bucket", F.col("pos") % 3)
    chunked = range_chunks(df, ["k"], ["bucket", "tag", "pos"])
    assert chunked.filter("k = 'hot'").select("_chunk").distinct().count() > 1
    got = running(chunked, ["k"], ["bucket", "tag", "pos"], outputs()).collect()
    want = expected(data, lambda r: (r[1] % 3, r[3], r[1]))
    assert {(r.k, r.pos): (r.total, r.before, r.hi, r.previous) for r in got} == want


def sparse(seed, n=600):
    """Positions far apart, in clusters, and one group that holds nearly all rows."""
    rng = random.Random(seed)
    out = {}
    for _ in range(n):
        key = rng.choices(["hot", "cold", None], [20, 2, 1])[0]
        at = rng.choice([rng.randrange(10**12), 5 * 10**11 + rng.randrange(900), -rng.randrange(10**9)])
        out[(key, at)] = (key, at, rng.choice([None, rng.randrange(-9, 9)]), f"{at:06d}")
    return list(out.values())


def test_row_chunks_follow_the_rows(spark):
    data, width = sparse(5), 16
    df = spark.createDataFrame(data, "k string, pos long, v long, tag string")
    chunked = row_chunks(df, ["k"], F.col("pos"), width=width)
    assert chunked.groupBy("k", "_chunk").count().count() <= 2 * (len(data) / width + 3)
    got = running(chunked, ["k"], ["pos"], outputs()).collect()
    assert {(r.k, r.pos): (r.total, r.before, r.hi, r.previous) for r in got if r.k} == {
        k: v for k, v in expected(data, lambda r: r[1]).items() if k[0]
    }
    assert len(got) == len(data)


def test_even_positions_give_no_more_chunks_than_rows_allow(spark):
    df = spark.range(0, 10**12, 10**9).select(F.lit("k").alias("k"), F.col("id").alias("pos"))
    chunks = row_chunks(df, ["k"], F.col("pos"), width=100).groupBy("_chunk").count().collect()
    assert len(chunks) <= 1000 / 100 + 1 and max(r["count"] for r in chunks) <= 101


def test_ties_are_cut_by_the_second_position(spark):
    names = sorted(f"{i * 7919 % 1000:03d}é" for i in range(1000))
    df = spark.createDataFrame([(1, n) for n in names], "at long, name string")
    chunked = row_chunks(df.withColumn("k", F.lit("k")), ["k"], F.col("at"), prefix_number("name"), width=50)
    rows = chunked.orderBy("name").collect()
    assert [r.name for r in rows] == names and len({r._chunk for r in rows}) > 3
    assert [r._chunk for r in rows] == sorted(r._chunk for r in rows)


def test_summary_rows_are_scanned_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(ordered, "_SCAN_BITS", 2)
    data = rows(4)
    df = spark.createDataFrame(data, "k string, pos long, v long, tag string")
    got = running(df, ["k"], ["pos"], outputs(), position_chunks("pos", 4)).collect()
    assert {(r.k, r.pos): (r.total, r.before, r.hi, r.previous) for r in got} == expected(data, lambda r: r[1])


def test_no_job_while_the_plan_is_built(spark):
    df = spark.createDataFrame(sparse(6, 40), "k string, pos long, v long, tag string")
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("plan", "plan")
    try:
        running(row_chunks(df, ["k"], F.col("pos")), ["k"], ["pos"], outputs())
        assert list(tracker.getJobIdsForGroup("plan")) == []
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_debounce_carries_open_batches_over_chunks(spark, monkeypatch):
    """One project holds all rows; batches run over many chunks and start at their edges."""
    monkeypatch.setattr(overlay, "row_chunks", lambda df, keys, *at: row_chunks(df, keys, *at, width=4))
    rng = random.Random(8)
    at, times = 0, []
    for _ in range(200):
        at += rng.choice([0, 1, 2, 2, 5, 5, 9])
        times.append(at)
    start = datetime(2024, 1, 1)
    df = spark.createDataFrame([("p", start + timedelta(seconds=t)) for t in times] + [("p", None), ("q", start)], "project_id string, ts timestamp")
    want, last = [], None
    for t in times:
        if last is None or t - last >= 5:
            want.append([t, t, 0])
        want[-1][1:] = [t, want[-1][2] + 1]
        last = t
    expected_rows = {(("p"), start + timedelta(seconds=a), start + timedelta(seconds=b + 5), n) for a, b, n in want}
    expected_rows.add(("q", start, start + timedelta(seconds=5), 1))
    assert {tuple(r) for r in overlay.debounce(df, "5 seconds").collect()} == expected_rows


def test_top_k_cuts_before_the_shuffle(spark):
    df = spark.createDataFrame(rows(3), "k string, pos long, v long, tag string")
    top = top_k(df, ["k"], [F.col("pos").desc()], 3)
    plan = top._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2
    assert top.filter("k = 'hot'").count() == 3
