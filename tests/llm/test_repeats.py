from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from obsframe.llm import queries, repeats
from obsframe.llm.columns import repeated_starts
from obsframe.llm.repeats import RepeatParams


def brute(texts: list[bytes], length: int) -> list[list[tuple[int, int]]]:
    seen = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        runs, at = [], 0
        while (at := gone.find(b"\1", at)) >= 0:
            end = gone.find(b"\0", at)
            end = len(t) if end < 0 else end
            runs.append((at, end))
            at = end
        out.append(runs)
    return out


def found(spark, texts: list[str | None], p: RepeatParams):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r.doc_id: ([(x.start, x.end) for x in r.removed], bytes(r.kept)) for r in repeats.without_repeats(docs, p).collect()}


def check(spark, texts, p):
    data = [(t or "").encode() for t in texts]
    got = found(spark, texts, p)
    assert len(got) == len(texts)
    for i, (runs, t) in enumerate(zip(brute(data, p.length), data, strict=True)):
        assert got[i][0] == runs, i
        ends = [0, *[b for _, b in runs]]
        assert got[i][1] == b"".join(t[a:b] for a, b in zip(ends, [*[a for a, _ in runs], len(t)], strict=True))
    return got


def noise(rng, n, letters="abcdefghijklmnopqrstuvwxyz é"):
    return "".join(rng.choices(letters, k=n))


def corpus(rng, length):
    """Passages of about ``length`` at random places, near copies, runs of one letter, periods, exact copies."""
    passages = [noise(rng, length + d) for d in (-3, -2, -1, 0, 1, 2, 7, length)]
    texts = [noise(rng, rng.randint(0, 30)) + "".join(rng.choice(passages) + noise(rng, rng.choice([0, 1, 2, 40])) for _ in range(rng.randint(0, 3))) for _ in range(60)]
    near = noise(rng, 6 * length)
    for _ in range(8):
        cut = rng.randint(0, len(near) - 1)
        texts.append(near[:cut] + rng.choice(["", "x", "yy"]) + near[cut + rng.randint(0, 2) :])
    texts += ["a" * (length + d) for d in (-1, 0, 1, 40)] + ["ab" * length, "abc" * length, "", None, " ", noise(rng, 5 * length)]
    return texts + [texts[-1], texts[0], texts[3], "ab" * length]


@pytest.mark.parametrize("seed", range(3))
def test_like_brute_force(spark, seed):
    rng = random.Random(seed)
    for p in (RepeatParams(length=40), RepeatParams(length=33, gram=16, batch_rows=2), RepeatParams(length=40, gram=19, group_rows=2)):
        got = check(spark, corpus(rng, p.length), p)
        assert any(runs for runs, _ in got.values())


def test_hot_passages_with_edges(spark):
    """A passage that all texts share, just too short, exact and too long, so that one core has many stretches."""
    rng = random.Random(9)
    for size in (399, 400, 401, 700):
        passage = noise(rng, size)
        texts = [noise(rng, 200) + passage + noise(rng, 200) for _ in range(60)]
        for p in (RepeatParams(), RepeatParams(group_rows=5), RepeatParams(batch_rows=8)):
            got = check(spark, texts, p)
            if size >= 400:
                assert all(runs for runs, _ in got.values())


def test_long_texts_are_cut_into_parts_without_loss(spark, monkeypatch):
    monkeypatch.setattr(repeats, "_CHUNK_BITS", 9)
    rng = np.random.default_rng(3)
    data = bytes(rng.integers(97, 105, 5000, np.uint8))
    texts = [data[:1700] + data[300:1200], data[1000:4000], b"q" * 700 + data[4000:], data[:90], data[2000:2600]]
    p = RepeatParams(length=64)
    offsets = np.cumsum([0, *map(len, texts)])
    starts = set()
    for text, anchor, low, high, left in repeats._cells(np.frombuffer(b"".join(texts), np.uint8), offsets, p):
        for t, a, x, y in zip(text, anchor, low, high, strict=True):
            assert offsets[t] <= x <= y and y + p.length <= offsets[t + 1] and y <= a <= x + p.length - p.gram
            starts |= set(range(x, y + 1))
    assert len(starts) == sum(max(0, len(t) - p.length + 1) for t in texts)


def test_anchor_depends_on_the_window_alone():
    rng = np.random.default_rng(5)
    p = RepeatParams(length=50)
    window = rng.integers(97, 100, 50, np.uint8)
    places = set()
    for _ in range(20):
        left, right = rng.integers(97, 100, rng.integers(0, 200), np.uint8), rng.integers(97, 100, 80, np.uint8)
        data = np.concatenate([left, window, right])
        places.add(int(repeats._anchors(data, p)[len(left)]) - len(left))
    assert len(places) == 1


def test_columns_like_brute_force():
    rng = random.Random(1)
    for _ in range(30):
        texts, starts, groups = [], [], []
        for g in range(rng.randint(1, 4)):
            base = "".join(rng.choices("ab", k=60))
            for _ in range(rng.randint(1, 9)):
                a, b = rng.randint(0, 25), rng.randint(35, 60)
                t = list(base[a:b])
                for _ in range(rng.randint(0, 2)):
                    t[rng.randrange(len(t))] = rng.choice("abc")
                texts.append("".join(t).encode())
                starts.append(a - 30)
                groups.append(g)
        got = repeated_starts(texts, np.array(starts), np.array(groups), 10)
        seen = Counter((g, s + i, t[i : i + 10]) for t, s, g in zip(texts, starts, groups, strict=True) for i in range(len(t) - 9))
        for t, s, g, x in zip(texts, starts, groups, got, strict=True):
            assert x.tolist() == [s + i for i in range(len(t) - 9) if seen[g, s + i, t[i : i + 10]] > 1]


def test_empty_table_clashing_columns_and_nulls(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert repeats.without_repeats(empty).collect() == []
    rows = [(None, None, "x", 1, "d"), (1, "z" * 500, "y", 2, "e"), (1, "z" * 500, "y", 2, "e")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kept string, `a.b` int, doc string")
    out = repeats.without_repeats(docs)
    assert out.columns == ["doc_id", "text", "a.b", "doc", "removed", "kept"]
    assert sorted((len(r.removed), len(r.kept)) for r in out.collect()) == [(0, 0), (1, 0), (1, 0)]


def test_query_like_brute_force(spark, tmp_path):
    rng = random.Random(4)
    passage = noise(rng, 450)
    texts = [noise(rng, 300) + (passage if i % 3 == 0 else "") + noise(rng, 300) for i in range(12)] + [None, "", passage, "A"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    data = [(t or "").encode() for t in texts]
    expected = []
    for i, (t, runs) in enumerate(zip(data, brute(data, 400), strict=True)):
        ends = [0, *[b for _, b in runs]]
        kept = b"".join(t[a:b] for a, b in zip(ends, [*[a for a, _ in runs], len(t)], strict=True))
        expected.append((i, len(t), len(t) - len(kept), len(runs), hashlib.sha256(kept).hexdigest()))
    out = queries.op13_repeats(spark, str(tmp_path))
    assert [tuple(r) for r in out.orderBy(F.col("doc_id")).collect()] == expected
    assert dict(out.dtypes) == {"doc_id": "bigint", "n_bytes": "bigint", "n_removed": "bigint", "n_spans": "bigint", "kept_sha256": "string"}


def test_cells_of_a_frequent_core_are_dealt_out(spark, monkeypatch):
    """A run of one period has a cell for each period, all with one core; they must not meet in one task."""
    rng = random.Random(6)
    texts = [noise(rng, 50) + "ab" * 1500 + noise(rng, 50) for _ in range(6)]
    shares = []

    def kept_folder(session, folder):
        cells = session.read.parquet(f"{folder}/cells").groupBy("core", F.input_file_name().alias("file")).count().collect()
        whole = Counter()
        for r in cells:
            whole[r["core"]] += r["count"]
        core, n = whole.most_common(1)[0]
        shares.append((n, max(r["count"] for r in cells if r["core"] == core) / n))

    monkeypatch.setattr(repeats, "discard", kept_folder)
    names = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")
    before = {k: spark.conf.get(k) for k in names}
    try:
        spark.conf.set(names[0], "-1")
        spark.conf.set(names[1], "false")
        check(spark, texts, RepeatParams(group_rows=64))
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert shares[0][0] > 1000 and shares[0][1] < 0.8
