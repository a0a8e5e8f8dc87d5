"""Line field against enumeration, quality on given labels, archives by round trip, and the pipeline's stages."""

from __future__ import annotations

import hashlib
import itertools
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from obsframe.llm import quality, warc

SF_DIR = "/root/testdata/sf0.01"


# --- quality


def enumerate_marginals(u, t):
    n = len(u)
    total, good, pairs = 0.0, np.zeros(n), np.zeros((2, 2))
    for y in itertools.product((0, 1), repeat=n):
        s = np.exp(sum(u[i] * y[i] for i in range(n)) + sum(t[y[i], y[i + 1]] for i in range(n - 1)))
        total += s
        good += s * np.array(y)
        for i in range(n - 1):
            pairs[y[i], y[i + 1]] += s
    return good / total, pairs / total


def test_forward_backward_equals_enumeration():
    rng = np.random.default_rng(0)
    lengths = np.array([1, 2, 5, 3, 8, 1, 4])
    u, t = rng.normal(size=lengths.sum()) * 2, rng.normal(size=(2, 2))
    got, counts = quality.marginals(u, lengths, t, pairs=True)
    at, expected, pairs = 0, [], np.zeros((2, 2))
    for n in lengths:
        g, c = enumerate_marginals(u[at : at + n], t)
        expected.append(g)
        pairs += c
        at += n
    assert np.allclose(got, np.concatenate(expected))
    assert np.allclose(counts, pairs)


def test_marginals_of_extreme_scores_are_finite():
    got = quality.marginals(np.array([900.0, -900.0, 900.0] * 200), np.array([600]), np.array([[5.0, -5.0], [-5.0, 5.0]]))
    assert np.isfinite(got).all() and got.min() >= 0 and got.max() <= 1


GOOD = "The river ran down to the old mill.\nNobody had worked there for years, and the wheel was still."
BAD = "BUY!!! NOW!!! $$$ $$$ $$$\n### ### *** ***"


def labelled(spark, n=80):
    docs = [(i, (GOOD if i % 2 else BAD) + f"\nline {i}", 0.1, "mine") for i in range(n)]
    docs += [(1000, None, 0.0, ""), (1001, "", 0.0, ""), (1002, "word " * 40_000, 0.0, ""), (None, GOOD, 0.0, ""), (1, GOOD, 0.0, "")]
    labels = [(i, i % 2, 0) for i in range(n)] + [(None, 1, 0), (3, 1, 0), (4, None, 0), (5, 9, 1)]
    return (
        spark.createDataFrame(docs, "doc_id long, text string, score double, quality string"),
        spark.createDataFrame(labels, "doc_id long, quality int, toxic int"),
    )


def test_quality_learns_and_scores_every_row(spark):
    docs, labels = labelled(spark)
    model = quality.train(docs, labels, quality.QualityParams(rounds=60))
    rows = quality.score(docs, model).collect()
    assert len(rows) == docs.count()
    assert rows[0].asDict().keys() == {"doc_id", "text", "quality", "score"}
    for r in rows:
        assert 0 <= r.score <= 1
        if r.doc_id is not None and r.doc_id < 80:
            assert (r.score >= 0.5) == (r.text.startswith("The")), r
    assert {r.quality for r in rows} == {"mine", ""}


def test_quality_without_labels(spark):
    docs, labels = labelled(spark, 4)
    assert quality.train(docs, labels.limit(0)) is None
    assert quality.train(docs.limit(0), labels) is None
    assert {r.score for r in quality.score(docs, None).collect()} == {0.5}
    assert quality.score(docs.limit(0), None).collect() == []


def test_long_documents_are_learned_whole_or_left_out(spark):
    head = "\n".join(f"The mill stood by river number {i} and was quiet." for i in range(250))
    labels = spark.createDataFrame([(i, 1 - i % 2, 0) for i in range(12)], "doc_id long, quality int, toxic int")

    def model(tail):
        docs = spark.createDataFrame([(i, head + tail * (i % 2)) for i in range(12)], "doc_id long, text string")
        return quality.train(docs, labels, quality.QualityParams(rounds=5))

    assert not np.allclose(model("")["w"], model(("\n" + BAD) * 60)["w"])  # the texts differ after line 200 alone
    assert quality._fitting([(1, 5), (2, 9), (3, 4)], 10) == ([1, 3], [2])


def test_held_out_rows_are_not_learned_from(spark):
    import zlib

    docs, labels = labelled(spark)
    turned = labels.withColumn("quality", F.when(quality.held_out(), 1 - F.col("quality")).otherwise(F.col("quality")))
    p = quality.QualityParams(rounds=5)
    a, b = quality.train(docs, labels, p), quality.train(docs, turned, p)
    assert np.array_equal(a["w"], b["w"]) and a["shift"] == b["shift"]
    got = {r.doc_id: r.h for r in docs.select("doc_id", quality.held_out().alias("h")).collect() if r.doc_id is not None}
    assert got == {i: zlib.crc32(str(i).encode()) % 3 == 1 for i in got}


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test data")
def test_held_out_accuracy(spark):
    from obsframe.llm.queries import op8_quality

    labels = spark.read.parquet(f"{SF_DIR}/labels.parquet").select("doc_id", "quality")
    rows = op8_quality(spark, SF_DIR).filter("held_out").join(labels, "doc_id").collect()
    assert sum(r.predicted == r.quality for r in rows) >= 0.97 * len(rows)


# --- archives

LONG = "<p>" + "x" * 200 + "</p>"
PAGES = [
    (5, "http://a.example/5", LONG, "mine"),
    (3, "http://a.example/3", LONG, ""),
    (9, "http://a.example/9\r\nX: y", LONG, ""),
    (4, None, "short", ""),
    (2, "http://b.example/é ü", "short", ""),
    (7, "u", None, ""),
    (8, "u", "", ""),
    (10, "u", "WARC/1.1\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n" * 20 + "\r\n\r\n", ""),
    (11, "u", "𝄞é\r\n\r\n" * 40_000, ""),
    (12, "u", "𝄞é\r\n\r\n" * 40_000, ""),
    (None, "u", LONG, ""),
    (3, "http://a.example/3", LONG, ""),
    (13, "u", "y" * 99, ""),
    (14, "u", "y" * 99, ""),
    (15, "u", "z" * 100, ""),
    (16, "u", "z" * 100, ""),
]
PAGE_SCHEMA = "page_id long, url string, html string, digest string"


def expected_pages(pages, least=100):
    first: dict = {}
    for page, _, html, *_ in pages:
        data = (html or "").encode()
        if len(data) >= least and page is not None:
            d = hashlib.sha256(data).hexdigest()
            first[d] = min(first.get(d, page), page)
    out = []
    for page, _, html, *_ in pages:
        data = (html or "").encode()
        d = hashlib.sha256(data).hexdigest()
        to = first.get(d) if len(data) >= least else None
        revisit = to is not None and to != page
        out.append((page, len(data), d, "revisit" if revisit else "response", to if revisit else None))
    return sorted(out, key=str)


def test_archive_round_trip(spark, tmp_path):
    path = str(tmp_path / "w")
    warc.write_archives(spark.createDataFrame(PAGES, PAGE_SCHEMA), path, file_bytes=100_000)
    read = warc.read_archives(spark, path, with_payload=True)
    got = sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.resolved(read).collect()), key=str)
    assert got == expected_pages(PAGES)
    texts = {p[0]: (p[2] or "").encode() for p in PAGES}
    for r in read.collect():
        if r.record_type == "response":
            assert bytes(r.payload) == texts[r.page_id] and r.block_digest == r.digest
        else:
            assert r.payload is None and r.block_payload_bytes == 0
        assert "\r" not in r.url and "\n" not in r.url


def test_archive_of_no_pages(spark, tmp_path):
    path = str(tmp_path / "w")
    warc.write_archives(spark.createDataFrame([], PAGE_SCHEMA), path)
    assert warc.resolved(warc.read_archives(spark, path)).collect() == []


def test_parse_rejects_damage():
    record = b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    assert [bytes(b) for _, b in warc.parse(record * 2)] == [b"abc", b"abc"]
    with pytest.raises(ValueError, match="no record"):
        list(warc.parse(b"x" + record))
    with pytest.raises(ValueError, match="cut off"):
        list(warc.parse(record[:-6]))


# --- the pipeline


def pipeline_docs(spark):
    docs, labels = labelled(spark)
    extra = [(2000 + i, GOOD.replace("river", f"river{i} x{i} y{i}") * 3 + f" mail me{i}@x.example now", "en", f"s{i % 3}", None) for i in range(6)]
    extra += [(3000, extra[0][1], "en", "s0", 1), (3001, None, None, None, None)]
    full = docs.select("doc_id", "text", F.lit("en").alias("lang"), F.lit("s0").alias("source"), F.length("text").cast("long").alias("n_chars"))
    return full.union(spark.createDataFrame(extra, "doc_id long, text string, lang string, source string, n_chars long")), labels


def test_stages_keep_columns_and_take_effect(spark, tmp_path):
    docs, labels = pipeline_docs(spark)
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    clash = docs.withColumn("quality_score", F.lit("mine")).withColumn("pii_spans", F.lit(1)).withColumn("_id", F.lit(2)).withColumn("copy", F.lit(3))
    good = corpus_pipeline.select_quality(spark, clash, str(tmp_path))
    assert good.columns == clash.columns
    kept = {r.doc_id for r in good.collect()}
    assert {2000, 2005, 3000} <= kept and not any(i in kept for i in range(0, 80, 2))
    unique = corpus_pipeline.drop_near_duplicates(spark, good, str(tmp_path))
    assert unique.columns == clash.columns
    ids = [r.doc_id for r in unique.collect()]
    assert 2000 in ids and 3000 not in ids
    clean = corpus_pipeline.redact_pii(spark, unique, str(tmp_path))
    assert clean.columns == clash.columns and clean.dtypes == clash.dtypes
    for r in clean.collect():
        if r.doc_id is not None and 2000 <= r.doc_id < 2006:
            assert "[EMAIL]" in r.text and "@" not in r.text and r.n_chars == len(r.text)
    mixed = corpus_pipeline.mix_sources(spark, clean, str(tmp_path))
    assert mixed.columns == clash.columns
    packed = corpus_pipeline.pack_batches(spark, mixed, str(tmp_path))
    assert packed.count() == mixed.count()


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test data")
def test_run_equals_its_stages(spark, tmp_path):
    sf_dir = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf_dir).write.parquet(str(tmp_path / str(i)))
        docs = spark.read.parquet(str(tmp_path / str(i)))
    key = lambda df: sorted(map(str, df.collect()))
    assert key(corpus_pipeline.run(spark, sf_dir)) == key(docs)


def test_empty_documents(spark, tmp_path):
    docs, labels = pipeline_docs(spark)
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    docs.limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
