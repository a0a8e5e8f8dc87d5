"""Queries over whole passages and whole lines, and what the first words alone would miss."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from obsframe.operators import search as se
from tests.check_oracles import compare, duck
from workload import tables as t

SF_DIR = "/root/testdata/sf0.001"
WHOLE = ("expand_terms_passages", "search_corpus_passages", "declarations_words", "java_members_words", "text_functions")


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test data")
@pytest.mark.parametrize("name", WHOLE)
def test_whole_query_equals_sql(spark, name):
    n, _, verdict = compare(spark, duck(SF_DIR), SF_DIR, entry.queries()[name], entry.oracle_sql()[name])
    assert n > 0 and verdict.startswith("ok"), verdict


def test_passages_are_asked_whole(spark, tmp_path):
    text = "one two three  four\nfive " + "six " * 300
    spark.createDataFrame([(1, text)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    asked = t.passages(spark, str(tmp_path))
    assert asked.first()["query"] == text
    terms = {r.q_term for r in se.split_queries(asked).collect()}
    assert terms == {"one", "two", "three", "four", "five", "six"}


def test_read_corpus_hashes_contents(spark, tmp_path):
    for name in ("region", "other"):
        spark.range(3).withColumn("s", F.lit(name)).write.parquet(str(tmp_path / f"{name}.parquet"))
    import hashlib

    rows = entry.queries()["read_corpus"](spark, str(tmp_path)).collect()
    assert any(r.path.endswith(".parquet") for r in rows)
    for r in rows:
        assert r.content_hash == hashlib.sha256((tmp_path / r.path).read_bytes()).hexdigest()
