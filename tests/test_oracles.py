"""A few registered queries against their SQL at the smallest scale; ``check_oracles.py`` runs them all."""

from __future__ import annotations

import os

import pytest

import __spark_entry__ as entry
from tests.check_oracles import compare, duck
from workload import registry

SF_DIR = "/root/testdata/sf0.001"
LIGHT = ("redact", "dedup_content", "turns", "gc_candidates", "apply_ignore_rules", "diff_overlay", "latest_per_path")


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test data")
@pytest.mark.parametrize("name", LIGHT)
def test_query_equals_sql(spark, name):
    n, _, verdict = compare(spark, duck(SF_DIR), SF_DIR, entry.queries()[name], entry.oracle_sql()[name])
    assert n > 0 and verdict.startswith("ok"), verdict


def test_registry_is_consistent():
    queries, oracles = entry.queries(), entry.oracle_sql()
    assert set(oracles) <= set(queries)
    own = registry.queries()
    assert set(own) <= set(queries)
    assert set(own) - set(registry.oracle_sql()) == {"read_corpus", "rebuild", "code_segments"}
