"""Admission, ranking and workspace state on small literal inputs."""

from __future__ import annotations

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from obsframe.operators import admission as ad
from obsframe.operators import overlay as ov
from obsframe.operators import search as se
from obsframe.plans import corpus as plans
from obsframe.plans import workspace as ws


def paths(spark, names):
    return spark.createDataFrame([("p", n) for n in names], "project_id string, path string")


def kept(df):
    return sorted(r.path for r in df.collect())


RULE_CASES = [
    # The last rule that matches decides, also below an ignored folder.
    (["logs", "!logs/audit.txt"], ["logs/audit.txt", "main.py"], ["main.py"]),
    (["*.o", "!main.o", "lib/main.o"], ["main.o", "util.o", "lib/main.o", "lib/a.c"], ["lib/a.c", "main.o"]),
    (["/top", "end/"], ["top/a", "sub/top/a", "end", "sub/end/x"], ["end", "sub/top/a"]),
    (["", "  ", "# words", "!", "/"], ["a", "# words"], ["# words", "a"]),
    (["docs/**/draft-?.md"], ["docs/draft-1.md", "docs/x/y/draft-2.md", "docs/draft-10.md"], ["docs/draft-10.md"]),
    (["a+b(c).{d}"], ["a+b(c).{d}", "aab(c).d"], ["aab(c).d"]),
]


@pytest.mark.parametrize("rules,names,expected", RULE_CASES)
def test_ignore_rules(spark, rules, names, expected):
    assert kept(ad.apply_ignore_rules(paths(spark, names), rules)) == expected
    table = spark.createDataFrame([("p", i, r) for i, r in enumerate(rules)], "project_id string, rule_idx int, pattern string")
    assert kept(ad.apply_ignore_rules(paths(spark, names), table)) == expected


def test_many_rules_in_one_project(spark):
    """A hundred thousand rules: each path meets those that begin where it lies, and the last match still decides."""
    rules = spark.range(100_000).select(
        F.lit("p").alias("project_id"),
        F.col("id").alias("rule_idx"),
        F.expr(
            "CASE id % 5 WHEN 0 THEN concat('/lib/mod', id, '/*.bak') WHEN 1 THEN concat('name', id) WHEN 2 THEN concat('!/lib/mod', id - 2, '/keep.bak') "
            "WHEN 3 THEN concat('deep/tree', id, '/**/tmp/') ELSE '# none' END"
        ).alias("pattern"),
    ).unionByName(spark.createDataFrame([("p", 200_000, "*.log"), ("p", 200_001, "!z*.log"), ("q", 1, "a")], "project_id string, rule_idx long, pattern string"))
    names = ["lib/mod5/a.bak", "lib/mod5/keep.bak", "lib/mod5/x/a.bak", "lib/mod6/a.bak", "x/name6/y", "x/name7", "deep/tree8/a/b/tmp/f", "deep/tree8/tmp",
             "deep/tree9/tmp/f", "a/b.log", "a/z.log", "a"]
    got = kept(ad.apply_ignore_rules(paths(spark, [*names, "lib/mod5/keep.bak"]), rules))
    assert got == ["a", "a/z.log", "deep/tree8/tmp", "deep/tree9/tmp/f", "lib/mod5/keep.bak", "lib/mod5/keep.bak", "lib/mod5/x/a.bak", "lib/mod6/a.bak", "x/name7"]


def test_rule_tables_like_rule_lists(spark, monkeypatch):
    monkeypatch.setattr(ad, "RULES_PER_ROW", 2)
    rng = random.Random(6)
    parts = ["a", "b", "ab", "b.c", "x"]
    names = sorted({"/".join(rng.choices(parts, k=rng.randint(1, 4))) for _ in range(60)})
    for _ in range(4):
        rules = []
        for _ in range(9):
            body = "/".join(rng.choices([*parts, "*", "**", "a*", "?"], k=rng.randint(1, 3)))
            rules.append(rng.choice(["", "", "!", "/", "!/"]) + body + rng.choice(["", "", "/"]))
        table = spark.createDataFrame([("p", i, r) for i, r in enumerate(rules)], "project_id string, rule_idx int, pattern string")
        assert kept(ad.apply_ignore_rules(paths(spark, names), table)) == kept(ad.apply_ignore_rules(paths(spark, names), rules)), rules


def test_segments_and_precedence(spark):
    names = [f"packages/{s}/output.py" for s in ("__pycache__", ".tox", "venv", "_build")]
    names += ["tools/rebuild_all.py", "tools/xvenv/run.py", "tools/_builds.md", "generated/v.ts"]
    out = ad.admit(paths(spark, names), ["!generated/v.ts", "!packages/venv/output.py"], ["generated/**"])
    assert kept(out) == ["tools/_builds.md", "tools/rebuild_all.py", "tools/xvenv/run.py"]


def test_globs(spark):
    names = ["a/b/c.ts", "c.ts", "x/c.ts", "gen/a", "gen", "deep/gen/a"]
    assert kept(ad.exclude_globs(paths(spark, names), ["./c.ts"])) == ["deep/gen/a", "gen", "gen/a"]
    assert kept(ad.exclude_globs(paths(spark, names), ["gen/"])) == ["a/b/c.ts", "c.ts", "deep/gen/a", "gen", "x/c.ts"]
    assert kept(ad.exclude_globs(paths(spark, names), ["/c.ts", "a/*/c.ts"])) == ["deep/gen/a", "gen", "gen/a", "x/c.ts"]


def test_outcomes(spark):
    rows = [
        ("ignored", False, True, True, b"x", None, None),
        ("missing", True, False, True, None, None, None),
        ("read-error", True, True, False, None, None, "stat"),
        ("non-regular", True, True, False, b"x", None, None),
        ("read-error", True, True, True, None, "denied", None),
        ("non-text", True, True, True, b"a\0b", None, None),
        ("indexed", True, True, True, b"x" * 8192 + b"\0", None, None),
    ]
    df = spark.createDataFrame(
        [(*r[:4], bytearray(r[4]) if r[4] else None, *r[5:]) for r in rows],
        "want string, admitted boolean, present boolean, is_regular boolean, content binary, read_error string, stat_error string",
    )
    assert [(r.want, r.outcome) for r in ad.classify_outcome(df).collect() if r.want != r.outcome] == []


def raw(spark, sources, project="p"):
    return spark.createDataFrame(
        [(project, p, bytearray(t.encode())) for p, t in sources.items()], "project_id string, path string, content binary"
    )


def first_paths(spark, sources, queries, limit=5):
    index = plans.build_index(plans.index_files(raw(spark, sources), stage=True)["files"])
    asked = spark.createDataFrame([("p", q, q) for q in queries], "project_id string, query_id string, query string")
    rows = plans.search_corpus(index, asked, limit).orderBy("query_id", "rank").collect()
    return {q: [r for r in rows if r.query_id == q] for q in queries}


def test_rare_words_and_symbols_rank_first(spark):
    """A declared name outranks the same word in prose; a word that every file has decides nothing."""
    sources = {f"notes/day{i}.txt": f"common walrus diary entry number {i}" for i in range(12)}
    sources["zoo/walrus_pool.ts"] = "export function feedWalrus(kilos: number): void { void kilos; }"
    sources["zoo/Otter.java"] = "package zoo; class Otter { int pebbles() { return 3; } }"
    rows = first_paths(spark, sources, ["feed walrus", "otter pebbles common", "absent-word"], 50)
    assert rows["feed walrus"][0].path == "zoo/walrus_pool.ts"
    assert "feedWalrus" in rows["feed walrus"][0].matched_symbols
    assert len(rows["feed walrus"]) == 13
    assert rows["otter pebbles common"][0].path == "zoo/Otter.java"
    assert rows["absent-word"] == []


def test_more_than_twenty_results(spark):
    sources = {f"n/{i}.txt": f"shared token{i}" for i in range(30)}
    assert len(first_paths(spark, sources, ["shared"], 25)["shared"]) == 25


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def test_fuzzy_finds_every_near_term(spark):
    rng = random.Random(9)
    words = {"".join(rng.choice("abc") for _ in range(rng.randrange(1, 22))) for _ in range(250)}
    for w in list(words)[:120]:
        for _ in range(2):
            i = rng.randrange(len(w) + 1)
            words.add(rng.choice((w[:i] + w[i + 1 :], w[:i] + "b" + w[i:], w[:i] + "c" + w[i + 1 :])) or "a")
    words = sorted(words)
    words += ["abc" * 16 + "bbbbbbb", "c" * 7 + "abc" * 16, "abc" * 16 + "b" * 8]
    terms = rng.sample(words, 80) + ["abcabcabcabcabcabcabcabcabcabcabcabcabcabcabcabc"]
    voc = spark.createDataFrame([(w,) for w in words], "term string")
    asked = spark.createDataFrame([(t,) for t in sorted(set(terms))], "q_term string")
    got = {(r.q_term, r.term) for r in se.fuzzy_matches(asked, voc).collect()}
    allowed = {t: (15 * len(t) + 50) // 100 for t in terms}
    want = {(t, w) for t in terms for w in words if t != w and allowed[t] and edits(t, w) <= allowed[t]}
    assert got == want
    prefixed = {(r.q_term, r.term) for r in se.exact_and_prefix(asked, voc).collect()}
    assert prefixed == {(t, w) for t in terms for w in words if w.startswith(t)}


# --- workspace ---------------------------------------------------------------------------------------


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_revision_is_order_free(spark):
    head = spark.createDataFrame([("p", "h1"), ("clean", "h2")], "project_id string, head string")
    rows = [("p", f"f{i}", sha(str(i))) for i in range(9000)]
    buckets: dict = {}
    for _, p, h in sorted(rows, key=lambda r: r[1]):
        buckets.setdefault(hashlib.md5(p.encode()).hexdigest()[:3], []).append(f"{p}\0{h}")
    want = sha("\0".join(["h1", *[f"{b}\0{sha(chr(0).join(e))}" for b, e in sorted(buckets.items())]]))
    for seed in (1, 2):
        random.Random(seed).shuffle(rows)
        dirty = spark.createDataFrame(rows, "project_id string, path string, content_hash string")
        got = {r.project_id: r.workspace_revision for r in ov.workspace_revision(head, dirty).collect()}
        assert got == {"p": want, "clean": sha("h2")}


def state(spark, base, now, previous_dirty=None):
    """``now`` maps a path to text, or to an outcome name."""
    files = spark.createDataFrame(
        [
            ("p", p, bytearray(b"\0bin") if t == "non-text" else bytearray(t.encode()), t != "missing", t != "non-regular", "boom" if t == "read-error" else None)
            for p, t in now.items()
        ],
        "project_id string, path string, content binary, present boolean, is_regular boolean, read_error string",
    )
    before = plans.index_files(raw(spark, base), stage=True)["files"]
    heads = spark.createDataFrame([("p", "h")], "project_id string, head string")
    return ws.stage(ws.overlay(before, plans.index_files(files, stage=True), heads, previous_dirty=previous_dirty))


def facts(w):
    return (
        {r.path: r.content_hash for r in w.dirty.collect()},
        sorted(r.path for r in w.files.collect()),
        w.freshness.first().freshness,
    )


def test_overlay_kinds(spark):
    base = {"same.txt": "s", "edit.txt": "old", "gone.txt": "g", "bin.txt": "t", "dir.txt": "d"}
    now = {"same.txt": "s", "edit.txt": "new", "bin.txt": "non-text", "dir.txt": "non-regular", "add.txt": "a", "newbin": "non-text"}
    dirty, files, fresh = facts(state(spark, base, now))
    assert dirty == {
        "edit.txt": sha("new"), "gone.txt": "deleted", "bin.txt": sha("\0bin"), "dir.txt": sha("non-regular\0dir.txt"), "add.txt": sha("a"),
    }
    assert files == ["add.txt", "edit.txt", "same.txt"] and fresh == "dirty"


def test_listed_missing_equals_unlisted(spark):
    base = {"a.txt": "a", "b.txt": "b"}
    one = state(spark, base, {"a.txt": "a", "b.txt": "missing"})
    two = state(spark, base, {"a.txt": "a"})
    assert facts(one) == facts(two)
    assert one.revision.first() == two.revision.first()


def test_read_error_keeps_prior_record(spark):
    base = {"a.txt": "prior content", "b.txt": "b"}
    previous = spark.createDataFrame([("p", "a.txt", sha("x"))], "project_id string, path string, content_hash string")
    w = state(spark, base, {"a.txt": "read-error", "b.txt": "b", "c.txt": "read-error"}, previous)
    dirty, files, fresh = facts(w)
    assert dirty == {"a.txt": sha("x")} and files == ["a.txt", "b.txt"] and fresh == "stale"
    assert sorted(r.path for r in w.pending.collect()) == ["a.txt", "c.txt"]
    assert sorted(r.code for r in w.warnings.collect()) == ["read-error", "read-error"]
    asked = spark.createDataFrame([("p", "q1", "prior"), ("p", "q2", "zzz")], "project_id string, query_id string, query string")
    found = ws.query_map(w, asked)
    assert [(r.query_id, r.path) for r in found["results"].collect()] == [("q1", "a.txt")]
    assert sorted((r.query_id, r.path, r.excerpt) for r in found["evidence"].collect()) == [
        ("q1", "a.txt", "txt prior content"), ("q2", "a.txt", "txt prior content"),
    ]


def test_no_file_at_all(spark):
    files = spark.createDataFrame([], "project_id string, path string, lexical_terms array<string>, text string")
    asked = spark.createDataFrame([("p", "q", "x")], "project_id string, query_id string, query string")
    fresh = spark.createDataFrame([("p", "stale")], "project_id string, freshness string")
    row = ov.fallback_evidence(asked, files, fresh).first()
    assert row.path is None and row.excerpt.startswith("No indexed source file")


def test_fresh_unsupported(spark):
    assert facts(state(spark, {"a.txt": "a"}, {"a.txt": "a"}))[2] == "fresh"
    assert facts(state(spark, {"a.ts": "x"}, {"a.ts": "function f( {"}))[2] == "unsupported"


def test_changed_list(spark):
    cols = "project_id string, path string"
    base = spark.createDataFrame([("p", "a", "h1"), ("p", "b", "h2")], f"{cols}, content_hash string")
    current = spark.createDataFrame(
        [("p", "a", "indexed", "h1"), ("p", "b", "read-error", None), ("p", "t", "non-text", "h3"), ("p", "u", "non-text", "h4"), ("p", "node_modules/x", "indexed", "h5")],
        f"{cols}, outcome string, content_hash string",
    )
    changed = spark.createDataFrame(
        [("p", "a", True), ("p", "t", True), ("p", "u", False), ("p", "gone", True), ("p", "node_modules/x", True)], f"{cols}, tracked boolean"
    )
    previous = spark.createDataFrame([("p", "b", "old")], f"{cols}, content_hash string")
    got = {r.path: r.dirty_hash for r in ov.diff_changed(base, current, changed, previous).collect()}
    assert got == {"a": "h1", "b": "old", "t": "h3", "u": None, "gone": "deleted"}


def test_ordering_and_batches(spark):
    events = spark.createDataFrame(
        [("p", f"f{i % 3}", "change", i) for i in range(10)], "project_id string, path string, event string, seq long"
    )
    got = [r.batch for r in ov.drain_batches(events, 4).orderBy("seq").collect()]
    assert got == [1, 1, 1, 1, 2, 2, 2, 2, 3, 3]
    ledger = spark.createDataFrame([("p", i, v) for i, v in enumerate("aabba")], "project_id string, generation long, v string")
    assert [r.generation for r in ov.suppress_noops(ledger, ["v"]).orderBy("generation").collect()] == [0, 2, 4]
