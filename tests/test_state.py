"""Turns, capsules, generations and streams."""

from __future__ import annotations

import gzip
import hashlib
import json
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from obsframe.operators import overlay as ov
from obsframe.operators import turns as tn
from obsframe.params import Params
from obsframe.plans import rebuild as rb
from obsframe.plans import workspace as ws
from obsframe.schemas import CHANGES, OBSERVATIONS
from obsframe.sources import generations as gen
from obsframe.sources import tables as src
from obsframe.streaming import archive as sa
from obsframe.streaming import changes as sc


def now():
    return F.lit("2026-02-10 00:00:00").cast("timestamp")


def test_turn_freeze_and_rebuild(spark):
    rows = [("p", "s", i, role, text) for i, (role, text) in enumerate(
        [("user", " fix login "), ("assistant", "a"), ("toolResult", "r"), ("user", "  "), ("user", "fix login")])]
    messages = spark.createDataFrame(rows, "project_id string, session_id string, msg_idx long, role string, text string")
    assert [r.turn for r in tn.turns(messages).orderBy("msg_idx").collect()] == [1, 1, 1, 2, 3]
    calls = spark.createDataFrame(
        [("p", "s", "c0", -1, 0), ("p", "s", "c1", 0, 1), ("p", "s", "c2", 2, 2), ("p", "s", "c3", 3, 3)],
        "project_id string, session_id string, call_id string, msg_idx long, call_idx long",
    )
    asked = {r.call_id: r.query for r in tn.asof_query(messages, calls).collect()}
    assert asked == {"c0": "repository structure", "c1": "fix login", "c2": "fix login", "c3": "fix login"}
    shown = spark.createDataFrame(
        [("p", "s", 1, 0, 1, "A"), ("p", "s", 1, 0, 2, "B"), ("p", "s", 1, 1, 3, "C"), ("p", "s", 2, 1, 4, "D")],
        "project_id string, session_id string, turn int, epoch int, call_idx int, capsule string",
    )
    frozen = [(r.capsule, r.built) for r in tn.freeze_per_turn(shown).orderBy("call_idx").collect()]
    assert frozen == [("A", True), ("A", False), ("C", True), ("D", True)]
    assert tn.freeze_per_turn(shown, "off").count() == 0
    assert all(r.built for r in tn.freeze_per_turn(shown, "every-llm-call").collect())
    put = tn.insert_capsules(messages, spark.createDataFrame([("p", "s", "CAP")], "project_id string, session_id string, capsule string"))
    assert [r.text for r in put.orderBy("msg_idx").collect()][-1] == "CAP"


# The sequential cutting rule on plain dictionaries.
def cut(p, limit):
    def size():
        return len((tn.CAPSULE_HEADER + json.dumps(p, ensure_ascii=False, separators=(",", ":"))).encode())

    for name, floor in (("hits", 0), ("waiting", 0), ("evidence", 1)):
        while size() > limit and len(p[name]) > floor:
            p[name].pop()
    while size() > limit and len(p["asked"]) > 64:
        p["asked"] = p["asked"][:-32]
    while size() > limit and any(len(e["excerpt"]) > 96 for e in p["evidence"]):
        for e in p["evidence"]:
            e["excerpt"] = e["excerpt"][: max(96, len(e["excerpt"]) // 2)]
    return p if size() <= limit else None


def test_fit_matches_sequential_rule(spark):
    rng = random.Random(4)
    text = lambda n: "".join(rng.choice('abc dé"\n') for _ in range(n))
    rows = []
    for i in range(40):
        rows.append(
            (
                i, text(rng.choice((10, 300, 512))), rng.choice(("fresh", "stale")), 7, "head", "r" * 64,
                [text(rng.randrange(1, 60)) for _ in range(rng.randrange(0, 12))],
                [(text(rng.randrange(1, 120)), "lexical") for _ in range(rng.randrange(0, 9))],
                [("source", text(8), text(rng.choice((50, 200, 1500)))) for _ in range(rng.randrange(1, 4))],
                None if i % 3 else text(700),
            )
        )
    df = spark.createDataFrame(
        rows,
        "i int, query string, freshness string, generation int, head string, workspace_revision string, pending_files array<string>, "
        "results array<struct<path:string,kind:string>>, evidence array<struct<kind:string,path:string,excerpt:string>>, error string",
    )
    for limit in (512, 700, 1200, 2500, 6144):
        got = {r.i: r.capsule for r in tn.fit_capsule(df, limit).collect()}
        for r in rows:
            body = json.loads(got[r[0]].removeprefix(tn.CAPSULE_HEADER))
            assert len(got[r[0]].encode()) <= limit
            assert (body["freshness"], body["revision"]) == (r[2], r[5])
            payload = {
                "type": tn.CAPSULE_TYPE, "note": tn.CAPSULE_NOTE, "asked": r[1], "freshness": r[2], "generation": 7,
                "head": "head", "revision": r[5], "waiting": list(r[6]),
                "hits": [{"path": a, "kind": b} for a, b in r[7]],
                "evidence": [{"kind": k, "path": p, "excerpt": e[:1024]} for k, p, e in r[8][:3]],
            }
            if r[9]:
                payload["problem"] = r[9][:512]
            want = cut(payload, limit)
            assert body == want if want else body["cut"], (r[0], limit)


def test_fit_rejects_small_budget(spark):
    with pytest.raises(ValueError):
        tn.fit_capsule(spark.createDataFrame([(1,)], "i int"), 511)


# --- generations -------------------------------------------------------------------------------------


def raw(spark, sources):
    return spark.createDataFrame(
        [(p, path, bytearray(t.encode()) if t is not None else None, None if t is not None else "denied") for p, path, t in sources],
        "project_id string, path string, content binary, read_error string",
    )


def heads(spark, *projects):
    return spark.createDataFrame([(p, "h1") for p in projects], "project_id string, head string")


def test_publish_and_prune(spark, tmp_path):
    root = str(tmp_path / "map")
    h = heads(spark, "p", "q")
    first = [("p", "a.ts", "export class A {}"), ("p", "b.txt", "bee"), ("q", "x.txt", "ex")]
    _, published = rb.rebuild(raw(spark, first), h, root, now())
    assert sorted((r.project_id, r.generation) for r in published.collect()) == [("p", 1), ("q", 1)]
    _, published = rb.rebuild(raw(spark, first), h, root, now())
    assert published.count() == 0
    # One project changes; an unreadable file keeps its record and makes the project stale.
    second = [("p", "a.ts", "export class B {}"), ("p", "b.txt", None), ("q", "x.txt", "ex")]
    _, published = rb.rebuild(raw(spark, second), h, root, now())
    assert [(r.project_id, r.generation) for r in published.collect()] == [("p", 2)]
    active = gen.read_active(spark, root)
    assert {(r.project_id, r.generation, r.freshness) for r in active["generation"].collect()} == {("p", 2, "stale"), ("q", 1, "fresh")}
    assert sorted(r.path for r in active["files"].filter("project_id = 'p'").collect()) == ["a.ts", "b.txt"]
    assert [r.path for r in active["pending"].collect()] == ["b.txt"]
    symbols = active["files"].filter("path = 'a.ts'").select(F.explode("symbols.name")).collect()
    assert [s[0] for s in symbols] == ["B"]
    assert gen.read_snapshot(spark, root, "p", 1)["files"].count() == 2
    with pytest.raises(ValueError):
        gen.read_snapshot(spark, root, "p", 9)
    start = {r.project_id: (r.generation, r.freshness) for r in gen.hydrate(spark, root, heads(spark, "p", "new")).collect()}
    assert start == {"p": (2, "stale"), "new": (0, "stale")}
    report = {r.project_id: r for r in gen.prune(spark, root, 1, 10**9).collect()}
    assert (report["p"].deleted_generations, report["p"].remaining_generations) == (1, 1)
    assert sorted((r.project_id, r.generation) for r in gen.read_generations(spark, root).collect()) == [("p", 2), ("q", 1)]


def test_invalid_generation_is_not_active_and_not_pruned(spark, tmp_path):
    root = str(tmp_path / "map")
    h = heads(spark, "p")
    for text in ("one", "two"):
        rb.rebuild(raw(spark, [("p", "a.txt", text)]), h, root, now())
    bad = gen.read_table(spark, root, "files").filter("generation = 2").withColumn("kind", F.lit("odd"))
    gen._write(spark.createDataFrame(bad.collect(), bad.schema), f"{root}/files")
    assert gen.read_active(spark, root)["generation"].count() == 0
    assert gen.hydrate(spark, root, h).first().freshness == "stale"
    report = gen.prune(spark, root, 1, 1).first()
    assert report.error == "invalid active generation" and report.deleted_generations == 0


def test_failed_publication_is_invisible(spark, tmp_path):
    root = str(tmp_path / "map")
    h = heads(spark, "p")
    rb.rebuild(raw(spark, [("p", "a.txt", "one")]), h, root, now())
    # A claimed number and data without a pointer: what a crash leaves behind.
    claim = gen.read_generations(spark, root).withColumn("generation", F.lit(2).cast("long"))
    gen._write(spark.createDataFrame(claim.collect(), claim.schema), f"{root}/generations")
    orphan = gen.read_table(spark, root, "files").withColumn("generation", F.lit(2).cast("long")).withColumn("path", F.lit("ghost"))
    gen._write(spark.createDataFrame(orphan.collect(), orphan.schema), f"{root}/files")
    assert [r.path for r in gen.read_active(spark, root)["files"].collect()] == ["a.txt"]
    _, published = rb.rebuild(raw(spark, [("p", "a.txt", "two")]), h, root, now())
    assert published.first().generation == 3
    assert [r.path for r in gen.read_active(spark, root)["files"].collect()] == ["a.txt"]


def test_capsules_of_unavailable_files(spark):
    empty = "project_id string, path string"
    files = spark.createDataFrame([], f"{empty}, kind string, content_hash string, lexical_terms array<string>, degraded_reason string").withColumns(
        {c: F.array().cast(t) for c, t in (("imports", "array<struct<source:string,names:array<string>>>"), ("exports", "array<struct<name:string>>"),
                                           ("symbols", "array<struct<name:string,signature:string>>"), ("dependencies", "array<string>"))}
    )
    state = ws.Workspace(
        files, spark.createDataFrame([], empty), spark.createDataFrame([], f"{empty}, content_hash string"),
        spark.createDataFrame([("p", f"f{i:03d}") for i in range(500)], empty),
        spark.createDataFrame([("p", "r" * 64)], "project_id string, workspace_revision string"),
        spark.createDataFrame([("p", "stale")], "project_id string, freshness string"),
    )
    messages = spark.createDataFrame([("p", "s", 0, "user", "find it")], "project_id string, session_id string, msg_idx long, role string, text string")
    calls = spark.createDataFrame([("p", "s", "c1", 0, 1, 1, 0), ("p", "s", "c2", 0, 2, 1, 0)],
                                  "project_id string, session_id string, call_id string, msg_idx long, call_idx long, turn int, epoch int")
    out = ws.capsules(messages, calls, state, heads(spark, "p"), 3, Params(map_context_max_bytes=1024)).orderBy("call_id").collect()
    assert [r.built for r in out] == [True, False] and out[0].capsule == out[1].capsule
    body = json.loads(out[0].capsule.removeprefix(tn.CAPSULE_HEADER))
    assert len(out[0].capsule.encode()) <= 1024 and body["freshness"] == "stale" and body["generation"] == 3
    assert body["waiting"] == [f"f{i:03d}" for i in range(len(body["waiting"]))]
    assert body["evidence"][0]["excerpt"].startswith("No indexed source file")


# --- sources and streams -----------------------------------------------------------------------------


def test_metadata_validation(spark, tmp_path):
    good = {
        "schemaVersion": 1, "artifactId": "a" * 64, "observationId": "o", "toolName": "t", "sessionId": "s", "contentHash": "a" * 64,
        "originalBytes": 5, "sanitizedBytes": 5, "redactionCount": 0, "createdAt": "2026-01-01T00:00:00.000Z", "updatedAt": "2026-01-01T00:00:00.000Z",
    }
    bad = [
        {**good, "schemaVersion": 2}, {**good, "contentHash": "b" * 64}, {**good, "originalBytes": 1.5}, {**good, "sanitizedBytes": "5"},
        {**good, "createdAt": "never"}, {**good, "artifactId": "zz", "contentHash": "zz"}, {**good, "toolCallId": 7}, {k: v for k, v in good.items() if k != "toolName"},
    ]
    path = tmp_path / "m.jsonl"
    path.write_text("\n".join([json.dumps(good), "", "  ", json.dumps({**good, "toolCallId": "c"}), "{broken", *map(json.dumps, bad)]) + "\n")
    ok, rejects = src.read_metadata(spark, str(path), "quarantine")
    assert [r.tool_call_id for r in ok.collect()] == [None, "c"] and rejects.count() == 9
    with pytest.raises(Exception, match="invalid metadata record"):
        src.read_metadata(spark, str(path)).collect()
    assert src.read_metadata(spark, str(tmp_path / "none")).count() == 0


def test_read_corpus(spark, tmp_path):
    (tmp_path / "a b").mkdir()
    (tmp_path / "a b" / "x+y.txt").write_bytes(b"hi")
    (tmp_path / "top.ts").write_bytes(b"let a = 1;")
    rows = src.read_corpus(spark, str(tmp_path), "p").orderBy("path").collect()
    assert [(r.path, bytes(r.content), r.size_bytes) for r in rows] == [("a b/x+y.txt", b"hi", 2), ("top.ts", b"let a = 1;", 10)]


def test_read_corpus_hashes_large_files_in_pieces(spark, tmp_path):
    rng = random.Random(7)
    kinds = {
        "ended": rng.randbytes(70_000) + b"\n", "open": rng.randbytes(70_000) + b"x", "one line": b"\0" * 50_000, "ends": b"\n" * 30_000,
        "marked": b"\xef\xbb\xbf" + b"text\r\n" * 9_000, "marked open": b"\xef\xbb\xbf" + b"ab\rc\n" * 9_000 + b"z", "small": b"hi",
        "marks": b"\xef\xbb\xbf" * 9_000, "packed.gz": gzip.compress(rng.randbytes(40_000)), "a b+cé.txt": rng.randbytes(65_537),
    }
    (tmp_path / "sub").mkdir()
    for name, content in kinds.items():
        (tmp_path / "sub" / name).write_bytes(content)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16k")  # splits inside the files
    try:
        files = src.read_corpus(spark, str(tmp_path), "p", piece_bytes=4096)
        assert "MapInArrow" in files._jdf.queryExecution().toString()
        light = {r.path: r for r in files.select("path", "size_bytes", "content_hash").collect()}
        full = {r.path: bytes(r.content) for r in files.collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert full == {f"sub/{name}": content for name, content in kinds.items()}
    for name, content in kinds.items():
        r = light[f"sub/{name}"]
        assert (r.size_bytes, r.content_hash) == (len(content), hashlib.sha256(content).hexdigest()), name


def test_archive_stream_replay_changes_nothing(spark, tmp_path):
    root = str(tmp_path / "archive")
    rows = [("p", "s", f"c{i % 3}", "read", f"token=abc{i} " + "x" * 600 * (i % 2), False, i) for i in range(6)]
    rows += [("p", "", "c9", "read", "no session", False, 9), ("p", "s", "c8", "obsframe_get", "own", False, 8)]
    batch = spark.createDataFrame(rows, OBSERVATIONS)
    params = Params(archive_threshold_bytes=500, receipt_max_bytes=512)

    def facts():
        metadata, artifacts = sa.read_archive(spark, root)
        return (
            sorted((r.tool_call_id, r.seq, r.position) for r in metadata.collect()),
            sorted((r.artifact_id, r.content) for r in artifacts.collect()),
            spark.read.parquet(f"{root}/outputs").count(),
            [r.reason for r in spark.read.parquet(f"{root}/dead_letters").collect()],
        )

    sa.archive_batch(batch, 0, root, params)
    once = facts()
    sa.archive_batch(batch, 0, root, params)
    assert facts() == once
    sa.archive_batch(batch, 1, root, params)
    assert facts()[0] == once[0] and facts()[1] == once[1]
    assert once[0] == [("c0", 3, 0), ("c1", 4, 1), ("c2", 5, 2)] and once[3] == ["session is empty"]
    assert all("abc" not in content for _, content in once[1])


def test_overlay_stream_late_events(spark, tmp_path):
    stamp = lambda s: F.expr(f"timestamp'2026-01-01 00:00:{s:02d}'")
    rows = [("a", "change", 5, 1), ("a", "unlink", 9, 2), ("b", "add", 3, 3), ("a", "change", 2, 4)]
    frames = [
        spark.range(1).select(F.lit("p").alias("project_id"), F.lit(p).alias("path"), F.lit(e).alias("event"), stamp(t).alias("ts"),
                              F.lit(s).cast("long").alias("seq"), F.lit(None).cast("binary").alias("content"))
        for p, e, t, s in rows
    ]
    states = []
    for order in ((0, 1, 2, 3), (3, 2, 1, 0)):
        root = str(tmp_path / f"o{order[0]}")
        for batch_id, i in enumerate(order):
            sc.overlay_batch(frames[i], batch_id, root)
        states.append(sorted((r.path, r.event, r.deleted) for r in sc.read_overlay(spark, root).collect()))
    assert states[0] == states[1] == [("a", "unlink", True), ("b", "add", False)]


def test_a_bounded_drain_keeps_its_remainder(spark, tmp_path):
    """Batches against a plain queue: order of arrival, newest event of a path, a batch that runs again, the final flush."""
    rng, root, limit = random.Random(4), str(tmp_path / "d"), 3
    start = datetime(2026, 1, 1)
    queue, applied, seq = {}, {}, 0
    for batch_id in range(6):
        rows = []
        for _ in range(rng.choice([0, 2, 9])):
            seq += 1
            key = rng.choice(["p", "p", "q"]), f"f{rng.randrange(8)}"
            event = (start + timedelta(seconds=rng.randrange(50)), seq, rng.choice(["add", "change", "unlink"]))
            rows.append((*key, event[2], event[0], seq, None))
            old = queue.get(key)
            queue[key] = (old[0], max(old[1], event)) if old else (seq, event)
        for project in ("p", "q"):
            for key in sorted((k for k in queue if k[0] == project), key=lambda k: queue[k][0])[:limit]:
                applied[key] = max(applied.get(key, queue[key][1]), queue[key][1])
                del queue[key]
        batch = spark.createDataFrame(rows, CHANGES)
        for _ in range(2):
            sc.drain_batch(batch, batch_id, root, limit)
        got = {(r.project_id, r.path): (r.queued, (r.ts, r.seq, r.event)) for r in sc.read_pending(spark, root).collect()}
        assert got == queue
    assert queue
    sc.flush(spark, root)
    for key, (_, event) in queue.items():
        applied[key] = max(applied.get(key, event), event)
    assert sc.read_pending(spark, root).count() == 0
    assert {(r.project_id, r.path): (r.ts, r.seq, r.event) for r in sc.read_overlay(spark, root).collect()} == applied
    sc.drain_batch(spark.createDataFrame([("p", "late", "add", start, 10**6, None)], CHANGES), 6, root, limit)
    assert sc.read_overlay(spark, root).count() == len(applied) + 1 and sc.read_pending(spark, root).count() == 0


def test_a_waiting_path_makes_its_project_stale(spark, tmp_path):
    root = str(tmp_path / "s")
    rows = [(p, f"f{i}", "add", datetime(2026, 1, 1), i, None) for p, n in (("p", 3), ("q", 2)) for i in range(n)]
    sc.drain_batch(spark.createDataFrame(rows, CHANGES), 0, root, 2)
    heads = spark.createDataFrame([("p",), ("q",)], "project_id string")
    none = spark.createDataFrame([], "project_id string, path string, degraded_reason string")
    out = ov.freshness(heads, sc.read_pending(spark, root).select("project_id", "path"), none, none, none)
    assert {r.project_id: r.freshness for r in out.collect()} == {"p": "stale", "q": "fresh"}


def test_streams_read_a_table_of_one_file_and_a_folder_of_files(spark, tmp_path):
    from workload import storage

    rows = spark.range(40).selectExpr(
        "id AS doc_id", "concat('text ', id) AS text", "'en' AS lang", "concat('src', id % 2) AS source", "200L AS n_chars"
    )
    rows.repartition(3).write.parquet(str(tmp_path / "many" / "documents.parquet"))
    rows.coalesce(1).write.parquet(str(tmp_path / "part"))
    (tmp_path / "one").mkdir()
    next((tmp_path / "part").glob("*.parquet")).rename(tmp_path / "one" / "documents.parquet")
    found = [sorted(storage.archive_stream(spark, str(tmp_path / d)).collect()) for d in ("one", "many")]
    # Nothing is set aside here: there are no dead letters to read.
    assert found[0] == found[1]
    assert [(r.project_id, r.observations, r.set_aside) for r in found[0]] == [("src0", 20, 0), ("src1", 20, 0)]


def test_a_table_in_few_files_is_spread_once(spark, tmp_path):
    """A job of many readings gets the same rows, in a folder whose texts no reading moves again."""
    from workload import tables as wt

    rows = [(i, f"text {i}") for i in range(200)]
    for name in ("documents", "labels"):
        spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / f"{name}.parquet"))
    folder = wt.spread(spark, str(tmp_path), "documents", "labels")
    assert folder != str(tmp_path)
    again = wt.table(spark, folder, "documents")
    assert "Exchange" not in again._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, again.collect())) == rows == sorted(map(tuple, wt.table(spark, folder, "labels").collect()))
    assert wt.spread(spark, folder, "documents", "labels") == folder


def test_terms_that_no_query_asks_are_not_sorted(spark, monkeypatch):
    from obsframe.operators import overlay as ov

    sorted_rows = []
    real = ov.top_k
    monkeypatch.setattr(ov, "top_k", lambda df, *a, **k: sorted_rows.append(df) or real(df, *a, **k))
    files = spark.createDataFrame([("p", f"f{i}", ["asked", f"other{i}"], "x") for i in range(9)], "project_id string, path string, lexical_terms array<string>, text string")
    queries = spark.createDataFrame([("p", "q", "asked")], "project_id string, query_id string, query string")
    state = spark.createDataFrame([("p", "stale")], "project_id string, freshness string")
    found = ov.fallback_evidence(queries, files, state)
    assert sorted(r.path for r in found.collect()) == ["f0", "f1", "f2"]
    assert {r.term for r in sorted_rows[0].collect()} == {"asked"}
