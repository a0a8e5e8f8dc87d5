"""Archive, retrieval, reduction and retention on small literal inputs."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from obsframe.functions.receipts import is_receipt
from obsframe.functions.text import block_text
from obsframe.operators import archive as ar
from obsframe.operators import reduce as rd
from obsframe.operators import retention as rt
from obsframe.operators import retrieve as re
from obsframe.plans import archive as plans
from obsframe.plans import retention as rplans
from obsframe.schemas import MESSAGES, OBSERVATIONS

def now():
    return F.lit("2026-02-10 00:00:00").cast("timestamp")


def observations(spark, rows):
    return spark.createDataFrame([("p", *r) for r in rows], OBSERVATIONS)


def test_equal_content_is_stored_once(spark):
    obs = observations(spark, [("s", f"c{i}", "read", "same", False, i) for i in range(12)])
    metadata, artifacts = plans.archive(obs, now())
    assert metadata.count() == 12 and artifacts.count() == 1
    _, flagged = ar.dedup_content(ar.sanitize(obs))
    assert sum(r.deduplicated for r in flagged.collect()) == 11


def test_existing_content_counts_as_duplicate(spark):
    obs = observations(spark, [("s", "c1", "read", "same", False, 1)])
    _, stored = plans.archive(obs, now())
    fresh, flagged = ar.dedup_content(ar.sanitize(obs), stored)
    assert fresh.count() == 0 and flagged.first().deduplicated


def test_upsert_keeps_first_position(spark):
    obs = observations(spark, [("s", "c1", "read", "one", False, 1), ("s", "c2", "read", "two", False, 2), ("s", "c1", "bash", "three", False, 9)])
    metadata, _ = plans.archive(obs, now())
    got = {r.tool_call_id: (r.tool_name, r.position, r.seq) for r in metadata.collect()}
    assert got == {"c1": ("bash", 1, 9), "c2": ("read", 2, 2)}


def test_eligible(spark):
    obs = observations(spark, [("s", "c1", "obsframe_get", "x", False, 1), ("s", "c2", "read", None, False, 2), ("s", "c3", "read", "x", False, 3)])
    assert [r.tool_call_id for r in ar.eligible(obs).collect()] == ["c3"]


def test_virtualize_threshold_is_strict(spark):
    obs = observations(spark, [("s", "a", "read", "x" * 600, False, 1), ("s", "b", "read", "x" * 601, True, 2)])
    out = {r.tool_call_id: r for r in plans.virtualize(obs, 600, 512).collect()}
    assert not out["a"].replaced and out["a"].output == "x" * 600
    assert out["b"].replaced and len(out["b"].output) <= 512 and '"error":true' in out["b"].output


def test_receipt_hides_secrets(spark):
    text = "\n".join(f"failed with api_key=secret{i}" for i in range(10)) + "z" * 600
    row = plans.virtualize(observations(spark, [("s", "a", "bash", text, True, 1)]), 100, 512).first()
    assert row.redactions == 10 and "secret1" not in row.output and len(row.output.encode()) <= 512


@pytest.fixture(scope="module")
def eight(spark):
    obs = observations(
        spark, [("session", f"call-{i}", "read" if i % 2 == 0 else "bash", f"line {i}\nshared needle", False, i) for i in range(8)]
    )
    return plans.archive(obs, now())


def test_search(spark, eight, tmp_path):
    metadata, artifacts = eight
    signed = plans.write_signatures(artifacts, str(tmp_path / "s"))
    asked = spark.createDataFrame(
        [("p", "q1", " NEEDLE ", "read", 3), ("p", "q2", "line", None, None), ("p", "q3", "absent", None, None), ("p", "q4", " ", None, None)],
        "project_id string, query_id string, query string, tool_name string, limit int",
    )
    rows = re.search_observations(asked, metadata, artifacts, signed).collect()
    by = {}
    for r in sorted(rows, key=lambda r: r.rank):
        by.setdefault(r.query_id, []).append(r)
    assert set(by) == {"q1", "q2"}
    assert [r.tool_name for r in by["q1"]] == ["read"] * 3 and all(r.truncated for r in by["q1"])
    assert len(by["q2"]) == 8 and not by["q2"][0].truncated
    assert by["q2"][0].matches[0].text == "line 7"
    _, rejects = re.validate_requests(asked)
    assert [r.reason for r in rejects.collect()] == ["query is empty"]


def test_search_clips_lines_before_matching(spark, tmp_path):
    obs = observations(spark, [("s", "a", "read", "x" * 1024 + "needle\nend", False, 1), ("s", "b", "read", "x" * 1000 + "needle", False, 2)])
    metadata, artifacts = plans.archive(obs, now())
    asked = spark.createDataFrame([("p", "q", "needle", None, None)], "project_id string, query_id string, query string, tool_name string, limit int")
    signed = plans.write_signatures(artifacts, str(tmp_path / "s"))
    assert [r.rank for r in re.search_observations(asked, metadata, artifacts, signed).collect()] == [1]


def test_get(spark, eight):
    metadata, artifacts = eight
    some = metadata.filter("tool_call_id = 'call-3'").first()
    asked = spark.createDataFrame(
        [
            ("p", "range", some.observation_id, None, 2, 6),
            ("p", "hash", some.artifact_id, None, None, None),
            ("p", "lines", some.observation_id, "LINE", None, 1),
            ("p", "gone", "obs_" + "f" * 24, None, None, None),
            ("p", "bad", "nonsense", None, None, None),
        ],
        "project_id string, request_id string, id string, query string, offset int, limit int",
    )
    got = {r.request_id: r for r in re.get_observations(asked, metadata, artifacts).collect()}
    assert set(got) == {"range", "hash", "lines", "gone"}
    assert (got["range"].text, got["range"].truncated) == ("ne 3\ns", True)
    assert (got["hash"].text, got["hash"].truncated) == ("line 3\nshared needle", False)
    assert [(m.line, m.text) for m in got["lines"].matches] == [(1, "line 3")]
    assert got["gone"].status == "not found"


# --- context reduction -------------------------------------------------------------------------------


def conversation(pairs, size=1200, orphan=False):
    block = lambda text: ("text", text, None, None)
    rows = [("p", "s", 0, "user", [block("keep this constraint")], None, None, None, 0, None)]
    for i in range(pairs):
        n = 1 + 2 * i
        rows.append(("p", "s", n, "assistant", [("toolCall", None, f"c{i}", "read")], None, None, None, n, None))
        text = f"result {i} " + "x" * size
        rows.append(("p", "s", n + 1, "toolResult", [block(text), ("image", None, f"img{i}", None)], f"c{i}", "read", False, n + 1, None))
    if orphan:
        n = 1 + 2 * pairs
        rows.insert(1, ("p", "s", n, "toolResult", [block("orphan " + "y" * size)], "nobody", "read", False, n, None))
    return rows


def reduced(spark, rows, window, archived=None, again=None):
    messages = spark.createDataFrame(rows, MESSAGES)
    results = messages.filter("role = 'toolResult'")
    if archived is not None:
        results = results.filter(F.col("tool_call_id").isin(archived))
    obs = results.select(
        "project_id", "session_id", "tool_call_id", "tool_name", F.col("content")[0]["text"].alias("text"), "is_error", F.col("msg_idx").alias("seq")
    )
    metadata, artifacts = plans.archive(obs, now())
    windows = spark.createDataFrame([("p", "s", window, 0)], "project_id string, session_id string, window_tokens long, prompt_bytes long")
    out, report = rd.reduce_context(again or messages, metadata, artifacts, windows, receipt_max=512)
    return out, report.first()


def test_reduces_oldest_to_target(spark):
    rows = conversation(30)
    assert reduced(spark, rows, 20_000)[1].triggered is False
    out, report = reduced(spark, rows, 19_500)
    got = sorted(out.collect(), key=lambda r: r.msg_idx)
    assert report.triggered and report.target_reached and report.tokens_after <= 11_700
    assert [r.role for r in got] == [r[3] for r in sorted(rows, key=lambda r: r[2])]
    results = [r for r in got if r.role == "toolResult"]
    flags = [r.reduced for r in results]
    assert not any(flags[-6:]) and flags == sorted(flags, reverse=True) and sum(flags) == report.reduced_count
    assert all(r.content[-1].type == "image" for r in results)


def test_reduction_is_idempotent(spark):
    out, first = reduced(spark, conversation(20), 8_000)
    again, second = reduced(spark, conversation(20), 8_000, again=out.drop("reduced"))
    assert first.reduced_count > 0
    assert second.reduced_count == 0
    assert [r.content for r in out.orderBy("msg_idx").collect()] == [r.content for r in again.orderBy("msg_idx").collect()]


def test_unarchived_and_orphans_stay(spark):
    rows = conversation(20, orphan=True)
    out, report = reduced(spark, rows, 8_000, archived=[f"c{i}" for i in range(5)])
    assert report.triggered and not report.target_reached and report.reduced_count == 5
    orphan = out.filter("tool_call_id = 'nobody'").first()
    assert not orphan.reduced and not out.select(is_receipt(block_text("content")).alias("r"), "reduced").filter("r != reduced").count()


def test_greedy_matches_sequential_rule(spark):
    rng = random.Random(11)
    rows, want = [], set()
    for session in range(60):
        total, target = rng.randrange(2000, 6000), rng.randrange(500, 1500)
        size, stopped = total, False
        for idx in range(rng.randrange(1, 12)):
            saving = rng.randrange(-60, 900)
            rows.append(("p", str(session), idx * 7, saving, total, float(target)))
            stopped = stopped or -(-size // 3) <= target
            if not stopped:
                want.add((str(session), idx * 7))
                size -= saving
    df = spark.createDataFrame(rows, "project_id string, session_id string, msg_idx long, saving long, total_bytes long, target_tokens double")
    assert {(r.session_id, r.msg_idx) for r in rd.greedy_reduce(df).collect()} == want


# --- retention ---------------------------------------------------------------------------------------


def gc(spark, stored, referenced, days, quota):
    inventory = spark.createDataFrame(
        [("p", a, size, dt.datetime.fromisoformat(day)) for a, size, day in stored],
        "project_id string, artifact_id string, size long, modified_at timestamp",
    )
    metadata = inventory.select("project_id", "artifact_id", F.col("modified_at").alias("updated_at"))
    refs = spark.createDataFrame([("p", r) for r in referenced], "project_id string, artifact_id string")
    out = rplans.collect_garbage(metadata, inventory, refs, now(), days, quota)
    return {r.artifact_id for r in out["decisions"].filter("deleted").collect()}, out["report"].first()


def test_expiry_then_quota(spark):
    gone, report = gc(spark, [("a", 80, "2026-01-01"), ("b", 80, "2026-01-20"), ("c", 80, "2026-02-10")], ["b"], 30, 100)
    assert gone == {"a", "c"} and report.remaining_bytes == 80 and report.quota_satisfied


def test_referenced_is_never_deleted(spark):
    gone, report = gc(spark, [("a", 180, "2026-02-01")], ["a"], 30, 1)
    assert gone == set() and not report.quota_satisfied


def test_eviction_matches_sequential_rule(spark):
    rng = random.Random(5)
    rows, want = [], set()
    for project in ["hot"] * 1 + [f"p{i}" for i in range(40)]:
        items = []
        for i in range(400 if project == "hot" else rng.randrange(1, 12)):
            items.append((project, f"{i:04d}", rng.randrange(0, 50), rng.randrange(0, 40), rng.random() < 0.2))
        quota, cutoff = 200, 10
        remaining = sum(i[2] for i in items)
        order = sorted((i for i in items if not i[4]), key=lambda i: (i[3], i[1]))
        deleted = {i[:2] for i in order if i[3] < cutoff}
        remaining -= sum(i[2] for i in order if i[3] < cutoff)
        for i in order:
            if remaining <= quota:
                break
            if i[:2] not in deleted:
                deleted.add(i[:2])
                remaining -= i[2]
        want |= deleted
        rows += items
    df = spark.createDataFrame(rows, "project_id string, artifact_id string, size long, day int, referenced boolean").withColumn(
        "newest", F.expr("timestamp'2026-01-01' + make_dt_interval(day)")
    )
    dated = rt.expire(df, 10, F.lit("2026-01-21 00:00:00").cast("timestamp"))
    got = {(r.project_id, r.artifact_id) for r in rt.evict(dated, 200).filter("deleted").collect()}
    assert got == want


def pruned(spark, rows, retention, quota):
    df = spark.createDataFrame([("p", *r) for r in rows], "project_id string, generation long, bytes long, is_active boolean, is_valid boolean")
    out = rplans.maintenance(df, retention, quota)
    return sorted(r.generation for r in out["decisions"].filter("deleted").collect()), out["report"].first()


def test_generation_pruning(spark):
    four = [(i, 100, i == 4, True) for i in range(1, 5)]
    assert pruned(spark, four, 2, 10**9)[0] == [1, 2]
    gone, report = pruned(spark, four, 10, 100)
    assert gone == [1, 2, 3] and report.quota_satisfied
    gone, report = pruned(spark, four, 10, 1)
    assert gone == [1, 2, 3] and not report.quota_satisfied
    # One above the active one protects nothing below it but is itself safe.
    assert pruned(spark, [(1, 10, True, True), (2, 10, False, True)], 1, 1)[0] == []
    # An invalid active generation: nothing goes.
    gone, report = pruned(spark, [(1, 10, False, True), (2, 10, True, False)], 1, 1)
    assert gone == [] and report.error == "invalid active generation"
