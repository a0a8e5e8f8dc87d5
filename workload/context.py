"""Context budgets, turns, telemetry and retention over conversations and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from obsframe.functions import text as fx
from obsframe.functions.receipts import is_receipt
from obsframe.operators import overlay as ov
from obsframe.operators import reduce as rd
from obsframe.operators import retention as rt
from obsframe.operators import telemetry as tm
from obsframe.operators import turns as tn
from obsframe.plans import archive as plans
from obsframe.plans import retention as rplans

from . import sql, tables as t

SOFT, TARGET = 0.75, 0.7
PROMPT_BYTES = 300
RECEIPT = 512


def _windows(spark, sf_dir):
    return t.messages(spark, sf_dir).select("project_id", "session_id").distinct().select(
        "*", F.lit(t.WINDOW_TOKENS).alias("window_tokens"), F.lit(PROMPT_BYTES).alias("prompt_bytes")
    )


def _archived(spark, sf_dir):
    return plans.archive(t.result_observations(spark, sf_dir), t.now())


def message_texts(spark, sf_dir):
    m = t.messages(spark, sf_dir).withColumn("joined", fx.block_text("content"))
    swapped = fx.replace_text_blocks("content", F.lit("short"))
    return m.select(
        "session_id", "msg_idx", fx.sha256("joined").alias("text_hash"), rd.message_bytes().alias("bytes"),
        F.size(swapped).cast("long").alias("blocks_after"), rd.message_bytes(swapped).alias("bytes_after"),
    )


def paired_results(spark, sf_dir):
    m = t.messages(spark, sf_dir)
    results = m.filter(F.col("role") == "toolResult").select("project_id", "session_id", "tool_call_id", "msg_idx")
    return rd.paired_results(results, m).select("session_id", "msg_idx", "tool_call_id")


def lookup_by_call(spark, sf_dir):
    metadata, _ = _archived(spark, sf_dir)
    m = t.messages(spark, sf_dir).filter(F.col("role") != "assistant")
    asked = m.select("project_id", "session_id", "msg_idx", "tool_call_id")
    return rd.lookup_by_call(asked, metadata).select("session_id", "msg_idx", "observation_id", "original_bytes")


def hot_set(spark, sf_dir):
    return rd.hot_set(t.messages(spark, sf_dir), 2).select("session_id", "hot_from")


def context_pressure(spark, sf_dir):
    sizes = t.messages(spark, sf_dir).select(*rd.MESSAGE, rd.message_bytes().alias("message_bytes"))
    return rd.context_pressure(sizes, _windows(spark, sf_dir), SOFT, TARGET).select(
        "session_id", "total_bytes", "tokens_before", F.col("target_tokens").cast("double").alias("target_tokens"), "triggered"
    )


def _reduced(spark, sf_dir):
    metadata, artifacts = _archived(spark, sf_dir)
    return rd.reduce_context(
        t.messages(spark, sf_dir), metadata, artifacts, _windows(spark, sf_dir), SOFT, TARGET, t.HOT, RECEIPT
    )


def reduce_context(spark, sf_dir):
    out, _ = _reduced(spark, sf_dir)
    return out.select(
        "session_id", "msg_idx", "role", "reduced",
        fx.sha256(fx.block_text("content")).alias("text_hash"), is_receipt(fx.block_text("content")).alias("is_receipt"),
    )


def reduction_report(spark, sf_dir):
    return _reduced(spark, sf_dir)[1].drop("project_id")


def turns(spark, sf_dir):
    return tn.turns(t.spoken(spark, sf_dir)).select("session_id", "msg_idx", F.col("turn").cast("long").alias("turn"))


def _calls(spark, sf_dir):
    """Every assistant turn is a model call that saw the messages before it; system turns mark rebuilds."""
    m = tn.turns(t.spoken(spark, sf_dir))
    return m.filter(F.col("role") == "assistant").select(
        "project_id", "session_id", F.col("msg_idx").cast("string").alias("call_id"),
        (F.col("msg_idx") - 1).alias("msg_idx"), F.col("msg_idx").alias("call_idx"), "turn", F.lit("call").alias("op"),
    )


def asof_query(spark, sf_dir):
    calls = _calls(spark, sf_dir)
    return tn.asof_query(t.spoken(spark, sf_dir), calls).select("session_id", "call_id", fx.sha256("query").alias("query_hash"))


def _epochs(spark, sf_dir):
    m = tn.turns(t.spoken(spark, sf_dir)).select(
        "project_id", "session_id", F.col("msg_idx").alias("call_idx"), "turn", "text",
        F.when(F.octet_length("text") > 600, "rebuild").otherwise("call").alias("op"),
    )
    return tn.rebuild_epochs(m)


def rebuild_epochs(spark, sf_dir):
    return _epochs(spark, sf_dir).select("session_id", "call_idx", F.col("epoch").cast("long").alias("epoch"))


def freeze_per_turn(spark, sf_dir):
    shown = _epochs(spark, sf_dir).withColumn("capsule", fx.sha256("text")).drop("text")
    return tn.freeze_per_turn(shown).select("session_id", "call_idx", "capsule", "built")


def insert_capsules(spark, sf_dir):
    m = t.spoken(spark, sf_dir)
    caps = m.select("project_id", "session_id").distinct().withColumn("capsule", F.concat(F.lit("capsule "), "session_id"))
    return tn.insert_capsules(m, caps).select("session_id", "msg_idx", "role", fx.sha256("text").alias("text_hash"))


def drop_capsules(spark, sf_dir):
    m = t.spoken(spark, sf_dir).select(
        "session_id", "msg_idx", F.when(F.col("role") == "system", "custom").otherwise(F.col("role")).alias("role"),
        F.when(F.col("role") == "system", tn.CAPSULE_TYPE).alias("custom_type"),
    )
    return tn.drop_capsules(m).select("session_id", "msg_idx", "role")


def counters(spark, sf_dir):
    out = tm.counters(t.oplog(spark, sf_dir))
    rounded = [
        F.round(c, 4).alias(c) if c.endswith("duration_ms_total") else F.col(c).cast("long").alias(c)
        for c in out.columns
        if c != "session_id"
    ]
    return out.select("session_id", *rounded)


def telemetry(spark, sf_dir):
    return tm.telemetry(t.oplog(spark, sf_dir)).select(
        "session_id", "capsule_build_count", "capsule_bytes", "capsule_insertion_index", "capsule_hash_change_count",
        "generation_bytes_written", "map_total_bytes", "archive_attempt_count",
    )


def _components(spark, sf_dir):
    log = t.oplog(spark, sf_dir)
    return log.groupBy(F.col("session_id").alias("project_id"), F.col("op").alias("component")).agg(
        F.bool_or("ok").alias("available"),
        (F.max("duration_ms") > 300).alias("degraded"),
        F.when(F.max("duration_ms") > 280, "stale").otherwise("fresh").alias("freshness"),
        F.when(F.max("duration_ms") > 290, "failed").alias("maintenance_error"),
    )


def _failures(spark, sf_dir):
    return t.oplog(spark, sf_dir).filter((F.col("op") == "archive") & (F.col("duration_ms") > 150)).select(
        F.col("session_id").alias("project_id"), "seq", F.col("op").alias("component"),
        F.repeat(F.concat("session_id", F.lit(" ")), 100).alias("error"),
    )


def status(spark, sf_dir):
    return tm.status(_components(spark, sf_dir), _failures(spark, sf_dir))[0]


def bounded_failures(spark, sf_dir):
    failures = t.oplog(spark, sf_dir).filter(~F.col("ok")).select(
        F.col("session_id").alias("project_id"), "seq", F.repeat(F.concat("session_id", F.lit(" ")), 100).alias("error")
    )
    return tm.bounded_failures(failures).select(
        "project_id", "seq", F.col("rank").cast("long").alias("rank"), fx.byte_len("error").alias("error_bytes")
    )


def health(spark, sf_dir):
    return tm.health(status(spark, sf_dir))


def _gc_input(spark, sf_dir):
    inv = t.inventory(spark, sf_dir)
    # Views were recorded again three days later; purchases are still referenced; signups left the store.
    metadata = inv.filter(F.col("event_type").isin("view", "signup")).select(
        "project_id", "artifact_id", (F.col("modified_at") + F.expr("INTERVAL 3 DAYS")).alias("updated_at")
    )
    stored = inv.filter(F.col("event_type") != "signup")
    referenced = inv.filter(F.col("event_type") == "purchase").select("project_id", "artifact_id")
    return metadata, stored, referenced


def gc_candidates(spark, sf_dir):
    return rt.gc_candidates(*_gc_input(spark, sf_dir)).select(
        "project_id", "artifact_id", "size", F.unix_micros("newest").alias("newest_us"), "referenced"
    )


def newest_timestamps(spark, sf_dir):
    metadata, _, _ = _gc_input(spark, sf_dir)
    return rt.newest_timestamps(metadata).select("artifact_id", F.unix_micros("updated_at").alias("updated_us"))


def _gc(spark, sf_dir):
    return rplans.collect_garbage(*_gc_input(spark, sf_dir), t.now(), t.RETENTION_DAYS, t.QUOTA)


def collect_garbage(spark, sf_dir):
    return _gc(spark, sf_dir)["decisions"].select("project_id", "artifact_id", "expired", "deleted")


def gc_report(spark, sf_dir):
    return _gc(spark, sf_dir)["report"]


def gc_metadata(spark, sf_dir):
    return _gc(spark, sf_dir)["metadata"].groupBy("project_id").agg(F.count(F.lit(1)).alias("records"))


def prune_generations(spark, sf_dir):
    pruned = rt.prune_generations(t.ledger(spark, sf_dir), t.GENERATION_RETENTION, t.GENERATION_QUOTA)
    return pruned.select("project_id", "generation", "active_generation", "deleted")


def maintenance(spark, sf_dir):
    return rplans.maintenance(t.ledger(spark, sf_dir), t.GENERATION_RETENTION, t.GENERATION_QUOTA)["report"].drop("error")


def suppress_noops(spark, sf_dir):
    return ov.suppress_noops(t.ledger(spark, sf_dir), ["event_type"]).select("project_id", "generation", "event_type")


def latest_per_path(spark, sf_dir):
    return ov.latest_per_path(t.changes(spark, sf_dir)).select("project_id", "path", "event", "seq")


def drain_batches(spark, sf_dir):
    return ov.drain_batches(t.changes(spark, sf_dir), 16).select("project_id", "seq", "batch")


def debounce(spark, sf_dir):
    out = ov.debounce(t.changes(spark, sf_dir), "6 hours")
    return out.select("project_id", F.unix_micros("started").alias("started_us"), F.unix_micros("ended").alias("ended_us"), "changes")


QUERIES = {
    f.__name__: f
    for f in (
        message_texts, paired_results, lookup_by_call, hot_set, context_pressure, reduce_context, reduction_report, turns,
        asof_query, rebuild_epochs, freeze_per_turn, insert_capsules, drop_capsules, counters, telemetry, status,
        bounded_failures, health, gc_candidates, newest_timestamps, collect_garbage, gc_report, gc_metadata,
        prune_generations, maintenance, suppress_noops, latest_per_path, drain_batches, debounce,
    )
}

_SPOKEN = """spoken AS (SELECT conv_id::VARCHAR AS session_id, turn AS msg_idx, role, text FROM conversations)"""
_TURNS = f"""{_SPOKEN}, turned AS (SELECT *, (sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END)
   OVER (PARTITION BY session_id ORDER BY msg_idx))::BIGINT AS turn FROM spoken)"""
_BYTES = """sized AS (SELECT *, (strlen('{"role":"' || role || '","content":[{"type":"text","text":' || to_json(text)::VARCHAR || '}'
     || CASE WHEN role = 'assistant' THEN ',{"type":"toolCall","id":"call-' || (msg_idx + 1) || '","name":"answer"}' ELSE '' END || ']'
     || CASE WHEN role = 'toolResult' THEN ',"tool_call_id":"' || tool_call_id || '","tool_name":"answer","is_error":false' ELSE '' END
     || ',"timestamp":' || msg_idx || '}'))::BIGINT AS bytes FROM msgs)"""
_SHORT = """strlen('{"role":"' || role || '","content":[{"type":"text","text":"short"}'
     || CASE WHEN role = 'assistant' THEN ',{"type":"toolCall","id":"call-' || (msg_idx + 1) || '","name":"answer"}' ELSE '' END || ']'
     || CASE WHEN role = 'toolResult' THEN ',"tool_call_id":"' || tool_call_id || '","tool_name":"answer","is_error":false' ELSE '' END
     || ',"timestamp":' || msg_idx || '}')::BIGINT"""
_PRESSURE = f"""pressure AS (
  SELECT session_id, (sum(bytes) + count(*) + 1 + {PROMPT_BYTES})::BIGINT AS total_bytes FROM sized GROUP BY 1),
est AS (SELECT *, ceil(total_bytes / 3.0)::BIGINT AS tokens_before, {t.WINDOW_TOKENS * TARGET} AS target_tokens,
        ceil(total_bytes / 3.0) >= {t.WINDOW_TOKENS * SOFT} AS triggered FROM pressure)"""
# The sequential rule itself, walked message by message.
_REDUCED = f"""WITH RECURSIVE {sql.sanitized(sql.RESULTS)}, {sql.receipts("sane", RECEIPT)}, {sql.MESSAGES}, {_BYTES}, {_PRESSURE},
cand0 AS (
  SELECT m.session_id, m.msg_idx, m.bytes, m.text, r.receipt,
         row_number() OVER (PARTITION BY m.session_id ORDER BY m.msg_idx DESC) AS recency
  FROM sized m JOIN sane s ON s.session_id = m.session_id AND s.tool_call_id = m.tool_call_id
  JOIN receipts r USING (observation_id) WHERE m.role = 'toolResult'),
cand AS (
  SELECT c.session_id, c.msg_idx, c.receipt, row_number() OVER (PARTITION BY c.session_id ORDER BY c.msg_idx) AS i,
         (strlen(to_json(c.text)::VARCHAR) - strlen(to_json(c.receipt)::VARCHAR))::BIGINT AS saving
  FROM cand0 c JOIN est e USING (session_id)
  JOIN msgs a ON a.session_id = c.session_id AND a.role = 'assistant' AND a.msg_idx + 1 = c.msg_idx
  WHERE recency > {t.HOT} AND triggered AND strlen(c.receipt) < strlen(c.text)),
walk AS (
  SELECT session_id, 0::BIGINT AS i, total_bytes AS size, target_tokens AS target, false AS reduced, false AS stopped
  FROM est WHERE triggered
  UNION ALL
  SELECT w.session_id, c.i, CASE WHEN w.stopped OR ceil(w.size / 3.0) <= w.target THEN w.size ELSE w.size - c.saving END,
         w.target, NOT (w.stopped OR ceil(w.size / 3.0) <= w.target), w.stopped OR ceil(w.size / 3.0) <= w.target
  FROM walk w JOIN cand c ON c.session_id = w.session_id AND c.i = w.i + 1),
chosen AS (SELECT c.* FROM walk w JOIN cand c ON c.session_id = w.session_id AND c.i = w.i WHERE w.reduced)"""

_GC = f"""WITH {sql.INVENTORY},
meta AS (SELECT project_id, artifact_id, modified_at + INTERVAL 3 DAY AS updated_at FROM inventory WHERE event_type IN ('view', 'signup')),
cands AS (SELECT coalesce(m.project_id, i.project_id) AS project_id, coalesce(m.artifact_id, i.artifact_id) AS artifact_id,
                 coalesce(i.size, 0)::BIGINT AS size,
                 greatest(coalesce(i.modified_at, TIMESTAMP '1970-01-01'), coalesce(m.updated_at, TIMESTAMP '1970-01-01')) AS newest,
                 coalesce(i.event_type = 'purchase', false) AS referenced
          FROM meta m FULL JOIN (SELECT * FROM inventory WHERE event_type <> 'signup') i
            ON m.project_id = i.project_id AND m.artifact_id = i.artifact_id),
dated AS (SELECT *, NOT referenced AND newest < {sql.NOW} - INTERVAL {t.RETENTION_DAYS} DAY AS expired FROM cands),
kept AS (SELECT *, sum(CASE WHEN expired THEN 0 ELSE size END) OVER (PARTITION BY project_id) AS left_after,
                coalesce(sum(CASE WHEN NOT expired AND NOT referenced THEN size END) OVER (PARTITION BY project_id
                  ORDER BY newest, artifact_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS prior FROM dated),
gc AS (SELECT *, expired OR (NOT referenced AND left_after - prior > {t.QUOTA}) AS deleted FROM kept)"""

_PRUNE = f"""WITH {sql.LEDGER},
act AS (SELECT project_id, max(CASE WHEN is_active THEN generation END) AS active_generation, count(*) AS n FROM ledger GROUP BY 1),
counted AS (SELECT l.*, active_generation, coalesce(l.generation < active_generation, false) AS older,
      row_number() OVER (PARTITION BY l.project_id ORDER BY l.generation) <= n - {t.GENERATION_RETENTION} AS surplus
   FROM ledger l JOIN act USING (project_id)),
byte_ AS (SELECT *, older AND surplus AS by_count FROM counted),
rest AS (SELECT *, sum(CASE WHEN by_count THEN 0 ELSE bytes END) OVER (PARTITION BY project_id) AS remaining,
      coalesce(sum(CASE WHEN by_count OR NOT older THEN 0 ELSE bytes END) OVER (PARTITION BY project_id ORDER BY generation
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS prior FROM byte_),
pruned AS (SELECT *, by_count OR (older AND remaining - prior > {t.GENERATION_QUOTA}) AS deleted FROM rest)"""

_COMPONENTS = f"""WITH {sql.OPLOG},
comp AS (SELECT session_id AS project_id, op, bool_or(ok) AS available,
     max(duration_ms) > 280 AS bad FROM oplog GROUP BY 1, 2),
fails AS (SELECT session_id AS project_id, least(count(*), 20) AS f FROM oplog WHERE op = 'archive' AND duration_ms > 150 GROUP BY 1),
roll AS (SELECT project_id, count(*) AS components, count_if(available)::BIGINT AS available, bool_or(bad) AS bad FROM comp GROUP BY 1),
status AS (SELECT project_id, coalesce(components, 0) AS components, coalesce(available, 0) AS available, coalesce(f, 0)::BIGINT AS failures,
     coalesce(bad, false) OR f IS NOT NULL AS degraded FROM roll FULL JOIN fails USING (project_id))"""


def _sum(op: str, value: str) -> str:
    return f"coalesce(sum({value}) FILTER (op = '{op}'), 0)"


def _n(op: str, extra: str = "true") -> str:
    return f"count(*) FILTER (op = '{op}' AND {extra})"


ORACLES = {
    "message_texts": f"""WITH {sql.MESSAGES}, {_BYTES} SELECT session_id, msg_idx, sha256(text) AS text_hash, bytes,
        CASE WHEN role = 'assistant' THEN 2 ELSE 1 END::BIGINT AS blocks_after, {_SHORT} AS bytes_after FROM sized""",
    "paired_results": f"""WITH {sql.MESSAGES} SELECT session_id, msg_idx, tool_call_id FROM msgs r WHERE role = 'toolResult' AND EXISTS (
        SELECT 1 FROM msgs a WHERE a.session_id = r.session_id AND a.role = 'assistant' AND 'call-' || (a.msg_idx + 1) = r.tool_call_id)""",
    "lookup_by_call": f"""WITH {sql.sanitized(sql.RESULTS)}, {sql.MESSAGES} SELECT m.session_id, m.msg_idx, observation_id, original_bytes
        FROM msgs m LEFT JOIN sane s ON s.session_id = m.session_id AND s.tool_call_id = m.tool_call_id WHERE role <> 'assistant'""",
    "hot_set": f"""WITH {sql.MESSAGES}, r AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY msg_idx DESC) AS n
        FROM msgs WHERE role = 'toolResult') SELECT session_id, min(msg_idx) AS hot_from FROM r WHERE n <= 2 GROUP BY 1""",
    "context_pressure": f"""WITH {sql.MESSAGES}, {_BYTES}, {_PRESSURE}
        SELECT session_id, total_bytes, tokens_before, target_tokens::DOUBLE AS target_tokens, triggered FROM est""",
    "reduce_context": f"""{_REDUCED} SELECT m.session_id, m.msg_idx, m.role, c.receipt IS NOT NULL AS reduced,
        sha256(coalesce(c.receipt, m.text)) AS text_hash, c.receipt IS NOT NULL AS is_receipt
        FROM msgs m LEFT JOIN chosen c ON c.session_id = m.session_id AND c.msg_idx = m.msg_idx""",
    "reduction_report": f"""{_REDUCED}, g AS (SELECT session_id, count(*) AS n, sum(saving) AS saved FROM chosen GROUP BY 1)
        SELECT session_id, triggered, ceil((total_bytes - coalesce(saved, 0)) / 3.0) <= target_tokens AS target_reached,
               coalesce(n, 0) AS reduced_count, tokens_before, ceil((total_bytes - coalesce(saved, 0)) / 3.0)::BIGINT AS tokens_after
        FROM est LEFT JOIN g USING (session_id)""",
    "turns": f"WITH {_TURNS} SELECT session_id, msg_idx, turn FROM turned",
    "asof_query": rf"""WITH {_SPOKEN}, clean AS (SELECT *, regexp_replace(text, '^[{sql.SPACE}]+|[{sql.SPACE}]+$', '', 'g') AS q FROM spoken),
        c AS (SELECT * FROM spoken WHERE role = 'assistant')
        SELECT c.session_id, c.msg_idx::VARCHAR AS call_id, sha256(coalesce((SELECT arg_max(substr(u.q, 1, 512), u.msg_idx) FROM clean u
          WHERE u.session_id = c.session_id AND u.role = 'user' AND u.q <> '' AND u.msg_idx < c.msg_idx), 'repository structure')) AS query_hash
        FROM c""",
    "rebuild_epochs": f"""WITH {_SPOKEN} SELECT session_id, msg_idx AS call_idx, (sum(CASE WHEN strlen(text) > 600 THEN 1 ELSE 0 END)
        OVER (PARTITION BY session_id ORDER BY msg_idx))::BIGINT AS epoch FROM spoken""",
    "freeze_per_turn": f"""WITH {_TURNS}, e AS (SELECT *, sum(CASE WHEN strlen(text) > 600 THEN 1 ELSE 0 END)
          OVER (PARTITION BY session_id ORDER BY msg_idx) AS epoch FROM turned)
        SELECT session_id, msg_idx AS call_idx, sha256(first_value(text) OVER w) AS capsule, msg_idx = first_value(msg_idx) OVER w AS built
        FROM e WINDOW w AS (PARTITION BY session_id, turn, epoch ORDER BY msg_idx)""",
    "insert_capsules": f"""WITH {_SPOKEN}, p AS (SELECT session_id, coalesce(max(msg_idx) FILTER (role = 'user') + 1, 0) AS pos FROM spoken GROUP BY 1)
        SELECT session_id, msg_idx + (CASE WHEN msg_idx >= pos THEN 1 ELSE 0 END) AS msg_idx, role, sha256(text) AS text_hash
        FROM spoken JOIN p USING (session_id)
        UNION ALL SELECT session_id, pos, 'custom', sha256('capsule ' || session_id) FROM p""",
    "drop_capsules": f"WITH {_SPOKEN} SELECT session_id, msg_idx, role FROM spoken WHERE role <> 'system'",
    "counters": f"""WITH {sql.OPLOG} SELECT session_id, {_n('capsule_build')} AS capsule_build_count,
        {_n('automatic_query')} AS map_automatic_query_count, {_n('map_query')} AS map_query_count,
        round({_sum('map_query', 'duration_ms')}, 4)::DOUBLE AS map_query_duration_ms_total,
        {_n('ensure_fresh')} AS ensure_fresh_count, round({_sum('ensure_fresh', 'duration_ms')}, 4)::DOUBLE AS ensure_fresh_duration_ms_total,
        {_n('reindex')} AS files_reindexed, {_n('index_build')} AS search_index_build_count,
        {_n('generation')} AS generation_created_count, {_sum('generation', 'bytes')}::BIGINT AS generation_bytes_written,
        {_n('maintenance_failure')} AS maintenance_failure_count, {_n('archive')} AS archive_attempt_count,
        {_n('archive', 'ok')} AS archive_success_count, {_n('archive', 'NOT ok')} AS archive_failure_count,
        {_n('archive', 'ok AND deduplicated')} AS archive_deduplicated_count,
        round({_sum('archive', 'duration_ms')}, 4)::DOUBLE AS archive_duration_ms_total,
        round({_sum('metadata_read', 'duration_ms')}, 4)::DOUBLE AS metadata_read_duration_ms_total,
        round({_sum('metadata_write', 'duration_ms')}, 4)::DOUBLE AS metadata_write_duration_ms_total,
        {_n('reduction')} AS reduction_invocation_count, {_n('reduction', 'triggered')} AS reduction_triggered_count,
        {_sum('reduction', 'reduced_count')}::BIGINT AS reduced_observation_count,
        {_sum('reduction', 'tokens_before')}::BIGINT AS estimated_tokens_before_total,
        {_sum('reduction', 'tokens_after')}::BIGINT AS estimated_tokens_after_total,
        {_n('reduction', 'target_reached')} AS target_reached_count,
        round({_sum('reduction', 'duration_ms')}, 4)::DOUBLE AS reduction_duration_ms_total FROM oplog GROUP BY 1""",
    "telemetry": f"""WITH {sql.OPLOG}, b AS (SELECT session_id, content_hash, lag(content_hash) OVER (PARTITION BY session_id ORDER BY seq) AS p
          FROM oplog WHERE op = 'capsule_build'),
        h AS (SELECT session_id, count_if(p <> content_hash)::BIGINT AS changes FROM b GROUP BY 1)
        SELECT session_id, {_n('capsule_build')} AS capsule_build_count,
          coalesce(arg_max(bytes, seq) FILTER (op = 'capsule_build'), 0) AS capsule_bytes,
          coalesce(arg_max(insertion_index, seq) FILTER (op = 'capsule_build'), 0) AS capsule_insertion_index,
          coalesce(any_value(changes), 0) AS capsule_hash_change_count, {_sum('generation', 'bytes')}::BIGINT AS generation_bytes_written,
          {_sum('generation', 'bytes')}::BIGINT AS map_total_bytes, {_n('archive')} AS archive_attempt_count
        FROM oplog LEFT JOIN h USING (session_id) GROUP BY 1""",
    "status": f"{_COMPONENTS} SELECT * FROM status",
    "health": f"{_COMPONENTS} SELECT project_id, CASE WHEN degraded THEN 'degraded' ELSE 'healthy' END AS health FROM status",
    "bounded_failures": f"""WITH {sql.OPLOG}, r AS (SELECT session_id AS project_id, seq,
          row_number() OVER (PARTITION BY session_id ORDER BY seq DESC) AS rank FROM oplog WHERE NOT ok)
        SELECT project_id, seq, rank, least(512, strlen(repeat(project_id || ' ', 100)))::BIGINT AS error_bytes FROM r WHERE rank <= 20""",
    "gc_candidates": f"{_GC} SELECT project_id, artifact_id, size, epoch_us(newest) AS newest_us, referenced FROM cands",
    "newest_timestamps": f"{_GC} SELECT artifact_id, epoch_us(updated_at) AS updated_us FROM meta",
    "collect_garbage": f"{_GC} SELECT project_id, artifact_id, expired, deleted FROM gc",
    "gc_report": f"""{_GC} SELECT project_id, count_if(deleted)::BIGINT AS deleted_artifacts,
        coalesce(sum(size) FILTER (deleted), 0)::BIGINT AS bytes_freed, coalesce(sum(size) FILTER (NOT deleted), 0)::BIGINT AS remaining_bytes,
        coalesce(sum(size) FILTER (NOT deleted), 0) <= {t.QUOTA} AS quota_satisfied FROM gc GROUP BY 1""",
    "gc_metadata": f"""{_GC} SELECT m.project_id, count(*) AS records FROM meta m JOIN gc USING (project_id, artifact_id)
        WHERE NOT deleted GROUP BY 1""",
    "prune_generations": f"{_PRUNE} SELECT project_id, generation, active_generation, deleted FROM pruned",
    "maintenance": f"""{_PRUNE} SELECT project_id, max(active_generation) AS active_generation, count_if(deleted)::BIGINT AS deleted_generations,
        coalesce(sum(bytes) FILTER (deleted), 0)::BIGINT AS bytes_freed, count_if(NOT deleted)::BIGINT AS remaining_generations,
        coalesce(sum(bytes) FILTER (NOT deleted), 0)::BIGINT AS remaining_bytes,
        coalesce(sum(bytes) FILTER (NOT deleted), 0) <= {t.GENERATION_QUOTA} AS quota_satisfied FROM pruned GROUP BY 1""",
    "suppress_noops": f"""WITH {sql.LEDGER}, p AS (SELECT *, lag(event_type) OVER (PARTITION BY project_id ORDER BY generation) AS before FROM ledger)
        SELECT project_id, generation, event_type FROM p WHERE before IS NULL OR before <> event_type""",
    "latest_per_path": f"""WITH {sql.CHANGES} SELECT project_id, path, arg_max(event, struct_pack(ts := ts, seq := seq)) AS event,
        arg_max(seq, struct_pack(ts := ts, seq := seq)) AS seq FROM changes GROUP BY 1, 2""",
    "drain_batches": f"""WITH {sql.CHANGES} SELECT project_id, seq, ((row_number() OVER (PARTITION BY project_id ORDER BY seq) + 15) // 16)::BIGINT AS batch
        FROM changes""",
    "debounce": f"""WITH {sql.CHANGES}, g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM changes
          WINDOW w AS (PARTITION BY project_id ORDER BY ts)),
        s AS (SELECT *, sum(fresh) OVER (PARTITION BY project_id ORDER BY ts, seq) AS n FROM g)
        SELECT project_id, epoch_us(min(ts)) AS started_us, epoch_us(max(ts) + INTERVAL 6 HOUR) AS ended_us, count(*) AS changes
        FROM s GROUP BY project_id, n""",
}
