"""Sources, sinks, generations, capsules and streams over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from obsframe.functions import text as fx
from obsframe.operators import archive as ar
from obsframe.operators import overlay as ov
from obsframe.operators import turns as tn
from obsframe.params import Params
from obsframe.plans import archive as aplans
from obsframe.plans import rebuild as rb
from obsframe.plans import workspace as ws
from obsframe.schemas import MESSAGES
from obsframe.session import scratch
from obsframe.sources import generations as gen
from obsframe.sources import tables as src
from obsframe.streaming import archive as sa
from obsframe.streaming import changes as sc

from . import context, corpus, sql, tables as t

CAPSULE_BYTES = 2048


def _json_lines(spark, sf_dir, broken=False):
    root = scratch(spark)
    metadata, _ = aplans.archive(t.observations(spark, sf_dir), t.now())
    lines = src.metadata_json(metadata)
    if broken:
        size = F.get_json_object("value", "$.sanitizedBytes").cast("long")
        lines = lines.withColumn(
            "value",
            F.when(size < 200, F.regexp_replace("value", '"contentHash":"..', '"contentHash":"00'))
            .when(size < 400, F.regexp_replace("value", '"originalBytes":', '"originalBytes":0.5e0'))
            .when(size < 600, F.regexp_replace("value", '"schemaVersion":1', '"schemaVersion":2'))
            .when(size < 800, F.regexp_replace("value", "}$", ""))
            .when(size < 1000, F.lit("  "))
            .otherwise(F.col("value")),
        )
    lines.write.text(root)
    return root


def read_metadata(spark, sf_dir):
    return src.read_metadata(spark, _json_lines(spark, sf_dir)).select(
        "observation_id", "artifact_id", "tool_call_id", "tool_name", "session_id", "original_bytes", "sanitized_bytes",
        "redaction_count", F.date_format("created_at", "yyyy-MM-dd").alias("created"),
    )


def metadata_quarantine(spark, sf_dir):
    good, bad = src.read_metadata(spark, _json_lines(spark, sf_dir, broken=True), mode="quarantine")
    return bad.groupBy("reason").agg(F.count(F.lit(1)).alias("n")).unionByName(
        good.agg(F.count(F.lit(1)).alias("n")).select(F.lit("valid").alias("reason"), "n")
    )


def write_artifacts(spark, sf_dir):
    """Stored twice under the same batch and once more under another: nothing is stored twice."""
    root = scratch(spark)
    _, found = aplans.archive(t.observations(spark, sf_dir), t.now())
    found = found.withColumn("modified_at", t.now())
    for batch in (1, 1, 2):
        src.write_artifacts(found, root, batch)
    return src.artifact_inventory(src.read_artifacts(spark, root)).groupBy("project_id").agg(
        F.count(F.lit(1)).alias("artifacts"), F.sum("size").alias("bytes")
    )


def read_corpus(spark, sf_dir):
    """The given tables themselves as a folder of binary files."""
    t.table(spark, sf_dir, "region")
    return src.read_corpus(spark, sf_dir, "tables").select(
        "project_id", "path", "size_bytes", "content_hash"
    )


def read_messages(spark, sf_dir):
    root = scratch(spark)
    names = [c for c in MESSAGES.fieldNames() if c != "custom_type"]
    t.messages(spark, sf_dir).select(*names).write.json(root)
    m = src.read_messages(spark, root, "json")
    return m.select("session_id", "msg_idx", "role", "tool_call_id", fx.sha256(fx.block_text("content")).alias("text_hash"))


# --- generations -------------------------------------------------------------------------------------


def _state(spark, sf_dir, curated):
    if curated:
        return corpus._workspace(spark, sf_dir)
    files = corpus._records(spark, sf_dir)
    outcomes = files.select("project_id", "path", F.lit("indexed").alias("outcome"), "content_hash")
    warnings = outcomes.filter(F.lit(False)).select("project_id", "path", F.lit("").alias("code"), F.lit("").alias("message"))
    return ws.overlay(files, {"files": files, "warnings": warnings, "outcomes": outcomes}, corpus._heads(spark, sf_dir))


def _full(workspace):
    """File records with every column of the snapshot schema."""
    files = workspace.files.withColumns(
        {
            "language": F.lit("text"),
            "size_bytes": F.lit(1).cast("long"),
            "package_name": F.lit(None).cast("string"),
        }
    )
    return workspace._replace(files=files)


def _published(spark, sf_dir):
    root = scratch(spark)
    sf_dir = t.spread(spark, sf_dir, "documents", "labels", "benchmark")
    heads = corpus._heads(spark, sf_dir)
    first = ws.stage(_full(_state(spark, sf_dir, False)))
    for state in (first, first, ws.stage(_full(_state(spark, sf_dir, True)))):  # the second adds nothing
        gen.publish_generation(state, heads, root, t.now())
    return root


def publish_generation(spark, sf_dir):
    root = _published(spark, sf_dir)
    active = gen.read_active(spark, root)
    files = active["files"].groupBy("project_id").agg(F.count(F.lit(1)).alias("files"), F.max("content_hash").alias("max_hash"))
    dirty = active["dirty"].groupBy("project_id").agg(F.count(F.lit(1)).alias("dirty"))
    return (
        active["generation"]
        .join(files, "project_id", "left")
        .join(dirty, "project_id", "left")
        .select("project_id", "generation", "workspace_revision", "freshness", "files", "max_hash", "dirty")
    )


def hydrate(spark, sf_dir):
    root = _published(spark, sf_dir)
    projects = corpus._heads(spark, sf_dir).select("project_id").unionByName(
        t.table(spark, sf_dir, "documents").select(F.concat(F.lit("new-"), "lang").alias("project_id"))
    )
    return gen.hydrate(spark, root, projects)


def prune(spark, sf_dir):
    """Two generations per project, one to keep: the report of the pruning, and what is left."""
    root = _published(spark, sf_dir)
    report = gen.prune(spark, root, 1, 10**12)
    left = gen.read_generations(spark, root).groupBy("project_id").agg(F.min("generation").alias("lowest_left"))
    return report.join(left, "project_id").select(
        "project_id", "active_generation", "deleted_generations", "remaining_generations", "quota_satisfied", "lowest_left"
    )


def rebuild(spark, sf_dir):
    """Pages indexed and published, then again without a change: one generation each."""
    root = scratch(spark)
    files = corpus._raw(spark, sf_dir).drop("page_id").dropDuplicates(["project_id", "path"])
    heads = files.select("project_id").distinct().withColumn("head", F.lit("h"))
    for _ in range(2):
        rb.rebuild(files, heads, root, t.now(), ["*5"], ["fr/**"])
    active = gen.read_active(spark, root)
    files_ = active["files"].groupBy("project_id").agg(F.count(F.lit(1)).alias("files"))
    return active["generation"].join(files_, "project_id", "left").select("project_id", "generation", "freshness", "files")


def _map(spark, sf_dir):
    files = corpus._records(spark, sf_dir, together=True)
    heads = files.select("project_id").distinct().withColumn("head", F.concat(F.lit("head-"), "project_id"))
    outcomes = files.select("project_id", "path", F.lit("indexed").alias("outcome"), "content_hash")
    warnings = outcomes.filter(F.lit(False)).select("project_id", "path", F.lit("").alias("code"), F.lit("").alias("message"))
    return ws.overlay(files, {"files": files, "warnings": warnings, "outcomes": outcomes}, heads), heads


def query_map(spark, sf_dir):
    return _mapped(spark, sf_dir, t.search_queries(spark, sf_dir))


def query_map_passages(spark, sf_dir):
    return _mapped(spark, sf_dir, t.passages(spark, sf_dir))


def _mapped(spark, sf_dir, asked):
    state = ws.stage(_map(spark, sf_dir)[0])
    found = ws.query_map(state, asked, limit=5)
    return found["results"].join(found["state"], ["project_id", "query_id"]).select(
        "query_id", F.col("rank").cast("long").alias("rank"), "path", "score", "freshness", "workspace_revision"
    )


def _calls(spark, sf_dir):
    return context._calls(spark, sf_dir).withColumn("epoch", F.lit(0))


def capsules(spark, sf_dir):
    """Capsules of every model call in the conversations, over the documents as their corpus."""
    state, heads = _map(spark, sf_dir)
    state = ws.stage(state)
    params = Params(map_context_max_bytes=CAPSULE_BYTES)
    # Conversations belong to the project of the documents.
    here = F.substring(F.concat(F.lit("src"), "session_id"), 1, 3)
    spoken = t.spoken(spark, sf_dir).withColumn("project_id", here)
    out = ws.capsules(spoken, _calls(spark, sf_dir).withColumn("project_id", here), state, heads, 1, params)
    body = F.substring("capsule", len(tn.CAPSULE_HEADER) + 1, CAPSULE_BYTES)
    return out.select(
        "session_id", "call_id", "built", (fx.byte_len("capsule") <= CAPSULE_BYTES).alias("within"),
        F.get_json_object(body, "$.freshness").alias("freshness"), fx.sha256(F.get_json_object(body, "$.asked")).alias("query_hash"),
    )


def fit_capsule(spark, sf_dir):
    """Every document as a payload: its lines as pending files, its text as query and evidence."""
    d = t.table(spark, sf_dir, "documents")
    lines = F.split("text", "\n")
    out = tn.fit_capsule(
        d.select(
            "doc_id", F.substring("text", 1, 512).alias("query"),
            F.when(F.col("lang") == "en", "fresh").otherwise("stale").alias("freshness"), F.lit(1).alias("generation"),
            F.lit("head").alias("head"), fx.sha256("text").alias("workspace_revision"), lines.alias("pending_files"),
            F.transform(lines, lambda l: F.struct(l.alias("path"), F.lit("lexical").alias("kind"))).alias("results"),
            F.array(
                F.struct(F.lit("source").alias("kind"), F.col("source").alias("path"), F.col("text").alias("excerpt"))
            ).alias("evidence"),
            F.lit(None).cast("string").alias("error"),
        ),
        CAPSULE_BYTES,
    )
    body = F.substring("capsule", len(tn.CAPSULE_HEADER) + 1, CAPSULE_BYTES)
    return out.select(
        "doc_id", (fx.byte_len("capsule") <= CAPSULE_BYTES).alias("within"), F.get_json_object(body, "$.freshness").alias("freshness"),
        F.get_json_object(body, "$.revision").alias("revision"),
    )


# --- streams -----------------------------------------------------------------------------------------


def _stream(spark, sf_dir, name):
    schema = t.table(spark, sf_dir, name).schema
    # A pattern takes a table of one file and a folder of files alike; a plain path has to be a folder.
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/{name}.parque[t]")


def _run(writer):
    query = writer.trigger(availableNow=True).start()
    query.awaitTermination()


def archive_stream(spark, sf_dir):
    """Documents as a stream; every label row arrives as an observation without a session and is set aside."""
    root = scratch(spark)
    rows = _stream(spark, sf_dir, "documents").select(
        F.col("source").alias("project_id"),
        F.when(F.col("n_chars") < 100, "").otherwise(F.col("source")).alias("session_id"),
        F.col("doc_id").cast("string").alias("tool_call_id"),
        F.col("lang").alias("tool_name"),
        "text",
        F.lit(False).alias("is_error"),
        F.col("doc_id").alias("seq"),
    )
    params = Params(archive_threshold_bytes=t.THRESHOLD, receipt_max_bytes=t.RECEIPT_MAX)
    _run(sa.archive_stream(rows, root, f"{root}/checkpoint", params))
    metadata, found = sa.read_archive(spark, root)
    # A stream may set nothing aside: then there is no such folder.
    outputs = src.read_or_empty(spark, f"{root}/outputs", "project_id string, replaced boolean")
    outputs = outputs.groupBy("project_id").agg(F.count_if("replaced").alias("replaced"))
    sizes = found.groupBy("project_id").agg(F.count(F.lit(1)).alias("artifacts"), F.sum("size").alias("bytes"))
    dead = src.read_or_empty(spark, f"{root}/dead_letters", "project_id string").groupBy("project_id").agg(
        F.count(F.lit(1)).alias("set_aside")
    )
    return (
        metadata.groupBy("project_id")
        .agg(F.count(F.lit(1)).alias("observations"), F.sum("redaction_count").alias("redactions"))
        .join(sizes, "project_id")
        .join(outputs, "project_id")
        .join(dead, "project_id", "left")
        .fillna(0, ["set_aside"])
    )


def archive_stream_dedup(spark, sf_dir):
    """Events as observations of one call per (user, key): repeats inside ten days are dropped before the sink."""
    root = scratch(spark)
    rows = _stream(spark, sf_dir, "events").select(
        F.concat(F.lit("user-"), "user_id").alias("project_id"),
        F.col("event_type").alias("session_id"),
        F.get_json_object("props", "$.k").alias("tool_call_id"),
        F.lit("log").alias("tool_name"),
        F.concat("event_type", F.lit(" "), F.col("props")).alias("text"),
        F.lit(False).alias("is_error"),
        F.col("event_id").alias("seq"),
        F.col("ts").cast("timestamp").alias("ts"),
    )
    _run(sa.archive_stream(rows, root, f"{root}/checkpoint", watermark=("ts", "10 days")))
    metadata, found = sa.read_archive(spark, root)
    return metadata.groupBy("project_id").agg(F.count(F.lit(1)).alias("observations")).join(
        found.groupBy("project_id").agg(F.count(F.lit(1)).alias("artifacts")), "project_id"
    )


def _change_stream(spark, sf_dir):
    kind = F.when(F.col("event_type") == "signup", "add").when(F.col("event_type") == "error", "unlink").otherwise("change")
    return _stream(spark, sf_dir, "events").select(
        F.concat(F.lit("user-"), F.col("user_id")).alias("project_id"),
        F.concat(F.lit("src/"), F.get_json_object("props", "$.k")).alias("path"),
        kind.alias("event"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.col("event_id").alias("seq"),
        F.lit(None).cast("binary").alias("content"),
    )


def overlay_stream(spark, sf_dir):
    root = scratch(spark)
    _run(sc.overlay_stream(_change_stream(spark, sf_dir), root, f"{root}/checkpoint"))
    return sc.read_overlay(spark, root).select("project_id", "path", "event", "seq", "deleted")


def drain_stream(spark, sf_dir):
    """Changes in two halves, a run of the stream for each: 20 paths a project are applied by each, the rest waits."""
    root = scratch(spark)
    rows = t.changes(spark, sf_dir).withColumn("content", F.lit(None).cast("binary"))
    middle = t.events(spark, sf_dir).agg(F.expr("max(event_id) div 2")).first()[0]
    for half in (F.col("seq") <= middle, F.col("seq") > middle):
        rows.filter(half).write.mode("append").parquet(f"{root}/in")
        changes = src.read_changes(spark, f"{root}/in", max_files=1 << 20)
        _run(sc.drain_stream(changes, root, f"{root}/checkpoint", passes=2, size=10))
    columns = ["project_id", "path", "event", "seq"]
    applied = sc.read_overlay(spark, root).select(*columns, F.lit("applied").alias("state"))
    return applied.unionByName(sc.read_pending(spark, root).select(*columns, F.lit("pending").alias("state")))


def debounce_stream(spark, sf_dir):
    """Closed batches only: the last batch of a project may still grow when the stream ends."""
    root = scratch(spark)
    batches = sc.debounce_stream(_change_stream(spark, sf_dir), "6 hours", "1 hour")
    _run(
        batches.writeStream.option("checkpointLocation", f"{root}/checkpoint").outputMode("append").format("parquet").option("path", f"{root}/out")
    )
    return spark.read.parquet(f"{root}/out").groupBy("project_id").agg(
        F.count(F.lit(1)).alias("batches"), F.sum("changes").alias("changes")
    )


def telemetry_stream(spark, sf_dir):
    root = scratch(spark)
    log = _stream(spark, sf_dir, "events").select(
        F.concat(F.lit("user-"), F.col("user_id")).alias("session_id"),
        F.when(F.col("event_type") == "error", "archive").otherwise("map_query").alias("op"),
        F.col("value").alias("duration_ms"),
        (F.col("value") < 20).alias("ok"),
        F.lit(False).alias("deduplicated"),
        F.lit(0).cast("long").alias("bytes"),
        F.lit(False).alias("triggered"),
        F.lit(0).alias("reduced_count"),
        F.lit(0).cast("long").alias("tokens_before"),
        F.lit(0).cast("long").alias("tokens_after"),
        F.lit(False).alias("target_reached"),
    )

    def keep(batch, batch_id):
        batch.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").option(
            "partitionOverwriteMode", "dynamic"
        ).partitionBy("batch_id").parquet(f"{root}/out")

    _run(
        sc.telemetry_stream(log).writeStream.outputMode("update").option("checkpointLocation", f"{root}/checkpoint").foreachBatch(keep)
    )
    latest = spark.read.parquet(f"{root}/out")
    names = ["archive_attempt_count", "archive_success_count", "map_query_count"]
    return latest.groupBy("session_id").agg(*[F.max_by(n, "batch_id").alias(n) for n in names])


QUERIES = {
    f.__name__: f
    for f in (
        read_metadata, metadata_quarantine, write_artifacts, read_corpus, read_messages, publish_generation, hydrate, prune,
        rebuild, query_map, query_map_passages, capsules, fit_capsule, archive_stream, archive_stream_dedup, overlay_stream, drain_stream, debounce_stream,
        telemetry_stream,
    )
}

_SANE = f"WITH {sql.sanitized()}"
_REV = corpus._revision
_ACTIVE = f"""{corpus._CURRENT}, fx AS (SELECT project_id, path, content_hash AS h FROM cur WHERE outcome = 'indexed'
      UNION ALL SELECT b.* FROM base b JOIN cur USING (project_id, path) WHERE outcome = 'read-error'),
    dirty AS (SELECT project_id, path, dirty_hash AS hash FROM diff WHERE dirty_hash IS NOT NULL
      UNION ALL SELECT p.project_id, p.path, p.h FROM prev p JOIN cur USING (project_id, path) WHERE outcome = 'read-error'),
    rev AS ({_REV("SELECT * FROM dirty")}),
    same AS (SELECT h.project_id, NOT EXISTS (SELECT 1 FROM ((FROM base EXCEPT FROM fx) UNION ALL (FROM fx EXCEPT FROM base)) d
        WHERE d.project_id = h.project_id) AND h.project_id NOT IN (SELECT project_id FROM dirty)
        AND h.project_id NOT IN (SELECT project_id FROM cur WHERE outcome = 'read-error') AS same
      FROM (SELECT DISTINCT project_id FROM base) h),
    active AS (SELECT project_id, CASE WHEN same THEN 1 ELSE 2 END::BIGINT AS generation, workspace_revision,
        CASE WHEN project_id IN (SELECT project_id FROM cur WHERE outcome = 'read-error') THEN 'stale'
             WHEN project_id IN (SELECT project_id FROM dirty) THEN 'dirty' ELSE 'fresh' END AS freshness
      FROM same JOIN rev USING (project_id))"""

ORACLES = {
    "read_metadata": f"""{_SANE} SELECT observation_id, artifact_id, tool_call_id, tool_name, session_id, original_bytes,
        sanitized_bytes, redactions AS redaction_count, '2024-01-31' AS created FROM sane""",
    "metadata_quarantine": f"""{_SANE} SELECT CASE WHEN sanitized_bytes < 200 AND NOT starts_with(artifact_id, '00') THEN 'content hash differs from artifact id'
        WHEN sanitized_bytes < 200 THEN 'valid' WHEN sanitized_bytes < 400 THEN 'missing or mistyped field'
        WHEN sanitized_bytes < 600 THEN 'unsupported schema version' WHEN sanitized_bytes < 800 THEN 'not JSON' ELSE 'valid' END AS reason,
        count(*) AS n FROM sane WHERE sanitized_bytes NOT BETWEEN 800 AND 999 GROUP BY 1""",
    "write_artifacts": f"""{_SANE} SELECT project_id, count(*) AS artifacts, sum(b)::BIGINT AS bytes
        FROM (SELECT project_id, artifact_id, any_value(sanitized_bytes) AS b FROM sane GROUP BY 1, 2) GROUP BY 1""",
    "read_messages": f"""WITH {sql.MESSAGES} SELECT session_id, msg_idx, role, tool_call_id, sha256(text) AS text_hash FROM msgs""",
    "publish_generation": f"""{_ACTIVE} SELECT a.*, f.files, f.max_hash, d.dirty FROM active a
        LEFT JOIN (SELECT project_id, count(*) AS files, max(h) AS max_hash FROM fx GROUP BY 1) f USING (project_id)
        LEFT JOIN (SELECT project_id, count(*) AS dirty FROM dirty GROUP BY 1) d USING (project_id)""",
    "hydrate": f"""{_ACTIVE} SELECT project_id, generation, 'head-' || project_id AS head, workspace_revision, freshness FROM active
        UNION ALL SELECT DISTINCT 'new-' || lang, 0, 'no-head', NULL, 'stale' FROM documents""",
    "prune": f"""{_ACTIVE} SELECT project_id, generation AS active_generation, generation - 1 AS deleted_generations,
        1::BIGINT AS remaining_generations, true AS quota_satisfied, generation AS lowest_left FROM active""",
    "query_map": corpus.ORACLES["search_corpus"].replace(
        "SELECT query_id, rank, path, score FROM ranked WHERE rank <= 10",
        "SELECT query_id, rank, path, score, 'fresh' AS freshness, sha256('head-src') AS workspace_revision FROM ranked WHERE rank <= 5",
    ),
    "capsules": rf"""WITH {context._TURNS}, clean AS (SELECT *, regexp_replace(text, '^[{sql.SPACE}]+|[{sql.SPACE}]+$', '', 'g') AS q FROM turned),
        c AS (SELECT session_id, msg_idx, turn, min(msg_idx) OVER (PARTITION BY session_id, turn) AS first_call FROM turned WHERE role = 'assistant')
        SELECT c.session_id, c.msg_idx::VARCHAR AS call_id, c.msg_idx = first_call AS built, true AS within, 'fresh' AS freshness,
          sha256(coalesce((SELECT arg_max(substr(u.q, 1, 512), u.msg_idx) FROM clean u WHERE u.session_id = c.session_id
            AND u.role = 'user' AND u.q <> '' AND u.msg_idx < first_call), 'repository structure')) AS query_hash FROM c""",
    "fit_capsule": """SELECT doc_id, true AS within, CASE WHEN lang = 'en' THEN 'fresh' ELSE 'stale' END AS freshness, sha256(text) AS revision FROM documents""",
    "archive_stream": f"""{_SANE}, ok AS (SELECT * FROM sane WHERE NOT is_error),
        a AS (SELECT project_id, count(*) AS artifacts, sum(b)::BIGINT AS bytes FROM (
          SELECT project_id, artifact_id, any_value(sanitized_bytes) AS b FROM ok GROUP BY 1, 2) GROUP BY 1),
        s AS (SELECT project_id, count(*) AS set_aside FROM sane WHERE is_error GROUP BY 1)
        SELECT project_id, count(*) AS observations, sum(redactions)::BIGINT AS redactions, any_value(artifacts) AS artifacts,
          any_value(bytes) AS bytes, count_if(original_bytes > {t.THRESHOLD})::BIGINT AS replaced, coalesce(any_value(set_aside), 0) AS set_aside
        FROM ok JOIN a USING (project_id) LEFT JOIN s USING (project_id) GROUP BY 1""",
    "archive_stream_dedup": """SELECT 'user-' || user_id AS project_id, count(DISTINCT event_type || props) AS observations,
        count(DISTINCT event_type || props) AS artifacts FROM events GROUP BY 1""",
    "drain_stream": f"""WITH {sql.CHANGES}, m AS (SELECT max(event_id) // 2 AS middle FROM events),
        q1 AS (SELECT project_id, path, min(seq) AS queued, max(struct_pack(ts := ts, seq := seq, event := event)) AS e
               FROM changes, m WHERE seq <= middle GROUP BY 1, 2),
        n1 AS (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY queued, path) AS place FROM q1),
        q2 AS (SELECT project_id, path, min(queued) AS queued, max(e) AS e FROM (
                 SELECT project_id, path, queued, e FROM n1 WHERE place > 20 UNION ALL
                 SELECT project_id, path, seq, struct_pack(ts := ts, seq := seq, event := event) FROM changes, m WHERE seq > middle) GROUP BY 1, 2),
        n2 AS (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY queued, path) AS place FROM q2),
        a AS (SELECT project_id, path, max(e) AS e FROM (SELECT project_id, path, e FROM n1 WHERE place <= 20
                 UNION ALL SELECT project_id, path, e FROM n2 WHERE place <= 20) GROUP BY 1, 2)
        SELECT project_id, path, e.event AS event, e.seq AS seq, 'applied' AS state FROM a
        UNION ALL SELECT project_id, path, e.event, e.seq, 'pending' FROM n2 WHERE place > 20""",
    "overlay_stream": f"""WITH {sql.CHANGES}, l AS (SELECT project_id, path, arg_max(event, struct_pack(ts := ts, seq := seq)) AS event,
        arg_max(seq, struct_pack(ts := ts, seq := seq)) AS seq FROM changes GROUP BY 1, 2) SELECT *, event = 'unlink' AS deleted FROM l""",
    "debounce_stream": f"""WITH {sql.CHANGES}, g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM changes
          WINDOW w AS (PARTITION BY project_id ORDER BY ts)),
        s AS (SELECT *, sum(fresh) OVER (PARTITION BY project_id ORDER BY ts, seq) AS n FROM g),
        b AS (SELECT project_id, n, max(ts) + INTERVAL 6 HOUR AS ended, count(*) AS c FROM s GROUP BY 1, 2)
        SELECT project_id, count(*) AS batches, sum(c)::BIGINT AS changes FROM b
        WHERE ended <= (SELECT max(ts) FROM changes) - INTERVAL 1 HOUR GROUP BY 1""",
    "telemetry_stream": """SELECT 'user-' || user_id AS session_id, count_if(event_type = 'error')::BIGINT AS archive_attempt_count,
        count_if(event_type = 'error' AND value < 20)::BIGINT AS archive_success_count, count_if(event_type <> 'error')::BIGINT AS map_query_count
        FROM events GROUP BY 1""",
}
ORACLES["query_map_passages"] = sql.asked_whole(ORACLES["query_map"])
