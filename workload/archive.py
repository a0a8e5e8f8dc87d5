"""Archive, receipts, lookups and search over documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from obsframe.functions import text as fx
from obsframe.operators import archive as ar
from obsframe.operators import retrieve as re
from obsframe.plans import archive as plans
from obsframe.session import scratch, staged
from obsframe.sources.tables import artifact_inventory

from . import sql, tables as t


def _sane(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ar.sanitize(t.observations(spark, sf_dir))


def redact(spark, sf_dir):
    return _sane(spark, sf_dir).select(
        F.col("seq").alias("doc_id"), "redactions", fx.sha256("sanitized").alias("sanitized_hash")
    )


def identifiers(spark, sf_dir):
    return _sane(spark, sf_dir).select(
        "tool_call_id",
        "observation_id",
        fx.project_id("session_id").alias("project_key"),
        fx.sha256("text").alias("text_hash"),
        fx.byte_len("text").alias("bytes"),
        fx.token_estimate(fx.byte_len("text")).alias("tokens"),
        (fx.is_obs_id("observation_id") & fx.is_obs_id("artifact_id") & ~fx.is_obs_id("tool_call_id")).alias("ids_ok"),
    )


def text_functions(spark, sf_dir):
    obs = t.observations(spark, sf_dir)
    return obs.select(
        "tool_call_id",
        fx.sha256(fx.clip_bytes("text", 100)).alias("clip_hash"),
        fx.sha256(fx.byte_slice("text", 0, 333)).alias("head_hash"),
        fx.sha256(fx.bounded_message("text")).alias("message_hash"),
        fx.sha256(fx.tool_label("text")).alias("label_hash"),
        fx.sha256(fx.trimmed("text")).alias("trimmed_hash"),
        fx.sha256(fx.excerpt("text", F.array(F.lit("x")))).alias("excerpt_hash"),
    )


def lexical_terms(spark, sf_dir):
    files = t.document_files(spark, sf_dir).withColumn("terms", fx.lexical_terms("path", "text"))
    return files.select(
        "doc_id", F.size("terms").cast("long").alias("terms"), fx.sha256(F.array_join("terms", " ")).alias("terms_hash")
    )


def eligible(spark, sf_dir):
    kept = ar.eligible(t.observations(spark, sf_dir), own_prefix="e")
    return kept.groupBy("tool_name").agg(F.count(F.lit(1)).alias("n"))


def dedup_content(spark, sf_dir):
    _, flagged = ar.dedup_content(_sane(spark, sf_dir))
    return flagged.select("observation_id", "artifact_id", "deduplicated")


def artifacts(spark, sf_dir):
    found, _ = ar.dedup_content(_sane(spark, sf_dir))
    return found.select("project_id", "artifact_id", "shard", "size", fx.sha256("content").alias("content_hash"))


def inventory_listing(spark, sf_dir):
    found, _ = ar.dedup_content(_sane(spark, sf_dir))
    listed = artifact_inventory(found.withColumn("modified_at", t.now()))
    return listed.groupBy(F.substring("artifact_id", 1, 1).alias("first_digit")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes")
    )


def archive_projection(spark, sf_dir):
    return ar.archive_projection(_sane(spark, sf_dir), t.now()).select(
        "observation_id", "artifact_id", "content_hash", "tool_name", "session_id", "original_bytes",
        "sanitized_bytes", "redaction_count", F.date_format("created_at", "yyyy-MM-dd").alias("created"),
    )


def upsert_latest(spark, sf_dir):
    """Every document archived once; labelled documents archived again later with their label as the tool."""
    first = ar.archive_projection(_sane(spark, sf_dir), t.now())
    labels = t.table(spark, sf_dir, "labels").select(
        F.col("doc_id").cast("string").alias("tool_call_id"),
        F.concat(F.lit("q"), "quality", F.lit("t"), "toxic").alias("_label"),
    )
    again = (
        first.join(labels, "tool_call_id")
        .withColumn("tool_name", F.col("_label"))
        .withColumn("seq", F.col("seq") + 1_000_000_000)
        .drop("_label")
    )
    merged = ar.upsert_latest(first, again, ["project_id", "observation_id"])
    return merged.select("observation_id", "tool_name", "position", F.col("seq").alias("latest_seq"))


def archive(spark, sf_dir):
    metadata, found = plans.archive(t.observations(spark, sf_dir), t.now())
    sizes = found.groupBy("project_id").agg(F.count(F.lit(1)).alias("artifacts"), F.sum("size").alias("bytes"))
    return metadata.groupBy("project_id").agg(
        F.count(F.lit(1)).alias("observations"), F.sum("redaction_count").alias("redactions")
    ).join(sizes, "project_id")


def virtualize(spark, sf_dir):
    out = plans.virtualize(t.observations(spark, sf_dir), t.THRESHOLD, t.RECEIPT_MAX)
    return out.select(
        "observation_id", "replaced", fx.byte_len("output").alias("output_bytes"), fx.sha256("output").alias("output_hash")
    )


def receipt_totals(spark, sf_dir):
    """Flagship: receipts by tool."""
    out = plans.virtualize(t.observations(spark, sf_dir), t.THRESHOLD, t.RECEIPT_MAX)
    return out.groupBy("tool_name").agg(
        F.count(F.lit(1)).alias("observations"),
        F.count_if("replaced").alias("replaced"),
        F.sum("original_bytes").alias("bytes_before"),
        F.sum(fx.byte_len("output")).alias("bytes_after"),
        F.sum("redactions").alias("redactions"),
    )


def _archived(spark, sf_dir):
    return plans.archive(t.observations(spark, sf_dir), t.now())


def attach_content(spark, sf_dir):
    """The artifacts of one tool are gone: their observations are not readable."""
    metadata, found = _archived(spark, sf_dir)
    gone = metadata.filter(F.col("tool_name") == "de").select("project_id", "artifact_id").distinct()
    left = found.join(gone, ["project_id", "artifact_id"], "left_anti")
    return re.attach_content(metadata, left).groupBy("tool_name", "readable").agg(
        F.count(F.lit(1)).alias("n"), F.sum(fx.byte_len("content")).alias("bytes")
    )


def lookup_by_id(spark, sf_dir):
    """Every observation asked for by its own id, and every artifact by its hash."""
    metadata, _ = _archived(spark, sf_dir)
    asked = metadata.select("project_id", F.col("observation_id").alias("id")).unionByName(
        metadata.select("project_id", F.col("artifact_id").alias("id")).distinct()
    )
    return re.lookup_by_id(asked, metadata.select("project_id", "observation_id", "artifact_id", "position")).select(
        "project_id", "id", "observation_id", "position"
    )


def get_ranges(spark, sf_dir):
    """The first 512 bytes of every observation."""
    metadata, found = _archived(spark, sf_dir)
    asked = metadata.select(
        "project_id", F.col("observation_id").alias("request_id"), F.col("observation_id").alias("id"),
        F.lit(None).cast("string").alias("query"), F.lit(0).alias("offset"), F.lit(512).alias("limit"),
    )
    return re.get_observations(asked, metadata, found).select(
        "request_id", "status", "byte_offset", "truncated", fx.sha256("text").alias("text_hash")
    )


def get_matches(spark, sf_dir):
    """Lines of every observation that contain a word of its tool's choice, third match on."""
    metadata, found = _archived(spark, sf_dir)
    asked = metadata.select(
        "project_id", F.col("observation_id").alias("request_id"), F.col("observation_id").alias("id"),
        F.when(F.col("tool_name") == "en", " THE ").otherwise("en").alias("query"),
        F.lit(2).alias("offset"), F.lit(5).alias("limit"),
    )
    got = re.get_observations(asked, metadata, found)
    return got.select(
        "request_id", F.size("matches").cast("long").alias("matches"), "truncated",
        F.array_join(F.transform("matches", lambda m: m["line"].cast("string")), ",").alias("lines"),
        fx.sha256(F.array_join(F.transform("matches", lambda m: m["text"]), "\n")).alias("text_hash"),
    )


def validate_requests(spark, sf_dir):
    """Document heads as queries, sizes as offsets, limits and tool names."""
    docs = t.table(spark, sf_dir, "documents")
    asked = docs.select(
        "doc_id",
        F.when(F.col("n_chars") > 9000, " ").otherwise(F.col("text")).alias("query"),
        (F.col("n_chars") - 50).alias("offset"),
        (F.col("n_chars") - 60).alias("limit"),
        F.repeat("lang", (F.col("n_chars") / 10).cast("int")).alias("tool_name"),
    )
    valid, rejects = re.validate_requests(asked)
    return rejects.select("doc_id", "reason").unionByName(valid.select("doc_id", F.lit("valid").alias("reason")))


def _one_archive(spark, sf_dir):
    obs = t.observations(spark, sf_dir).withColumn("project_id", F.substring("session_id", 1, 3))
    return (staged(df) for df in plans.archive(obs, t.now()))


def _search_input(spark, sf_dir):
    """One archive of all documents, asked for every three words of the passages, of any tool and of English only."""
    metadata, found = _one_archive(spark, sf_dir)
    words = t.search_queries(spark, sf_dir)

    def of(prefix, tool, limit):
        return words.select(
            "project_id",
            F.concat(F.lit(prefix), "query_id").alias("query_id"),
            "query",
            F.lit(tool).cast("string").alias("tool_name"),
            F.lit(limit).cast("int").alias("limit"),
        )

    asked = of("a", None, 7).unionByName(of("b", "en", None))
    return asked, metadata, found, plans.write_signatures(found, scratch(spark))


def _passage_input(spark, sf_dir):
    """The same archive asked for whole passages, of any tool and of English only."""
    metadata, found = _one_archive(spark, sf_dir)
    whole = t.passages(spark, sf_dir)

    def asked(prefix, tool, limit):
        return whole.select(
            "project_id",
            F.concat(F.lit(prefix), "query_id").alias("query_id"),
            "query",
            F.lit(tool).cast("string").alias("tool_name"),
            F.lit(limit).cast("int").alias("limit"),
        )

    return asked("a", None, 7).unionByName(asked("b", "en", None)), metadata, found, plans.write_signatures(found, scratch(spark))


def search_observations(spark, sf_dir):
    return _hits(re.search_observations(*_search_input(spark, sf_dir)))


def search_observations_passages(spark, sf_dir):
    return _hits(re.search_observations(*_passage_input(spark, sf_dir)))


def _hits(out):
    return out.select(
        "query_id", F.col("rank").cast("long").alias("rank"), "observation_id", "truncated",
        F.array_join(F.transform("matches", lambda m: m["line"].cast("string")), ",").alias("lines"),
        fx.sha256(F.array_join(F.transform("matches", lambda m: m["text"]), "\n")).alias("text_hash"),
    )


def newest_first(spark, sf_dir):
    metadata, _ = _archived(spark, sf_dir)
    return re.newest_first(metadata, 20).select("position", "observation_id")


def explode_lines(spark, sf_dir):
    from obsframe.operators.ordered import explode_lines as explode

    lines = explode(t.observations(spark, sf_dir).select("tool_call_id", "text"))
    return lines.groupBy("tool_call_id").agg(
        F.max("line").alias("lines"), F.max_by(fx.byte_len("text"), "line").alias("last_line_bytes")
    )


def _matches(spark, sf_dir):
    obs = t.observations(spark, sf_dir).select(
        F.col("session_id"), F.col("tool_call_id").alias("observation_id"), F.col("seq").alias("position"),
        F.explode(fx.match_lines("text", F.lit("En"), 2048)).alias("m"),
    )
    return obs.select("session_id", "observation_id", "position", "m.line", "m.text")


def page_matches(spark, sf_dir):
    return re.page_matches(_matches(spark, sf_dir), ["observation_id"], offset=1, limit=4).select(
        "observation_id", "line", F.col("rank").cast("long").alias("rank"), "truncated"
    )


def top_lines(spark, sf_dir):
    return re.top_lines(_matches(spark, sf_dir), ["session_id"]).select(
        "session_id", "observation_id", "line", F.col("line_rank").cast("long").alias("line_rank"),
        F.col("hit_rank").cast("long").alias("hit_rank"),
    )


QUERIES = {
    f.__name__: f
    for f in (
        redact, identifiers, text_functions, lexical_terms, eligible, dedup_content, artifacts, inventory_listing,
        archive_projection, upsert_latest, archive, virtualize, receipt_totals, attach_content, lookup_by_id,
        get_ranges, get_matches, validate_requests, search_observations,
        search_observations_passages, newest_first, explode_lines, page_matches,
        top_lines,
    )
}

_SANE = f"WITH {sql.sanitized()}"
_TERMS = r"regexp_extract_all(lower({}), '[\p{{L}}\p{{N}}_$-]{{2,}}')"
_ART = """arts AS (SELECT project_id, artifact_id, any_value(sanitized) AS content, min(seq) AS first_seq
  FROM sane GROUP BY 1, 2)"""


def _clip(c: str, n: int) -> str:
    """Longest run of whole characters within n bytes (no cut leaves three bytes of four in these tables)."""
    return (
        f"CASE WHEN strlen({c}) <= {n} THEN {c} ELSE list_reduce(list_prepend('', string_split(substr({c}, 1, {n}), '')), "
        f"lambda a, b: CASE WHEN right(a, 1) = chr(1) THEN a WHEN strlen(a) + strlen(b) <= {n} THEN a || b ELSE a || chr(1) END) END"
    )


def _clipped(c: str, n: int) -> str:
    return f"replace({_clip(c, n)}, chr(1), '')"


_LINES = """lines AS (
  SELECT {keys}, line, {clip} AS text FROM (
    SELECT {keys}, unnest(string_split({text}, chr(10))) AS text_, generate_subscripts(string_split({text}, chr(10)), 1) AS line
    FROM {source}))"""


def _lines(source: str, keys: str, text: str, clip: int) -> str:
    return _LINES.format(source=source, keys=keys, text=text, clip=_clipped("text_", clip))


_RECEIPTS = sql.receipts(f"(SELECT * FROM sane WHERE original_bytes > {t.THRESHOLD})", t.RECEIPT_MAX)
_OUTPUT = f"""{_SANE}, {_RECEIPTS},
out_ AS (SELECT s.*, r.receipt IS NOT NULL AS replaced, coalesce(r.receipt, s.text) AS output
         FROM sane s LEFT JOIN receipts r USING (observation_id))"""
_MATCHES = f"""WITH {sql.OBSERVATIONS}, {_lines("obs", "session_id, tool_call_id, seq", "text", 2048)},
matches AS (SELECT session_id, tool_call_id AS observation_id, seq AS position, line, text FROM lines
            WHERE contains(lower(text), 'en'))"""

ORACLES = {
    "redact": f"{_SANE} SELECT seq AS doc_id, redactions, sha256(sanitized) AS sanitized_hash FROM sane",
    "identifiers": f"""{_SANE} SELECT tool_call_id, observation_id, substr(sha256(session_id), 1, 32) AS project_key,
        sha256(text) AS text_hash, strlen(text)::BIGINT AS bytes, ceil(strlen(text) / 3.0)::BIGINT AS tokens,
        regexp_matches(observation_id, '^obs_[a-f0-9]{{24}}$') AND length(artifact_id) = 64 AS ids_ok FROM sane""",
    "text_functions": rf"""WITH {sql.OBSERVATIONS} SELECT tool_call_id,
        sha256({_clipped("text", 100)}) AS clip_hash, sha256({_clipped("text", 333)}) AS head_hash,
        sha256(substr(regexp_replace(text, '[{sql.SPACE}]+', ' ', 'g'), 1, 512)) AS message_hash,
        sha256(substr(regexp_replace(substr(text, 1, 200), '[^ -~]', '?', 'g'), 1, 64)) AS label_hash,
        sha256(regexp_replace(text, '^[{sql.SPACE}]+|[{sql.SPACE}]+$', '', 'g')) AS trimmed_hash,
        sha256(substr(text, 1, 4096)) AS excerpt_hash FROM obs""",
    "lexical_terms": rf"""WITH {sql.DOCUMENT_FILES},
        words AS (SELECT doc_id, {_TERMS.format("path || ' ' || text")} AS w FROM files),
        kept AS (SELECT doc_id, term, min(i) AS i FROM (SELECT doc_id, unnest(w) AS term, generate_subscripts(w, 1) AS i FROM words) GROUP BY 1, 2)
        SELECT doc_id, count(*) AS terms, sha256(string_agg(term, ' ' ORDER BY i)) AS terms_hash
        FROM kept GROUP BY 1""",
    "eligible": f"WITH {sql.OBSERVATIONS} SELECT tool_name, count(*) AS n FROM obs WHERE text IS NOT NULL AND NOT starts_with(tool_name, 'e') GROUP BY 1",
    "dedup_content": f"""{_SANE} SELECT observation_id, artifact_id,
        row_number() OVER (PARTITION BY project_id, artifact_id ORDER BY seq) > 1 AS deduplicated FROM sane""",
    "artifacts": f"""{_SANE}, {_ART} SELECT project_id, artifact_id, substr(artifact_id, 1, 2) AS shard,
        strlen(content)::BIGINT AS size, sha256(content) AS content_hash FROM arts""",
    "inventory_listing": f"""{_SANE}, {_ART} SELECT substr(artifact_id, 1, 1) AS first_digit, count(*) AS n,
        sum(strlen(content))::BIGINT AS bytes FROM arts GROUP BY 1""",
    "archive_projection": f"""{_SANE} SELECT observation_id, artifact_id, artifact_id AS content_hash, tool_name, session_id,
        original_bytes, sanitized_bytes, redactions AS redaction_count, '2024-01-31' AS created FROM sane""",
    "upsert_latest": f"""{_SANE},
        both_ AS (SELECT observation_id, tool_name, seq FROM sane UNION ALL
                 SELECT observation_id, 'q' || quality || 't' || toxic, seq + 1000000000 FROM sane JOIN labels ON doc_id = seq)
        SELECT observation_id, arg_max(tool_name, seq) AS tool_name, min(seq) AS position, max(seq) AS latest_seq
        FROM both_ GROUP BY 1""",
    "archive": f"""{_SANE}, {_ART},
        a AS (SELECT project_id, count(*) AS artifacts, sum(strlen(content))::BIGINT AS bytes FROM arts GROUP BY 1)
        SELECT project_id, count(*) AS observations, sum(redactions)::BIGINT AS redactions, any_value(artifacts) AS artifacts,
               any_value(bytes) AS bytes FROM sane JOIN a USING (project_id) GROUP BY 1""",
    "virtualize": f"""{_OUTPUT} SELECT observation_id, replaced, strlen(output)::BIGINT AS output_bytes,
        sha256(output) AS output_hash FROM out_""",
    "receipt_totals": f"""{_OUTPUT} SELECT tool_name, count(*) AS observations, count_if(replaced)::BIGINT AS replaced,
        sum(original_bytes)::BIGINT AS bytes_before, sum(strlen(output))::BIGINT AS bytes_after,
        sum(redactions)::BIGINT AS redactions FROM out_ GROUP BY 1""",
    "attach_content": f"""{_SANE}, gone AS (SELECT DISTINCT project_id, artifact_id FROM sane WHERE tool_name = 'de')
        SELECT tool_name, g.artifact_id IS NULL AS readable, count(*) AS n,
               sum(CASE WHEN g.artifact_id IS NULL THEN sanitized_bytes END)::BIGINT AS bytes
        FROM sane LEFT JOIN gone g USING (project_id, artifact_id) GROUP BY 1, 2""",
    "lookup_by_id": f"""{_SANE} SELECT project_id, observation_id AS id, observation_id, seq AS position FROM sane
        UNION ALL SELECT project_id, artifact_id, arg_min(observation_id, seq), min(seq) FROM sane GROUP BY 1, 2""",
    "get_ranges": f"""{_SANE} SELECT observation_id AS request_id, 'ok' AS status, 0::BIGINT AS byte_offset,
        512 < sanitized_bytes AS truncated, sha256({_clipped("sanitized", 512)}) AS text_hash FROM sane""",
    "get_matches": f"""{_SANE}, {_lines("sane", "observation_id, tool_name", "sanitized", 2048)},
        m AS (SELECT *, row_number() OVER (PARTITION BY observation_id ORDER BY line) AS rn FROM lines
              WHERE contains(lower(text), CASE WHEN tool_name = 'en' THEN 'the' ELSE 'en' END)),
        g AS (SELECT observation_id, count(*) AS total, count_if(rn BETWEEN 3 AND 7) AS n,
                     string_agg(line::VARCHAR, ',' ORDER BY line) FILTER (rn BETWEEN 3 AND 7) AS lines,
                     string_agg(text, chr(10) ORDER BY line) FILTER (rn BETWEEN 3 AND 7) AS texts FROM m GROUP BY 1)
        SELECT observation_id AS request_id, coalesce(n, 0)::BIGINT AS matches, 2 + coalesce(n, 0) < coalesce(total, 0) AS truncated,
               coalesce(lines, '') AS lines, sha256(coalesce(texts, '')) AS text_hash FROM sane LEFT JOIN g USING (observation_id)""",
    "validate_requests": rf"""WITH r AS (SELECT doc_id, n_chars, lang,
          regexp_replace(CASE WHEN n_chars > 9000 THEN ' ' ELSE text END, '^[{sql.SPACE}]+|[{sql.SPACE}]+$', '', 'g') AS q FROM documents)
        SELECT doc_id, CASE WHEN q = '' THEN 'query is empty' WHEN length(q) > 512 THEN 'query is too long'
          WHEN n_chars - 50 < 0 THEN 'offset is negative' WHEN n_chars - 60 < 1 THEN 'limit is not positive'
          WHEN length(lang) * (n_chars // 10) < 1 OR length(lang) * (n_chars // 10) > 128 THEN 'tool name is empty or too long'
          ELSE 'valid' END AS reason FROM r""",
    "search_observations": rf"""{_SANE}, {sql.QUERIES},
        asked AS (SELECT 'a' || query_id AS query_id, query AS q, NULL AS tool, 7 AS lim FROM queries WHERE length(trim(query)) > 0
            UNION ALL SELECT 'b' || query_id, query, 'en', 10 FROM queries WHERE length(trim(query)) > 0),
        {_lines("sane", "observation_id, tool_name, seq", "sanitized", 1024)},
        m AS (SELECT query_id, lim, l.*, row_number() OVER (PARTITION BY query_id, observation_id ORDER BY line) AS rn
              FROM asked JOIN lines l ON contains(lower(l.text), lower(q)) AND (tool IS NULL OR tool = tool_name)),
        h AS (SELECT query_id, lim, observation_id, seq, string_agg(line::VARCHAR, ',' ORDER BY line) AS lines,
                     sha256(string_agg(text, chr(10) ORDER BY line)) AS text_hash FROM m WHERE rn <= 5 GROUP BY ALL),
        r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY seq DESC) AS rank FROM h)
        SELECT query_id, rank, observation_id, lines, text_hash,
               count(*) OVER (PARTITION BY query_id) >= lim AS truncated FROM r WHERE rank <= lim""",
    "newest_first": f"{_SANE} SELECT seq AS position, observation_id FROM sane ORDER BY seq DESC LIMIT 20",
    "explode_lines": """SELECT doc_id::VARCHAR AS tool_call_id, len(string_split(text, chr(10)))::BIGINT AS lines,
        strlen(string_split(text, chr(10))[-1])::BIGINT AS last_line_bytes FROM documents""",
    "page_matches": f"""{_MATCHES}, n AS (SELECT *, row_number() OVER (PARTITION BY observation_id ORDER BY line) AS rank,
          count(*) OVER (PARTITION BY observation_id) AS total FROM matches)
        SELECT observation_id, line::BIGINT AS line, rank, 5 < total AS truncated FROM n WHERE rank BETWEEN 2 AND 5""",
    "top_lines": f"""{_MATCHES},
        l AS (SELECT *, row_number() OVER (PARTITION BY session_id, observation_id ORDER BY line) AS line_rank FROM matches),
        h AS (SELECT session_id, observation_id, row_number() OVER (PARTITION BY session_id ORDER BY position DESC) AS hit_rank
              FROM l WHERE line_rank = 1)
        SELECT session_id, observation_id, line::BIGINT AS line, line_rank, hit_rank FROM l JOIN h USING (session_id, observation_id)
        WHERE line_rank <= 5 AND hit_rank <= 20""",
}
# A request is valid up to the operator's 512 characters.
_WORDS_ASKED = """asked AS (SELECT 'a' || query_id AS query_id, query AS q, NULL AS tool, 7 AS lim FROM queries WHERE length(trim(query)) > 0
            UNION ALL SELECT 'b' || query_id, query, 'en', 10 FROM queries WHERE length(trim(query)) > 0)"""
assert _WORDS_ASKED in ORACLES["search_observations"]
ORACLES["search_observations_passages"] = sql.asked_whole(ORACLES["search_observations"]).replace(
    _WORDS_ASKED,
    """asked AS (SELECT 'a' || query_id AS query_id, query AS q, NULL AS tool, 7 AS lim FROM queries WHERE length(query) <= 512
            UNION ALL SELECT 'b' || query_id, query, 'en', 10 FROM queries WHERE length(query) <= 512)""",
)
