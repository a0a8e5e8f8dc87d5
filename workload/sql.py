"""Building blocks of the SQL side."""

from __future__ import annotations

from . import tables as t

SPACE = r"\t-\r \x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"
NAME = (
    r"(?:(?:[a-z0-9]+[_-])*(?:api[_-]?key|access[_-]?key|secret[_-]?access[_-]?key|access[_-]?token"
    r"|auth[_-]?token|refresh[_-]?token|token|password|passwd|secret|client[_-]?secret|private[_-]?key))"
)
_S = f"[{SPACE}]"


def quote(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _pem(kind: str) -> tuple[str, str]:
    k = f"{kind}PRIVATE KEY"
    return (
        rf"-----BEGIN {k}-----[\s\S]*?-----END {k}-----",
        f"-----BEGIN {k}-----\n[REDACTED]\n-----END {k}-----",
    )


# No look-ahead and no back-references here: one stage per key kind and per quote sign.
STAGES = [
    *[_pem(k) for k in ("RSA ", "EC ", "OPENSSH ", "")],
    (rf"(?i)(\bAuthorization{_S}*[:=]{_S}*[\"']?Bearer{_S}+)[^{SPACE}\"',;]+", r"\1[REDACTED]"),
    (rf"(?i)([\"']?{NAME}[\"']?{_S}*[:=]{_S}*)\"([^\r\n]*?)\"", r'\1"[REDACTED]"'),
    (rf"(?i)([\"']?{NAME}[\"']?{_S}*[:=]{_S}*)'([^\r\n]*?)'", r"\1'[REDACTED]'"),
    (rf"(?i)(\b{NAME}\b{_S}*[:=]{_S}*)([^{SPACE},;\"'][^{SPACE},;]*)", r"\1[REDACTED]"),
    (r"\b(?:sk-[A-Za-z0-9_-]{16,}|gh[pousr]_[A-Za-z0-9_]{20,}|github_pat_[A-Za-z0-9_]{20,})\b", "[REDACTED]"),
    (rf"(?i)(\b[a-z][a-z0-9+.-]*://[^{SPACE}/:@]+:)[^{SPACE}/@]+(@)", r"\1[REDACTED]\2"),
]


def redacted(source: str, out: str = "redacted") -> str:
    """CTEs that end in ``out``: the columns of ``source`` with sanitized and redactions."""
    steps = [f"{out}_0 AS (SELECT *, text AS t, 0::BIGINT AS n FROM {source})"]
    for i, (pattern, replacement) in enumerate(STAGES):
        p = quote(pattern)
        steps.append(
            f"{out}_{i + 1} AS (SELECT * EXCLUDE (t, n), regexp_replace(t, {p}, {quote(replacement)}, 'g') AS t, "
            f"n + len(regexp_extract_all(t, {p})) AS n FROM {out}_{i})"
        )
    steps.append(
        f"{out} AS (SELECT * EXCLUDE (t, n), t AS sanitized, n AS redactions FROM {out}_{len(STAGES)})"
    )
    return ",\n".join(steps)


OBSERVATIONS = """obs AS (
  SELECT source AS project_id, source AS session_id, doc_id::VARCHAR AS tool_call_id, lang AS tool_name, text,
         n_chars < 100 AS is_error, doc_id AS seq
  FROM documents)"""

RESULTS = """obs AS (
  SELECT 'conversations' AS project_id, conv_id::VARCHAR AS session_id, 'call-' || turn AS tool_call_id,
         'answer' AS tool_name, text, false AS is_error, conv_id * 1000 + turn AS seq
  FROM conversations WHERE role = 'assistant')"""


def sanitized(observations: str = OBSERVATIONS) -> str:
    """CTEs obs .. sane: sanitized observations with ids and sizes."""
    return f"""{observations},
{redacted("obs")},
sane AS (
  SELECT *, 'obs_' || substr(sha256(session_id || chr(0) || tool_call_id), 1, 24) AS observation_id,
         sha256(sanitized) AS artifact_id, strlen(text)::BIGINT AS original_bytes,
         strlen(sanitized)::BIGINT AS sanitized_bytes
  FROM redacted)"""


FIXED_RECEIPT = """'{"type":"observation_receipt","id":"' || observation_id || '","hash":"' || artifact_id
   || '","tool":"' || substr(regexp_replace(tool_name, '[^ -~]', '?', 'g'), 1, 64)
   || '","originalBytes":' || original_bytes || ',"sanitizedBytes":' || sanitized_bytes
   || ',"redactions":' || redactions || ',"error":' || is_error
   || ',"evidence":{"artifactId":"' || artifact_id || '","byteOffset":0,"preview":"'"""


def receipts(source: str, max_bytes: int, out: str = "receipts") -> str:
    """CTEs that end in ``out``: observation_id and receipt for every row of ``source``.

    The preview is found by adding up the escaped width of each character.
    """
    width = r"""CASE WHEN ch IN ('"', '\', chr(10), chr(13), chr(9), chr(8), chr(12)) THEN 2
                     WHEN unicode(ch) < 32 THEN 6 ELSE strlen(ch) END"""
    return rf"""{out}_head AS (
  SELECT observation_id, sanitized, {FIXED_RECEIPT} AS head FROM {source}),
{out}_room AS (SELECT *, {max_bytes} - strlen(head) - 3 AS room FROM {out}_head),
{out}_chars AS (
  SELECT observation_id, room, i, substr(sanitized, i::BIGINT, 1) AS ch
  FROM (SELECT observation_id, room, sanitized,
               unnest(generate_series(1, least(length(sanitized), greatest(room, 0)))) AS i FROM {out}_room)),
{out}_fit AS (
  SELECT observation_id, max(i) AS n FROM (
    SELECT observation_id, i, room,
           sum({width}) OVER (PARTITION BY observation_id ORDER BY i) AS used FROM {out}_chars)
  WHERE used <= room GROUP BY 1),
{out} AS (
  SELECT r.observation_id,
         head || substr(to_json(substr(sanitized, 1, coalesce(n, 0)))::VARCHAR, 2,
                        length(to_json(substr(sanitized, 1, coalesce(n, 0)))::VARCHAR) - 2) || '"}}}}' AS receipt
  FROM {out}_room r LEFT JOIN {out}_fit f USING (observation_id))"""


MESSAGES = """msgs AS (
  SELECT 'conversations' AS project_id, conv_id::VARCHAR AS session_id, turn AS msg_idx,
         CASE role WHEN 'user' THEN 'assistant' WHEN 'assistant' THEN 'toolResult' ELSE 'user' END AS role, text,
         CASE WHEN role = 'assistant' THEN 'call-' || turn END AS tool_call_id
  FROM conversations)"""

NOW = f"TIMESTAMP '{t.NOW}'"
PAGE_FILES = """files AS (
  SELECT regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS project_id,
         regexp_replace(regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1), '^/+', '') AS path,
         html AS text, page_id FROM pages)"""
DOCUMENT_FILES = """files AS (
  SELECT source AS project_id, lang || '/' || doc_id || '.txt' AS path, text, doc_id FROM documents)"""
INVENTORY = """inventory AS (
  SELECT 'user-' || user_id AS project_id, event_id::VARCHAR AS artifact_id, round(value * 100)::BIGINT AS size,
         ts AS modified_at, event_type FROM events)"""
LEDGER = """rows_ AS (
  SELECT 'user-' || user_id AS project_id, event_id AS generation, round(value * 100)::BIGINT AS bytes, event_type,
         value, props FROM events),
ledger AS (
  SELECT *, coalesce(generation = max(CASE WHEN event_type = 'click' THEN generation END) OVER (PARTITION BY project_id), false)
         AS is_active FROM rows_)"""
CHANGES = """changes AS (
  SELECT 'user-' || user_id AS project_id, 'src/' || json_extract_string(props, '$.k') AS path,
         CASE event_type WHEN 'signup' THEN 'add' WHEN 'error' THEN 'unlink' ELSE 'change' END AS event,
         ts, event_id AS seq FROM events)"""
OPLOG = """oplog AS (
  SELECT 'user-' || user_id AS session_id, event_id AS seq,
         CASE event_type WHEN 'signup' THEN 'capsule_build' WHEN 'error' THEN 'archive' WHEN 'click' THEN 'map_query'
              WHEN 'purchase' THEN 'generation' ELSE 'reduction' END AS op,
         value AS duration_ms, value < 20 AS ok, k > 50 AS deduplicated, round(value * 100)::BIGINT AS bytes,
         k::VARCHAR AS content_hash, k AS insertion_index, k > 30 AS triggered, k AS reduced_count,
         round(value * 1000)::BIGINT AS tokens_before, round(value * 500)::BIGINT AS tokens_after,
         k > 60 AS target_reached
  FROM (SELECT *, json_extract_string(props, '$.k')::BIGINT AS k FROM events))"""
QUERIES = r"""queries AS (
  SELECT item_id::VARCHAR || '.' || i AS query_id, array_to_string(w[3 * i + 1:3 * i + 3], ' ') AS query FROM (
    SELECT item_id, w, unnest(range(0, (len(w) + 2) // 3)) AS i FROM (
      SELECT item_id, string_split(regexp_replace(text, '\s+', ' ', 'g'), ' ') AS w FROM benchmark)))"""
PASSAGES = """queries AS (SELECT item_id::VARCHAR AS query_id, text AS query FROM benchmark)"""


def asked_whole(oracle: str) -> str:
    """The SQL of a query that asks pieces of the passages, asked with whole passages."""
    if oracle.count(QUERIES) != 1:
        raise ValueError("no queries to replace")
    return oracle.replace(QUERIES, PASSAGES)
