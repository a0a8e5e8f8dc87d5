"""Explicit schemas.  Nothing in this package infers one."""

from __future__ import annotations

from pyspark.sql import types as T

SCHEMA_VERSION = 1

_S, _L, _B, _I = T.StringType(), T.LongType(), T.BooleanType(), T.IntegerType()


def _struct(*fields: tuple) -> T.StructType:
    return T.StructType([T.StructField(n, k, True) for n, k in fields])


BLOCK = _struct(("type", _S), ("text", _S), ("id", _S), ("name", _S))
MESSAGES = _struct(
    ("project_id", _S),
    ("session_id", _S),
    ("msg_idx", _L),
    ("role", _S),
    ("content", T.ArrayType(BLOCK)),
    ("tool_call_id", _S),
    ("tool_name", _S),
    ("is_error", _B),
    ("timestamp", _L),
    ("custom_type", _S),
)
OBSERVATIONS = _struct(
    ("project_id", _S),
    ("session_id", _S),
    ("tool_call_id", _S),
    ("tool_name", _S),
    ("text", _S),
    ("is_error", _B),
    ("seq", _L),
)
METADATA = _struct(
    ("schema_version", _I),
    ("artifact_id", _S),
    ("observation_id", _S),
    ("tool_call_id", _S),
    ("tool_name", _S),
    ("session_id", _S),
    ("content_hash", _S),
    ("original_bytes", _L),
    ("sanitized_bytes", _L),
    ("redaction_count", _L),
    ("created_at", T.TimestampType()),
    ("updated_at", T.TimestampType()),
)
CHANGES = _struct(
    ("project_id", _S),
    ("path", _S),
    ("event", _S),
    ("ts", T.TimestampType()),
    ("seq", _L),
    ("content", T.BinaryType()),
)
IMPORT = _struct(
    ("source", _S), ("names", T.ArrayType(_S)), ("type_only", _B), ("static", _B), ("wildcard", _B)
)
EXPORT = _struct(("name", _S), ("source", _S), ("type_only", _B))
RELATIONSHIPS = _struct(("extends", T.ArrayType(_S)), ("implements", T.ArrayType(_S)), ("permits", T.ArrayType(_S)))
SYMBOL = _struct(
    ("name", _S),
    ("kind", _S),
    ("signature", _S),
    ("exported", _B),
    ("line", _L),
    ("container", _S),
    ("annotations", T.ArrayType(_S)),
    ("modifiers", T.ArrayType(_S)),
    ("type_parameters", T.ArrayType(_S)),
    ("relationships", RELATIONSHIPS),
)
FILES = _struct(
    ("project_id", _S),
    ("path", _S),
    ("kind", _S),
    ("language", _S),
    ("content_hash", _S),
    ("size_bytes", _L),
    ("lexical_terms", T.ArrayType(_S)),
    ("imports", T.ArrayType(IMPORT)),
    ("exports", T.ArrayType(EXPORT)),
    ("symbols", T.ArrayType(SYMBOL)),
    ("dependencies", T.ArrayType(_S)),
    ("package_name", _S),
    ("degraded_reason", _S),
    ("generation", _L),
)
WARNINGS = _struct(("project_id", _S), ("path", _S), ("code", _S), ("message", _S), ("generation", _L))
DIRTY = _struct(("project_id", _S), ("path", _S), ("content_hash", _S), ("generation", _L))
PENDING = _struct(("project_id", _S), ("path", _S), ("generation", _L))
GENERATIONS = _struct(
    ("project_id", _S),
    ("schema_version", _I),
    ("head", _S),
    ("workspace_revision", _S),
    ("freshness", _S),
    ("semantic_hash", _S),
    ("bytes", _L),
    ("generator", _S),
    ("generator_version", _S),
    ("generated_at", T.TimestampType()),
    ("generation", _L),
)
POINTERS = _struct(("project_id", _S), ("generation", _L), ("path", _S), ("activated_at", T.TimestampType()))

# Closed sets of the snapshot.
FILE_KINDS = ("semantic", "lexical")
LANGUAGES = ("typescript", "javascript", "java", "text")
SYMBOL_KINDS = (
    "function",
    "class",
    "interface",
    "type",
    "enum",
    "variable",
    "namespace",
    "record",
    "annotation",
    "constructor",
    "method",
    "field",
    "enum-constant",
)
WARNING_CODES = ("parse-error", "read-error")
FRESHNESS = ("fresh", "dirty", "stale", "unsupported")
