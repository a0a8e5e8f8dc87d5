"""Bounded stand-ins for large results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import byte_len, clip_bytes, prefix_bytes, tool_label

RECEIPT_TYPE = "observation_receipt"


def escaped(c: Column) -> Column:
    """Body of the JSON string literal for ``c`` (without its quotes)."""
    literal = F.to_json(F.struct(c.alias("p")))  # {"p":"..."}
    return literal.substr(F.lit(7), F.length(literal) - 8)


def _whole_escapes(c: Column) -> Column:
    """Drop an escape sequence that a cut left unfinished at the end."""
    return F.regexp_replace(c, r"(?<!\\)((?:\\\\)*)\\(?:u[0-9A-Fa-f]{0,3})?$", "$1")


def receipt(df: DataFrame, max_bytes: int, content: str = "sanitized") -> DataFrame:
    """Add ``receipt``: JSON of at most ``max_bytes`` whose preview is the longest prefix that fits.

    Needs observation_id, artifact_id, tool_name, original_bytes, sanitized_bytes, redactions, is_error.
    """
    if max_bytes < 512:
        raise ValueError("max_bytes must be at least 512")
    fixed = F.to_json(
        F.struct(
            F.lit(RECEIPT_TYPE).alias("type"),
            F.col("observation_id").alias("id"),
            F.col("artifact_id").alias("hash"),
            tool_label("tool_name").alias("tool"),
            F.col("original_bytes").alias("originalBytes"),
            F.col("sanitized_bytes").alias("sanitizedBytes"),
            F.col("redactions").alias("redactions"),
            F.col("is_error").alias("error"),
            F.struct(
                F.col("artifact_id").alias("artifactId"),
                F.lit(0).alias("byteOffset"),
                F.lit("").alias("preview"),
            ).alias("evidence"),
        )
    )
    # No character is shorter than one byte, so the first max_bytes characters hold every candidate.
    body = escaped(F.substring(F.col(content), 1, max_bytes))
    out = df.withColumn("_fixed", fixed)
    room = F.lit(max_bytes) - byte_len("_fixed")
    out = out.withColumn("_preview", _whole_escapes(prefix_bytes(body, F.greatest(room, F.lit(0)))))
    open_part = F.col("_fixed").substr(F.lit(1), F.length("_fixed") - 3)
    return out.withColumn(
        "receipt",
        F.when(byte_len("_fixed") > max_bytes, clip_bytes("_fixed", max_bytes)).otherwise(
            F.concat(open_part, F.col("_preview"), F.lit('"}}'))
        ),
    ).drop("_fixed", "_preview")


def receipt_type(c: Column | str) -> Column:
    """``type`` of a JSON text, null when it is no JSON object."""
    c = F.col(c) if isinstance(c, str) else c
    guarded = F.when(F.startswith(F.ltrim(c), F.lit("{")), F.try_parse_json(c))
    return F.try_variant_get(guarded, "$.type", "string")


def is_receipt(c: Column | str) -> Column:
    return F.coalesce(receipt_type(c) == RECEIPT_TYPE, F.lit(False))
