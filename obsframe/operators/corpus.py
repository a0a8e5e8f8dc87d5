"""Indexing of corpus files: classification, terms, declarations, warnings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import source as src
from ..functions.paths import is_safe_path, language
from ..functions.text import bounded_message, byte_len, lexical_terms
from .extract import EXPORT_TYPE, FILE, IMPORT_TYPE, SYMBOL_TYPE, dependency_names, java_declarations, ts_declarations


def reject_unsafe(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Safe relative paths, and the rest: an unsafe path is an error, never an outcome."""
    safe = is_safe_path("path")
    return files.filter(safe), files.filter(~safe)


def degraded_reason(lang: Column, text: Column, size: Column) -> Column:
    """Why declarations of a source file cannot be trusted; null when they can."""
    masked = F.when(lang == "java", src.masked_source(text, script=False)).otherwise(src.masked_source(text, script=True))
    balanced = src.brace_balance(masked) == 0
    grouped = src.deepest(masked, src.OPEN + src.CLOSE) <= src.MAX_GROUPS
    many = F.length(text) - F.length(F.replace(text, F.lit("{"), F.lit(""))) > src.MAX_NESTING
    deep = F.when(many, src.max_nesting(text) > src.MAX_NESTING).otherwise(F.lit(False))
    java = lang == "java"
    return (
        F.when(lang == "text", F.lit(None).cast("string"))
        .when(java & (size > src.MAX_JAVA_BYTES), "parse error: Java source exceeds 2 MiB")
        .when(java & deep, "parse error: Java brace nesting exceeds 512")
        .when(~balanced, "parse error: braces do not balance")
        .when(~grouped, f"parse error: parentheses nest deeper than {src.MAX_GROUPS}")
    )


def classify_files(indexed: DataFrame) -> DataFrame:
    """Text, hash, size, terms, language, kind and degradation of files whose outcome is ``indexed``."""
    text = F.make_valid_utf8(F.col("content").cast("string"))
    out = indexed.withColumn("text", text).withColumns(
        {
            "content_hash": F.coalesce(F.sha2("content", 256), F.lit("")),
            "size_bytes": byte_len("content"),
            "language": language("path"),
        }
    )
    out = out.withColumn("degraded_reason", degraded_reason(F.col("language"), F.col("text"), F.col("size_bytes")))
    semantic = (F.col("language") != "text") & F.col("degraded_reason").isNull()
    return out.withColumns(
        {
            "kind": F.when(semantic, "semantic").otherwise("lexical"),
            "lexical_terms": lexical_terms("path", "text"),
        }
    )


def _per_file(declarations: DataFrame, with_package: bool) -> DataFrame:
    """Nested columns per file in source order; the group is one file."""
    if not with_package:
        declarations = declarations.withColumn("package_name", F.lit(None).cast("string"))
    gathered = declarations.groupBy(*FILE).agg(
        F.array_sort(F.collect_list(F.struct("seg", "imports", "exports", "symbols"))).alias("_d"),
        F.max("package_name").alias("package_name"),
    )
    return gathered.select(
        *FILE,
        F.flatten("_d.imports").alias("imports"),
        F.flatten("_d.exports").alias("exports"),
        F.flatten("_d.symbols").alias("symbols"),
        "package_name",
    )


def index_corpus(files: DataFrame) -> DataFrame:
    """File records of everything whose ``outcome`` (see admission) is ``indexed``.

    files: project_id, path, outcome, content.
    """
    base = classify_files(files.filter(F.col("outcome") == "indexed"))
    semantic = base.filter(F.col("kind") == "semantic").select(*FILE, "language", "text")
    scripts = _per_file(ts_declarations(semantic.filter(F.col("language") != "java")), False)
    java = _per_file(java_declarations(semantic.filter(F.col("language") == "java")), True)
    declared = scripts.unionByName(java)
    joined = base.join(declared, FILE, "left")
    nested = {c: F.coalesce(c, F.array().cast(k)) for c, k in (("imports", IMPORT_TYPE), ("exports", EXPORT_TYPE), ("symbols", SYMBOL_TYPE))}
    indexed = joined.withColumns(nested).select(
        *FILE,
        "kind",
        "language",
        "content_hash",
        "size_bytes",
        "lexical_terms",
        "imports",
        "exports",
        "symbols",
        dependency_names(F.col("imports"), F.col("exports"), F.col("symbols")).alias("dependencies"),
        "package_name",
        "degraded_reason",
    )
    return indexed


def index_warnings(indexed: DataFrame, outcomes: DataFrame) -> DataFrame:
    """One warning per degraded or unreadable file.  outcomes: project_id, path, outcome, message."""
    degraded = indexed.filter(F.col("degraded_reason").isNotNull()).select(
        *FILE, F.lit("parse-error").alias("code"), bounded_message("degraded_reason").alias("message")
    )
    unread = outcomes.filter(F.col("outcome") == "read-error").select(
        *FILE, F.lit("read-error").alias("code"), bounded_message("message").alias("message")
    )
    return degraded.unionByName(unread)


def warnings_summary(warnings: DataFrame) -> DataFrame:
    return warnings.groupBy("project_id", "code").agg(F.count(F.lit(1)).alias("n"))
