"""Which files enter the corpus map, and what kind of entry each of them gives."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.paths import (
    EXCLUDED_SEGMENTS,
    glob_regex,
    has_excluded_segment,
    path_prefixes,
    rule_key,
    rule_struct,
)

TEXT_PROBE_BYTES = 8192
RULES_PER_ROW = 256


def exclude_segments(df: DataFrame, segments: Sequence[str] = EXCLUDED_SEGMENTS) -> DataFrame:
    return df.filter(~has_excluded_segment("path", tuple(segments)))


def _excluded(patterns: Sequence[str]) -> Column:
    """Whether a configured glob matches the path; patterns are constants of the plan."""
    hits = [F.coalesce(F.rlike("path", glob_regex(F.lit(p))), F.lit(False)) for p in patterns]
    return reduce(or_, hits, F.lit(False))


def exclude_globs(df: DataFrame, patterns: Sequence[str]) -> DataFrame:
    return df.filter(~_excluded(patterns)) if patterns else df


def _applies(r: Column, p: Column) -> Column:
    return (p["is_directory"] | ~r["rule"]["directory_only"]) & F.rlike(
        F.when(r["rule"]["whole_path"], p["prefix"]).otherwise(p["segment"]), r["rule"]["regex"]
    )


def _table_verdict(p: Column) -> Column:
    hits = F.filter("_rules", lambda r: _applies(r, p))
    return F.coalesce(~F.try_element_at(hits, F.lit(-1))["rule"]["negated"], F.lit(False))


def _hidden_paths(paths: DataFrame, rules: DataFrame) -> DataFrame:
    """(project_id, path) with an ignored part.

    Folders and files are judged once, however many paths share them: a rule with a literal beginning meets only what lies
    there, and rules that begin with a wildcard meet every part in arrays of some hundred.  The last match of a part decides
    by ``max_by``; then each path looks for an ignored part.
    """
    node = ["project_id", "prefix", "is_directory"]
    parts = paths.select("project_id", "path", F.explode(path_prefixes("path")).alias("_p")).select("project_id", "path", "_p.*")
    nodes = parts.select(*node, "segment").distinct()
    parsed = rules.select("project_id", "rule_idx", rule_struct("pattern").alias("rule"), rule_key("pattern").alias("key")).filter("rule IS NOT NULL")
    parsed = parsed.select("project_id", "rule_idx", "rule.regex", "rule.negated", "rule.directory_only", "key.whole_path", "key.literal")

    names = F.split("prefix", "/")
    above = F.transform(
        F.sequence(F.lit(1), F.size(names)), lambda n: F.struct(F.lit(True).alias("whole_path"), F.array_join(F.slice(names, F.lit(1), n), "/").alias("literal"))
    )
    own = F.array(F.struct(F.lit(False).alias("whole_path"), F.col("segment").alias("literal")))
    offered = nodes.select(*node, "segment", F.explode(F.concat(above, own)).alias("_k")).select(*node, "segment", "_k.*")
    met = offered.join(parsed.filter("literal <> ''"), ["project_id", "whole_path", "literal"]).filter(
        (F.col("is_directory") | ~F.col("directory_only")) & F.rlike(F.when(F.col("whole_path"), F.col("prefix")).otherwise(F.col("segment")), F.col("regex"))
    )
    plain = met.groupBy(*node).agg(F.max_by("negated", "rule_idx").alias("negated"), F.max("rule_idx").alias("rule_idx"))

    wild = parsed.filter("literal = ''")
    counts = wild.groupBy("project_id").agg(F.count("*").alias("_n"))
    listed = (
        wild.join(counts, "project_id")
        .withColumn("_part", F.pmod(F.xxhash64("rule_idx"), F.ceil(F.col("_n") / RULES_PER_ROW)))
        .groupBy("project_id", "_part")
        .agg(F.array_sort(F.collect_list(F.struct("rule_idx", F.struct("regex", "negated", "directory_only", "whole_path").alias("rule")))).alias("_rules"))
    )
    last = F.try_element_at(F.filter("_rules", lambda r: _applies(r, F.struct("prefix", "segment", "is_directory"))), F.lit(-1))
    scanned = nodes.join(listed, "project_id").select(*node, last.alias("_r")).filter("_r IS NOT NULL")
    judged = plain.unionByName(scanned.select(*node, F.col("_r.rule.negated").alias("negated"), F.col("_r.rule_idx").alias("rule_idx")))
    ignored = judged.groupBy(*node).agg(F.max_by("negated", "rule_idx").alias("negated")).filter(~F.col("negated")).drop("negated")
    return parts.join(ignored, node, "left_semi").select("project_id", "path").distinct()


def mark_ignored(paths: DataFrame, rules: Sequence[str] | DataFrame) -> DataFrame:
    """Add ``ignored``: the last matching rule of some leading part of the path says so.

    ``rules`` is one list for all projects, compared inside the row of a path, or a table (project_id, rule_idx, pattern) of
    any size, which is looked up by what its lines say in plain words.
    """
    if isinstance(rules, DataFrame):
        hidden = _hidden_paths(paths, rules).withColumn("_hidden", F.lit(True))
        joined = paths.join(hidden, ["project_id", "path"], "left")
        return joined.withColumn("ignored", F.coalesce("_hidden", F.lit(False))).drop("_hidden").select(*paths.columns, "ignored")
    parsed = F.array(*[F.struct(F.lit(i).alias("rule_idx"), rule_struct(F.lit(r)).alias("rule")) for i, r in enumerate(rules)])
    ignored = F.lit(False)
    if rules:
        listed = paths.withColumn("_rules", F.filter(parsed, lambda r: r["rule"].isNotNull()))
        ignored = F.coalesce(F.exists(path_prefixes("path"), _table_verdict), F.lit(False))
        return listed.withColumn("ignored", ignored).drop("_rules")
    return paths.withColumn("ignored", ignored)


def apply_ignore_rules(paths: DataFrame, rules: Sequence[str] | DataFrame) -> DataFrame:
    return mark_ignored(paths, rules).filter(~F.col("ignored")).drop("ignored")


def admit(paths: DataFrame, rules: Sequence[str] | DataFrame, exclude: Sequence[str] = ()) -> DataFrame:
    """Built-in and configured exclusions first; no ignore rule can bring a path back."""
    return apply_ignore_rules(exclude_globs(exclude_segments(paths), exclude), rules)


def mark_admitted(paths: DataFrame, rules: Sequence[str] | DataFrame, exclude: Sequence[str] = ()) -> DataFrame:
    """All paths, with ``admitted``."""
    out = has_excluded_segment("path") | _excluded(exclude)
    return mark_ignored(paths, rules).withColumn("admitted", ~out & ~F.col("ignored")).drop("ignored")


def is_text(content: Column | str) -> Column:
    """No NUL among the first bytes."""
    content = F.col(content) if isinstance(content, str) else content
    head = F.substring(content, 1, TEXT_PROBE_BYTES)
    return ~F.contains(head, F.lit(b"\0"))


def classify_outcome(df: DataFrame) -> DataFrame:
    """Add ``outcome``.

    Columns: admitted, present, is_regular, content (null when unread), read_error, and optionally
    stat_error for an error before the file type is known.
    """
    stat_error = F.col("stat_error").isNotNull() if "stat_error" in df.columns else F.lit(False)
    return df.withColumn(
        "outcome",
        F.when(~F.col("admitted"), "ignored")
        .when(~F.col("present"), "missing")
        .when(stat_error, "read-error")
        .when(~F.col("is_regular"), "non-regular")
        .when(F.col("read_error").isNotNull() | F.col("content").isNull(), "read-error")
        .when(~is_text("content"), "non-text")
        .otherwise("indexed"),
    )
