"""Workspace state on top of a base snapshot: dirty set, revision and freshness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.paths import has_excluded_segment
from ..functions.text import excerpt, query_terms
from .ordered import CHUNK, Running, row_chunks, running, top_k

KEY = ["project_id", "path"]
DELETED = "deleted"
BUCKET_DIGITS = 3


def non_regular_hash(path: Column | str) -> Column:
    path = F.col(path) if isinstance(path, str) else path
    return F.sha2(F.concat(F.lit("non-regular\0"), path), 256)


def diff_overlay(base: DataFrame, current: DataFrame) -> DataFrame:
    """Per path: ``status`` (clean, dirty, pending) and ``dirty_hash``.

    base: project_id, path, content_hash.  current: project_id, path, outcome, content_hash; a base path
    that current does not list is missing.
    """
    both = base.select(*KEY, F.col("content_hash").alias("_base")).join(
        current.select(*KEY, "outcome", F.col("content_hash").alias("_new")), KEY, "full_outer"
    )
    outcome = F.coalesce("outcome", F.lit("missing"))
    in_base = F.col("_base").isNotNull()
    dirty_hash = (
        F.when((outcome == "indexed") & ~F.col("_new").eqNullSafe(F.col("_base")), F.col("_new"))
        .when(in_base & (outcome == "missing"), F.lit(DELETED))
        .when(in_base & (outcome == "non-text"), F.col("_new"))
        .when(in_base & (outcome == "non-regular"), non_regular_hash("path"))
    )
    return both.withColumn("dirty_hash", dirty_hash).select(
        *KEY,
        outcome.alias("outcome"),
        "dirty_hash",
        F.when(outcome == "read-error", "pending")
        .when(F.col("dirty_hash").isNotNull(), "dirty")
        .otherwise("clean")
        .alias("status"),
    )


def paths_to_refresh(dirty: DataFrame, previous: DataFrame, failures: DataFrame) -> DataFrame:
    return union_distinct(dirty.select(*KEY), previous.select(*KEY), failures.select(*KEY))


def union_distinct(*dfs: DataFrame) -> DataFrame:
    out = dfs[0]
    for df in dfs[1:]:
        out = out.unionByName(df)
    return out.distinct()


def diff_changed(base: DataFrame, current: DataFrame, changed: DataFrame, previous_dirty: DataFrame) -> DataFrame:
    """Dirty set under a change list: listed and admitted paths are dirty even when equal to the base.

    changed: project_id, path, tracked.  previous_dirty: project_id, path, content_hash.  ``base`` only
    matters to the files themselves, not to this set.
    """
    listed = changed.filter(~has_excluded_segment("path")).select(*KEY, "tracked")
    previous = previous_dirty.select(*KEY, F.col("content_hash").alias("_previous"))
    failures = current.filter(F.col("outcome") == "read-error")
    refreshed = (
        paths_to_refresh(listed, previous, failures)
        .join(current.select(*KEY, "outcome", F.col("content_hash").alias("_new")), KEY, "left")
        .join(listed, KEY, "left")
        .join(previous, KEY, "left")
        .withColumn("outcome", F.coalesce("outcome", F.lit("missing")))
    )
    is_listed = F.col("tracked").isNotNull()
    dirty_hash = (
        F.when((F.col("outcome") == "read-error") & F.col("_previous").isNotNull(), F.col("_previous"))
        .when(is_listed & (F.col("outcome") == "indexed"), F.col("_new"))
        .when(is_listed & (F.col("outcome") == "missing"), F.lit(DELETED))
        .when(F.col("tracked") & (F.col("outcome") == "non-text"), F.col("_new"))
        .when(F.col("tracked") & (F.col("outcome") == "non-regular"), non_regular_hash("path"))
    )
    return refreshed.select(*KEY, "outcome", dirty_hash.alias("dirty_hash"))


def carry_forward(current: DataFrame, previous: DataFrame) -> DataFrame:
    """Where reading failed, keep the earlier record and dirty hash and mark the path pending.

    current: project_id, path, outcome, content_hash.  previous: project_id, path, content_hash, dirty_hash.
    """
    earlier = previous.select(
        *KEY, F.col("content_hash").alias("_hash"), F.col("dirty_hash").alias("_dirty"), F.lit(True).alias("_had")
    )
    failed = F.col("outcome") == "read-error"
    return current.join(earlier, KEY, "left").select(
        *KEY,
        "outcome",
        F.when(failed, F.col("_hash")).otherwise(F.col("content_hash")).alias("content_hash"),
        F.when(failed, F.col("_dirty")).alias("dirty_hash"),
        failed.alias("pending"),
        (failed & F.coalesce("_had", F.lit(False))).alias("carried"),
    )


def replace_by_key(snapshot: DataFrame, updates: DataFrame, removed: DataFrame, key: list[str] = KEY) -> DataFrame:
    """Drop every touched key from the snapshot, then add the updates."""
    touched = updates.select(*key).unionByName(removed.select(*key)).distinct()
    return snapshot.join(touched, key, "left_anti").unionByName(updates, allowMissingColumns=True)


def overlay_changed(previous: DataFrame, current: DataFrame) -> DataFrame:
    """Projects whose dirty set differs, as ``(project_id, changed_rows)``."""
    columns = [*KEY, "content_hash"]
    before, after = previous.select(*columns), current.select(*columns)
    return (
        before.exceptAll(after)
        .unionByName(after.exceptAll(before))
        .groupBy("project_id")
        .agg(F.count(F.lit(1)).alias("changed_rows"))
    )


def _digest(rows: DataFrame, keys: list[str]) -> DataFrame:
    entries = F.array_sort(F.collect_list(F.struct("path", "content_hash")))
    text = F.array_join(
        F.transform(entries, lambda e: F.concat(e["path"], F.lit("\0"), e["content_hash"])), "\0"
    )
    return rows.groupBy(*keys).agg(text.alias("_text"))


def workspace_revision(head: DataFrame, dirty: DataFrame) -> DataFrame:
    """SHA-256 over the head and the dirty set; independent of event order, one definition for every size.

    Entries are hashed in 4,096 buckets by the first three digits of the MD5 of their path; the ordered bucket digests
    stand in for the entries, so no task gathers a whole project.
    """
    bucketed = dirty.select(*KEY, "content_hash").withColumn("_b", F.left(F.md5("path"), F.lit(BUCKET_DIGITS)))
    folded = _digest(bucketed, ["project_id", "_b"]).select(
        "project_id", F.col("_b").alias("path"), F.sha2("_text", 256).alias("content_hash")
    )
    return head.join(_digest(folded, ["project_id"]), "project_id", "left").select(
        "project_id",
        F.sha2(
            F.when(F.col("_text").isNull(), F.col("head")).otherwise(F.concat("head", F.lit("\0"), "_text")), 256
        ).alias("workspace_revision"),
    )


def freshness(
    projects: DataFrame, pending: DataFrame, read_failures: DataFrame, files: DataFrame, dirty: DataFrame
) -> DataFrame:
    """stale, else unsupported, else dirty, else fresh."""

    def flag(df: DataFrame, name: str) -> DataFrame:
        return df.select("project_id").distinct().withColumn(name, F.lit(True))

    degraded = files.filter(F.col("degraded_reason").isNotNull())
    stale = flag(pending.select("project_id").unionByName(read_failures.select("project_id")), "_stale")
    out = projects.select("project_id").distinct().join(stale, "project_id", "left")
    out = out.join(flag(degraded, "_degraded"), "project_id", "left").join(flag(dirty, "_dirty"), "project_id", "left")
    return out.select(
        "project_id",
        F.when(F.col("_stale"), "stale")
        .when(F.col("_degraded"), "unsupported")
        .when(F.col("_dirty"), "dirty")
        .otherwise("fresh")
        .alias("freshness"),
    )


def fallback_evidence(
    queries: DataFrame, files: DataFrame, freshness: DataFrame, diffs: DataFrame | None = None, k: int = 3
) -> DataFrame:
    """Direct evidence for queries on stale projects: the first files sharing a term, the diff, or a stand-in.

    queries: project_id, query_id, query.  files: project_id, path, lexical_terms, text (nullable).
    Only the first ``k`` paths per (project, term) can be among the first ``k`` of a query, so the term
    lists are cut before they meet the queries; terms that no query asks are never sorted.
    """
    stale = freshness.filter(F.col("freshness") == "stale").select("project_id")
    asked = queries.join(stale, "project_id", "left_semi")
    terms = asked.select("project_id", "query_id", F.explode(F.array_distinct(query_terms("query"))).alias("term"))
    held = files.select("project_id", "path", F.explode(F.array_distinct("lexical_terms")).alias("term"))
    heads = top_k(
        held.join(terms.select("project_id", "term").distinct(), ["project_id", "term"], "left_semi"),
        ["project_id", "term"],
        [F.col("path")],
        k,
        "_r",
    ).drop("_r")
    shared = terms.join(heads, ["project_id", "term"]).select("project_id", "query_id", "path").distinct()
    best = top_k(shared, ["project_id", "query_id"], [F.col("path")], k)
    kinds = best.select("project_id", "query_id", "rank", F.lit("source").alias("kind"), "path")
    shown = kinds.join(
        files.select(*KEY, excerpt("text", "lexical_terms").alias("excerpt")), KEY
    )
    if diffs is not None:
        diff_rows = asked.join(diffs.filter(F.col("diff") != ""), "project_id").select(
            "project_id",
            "query_id",
            F.lit(k + 1).alias("rank"),
            F.lit("diff").alias("kind"),
            F.lit(None).cast("string").alias("path"),
            F.substring("diff", 1, 16 * 1024).alias("excerpt"),
        )
        shown = shown.unionByName(diff_rows)
    without = asked.select("project_id", "query_id").join(shown, ["project_id", "query_id"], "left_anti")
    first = files.groupBy("project_id").agg(
        F.min_by(F.struct("path", excerpt("text", "lexical_terms").alias("excerpt")), "path").alias("_f")
    )
    stand_in = without.join(first, "project_id", "left").select(
        "project_id",
        "query_id",
        F.lit(1).alias("rank"),
        F.lit("source").alias("kind"),
        F.col("_f.path").alias("path"),
        F.coalesce("_f.excerpt", F.lit("No indexed source file is available; search the files directly.")).alias(
            "excerpt"
        ),
    )
    return shown.unionByName(stand_in)


def latest_per_path(events: DataFrame) -> DataFrame:
    """Newest event of each path by (ts, seq)."""
    values = [c for c in events.columns if c not in KEY]
    newest = events.groupBy(*KEY).agg(F.max_by(F.struct(*values), F.struct("ts", "seq")).alias("_e"))
    return newest.select(*KEY, *[F.col(f"_e.{v}").alias(v) for v in values])


def drain_batches(events: DataFrame, size: int = 64) -> DataFrame:
    """Batch number of each queued event: ``size`` per pass in queue order."""
    numbered = running(row_chunks(events, ["project_id"], F.col("seq")), ["project_id"], ["seq"], {"_row": Running("sum", F.lit(1))})
    return numbered.withColumn("batch", F.ceil(F.col("_row") / size).cast("long")).drop("_row")


def debounce(changes: DataFrame, gap: str = "300 milliseconds") -> DataFrame:
    """Quiet-gap batches per project: start, end and number of changes; rows without a time are left out.

    Times are cut into chunks, so no task holds a project.  A batch that is open at the edge of a chunk goes on in the next
    one: the latest time before a row and the number of batches before it are carried over the edges.
    """
    silence = F.expr(f"INTERVAL {gap}")
    points = changes.filter(F.col("ts").isNotNull()).groupBy("project_id", "ts").agg(F.count(F.lit(1)).alias("_n"))
    chunked = row_chunks(points, ["project_id"], F.unix_micros(F.col("ts").cast("timestamp"))).withColumnRenamed(CHUNK, "_part")
    part, key = F.col("_part"), ["project_id"]
    seen = running(chunked, key, ["ts"], {"_last": Running("max", F.col("ts"), before=True)}, part)
    opens = F.when(F.col("_last").isNull() | (F.col("ts") >= F.col("_last") + silence), 1).otherwise(0)
    numbered = running(seen, key, ["ts"], {"_batch": Running("sum", opens)}, part)
    return numbered.groupBy("project_id", "_batch").agg(
        F.min("ts").alias("started"), (F.max("ts") + silence).alias("ended"), F.sum("_n").alias("changes")
    ).drop("_batch")


def open_sessions(changes: DataFrame, gap: str) -> DataFrame:
    """The same as session windows, for streams: only batches that are not closed stay in the state."""
    return (
        changes.groupBy("project_id", F.session_window("ts", gap).alias("w"))
        .agg(F.count(F.lit(1)).alias("changes"))
        .select("project_id", F.col("w.start").alias("started"), F.col("w.end").alias("ended"), "changes")
    )


def suppress_noops(ledger: DataFrame, fields: list[str]) -> DataFrame:
    """Drop a generation equal to the one before it in every durable field."""
    hashed = ledger.withColumn("_hash", F.sha2(F.to_json(F.struct(*fields)), 256))
    marked = running(
        row_chunks(hashed, ["project_id"], F.col("generation")),
        ["project_id"],
        ["generation"],
        {"_previous": Running("last", F.col("_hash"), before=True)},
    )
    return marked.filter(F.col("_previous").isNull() | (F.col("_previous") != F.col("_hash"))).drop("_hash", "_previous")
