"""Versioned workspace state: overlay, publication, queries and capsules."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import overlay as ov
from ..operators import search, turns
from ..operators.ordered import top_k
from ..params import Params
from ..session import scratch, stored
from .corpus import Index, search_corpus, write_index

KEY = ["project_id", "path"]

NO_STATE = "no workspace state for this project"


class Workspace(NamedTuple):
    files: DataFrame
    warnings: DataFrame
    dirty: DataFrame
    pending: DataFrame
    revision: DataFrame
    freshness: DataFrame


def stage(workspace: Workspace) -> Workspace:
    """Materialize every table once.  Do this before publishing or querying a state that is costly to compute."""
    return Workspace(*[stored(df) for df in workspace])


def overlay(
    base: DataFrame,
    indexed: dict[str, DataFrame],
    heads: DataFrame,
    previous_files: DataFrame | None = None,
    previous_dirty: DataFrame | None = None,
    changed: DataFrame | None = None,
) -> Workspace:
    """Effective files and consistency state of every project.

    base: file records of the last full index.  indexed: output of ``index_files`` for the current state.
    With ``changed`` (project_id, path, tracked) only listed paths can be dirty and untouched base files stay.
    """
    outcomes = indexed["outcomes"]
    failed = outcomes.filter(F.col("outcome") == "read-error")
    earlier = base if previous_files is None else previous_files
    if previous_dirty is None:
        previous_dirty = base.select(*KEY, "content_hash").filter(F.lit(False))
    carried = earlier.join(failed.select(*KEY), KEY, "left_semi")
    if changed is None:
        dirty = ov.diff_overlay(base, outcomes).filter(F.col("dirty_hash").isNotNull())
        dirty = dirty.select(*KEY, F.col("dirty_hash").alias("content_hash")).unionByName(
            previous_dirty.select(*KEY, "content_hash").join(failed.select(*KEY), KEY, "left_semi")
        )
        files = indexed["files"].unionByName(carried, allowMissingColumns=True)
    else:
        dirty = (
            ov.diff_changed(base, outcomes, changed, previous_dirty)
            .filter(F.col("dirty_hash").isNotNull())
            .select(*KEY, F.col("dirty_hash").alias("content_hash"))
        )
        touched = changed.select(*KEY).unionByName(previous_dirty.select(*KEY)).distinct()
        removed = touched.join(failed.select(*KEY), KEY, "left_anti")
        files = ov.replace_by_key(earlier, indexed["files"], removed)
    pending = failed.select(*KEY)
    projects = heads.select("project_id")
    return Workspace(
        files,
        indexed["warnings"],
        dirty,
        pending,
        ov.workspace_revision(heads, dirty),
        ov.freshness(projects, pending, failed, files, dirty),
    )


def query_map(
    workspace: Workspace,
    queries: DataFrame,
    texts: DataFrame | None = None,
    diffs: DataFrame | None = None,
    limit: int = 10,
    index: Index | None = None,
) -> dict[str, DataFrame]:
    """``results``, ``state`` per query (freshness, revision) and ``evidence`` for stale projects.

    Everything is read from one workspace state, so results and provenance always belong together.
    """
    if index is None:
        index = write_index(workspace.files, scratch(queries.sparkSession))
    results = search_corpus(index, queries, limit)
    # A query of a project without state stays, as stale.
    state = (
        queries.select("project_id", "query_id")
        .join(workspace.freshness, "project_id", "left")
        .join(workspace.revision, "project_id", "left")
        .withColumn("freshness", F.coalesce("freshness", F.lit("stale")))
    )
    files = workspace.files.select(*KEY, "lexical_terms")
    if texts is None:
        files = files.withColumn("text", F.lit(None).cast("string"))
    else:
        files = files.join(texts.select(*KEY, "text"), KEY, "left")
    evidence = ov.fallback_evidence(queries, files, workspace.freshness, diffs)
    return {"results": results, "state": state, "evidence": evidence}


def capsules(
    messages: DataFrame,
    calls: DataFrame,
    workspace: Workspace,
    heads: DataFrame,
    generation: int,
    params: Params = Params(),
    results_per_capsule: int = 8,
    index: Index | None = None,
) -> DataFrame:
    """Capsule of each model call, built once per (session, turn, rebuild epoch).

    messages: project_id, session_id, msg_idx, role, text.  calls: project_id, session_id, call_id,
    msg_idx (last message seen), call_idx, turn, epoch.
    """
    asked = turns.asof_query(messages, calls.select("project_id", "session_id", "call_id", "msg_idx"))
    # Equal queries of one project are searched once.
    queries = asked.select("project_id", "query").distinct().withColumn("query_id", F.sha2("query", 256))
    found = query_map(workspace, queries, limit=results_per_capsule, index=index)
    hits = search.clip_hit(found["results"]).groupBy("project_id", "query_id").agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("rank", "path", "kind", "matched_symbols", "symbols", "dependencies"))),
            lambda r: F.struct(
                r["path"].alias("path"),
                r["kind"].alias("kind"),
                r["matched_symbols"].alias("named"),
                r["symbols"].alias("symbols"),
                r["dependencies"].alias("dependencies"),
            ),
        ).alias("results")
    )
    evidence = found["evidence"].groupBy("project_id", "query_id").agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("rank", "kind", "path", F.substring("excerpt", 1, 1024).alias("excerpt")))),
            lambda e: F.struct(e["kind"].alias("kind"), e["path"].alias("path"), e["excerpt"].alias("excerpt")),
        ).alias("evidence")
    )
    pending = pending_heads(workspace.pending, params.map_context_max_bytes)
    key = ["project_id", "query_id"]
    payload = (
        queries.join(found["state"], key)
        .join(heads, "project_id", "left")
        .join(hits, key, "left")
        .join(evidence, key, "left")
        .join(pending, "project_id", "left")
        .withColumn("generation", F.lit(generation))
        .withColumn("error", F.when(F.col("workspace_revision").isNull(), F.lit(NO_STATE)))
    )
    empty = {
        c: F.coalesce(c, F.array().cast(payload.schema[c].dataType)) for c in ("results", "evidence", "pending_files")
    }
    built = turns.fit_capsule(payload.withColumns(empty), params.map_context_max_bytes)
    shown = (
        asked.withColumn("query_id", F.sha2("query", 256))
        .join(built.select(*key, "capsule"), key)
        .join(calls.select("project_id", "session_id", "call_id", "call_idx", "turn", "epoch"), ["project_id", "session_id", "call_id"])
    )
    return turns.freeze_per_turn(
        shown.select("project_id", "session_id", "call_id", "call_idx", "turn", "epoch", "capsule"),
        params.map_injection_mode,
    )


def pending_heads(pending: DataFrame, max_bytes: int) -> DataFrame:
    """First pending paths of each project in path order, as many as a capsule could ever show.

    A path takes at least three bytes of a capsule, so later ones would be cut anyway.
    """
    first = top_k(pending.select("project_id", "path").distinct(), ["project_id"], [F.col("path")], max_bytes // 3)
    return first.groupBy("project_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rank", "path"))), lambda p: p["path"]).alias("pending_files")
    )
