"""Garbage collection of the archive and maintenance of map generations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import retention as rt


def collect_garbage(
    metadata: DataFrame, inventory: DataFrame, referenced: DataFrame, now: Column, days: int, quota: int
) -> dict[str, DataFrame]:
    """``decisions`` per artifact, ``report`` per project, and the ``metadata`` that stays."""
    if days < 0 or quota < 0:
        raise ValueError("days and quota must not be negative")
    candidates = rt.gc_candidates(metadata, inventory, referenced)
    decisions = rt.evict(rt.expire(candidates, days, now), quota)
    gone = decisions.filter("deleted").select("project_id", "artifact_id")
    return {
        "decisions": decisions,
        "report": rt.gc_report(decisions, quota),
        "metadata": metadata.join(gone, ["project_id", "artifact_id"], "left_anti"),
    }


def maintenance(ledger: DataFrame, retention: int, quota: int) -> dict[str, DataFrame]:
    """``decisions`` per generation and ``report`` per project."""
    pruned = rt.prune_generations(ledger, retention, quota)
    return {"decisions": pruned, "report": rt.generation_report(pruned, quota)}
