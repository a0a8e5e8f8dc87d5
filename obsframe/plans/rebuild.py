"""Full re-index of projects and publication of the result."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame

from ..sources.generations import publish_generation, read_active
from .corpus import index_files
from .workspace import Workspace, overlay, stage


def rebuild(
    files: DataFrame,
    heads: DataFrame,
    root: str,
    now: Column,
    rules: Sequence[str] | DataFrame = (),
    exclude: Sequence[str] = (),
) -> tuple[Workspace, DataFrame]:
    """Index everything again; where reading failed, the record and dirty hash of the active generation stay.

    Returns the workspace and what was published.
    """
    indexed = index_files(files, rules, exclude, stage=True)
    active = read_active(heads.sparkSession, root)
    previous = active["files"].drop("generation")
    fresh_base = indexed["files"].unionByName(
        previous.join(
            indexed["outcomes"].filter("outcome = 'read-error'").select("project_id", "path"),
            ["project_id", "path"],
            "left_semi",
        )
    )
    workspace = stage(
        overlay(fresh_base, indexed, heads, previous_files=previous, previous_dirty=active["dirty"].drop("generation"))
    )
    return workspace, publish_generation(workspace, heads, root, now)
