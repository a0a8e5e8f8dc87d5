"""All registered queries, by area."""

from __future__ import annotations

from importlib import import_module

AREAS = ("archive", "context", "corpus", "storage")


def _merged(attribute: str) -> dict:
    out: dict = {}
    for area in AREAS:
        found = getattr(import_module(f"workload.{area}"), attribute)
        clash = set(out) & set(found)
        if clash:
            raise ValueError(f"registered twice: {sorted(clash)}")
        out.update(found)
    return out


def queries() -> dict:
    return _merged("QUERIES")


def oracle_sql() -> dict:
    return _merged("ORACLES")
