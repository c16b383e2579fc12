"""All queries of the detectors and their operators, with their SQL."""

from __future__ import annotations

from .queries import basics, forest, mixed, sparse, streams

ALL = basics.QUERIES | mixed.QUERIES | sparse.QUERIES | forest.QUERIES | streams.QUERIES


def queries() -> dict:
    return {name: run for name, (run, _) in ALL.items()}


def oracle_sql() -> dict:
    return {name: sql for name, (_, sql) in ALL.items() if sql}
