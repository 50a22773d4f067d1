"""Queries of this package; ``__spark_entry__.py`` adds them to the others."""

from __future__ import annotations

from domweave.plans.registry import table  # noqa: F401

QUERIES: dict = {}
SQL: dict = {}


def query(name: str, sql: str | None = None):
    def register(build):
        QUERIES[name] = build
        if sql is not None:
            SQL[name] = sql
        return build

    return register
