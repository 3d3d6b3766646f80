"""Registered queries over the driver's tables, each with DuckDB SQL for the same rows where SQL can express it."""

from __future__ import annotations

from tablekeel.queries import governance, quality, relational, storage

ALL = (relational.REGISTRY, storage.REGISTRY, quality.REGISTRY, governance.REGISTRY)
QUERIES = {name: f for r in ALL for name, f in r.queries.items()}
ORACLE_SQL = {name: sql for r in ALL for name, sql in r.sql.items()}
