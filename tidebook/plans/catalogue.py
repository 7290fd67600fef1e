"""Queries by name, and their SQL."""

from __future__ import annotations

from . import books, desk, features, joins, runs, store, streams

MODULES = [features, joins, books, runs, streams, store, desk]
QUERIES = {name: f for m in MODULES for name, f in m.QUERIES.items()}
ORACLE_SQL = {name: sql for m in MODULES for name, sql in m.SQL.items()}
