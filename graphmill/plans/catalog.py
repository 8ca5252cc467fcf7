"""All core queries by name, and their SQL."""

from __future__ import annotations

from . import batches, checks, graphs, prepare, scores, tables, words

QUERIES = {}
SQL: dict[str, str] = {}
for module in (checks, prepare, words, batches, tables, graphs, scores):
    QUERIES |= module.QUERIES
    SQL |= module.SQL
