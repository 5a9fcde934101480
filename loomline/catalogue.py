"""The queries of the engine's own operators and their SQL, by name."""

from __future__ import annotations

from .plans import annotations, casts, conversations, files, merges, scripts, stored, tables, texts

QUERIES: dict = {}
SQL: dict = {}
for _plan in (conversations, texts, tables, annotations, scripts, casts, merges, stored, files):
    QUERIES |= _plan.QUERIES
    SQL |= _plan.SQL
