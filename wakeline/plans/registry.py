"""All queries of the core and their SQL."""

from __future__ import annotations

from wakeline.plans import bookkeeping, nested, scores, sequences

MODULES = (nested, sequences, bookkeeping, scores)
QUERIES = {k: f for m in MODULES for k, f in m.QUERIES.items()}
SQL = {k: s for m in MODULES for k, s in m.SQL.items()}
