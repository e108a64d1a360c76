"""All core queries and their SQL."""

from __future__ import annotations

from basewise.plans import data_quality, events, lookups, models, profiles, regions, sequences, streams

MODULES = [data_quality, regions, events, lookups, profiles, sequences, models, streams]
QUERIES = {k: f for m in MODULES for k, f in m.QUERIES.items()}
SQL = {k: s for m in MODULES for k, s in m.SQL.items()}
