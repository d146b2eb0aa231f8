"""Registered queries of the core and their SQL."""

from setweave.catalog import exported, graphs, measures, reports, skewed, texts

_MODULES = (exported, graphs, measures, reports, skewed, texts)
QUERIES = {k: f for m in _MODULES for k, f in m.QUERIES.items()}
SQL = {k: s for m in _MODULES for k, s in m.SQL.items()}
