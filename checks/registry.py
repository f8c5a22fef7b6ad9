"""All queries and their check SQL."""

from __future__ import annotations

from checks import forecasts, history, imports, rules, storage, streams

_MODULES = (forecasts, history, imports, rules, storage, streams)

QUERIES = {name: query for module in _MODULES for name, query in module.QUERIES.items()}
SQL = {name: sql for module in _MODULES for name, sql in module.SQL.items()}
