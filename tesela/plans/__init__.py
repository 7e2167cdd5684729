"""Registered queries over the driver's tables, each with the SQL that must give the same rows."""

from __future__ import annotations

from . import archive, calendar, canonical, criteria, decisions, documents, fields, forms, indicators, insights, layout, mending, people, readings, registers, store, tables, usage

FLAGSHIP = "scanner_counts"
_MODULES = (documents, tables, usage, registers, readings, calendar, archive, people, layout, decisions, store, fields, canonical, indicators, mending, forms, insights, criteria)
QUERIES: dict = {name: query for m in _MODULES for name, query in m.QUERIES.items()}
ORACLES: dict[str, str] = {name: sql for m in _MODULES for name, sql in m.ORACLES.items()}
