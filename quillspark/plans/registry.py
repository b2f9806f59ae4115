"""Queries over the driver's tables, with the SQL they are checked against."""

from __future__ import annotations

from quillspark.plans import audits, critical, forecasts, language_models, relational, rules, stores, streams, vectors

_MODULES = (critical, relational, rules, vectors, language_models, forecasts, audits, streams, stores)


def queries() -> dict:
    return {name: query for module in _MODULES for name, query in module.QUERIES.items()}


def oracle_sql() -> dict:
    return {name: sql for module in _MODULES for name, sql in module.ORACLE.items()}
