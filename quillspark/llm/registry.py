"""The queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from quillspark.llm import decontaminate, language, licenses, mixing, parsing, quality, scoring, secrets, simhash, tokens

_MODULES = (
    tokens,
    scoring,
    parsing,
    simhash,
    secrets,
    decontaminate,
    quality,
    mixing,
    language,
    licenses,
)


def queries() -> dict:
    return {name: query for module in _MODULES for name, query in module.QUERIES.items()}


def oracle_sql() -> dict:
    return {name: sql for module in _MODULES for name, sql in module.ORACLE.items()}
