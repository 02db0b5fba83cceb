"""Registered queries of the core and the SQL each is held against."""

from __future__ import annotations


def _modules():
    from . import mapping, quality

    return [mapping, quality]


def all_queries() -> dict:
    return {k: f for m in _modules() for k, f in m.QUERIES.items()}


def all_oracle_sql() -> dict[str, str]:
    return {k: s for m in _modules() for k, s in getattr(m, "ORACLE_SQL", {}).items()}


def flagship(spark, d):
    return all_queries()["check_report"](spark, d)
