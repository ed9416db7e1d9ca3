"""Registered queries of the core engine and their independent SQL."""

from __future__ import annotations

from . import declared, retrieval, structure

FAMILIES = (retrieval, structure, declared)


def queries() -> dict:
    return {k: v for m in FAMILIES for k, v in m.Q.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for m in FAMILIES for k, v in m.SQL.items()}


def entry(spark, sf_dir: str):
    return queries()["hybrid_search"](spark, sf_dir)
