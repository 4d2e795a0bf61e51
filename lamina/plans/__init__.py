"""Registered queries and their SQL twins, gathered from the modules beside this one."""

from __future__ import annotations

from lamina.plans import importers, relational, scalars

MODULES = [relational, scalars, importers]


def queries() -> dict:
    return {k: f for m in MODULES for k, (f, _) in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: sql for m in MODULES for k, (_, sql) in m.QUERIES.items() if sql}
