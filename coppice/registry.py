"""The registered queries and their SQL twins, gathered from the operator modules."""

from __future__ import annotations

import importlib

#: Modules with QUERIES (name -> function of spark and folder) and SQL (name -> DuckDB text).
MODULES: tuple[str, ...] = (
    "coppice.operators.tree",
    "coppice.operators.refs",
    "coppice.operators.versions",
    "coppice.operators.recovery",
    "coppice.operators.edits",
    "coppice.operators.generations",
    "coppice.operators.stats",
    "coppice.operators.admission",
    "coppice.operators.scopes",
    "coppice.operators.audit",
    "coppice.operators.scalars",
    "coppice.operators.vectors",
    "coppice.operators.pivots",
    "coppice.operators.extensions",
    "coppice.sources.files",
    "coppice.streaming.jobs",
)


def queries() -> dict:
    out: dict = {}
    for name in MODULES:
        out |= importlib.import_module(name).QUERIES
    return out


def oracle_sql() -> dict[str, str]:
    out: dict = {}
    for name in MODULES:
        out |= importlib.import_module(name).SQL
    return out
