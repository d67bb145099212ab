"""All queries of the process-log engine by name."""

from __future__ import annotations

from tracework.plans import analysis, core, process

GROUPS = (core, analysis, process)


def queries() -> dict:
    return {k: v for g in GROUPS for k, v in g.Q.items()}


def oracle_sql() -> dict:
    return {k: v for g in GROUPS for k, v in g.SQL.items()}
