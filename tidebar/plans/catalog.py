"""Every query of the engine by name, with the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from tidebar.plans import bars_and_features, blocks, contexts, executions, figures, governed, laws, micro, mining, paths, profile, registry, research, shapes, tables, verdicts, widebase

_PARTS = (bars_and_features, blocks, research, widebase, figures, micro, profile, registry, tables, paths, laws, executions, mining, shapes, governed, contexts, verdicts)


def queries() -> dict[str, Callable]:
    return {name: f for part in _PARTS for name, f in part.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for part in _PARTS for name, sql in part.SQL.items()}
