"""The registered queries and their SQL equivalents, gathered from the plan modules."""

from __future__ import annotations

from brickwise.plans import analysis_queries, grid_queries, inspection_queries, kernel_queries

MODULES = (grid_queries, analysis_queries, kernel_queries, inspection_queries)


def _gathered(parts: list[dict]) -> dict:
    """All parts in one; a name that two of them have would hide a query."""
    out: dict = {}
    for part in parts:
        if twice := out.keys() & part.keys():
            raise ValueError(f"registered twice: {sorted(twice)}")
        out |= part
    return out


def queries() -> dict:
    return _gathered([m.Q for m in MODULES])


def oracle_sql() -> dict[str, str]:
    return _gathered([m.SQL for m in MODULES])
