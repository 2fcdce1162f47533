"""SQL that DuckDB runs on the same tables, for each registered query."""

from __future__ import annotations

from gaugeworks.plans import queries  # noqa: F401  (registers)
from gaugeworks.plans.registry import ORACLES


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
