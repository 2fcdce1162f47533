"""All registered queries, by name."""

from __future__ import annotations

from gaugeworks.plans import alarm_queries, case_queries, document_queries, evidence_queries, experiment_queries, feature_queries, interval_queries, loop_queries, more_queries, placebo_queries, state_queries, stats_queries, stream_queries  # noqa: F401  (they register)
from gaugeworks.plans.registry import QUERIES, Query


def queries() -> dict[str, Query]:
    return dict(QUERIES)
