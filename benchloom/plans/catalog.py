"""All registered queries."""

from __future__ import annotations

from benchloom.plans import (
    classify_plans, graph_plans, history_plans, rating_plans, record_plans, sql_plans, stream_plans,
)
from benchloom.plans.registry import Registry

ALL = Registry().merge(
    sql_plans.registry, record_plans.registry, history_plans.registry, graph_plans.registry,
    rating_plans.registry, classify_plans.registry, stream_plans.registry,
)

# Those of this catalog alone, whatever is merged into it later.
CORE = frozenset(ALL.queries)
