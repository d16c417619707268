"""Registered queries: each reads the given tables and pairs with the SQL that states its answer."""

from tracemill.plans.registry import ORACLES, QUERIES  # noqa: F401
from tracemill.plans import conversations, datasets, difficulty, episodes, evaluation, records, rollout_groups, store, streams  # noqa: F401
