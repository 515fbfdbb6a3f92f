"""Registered queries over the domain tables, one module per operator family."""

from ranklens.plans import q_sources, q_filters, q_joins, q_metrics, q_examples, q_curves, q_bandit, q_retrieval  # noqa: F401
from ranklens.plans.registry import ORACLES, QUERIES  # noqa: F401
