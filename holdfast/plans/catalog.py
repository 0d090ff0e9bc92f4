"""All registered queries."""

from holdfast.plans import decision_queries, drift_queries, explore_queries, label_queries, metric_queries, model_queries, schema_queries, source_queries  # noqa: F401
from holdfast.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
