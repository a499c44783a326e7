"""All registered queries."""

from egresslens.plans import disk_queries, model_queries, text_queries, traffic_queries  # noqa: F401  (they register)
from egresslens.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
