"""All registered queries of the road-network engine."""

from roadspark.plans import analytics, mapping, mobility, network, roads, tours, turns  # noqa: F401
from roadspark.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
