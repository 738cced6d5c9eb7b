"""Query plans over the given tables, with their SQL counterparts."""

from tideline.plans import (  # noqa: F401
    learning,
    metrics,
    partitions,
    quality,
    scoring_queries,
    stateful,
    streams,
    text_queries,
)
from tideline.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
