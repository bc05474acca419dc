"""All registered queries."""

from . import (  # noqa: F401  (importing registers the queries)
    q_fit,
    q_grid,
    q_metrics,
    q_pairs,
    q_scalar,
    q_series,
    q_sources,
    q_stats,
    q_survey,
)
from .registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
