"""Registered queries: each key has a Spark plan and, where SQL can express it, a DuckDB twin."""

from tablescope.plans.registry import ORACLES, QUERIES
from tablescope.plans import (  # noqa: F401  (importing registers the queries)
    charts, cleaning, models, reports, sql_shapes, statistics, tables, transforms,
)

__all__ = ["ORACLES", "QUERIES"]
