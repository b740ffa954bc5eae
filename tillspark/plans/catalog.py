"""All registered queries."""

from tillspark.plans import (  # noqa: F401
    cleaning_queries,
    forecast_queries,
    kpi_queries,
    model_queries,
    segment_queries,
    series_queries,
    stream_queries,
)
from tillspark.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
