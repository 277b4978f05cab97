"""All registered queries."""

from kilohour.queries import (  # noqa: F401
    detect_queries,
    dispatch_queries,
    forecast_queries,
    ingest_queries,
    model_queries,
    read_queries,
    series_queries,
)
from kilohour.queries.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
