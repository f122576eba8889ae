"""Queries over the driver's tables; importing the package registers them all."""

from tallyline.catalog import history_queries, panel_queries, position_queries, quality_queries, remaining_queries, text_queries, trend_queries, value_queries  # noqa: F401
from tallyline.catalog.base import CATALOG, Query, Tables

__all__ = ["CATALOG", "Query", "Tables"]
