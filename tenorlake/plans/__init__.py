"""Named queries over the driver's tables, with SQL oracles."""

from tenorlake.plans import basic_queries, extra_queries, file_queries, model_queries, panel_queries, series_queries  # noqa: F401
from tenorlake.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
