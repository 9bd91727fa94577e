"""Every operator as a query over the driver's tables, with a DuckDB statement to check it."""

from checks.fixtures import ORACLES, QUERIES, TABLES
from checks import sources, preparation, graph, matching, features, ranking, results, models, fits  # noqa: F401

__all__ = ["ORACLES", "QUERIES", "TABLES"]
