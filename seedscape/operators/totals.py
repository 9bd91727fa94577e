"""Putting group totals next to rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seedscape.operators.skew import lookup_join


def attach_totals(
    rows: DataFrame, totals: DataFrame, by: Sequence[str] = (), salt_on: Sequence[str] | None = None
) -> DataFrame:
    """Add the columns of ``totals``, one row per group or a single row without groups.

    The single row becomes scalar subqueries, so no join runs at all.
    """
    if not by:
        return rows.withColumns({c: totals.select(F.first(c)).scalar() for c in totals.columns})
    return lookup_join(rows, totals, by, "left", salt_on)
