"""Ranks and running sums over groups of any size.

A plain ordered window puts a whole group into one task. Here the rows are first
cut into slices that follow each other in the wanted order; each slice is ranked
alone, and the totals of the slices before it are added.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from seedscape.scratch import materialize

SLICE = "_slice"


def running_totals(
    rows: DataFrame,
    order: Sequence[Column],
    sums: Mapping[str, Column] | None = None,
    by: Sequence[str] = (),
    slice_by: Column | None = None,
    n_slices: int | None = None,
) -> DataFrame:
    """Add ``rank``, ``n_rows`` and, per entry of ``sums``, a running and a full total.

    ``order`` must be a total order within a group for the result to be unique.
    The running total of ``x`` includes the row itself and is named ``x``; the
    group's total is ``x_total``. Rows with a null key form a group of their own.

    Slices come from a range shuffle over the keys and the order, which also splits
    a group that holds most of the rows. A range shuffle samples its borders, so
    its slices are written before they are used twice. ``slice_by`` may instead
    give a deterministic slice number that grows with the order; ``rows`` are then
    read twice and should be cheap to read.
    """
    by = list(by)
    amounts = {"rank": F.lit(1).cast("long"), **(sums or {})}
    valued = rows.withColumns({f"_{name}": amount for name, amount in amounts.items()})
    if slice_by is None:
        keys = [*[F.col(k) for k in by], *order]
        ranged = valued.repartitionByRange(n_slices, *keys) if n_slices else valued.repartitionByRange(*keys)
        sliced = materialize(ranged.withColumn(SLICE, F.spark_partition_id()), "slices")
    else:
        sliced = valued.withColumn(SLICE, slice_by)

    parts = sliced.groupBy(*by, SLICE).agg(*[F.sum(f"_{name}").alias(f"_{name}") for name in amounts])
    group = W.partitionBy(*by)
    earlier = group.orderBy(SLICE).rowsBetween(W.unboundedPreceding, -1)
    offsets = parts.select(
        *by,
        SLICE,
        *[F.coalesce(F.sum(f"_{name}").over(earlier), F.lit(0)).alias(f"_{name}_before") for name in amounts],
        *[F.sum(f"_{name}").over(group).alias("n_rows" if name == "rank" else f"{name}_total") for name in amounts],
    )
    here = W.partitionBy(*by, SLICE).orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    keys = {k: f"_of_{k}" for k in (*by, SLICE)}
    same = reduce(and_, [F.col(k).eqNullSafe(F.col(of)) for k, of in keys.items()])
    placed = sliced.join(offsets.withColumnsRenamed(keys), same).drop(*keys.values()).withColumns(
        {name: F.col(f"_{name}_before") + F.sum(f"_{name}").over(here) for name in amounts}
    )
    return placed.drop(SLICE, *[f"_{name}" for name in amounts], *[f"_{name}_before" for name in amounts])


def hash_rank(
    rows: DataFrame, id_col: str = "id", seed: int | Column = 0, by: Sequence[str] = (), n_slices: int = 4096
) -> DataFrame:
    """Repeatable random order: ``rank`` of each row by the MD5 of ``seed:id``.

    The leading digits of the hash cut the rows into even slices that need no
    sampling, so nothing is written and no task sees more than its share. ``seed``
    may be a column, for runs that each have their own. Rows without an ID or seed
    come first, in a slice of their own.
    """
    salt = (seed if isinstance(seed, Column) else F.lit(seed)).cast("string")
    hashed = rows.withColumn("_hash", F.md5(F.concat(salt, F.lit(":"), F.col(id_col).cast("string"))))
    leading = F.conv(F.substring("_hash", 1, 8), 16, 10).cast("long")
    slices = F.coalesce(F.shiftright(leading * n_slices, 32).cast("int"), F.lit(-1))
    ranked = running_totals(hashed, [F.col("_hash"), F.col(id_col)], by=by, slice_by=slices)
    return ranked.drop("_hash")
