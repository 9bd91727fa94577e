"""Exact-size random splits and samples that any engine can repeat."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seedscape.operators.ordering import hash_rank


def split_seeds(
    ids: DataFrame, sample_size: int | Column, seed: int | Column = 999, by: Sequence[str] = (), id_col: str = "id"
) -> DataFrame:
    """Flag exactly ``sample_size`` IDs as ``is_seed``; the others are the targets to find.

    ``sample_size`` may be a column expression over ``n_rows``, the length of the list.
    """
    size = sample_size if isinstance(sample_size, Column) else F.lit(sample_size)
    ranked = hash_rank(ids, id_col, seed, by)
    return ranked.withColumn("is_seed", F.col("rank") <= size).drop("rank", "n_rows")


def split_train(rows: DataFrame, seed: int | Column = 999, by: Sequence[str] = (), id_col: str = "id") -> DataFrame:
    """Flag four fifths of the rows, rounded down, as ``is_train``."""
    ranked = hash_rank(rows, id_col, seed, by)
    train_rows = F.floor(F.col("n_rows") * 4 / 5)
    return ranked.withColumn("is_train", F.col("rank") <= train_rows).drop("rank", "n_rows")


def sample_rows(rows: DataFrame, n: int, seed: int | Column = 999, by: Sequence[str] = (), id_col: str = "id") -> DataFrame:
    """Exactly ``n`` rows (of each group), chosen by hash order."""
    return hash_rank(rows, id_col, seed, by).where(F.col("rank") <= n).drop("rank", "n_rows")
