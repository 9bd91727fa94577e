"""Numeric features side by side."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seedscape.operators.clusters import average_distance
from seedscape.operators.similarity import embedding_similarity, title_similarity
from seedscape.operators.totals import attach_totals

#: A feature of a run: from candidates, seeds and run keys to a table of run keys, ``id`` and one value.
Feature = Callable[[DataFrame, DataFrame, Sequence[str]], DataFrame]

# The default features of a run.
DEFAULT_FEATURES = ("avg_distance", "ef", "title_similarity")


def column_feature(rows: DataFrame, column: str, name: str | None = None) -> DataFrame:
    """One numeric column as a feature."""
    return rows.select("id", F.col(column).cast("double").alias(name or column))


def distance_to_seed_mean(
    rows: DataFrame, seeds: DataFrame, column: str, by: Sequence[str] = (), out_col: str | None = None
) -> DataFrame:
    """Add the absolute distance of a number to the seeds' mean of it."""
    mean = seeds.groupBy(*by).agg(F.avg(column).alias("_seed_mean"))
    placed = attach_totals(rows, mean, by, salt_on=["id"])
    return placed.withColumn(out_col or f"{column}_distance", F.abs(F.col(column) - F.col("_seed_mean"))).drop("_seed_mean")


def feature_union(base: DataFrame, features: Sequence[DataFrame], by: Sequence[str] = ()) -> DataFrame:
    """``base`` with the columns of each feature table; an item without a value gets 0."""
    joined = base
    names: list[str] = []
    for table in features:
        names += [c for c in table.columns if c not in (*by, "id")]
        joined = joined.join(table, [*by, "id"], "left")
    return joined.fillna(0.0, subset=names)


def cluster_distance(candidates: DataFrame, seeds: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Feature: average cluster distance to the seeds."""
    return average_distance(candidates.select(*by, "id", "cl"), seeds, by).select(*by, "id", "avg_distance")


def rank_value(candidates: DataFrame, seeds: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Feature: the paper's rank."""
    return candidates.select(*by, "id", F.col("ef").cast("double").alias("ef"))


def title_feature(title_col: str = "title") -> Feature:
    """Feature: similarity of the title to the seeds' titles."""

    def feature(candidates: DataFrame, seeds: DataFrame, by: Sequence[str] = ()) -> DataFrame:
        similar = title_similarity(candidates.select(*by, "id", title_col), seeds, by, title_col)
        return similar.select(*by, "id", "title_similarity")

    return feature


def seed_mean_feature(column: str) -> Feature:
    """Feature: distance of a number to the seeds' mean of it."""

    def feature(candidates: DataFrame, seeds: DataFrame, by: Sequence[str] = ()) -> DataFrame:
        placed = distance_to_seed_mean(candidates.select(*by, "id", column), seeds, column, by, "_value")
        return placed.select(*by, "id", F.col("_value").cast("double").alias("value"))

    return feature


def embedding_feature(embeddings: DataFrame) -> Feature:
    """Feature: similarity of the item's vector to the seeds' mean vector."""

    def feature(candidates: DataFrame, seeds: DataFrame, by: Sequence[str] = ()) -> DataFrame:
        similar = embedding_similarity(candidates.select(*by, "id"), seeds, embeddings, by)
        return similar.select(*by, "id", F.col("embedding_similarity").cast("double").alias("value"))

    return feature


def default_feature_set(title_col: str = "title") -> dict[str, Feature]:
    """The features of a run unless others are given."""
    return dict(zip(DEFAULT_FEATURES, (cluster_distance, rank_value, title_feature(title_col))))


def with_features(
    candidates: DataFrame, seeds: DataFrame, features: Mapping[str, Feature], by: Sequence[str] = ()
) -> DataFrame:
    """``candidates`` with a column per named feature; an item without a value gets 0.

    ``candidates`` should be a written table: every feature reads it for itself.
    """
    tables = []
    for name, feature in features.items():
        table = feature(candidates, seeds, by)
        (value,) = [c for c in table.columns if c not in (*by, "id")]
        tables.append(table.select(*by, "id", F.col(value).alias(name)))
    return feature_union(candidates.drop(*features), tables, by)


def default_features(
    candidates: DataFrame, seeds: DataFrame, by: Sequence[str] = (), title_col: str = "title", titles: bool = True
) -> DataFrame:
    """Candidates with the average cluster distance, the rank and, if wanted, the title similarity."""
    chosen = default_feature_set(title_col)
    if not titles:
        del chosen["title_similarity"]
    return with_features(candidates, seeds, chosen, by)


def assembler(columns: Sequence[str], out_col: str = "features") -> VectorAssembler:
    return VectorAssembler(inputCols=list(columns), outputCol=out_col)
