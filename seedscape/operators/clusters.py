"""Distances between cluster paths of whole sets, without comparing item by item.

Two paths share as many levels as they have leading sub-paths in common. Counting
the members below each sub-path therefore answers every question about pairs, and
an equi-join on sub-paths replaces the comparison of each item with each seed.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seedscape.functions.paths import SEPARATOR, depth, prefixes
from seedscape.operators.skew import lookup_join
from seedscape.operators.totals import attach_totals


def average_distance(
    papers: DataFrame,
    seeds: DataFrame,
    by: Sequence[str] = (),
    path_col: str = "cl",
    seed_path_col: str | None = None,
    out_col: str = "avg_distance",
    sep: str = SEPARATOR,
) -> DataFrame:
    """Add the mean tree distance of each paper to all seeds of its run.

    Seeds are counted per (sub-path, depth) and papers are reduced to their distinct
    paths before the join. A paper without a path gets null.
    """
    seed_path = F.col(seed_path_col or path_col)
    known = seeds.where(seed_path.isNotNull()).select(*by, seed_path.alias("_path"))
    below = (
        known.select(*by, F.explode(prefixes(F.col("_path"), sep)).alias("_prefix"), depth(F.col("_path"), sep).alias("_seed_depth"))
        .groupBy(*by, "_prefix", "_seed_depth")
        .agg(F.count("*").alias("_n"))
    )
    totals = known.groupBy(*by).agg(F.count("*").alias("_n_seeds"))

    path = F.col(path_col)
    paths = papers.where(path.isNotNull()).select(*by, path_col).distinct()
    steps = paths.select(*by, path_col, depth(path, sep).alias("_depth"), F.explode(prefixes(path, sep)).alias("_prefix"))
    met = lookup_join(steps, below, [*by, "_prefix"], "left", salt_on=[path_col])
    overlap = 2.0 * F.col("_n") / (F.col("_depth") + F.col("_seed_depth"))
    scored = met.groupBy(*by, path_col).agg(F.coalesce(F.sum(overlap), F.lit(0.0)).alias("_overlap"))
    distances = attach_totals(scored, totals, by, salt_on=[path_col]).select(
        *by, path_col, (1.0 - F.try_divide("_overlap", "_n_seeds")).alias(out_col)
    )
    return lookup_join(papers, distances, [*by, path_col], "left", salt_on=["id"])


def _members_below(group: DataFrame, path_col: str, sep: str, name: str, by: Sequence[str]) -> DataFrame:
    """Members of a group below every sub-path, the empty one at level 0 included, by depth."""
    path = F.col(path_col)
    levels = F.concat(F.array(F.lit("")), prefixes(path, sep))
    return (
        group.where(path.isNotNull())
        .groupBy(*by, path_col)
        .agg(F.count("*").alias("_m"))
        .select(*by, depth(path, sep).alias(f"_depth_{name}"), "_m", F.posexplode(levels).alias("_level", "_prefix"))
        .groupBy(*by, "_level", "_prefix", f"_depth_{name}")
        .agg(F.sum("_m").cast("decimal(19,0)").alias(f"_n_{name}"))
    )


def _pairs_by_distance(left: DataFrame, right: DataFrame, path_col: str, sep: str, by: Sequence[str]) -> DataFrame:
    """Number of ordered pairs at each path length, equal paths included.

    Pairs sharing exactly k levels are those below a common level-k sub-path less
    those below a common level-(k+1) sub-path.
    """
    a = _members_below(left, path_col, sep, "a", by)
    b = _members_below(right, path_col, sep, "b", by)
    shared = a.join(b, [*by, "_level", "_prefix"])
    n: Column = F.col("_n_a") * F.col("_n_b")
    apart = F.col("_depth_a") + F.col("_depth_b") - 2 * F.col("_level")
    changes = F.array(
        F.struct(apart.alias("distance"), n.alias("n")),
        F.struct((apart + 2).alias("distance"), F.when(F.col("_level") > 0, -n).alias("n")),
    )
    counted = shared.select(*by, F.inline(changes)).where(F.col("n").isNotNull())
    return counted.groupBy(*by, "distance").agg(F.sum("n").alias("n_pairs"))


def distances_between(
    left: DataFrame, right: DataFrame, by: Sequence[str] = (), path_col: str = "cl", sep: str = SEPARATOR
) -> DataFrame:
    """All path lengths between two groups, equal paths skipped, as ``(distance, n_pairs)``.

    The list of pairs would be as long as the product of the groups; its content is
    fully described by how often each length occurs.
    """
    pairs = _pairs_by_distance(left, right, path_col, sep, by)
    return pairs.where((F.col("distance") > 0) & (F.col("n_pairs") > 0))


def distances_within(
    group: DataFrame, by: Sequence[str] = (), path_col: str = "cl", sep: str = SEPARATOR
) -> DataFrame:
    """Path lengths of all unordered pairs of one group, as ``(distance, n_pairs)``."""
    ordered = _pairs_by_distance(group, group, path_col, sep, by)
    selves = (
        group.where(F.col(path_col).isNotNull())
        .groupBy(*by)
        .agg((-F.count("*")).cast("decimal(38,0)").alias("n_pairs"))
        .withColumn("distance", F.lit(0))
    )
    both = ordered.unionByName(selves).groupBy(*by, "distance").agg(F.sum("n_pairs").alias("n_pairs"))
    halves = both.withColumn("n_pairs", (F.col("n_pairs") / 2).cast("decimal(38,0)"))
    return halves.where(F.col("n_pairs") > 0)
