"""Summaries of experiment results."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import combinations_with_replacement

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seedscape.operators.ordering import running_totals
from seedscape.operators.skew import lookup_join
from seedscape.operators.totals import attach_totals

QUARTILES = {"q25": 0.25, "median": 0.5, "q75": 0.75}


def describe_counts(counts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Describe values given with their frequency, as rows ``(by, value, n)``.

    Quartiles interpolate between neighbours. They are read off running counts over
    the distinct values, so neither a sort nor a value map of a whole group is
    needed in one task.
    """
    value, n = F.col("value"), F.col("n").cast("double")
    seen = running_totals(counts, [F.col("value")], {"seen": F.col("n").cast("long"), "mass": n * value}, by)
    size = F.col("seen_total")
    mean = F.col("mass_total") / size

    def at(position: Column) -> Column:
        return F.max(F.when((F.col("seen") - F.col("n") <= position) & (position < F.col("seen")), value))

    picks = {}
    for name, q in QUARTILES.items():
        position = (size - 1) * F.lit(q)
        picks[f"_{name}_low"] = at(F.floor(position))
        picks[f"_{name}_high"] = at(F.ceil(position))
        picks[f"_{name}_part"] = F.max(position - F.floor(position))
    stats = seen.groupBy(*by).agg(
        F.max(size).alias("n"),
        F.max(mean).alias("mean"),
        F.sum(n * (value - mean) * (value - mean)).alias("_squares"),
        F.min(value).alias("min"),
        F.max(value).alias("max"),
        *[expr.alias(name) for name, expr in picks.items()],
    )
    between = {
        q: F.col(f"_{q}_low") + (F.col(f"_{q}_high") - F.col(f"_{q}_low")) * F.col(f"_{q}_part") for q in QUARTILES
    }
    return stats.select(
        *by,
        "n",
        "mean",
        F.sqrt(F.try_divide("_squares", F.col("n") - 1)).alias("std"),
        "min",
        *[expr.alias(q) for q, expr in between.items()],
        "max",
    )


def describe(rows: DataFrame, columns: Sequence[str] | Mapping[str, Column], by: Sequence[str] = ()) -> DataFrame:
    """Count, mean, standard deviation, extremes and quartiles of each column, nulls aside."""
    exprs = columns if isinstance(columns, Mapping) else {c: F.col(c) for c in columns}
    pairs = F.array(*[F.struct(F.lit(m).alias("measure"), e.cast("double").alias("value")) for m, e in exprs.items()])
    long = rows.select(*by, F.inline(pairs)).where(F.col("value").isNotNull())
    return describe_counts(long.groupBy(*by, "measure", "value").agg(F.count("*").alias("n")), [*by, "measure"])


def summary_table(tables: Mapping[str, tuple[DataFrame, Column]]) -> DataFrame:
    """Extremes, mean, deviation and median of several measures, each from its own table."""
    united = None
    for name, (rows, measure) in tables.items():
        part = rows.select(F.lit(name).alias("measure"), measure.cast("double").alias("value"))
        united = part if united is None else united.unionByName(part)
    counts = united.where(F.col("value").isNotNull()).groupBy("measure", "value").agg(F.count("*").alias("n"))
    return describe_counts(counts, ["measure"]).select("measure", "min", "max", "mean", "std", "median")


def best_per_key(rows: DataFrame, keys: Sequence[str], score: str, id_col: str = "id") -> DataFrame:
    """The row with the highest score per key, smallest ID on a tie.

    A partial aggregate, not a window: one key with most of the rows still shrinks
    to one row per task before it is shuffled.
    """
    rest = [c for c in rows.columns if c not in keys]
    order = F.struct(F.col(score).isNull(), -F.col(score), F.col(id_col))
    best = rows.groupBy(*keys).agg(F.min_by(F.struct(*rest), order).alias("_row"))
    return best.select(*keys, "_row.*")


def with_group_size(rows: DataFrame, key: str, salt_on: Sequence[str], out_col: str = "num_entries") -> DataFrame:
    sizes = rows.groupBy(key).agg(F.count(key).alias(out_col))
    return lookup_join(rows, sizes, [key], "left", salt_on)


def entries_report(rows: DataFrame, key: str, salt_on: Sequence[str], out_col: str = "num_entries") -> DataFrame:
    """All rows with the size of their group, the largest groups first and then by name."""
    return with_group_size(rows, key, salt_on, out_col).orderBy(F.col(out_col).desc(), key, *salt_on)


def groups_with_at_least(rows: DataFrame, key: str, n: int, salt_on: Sequence[str] = ("id",)) -> DataFrame:
    """Rows of the keys that have ``n`` rows or more."""
    large = rows.groupBy(key).agg(F.count("*").alias("_n")).where(F.col("_n") >= n).select(key)
    return lookup_join(rows, large, [key], "left_semi", salt_on)


def distinct_groups(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    return rows.select(*columns).distinct()


def column_means(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    return rows.agg(*[F.avg(c).alias(c) for c in columns])


def distinct_counts(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    return rows.agg(*[F.count_distinct(c).alias(c) for c in columns])


def value_counts(rows: DataFrame, column: str) -> DataFrame:
    counts = rows.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n"))
    return counts.orderBy(F.col("n").desc(), column)


def means_by(rows: DataFrame, columns: Sequence[str], by: Sequence[str]) -> DataFrame:
    return rows.groupBy(*by).agg(*[F.avg(c).alias(f"mean_{c}") for c in columns])


def correlations(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Pearson correlation of each pair of columns, as ``(column_a, column_b, r)``; one pass over the rows."""
    pairs = list(combinations_with_replacement(columns, 2))
    row = rows.agg(*[F.corr(a, b).alias(f"r{i}") for i, (a, b) in enumerate(pairs)])
    cells = [F.struct(F.lit(a).alias("column_a"), F.lit(b).alias("column_b"), F.col(f"r{i}").alias("r")) for i, (a, b) in enumerate(pairs)]
    mirrored = [
        F.struct(F.lit(b).alias("column_a"), F.lit(a).alias("column_b"), F.col(f"r{i}").alias("r"))
        for i, (a, b) in enumerate(pairs)
        if a != b
    ]
    return row.select(F.inline(F.array(*cells, *mirrored)))


def largest_groups(rows: DataFrame, key: str, k: int) -> DataFrame:
    """The ``k`` most frequent values; a top-k report, so at most ``k`` rows."""
    return value_counts(rows, key).limit(k)


def largest_groups_scores(rows: DataFrame, key: str, score: str, k: int) -> DataFrame:
    """Size, mean and deviation of the score in the ``k`` largest groups."""
    groups = rows.where(F.col(key).isNotNull()).groupBy(key).agg(
        F.count("*").alias("n"), F.avg(score).alias("mean_score"), F.stddev_samp(score).alias("std_score")
    )
    return groups.orderBy(F.col("n").desc(), key).limit(k)


def scores_in_groups(rows: DataFrame, key: str, score: str, id_col: str = "id") -> DataFrame:
    """Each group's scores in ascending order, one row per score with its position.

    A single list per group would have to fit into one task; positions carry the
    same content.
    """
    ranked = running_totals(rows.select(key, id_col, score), [F.col(score), F.col(id_col)], by=[key])
    return ranked.select(key, F.col("rank").alias("position"), score)


def top_sorted(rows: DataFrame, order: Sequence[Column], n: int) -> DataFrame:
    """First ``n`` rows of a sort, kept by a bounded heap per task."""
    return rows.orderBy(*order).limit(n)


def histogram(rows: DataFrame, column: str, bins: int = 10) -> DataFrame:
    """Rows per equal-width bin between the smallest and the largest value."""
    known = rows.where(F.col(column).isNotNull()).select(F.col(column).cast("double").alias("_x"))
    bounds = known.agg(F.min("_x").alias("_low"), F.max("_x").alias("_high"))
    width = (F.col("_high") - F.col("_low")) / bins
    at = F.floor(F.try_divide(F.col("_x") - F.col("_low"), width))
    bin_no = F.least(F.coalesce(at, F.lit(0)), F.lit(bins - 1)).cast("int").alias("bin")
    return attach_totals(known, bounds).groupBy(bin_no).agg(F.count("*").alias("n"))


def share_with_word(rows: DataFrame, text_col: str, word: str, score: str) -> DataFrame:
    """Share of texts that hold a word, and the mean score of those."""
    holds = F.lower(F.col(text_col)).contains(word.lower())
    return rows.agg(F.avg(holds.cast("int")).alias("share"), F.avg(F.when(holds, F.col(score))).alias("mean_score"))


def run_shares(log: DataFrame) -> DataFrame:
    """Targets missing from the candidates, their share found, and the number of references."""
    targets, found = F.col("num_target_papers"), F.col("num_target_in_candidates")
    return log.withColumns(
        {
            "num_target_not_in_candidates": targets - found,
            "share_in_candidates": F.try_divide(found, targets),
            "num_references": F.col("num_seed_papers") + targets,
        }
    )


def experiment_grid(reviews: DataFrame, seeds: Sequence[int], feature_sets: Mapping[str, Sequence[str]]) -> DataFrame:
    """One row per review, split seed and feature set."""
    sets = [F.struct(F.lit(n).alias("feature_set"), F.array(*map(F.lit, f)).alias("features")) for n, f in feature_sets.items()]
    return reviews.select("review_id", F.explode(F.array(*map(F.lit, seeds))).alias("split_seed")).select(
        "review_id", "split_seed", F.inline(F.array(*sets))
    )
