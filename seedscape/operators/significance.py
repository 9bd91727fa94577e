"""Are the scores of groups different: one-way ANOVA and pairwise t-tests.

Both need only the size, mean and variance of each group, which come from one
partial aggregate; everything after that is as small as the number of groups.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seedscape.functions.pvalues import f_tail, t_two_sided
from seedscape.operators.ordering import running_totals
from seedscape.scratch import materialize

#: Groups of a block; two blocks meet in one task.
BLOCK = 256


def group_moments(rows: DataFrame, key: str, score: str) -> DataFrame:
    return rows.where(F.col(key).isNotNull() & F.col(score).isNotNull()).groupBy(key).agg(
        F.count("*").alias("n"), F.avg(score).alias("mean"), F.coalesce(F.var_samp(score), F.lit(0.0)).alias("variance")
    )


def anova(rows: DataFrame, key: str, score: str) -> DataFrame:
    """F statistic, its degrees of freedom and p."""
    moments = group_moments(rows, key, score)
    n, mean = F.col("n"), F.col("mean")
    grand = moments.agg(F.try_divide(F.sum(n * mean), F.sum(n))).scalar()
    parts = moments.withColumn("_grand", grand).agg(
        (F.count("*") - 1).alias("df_between"),
        (F.sum(n) - F.count("*")).alias("df_within"),
        F.sum(n * (mean - F.col("_grand")) * (mean - F.col("_grand"))).alias("_between"),
        F.sum((n - 1) * F.col("variance")).alias("_within"),
    )
    f = F.try_divide(F.try_divide("_between", "df_between"), F.try_divide("_within", "df_within"))
    return parts.select("df_between", "df_within", f.alias("f")).withColumn(
        "p", f_tail(F.col("f"), F.col("df_between"), F.col("df_within"))
    )


def pairwise_t_tests(
    rows: DataFrame, key: str, score: str, without: Sequence[str] = ("Other",), level: float = 0.05
) -> DataFrame:
    """t-test of every two groups with pooled variance, judged at ``level`` over the number of tests.

    t, p and the judgement are null where they are not defined: two groups of one row, or without
    variance. The output grows with the square of the number of groups, which is its purpose. Groups are
    numbered and cut into blocks; every two blocks meet under a key of their own, so the pairs are an
    ordinary join, dealt over tasks.
    """
    moments = group_moments(rows, key, score).where(~F.col(key).isin(*without))
    numbered = materialize(running_totals(moments, [F.col(key)]), "groups")
    last = F.floor((F.col("n_rows") - 1) / BLOCK)
    blocked = numbered.withColumn("_block", F.floor((F.col("rank") - 1) / BLOCK))
    side = lambda name, blocks: blocked.select(
        *[F.col(c).alias(f"{c}_{name}") for c in (*moments.columns, "rank")], F.col("n_rows").alias(f"n_groups_{name}"), *blocks
    )
    a = side("a", [F.col("_block").alias("_i"), F.explode(F.sequence("_block", last)).alias("_j")])
    b = side("b", [F.explode(F.sequence(F.lit(0).cast("long"), "_block")).alias("_i"), F.col("_block").alias("_j")])
    pairs = a.join(b, ["_i", "_j"]).where(F.col("rank_a") < F.col("rank_b"))
    df = F.col("n_a") + F.col("n_b") - 2
    spread = (F.col("n_a") - 1) * F.col("variance_a") + (F.col("n_b") - 1) * F.col("variance_b")
    error = F.sqrt(F.try_divide(spread, df) * (1 / F.col("n_a") + 1 / F.col("n_b")))
    t = F.try_divide(F.col("mean_a") - F.col("mean_b"), error)
    tested = pairs.select(
        F.col(f"{key}_a").alias("group_a"), F.col(f"{key}_b").alias("group_b"), t.alias("t"), df.alias("df"), F.col("n_groups_a").alias("_groups")
    )
    judged = tested.withColumn("p", t_two_sided(F.col("t"), F.col("df"))).withColumn(
        "corrected_level", level / (F.col("_groups") * (F.col("_groups") - 1) / 2)
    )
    return judged.withColumn("significant", F.col("p") < F.col("corrected_level")).drop("_groups")
