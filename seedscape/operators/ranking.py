"""How well a ranking finds the held-out targets.

Input rows are ``(by, id, score, target)``; ``by`` names the run, so that any
number of runs is evaluated in one job. Ties are broken by ID. Metrics that only
depend on distinct scores work on :func:`score_steps`, the others on
:func:`rank_candidates`.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seedscape.operators.ordering import running_totals
from seedscape.operators.summary import describe

# The cut-offs at which a run is reported.
LADDER = (10, 50, 100, 500, 1_000, 10_000, 50_000, 100_000, 500_000, 1_000_000, 5_000_000, 10_000_000, 50_000_000, 100_000_000)


def rank_candidates(scored: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Add ``rank`` (1 is best), ``n_rows``, ``hits`` up to the rank and ``hits_total``."""
    order = [F.col("score").desc_nulls_last(), F.col("id")]
    return running_totals(scored, order, {"hits": F.col("target").cast("long")}, by)


def score_steps(scored: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """One row per distinct score, best first: its rows ``n`` and targets ``pos``, and running ``seen`` and ``tp``."""
    steps = scored.groupBy(*by, "score").agg(
        F.count("*").alias("n"), F.sum(F.col("target").cast("long")).alias("pos")
    )
    sums = {"seen": F.col("n"), "tp": F.col("pos")}
    return running_totals(steps, [F.col("score").desc_nulls_last()], sums, by).withColumnRenamed("rank", "step")


def _relevant(num_relevant: int | Column | None) -> Column:
    if num_relevant is None:
        return F.col("hits_total")
    return num_relevant if isinstance(num_relevant, Column) else F.lit(num_relevant)


def top_by_target(ranked: DataFrame, n: int | Column, by: Sequence[str] = ()) -> DataFrame:
    """Targets and non-targets among the first ``n``."""
    first = ranked.where(F.col("rank") <= n)
    return first.groupBy(*by, "target").agg(F.count("*").alias("n"))


def r_precision(ranked: DataFrame, num_relevant: int | Column | None = None, by: Sequence[str] = ()) -> DataFrame:
    """Share of the R targets found among the first R; R counts all targets, found or not."""
    marked = ranked.withColumn("_r", _relevant(num_relevant))
    found = F.count_if(F.col("target") & (F.col("rank") <= F.col("_r")))
    stats = marked.groupBy(*by).agg(found.alias("num_correctly_predicted"), F.max("_r").alias("num_target_papers"))
    return stats.withColumn("r_precision", F.try_divide("num_correctly_predicted", "num_target_papers"))


def f1_score(precision: Column, recall: Column) -> Column:
    """Harmonic mean; null when both are 0."""
    return F.try_divide(2.0 * precision * recall, precision + recall)


def metrics_at(
    ranked: DataFrame, n: int, num_relevant: int | Column | None = None, by: Sequence[str] = ()
) -> DataFrame:
    """Precision, recall and F1 of the first ``n`` rows (of all rows where there are fewer)."""
    marked = ranked.where(F.col("rank") <= n).withColumn("_r", _relevant(num_relevant))
    stats = marked.groupBy(*by).agg(
        F.avg(F.col("target").cast("int")).alias("precision"),
        F.try_divide(F.sum(F.col("target").cast("long")), F.max("_r")).alias("recall"),
    )
    return stats.withColumn("f1", f1_score(F.col("precision"), F.col("recall")))


def metric_ladder(ranked: DataFrame, num_relevant: int | Column | None = None, by: Sequence[str] = ()) -> DataFrame:
    """Precision, recall and F1 at each cut-off; the last one is the length of the ranking.

    The running hits already stand at every rank, so the cut-offs are a filter.
    """
    last = (F.col("rank") == F.col("n_rows")) & (F.col("n_rows") <= LADDER[-1])
    marks = ranked.where(F.col("rank").isin(*LADDER) | last)
    precision = F.col("hits") / F.col("rank")
    recall = F.try_divide(F.col("hits"), _relevant(num_relevant))
    return marks.select(
        *by,
        F.col("rank").alias("n"),
        precision.alias("precision"),
        recall.alias("recall"),
        f1_score(precision, recall).alias("f1"),
    )


def average_precision_as_ranked(
    ranked: DataFrame, num_relevant: int | Column | None = None, by: Sequence[str] = ()
) -> DataFrame:
    """The precision just above each hit, hits at rank 1 left out, summed over the number of targets."""
    above = F.when(F.col("target") & (F.col("rank") > 1), (F.col("hits") - 1) / (F.col("rank") - 1))
    stats = ranked.withColumn("_r", _relevant(num_relevant)).groupBy(*by).agg(
        F.coalesce(F.sum(above), F.lit(0.0)).alias("_sum"), F.max("_r").alias("_r")
    )
    return stats.select(*by, F.coalesce(F.try_divide("_sum", "_r"), F.lit(0.0)).alias("average_precision"))


def average_precision(steps: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Precision at each distinct score, weighted by the recall gained there."""
    gained = F.try_divide("pos", "tp_total") * F.col("tp") / F.col("seen")
    return steps.groupBy(*by).agg(F.sum(gained).alias("average_precision"))


def precision_recall_curve(steps: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """A point per distinct score until all targets are found, and the closing point (1, 0) without a threshold.

    Long form: the arrays of one curve could be as long as the ranking.
    """
    needed = steps.where((F.col("tp") - F.col("pos") < F.col("tp_total")) | (F.col("tp_total") == 0))
    points = needed.select(
        *by,
        F.col("score").alias("threshold"),
        (F.col("tp") / F.col("seen")).alias("precision"),
        F.try_divide("tp", "tp_total").alias("recall"),
    )
    closing = steps.where(F.col("step") == 1).select(
        *by, F.lit(None).cast("double").alias("threshold"), F.lit(1.0).alias("precision"), F.lit(0.0).alias("recall")
    )
    return points.unionByName(closing)


def no_skill(scored: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Share of targets: the precision of a random ranking."""
    return scored.groupBy(*by).agg(F.avg(F.col("target").cast("int")).alias("no_skill"))


def roc_curve(steps: DataFrame, by: Sequence[str] = (), drop_intermediate: bool = True) -> DataFrame:
    """False and true positive rate per distinct score, from (0, 0).

    Points inside a straight stretch are left out unless asked for; a point is such
    a point when the next step gains exactly what its own step gained. The first and
    the last score always stay, and with two scores nothing is left out.
    """
    fp, fp_total = F.col("seen") - F.col("tp"), F.col("seen_total") - F.col("tp_total")
    points = steps
    if drop_intermediate:
        following = steps.select(*by, (F.col("step") - 1).alias("step"), F.col("n").alias("_n"), F.col("pos").alias("_pos"))
        straight = (F.col("_n") == F.col("n")) & (F.col("_pos") == F.col("pos")) & (F.col("step") > 1)
        points = steps.join(following, [*by, "step"], "left").where(~F.coalesce(straight, F.lit(False)))
    rated = points.select(
        *by,
        F.col("score").alias("threshold"),
        F.try_divide(fp, fp_total).alias("fpr"),
        F.try_divide("tp", "tp_total").alias("tpr"),
    )
    start = steps.where(F.col("step") == 1).select(
        *by, (F.col("score") + 1).alias("threshold"), F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr")
    )
    return rated.unionByName(start)


def roc_auc(steps: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Area under the ROC curve from the rank sum, ties at their mean rank; null with only one class."""
    mean_rank = F.col("seen_total") - F.col("seen") + (F.col("n") + 1) / 2
    sums = steps.groupBy(*by).agg(
        F.sum(F.col("pos") * mean_rank).alias("_ranks"),
        F.max("tp_total").cast("double").alias("_pos"),
        F.max(F.col("seen_total") - F.col("tp_total")).cast("double").alias("_neg"),
    )
    area = F.try_divide(
        F.col("_ranks") - F.col("_pos") * (F.col("_pos") + 1) / 2, F.col("_pos") * F.col("_neg")
    )
    return sums.select(*by, area.alias("roc_auc"))


def evaluate_runs(runs: DataFrame, scored: DataFrame, by: Sequence[str] = ("run_id",)) -> DataFrame:
    """One row per run of the list with its precision measures; nulls for a run without a scored model."""
    measured = score_steps(scored, by).groupBy(*by).agg(
        F.sum(F.try_divide("pos", "tp_total") * F.col("tp") / F.col("seen")).alias("average_precision"),
        F.max(F.col("tp_total") / F.col("seen_total")).alias("no_skill"),
        F.max("seen_total").alias("num_candidates"),
        F.max("step").alias("num_thresholds"),
    )
    return runs.join(measured, list(by), "left")


def target_positions(ranked: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Describe the 0-based positions of the targets."""
    return describe(ranked.where("target"), {"position": F.col("rank") - 1}, by).drop("measure")


def aggregate_rankings(ranked: DataFrame) -> DataFrame:
    """Mean score and mean rank of each item over the runs that rank it."""
    return ranked.groupBy("id").agg(
        F.count("*").alias("n_runs"), F.avg("score").alias("mean_score"), F.avg("rank").alias("mean_rank")
    )


def score_cutoff(ranked: DataFrame, num_relevant: int | Column | None = None, by: Sequence[str] = ()) -> DataFrame:
    """Lowest score within the first R."""
    return ranked.where(F.col("rank") <= _relevant(num_relevant)).groupBy(*by).agg(F.min("score").alias("cutoff"))


def class_report(predicted: DataFrame) -> DataFrame:
    """Precision, recall, F1 and support of each class from ``(label, prediction)`` rows."""
    cells = predicted.groupBy("label", "prediction").agg(F.count("*").alias("n"))
    same = F.col("label") == F.col("prediction")
    sides = F.array(
        F.struct(F.col("label").alias("class"), F.col("n").alias("actual"), F.lit(0).cast("long").alias("given"), F.lit(0).cast("long").alias("right")),
        F.struct(F.col("prediction").alias("class"), F.lit(0).cast("long").alias("actual"), F.col("n").alias("given"), F.when(same, F.col("n")).otherwise(0).alias("right")),
    )
    sums = cells.select(F.inline(sides)).groupBy("class").agg(F.sum("actual").alias("support"), F.sum("given").alias("given"), F.sum("right").alias("right"))
    precision = F.coalesce(F.try_divide("right", "given"), F.lit(0.0))
    recall = F.coalesce(F.try_divide("right", "support"), F.lit(0.0))
    return sums.select(
        "class",
        precision.alias("precision"),
        recall.alias("recall"),
        F.coalesce(f1_score(precision, recall), F.lit(0.0)).alias("f1"),
        "support",
    )
