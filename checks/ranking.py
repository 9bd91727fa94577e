"""Ranking evaluation."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks.fixtures import LADDER_SQL, query, rounded, text_scores, view
from seedscape.operators import ranking

RUN = ["run_id"]


def _text_ranked(spark: SparkSession, sf: str) -> DataFrame:
    return ranking.rank_candidates(text_scores(spark, sf))


def _run_ranked(spark: SparkSession, sf: str) -> DataFrame:
    return ranking.rank_candidates(view(spark, sf, "run_scores"), RUN)


def _run_steps(spark: SparkSession, sf: str) -> DataFrame:
    return ranking.score_steps(view(spark, sf, "run_scores"), RUN)


@query("SELECT id, round(score, 6) AS score, target, rank, n_rows, CAST(hits AS BIGINT) AS hits FROM {text_ranked}")
def ranked_texts(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(_text_ranked(spark, sf).select("id", "score", "target", "rank", "n_rows", "hits"))


@query("SELECT run_id, id, rank, n_rows, CAST(hits AS BIGINT) AS hits FROM {run_ranked}")
def ranked_runs(spark: SparkSession, sf: str) -> DataFrame:
    return _run_ranked(spark, sf).select("run_id", "id", "rank", "n_rows", "hits")


@query("SELECT target, count(*) AS n FROM {text_ranked} WHERE rank <= hits_total GROUP BY target")
def top_by_target(spark: SparkSession, sf: str) -> DataFrame:
    return ranking.top_by_target(_text_ranked(spark, sf), F.col("hits_total"))


@query("""SELECT run_id, count(*) FILTER (target AND rank <= hits_total) AS num_correctly_predicted,
                 CAST(max(hits_total) AS BIGINT) AS num_target_papers,
                 round(count(*) FILTER (target AND rank <= hits_total) / max(hits_total), 6) AS r_precision
          FROM {run_ranked} GROUP BY run_id""")
def r_precision(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(ranking.r_precision(_run_ranked(spark, sf), by=RUN))


@query("""SELECT count(*) FILTER (target AND rank <= t) AS num_correctly_predicted, CAST(max(t) AS BIGINT) AS num_target_papers,
                 round(count(*) FILTER (target AND rank <= t) / max(t), 6) AS r_precision
          FROM {text_ranked}, (SELECT count(*) AS t FROM {labels} WHERE quality = 1)""")
def r_precision_of_all_targets(spark: SparkSession, sf: str) -> DataFrame:
    """R counts every labelled target, also those that are not in the ranking."""
    wanted = view(spark, sf, "labels").where("quality = 1").agg(F.count("*")).scalar()
    return rounded(ranking.r_precision(_text_ranked(spark, sf), wanted))


def _at(n: int) -> str:
    return f"""SELECT run_id, round(p, 6) AS precision, round(r, 6) AS recall,
        round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) END, 6) AS f1
        FROM (SELECT run_id, avg(CAST(target AS INT)) AS p, sum(CAST(target AS INT)) / max(hits_total) AS r
              FROM {{run_ranked}} WHERE rank <= {n} GROUP BY run_id)"""


@query(_at(10))
def metrics_at_10(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(ranking.metrics_at(_run_ranked(spark, sf), 10, by=RUN))


@query(_at(100))
def metrics_at_100(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(ranking.metrics_at(_run_ranked(spark, sf), 100, by=RUN))


@query("""SELECT run_id, rank AS n, round(hits / rank, 6) AS precision, round(hits / hits_total, 6) AS recall,
                 round(CASE WHEN hits > 0 THEN 2 * (hits / rank) * (hits / hits_total) / (hits / rank + hits / hits_total) END, 6) AS f1
          FROM {run_ranked} WHERE rank IN (""" + LADDER_SQL + ") OR rank = n_rows")
def metric_ladder(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(ranking.metric_ladder(_run_ranked(spark, sf), by=RUN))


@query("""SELECT run_id, round(coalesce(sum((hits - 1) / (rank - 1)) FILTER (target AND rank > 1), 0) / max(hits_total), 6) AS average_precision
          FROM {run_ranked} GROUP BY run_id""")
def average_precision_as_ranked(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(ranking.average_precision_as_ranked(_run_ranked(spark, sf), by=RUN))


@query("SELECT run_id, round(sum(pos / tp_total * tp / seen), 6) AS average_precision FROM {run_steps} GROUP BY run_id")
def average_precision(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(ranking.average_precision(_run_steps(spark, sf), RUN))


@query("""SELECT round(sum(pos / tp_total * tp / seen), 6) AS average_precision FROM (
            SELECT pos, sum(n) OVER w AS seen, sum(pos) OVER w AS tp, sum(pos) OVER () AS tp_total
            FROM (SELECT score, count(*) AS n, sum(CAST(target AS INT)) AS pos FROM {text_scores} GROUP BY score)
            WINDOW w AS (ORDER BY score DESC ROWS UNBOUNDED PRECEDING))""")
def average_precision_of_texts(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(ranking.average_precision(ranking.score_steps(text_scores(spark, sf))))


@query("""SELECT run_id, round(score, 6) AS threshold, round(tp / seen, 6) AS precision, round(tp / tp_total, 6) AS recall
          FROM {run_steps} WHERE tp - pos < tp_total
          UNION ALL SELECT DISTINCT run_id, NULL, 1.0, 0.0 FROM {run_steps}""")
def precision_recall_curve(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(ranking.precision_recall_curve(_run_steps(spark, sf), RUN))


@query("SELECT run_id, round(avg(CAST(target AS INT)), 6) AS no_skill FROM {run_scores} GROUP BY run_id")
def no_skill(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(ranking.no_skill(view(spark, sf, "run_scores"), RUN))


@query("""
    WITH looked AS (SELECT *, lead(n) OVER w AS next_n, lead(pos) OVER w AS next_pos FROM {run_steps}
                    WINDOW w AS (PARTITION BY run_id ORDER BY step))
    SELECT run_id, round(score, 6) AS threshold, round((seen - tp) / (seen_total - tp_total), 6) AS fpr, round(tp / tp_total, 6) AS tpr
    FROM looked WHERE step = 1 OR next_n IS NULL OR next_n <> n OR next_pos <> pos
    UNION ALL SELECT run_id, round(score + 1, 6), 0.0, 0.0 FROM {run_steps} WHERE step = 1""")
def roc_curve(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(ranking.roc_curve(_run_steps(spark, sf), RUN))


@query("""SELECT run_id, round((sum(r) FILTER (target) - count(*) FILTER (target) * (count(*) FILTER (target) + 1) / 2)
                 / (count(*) FILTER (target) * count(*) FILTER (NOT target)), 6) AS roc_auc
          FROM (SELECT *, rank() OVER (PARTITION BY run_id ORDER BY score)
                       + (count(*) OVER (PARTITION BY run_id, score) - 1) / 2 AS r FROM {run_scores}) GROUP BY run_id""")
def roc_auc(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(ranking.roc_auc(_run_steps(spark, sf), RUN))


@query("""SELECT r.run_id, round(sum(pos / tp_total * tp / seen), 6) AS average_precision, round(max(tp_total / seen_total), 6) AS no_skill,
                 CAST(max(seen_total) AS BIGINT) AS num_candidates, max(step) AS num_thresholds
          FROM (SELECT 'run-' || CAST(n_nationkey AS STRING) AS run_id FROM {nation} UNION ALL SELECT 'run-' || r_name FROM {region}) r
          LEFT JOIN {run_steps} s ON r.run_id = s.run_id GROUP BY r.run_id""")
def evaluated_runs(spark: SparkSession, sf: str) -> DataFrame:
    runs = view(spark, sf, "nation").select(F.concat(F.lit("run-"), "n_nationkey").alias("run_id"))
    lost = view(spark, sf, "region").select(F.concat(F.lit("run-"), "r_name").alias("run_id"))
    return rounded(ranking.evaluate_runs(runs.unionByName(lost), view(spark, sf, "run_scores")))


@query("""SELECT run_id, CAST(count(*) AS BIGINT) AS n, round(avg(rank - 1), 6) AS mean, round(stddev_samp(rank - 1), 6) AS std,
                 CAST(min(rank - 1) AS DOUBLE) AS min, round(quantile_cont(rank - 1, 0.25), 6) AS q25,
                 round(quantile_cont(rank - 1, 0.5), 6) AS median, round(quantile_cont(rank - 1, 0.75), 6) AS q75,
                 CAST(max(rank - 1) AS DOUBLE) AS max FROM {run_ranked} WHERE target GROUP BY run_id""")
def target_positions(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(ranking.target_positions(_run_ranked(spark, sf), RUN))


@query("""
    WITH scored AS (SELECT l_linenumber AS run_id, l_partkey AS id, max(l_quantity) AS score FROM {lineitem} GROUP BY ALL),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY score DESC, id) AS rank FROM scored)
    SELECT id, count(*) AS n_runs, round(avg(score), 6) AS mean_score, round(avg(rank), 6) AS mean_rank FROM ranked GROUP BY id""")
def aggregated_rankings(spark: SparkSession, sf: str) -> DataFrame:
    scored = view(spark, sf, "lineitem").groupBy(F.col("l_linenumber").alias("run_id"), F.col("l_partkey").alias("id")).agg(
        F.max("l_quantity").alias("score")
    )
    ranked = ranking.rank_candidates(scored.withColumn("target", F.lit(False)), RUN)
    return rounded(ranking.aggregate_rankings(ranked))


@query("SELECT run_id, round(min(score), 6) AS cutoff FROM {run_ranked} WHERE rank <= hits_total GROUP BY run_id")
def score_cutoff(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(ranking.score_cutoff(_run_ranked(spark, sf), by=RUN))


@query("""
    WITH classes AS (SELECT unnest([TRUE, FALSE]) AS class),
    counts AS (SELECT class, count(*) FILTER (label = class) AS support, count(*) FILTER (prediction = class) AS given,
               count(*) FILTER (label = class AND prediction = class) AS hit FROM classes, {predicted} GROUP BY class)
    SELECT class, round(hit / given, 6) AS precision, round(hit / support, 6) AS recall,
           round(2 * (hit / given) * (hit / support) / (hit / given + hit / support), 6) AS f1, support FROM counts""")
def class_report(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(ranking.class_report(view(spark, sf, "predicted")))
