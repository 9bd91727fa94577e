"""Analysis of experiment results."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks.fixtures import places_in_files, query, rounded, view
from checks.preparation import FIELDS_SQL
from seedscape.operators import significance, subjects, summary
from seedscape.operators.classifiers import select_model
from seedscape.scratch import new_path

SCORE = "score_correctly_predicted"


def _log(spark: SparkSession, sf: str) -> DataFrame:
    return view(spark, sf, "log")


def _top(spark: SparkSession, sf: str) -> DataFrame:
    return summary.best_per_key(_log(spark, sf), ["review_paper_id", "random_seed"], SCORE)


def describe_sql(x: str) -> str:
    return f"""count({x}) AS n, round(avg({x}), 6) AS mean, round(stddev_samp({x}), 6) AS std,
        round(CAST(min({x}) AS DOUBLE), 6) AS min, round(quantile_cont({x}, 0.25), 6) AS q25, round(quantile_cont({x}, 0.5), 6) AS median,
        round(quantile_cont({x}, 0.75), 6) AS q75, round(CAST(max({x}) AS DOUBLE), 6) AS max"""


@query("SELECT id, review_paper_id, random_seed, round(score_correctly_predicted, 6) AS score_correctly_predicted, clf FROM {top_results}")
def best_per_review_and_seed(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(_top(spark, sf).select("id", "review_paper_id", "random_seed", SCORE, "clf"))


@query("""SELECT review_paper_id, id, clf FROM {log}
          QUALIFY row_number() OVER (PARTITION BY review_paper_id ORDER BY score_correctly_predicted DESC, id) = 1""")
def best_per_review(spark: SparkSession, sf: str) -> DataFrame:
    return summary.best_per_key(_log(spark, sf), ["review_paper_id"], SCORE).select("review_paper_id", "id", "clf")


@query("SELECT id, review_paper_id FROM {top_results} QUALIFY count(*) OVER (PARTITION BY review_paper_id) >= 5")
def reviews_with_all_runs(spark: SparkSession, sf: str) -> DataFrame:
    return summary.groups_with_at_least(_top(spark, sf), "review_paper_id", 5).select("id", "review_paper_id")


@query("SELECT DISTINCT title_source, title_source_abbrev, subject_extended, subject_traditional, heading, subheading FROM {venues}")
def distinct_venue_subjects(spark: SparkSession, sf: str) -> DataFrame:
    customers = view(spark, sf, "venues")
    doubled = customers.unionByName(customers)
    return summary.distinct_groups(doubled, customers.columns)


@query("SELECT o_orderkey AS id, o_custkey AS title_source, count(*) OVER (PARTITION BY o_custkey) AS num_entries FROM {orders}")
def entries_per_venue(spark: SparkSession, sf: str) -> DataFrame:
    rows = view(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("title_source"))
    return summary.with_group_size(rows, "title_source", ["id"])


@query("""SELECT row_number() OVER (ORDER BY num_entries DESC, title_source, id) AS place, id, title_source, num_entries
          FROM (SELECT o_orderkey AS id, o_custkey AS title_source, count(*) OVER (PARTITION BY o_custkey) AS num_entries FROM {orders})""")
def sorted_entries(spark: SparkSession, sf: str) -> DataFrame:
    """The report as written, with the place of each row in its files."""
    rows = view(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("title_source"))
    path = new_path(spark, "entries")
    summary.entries_report(rows, "title_source", ["id"]).write.parquet(path)
    return places_in_files(spark.read.parquet(path))


@query("SELECT 'score_correctly_predicted' AS measure, " + describe_sql(SCORE) + """ FROM {top_results}
          UNION ALL SELECT 'num_target_papers', """ + describe_sql("num_target_papers") + " FROM {top_results}")
def described_scores(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(summary.describe(_top(spark, sf), [SCORE, "num_target_papers"]))


@query("SELECT target, 'score' AS measure, " + describe_sql("score") + " FROM {run_scores} GROUP BY target")
def described_by_target(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(summary.describe(view(spark, sf, "run_scores"), ["score"], ["target"]))


@query("SELECT l_returnflag, 'l_extendedprice' AS measure, " + describe_sql("l_extendedprice") + " FROM {lineitem} GROUP BY l_returnflag")
def described_prices(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(summary.describe(view(spark, sf, "lineitem"), ["l_extendedprice"], ["l_returnflag"]))


@query("SELECT target, round(avg(score), 6) AS mean_score, round(avg(id), 6) AS mean_id FROM {run_scores} GROUP BY target")
def means_by_target(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(summary.means_by(view(spark, sf, "run_scores"), ["score", "id"], ["target"]))


NUMBERS = ["num_target_papers", "num_target_in_candidates", "num_candidates", SCORE]


@query("SELECT " + ", ".join(f"round(avg({c}), 6) AS {c}" for c in NUMBERS) + " FROM {top_results}")
def column_means(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(summary.column_means(_top(spark, sf), NUMBERS))


@query("SELECT count(DISTINCT review_paper_id) AS review_paper_id, count(DISTINCT clf) AS clf, count(DISTINCT num_candidates) AS num_candidates FROM {log}")
def distinct_counts(spark: SparkSession, sf: str) -> DataFrame:
    return summary.distinct_counts(_log(spark, sf), ["review_paper_id", "clf", "num_candidates"])


@query("SELECT subject, count(*) AS n FROM {subjects} GROUP BY subject")
def value_counts(spark: SparkSession, sf: str) -> DataFrame:
    return summary.value_counts(view(spark, sf, "subjects"), "subject")


@query("SELECT num_target_papers - num_target_in_candidates AS num_target_not_in_candidates, count(*) AS n FROM {log} GROUP BY 1")
def value_counts_by_value(spark: SparkSession, sf: str) -> DataFrame:
    counts = summary.value_counts(summary.run_shares(_log(spark, sf)), "num_target_not_in_candidates")
    return counts.orderBy("num_target_not_in_candidates")


def _corr_sql() -> str:
    cells = [f"SELECT '{a}' AS column_a, '{b}' AS column_b, round(corr({a}, {b}), 6) AS r FROM {{top_results}}" for a in NUMBERS for b in NUMBERS]
    return " UNION ALL ".join(cells)


@query(_corr_sql())
def correlations(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(summary.correlations(_top(spark, sf), NUMBERS))


@query("""SELECT subject, count(*) AS n, round(avg(score), 6) AS mean_score, round(stddev_samp(score), 6) AS std_score
          FROM {subjects} GROUP BY subject ORDER BY n DESC, subject LIMIT 3""")
def largest_subjects(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(summary.largest_groups_scores(view(spark, sf, "subjects"), "subject", "score", 3))


@query("SELECT l_suppkey, count(*) AS n FROM {lineitem} GROUP BY l_suppkey ORDER BY n DESC, l_suppkey LIMIT 20")
def largest_groups(spark: SparkSession, sf: str) -> DataFrame:
    return summary.largest_groups(view(spark, sf, "lineitem"), "l_suppkey", 20)


def _summary_sql(name: str, table: str, x: str) -> str:
    return f"""SELECT '{name}' AS measure, round(CAST(min({x}) AS DOUBLE), 6) AS min, round(CAST(max({x}) AS DOUBLE), 6) AS max,
        round(avg({x}), 6) AS mean, round(stddev_samp({x}), 6) AS std, round(CAST(quantile_cont({x}, 0.5) AS DOUBLE), 6) AS median FROM {table}"""


ONE_PER_REVIEW = "(SELECT * FROM {top_results} QUALIFY row_number() OVER (PARTITION BY review_paper_id ORDER BY score_correctly_predicted DESC, id) = 1)"


@query(" UNION ALL ".join([
    _summary_sql("Number of references", ONE_PER_REVIEW, "(num_seed_papers + num_target_papers)"),
    _summary_sql("Publication year", ONE_PER_REVIEW, "wos_year"),
    _summary_sql("Number of candidates", "{top_results}", "num_candidates"),
    _summary_sql("Percentage of target in candidates", "{top_results}", "(num_target_in_candidates / num_target_papers * 100)"),
]))
def summary_table(spark: SparkSession, sf: str) -> DataFrame:
    top = summary.run_shares(_top(spark, sf))
    reviews = summary.best_per_key(top, ["review_paper_id"], SCORE)
    return rounded(summary.summary_table({
        "Number of references": (reviews, F.col("num_references")),
        "Publication year": (reviews, F.col("wos_year")),
        "Number of candidates": (top, F.col("num_candidates")),
        "Percentage of target in candidates": (top, F.col("share_in_candidates") * 100),
    }))


@query("SELECT subject, row_number() OVER (PARTITION BY subject ORDER BY score, id) AS position, round(score, 6) AS score FROM {subjects}")
def scores_in_groups(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(summary.scores_in_groups(view(spark, sf, "subjects"), "subject", "score"))


ROLLED = "(SELECT id, score, coalesce(field, 'Other') AS field FROM {subjects} s LEFT JOIN " + FIELDS_SQL + " ON s.subject = fields.subject)"


def _rolled(spark: SparkSession, sf: str) -> DataFrame:
    return subjects.roll_up(view(spark, sf, "subjects"), "subject")


MOMENTS = "moments AS (SELECT field, count(*) AS n, avg(score) AS mean, var_samp(score) AS variance FROM " + ROLLED + " GROUP BY field)"


@query("WITH " + MOMENTS + """, grand AS (SELECT sum(n * mean) / sum(n) AS g FROM moments)
    SELECT count(*) - 1 AS df_between, CAST(sum(n) - count(*) AS BIGINT) AS df_within,
           round((sum(n * (mean - g) * (mean - g)) / (count(*) - 1)) / (sum((n - 1) * variance) / (sum(n) - count(*))), 6) AS f
    FROM moments, grand""")
def anova(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(significance.anova(_rolled(spark, sf), "field", "score").select("df_between", "df_within", "f"))


@query("WITH " + MOMENTS + """
    SELECT a.field AS group_a, b.field AS group_b, a.n + b.n - 2 AS df,
           round((a.mean - b.mean) / sqrt(((a.n - 1) * a.variance + (b.n - 1) * b.variance) / (a.n + b.n - 2) * (1 / a.n + 1 / b.n)), 6) AS t,
           round(0.05 / (SELECT (count(*) - 1) * (count(*) - 2) / 2 FROM moments), 6) AS corrected_level
    FROM moments a JOIN moments b ON a.field < b.field AND a.field <> 'Other' AND b.field <> 'Other'""")
def pairwise_t_tests(spark: SparkSession, sf: str) -> DataFrame:
    tests = significance.pairwise_t_tests(_rolled(spark, sf), "field", "score")
    return rounded(tests.select("group_a", "group_b", "df", "t", "corrected_level"))


@query("WITH " + MOMENTS + """,
    tests AS (
        SELECT a.field AS group_a, b.field AS group_b, a.n + b.n - 2 AS df,
               (a.mean - b.mean) / sqrt(((a.n - 1) * a.variance + (b.n - 1) * b.variance) / (a.n + b.n - 2) * (1 / a.n + 1 / b.n)) AS t,
               0.05 / (SELECT (count(*) - 1) * (count(*) - 2) / 2 FROM moments) AS corrected_level
        FROM moments a JOIN moments b ON a.field < b.field AND a.field <> 'Other' AND b.field <> 'Other'),
    angles AS (SELECT *, atan(abs(t) / sqrt(df)) AS low, (pi() / 2 - atan(abs(t) / sqrt(df))) / 200000 AS step FROM tests),
    areas AS (
        SELECT group_a, group_b, 2 * exp(lgamma((any_value(df) + 1) / 2) - lgamma(any_value(df) / 2)) / sqrt(pi())
               * sum(exp((df - 1) * ln(cos(low + (i + 0.5) * step))) * step) AS p
        FROM angles, range(200000) AS parts(i) GROUP BY ALL)
    SELECT group_a, group_b, df, round(t, 6) AS t, round(p, 4) AS p, round(corrected_level, 6) AS corrected_level, p < corrected_level AS significant
    FROM tests JOIN areas USING (group_a, group_b)""")
def significance_of_fields(spark: SparkSession, sf: str) -> DataFrame:
    """With p values; the statement integrates the density."""
    tests = rounded(significance.pairwise_t_tests(_rolled(spark, sf), "field", "score"))
    return tests.withColumn("p", F.round("p", 4))


@query("SELECT id, num_target_papers, num_candidates FROM {log} ORDER BY num_target_papers, num_candidates DESC, id LIMIT 50")
def sorted_head(spark: SparkSession, sf: str) -> DataFrame:
    rows = _log(spark, sf).select("id", "num_target_papers", "num_candidates")
    return summary.top_sorted(rows, [F.col("num_target_papers"), F.col("num_candidates").desc(), F.col("id")], 50)


@query("""
    WITH bounds AS (SELECT min(score_correctly_predicted) AS low, max(score_correctly_predicted) AS high FROM {top_results})
    SELECT CAST(least(floor((score_correctly_predicted - low) / ((high - low) / 10)), 9) AS INT) AS bin, count(*) AS n
    FROM {top_results}, bounds GROUP BY 1""")
def score_histogram(spark: SparkSession, sf: str) -> DataFrame:
    return summary.histogram(_top(spark, sf), SCORE)


@query("""SELECT c_custkey AS review_id, s AS split_seed, f AS feature_set,
                 CASE f WHEN 'network' THEN 2 ELSE 3 END AS n_features
          FROM {customer}, unnest([1, 2, 3, 4, 5]) AS seeds(s), unnest(['network', 'network_and_titles']) AS sets(f)""")
def experiment_grid(spark: SparkSession, sf: str) -> DataFrame:
    reviews = view(spark, sf, "customer").select(F.col("c_custkey").alias("review_id"))
    sets = {"network": ["avg_distance", "ef"], "network_and_titles": ["avg_distance", "ef", "title_similarity"]}
    grid = summary.experiment_grid(reviews, range(1, 6), sets)
    return grid.select("review_id", "split_seed", "feature_set", F.size("features").alias("n_features"))


@query("""
    WITH marked AS (SELECT *, max(r_precision) OVER (PARTITION BY run_id) AS best FROM {model_scores})
    SELECT run_id, clf, position, round(r_precision, 6) AS r_precision FROM marked
    QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY CASE WHEN best = 0 THEN -position ELSE 0 END, r_precision DESC, position) = 1""")
def selected_models(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(select_model(view(spark, sf, "model_scores"), ["run_id"]).select("run_id", "clf", "position", "r_precision"))
