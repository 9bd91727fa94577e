"""Reading and writing."""

import contextlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks.fixtures import places_in_files, query, rounded, union_all, view
from seedscape.scratch import materialize, new_path
from seedscape.sources import readers, runs, writers


@query("SELECT CAST(o_orderkey AS STRING) AS o_orderkey, o_orderstatus, o_orderpriority FROM {orders}")
def read_tab_separated(spark: SparkSession, sf: str) -> DataFrame:
    path = new_path(spark, "orders-tsv")
    orders = view(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    orders.write.csv(path, sep="\t", header=True)
    return readers.read_table(spark, path)


@query("SELECT id, cited_id, count(*) AS n FROM {citations} GROUP BY ALL")
def read_citations_renamed(spark: SparkSession, sf: str) -> DataFrame:
    path = new_path(spark, "edges-parquet")
    view(spark, sf, "citations").withColumnsRenamed({"id": "UID", "cited_id": "cited_UID"}).write.parquet(path)
    edges = readers.read_citations(spark, path, "UID", "cited_UID")
    return edges.groupBy("id", "cited_id").agg(F.count("*").alias("n"))


@query("SELECT id FROM {part_papers}")
def read_id_lines(spark: SparkSession, sf: str) -> DataFrame:
    path = new_path(spark, "ids")
    padded = F.array(F.concat(F.lit("  "), F.col("id"), F.lit(" ")), F.lit(""), F.lit("   "))
    view(spark, sf, "part_papers").select(F.explode(padded).alias("value")).write.text(path)
    return readers.read_id_list(spark, path)


@query("SELECT CAST(o_orderkey AS STRING) AS id FROM {orders}")
def normal_ids(spark: SparkSession, sf: str) -> DataFrame:
    return readers.clean_ids(view(spark, sf, "orders"), "o_orderkey")


@query("""SELECT id FROM {part_papers} UNION ALL SELECT '' FROM {part_papers}""")
def read_list_with_header(spark: SparkSession, sf: str) -> DataFrame:
    """Files with a header line each; their blank lines are kept."""
    path = new_path(spark, "ids")
    lines = view(spark, sf, "part_papers").select(F.explode(F.array(F.col("id"), F.lit(""))).alias("value"), "id")
    header = spark.range(1, numPartitions=1).select(F.lit("ID").alias("value"))
    for number in range(3):
        own = lines.where(F.pmod(F.xxhash64("id"), F.lit(3)) == number).select("value")
        header.union(own).coalesce(1).write.mode("append").text(path)
    return readers.read_id_list(spark, path, header=True, keep_blank=True)


@query("SELECT id, cited_id FROM {citations}")
def preloaded_table(spark: SparkSession, sf: str) -> DataFrame:
    return readers.read_citations(spark, view(spark, sf, "citations")).select("id", "cited_id")


@query("SELECT id, review_paper_id, random_seed, datadir, round(score_correctly_predicted, 6) AS score_correctly_predicted FROM {log}")
def read_experiment_log(spark: SparkSession, sf: str) -> DataFrame:
    path = new_path(spark, "log")
    writers.append_log(view(spark, sf, "log"), path)
    log = readers.read_log(spark, path)
    return rounded(log.select("id", "review_paper_id", "random_seed", "datadir", "score_correctly_predicted"))


@query("SELECT * FROM {citations}")
def write_create_only(spark: SparkSession, sf: str) -> DataFrame:
    path = new_path(spark, "new")
    writers.write_new(view(spark, sf, "citations"), path)
    return spark.read.parquet(path)


@query("SELECT o_orderkey AS id, CAST(year(o_orderdate) AS INT) AS year, o_orderdate AS pub_date, round(o_totalprice, 6) AS ef FROM {orders}")
def saved_paper_set(spark: SparkSession, sf: str) -> DataFrame:
    folder = new_path(spark, "papers")
    papers = view(spark, sf, "orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("pub_date"), F.col("o_totalprice").alias("flow")
    )
    writers.save_paper_set(papers, folder, "test_papers")
    return rounded(readers.read_paper_sets(spark, folder, ("test_papers",))["test_papers"])


@query("SELECT DISTINCT id, cited_id FROM {citations}")
def loaded_without_duplicates(spark: SparkSession, sf: str) -> DataFrame:
    folder = new_path(spark, "sets")
    edges = view(spark, sf, "citations")
    writers.write_new(edges.unionByName(edges), f"{folder}/seed_papers.parquet")
    return readers.read_paper_sets(spark, folder, ("seed_papers",))["seed_papers"]


def _order_scores(spark: SparkSession, sf: str) -> DataFrame:
    return view(spark, sf, "run_scores").select("id", "target", F.col("score").alias("pred_ranks"))


@query("SELECT CAST(id AS STRING) AS id, score AS pred_ranks FROM {run_scores} WHERE NOT target ORDER BY score DESC, run_scores.id LIMIT 100")
def written_best_predictions(spark: SparkSession, sf: str) -> DataFrame:
    folder = new_path(spark, "predictions")
    writers.write_predictions(_order_scores(spark, sf), folder)
    best = readers.read_table(spark, f"{folder}/predictions.tsv")
    return best.select("id", F.col("pred_ranks").cast("double").alias("pred_ranks"))


@query("SELECT CAST(target AS STRING) AS target, count(*) AS n FROM {run_scores} GROUP BY ALL")
def written_target_flags(spark: SparkSession, sf: str) -> DataFrame:
    folder = new_path(spark, "predictions")
    writers.write_predictions(_order_scores(spark, sf), folder)
    flags = spark.read.schema("target string").csv(f"{folder}/all_pred_y_target.csv.gz")
    return flags.groupBy("target").agg(F.count("*").alias("n"))


@query("SELECT row_number() OVER (ORDER BY score DESC, id) AS place, CAST(target AS STRING) AS target FROM {run_scores}")
def order_of_target_flags(spark: SparkSession, sf: str) -> DataFrame:
    """The flags stand in the files in the order of the ranking."""
    folder = new_path(spark, "predictions")
    writers.write_predictions(_order_scores(spark, sf), folder)
    return places_in_files(spark.read.schema("target string").csv(f"{folder}/all_pred_y_target.csv.gz"))


@query("SELECT id, score AS pred_ranks FROM {run_scores} WHERE NOT target ORDER BY score DESC, id LIMIT 500")
def best_non_targets(spark: SparkSession, sf: str) -> DataFrame:
    return writers.top_predictions(_order_scores(spark, sf), 500)


@query("""SELECT o_orderkey AS mag_id, date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) * 86400000 AS mag_date,
          CAST(year(o_orderdate) AS INT) AS year FROM {orders}""")
def paper_info_json(spark: SparkSession, sf: str) -> DataFrame:
    path = new_path(spark, "info")
    days = F.datediff(F.col("o_orderdate").cast("date"), F.lit("1970-01-01").cast("date")).cast("long")
    info = view(spark, sf, "orders").select(F.col("o_orderkey").alias("mag_id"), (days * 86_400_000).alias("mag_date"))
    writers.write_paper_info(info, path)
    return readers.read_paper_info(spark, path, "mag_id long, mag_date long")


@query("SELECT id FROM {order_papers}")
def written_id_list(spark: SparkSession, sf: str) -> DataFrame:
    path = new_path(spark, "id-list")
    writers.write_id_list(view(spark, sf, "order_papers"), path)
    return readers.read_id_list(spark, path)


@query("""SELECT DISTINCT o_custkey AS review_id, o_orderkey % 5 AS split_seed FROM {orders}
          EXCEPT SELECT o_custkey, o_orderkey % 5 FROM {orders} WHERE o_orderstatus = 'F'""")
def pending_collections(spark: SparkSession, sf: str) -> DataFrame:
    orders = view(spark, sf, "orders").select(
        F.col("o_custkey").alias("review_id"), (F.col("o_orderkey") % 5).alias("split_seed"), "o_orderstatus"
    )
    wanted = orders.select("review_id", "split_seed").distinct()
    return runs.pending_runs(wanted, orders.where("o_orderstatus = 'F'"))


@query("""SELECT c_mktsegment AS review_id, CAST(o_orderkey % 2 AS INT) AS split_seed, count(*) AS n FROM {orders}
          JOIN {customer} ON o_custkey = c_custkey GROUP BY ALL""")
def restarted_collection(spark: SparkSession, sf: str) -> DataFrame:
    """Half of the runs first, then all: only the open ones are collected the second time."""
    folder = new_path(spark, "collection")
    orders = view(spark, sf, "orders").join(view(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    keyed = orders.select(
        F.col("c_mktsegment").alias("review_id"), (F.col("o_orderkey") % 2).cast("int").alias("split_seed"), "o_orderkey"
    )
    wanted = keyed.select("review_id", "split_seed").distinct()

    def collect(open_runs: DataFrame) -> DataFrame:
        return keyed.join(open_runs, ["review_id", "split_seed"])

    runs.collect_pending(wanted.where("split_seed = 0"), folder, collect)
    runs.collect_pending(wanted, folder, collect)
    done = spark.read.parquet(f"{folder}/papers.parquet")
    return done.groupBy("review_id", "split_seed").agg(F.count("*").alias("n"))


@query("""SELECT '00' || CAST(c_nationkey AS STRING) AS review_id, CAST(o_orderkey % 2 AS INT) AS split_seed, count(*) AS n, FALSE AS redone
          FROM {orders} JOIN {customer} ON o_custkey = c_custkey GROUP BY ALL""")
def collection_after_a_failure(spark: SparkSession, sf: str) -> DataFrame:
    """The third group of runs fails the first time; the two before it are not collected again. IDs keep their zeros."""
    folder = new_path(spark, "collection")
    orders = view(spark, sf, "orders").join(view(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    keys = {"review_id": "string", "split_seed": "int"}
    nation = F.concat(F.lit("00"), F.col("c_nationkey").cast("string"))
    keyed = orders.select(nation.alias("review_id"), (F.col("o_orderkey") % 2).cast("int").alias("split_seed"), "o_orderkey")
    keyed = materialize(keyed, "keyed")
    wanted = keyed.select(*keys).distinct()
    asked = []

    def collect(open_runs: DataFrame) -> DataFrame:
        asked.append(open_runs)
        if len(asked) == 3:
            raise ConnectionError
        return keyed.join(open_runs, list(keys))

    with contextlib.suppress(ConnectionError):
        runs.collect_pending(wanted, folder, collect, group_size=10)
    before = materialize(runs.completed_runs(wanted, folder), "before")
    first = len(asked)
    runs.collect_pending(wanted, folder, collect, group_size=10)
    again = union_all(asked[first:]).join(before, list(keys)).select(*keys, F.lit(True).alias("redone"))
    counted = runs.read_collection(spark, folder, keys).groupBy(*keys).agg(F.count("*").alias("n"))
    return counted.join(again, list(keys), "left").withColumn("redone", F.coalesce("redone", F.lit(False)))


@query("""SELECT id, clf FROM {log} WHERE random_seed < 2 UNION ALL SELECT id, clf FROM {log} WHERE random_seed >= 2""")
def appended_experiments(spark: SparkSession, sf: str) -> DataFrame:
    path = new_path(spark, "appended")
    log = view(spark, sf, "log").select("id", "clf", "random_seed")
    writers.append_log(log.where("random_seed < 2"), path)
    writers.append_log(log.where("random_seed >= 2"), path)
    return readers.read_log(spark, path).select("id", "clf")
