"""Terms of many and of long texts: tasks of a bounded size, nothing moved twice."""

import time

import pytest
from pyspark.sql import functions as F

from seedscape.operators import classifiers as clf
from seedscape.operators import similarity
from seedscape.scratch import materialize


def texts(spark, n=300):
    words = F.transform(F.sequence(F.lit(1), F.lit(12)), lambda i: F.concat(F.lit("w"), F.pmod(F.col("id") * i, F.lit(37)).cast("string")))
    return materialize(spark.range(n).select("id", F.array_join(words, " ").alias("title")))


def exchanges(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0].count("Exchange hashpartitioning")


def test_tasks_grow_with_the_terms(spark, monkeypatch):
    monkeypatch.setattr(similarity, "TASK_TERMS", 100)
    assert similarity.term_counts(texts(spark)).rdd.getNumPartitions() >= 300 * 12 // 3 // 100
    assert similarity.term_counts(texts(spark, 30)).rdd.getNumPartitions() < 10


def test_other_terms_are_joined_like_common_ones(spark, monkeypatch):
    rows = texts(spark)
    candidates, seeds = rows.where("id >= 20"), rows.where("id < 20")
    weights = {(r["id"], r["term"]): r["weight"] for r in similarity.tfidf(rows).collect()}
    close = {r["id"]: r["title_similarity"] for r in similarity.title_similarity(candidates, seeds).collect()}
    monkeypatch.setattr(similarity, "MOST_COMMON", 5)
    assert {(r["id"], r["term"]): r["weight"] for r in similarity.tfidf(rows).collect()} == pytest.approx(weights)
    assert {r["id"]: r["title_similarity"] for r in similarity.title_similarity(candidates, seeds).collect()} == pytest.approx(close)
    assert len(close) == 280 and max(close.values()) > 0.5


def test_places_of_terms_move_texts_once(spark, monkeypatch):
    monkeypatch.setattr(similarity, "LEAST_TERMS", 100)
    index = similarity.positions(texts(spark), text_col="title")
    assert exchanges(index) == 1
    first = {r["id"]: r["index"] for r in index.collect()}
    assert first[0] == {"w0": list(range(12))} and first[1]["w3"] == [2]


def test_vectors_of_long_texts_take_time_in_proportion(spark):
    words = F.transform(F.sequence(F.lit(1), F.lit(40_000)), lambda i: F.concat(F.lit("w"), i.cast("string")))
    rows = materialize(spark.range(2).select("id", words.alias("tokens")))
    bag = clf.bag_of_words(rows, "tokens", min_df=1)
    begun = time.perf_counter()
    vectors = [r["bag_of_words"] for r in bag.transform(rows).collect()]
    assert time.perf_counter() - begun < 30
    assert all(v.numNonzeros() == 40_000 and v.norm(2) == pytest.approx(1.0) for v in vectors)


def test_vectors_of_the_counted_rows_cut_and_move_no_text_again(spark):
    cut = spark.sparkContext.accumulator(0)

    def words(text):
        cut.add(1)
        return (text or "").split()

    rows = texts(spark).unionByName(spark.createDataFrame([(None, "w1 w2"), (None, "w1"), (7, "w1 w1"), (900, None)], "id long, title string"))
    tokens = F.udf(words, "array<string>")(F.col("title"))
    bag = clf.bag_of_words(rows, tokens, min_df=2, length=F.lit(12))
    made = bag.transform(rows, ["title"])
    assert cut.value == 304 and made.columns == ["title", "bag_of_words"]
    again = bag.transform(rows.select("*"))
    as_list = lambda out: sorted((r["title"] or "", str(r["bag_of_words"].indices), r["bag_of_words"].norm(2)) for r in out.collect())
    for a, b in zip(as_list(made), as_list(again), strict=True):
        assert a[:2] == b[:2] and a[2] == pytest.approx(b[2])
    assert [r["bag_of_words"].numNonzeros() for r in again.where("id IS NULL OR id = 900").collect()] == [0, 0, 0]
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("seedscape")]


def test_counts_lie_in_buckets_and_their_shuffles_are_dropped(spark):
    disk = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    shuffles = lambda: {str(f) for f in disk.getAllFiles().mkString(" ").split(" ") if "shuffle_" in f}
    rows, before = texts(spark, 3000), shuffles()
    bag = clf.bag_of_words(rows, F.split("title", " "), min_df=1)
    assert "Exchange hashpartitioning(id" not in bag.counts.groupBy("id").count()._jdf.queryExecution().executedPlan().toString()
    bag.transform(rows, ["id"])
    end = time.perf_counter() + 20
    while shuffles() - before and time.perf_counter() < end:
        time.sleep(0.2)
    assert not shuffles() - before
    assert bag.counts.agg(F.sum("tf")).first()[0] == 3000 * 12


def test_no_rows_have_no_vectors(spark):
    rows = texts(spark, 3).limit(0)
    bag = clf.bag_of_words(rows, F.split("title", " "))
    assert bag.size == 0 and bag.transform(rows).count() == 0
