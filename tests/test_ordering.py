import random

import pytest
from pyspark.sql import functions as F

from seedscape.operators.ordering import hash_rank, running_totals
from seedscape.operators.sampling import sample_rows, split_seeds, split_train
from seedscape.operators.skew import lookup_join
from seedscape.operators.summary import describe


@pytest.mark.parametrize("n_slices", [None, 7])
def test_ranks_across_slices_with_one_hot_group(spark, n_slices):
    """One group with most rows and one score with most of those: still exact ranks."""
    rng = random.Random(3)
    rows = [("hot", i, 5.0 if i % 3 else rng.random() * 10, i % 7 == 0) for i in range(2000)]
    rows += [(f"g{i % 5}", i, rng.random(), i % 2 == 0) for i in range(2000, 2100)]
    df = spark.createDataFrame(rows, "run string, id long, score double, target boolean")
    order = [F.col("score").desc(), F.col("id")]
    ranked = running_totals(df, order, {"hits": F.col("target").cast("long")}, ["run"], n_slices=n_slices)
    got = {(r["run"], r["id"]): r for r in ranked.collect()}
    assert len(got) == len(rows)
    for run in {r[0] for r in rows}:
        group = sorted((r for r in rows if r[0] == run), key=lambda r: (-r[2], r[1]))
        hits = 0
        for rank, row in enumerate(group, 1):
            hits += row[3]
            found = got[(run, row[1])]
            assert (found["rank"], found["hits"], found["n_rows"]) == (rank, hits, len(group))
            assert found["hits_total"] == sum(r[3] for r in group)


def test_hash_rank_is_repeatable_and_complete(spark):
    ids = spark.range(500)
    first = {r["id"]: r["rank"] for r in hash_rank(ids, seed=1).collect()}
    again = {r["id"]: r["rank"] for r in hash_rank(ids.repartition(3), seed=1).collect()}
    other = {r["id"]: r["rank"] for r in hash_rank(ids, seed=2).collect()}
    assert first == again != other
    assert sorted(first.values()) == list(range(1, 501))


def test_split_sizes_are_exact_and_disjoint(spark):
    ids = spark.range(43).withColumn("run", F.col("id") % 2)
    split = split_seeds(ids, 5, by=["run"]).groupBy("run", "is_seed").count().collect()
    assert {(r["run"], r["is_seed"]): r["count"] for r in split} == {(0, True): 5, (0, False): 17, (1, True): 5, (1, False): 16}
    train = split_train(spark.range(43)).groupBy("is_train").count().collect()
    assert {r["is_train"]: r["count"] for r in train} == {True: 34, False: 9}
    assert sample_rows(spark.range(43), 10).distinct().count() == 10
    repeated = [split_train(spark.range(43)).where("is_train").select("id").collect() for _ in range(2)]
    assert sorted(repeated[0]) == sorted(repeated[1])


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_lookup_join_equals_plain_join(spark, how):
    rows = spark.range(300).select("id", F.when(F.col("id") < 200, 1).otherwise(F.col("id") % 20).alias("k"))
    lookup = spark.createDataFrame([(k, f"v{k}") for k in range(0, 15)], "k long, v string")
    expected = sorted(tuple(r) for r in rows.join(lookup, ["k"], how).select("id", "k").collect())
    got = sorted(tuple(r) for r in lookup_join(rows, lookup, ["k"], how).select("id", "k").collect())
    assert got == expected


def test_describe_small_cases(spark):
    rows = [("a", 1.0), ("a", 2.0), ("a", 4.0), ("a", 4.0), ("b", 7.0), ("b", None)]
    df = spark.createDataFrame(rows, "g string, x double")
    got = {r["g"]: r for r in describe(df, ["x"], ["g"]).collect()}
    a, b = got["a"], got["b"]
    assert (a["n"], a["mean"], a["min"], a["q25"], a["median"], a["q75"], a["max"]) == (4, 2.75, 1.0, 1.75, 3.0, 4.0, 4.0)
    assert a["std"] == pytest.approx(1.5)
    assert (b["n"], b["std"], b["median"]) == (1, None, 7.0)


def test_rows_with_null_keys_and_ids_stay(spark):
    from seedscape.operators.ranking import rank_candidates
    from seedscape.operators.sampling import split_train

    ids = spark.createDataFrame([(1,), (2,), (3,), (4,), (None,)], "id long")
    assert split_train(ids).count() == 5
    runs = spark.createDataFrame([("a", 1, 0.5, True), (None, 2, 0.4, False), (None, 3, 0.9, False)], "run string, id long, score double, target boolean")
    got = {(r["run"], r["id"]): (r["rank"], r["n_rows"]) for r in rank_candidates(runs, ["run"]).collect()}
    assert got == {("a", 1): (1, 1), (None, 3): (1, 2), (None, 2): (2, 2)}
