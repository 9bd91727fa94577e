"""Models as rows against the models themselves, and many saved runs in the jobs of few."""

import random

import pytest
from pyspark.sql import functions as F

from checks import fits
from seedscape.operators import classifiers as clf
from seedscape.operators import model_tables
from seedscape.operators.model_tables import parts_of, score_with_tables
from seedscape.plans.review import evaluate_saved
from seedscape.scratch import new_path
from seedscape.sources.readers import read_of_runs
from seedscape.sources.writers import save_model, save_paper_set

FITTERS = {
    "logistic": clf.logistic(),
    "l1": clf.logistic(penalty="l1", balanced=True),
    "forest": clf.forest(7),
    "entropy": clf.forest(5, "entropy"),
    "svm": clf.linear_svm(),
    "bayes": clf.gaussian_bayes(),
    "boosted": clf.boosted(30),
}


@pytest.fixture(scope="module")
def toy(spark):
    rng = random.Random(4)
    rows = [(i, (t := rng.random() < 0.3), rng.gauss(t * 1.0, 1.0), rng.gauss(0, 1), float(rng.randint(0, 3) + t)) for i in range(400)]
    return spark.createDataFrame(rows, "id long, target boolean, a double, b double, c double").repartition(3).cache()


def test_scores_of_the_rows_are_those_of_the_models(spark, toy, monkeypatch):
    """All kinds as runs of one table, a hot run cut into several groups."""
    monkeypatch.setattr(model_tables, "BLOCK", 150)
    features, parts, rows, wanted = ["a", "b", "c"], None, None, {}
    for name, fitter in FITTERS.items():
        model = fitter(toy, features)
        own = parts_of(spark, model, new_path(spark, "forest")).withColumn("run_id", F.lit(name))
        parts = own if parts is None else parts.unionByName(own)
        part = toy.withColumn("run_id", F.lit(name))
        rows = part if rows is None else rows.unionByName(part)
        wanted |= {(name, r["id"]): r["score"] for r in clf.score_rows(model, toy).collect()}
    rows = rows.unionByName(toy.withColumn("run_id", F.lit("no model")))
    found = {(r["run_id"], r["id"]): r["score"] for r in score_with_tables(rows, parts, features).collect()}
    assert found == pytest.approx(wanted, abs=1e-9)


def _save(spark, folder, target):
    """A run whose candidates cite one topic; its model is a plain regression."""
    papers = [(f"p{i}", f"topic{i % 4} paper", 1990, float(i % 7), f"{i % 4}:{i}") for i in range(60)]
    table = spark.createDataFrame(papers, "id string, title string, year int, ef double, cl string")
    for name, chosen in (("seed_papers", f"cl LIKE '{target}:%' AND ef < 3"), ("target_papers", f"cl LIKE '{target}:%' AND ef >= 3"), ("test_papers", "true")):
        save_paper_set(table.where(chosen), folder, name)
    model = clf.coefficients_model(["avg_distance", "ef", "title_similarity"], [-4.0, 0.1, 2.0, 0.5])
    save_model(model, f"{folder}/best_model")


def test_number_of_jobs_does_not_grow_with_the_runs(spark):
    folders = [new_path(spark, "run") for _ in range(7)]
    for i, folder in enumerate(folders):
        _save(spark, folder, i % 4)
    jobs = {}
    for n in (2, 7):
        rows = [(f"r{i}", f"review {i}", 0.5, folders[i], "logistic") for i in range(n)] + [("gone", "lost", 0.9, new_path(spark, "x"), "logistic")]
        log = spark.createDataFrame(rows, "id string, review string, score double, datadir string, clf string")
        spark.sparkContext.setJobGroup(f"evaluate {n}", "")
        found = {r["run_id"]: r for r in evaluate_saved(spark, log, ["review"], "score").collect()}
        jobs[n] = len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"evaluate {n}"))
        assert len(found) == n + 1 and found["gone"]["average_precision"] is None and found["gone"]["classifier_str"] is None
        assert all(found[f"r{i}"]["average_precision"] > 0.9 and found[f"r{i}"]["num_candidates"] > 40 for i in range(n))
    assert jobs[7] <= jobs[2] + 2 and jobs[2] > 0
    spark.sparkContext.setJobGroup("", "")


def test_tables_of_runs_in_one_scan(spark):
    first, second = new_path(spark, "a run"), new_path(spark, "b")
    spark.range(3).write.parquet(f"{first}/t.parquet")
    spark.range(5, 6).write.parquet(f"{second}/t.parquet")
    found = read_of_runs(spark, {"x": first, "y": second, "z": new_path(spark, "none"), "again": first}, "t.parquet")
    assert sorted((r["run_id"], r["id"]) for r in found.collect()) == [("again", 0), ("again", 1), ("again", 2), ("x", 0), ("x", 1), ("x", 2), ("y", 5)]
    assert read_of_runs(spark, {"z": new_path(spark, "none")}, "t.parquet") is None


def test_features_travel_as_columns_and_what_is_kept_with_them(spark, toy):
    """No array is made of a row's features, and scores to compare need no join of their own."""
    model = clf.logistic()(toy, ["a", "b"])
    rows = clf.score_rows(model, toy, ["id", "a", "b"]).withColumnRenamed("score", "own").withColumn("run_id", F.lit("one"))
    parts = parts_of(spark, model, new_path(spark, "forest")).withColumn("run_id", F.lit("one"))
    scored = score_with_tables(rows, parts, ["a", "b"], keep=("id", "own"))
    assert "array(" not in scored._jdf.queryExecution().optimizedPlan().toString()
    found = scored.collect()
    assert len(found) == 400 and all(r["score"] == pytest.approx(r["own"], abs=1e-12) for r in found)


def test_only_the_features_asked_for_are_summed_up(spark):
    facts = fits._order_facts(spark, "/root/testdata/sf0.001", ["f0", "f4"])
    assert facts.columns == ["id", "target", "label", "f0", "f4"]
