import random

import pytest
from pyspark.sql import functions as F

from seedscape.operators import classifiers as clf
from seedscape.operators.ranking import rank_candidates, r_precision
from seedscape.plans.review import ladder_of_best, run_review
from seedscape.scratch import new_path
from seedscape.sources.readers import read_model
from seedscape.sources.writers import save_model


@pytest.fixture(scope="module")
def toy(spark):
    rng = random.Random(4)
    rows = []
    for i in range(300):
        target = i % 6 == 0
        rows.append((i, target, rng.gauss(1.5 if target else -1.5, 0.4), rng.gauss(0, 1), i % 5 != 0))
    return spark.createDataFrame(rows, "id long, target boolean, a double, b double, is_train boolean").repartition(3)


FITTERS = {
    "logistic": clf.logistic(),
    "balanced": clf.logistic(balanced=True),
    "l1": clf.logistic(penalty="l1"),
    "forest": clf.forest(10),
    "entropy": clf.forest(10, "entropy"),
    "svm": clf.linear_svm(),
    "bayes": clf.gaussian_bayes(),
    "boosted": clf.boosted(4),
}


@pytest.mark.parametrize("name", FITTERS)
def test_separable_data_is_ranked_right(spark, toy, name):
    model = FITTERS[name](toy.where("is_train"), ["a", "b"])
    scored = clf.score_rows(model, toy)
    assert scored.where("score < 0 OR score > 1 OR score IS NULL").count() == 0
    assert r_precision(rank_candidates(scored)).first()["r_precision"] > 0.95


def test_boosting_uses_both_features_and_survives_saving(spark):
    """A band needs two cuts; one stump cannot rank it."""
    rows = [(i, 30 <= i < 60, float(i), float(i % 7)) for i in range(90)]
    df = spark.createDataFrame(rows, "id long, target boolean, a double, b double")
    model = clf.boosted(12)(df, ["a", "b"])
    path = new_path(spark, "model")
    save_model(model, path)
    scored = {r["id"]: r["score"] for r in clf.score_rows(read_model(path), df).collect()}
    same = {r["id"]: r["score"] for r in clf.score_rows(model, df).collect()}
    assert scored == same
    right = sum((scored[i] > 0.5) == t for i, t, _, _ in rows)
    assert right >= 85


def test_balanced_weights(spark, toy):
    rows = {r["target"]: r["weight"] for r in clf.balanced_weights(toy).select("target", "weight").distinct().collect()}
    assert rows == {True: 300 / (2 * 50), False: 300 / (2 * 250)}


def test_selection_prefers_the_first_best_and_falls_back_to_the_last(spark):
    rows = [("r", "a", 0, 0.2), ("r", "b", 1, 0.5), ("r", "c", 2, 0.5), ("s", "a", 0, 0.0), ("s", "b", 1, 0.0)]
    metrics = spark.createDataFrame(rows, "run string, clf string, position int, r_precision double")
    got = {r["run"]: r["clf"] for r in clf.select_model(metrics, ["run"]).collect()}
    assert got == {"r": "b", "s": "b"}


def test_bag_of_words_weights(spark):
    rows = spark.createDataFrame([(1, ["a", "b", "b"]), (2, ["a"]), (3, ["c"])], "id long, tokens array<string>")
    out = clf.bag_of_words(rows, "tokens", min_df=2).transform(rows).collect()
    vectors = {r["id"]: r["bag_of_words"] for r in out}
    assert vectors[1].toArray().tolist() == [1.0] and vectors[3].toArray().tolist() == [0.0]
    plan = clf.bag_of_words(rows, "tokens", min_df=2).transform(rows)._jdf.queryExecution().toString()
    assert "Python" not in plan


def test_whole_review(spark):
    """Papers of one topic cite each other; the run must find the held-out ones and leave its files."""
    rng = random.Random(8)
    papers, edges = [], []
    for i in range(240):
        topic = i % 4
        papers.append((f"p{i}", f"topic{topic} paper words{i % 11}", 1990 + i % 20, rng.random(), f"{topic}:{i % 3}:{i}"))
        for _ in range(4):
            other = topic + 4 * rng.randint(0, 59) if rng.random() < 0.8 else rng.randint(0, 239)
            edges.append((f"p{i}", f"p{other}"))
    paper_table = spark.createDataFrame(papers, "id string, title string, year int, ef double, cl string")
    edge_table = spark.createDataFrame(edges, "id string, cited_id string")
    known = paper_table.where("cl LIKE '1:%'").select("id")
    folder = new_path(spark, "review")
    tried = {"logistic": clf.logistic(), "forest": clf.forest(10)}
    done = run_review(spark, known, paper_table, edge_table, 15, folder, classifiers=tried)
    assert done.metrics.count() == 2
    assert done.metrics.agg(F.max("r_precision")).first()[0] > 0.9
    assert done.predictions.select("id").distinct().count() == done.candidates.count()
    assert ladder_of_best(done, 45).where("n = 10").first()["precision"] == 1.0
    reread = clf.score_rows(read_model(f"{folder}/best_model"), done.candidates)
    assert reread.count() == done.candidates.count()
    assert spark.read.csv(f"{folder}/predictions.tsv", sep="\t", header=True).count() == 100
    with pytest.raises(Exception, match="(?i)exists"):
        run_review(spark, known, paper_table, edge_table, 15, folder, classifiers=tried)


def test_bag_of_words_equals_tfidf(spark):
    from seedscape.operators.similarity import tfidf

    texts = spark.createDataFrame([(i, f"word{i % 3} other{i % 2} both both x{i}") for i in range(12)] + [(99, None)], "id long, title string")
    rows = texts.withColumn("tokens", F.expr("regexp_extract_all(lower(coalesce(title, '')), '[a-z0-9]{2,}', 0)"))
    bag = clf.bag_of_words(rows, "tokens", min_df=3)
    places = {r["place"]: r["term"] for r in bag.words.collect()}
    found = {
        (r["id"], places[int(i)]): v
        for r in bag.transform(rows).collect()
        for i, v in zip(r["bag_of_words"].indices, r["bag_of_words"].values)
    }
    expected = {(r["id"], r["term"]): r["weight"] for r in tfidf(texts, min_df=3).collect()}
    assert found == pytest.approx(expected)


def test_svm_probabilities_are_honest_on_rows_not_learnt(spark):
    """With many features of noise the margin fits its own rows too well; the curve must come from others."""
    rng = random.Random(3)
    rows = [(i, (t := rng.random() < 0.5), *[rng.gauss(0.5 * t * (k == 0), 1) for k in range(12)]) for i in range(500)]
    names = [f"x{k}" for k in range(12)]
    table = spark.createDataFrame(rows, "id long, target boolean, " + ", ".join(f"{n} double" for n in names))
    learnt, held = table.where("id < 90"), table.where("id >= 90")

    def loss(folds):
        scored = clf.score_rows(clf.linear_svm(folds)(learnt, names), held)
        own = F.when(F.col("target"), F.col("score")).otherwise(1 - F.col("score"))
        return scored.agg(F.avg(-F.log(F.greatest(own, F.lit(1e-9))))).first()[0]

    assert loss(5) < loss(1)
