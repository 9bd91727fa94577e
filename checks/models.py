"""Classifiers and scoring. Fits have no SQL form; what surrounds them does."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks.fixtures import LADDER_SQL, paper_sets, query, rounded, seed_ids, target_ids, view
from seedscape.functions.text import terms
from seedscape.operators import classifiers as clf
from seedscape.operators.features import (
    DEFAULT_FEATURES,
    cluster_distance,
    default_features,
    embedding_feature,
    feature_union,
    seed_mean_feature,
)
from seedscape.operators.graph import attach_papers, expand
from seedscape.operators.prep import drop_unclustered, prepare_candidates
from seedscape.operators.ranking import class_report, rank_candidates
from seedscape.operators.sampling import split_train
from seedscape.operators.similarity import TERM_BYTES
from seedscape.operators.clusters import average_distance
from seedscape.operators.matching import meta_clusters
from seedscape.plans.review import evaluate_saved, rank_over_splits, train_models, train_saved
from seedscape.scratch import materialize, new_path
from seedscape.sources.readers import read_model
from seedscape.sources.writers import save_model, save_paper_set

FEATURES = list(DEFAULT_FEATURES)


def _candidates(spark: SparkSession, sf: str) -> DataFrame:
    """Candidates of the citation graph with their features and their part of the split."""
    sets = paper_sets(spark, sf)
    prepared = materialize(prepare_candidates(sets.candidates, sets.seeds, sets.targets), "prepared")
    prepared = materialize(split_train(prepared), "split")
    return materialize(default_features(prepared, sets.seeds), "features")


def _fit_and_score(spark: SparkSession, sf: str, fitter: clf.Fitter) -> DataFrame:
    """Fit on four fifths, score everything."""
    candidates = _candidates(spark, sf)
    model = fitter(candidates.where("is_train"), FEATURES)
    return _judged(clf.score_rows(model, candidates))


# Says only that every candidate gets a probability. Values of fits are compared in checks/fits.py, that they tell targets
# apart is tested in tests/test_models.py.
SCORED = "SELECT id, target, TRUE AS is_probability FROM {prepared}"


def _judged(scored: DataFrame) -> DataFrame:
    return scored.select("id", "target", F.col("score").between(0, 1).alias("is_probability"))


@query(SCORED)
def logistic(spark: SparkSession, sf: str) -> DataFrame:
    return _fit_and_score(spark, sf, clf.logistic())


@query(SCORED)
def logistic_balanced(spark: SparkSession, sf: str) -> DataFrame:
    return _fit_and_score(spark, sf, clf.logistic(balanced=True))


@query("""SELECT o_orderkey AS id, round(n / (2.0 * CASE WHEN target THEN pos ELSE n - pos END), 6) AS weight
          FROM (SELECT o_orderkey, o_orderpriority = '1-URGENT' AS target FROM {orders}),
               (SELECT count(*) AS n, count(*) FILTER (o_orderpriority = '1-URGENT') AS pos FROM {orders})""")
def balanced_weights(spark: SparkSession, sf: str) -> DataFrame:
    rows = view(spark, sf, "orders").select(
        F.col("o_orderkey").alias("id"), (F.col("o_orderpriority") == "1-URGENT").alias("target")
    )
    return rounded(clf.balanced_weights(rows).select("id", "weight"))


@query(SCORED)
def logistic_l1(spark: SparkSession, sf: str) -> DataFrame:
    return _fit_and_score(spark, sf, clf.logistic(penalty="l1"))


@query(SCORED)
def forest_50(spark: SparkSession, sf: str) -> DataFrame:
    return _fit_and_score(spark, sf, clf.forest(50))


@query(SCORED)
def forest_100(spark: SparkSession, sf: str) -> DataFrame:
    return _fit_and_score(spark, sf, clf.forest(100))


@query(SCORED)
def forest_500(spark: SparkSession, sf: str) -> DataFrame:
    return _fit_and_score(spark, sf, clf.forest(500))


@query(SCORED)
def forest_100_entropy(spark: SparkSession, sf: str) -> DataFrame:
    return _fit_and_score(spark, sf, clf.forest(100, "entropy"))


@query(SCORED)
def forest_500_entropy(spark: SparkSession, sf: str) -> DataFrame:
    return _fit_and_score(spark, sf, clf.forest(500, "entropy"))


@query(SCORED)
def boosted(spark: SparkSession, sf: str) -> DataFrame:
    return _fit_and_score(spark, sf, clf.boosted())


@query(SCORED)
def linear_svm(spark: SparkSession, sf: str) -> DataFrame:
    return _fit_and_score(spark, sf, clf.linear_svm())


@query("""
    WITH train AS (
        SELECT p.*, avg_distance, ln(1 + p.ef) AS ln_ef,
               row_number() OVER (ORDER BY md5('999:' || p.id), p.id) <= floor(count(*) OVER () * 4 / 5) AS is_train
        FROM {prepared} p JOIN {distances} d ON p.cl = d.cl),
    classes AS (
        SELECT target, count(*) AS n, avg(avg_distance) AS m1, avg(ln_ef) AS m2,
               var_pop(avg_distance) + any_value(least_spread) AS v1, var_pop(ln_ef) + any_value(least_spread) AS v2
        FROM train, (SELECT 1e-9 * greatest(var_pop(avg_distance), var_pop(ln_ef)) AS least_spread FROM train WHERE is_train)
        WHERE is_train GROUP BY target),
    odds AS (
        SELECT id, c.target AS class, ln(n) - 0.5 * (ln(v1) + (avg_distance - m1) * (avg_distance - m1) / v1)
                                      - 0.5 * (ln(v2) + (ln_ef - m2) * (ln_ef - m2) / v2) AS l
        FROM train, classes c)
    SELECT t.id, t.target, round(1 / (1 + exp(least(a.l - b.l, 700))), 4) AS score
    FROM train t JOIN odds b ON t.id = b.id AND b.class JOIN odds a ON t.id = a.id AND NOT a.class""")
def gaussian_bayes(spark: SparkSession, sf: str) -> DataFrame:
    """Closed form on two features: normal densities with each class's mean and variance, widened a little."""
    candidates = _candidates(spark, sf).withColumn("ln_ef", F.log1p("ef"))
    model = clf.gaussian_bayes()(candidates.where("is_train"), ["avg_distance", "ln_ef"])
    return clf.score_rows(model, candidates).withColumn("score", F.round("score", 4))


@query("SELECT id, target, title, TRUE AS is_probability FROM {prepared}")
def predicted_ranks(spark: SparkSession, sf: str) -> DataFrame:
    """All candidates with the model's probability, best first."""
    candidates = _candidates(spark, sf)
    model = clf.logistic()(candidates.where("is_train"), FEATURES)
    ranked = clf.predict_ranks(model, candidates)
    return ranked.select("id", "target", "title", F.col("pred_ranks").between(0, 1).alias("is_probability"))


NAMES = ("logistic", "logistic_balanced", "forest_50", "forest_100", "forest_500", "boosted")


@query(f"""
    WITH tried AS (SELECT unnest({list(NAMES)}) AS clf, unnest(range(6)) AS position)
    SELECT clf, CAST(position AS INT) AS position, (SELECT count(*) FROM {{target_ids}} t JOIN {{known_papers}} USING (id)) AS num_target_papers,
           TRUE AS is_share FROM tried""")
def model_comparison(spark: SparkSession, sf: str) -> DataFrame:
    """All default classifiers on the same candidates, with the measures the choice is made by."""
    metrics = train_models(paper_sets(spark, sf)).metrics
    share = F.col("r_precision").between(0, 1) & F.col("average_precision").between(0, 1)
    return metrics.select("clf", "position", F.col("num_target_papers").cast("long").alias("num_target_papers"), share.alias("is_share"))


@query("SELECT id, title, target, TRUE AS is_probability FROM {prepared}")
def best_model_predictions(spark: SparkSession, sf: str) -> DataFrame:
    """The whole run: collect, compute features, try all classifiers, rank with the best one."""
    found = train_models(paper_sets(spark, sf)).predictions
    return found.select("id", "title", "target", F.col("pred_ranks").between(0, 1).alias("is_probability"))


@query(f"""
    WITH sizes AS (SELECT (SELECT count(*) FROM {{seeds}}) AS num_seed_papers, (SELECT count(*) FROM {{prepared}}) AS num_candidates,
                          (SELECT count(*) FROM {{prepared}} WHERE target) AS num_target_in_candidates,
                          (SELECT count(*) FROM {{target_ids}} t JOIN {{known_papers}} USING (id)) AS num_target_papers)
    SELECT clf, 'rank_to_seeds,embedding,avg_distance' AS features, TRUE AS took_time, sizes.*
    FROM (SELECT unnest(['logistic', 'gaussian_bayes']) AS clf), sizes""")
def experiment_record(spark: SparkSession, sf: str) -> DataFrame:
    """What a run notes of each fit, here with own features: distance of the rank to the seeds', vectors, clusters."""
    vectors = view(spark, sf, "embeddings").select(F.concat(F.lit("p"), F.col("vec_id") + 1).alias("id"), "embedding")
    chosen = {"rank_to_seeds": seed_mean_feature("ef"), "embedding": embedding_feature(vectors), "avg_distance": cluster_distance}
    tried = {"logistic": clf.logistic(), "gaussian_bayes": clf.gaussian_bayes()}
    record = train_models(paper_sets(spark, sf), classifiers=tried, features=chosen).record
    took = (F.col("time_fit") > 0) & (F.col("time_predict") > 0)
    counts = ("num_seed_papers", "num_candidates", "num_target_in_candidates", "num_target_papers")
    return record.select("clf", "features", took.alias("took_time"), *[F.col(c).cast("long").alias(c) for c in counts])


@query(f"""
    WITH n AS (SELECT count(*) AS n FROM {{prepared}}), marks AS (SELECT unnest([{LADDER_SQL}]) AS n)
    SELECT clf, n FROM (SELECT m.n FROM marks m, n WHERE m.n <= n.n UNION SELECT n FROM n), (SELECT unnest(['logistic', 'gaussian_bayes']) AS clf)""")
def ladder_of_every_classifier(spark: SparkSession, sf: str) -> DataFrame:
    tried = {"logistic": clf.logistic(), "gaussian_bayes": clf.gaussian_bayes()}
    return train_models(paper_sets(spark, sf), classifiers=tried).ladder.select("clf", F.col("n").cast("long").alias("n"))


@query("""SELECT unnest(['a', 'b', 'c', 'lost']) AS run_id, unnest(['review 1', 'review 2', 'review 3', 'review 4']) AS review_paper_id,
                 unnest(['logistic', 'gaussian_bayes', 'logistic_balanced', NULL]) AS classifier_str,
                 unnest([TRUE, TRUE, TRUE, NULL]) AS is_share,
                 unnest([(SELECT count(*) FROM {prepared})] || [(SELECT count(*) FROM {prepared})] || [(SELECT count(*) FROM {prepared})] || [NULL]) AS num_candidates""")
def reevaluated_runs(spark: SparkSession, sf: str) -> DataFrame:
    """The best run of each review is read back with its papers and model, and scored again; one has lost its model."""
    sets = paper_sets(spark, sf)
    fits = {"a": ("logistic", clf.logistic()), "b": ("gaussian_bayes", clf.gaussian_bayes()), "c": ("logistic_balanced", clf.logistic(balanced=True))}
    rows = [("worse", "review 1", 0.1, "nowhere", "forest_50"), ("lost", "review 4", 0.9, new_path(spark, "lost"), "forest_50")]
    for number, (run, (name, fitter)) in enumerate(fits.items(), 1):
        folder = new_path(spark, "run")
        for part, table in (("seed_papers", sets.seeds), ("target_papers", sets.targets), ("test_papers", sets.candidates)):
            save_paper_set(table, folder, part)
        train_saved(spark, folder, classifiers={name: fitter})
        rows.append((run, f"review {number}", 0.5, folder, name))
    log = spark.createDataFrame(rows, "id string, review_paper_id string, score double, datadir string, clf string")
    found = evaluate_saved(spark, log, ["review_paper_id"], "score")
    share = F.col("average_precision").between(0, 1)
    return found.select("run_id", "review_paper_id", "classifier_str", share.alias("is_share"), F.col("num_candidates").cast("long").alias("num_candidates"))


@query("SELECT id, target, TRUE AS same FROM {prepared}")
def reloaded_model(spark: SparkSession, sf: str) -> DataFrame:
    """Scores of a model read back from where it was saved are those of the model itself."""
    candidates = _candidates(spark, sf)
    model = clf.logistic()(candidates.where("is_train"), FEATURES)
    path = new_path(spark, "model")
    save_model(model, path)
    again = clf.score_rows(read_model(path), candidates, ["id"]).withColumnRenamed("score", "again")
    both = clf.score_rows(model, candidates).join(again, "id")
    return both.select("id", "target", (F.col("score") == F.col("again")).alias("same"))


@query("""SELECT unnest(['rank', 'distance', 'rank and both distances']) AS feature_set,
                 (SELECT count(*) FROM {target_ids}) AS num_target_papers, TRUE AS is_share""")
def compared_feature_sets(spark: SparkSession, sf: str) -> DataFrame:
    """R-precision with the rank alone, the distance alone, and with the distance of broader clusters."""
    ids = seed_ids(spark, sf)
    placed = meta_clusters(view(spark, sf, "tree_papers"), view(spark, sf, "meta")).select("id", "cl_meta")
    candidates = _candidates(spark, sf)
    broad = average_distance(placed, attach_papers(ids, placed), path_col="cl_meta", out_col="meta_distance")
    table = materialize(feature_union(candidates, [broad.select("id", "meta_distance")]), "features")
    sets = {
        "rank": ["ef"],
        "distance": ["avg_distance"],
        "rank and both distances": ["ef", "avg_distance", "meta_distance"],
    }
    num_targets = target_ids(spark, sf).count()
    found = clf.compare_feature_sets(table.where("is_train"), table, sets, num_targets, clf.logistic())
    count = F.col("num_target_papers").cast("long").alias("num_target_papers")
    return found.select("feature_set", count, F.col("r_precision").between(0, 1).alias("is_share"))


TRAIN = """
    parts AS (SELECT *, row_number() OVER (ORDER BY md5('999:' || id), id) <= floor(count(*) OVER () * 4 / 5) AS is_train FROM {prepared})"""


@query(f"WITH {TRAIN} SELECT target AS class, count(*) AS support, TRUE AS is_share FROM parts WHERE NOT is_train GROUP BY target")
def class_report_of_model(spark: SparkSession, sf: str) -> DataFrame:
    """Precision and recall of both classes on the held-out part, decided at one half."""
    candidates = _candidates(spark, sf)
    model = clf.logistic(balanced=True)(candidates.where("is_train"), FEATURES)
    report = class_report(clf.predictions_at_half(clf.score_rows(model, candidates.where("NOT is_train"))))
    share = F.col("precision").between(0, 1) & F.col("recall").between(0, 1) & F.col("f1").between(0, 1)
    return report.where("support > 0").select("class", "support", share.alias("is_share"))


@query("""
    WITH others AS (SELECT id FROM {part_papers} WHERE year = 1980),
    reached AS (SELECT DISTINCT unnest([c.id, c.cited_id]) AS id FROM {citations} c
                WHERE c.id IN (SELECT id FROM others) OR c.cited_id IN (SELECT id FROM others))
    SELECT id, id IN (SELECT id FROM {part_papers} WHERE year = 1981) AS target, TRUE AS is_probability
    FROM {known_papers} WHERE id IN (SELECT id FROM reached) AND id NOT IN (SELECT id FROM others) AND title IS NOT NULL""")
def transferred_model(spark: SparkSession, sf: str) -> DataFrame:
    """Candidates of one review scored with the model of another one."""
    candidates = _candidates(spark, sf)
    model = clf.logistic()(candidates.where("is_train"), FEATURES)
    papers = view(spark, sf, "part_papers")
    other_seeds = papers.where("year = 1980")
    reached = materialize(expand(other_seeds, view(spark, sf, "citations"), 1), "reached")
    others = attach_papers(reached, drop_unclustered(view(spark, sf, "papers")))
    prepared = materialize(prepare_candidates(others, other_seeds, papers.where("year = 1981")), "prepared")
    return _judged(clf.score_rows(model, default_features(prepared, other_seeds)))


@query(f"WITH {TRAIN} SELECT is_train, row_number() OVER (PARTITION BY is_train ORDER BY id) AS rank FROM parts")
def rankings_of_both_parts(spark: SparkSession, sf: str) -> DataFrame:
    """The held-out fifth and the training part, each ranked for itself."""
    candidates = _candidates(spark, sf)
    model = clf.logistic()(candidates.where("is_train"), FEATURES)
    scored = clf.score_rows(model, candidates, ["id", "target", "is_train"])
    return rank_candidates(scored, ["is_train"]).select("is_train", "rank")


@query("SELECT id, target, TRUE AS is_probability FROM {text_candidates}")
def bag_of_words_model(spark: SparkSession, sf: str) -> DataFrame:
    """Document texts as TF-IDF vectors, and a logistic regression on them."""
    rows, text = view(spark, sf, "text_candidates"), F.col("text")
    vectors = clf.bag_of_words(rows, terms(text), min_df=10, length=F.octet_length(text) / TERM_BYTES)
    featured = vectors.transform(rows, ["id", "target"])
    model = clf.logistic()(featured, ["bag_of_words"])
    return _judged(clf.score_rows(model, featured))


@query("""
    WITH lists AS (SELECT s AS split_seed, id, row_number() OVER (PARTITION BY s ORDER BY md5(CAST(s AS STRING) || ':' || id), id)
                          <= CASE WHEN count(*) OVER (PARTITION BY s) < 21 THEN 3 ELSE 20 END AS is_seed
                   FROM {id_list}, unnest([1, 2, 3, 4, 5]) AS seeds(s)),
    one AS (SELECT DISTINCT split_seed, unnest([c.id, cited_id]) AS id FROM lists l JOIN {citations} c
            ON l.id = c.cited_id OR l.id = c.id WHERE is_seed),
    two AS (SELECT split_seed, unnest([c.id, cited_id]) AS id FROM one JOIN {citations} c ON one.id = c.id
            UNION SELECT split_seed, unnest([c.id, cited_id]) FROM one JOIN {citations} c ON one.id = c.cited_id)
    SELECT t.id, count(*) AS n_runs, TRUE AS is_placed
    FROM two t JOIN {known_papers} p ON t.id = p.id LEFT JOIN lists l ON l.id = t.id AND l.split_seed = t.split_seed AND l.is_seed
    WHERE p.title IS NOT NULL AND l.id IS NULL GROUP BY t.id""")
def ranking_over_splits(spark: SparkSession, sf: str) -> DataFrame:
    """Mean rank of every candidate over five random splits, a model fitted for each."""
    size = F.when(F.col("n_rows") < 21, 3).otherwise(20)
    tables = [view(spark, sf, name) for name in ("id_list", "papers", "citations")]
    ranked = rank_over_splits(*tables, sample_size=size)
    placed = (F.col("mean_rank") >= 1) & F.col("mean_score").between(0, 1)
    return ranked.select("id", F.col("n_runs").cast("long").alias("n_runs"), placed.alias("is_placed"))
