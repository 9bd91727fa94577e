"""From a list of known papers to a ranked list of related ones."""

from __future__ import annotations

import time
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seedscape.operators.classifiers import Fitter, default_classifiers, logistic, score_rows, select_model
from seedscape.operators.features import Feature, default_feature_set, with_features
from seedscape.operators.graph import attach_papers, expand
from seedscape.operators.model_tables import score_with_tables
from seedscape.operators.newton import score_runs
from seedscape.operators.prep import drop_unclustered, prepare_candidates
from seedscape.operators.ranking import (
    aggregate_rankings,
    average_precision_as_ranked,
    evaluate_runs,
    metric_ladder,
    r_precision,
    rank_candidates,
)
from seedscape.operators.sampling import split_seeds, split_train
from seedscape.operators.summary import best_per_key
from seedscape.scratch import materialize
from seedscape.sources.readers import find_model, only_paper_info, read_of_runs, read_paper_sets
from seedscape.sources.runs import RUN_KEYS, collect_pending
from seedscape.sources.writers import append_log, save_model, save_paper_set, write_new, write_predictions


@dataclass(frozen=True)
class PaperSets:
    seeds: DataFrame
    targets: DataFrame
    candidates: DataFrame


def collect_papers(
    id_list: DataFrame,
    papers: DataFrame,
    edges: DataFrame,
    sample_size: int | Column,
    seed: int | Column = 999,
    degrees: int = 2,
    by: Sequence[str] = (),
) -> PaperSets:
    """Split the list into seeds and targets and collect everything within ``degrees`` of the seeds.

    Seeds without a paper record are followed as well. With run keys in ``by``,
    all runs are collected at once. The IDs reached are written, so that the join with the papers knows how
    few they are, and papers are read once for all three sets. These are written, since every later
    step reads them several times.
    """
    known = drop_unclustered(papers)
    split = materialize(split_seeds(id_list.select(*by, "id").distinct(), sample_size, seed, by), "split")
    seed_ids = split.where("is_seed").drop("is_seed")
    target_ids = split.where("NOT is_seed").drop("is_seed")
    reached = expand(seed_ids, edges, degrees, by)
    sets = {"seeds": seed_ids, "targets": target_ids, "candidates": reached}
    named = [ids.select(*by, "id", F.lit(name).alias("_set")) for name, ids in sets.items()]
    wanted = materialize(named[0].unionByName(named[1]).unionByName(named[2]), "wanted")
    found = materialize(attach_papers(wanted, known), "papers")
    return PaperSets(**{name: materialize(found.where(F.col("_set") == name).drop("_set"), name) for name in sets})


@dataclass(frozen=True)
class TrainedReview:
    model: PipelineModel
    name: str
    metrics: DataFrame
    ladder: DataFrame
    record: DataFrame
    candidates: DataFrame
    predictions: DataFrame


# The columns of an experiment record, beside ID and time of the run.
RECORD = (
    "clf, num_seed_papers, num_target_papers, num_target_in_candidates, num_candidates, num_correctly_predicted, "
    "score_correctly_predicted, features, time_fit, time_predict"
).split(", ")


def _experiment_record(metrics: DataFrame, counts: Mapping[str, int], features: Sequence[str], times: Mapping[str, float], predict: float) -> DataFrame:
    """One row per fit: sizes of the sets, hits and their share, features and seconds. Ranking is one job for all fits."""
    spent = metrics.sparkSession.createDataFrame(list(times.items()), "clf string, time_fit double")
    rows = metrics.join(F.broadcast(spent), "clf").withColumnRenamed("r_precision", "score_correctly_predicted")
    rows = rows.withColumns({name: F.lit(n).cast("long") for name, n in counts.items()})
    return rows.withColumns({"features": F.lit(",".join(features)), "time_predict": F.lit(predict / len(times))}).select(*RECORD)


def train_models(
    sets: PaperSets,
    year: int | None = None,
    classifiers: Mapping[str, Fitter] | None = None,
    features: Mapping[str, Feature] | None = None,
    title_col: str = "title",
    seed: int = 999,
) -> TrainedReview:
    """Try each classifier and rank all candidates with the one that finds most targets.

    ``features`` are named functions of candidates and seeds, the three default ones unless
    given. They are computed once from the written candidates and shared by all fits. The
    scores of all classifiers are ranked in one job, which also gives the predictions.
    """
    classifiers = classifiers or default_classifiers()
    features = features or default_feature_set(title_col)
    prepared = materialize(prepare_candidates(sets.candidates, sets.seeds, sets.targets, year, title_col), "prepared")
    prepared = materialize(split_train(prepared, seed), "split")
    candidates = materialize(with_features(prepared, sets.seeds, features), "features")
    train = candidates.where("is_train")
    models, times, scored = {}, {}, None
    for position, (name, fit) in enumerate(classifiers.items()):
        begun = time.perf_counter()
        models[name] = fit(train, list(features))
        times[name] = time.perf_counter() - begun
        part = score_rows(models[name], candidates).withColumns({"clf": F.lit(name), "position": F.lit(position)})
        scored = part if scored is None else scored.unionByName(part)
    num_targets = sets.targets.select("id").distinct().count()
    begun = time.perf_counter()
    ranked = materialize(rank_candidates(scored, ["clf", "position"]), "ranked")
    predict = time.perf_counter() - begun
    key = ["clf", "position"]
    metrics = materialize(
        r_precision(ranked, num_targets, key).join(average_precision_as_ranked(ranked, num_targets, key), key), "metrics"
    )
    best = select_model(metrics).first()["clf"]
    counts = {
        "num_seed_papers": sets.seeds.count(),
        "num_target_in_candidates": candidates.where("target").count(),
        "num_candidates": candidates.count(),
    }
    own = ranked.where(F.col("clf") == best).select("id", F.col("score").alias("pred_ranks"))
    predictions = materialize(candidates.join(own, "id"), "predictions")
    return TrainedReview(
        models[best],
        best,
        metrics,
        metric_ladder(ranked, num_targets, key),
        _experiment_record(metrics, counts, list(features), times, predict),
        candidates,
        predictions.orderBy(F.col("pred_ranks").desc(), "id"),
    )


def collect_splits(
    id_list: DataFrame,
    papers: DataFrame,
    edges: DataFrame,
    sample_size: int | Column,
    split_seeds: Sequence[int] = (1, 2, 3, 4, 5),
    degrees: int = 2,
) -> PaperSets:
    """The paper sets of several random splits of one list, told apart by ``split_seed`` and collected together."""
    repeated = id_list.select(F.explode(F.array(*map(F.lit, split_seeds))).alias("split_seed"), "id")
    return collect_papers(repeated, papers, edges, sample_size, F.col("split_seed"), degrees, ["split_seed"])


def collect_lists(
    lists: DataFrame,
    papers: DataFrame,
    edges: DataFrame,
    sample_size: int | Column,
    folder: str,
    split_seeds: Sequence[int] = (1, 2, 3, 4, 5),
    degrees: int = 2,
    group_size: int = 100,
) -> None:
    """Collect several splits of many lists ``(review_id, id)`` into ``folder``, restartable.

    Runs without a completion record are collected in groups of ``group_size``, each in the same
    jobs, and stored by ``(review_id, split_seed)``; ``paper_set`` says which of the three sets a
    row belongs to. :func:`~seedscape.operators.graph.lists_of_reviews` makes such lists from the
    review papers themselves.
    """
    keys = list(RUN_KEYS)
    seeds = F.explode(F.array(*map(F.lit, split_seeds))).alias("split_seed")
    runs = lists.select("review_id").distinct().select("review_id", seeds)

    def collect(open_runs: DataFrame) -> DataFrame:
        wanted = lists.join(open_runs, "review_id").select(*keys, "id")
        sets = collect_papers(wanted, papers, edges, sample_size, F.col("split_seed"), degrees, keys)
        named = {"seed": sets.seeds, "target": sets.targets, "candidate": sets.candidates}
        parts = [rows.withColumn("paper_set", F.lit(name)) for name, rows in named.items()]
        return parts[0].unionByName(parts[1]).unionByName(parts[2])

    collect_pending(runs, folder, collect, group_size=group_size)


def rank_over_splits(
    id_list: DataFrame,
    papers: DataFrame,
    edges: DataFrame,
    sample_size: int | Column,
    split_seeds: Sequence[int] = (1, 2, 3, 4, 5),
    classifier: Fitter | None = None,
    year: int | None = None,
    degrees: int = 2,
    features: Mapping[str, Feature] | None = None,
) -> DataFrame:
    """Repeat the split, rank the candidates of each, and average score and rank per paper, best mean rank first.

    Collection, features and ranking run once for all splits, and so do fits of a classifier that fits several
    runs together, as logistic regression does; other fits follow one another. Papers that were a seed in one split are still ranked in the others.
    """
    by = ["split_seed"]
    classifier = classifier or logistic()
    sets = collect_splits(id_list, papers, edges, sample_size, split_seeds, degrees)
    features = features or default_feature_set()
    prepared = materialize(prepare_candidates(sets.candidates, sets.seeds, sets.targets, year, by=by), "prepared")
    prepared = materialize(split_train(prepared, F.col("split_seed"), by), "split")
    candidates = materialize(with_features(prepared, sets.seeds, features, by), "features")
    kept = ["split_seed", "id", "target"]
    if hasattr(classifier, "fit_runs"):
        fitted = classifier.fit_runs(candidates.where("is_train"), list(features), by)
        scored = score_runs(candidates, fitted, list(features), by).select(*kept, "score")
    else:
        scored = None
        for number in split_seeds:
            own = candidates.where(F.col("split_seed") == number)
            part = score_rows(classifier(own.where("is_train"), list(features)), own, kept)
            scored = part if scored is None else scored.unionByName(part)
    return aggregate_rankings(rank_candidates(scored, by)).orderBy("mean_rank", "id")


def ladder_of_best(trained: TrainedReview, num_targets: int) -> DataFrame:
    """Precision, recall and F1 of the chosen model at each cut-off."""
    scored = trained.predictions.select("id", "target", F.col("pred_ranks").alias("score"))
    return metric_ladder(rank_candidates(scored), num_targets)


def run_review(
    spark: SparkSession,
    id_list: DataFrame,
    papers: DataFrame,
    edges: DataFrame,
    sample_size: int,
    folder: str,
    seed: int = 999,
    year: int | None = None,
    classifiers: Mapping[str, Fitter] | None = None,
    features: Mapping[str, Feature] | None = None,
    info: DataFrame | None = None,
) -> TrainedReview:
    """Collect, save, train, and write the model and its predictions below ``folder``.

    ``info`` is the one record of the review itself; its year is used unless one is given.
    """
    sets = collect_papers(id_list, papers, edges, sample_size, seed)
    save_paper_set(sets.seeds, folder, "seed_papers")
    save_paper_set(sets.targets, folder, "target_papers")
    save_paper_set(sets.candidates, folder, "test_papers")
    if info is not None and year is None:
        year = year_of_info(info)
    return train_saved(spark, folder, year, classifiers, seed, features)


def year_of_info(info: DataFrame) -> int | None:
    """The year of a review's own record."""
    return only_paper_info(info, F.lit(True)).first()["year"]


def train_saved(
    spark: SparkSession,
    folder: str,
    year: int | None = None,
    classifiers: Mapping[str, Fitter] | None = None,
    seed: int = 999,
    features: Mapping[str, Feature] | None = None,
) -> TrainedReview:
    """Train on paper sets saved before and write model, metrics, ladder, experiment record and predictions beside them."""
    saved = read_paper_sets(spark, folder)
    sets = PaperSets(saved["seed_papers"], saved["target_papers"], saved["test_papers"])
    trained = train_models(sets, year, classifiers, features, seed=seed)
    save_model(trained.model, f"{folder}/best_model")
    write_new(trained.metrics, f"{folder}/metrics.parquet")
    write_new(trained.ladder, f"{folder}/ladder.parquet")
    append_log(trained.record, f"{folder}/experiments.parquet")
    write_predictions(trained.predictions, folder)
    return trained


def evaluate_saved(
    spark: SparkSession,
    runs: DataFrame,
    key: Sequence[str],
    score: str,
    features: Mapping[str, Feature] | None = None,
    year: int | None = None,
) -> DataFrame:
    """Score the saved candidates of the best run per key with its saved model, one row per run.

    ``runs`` is a log with ``id``, ``key``, ``score``, ``datadir`` (the folder of :func:`run_review`) and
    ``clf``. A run whose folder holds no model gives nulls. Paper sets and models of all runs are read in one
    scan each, and features, scores and measures are computed together, so the number of jobs does not depend on
    the number of runs. The list of runs, a row per fit, comes to the driver. Models of a kind without a table are scored in turn.
    """
    best = materialize(best_per_key(runs, list(key), score), "runs")
    features = features or default_feature_set()
    kind = best.schema["id"].dataType.simpleString()
    folders = {r["id"]: r["datadir"] for r in best.select("id", "datadir").collect()}
    parts = read_of_runs(spark, folders, "best_model_parts.parquet", kind=kind)
    with_parts = {r[0] for r in parts.select("run_id").distinct().collect()} if parts is not None else set()
    others = {run: model for run, folder in folders.items() if run not in with_parts and (model := find_model(f"{folder}/best_model"))}
    known = {run: folder for run, folder in folders.items() if run in with_parts or run in others}
    named = best.select(F.col("id").alias("run_id"), *key, "datadir", F.col("clf").alias("classifier_str"))
    scored = None
    if known:
        names = ("test_papers", "seed_papers", "target_papers")
        sets = [materialize(read_of_runs(spark, known, f"{n}.parquet", kind=kind).dropDuplicates(), n) for n in names]
        prepared = materialize(prepare_candidates(*sets, year, by=["run_id"]), "prepared")
        candidates = materialize(with_features(prepared, sets[1], features, ["run_id"]), "features")
        if with_parts:
            scored = score_with_tables(candidates, parts, list(features))
        for run, model in others.items():
            own = score_rows(model, candidates.where(F.col("run_id") == run), ["run_id", "id", "target"])
            scored = own if scored is None else scored.unionByName(own)
    if scored is None:
        scored = named.select("run_id", F.lit("").alias("id"), F.lit(False).alias("target"), F.lit(0.0).alias("score")).limit(0)
    evaluated = evaluate_runs(named, materialize(scored, "scored"), ["run_id"])
    return evaluated.withColumn("classifier_str", F.when(F.col("num_candidates").isNotNull(), F.col("classifier_str")))
