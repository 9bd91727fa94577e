import random

import pytest

from seedscape.operators import ranking

FLAGS = [True, False, True, True, False]


def scored(spark, flags=FLAGS, scores=None):
    scores = scores or [1.0 - i / 10 for i in range(len(flags))]
    return spark.createDataFrame(
        [(i, s, f) for i, (f, s) in enumerate(zip(flags, scores))], "id long, score double, target boolean"
    )


def test_small_ranking_by_hand(spark):
    ranked = ranking.rank_candidates(scored(spark))
    assert ranking.r_precision(ranked).first()["r_precision"] == pytest.approx(2 / 3)
    assert ranking.r_precision(ranked, 4).first()["r_precision"] == pytest.approx(3 / 4)
    at2 = ranking.metrics_at(ranked, 2, 4).first()
    assert (at2["precision"], at2["recall"]) == (0.5, 0.25)
    assert at2["f1"] == pytest.approx(2 * 0.5 * 0.25 / 0.75)
    # hits at ranks 3 and 4 see precisions 1/2 and 2/3 just above them
    coded = ranking.average_precision_as_ranked(ranked, 3).first()["average_precision"]
    assert coded == pytest.approx((1 / 2 + 2 / 3) / 3)
    steps = ranking.score_steps(scored(spark))
    assert ranking.average_precision(steps).first()["average_precision"] == pytest.approx((1 + 2 / 3 + 3 / 4) / 3)
    assert ranking.roc_auc(steps).first()["roc_auc"] == pytest.approx(4 / 6)
    assert ranking.score_cutoff(ranked).first()["cutoff"] == pytest.approx(0.8)
    top = {r["target"]: r["n"] for r in ranking.top_by_target(ranked, 3).collect()}
    assert top == {True: 2, False: 1}


def test_ladder_stops_at_the_length(spark):
    rows = ranking.metric_ladder(ranking.rank_candidates(scored(spark, [True, False] * 30))).collect()
    assert sorted(r["n"] for r in rows) == [10, 50, 60]


def test_curve_ends_when_all_targets_are_found(spark):
    rows = ranking.precision_recall_curve(ranking.score_steps(scored(spark))).collect()
    points = sorted((r["recall"], r["precision"]) for r in rows)
    assert points == [(0.0, 1.0), (pytest.approx(1 / 3), 0.5), (pytest.approx(1 / 3), 1.0), (pytest.approx(2 / 3), pytest.approx(2 / 3)), (1.0, 0.75)]


def test_roc_drops_points_inside_straight_stretches(spark):
    steps = ranking.score_steps(scored(spark, [True, True, True, False, False]))
    kept = sorted((r["fpr"], r["tpr"]) for r in ranking.roc_curve(steps).collect())
    assert kept == [(0.0, 0.0), (0.0, pytest.approx(1 / 3)), (0.0, 1.0), (1.0, 1.0)]
    two = ranking.score_steps(scored(spark, [True, False], [0.9, 0.1]))
    assert ranking.roc_curve(two).count() == 3
    assert ranking.roc_curve(steps, drop_intermediate=False).count() == 6


def test_ties_share_a_step_and_count_half(spark):
    steps = ranking.score_steps(scored(spark, [True, False, True, False], [0.5] * 4))
    assert ranking.roc_auc(steps).first()["roc_auc"] == pytest.approx(0.5)
    assert ranking.average_precision(steps).first()["average_precision"] == pytest.approx(0.5)


@pytest.mark.parametrize("seed", range(3))
def test_measures_stay_in_bounds_and_match_pair_counting(spark, seed):
    rng = random.Random(seed)
    flags = [rng.random() < 0.3 for _ in range(80)] + [True, False]
    scores = [rng.randint(0, 20) / 20 for _ in flags]
    steps = ranking.score_steps(scored(spark, flags, scores))
    auc = ranking.roc_auc(steps).first()["roc_auc"]
    pos = [s for s, f in zip(scores, flags) if f]
    neg = [s for s, f in zip(scores, flags) if not f]
    wins = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg)
    assert auc == pytest.approx(wins / (len(pos) * len(neg)))
    assert 0 <= ranking.average_precision(steps).first()["average_precision"] <= 1


def test_no_hits_at_all(spark):
    ranked = ranking.rank_candidates(scored(spark, [False, False, False]))
    assert ranking.average_precision_as_ranked(ranked, 5).first()["average_precision"] == 0
    assert ranking.metrics_at(ranked, 2, 5).first()["f1"] is None


def test_runs_without_a_model_get_nulls(spark):
    runs = spark.createDataFrame([("r1",), ("r2",)], "run_id string")
    rows = scored(spark).selectExpr("'r1' AS run_id", "*")
    got = {r["run_id"]: r for r in ranking.evaluate_runs(runs, rows).collect()}
    assert got["r1"]["num_candidates"] == 5 and got["r1"]["no_skill"] == pytest.approx(0.6)
    assert got["r2"]["average_precision"] is None


def test_class_report_counts(spark):
    rows = [(True, True)] * 3 + [(True, False)] + [(False, True)] * 2 + [(False, False)] * 4
    got = {r["class"]: r for r in ranking.class_report(spark.createDataFrame(rows, "label boolean, prediction boolean")).collect()}
    assert (got[True]["precision"], got[True]["recall"], got[True]["support"]) == (0.6, 0.75, 4)
    assert got[False]["precision"] == pytest.approx(0.8) and got[False]["support"] == 6
