"""Batched logistic regressions against plain Newton steps in NumPy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from seedscape.operators import classifiers as clf
from seedscape.operators.newton import fit_logistic, optimality, score_runs

RUNS = [None, "a", "b"]


def made_rows(seed=5, n=240):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        run = RUNS[i % 3]
        target = bool(rng.random() < 0.3)
        rows.append((i, run, target, float(rng.normal(2e5 if target else 1e5, 8e4)), float(rng.normal(0.4 * target, 1)), float(rng.normal())))
    return rows


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame(made_rows(), "id long, run string, target boolean, a double, b double, c double").repartition(3)


def plain(rows, balanced=False):
    """The minimum of the penalised losses by many undamped steps on scaled columns."""
    x = np.array([[*r[3:], 1.0] for r in rows])
    y = np.array([float(r[2]) for r in rows])
    w = np.where(y > 0, len(y) / (2 * y.sum()), len(y) / (2 * (len(y) - y.sum()))) if balanced else np.ones(len(y))
    beta = np.zeros(4)
    for _ in range(60):
        p = 1 / (1 + np.exp(-x @ beta))
        gradient = x.T @ (w * (p - y)) + beta
        hessian = (x * (w * p * (1 - p))[:, None]).T @ x + np.eye(4)
        unit = np.sqrt(np.diag(hessian))
        beta = beta - np.linalg.solve(hessian / np.outer(unit, unit), gradient / unit) / unit
    return beta


@pytest.mark.parametrize("balanced", [False, True])
def test_every_run_has_its_own_minimum(spark, table, balanced):
    found = clf.logistic(balanced=balanced).fit_runs(table, ["a", "b", "c"], ["run"])
    betas = {r["run"]: r["beta"] for r in found.collect()}
    assert set(betas) == set(RUNS)
    for run in RUNS:
        assert betas[run] == pytest.approx(plain([r for r in made_rows() if r[1] == run], balanced), rel=1e-6, abs=1e-9)


def test_one_run_is_saved_and_scores_alike(spark, table):
    fitter = clf.logistic()
    scored = {r["id"]: r["score"] for r in clf.score_rows(fitter(table, ["a", "b", "c"]), table).collect()}
    found = fitter.fit_runs(table, ["a", "b", "c"])
    together = {r["id"]: r["score"] for r in score_runs(table, found, ["a", "b", "c"]).collect()}
    assert scored == pytest.approx(together)
    assert found.first()["beta"] == pytest.approx(plain(made_rows()), rel=1e-6, abs=1e-9)


@pytest.mark.parametrize("penalty", ["l1", "l2"])
def test_conditions_of_the_minimum(spark, table, penalty):
    fitter = clf.logistic(penalty)
    found = fitter.fit_runs(table, ["a", "b", "c"], ["run"])
    assert fitter.slack(table, found, ["a", "b", "c"], ["run"]).agg(F.max("slack"), F.count("*")).first()[:] == (pytest.approx(0, abs=1e-6), 12)
    worse = found.withColumn("beta", F.transform("beta", lambda b: b * 1.1 + 1e-7))
    assert fitter.slack(table, worse, ["a", "b", "c"], ["run"]).agg(F.max("slack")).first()[0] > 1e-3


def test_absolute_penalty_leaves_noise_out(spark):
    rng = np.random.default_rng(2)
    rows = [(float(rng.normal(y)), float(rng.normal() * 1e-3), float(y)) for y in (i % 2 for i in range(200))]
    table = spark.createDataFrame(rows, "a double, noise double, label double")
    beta = fit_logistic(table, ["a", "noise"], penalty="l1").first()["beta"]
    assert beta[1] == 0 and beta[0] > 0.5


def test_separable_one_class_and_no_rows(spark):
    table = spark.createDataFrame([("s", float(x), float(x > 0)) for x in (-3, -2, 2, 3)] + [("one", 1.0, 1.0)] * 3, "run string, a double, label double")
    betas = {r["run"]: r["beta"] for r in fit_logistic(table, ["a"], ["run"]).collect()}
    assert all(np.isfinite(b).all() for b in betas.values()) and betas["s"][0] > 0 and betas["one"][1] > 0
    assert optimality(table, fit_logistic(table, ["a"], ["run"]), ["a"], ["run"]).agg(F.max("slack")).first()[0] < 1e-6
    assert fit_logistic(table.limit(0), ["a"]).count() == 0
    with pytest.raises(ValueError):
        fit_logistic(table, ["a"] * 65)
