"""Boosting over cells against plain rounds on the rows."""

import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from seedscape.operators import boosting
from seedscape.operators import classifiers as clf
from seedscape.operators.boosting import EPSILON, bin_edges, boost, fit_boosted


def made(n=400, width=3, seed=1):
    rng = np.random.default_rng(seed)
    x = np.round(rng.normal(size=(n, width)), 1)
    y = ((x[:, 0] > 0.3) ^ (rng.random(n) < 0.2)) | (x[:, 1] > 1.2)
    return x, y.astype(float)


def table(spark, x, y):
    names = [f"f{i}" for i in range(x.shape[1])]
    rows = [(float(t), *map(float, r)) for r, t in zip(x, y)]
    return spark.createDataFrame(rows, "label double, " + ", ".join(f"{c} double" for c in names)).repartition(3), names


def plain_stumps(x, y, rounds):
    """Every threshold of every feature, on the rows themselves."""
    weight, found = np.full(len(y), 1 / len(y)), []
    for _ in range(rounds):
        best = (np.inf,)
        for f in range(x.shape[1]):
            for edge in np.unique(x[:, f])[:-1]:
                low = x[:, f] <= edge
                sides = [(weight[s].sum(), (weight * y)[s].sum()) for s in (low, ~low)]
                gini = sum(p * (t - p) / max(t, EPSILON) for t, p in sides)
                if gini < best[0] - 1e-15:
                    value = [0.5 * np.log(np.clip(p / t, EPSILON, 1 - EPSILON) / (1 - np.clip(p / t, EPSILON, 1 - EPSILON))) for t, p in sides]
                    best = (gini, f, edge, *value)
        _, f, edge, low, high = best
        found.append((f, edge, low, high))
        weight = weight * np.exp(-(2 * y - 1) * np.where(x[:, f] <= edge, low, high))
        weight /= weight.sum()
    return found


def test_stumps_equal_those_of_all_thresholds(spark):
    x, y = made()
    frame, names = table(spark, x, y)
    edges = bin_edges(frame, names, 1000)
    found = [(r["feature"], edges[names[r["feature"]]][r["bin"]], r["low"], r["high"]) for r in boost(frame, names, edges, 12).orderBy("round").collect()]
    for got, wanted in zip(found, plain_stumps(x, y, 12), strict=True):
        assert got == pytest.approx(wanted, rel=1e-6)


def test_bins_do_not_depend_on_the_number_of_features(spark):
    x, y = made(3000, 20)
    x = x + np.random.default_rng(0).random(x.shape) / 100
    frame, names = table(spark, x, y)
    assert bin_edges(frame, names[:3]) == {f: e for f, e in bin_edges(frame, names).items() if f in names[:3]}
    edges = bin_edges(frame, names)
    for i, f in enumerate(names):
        ordered = np.sort(x[:, i])
        assert edges[f] == pytest.approx([ordered[int(np.ceil(k * 3000 / 64)) - 1] for k in range(1, 64)])


def test_several_tasks_give_the_stumps_of_one(spark, monkeypatch):
    from seedscape.operators import boosting

    x, y = made(600, 5)
    frame, names = table(spark, x, y)
    edges = bin_edges(frame, names)
    alone = boost(frame, names, edges, 20).orderBy("round").collect()
    monkeypatch.setattr(boosting, "TASK_CELLS", 100)
    for a, b in zip(alone, boost(frame, names, edges, 20).orderBy("round").collect(), strict=True):
        assert tuple(a)[:3] == tuple(b)[:3] and tuple(a)[3:] == pytest.approx(tuple(b)[3:])


def test_nulls_and_nan_lie_below_and_constants_say_nothing(spark):
    rows = [(i, i % 2 == 0, None if i % 2 == 0 else float(i), float("nan") if i % 4 == 0 else 1.0, 7.0) for i in range(40)]
    frame = spark.createDataFrame(rows, "id long, target boolean, a double, b double, c double")
    scored = clf.score_rows(clf.boosted(5)(frame, ["a", "b", "c"]), frame)
    wrong = scored.where((F.col("score") > 0.5) != F.col("target"))
    assert [r["id"] for r in wrong.collect()] == [1]  # the least value is below all edges, too


def test_no_rows_and_no_features(spark):
    x, y = made(20)
    frame, names = table(spark, x, y)
    assert fit_boosted(frame.limit(0), names).transform(frame).select("model_score").distinct().collect()[0][0] == 0.5
    assert fit_boosted(frame, []).transform(frame).count() == 20


def test_a_round_does_not_wait_and_its_sums_may_come_from_many_tasks(spark, monkeypatch):
    x, y = made(2000, 4, seed=3)
    frame, names = table(spark, x, y)
    edges = bin_edges(frame, names, 1000)
    begun = time.perf_counter()
    alone = boost(frame, names, edges, 60).orderBy("round").collect()
    assert time.perf_counter() - begun < 40  # a barrier between rounds takes a second each
    monkeypatch.setattr(boosting, "TASK_CELLS", 300)
    spread = boost(frame, names, edges, 60).orderBy("round").collect()
    assert len(alone) == len(spread) == 60
    for a, b in zip(alone, spread):
        assert a[:3] == b[:3] and a[3:] == pytest.approx(b[3:], rel=1e-6)


def test_features_with_few_bins_share_a_code(monkeypatch):
    sizes = [7, 64, 50, 3, 1, 12, 64, 200]
    groups = boosting._groups(sizes)
    assert sorted(f for group in groups for f in group) == list(range(8)) and len(groups) <= 5
    rng = np.random.default_rng(5)
    bins = [rng.integers(0, n, 3000) for n in sizes]
    label, n = rng.integers(0, 2, 3000), rng.integers(1, 300, 3000)
    batches = [pa.RecordBatch.from_arrays([pa.array(c[k : k + 700]) for c in (label, *bins, n)], names=[f"c{i}" for i in range(10)]) for k in range(0, 3000, 700)]
    monkeypatch.setattr(boosting, "BLOCK_CELLS", 1000)
    packed = list(boosting._pack(sizes)(iter(batches)))
    assert len(packed) == 3
    made = boosting._Rounds(sizes)
    made.leaves = np.where(np.arange(200) < np.array(sizes)[:, None], rng.normal(size=(8, 200)), 0.0)
    made.leaves[3] = 0.0
    made.shift = 0.7
    weight = n * np.exp(-(1 - 2 * label) * -sum(made.leaves[f][b] for f, b in enumerate(bins)) - 0.7)
    found = made.sums(boosting._blocks(iter(packed), len(groups), boosting._code_type(sizes))).reshape(8, 200, 2)
    for f, b in enumerate(bins):
        for y in (0, 1):
            assert found[f, :, y] == pytest.approx(np.bincount(b[label == y], weight[label == y], 200))


def test_scores_are_looked_up_not_compared_edge_by_edge(spark):
    x, y = made(3000, 20)
    x = x + np.random.default_rng(0).random(x.shape) / 100
    frame, names = table(spark, x, y)
    model = fit_boosted(frame, names, 200)
    plan = model.transform(frame)._jdf.queryExecution().optimizedPlan().toString()
    assert "CASE" not in plan and set(model.transform(frame).columns) == {*frame.columns, "model_score"}
    edges, stumps = bin_edges(frame, names), boost(frame, names, bin_edges(frame, names), 200).collect()
    margin = sum(np.where(x[:, s["feature"]] <= edges[names[s["feature"]]][s["bin"]], s["low"], s["high"]) for s in stumps) / len(stumps)
    wanted = {tuple(map(float, row)): 1 / (1 + np.exp(-2 * m)) for row, m in zip(x, margin)}
    for row in model.transform(frame).collect():
        assert row["model_score"] == pytest.approx(wanted[tuple(row[f] for f in names)], rel=1e-9)
