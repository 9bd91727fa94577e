"""Logistic regressions of many runs at once, by Newton steps.

A step is one aggregate over the training rows of all runs: per run the loss, its gradient and its
Hessian, which are plain sums of compiled expressions. The equations of a run, one row of a
few numbers, are then solved for themselves. Every step is a table in the shared folder, so a
lost executor repeats at most one.

The penalty counts once against the sum of the losses (C = 1) and includes the intercept.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce
from operator import add, and_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seedscape.scratch import materialize

#: Steps after which a run is left as it is, and the change, against the scale of a feature, that ends it.
MAX_STEPS, TOLERANCE = 100, 1e-10
#: Features up to which the Hessian is summed up whole.
MAX_FEATURES = 64

_STATE = "beta array<double>, best array<double>, loss double, step array<double>, share double, done boolean"


def _margin(features: Sequence[str], beta: str) -> Column:
    """Log-odds of a row; the last coefficient is the intercept."""
    terms = [F.col(f).cast("double") * F.col(beta)[i] for i, f in enumerate(features)]
    return reduce(add, [*terms, F.col(beta)[len(features)]])


def probability(features: Sequence[str], beta: str = "beta") -> Column:
    return 1 / (1 + F.exp(-_margin(features, beta)))


def _sums(rows: DataFrame, features: Sequence[str], by: Sequence[str], weight: str | None) -> DataFrame:
    """Per run: loss, gradient of the loss, and the upper triangle of its Hessian."""
    w = F.col(weight) if weight else F.lit(1.0)
    margin = _margin(features, "beta")
    p = probability(features)
    signed = F.when(F.col("label") > 0, -margin).otherwise(margin)
    loss = w * (F.greatest(signed, F.lit(0.0)) + F.log1p(F.exp(-F.abs(signed))))
    x = [*[F.col(f).cast("double") for f in features], F.lit(1.0)]
    valued = rows.select(*by, "label", *[c.alias(f"_x{i}") for i, c in enumerate(x)], loss.alias("_loss"), (w * (p - F.col("label"))).alias("_g"), (w * p * (1 - p)).alias("_h"))
    n = len(x)
    sums = [F.sum("_loss").alias("now")]
    sums.append(F.array(*[F.sum(F.col("_g") * F.col(f"_x{i}")) for i in range(n)]).alias("gradient"))
    sums.append(F.array(*[F.sum(F.col("_h") * F.col(f"_x{i}") * F.col(f"_x{j}")) for i in range(n) for j in range(i, n)]).alias("hessian"))
    sums.append(F.array(*[F.sum(F.col(f"_x{i}") * F.col(f"_x{i}")) for i in range(n)]).alias("square"))
    return valued.groupBy(*by).agg(*sums)


def _l1_step(beta: np.ndarray, gradient: np.ndarray, hessian: np.ndarray) -> np.ndarray:
    """Coordinate by coordinate, the change that makes the quadratic model and the sum of the absolute values least."""
    change = np.zeros(len(beta))
    slope = gradient.copy()
    for _ in range(20_000):
        most = 0.0
        for j in range(len(beta)):
            curve = max(hessian[j, j], 1e-300)
            aim = beta[j] + change[j] - slope[j] / curve
            step = np.sign(aim) * max(abs(aim) - 1 / curve, 0.0) - beta[j] - change[j]
            change[j] += step
            slope += step * hessian[j]
            most = max(most, abs(step) * np.sqrt(curve))
        if most < 1e-13:
            break
    return change


def _solve(penalty: str):
    """The next trial of every run: a Newton step from where the loss fell, half the last step where it rose."""

    def penalised(beta: np.ndarray) -> float:
        return float(np.abs(beta).sum() if penalty == "l1" else 0.5 * beta @ beta)

    def one(beta, best, loss, step, share, now, gradient, hessian, square) -> tuple:
        beta, best, step = np.array(beta), np.array(best), np.array(step)
        now += penalised(beta)
        if now > loss + 1e-9 * abs(loss):  # the step was too long
            share /= 2
            return best + share * step, best, loss, step, share, share < 1e-12
        n = len(beta)
        full = np.zeros((n, n))
        full[np.triu_indices(n)] = hessian
        full = full + full.T - np.diag(np.diag(full))
        scale = np.sqrt(np.maximum(square, 1e-300))
        if penalty == "l1":
            full += np.diag(1e-12 * scale**2)
            step = _l1_step(beta, np.array(gradient), full)
        else:
            full += np.eye(n)
            unit = np.sqrt(np.diag(full))
            step = np.linalg.solve(full / np.outer(unit, unit), -(np.array(gradient) + beta) / unit) / unit
        longest = np.abs(step * scale).max() / max(1.0, np.sqrt(square[-1]))
        share = min(1.0, 20.0 / max(longest, 1e-300))  # no feature may move the odds by more in one step
        return beta + share * step, beta, now, step, share, longest < TOLERANCE * (1 + np.abs(beta * scale).max())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["beta", "best", "loss", "step", "share", "now", "gradient", "hessian", "square"]
        for batch in batches:
            given = list(zip(*(batch.column(batch.schema.names.index(c)).to_pylist() for c in names)))
            made = list(zip(*(one(*row) for row in given))) or [()] * 6
            lists = pa.list_(pa.float64())
            columns = [pa.array(map(list, made[0]), lists), pa.array(map(list, made[1]), lists), pa.array(made[2], pa.float64())]
            columns += [pa.array(map(list, made[3]), lists), pa.array(made[4], pa.float64()), pa.array(map(bool, made[5]), pa.bool_())]
            keys = [i for i, c in enumerate(batch.schema.names) if c not in names]
            out = ["beta", "best", "loss", "step", "share", "done"]
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in keys], *columns], names=[*[batch.schema.names[i] for i in keys], *out])

    return run


def join_runs(rows: DataFrame, runs: DataFrame, by: Sequence[str]) -> DataFrame:
    """``rows`` of the ``runs`` with the columns of their run; a run may have a null key. Without keys there is one run."""
    keys = {k: f"_of_{k}" for k in by}
    same = reduce(and_, [F.col(k).eqNullSafe(F.col(of)) for k, of in keys.items()], F.lit(True))
    return rows.join(runs.withColumnsRenamed(keys), same).drop(*keys.values()) if by else rows.crossJoin(F.broadcast(runs))


def fit_logistic(
    train: DataFrame, features: Sequence[str], by: Sequence[str] = (), penalty: str = "l2", weight: str | None = None
) -> DataFrame:
    """``(by, beta)``: coefficients of ``features`` in order and the intercept, per run, in the jobs of one.

    ``train`` has a ``label`` of 0 or 1 and no null features. A run with one class only gets the finite coefficients
    that the penalty allows; no rows give no runs. Without ``by`` there is one run.
    """
    if len(features) > MAX_FEATURES:
        raise ValueError(f"at most {MAX_FEATURES} columns; put more of them into a vector")
    zeros = F.array(*[F.lit(0.0)] * (len(features) + 1))
    start = {"beta": zeros, "best": zeros, "loss": F.lit(float("inf")), "step": zeros, "share": F.lit(1.0), "done": F.lit(False)}
    first = train.select(*by).distinct() if by else train.limit(1).select()
    state = materialize(first.withColumns(start), "coefficients")
    solved = None
    keys = ", ".join(f"`{k}` {train.schema[k].dataType.simpleString()}" for k in by)
    for _ in range(MAX_STEPS):
        rows = join_runs(train, state, by)
        sums = _sums(rows, features, by, weight)
        told = join_runs(sums, state, by) if by else sums.crossJoin(F.broadcast(state))
        made = told.drop("done").mapInArrow(_solve(penalty), ", ".join(filter(None, [keys, _STATE])))
        state = materialize(made, "coefficients")
        ended = state.where("done")
        solved = ended if solved is None else solved.unionByName(ended)
        state = state.where("NOT done")
        if state.isEmpty():
            break
    everything = solved.unionByName(state)
    return materialize(everything.select(*by, F.col("best").alias("beta")), "coefficients")


def score_runs(rows: DataFrame, coefficients: DataFrame, features: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """``rows`` with the ``score`` that their run's coefficients give them."""
    return join_runs(rows, coefficients, by).withColumn("score", probability(features)).drop("beta")


def optimality(
    train: DataFrame, coefficients: DataFrame, features: Sequence[str], by: Sequence[str] = (), penalty: str = "l2", weight: str | None = None
) -> DataFrame:
    """``(by, place, slack)``: how far each coefficient is from the condition of a minimum, against the feature's scale.

    At the minimum the gradient of the losses and the penalty is 0; under the absolute penalty, where a coefficient is 0,
    the losses' gradient must not exceed 1.
    """
    sums = join_runs(_sums(join_runs(train, coefficients, by), features, by, weight), coefficients, by)
    each = sums.select(*by, F.posexplode(F.arrays_zip("gradient", "beta", "square")).alias("place", "x"))
    g, b = F.col("x.gradient"), F.col("x.beta")
    if penalty == "l1":
        slack = F.when(b == 0, F.greatest(F.abs(g) - 1, F.lit(0.0))).otherwise(F.abs(g + F.sign(b)))
    else:
        slack = F.abs(g + b)
    return each.select(*by, "place", (slack / F.sqrt(F.greatest("x.square", F.lit(1.0)))).alias("slack"))
