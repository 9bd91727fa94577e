"""Fitted models as rows, so that the models of many runs are read in one scan and applied in one job.

A row is a part of a model: ``slope`` and ``square`` of a feature, a ``constant``, a ``step`` (added
where the feature is above ``edge``), or a ``node`` of a tree, which leads to node ``low`` where the feature
is not above ``edge`` and to ``high`` elsewhere, or has no feature and the tree's ``value``. Parts but nodes add up to log-odds;
trees are averaged.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml import PipelineModel
from pyspark.ml.classification import LinearSVCModel, LogisticRegressionModel, NaiveBayesModel, RandomForestClassificationModel
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seedscape.scratch import materialize

PARTS = "part string, tree int, node int, feature string, edge double, low int, high int, value double"
#: Rows of a run that are scored in one group.
BLOCK = 1 << 16


def part(kind: str, value: float, feature: str | None = None, edge: float | None = None) -> tuple:
    """A row of a model that adds up to log-odds."""
    return (kind, None, None, feature, edge, None, None, float(value))


def linear_parts(features: Sequence[str], slopes: Sequence[float], constant: float) -> list[tuple]:
    return [*[part("slope", b, f) for f, b in zip(features, slopes)], part("constant", constant)]


def _bayes_parts(features: Sequence[str], model: NaiveBayesModel) -> list[tuple]:
    """Log-odds of two normal densities per feature, which are a square, a slope and a constant."""
    prior, mean, spread = model.pi.toArray(), model.theta.toArray(), model.sigma.toArray()
    rows, constant = [], prior[1] - prior[0]
    for i, feature in enumerate(features):
        sign = np.array([-1.0, 1.0])
        rows.append(part("square", float((-0.5 * sign / spread[:, i]).sum()), feature))
        rows.append(part("slope", float((sign * mean[:, i] / spread[:, i]).sum()), feature))
        constant += float((sign * (-0.5 * np.log(spread[:, i]) - 0.5 * mean[:, i] ** 2 / spread[:, i])).sum())
    return [*rows, part("constant", constant)]


def _forest_parts(spark: SparkSession, features: Sequence[str], model: RandomForestClassificationModel, path: str) -> DataFrame:
    """The nodes of a forest, from the table that the library saves at ``path``."""
    model.write().overwrite().save(path)
    nodes = spark.read.parquet(f"{path}/data").select(F.col("treeID").cast("int").alias("tree"), "nodeData.*")
    leaf = F.col("leftChild") < 0
    names = F.array(*[F.lit(f) for f in features])
    return nodes.select(
        F.lit("node").alias("part"),
        "tree",
        F.col("id").cast("int").alias("node"),
        F.when(~leaf, F.get(names, F.col("split.featureIndex"))).alias("feature"),
        F.when(~leaf, F.get("split.leftCategoriesOrThreshold", F.lit(0))).alias("edge"),
        F.when(~leaf, F.col("leftChild")).cast("int").alias("low"),
        F.when(~leaf, F.col("rightChild")).cast("int").alias("high"),
        F.when(leaf, F.get("impurityStats", F.lit(1)) / F.aggregate("impurityStats", F.lit(0.0), lambda a, b: a + b)).alias("value"),
    )


def parts_of(spark: SparkSession, model: PipelineModel, path: str) -> DataFrame | None:
    """The rows of a fitted model; None for a kind that has none, as over a bag of words. ``path``: a folder for its trees."""
    rows = getattr(model, "parts", None)
    if rows is None:
        stages = list(model.stages)
        if not isinstance(stages[0], VectorAssembler):
            return None
        features, fitted = stages[0].getInputCols(), stages[1:]
        kinds = [type(s) for s in fitted]
        if kinds == [RandomForestClassificationModel]:
            return _forest_parts(spark, features, fitted[0], path)
        if kinds == [NaiveBayesModel] and fitted[0].getModelType() == "gaussian":
            rows = _bayes_parts(features, fitted[0])
        elif kinds[0] is LinearSVCModel and kinds[-1] is LogisticRegressionModel:
            (a,), c = fitted[-1].coefficients.toArray(), fitted[-1].intercept
            rows = linear_parts(features, a * fitted[0].coefficients.toArray(), a * fitted[0].intercept + c)
        else:
            return None
    return spark.createDataFrame(rows, PARTS)


def _apply(parts: list[dict], columns: dict[str, np.ndarray], n: int) -> np.ndarray:
    """Scores of ``n`` rows by the parts of one model."""
    trees: dict[int, list[dict]] = {}
    steps: dict[str, list[tuple[float, float]]] = {}
    odds = np.zeros(n)
    for p in parts:
        if p["part"] == "node":
            trees.setdefault(p["tree"], []).append(p)
        elif p["part"] == "step":
            steps.setdefault(p["feature"], []).append((p["edge"], p["value"]))
        else:
            x = 1.0 if p["part"] == "constant" else columns[p["feature"]]
            odds += p["value"] * (x * x if p["part"] == "square" else x)
    for feature, own in steps.items():
        edges, gains = map(np.array, zip(*sorted(own)))
        x = np.where(np.isnan(columns[feature]), -np.inf, columns[feature])
        odds += np.append(0.0, np.cumsum(gains))[np.searchsorted(edges, x)]
    if not trees:
        return 1 / (1 + np.exp(-np.clip(odds, -700, 700)))
    total = np.zeros(n)
    for nodes in trees.values():
        by_node = {p["node"]: p for p in nodes}
        waiting = [(0, np.arange(n))]
        while waiting:
            at, rows = waiting.pop()
            node = by_node[at]
            if node["feature"] is None:
                total[rows] += node["value"]
                continue
            low = columns[node["feature"]][rows] <= node["edge"]
            waiting += [(to, own) for to, own in ((node["low"], rows[low]), (node["high"], rows[~low])) if len(own)]
    return total / len(trees)


def score_with_tables(rows: DataFrame, models: DataFrame, features: Sequence[str], run: str = "run_id", keep: Sequence[str] = ("id", "target")) -> DataFrame:
    """``run``, ``keep`` and ``score`` of the rows of every run that has a model; ``models`` has ``run`` and the parts.

    Rows of a run meet its parts in groups of about ``BLOCK``, so a run of any size is spread; all runs are one job.
    Features travel as plain columns, which a group's arrays are views of. What else is known of a row may travel along in ``keep``.
    """
    sizes = rows.groupBy(run).agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("_blocks"))
    sizes = materialize(sizes, "sizes")
    dealt = rows.join(sizes, run).withColumn("_block", F.pmod(F.xxhash64(*keep), "_blocks").cast("int"))
    places = [f"_x{i}" for i in range(len(features))]
    values = [F.coalesce(F.col(f).cast("double"), F.lit(float("nan"))).alias(x) for f, x in zip(features, places)]
    dealt = dealt.select(run, "_block", F.struct(*[F.col(c) for c in keep]).alias("_row"), *values)
    names = [f.split()[0] for f in PARTS.split(", ")]
    spread = models.join(sizes, run).select(run, F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)).alias("_block"), *names)

    def score(rows_: pa.Table, parts: pa.Table) -> pa.Table:
        n = len(rows_) if len(parts) else 0
        rows_ = rows_.slice(0, n)
        columns = {f: rows_[x].to_numpy() for f, x in zip(features, places)}
        found = _apply(parts.select(names).to_pylist(), columns, n) if n else np.zeros(0)
        return pa.table({run: rows_[run], "_row": rows_["_row"], "score": pa.array(found)})

    kinds = {f.name: f.dataType.simpleString() for f in dealt.schema.fields}
    made = dealt.groupBy(run, "_block").cogroup(spread.groupBy(run, "_block"))
    scored = made.applyInArrow(score, f"`{run}` {kinds[run]}, _row {kinds['_row']}, score double")
    return scored.select(run, "_row.*", "score")
