"""Classifiers that tell targets from other candidates, as MLlib pipelines.

A classifier is a function from the number of training rows (and the columns of
the training table) to pipeline stages. All of them end in a ``score`` column
through :func:`score_rows`.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.base import Estimator, Transformer
from pyspark.ml.classification import LinearSVC, LinearSVCModel, LogisticRegression, NaiveBayes, RandomForestClassifier
from pyspark.ml.feature import SQLTransformer, VectorSlicer
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seedscape.operators.boosting import fit_boosted
from seedscape.operators.features import assembler
from seedscape.operators.model_tables import linear_parts
from seedscape.operators.newton import fit_logistic, join_runs, optimality
from seedscape.operators.ordering import running_totals
from seedscape.operators.ranking import r_precision, rank_candidates
from seedscape.operators.similarity import count_listed, tasks_for, vocabulary
from seedscape.operators.totals import attach_totals
from seedscape.scratch import materialize, materialize_by, new_path, shuffles_dropped

FEATURES, LABEL, WEIGHT = "features", "label", "weight"

Stages = list[Estimator | Transformer]
Fitter = Callable[[DataFrame, Sequence[str]], PipelineModel]


# Fixed value: says that a label has two classes, so that a fit need not count them.
TWO_CLASSES = {"ml_attr": {"type": "nominal", "name": LABEL, "vals": ["0.0", "1.0"]}}


def _labelled(rows: DataFrame) -> DataFrame:
    return rows.withColumn(LABEL, F.col("target").cast("double")).withMetadata(LABEL, TWO_CLASSES)


def balanced_weights(rows: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Add ``weight = n / (2 * size of the row's class)``, per run; the counts are one row each."""
    counts = rows.groupBy(*by).agg(F.count("*").alias("_n"), F.count_if("target").alias("_pos"))
    own = F.when(F.col("target"), F.col("_pos")).otherwise(F.col("_n") - F.col("_pos"))
    together = join_runs(rows, counts, by) if by else attach_totals(rows, counts)
    return together.withColumn(WEIGHT, F.col("_n") / (2.0 * own)).drop("_n", "_pos")


@dataclass(frozen=True)
class Logistic:
    """Logistic regression with C=1: the penalty counts once against the sum of the losses, and includes the intercept.

    Plain columns are fitted by Newton steps, for any number of runs together. Vector columns, as of a bag of
    words, are fitted by MLlib, which leaves the intercept out of the penalty.
    """

    penalty: str = "l2"
    balanced: bool = False

    def _rows(self, train: DataFrame, by: Sequence[str]) -> DataFrame:
        return balanced_weights(_labelled(train), by) if self.balanced else _labelled(train)

    def fit_runs(self, train: DataFrame, features: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
        """``(by, beta)``: the coefficients of every run, the intercept last."""
        return fit_logistic(self._rows(train, by), features, by, self.penalty, WEIGHT if self.balanced else None)

    def slack(self, train: DataFrame, coefficients: DataFrame, features: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
        """``(by, place, slack)``: how far each coefficient is from the condition of a minimum."""
        return optimality(self._rows(train, by), coefficients, features, by, self.penalty, WEIGHT if self.balanced else None)

    def __call__(self, train: DataFrame, features: Sequence[str]) -> PipelineModel:
        if any(isinstance(train.schema[f].dataType, VectorUDT) for f in features):
            return self._fit_vectors(train, features)
        found = self.fit_runs(train, features).first()
        beta = found["beta"] if found else [0.0] * (len(features) + 1)
        return coefficients_model(features, beta)

    def _fit_vectors(self, train: DataFrame, features: Sequence[str]) -> PipelineModel:
        """Every step of the fit shuffles a gradient per task, as long as the vectors: no more tasks than cores."""
        train = train.coalesce(train.sparkSession.sparkContext.defaultParallelism)
        model = LogisticRegression(
            featuresCol=FEATURES,
            labelCol=LABEL,
            regParam=1.0 / max(train.count(), 1),
            elasticNetParam=1.0 if self.penalty == "l1" else 0.0,
            standardization=False,
        )
        if self.balanced:
            model = model.setWeightCol(WEIGHT)
        return Pipeline(stages=[assembler(features), model]).fit(self._rows(train, ()))


def coefficients_model(features: Sequence[str], beta: Sequence[float]) -> PipelineModel:
    """A pipeline model that applies the coefficients of one run."""
    terms = [f"`{f}` * {float(b)!r}D" for f, b in zip(features, beta)]
    margin = " + ".join([*terms, f"{float(beta[-1])!r}D"])
    model = PipelineModel(stages=[SQLTransformer(statement=f"SELECT *, 1 / (1 + exp(-({margin}))) AS model_score FROM __THIS__")])
    model.parts = linear_parts(features, beta, beta[-1])
    return model


def logistic(penalty: str = "l2", balanced: bool = False) -> Logistic:
    return Logistic(penalty, balanced)


def forest(trees: int, impurity: str = "gini", max_depth: int = 30, seed: int = 999, bins: int = 32) -> Fitter:
    """Random forest; thresholds are the borders of ``bins`` equally full bins of a feature, so more of them come
    nearer to trying every value, at a cost in proportion."""

    def fit(train: DataFrame, features: Sequence[str]) -> PipelineModel:
        model = RandomForestClassifier(
            featuresCol=FEATURES,
            labelCol=LABEL,
            numTrees=trees,
            impurity=impurity,
            maxDepth=max_depth,
            maxBins=bins,
            featureSubsetStrategy="sqrt",
            seed=seed,
        )
        return Pipeline(stages=[assembler(features), model]).fit(_labelled(train))

    return fit


def linear_svm(folds: int = 3) -> Fitter:
    """Linear support vectors; a logistic curve on the margin gives the probability.

    The curve is fitted on margins of rows that the margin was not fitted on: every fold of the rows is measured by a
    fit on the others. Rows with equal features are in one fold. Folds whose others hold one class only are left out, and if
    that leaves no two classes, the curve is fitted on the margin's own rows.
    """

    def fit(train: DataFrame, features: Sequence[str]) -> PipelineModel:
        columns = assembler(features)
        rows = materialize(columns.transform(_labelled(train)).select(FEATURES, LABEL, F.pmod(F.xxhash64(*features), F.lit(folds)).alias("_fold")), "folds")
        rows = rows.withMetadata(LABEL, TWO_CLASSES)
        side = VectorSlicer(inputCol="svm_raw", outputCol="margin", indices=[1])
        counts = {(r["_fold"], r[LABEL]): r["n"] for r in rows.groupBy("_fold", LABEL).agg(F.count("*").alias("n")).collect()}
        total = max(sum(counts.values()), 1)

        def margin(part: DataFrame, n: int) -> LinearSVCModel:
            svm = LinearSVC(featuresCol=FEATURES, labelCol=LABEL, regParam=1.0 / max(n, 1), standardization=False)
            return svm.setRawPredictionCol("svm_raw").setPredictionCol("svm_prediction").fit(part)

        unseen, seen = None, set()
        for k in range(folds):
            others = {key: n for key, n in counts.items() if key[0] != k}
            if len({label for _, label in others}) == 2 and len(others) < len(counts):
                model = margin(rows.where(F.col("_fold") != k), sum(others.values()))
                part = side.transform(model.transform(rows.where(F.col("_fold") == k))).select("margin", LABEL)
                unseen = part if unseen is None else unseen.unionByName(part)
                seen |= {label for fold, label in counts if fold == k}
        whole = margin(rows, total)
        if len(seen) < 2:
            unseen = side.transform(whole.transform(rows)).select("margin", LABEL)
        curve = LogisticRegression(featuresCol="margin", labelCol=LABEL).fit(unseen.withMetadata(LABEL, TWO_CLASSES))
        return PipelineModel(stages=[columns, whole, side, curve])

    return fit


def gaussian_bayes() -> Fitter:
    def fit(train: DataFrame, features: Sequence[str]) -> PipelineModel:
        model = NaiveBayes(featuresCol=FEATURES, labelCol=LABEL, modelType="gaussian")
        return Pipeline(stages=[assembler(features), model]).fit(_labelled(train))

    return fit


def boosted(rounds: int = 500) -> Fitter:
    def fit(train: DataFrame, features: Sequence[str]) -> PipelineModel:
        return fit_boosted(_labelled(train), features, rounds)

    return fit


def default_classifiers(rounds: int = 500) -> dict[str, Fitter]:
    """The classifiers a run tries, in order."""
    return {
        "logistic": logistic(),
        "logistic_balanced": logistic(balanced=True),
        "forest_50": forest(50),
        "forest_100": forest(100),
        "forest_500": forest(500),
        "boosted": boosted(rounds),
    }


def legacy_classifiers() -> dict[str, Fitter]:
    """Further classifiers that may be asked for."""
    return {
        "logistic_l1": logistic(penalty="l1"),
        "linear_svm": linear_svm(),
        "gaussian_bayes": gaussian_bayes(),
        "forest_100_entropy": forest(100, "entropy"),
        "forest_500_entropy": forest(500, "entropy"),
    }


def score_rows(model: PipelineModel, rows: DataFrame, keep: Sequence[str] = ("id", "target")) -> DataFrame:
    """``keep`` and ``score``, the model's probability of being a target."""
    out = model.transform(rows)
    if "model_score" in out.columns:
        score = F.col("model_score")
    else:
        score = vector_to_array("probability")[1]
    return out.select(*keep, score.alias("score"))


def predict_ranks(model: PipelineModel, rows: DataFrame) -> DataFrame:
    """All rows with ``pred_ranks``, best first."""
    scored = score_rows(model, rows, rows.columns).withColumnRenamed("score", "pred_ranks")
    return scored.orderBy(F.col("pred_ranks").desc(), "id")


def predictions_at_half(scored: DataFrame) -> DataFrame:
    """``(label, prediction)`` with the class decided at a probability of one half."""
    return scored.select(F.col("target").alias("label"), (F.col("score") > 0.5).alias("prediction"))


def select_model(metrics: DataFrame, by: Sequence[str] = (), score: str = "r_precision") -> DataFrame:
    """The first model (by ``position``) with the best score; the last one where every score is 0."""
    rest = [c for c in metrics.columns if c not in by]
    picked = metrics.groupBy(*by).agg(
        F.min_by(F.struct(*rest), F.struct(-F.coalesce(F.col(score), F.lit(0.0)), F.col("position"))).alias("_best"),
        F.max_by(F.struct(*rest), F.col("position")).alias("_last"),
    )
    chosen = F.when(F.col(f"_best.{score}") > 0, F.col("_best")).otherwise(F.col("_last"))
    return picked.select(*by, chosen.alias("_row")).select(*by, "_row.*")


def compare_feature_sets(
    train: DataFrame, everyone: DataFrame, feature_sets: Mapping[str, Sequence[str]], num_relevant: int, fitter: Fitter
) -> DataFrame:
    """R-precision of one classifier on several feature sets, all sets ranked in one job."""
    scored = None
    for name, features in feature_sets.items():
        model = fitter(train, features)
        part = score_rows(model, everyone).withColumn("feature_set", F.lit(name))
        scored = part if scored is None else scored.unionByName(part)
    return r_precision(rank_candidates(scored, ["feature_set"]), num_relevant, ["feature_set"])


def as_vectors(rows: DataFrame, size: int, places: str, weights: str, out_col: str) -> DataFrame:
    """``rows`` with the sparse vector of two arrays in their place, null arrays as zeros.

    A vector column is stored as a struct. So the struct is written, and read back under the type.
    """
    none = F.array()
    stored = F.struct(
        F.lit(0).cast("tinyint").alias("type"),
        F.lit(size).alias("size"),
        F.coalesce(places, none.cast("array<int>")).alias("indices"),
        F.coalesce(weights, none.cast("array<double>")).alias("values"),
    )
    kept = rows.drop(places, weights, out_col)
    path = new_path(rows.sparkSession, "vectors")
    rows.select(*kept.columns, stored.alias(out_col)).write.parquet(path)
    schema = T.StructType([*kept.schema.fields, T.StructField(out_col, VectorUDT())])
    return rows.sparkSession.read.schema(schema).parquet(path)


@dataclass(frozen=True)
class BagOfWords:
    """From a term array to a TF-IDF vector of length 1, by a numbered vocabulary ``(term, place, idf)``.

    The vocabulary stays a table; only the coefficients of a model on the vectors come to the driver.
    ``counts`` are those of ``counted``, the rows the vocabulary was made from, dealt out by ``id`` to ``tasks`` buckets.
    """

    words: DataFrame
    size: int
    tokens: str | Column
    out_col: str
    length: Column | None
    counted: DataFrame
    counts: DataFrame
    tasks: int

    def transform(self, rows: DataFrame, keep: Sequence[str] | None = None) -> DataFrame:
        """Add the vector of each row to its ``keep`` (all columns); ``id`` must tell the rows apart.

        The rows the vocabulary was made from are not cut into terms again, and the counts of a text, which lie
        in one bucket, meet without a shuffle.
        """
        counts, n = (self.counts, self.tasks) if rows is self.counted else _counted(rows, self.tokens, self.length)
        kept = rows if keep is None else rows.select(*dict.fromkeys(["id", *keep]))
        w = F.col("tf") * F.col("idf")
        sums = [F.sort_array(F.collect_list(F.struct("place", w.alias("weight")))).alias("_weights"), F.sqrt(F.sum(w * w)).alias("_length")]
        texts = counts.join(self.words, "term").groupBy("id").agg(*sums)
        scaled = texts.select(
            "id", F.col("_weights.place").alias("_places"), F.transform("_weights", lambda w: w["weight"] / F.col("_length")).alias("_values")
        )
        with shuffles_dropped(rows.sparkSession):
            made = as_vectors(kept.repartition(n, "id").join(scaled, "id", "left"), self.size, "_places", "_values", self.out_col)
        return made if keep is None else made.select(*keep, self.out_col)


def _counted(rows: DataFrame, tokens: str | Column, length: Column | None) -> tuple[DataFrame, int]:
    """The written counts of the terms of each ``id``, and in how many buckets they lie."""
    listed = F.col(tokens) if isinstance(tokens, str) else tokens
    with shuffles_dropped(rows.sparkSession):
        tasks = tasks_for(rows, F.size(listed) if length is None else length)
        return materialize_by(count_listed(rows, ["id"], listed, tasks=tasks), tasks, "id", "terms"), tasks


def bag_of_words(
    rows: DataFrame, tokens: str | Column, min_df: int = 10, out_col: str = "bag_of_words", length: Column | None = None
) -> BagOfWords:
    """Number the terms that are in at least ``min_df`` of the texts in ``rows``, with their smoothed weights.

    ``tokens`` is an array of terms. An expression on a text is worked out where the texts are dealt to, so that the texts
    move and not their terms; ``length`` is then about the number of terms, known more cheaply.
    """
    counts, tasks = _counted(rows, tokens, length)
    with shuffles_dropped(rows.sparkSession):
        known = vocabulary(counts, rows.agg(F.count("*").alias("n_texts")), min_df=min_df)
        numbered = running_totals(known, [F.col("term")]).select("term", (F.col("rank") - 1).cast("int").alias("place"), "idf")
        words = materialize(numbered, "words")
        return BagOfWords(words, words.count(), tokens, out_col, length, rows, counts, tasks)
