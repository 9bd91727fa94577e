"""AdaBoost over one-split trees, real-valued form.

MLlib has no AdaBoost. A stump only asks on which side of a threshold a value lies, so the training
rows are counted in cells first: the bin of every feature, and the label. Bins depend on a feature's
own values alone, however many features there are. The cells stay spread over the executors, packed
in blocks, and are kept there for all rounds. Features with few bins share a code, so that a cell is looked up and
counted once for all of them. A round is one job: a task reads its blocks one by one, weighs each cell by the sum
of the leaf values so far, and adds up the weights per code, and from these per feature and bin. Only these small tables come back, and the next stump is found in their sum. A table of cells for one
task goes through all rounds in that task.

The result is a plain pipeline model: bins are searched for, and an SQL stage adds up the leaf values per feature,
so saving, loading and scoring need nothing special however many rounds there were.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel, TaskContext
from pyspark.ml import PipelineModel
from pyspark.ml.feature import Bucketizer, SQLTransformer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seedscape.operators.model_tables import part
from seedscape.operators.ordering import running_totals
from seedscape.scratch import materialize

# Fixed value: leaf shares are kept this far away from 0 and 1.
EPSILON = 2.220446049250313e-16
#: Bins of a feature with more different values than that.
MAX_BINS = 64
#: Cells of a task, as long as there are cores for more tasks, and the most in any case.
TASK_CELLS, MOST_CELLS = 1 << 16, 1 << 21
#: Cells of a block, and the most codes of a group of features: what a block is added up to stays in a core's cache.
BLOCK_CELLS, GROUP_CODES = 1 << 16, 1 << 13

STUMPS = "round int, feature int, bin int, low double, high double"


def _leaf_values(pos: np.ndarray, total: np.ndarray) -> np.ndarray:
    share = np.clip(pos / np.maximum(total, EPSILON), EPSILON, 1.0 - EPSILON)
    return 0.5 * (np.log(share) - np.log(1.0 - share))


def _value(feature: str) -> Column:
    """Null and NaN lie below every other value."""
    return F.coalesce(F.nanvl(F.col(feature).cast("double"), F.lit(float("-inf"))), F.lit(float("-inf")))


def bin_edges(train: DataFrame, features: Sequence[str], bins: int = MAX_BINS) -> dict[str, list[float]]:
    """Inner edges of the bins of each feature, by its own values; a value on an edge lies below it.

    With at most ``bins`` different values each is a bin. Otherwise the edges are the exact quantiles: the values
    at which the share of the rows passes a multiple of ``1 / bins``.
    """
    if not features:
        return {}
    listed = F.explode(F.array(*[F.struct(F.lit(i).alias("feature"), _value(f).alias("value")) for i, f in enumerate(features)]))
    counts = train.select(listed.alias("x")).groupBy("x.feature", "x.value").agg(F.count(F.lit(1)).alias("n"))
    ordered = running_totals(counts, [F.col("value")], {"seen": F.col("n")}, by=["feature"])
    quantile = lambda seen: F.floor(seen * bins / F.col("seen_total"))
    passed = quantile(F.col("seen")) > quantile(F.col("seen") - F.col("n"))
    cut = ordered.filter((F.col("rank") < F.col("n_rows")) & ((F.col("n_rows") <= bins) | passed) & (F.col("value") > float("-inf")))
    found = cut.select("feature", "value").collect()  # at most ``bins`` rows per feature
    return {f: sorted(r["value"] for r in found if r["feature"] == i) for i, f in enumerate(features)}


def count_cells(train: DataFrame, features: Sequence[str], edges: dict[str, list[float]]) -> DataFrame:
    """(label, bin_0, bin_1, ..., n): the training rows by bins and label."""
    valued = train.select("label", *[_value(f).alias(f"value_{i}") for i, f in enumerate(features)])
    cut = [i for i, f in enumerate(features) if edges[f]]
    if cut:
        valued = _bucketizer({f"value_{i}": edges[features[i]] for i in cut}, [f"at_{i}" for i in cut]).transform(valued)
    bins = [(F.col(f"at_{i}") if i in cut else F.lit(0)).cast("int").alias(f"bin_{i}") for i in range(len(features))]
    keys = ["label", *[f"bin_{i}" for i in range(len(features))]]
    return valued.select("label", *bins).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def best_stump(pos: np.ndarray, neg: np.ndarray, sizes: Sequence[int]) -> tuple[int, int, np.ndarray, float]:
    """The feature and its last bin on the low side with the least impurity, the values of both leaves, and the
    error. ``pos`` and ``neg`` have a row of weights per feature; ``sizes`` says how many bins a feature has.

    Each side is added up for itself, so that a pure one is exactly pure.
    """
    best = (np.inf, 0, 0, np.zeros(2), 0.0)
    for f, n in enumerate(sizes):
        last = max(n - 1, 1)
        up = [np.cumsum(x[f, :n])[:last] for x in (pos, neg)]
        down = [np.append(np.cumsum(x[f, :n][::-1])[::-1][1:], [0.0] * (n == 1)) for x in (pos, neg)]
        good, bad = np.stack([up[0], down[0]]), np.stack([up[1], down[1]])
        gini = (good * bad / np.maximum(good + bad, EPSILON)).sum(axis=0)
        at = int(np.argmin(gini))
        if gini[at] < best[0] - 1e-15:
            error = np.minimum(good[:, at], bad[:, at]).sum()
            best = (gini[at], f, at, _leaf_values(good[:, at], good[:, at] + bad[:, at]), float(error))
    return best[1:]


def _groups(sizes: Sequence[int]) -> list[list[int]]:
    """Features that share a code: each group has at most ``GROUP_CODES`` combinations of bins and label, or one feature."""
    groups: list[tuple[int, list[int]]] = []
    for f in sorted(range(len(sizes)), key=lambda f: -sizes[f]):
        at = next((i for i, (n, _) in enumerate(groups) if n * sizes[f] <= GROUP_CODES), len(groups))
        n, members = groups[at] if at < len(groups) else (2, [])
        groups[at : at + 1] = [(n * sizes[f], [*members, f])]
    return [sorted(members) for _, members in groups]


def _code_type(sizes: Sequence[int]) -> np.dtype:
    return np.min_scalar_type(max(2 * int(np.prod([sizes[f] for f in group])) for group in _groups(sizes)))


def _pack(sizes: Sequence[int]):
    """Cells in blocks: a code of the bins and the label per group of features, group by group, and the numbers of rows."""
    groups, kind = _groups(sizes), _code_type(sizes)

    def block(held: list[list[np.ndarray]]) -> pa.RecordBatch:
        label, *bins, n = [np.concatenate(column) for column in zip(*held)]
        codes = []
        for group in groups:
            code = np.zeros(len(n), np.int64)
            for f in group:
                code = code * sizes[f] + bins[f]
            codes.append((2 * code + label).astype(kind))
        counts = n.astype(np.min_scalar_type(int(n.max())))
        columns = [pa.array([x.tobytes()], pa.binary()) for x in (np.stack(codes), counts)]
        return pa.RecordBatch.from_arrays(columns, names=["codes", "counts"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, cells = [], 0
        for batch in batches:
            if len(batch):
                held.append([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns])
                cells += len(batch)
            if cells >= BLOCK_CELLS:
                yield block(held)
                held, cells = [], 0
        if held:
            yield block(held)

    return run


def _blocks(batches: Iterator[pa.RecordBatch], n_groups: int, kind: np.dtype) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for batch in batches:
        for codes, counts in zip(*batch.columns):
            own = np.frombuffer(codes.as_buffer(), kind).reshape(n_groups, -1)
            numbers = counts.as_buffer()
            yield own, np.frombuffer(numbers, f"u{numbers.size // own.shape[1]}")


class _Rounds:
    """The stumps so far, and what they add up to by feature and bin."""

    def __init__(self, sizes: Sequence[int]):
        self.sizes, self.stumps, self.shift, self.ended = list(sizes), [], 0.0, False
        self.leaves = np.zeros((len(sizes), max(sizes)))

    def sums(self, blocks: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """Weights of cells per feature, bin and label. They add up to 1 before the last stump."""
        groups = _groups(self.sizes)
        shapes = [[self.sizes[f] for f in group] for group in groups]
        tables = [self._signed(group, shape) for group, shape in zip(groups, shapes)]
        totals = [np.zeros(2 * int(np.prod(shape))) for shape in shapes]
        for codes, counts in blocks:
            exponent, places = np.full(codes.shape[1], -self.shift), [own.astype(np.intp) for own in codes]
            for table, at in zip(tables, places):
                if table is not None:
                    exponent += table.take(at)
            weight = counts * np.exp(exponent, out=exponent)
            for total, at in zip(totals, places):
                total += np.bincount(at, weight, len(total))
        sums = np.zeros((*self.leaves.shape, 2))
        for group, shape, total in zip(groups, shapes, totals):
            cube = total.reshape(*shape, 2)
            for axis, f in enumerate(group):
                others = tuple(k for k in range(len(group)) if k != axis)
                sums[f, : self.sizes[f]] = cube.sum(axis=others)
        return sums.reshape(len(self.sizes), -1)

    def _signed(self, group: Sequence[int], shape: Sequence[int]) -> np.ndarray | None:
        """What the stumps add to the exponent, by the code of a group; nothing if they do not use its features."""
        leaves = np.zeros(shape)
        for axis, f in enumerate(group):
            leaves += self.leaves[f, : self.sizes[f]].reshape([-1 if k == axis else 1 for k in range(len(group))])
        return np.stack([leaves, -leaves], axis=-1).ravel() if leaves.any() else None

    def add(self, sums: np.ndarray) -> None:
        """One more stump, or the end."""
        whole = sums[0].sum()
        if not whole:
            self.ended = True
            return
        neg, pos = np.moveaxis(sums.reshape(*self.leaves.shape, 2) / whole, 2, 0)
        f, at, (low, high), error = best_stump(pos, neg, self.sizes)
        self.stumps.append((len(self.stumps) + 1, f, at, float(low), float(high)))
        self.leaves[f] += np.where(np.arange(self.leaves.shape[1]) <= at, low, high)
        self.shift += float(np.log(whole))
        self.ended = error <= 0


def _sums_of(made: _Rounds, kind: np.dtype):
    """The sums of a task's cells, under the number of the task: they must not be added in the order of arrival."""

    n_groups = len(_groups(made.sizes))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = made.sums(_blocks(batches, n_groups, kind))
        task = pa.array([TaskContext.get().partitionId()], pa.int32())
        yield pa.RecordBatch.from_arrays([task, pa.array([sums.tobytes()], pa.binary())], names=["task", "sums"])

    return run


def _all_rounds(sizes: Sequence[int], kind: np.dtype, rounds: int):
    """All rounds over the cells of one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, made = list(_blocks(batches, len(_groups(sizes)), kind)), _Rounds(sizes)
        while len(made.stumps) < rounds and not made.ended:
            made.add(made.sums(held))
        kinds = [pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.float64()]
        columns = [pa.array([s[k] for s in made.stumps], t) for k, t in enumerate(kinds)]
        yield pa.RecordBatch.from_arrays(columns, names=["round", "feature", "bin", "low", "high"])

    return run


def boost(train: DataFrame, features: Sequence[str], edges: dict[str, list[float]], rounds: int = 500) -> DataFrame:
    """The stumps (round, feature and last low bin by number, leaf values), up to the first that makes no error.

    ``train`` has a ``label`` of 0 or 1. Rows with a null feature lie below all edges. No rows give no stumps. What a lost
    executor held is made again from the table of cells.
    """
    cells = materialize(count_cells(train, features, edges), "cells")
    spark, n = cells.sparkSession, cells.count()
    tasks = max(1, min(spark.sparkContext.defaultParallelism, -(-n // TASK_CELLS)), -(-n // MOST_CELLS))
    keys = ["label", *[f"bin_{i}" for i in range(len(features))]]
    sizes = [len(edges[f]) + 1 for f in features]
    kind = _code_type(sizes)
    dealt = cells.select(*keys, "n").repartition(tasks, *keys).sortWithinPartitions(*keys)
    packed = dealt.mapInArrow(_pack(sizes), "codes binary, counts binary")
    if tasks == 1:
        return materialize(packed.mapInArrow(_all_rounds(sizes, kind, rounds), STUMPS), "stumps")
    packed, made = packed.persist(StorageLevel.MEMORY_AND_DISK), _Rounds(sizes)
    try:
        while len(made.stumps) < rounds and not made.ended:
            found = packed.mapInArrow(_sums_of(made, kind), "task int, sums binary").collect()  # a small table per task
            made.add(sum(np.frombuffer(r["sums"]).reshape(len(sizes), -1) for r in sorted(found, key=lambda r: r["task"])))
    finally:
        packed.unpersist()
    return spark.createDataFrame(made.stumps, STUMPS)


def fit_boosted(train: DataFrame, features: Sequence[str], rounds: int = 500) -> PipelineModel:
    """Fit up to ``rounds`` stumps; stops early when one of them makes no error.

    Rows with a null feature count as below all edges.
    """
    features = list(features)
    edges = bin_edges(train, features)
    values = {f: np.zeros(len(edges[f]) + 1) for f in features}
    stumps = boost(train, features, edges, rounds).orderBy("round").collect() if features else []  # one row per round
    for s in stumps:
        own = values[features[s["feature"]]]
        own += np.where(np.arange(len(own)) <= s["bin"], s["low"], s["high"])
    model = _sums_of_leaves(features, edges, {f: values[f] / max(len(stumps), 1) for f in features})
    model.parts = [part("constant", sum(2 * values[f][0] for f in features) / max(len(stumps), 1))]
    for f in features:
        gains = 2 * np.diff(values[f]) / max(len(stumps), 1)
        model.parts += [part("step", gain, f, edge) for edge, gain in zip(edges[f], gains) if gain]
    return model


def _sums_of_leaves(features: Sequence[str], edges: dict[str, list[float]], values: dict[str, np.ndarray]) -> PipelineModel:
    """What the stumps add up to, by the bins that the values lie in; null and NaN are below all edges.

    A bin is searched for, and its value looked up in an array: a comparison for every edge makes a method that
    the JVM does not compile.
    """
    least = "double('-infinity')"
    cut = {f: i for i, f in enumerate(features) if edges[f]}
    known = [f"coalesce(nanvl(double(`{f}`), {least}), {least}) AS _boost_value_{i}" for f, i in cut.items()]
    listed = {f: "array(" + ", ".join(f"{float(v)!r}D" for v in values[f]) + ")" for f in cut}
    terms = [f"element_at({listed[f]}, int(_boost_bin_{cut[f]}) + 1)" if f in cut else f"{float(values[f][0])!r}D" for f in features]
    score = f"1 / (1 + exp(-2 * ({' + '.join(terms) or '0.0D'}))) AS model_score"
    if not cut:
        return PipelineModel(stages=[SQLTransformer(statement=f"SELECT *, {score} FROM __THIS__")])
    own = [f"_boost_{kind}_{i}" for kind in ("value", "bin") for i in cut.values()]
    return PipelineModel(
        stages=[
            SQLTransformer(statement=f"SELECT *, {', '.join(known)} FROM __THIS__"),
            _bucketizer({f"_boost_value_{i}": edges[f] for f, i in cut.items()}, own[len(cut) :]),
            SQLTransformer(statement=f"SELECT * EXCEPT ({', '.join(own)}), {score} FROM __THIS__"),
        ]
    )


def _bucketizer(edges: dict[str, list[float]], out: Sequence[str]) -> Bucketizer:
    """The bins of columns; a value on an edge lies below it."""
    splits = [[-np.inf, *[float(np.nextafter(e, np.inf)) for e in own], np.inf] for own in edges.values()]
    return Bucketizer(splitsArray=splits, inputCols=list(edges), outputCols=list(out))
