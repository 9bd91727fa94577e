"""Quality classifier by co-training of two views.

One classifier sees the words of a text, the other what a page index would know about it:
language, source, sizes and the make-up of its lines and characters. Both are fitted on a
bounded sample of labelled documents. In every round both then score all unlabelled documents, and each
labels those of which it is most certain, for the other to learn from. Their scores are
calibrated on labelled documents kept aside and added up as evidence.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from itertools import islice
from math import log2
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seedscape.llm.common import appended, delete_table, map_batches, text_bytes, with_fields
from seedscape.scratch import materialize, new_path

#: Tokens are hashed to so many features, of which a classifier keeps those that tell the classes apart best.
HASHED, KEPT = 1 << 20, 768
#: Least chi-square of such a token, so that chance differences in a small sample are not learnt.
LEAST_CHI = 10.0
#: Leading bytes of a word that count as features besides the word, so that inflected words are known too.
STEMS = (4, 6)
#: Labelled documents to learn from, at most, up to chance; rounds of exchange.
MAX_LABELLED, COTRAIN_ROUNDS = 8_000, 3
#: Documents that a view labels in a round, the most certain of all, and how certain it must be.
PER_ROUND, CERTAIN = 400, 0.98
#: Ridge penalty of the classifiers; weights a worker remembers by token.
PENALTY, REMEMBERED = 1.0, 100_000

_TOKENS = re.compile(rb"[0-9a-z\x80-\xff]+|[^\x00-\x20\x7f0-9a-z\x80-\xff]+")
_LAYOUT = (("upper", rb"[A-Z]"), ("digit", rb"[0-9]"), ("mark", rb"[!-/:-@\[-`{-~]"), ("space", rb"[\x09-\x0d ]"))
_CLASSES = {name: bytes(b for b in range(256) if re.match(shape, bytes([b]))) for name, shape in _LAYOUT}


def _level(share: float) -> int:
    """A share on a rough scale: 0 for none, then by powers of two."""
    return 0 if share <= 0 else max(1, 12 + int(log2(share)))


def content_tokens(text: bytes) -> set[bytes]:
    """The view of the words: words, runs of marks and leading letters, and how often words come twice in a row."""
    words = _TOKENS.findall(text.lower())
    found = set(words)
    for size in STEMS:
        found |= {b"\1" + w[:size] for w in found if len(w) > size and w[0] > 1}
    twice = sum(a == b for a, b in zip(words, islice(words, 1, None)))
    found.add(b"\2twice%d" % _level(twice / max(1, len(words))))
    found.add(b"\2fresh%d" % (20 * len(set(words)) // max(1, len(words))))
    return found


def metadata_tokens(text: bytes, facts: Iterable[object]) -> set[bytes]:
    """The view of the metadata: the given facts as they are, and sizes and shares on rough scales."""
    n, lines = len(text), text.count(b"\n") + 1
    found = {b"%d=%s" % (i, str(fact).encode()) for i, fact in enumerate(facts)}
    found |= {b"size%d" % n.bit_length(), b"lines%d" % lines.bit_length(), b"width%d" % (n // lines).bit_length()}
    for name, members in _CLASSES.items():
        found.add(name.encode() + b"%d" % _level((n - len(text.translate(None, members))) / max(1, n)))
    return found


def _hashed(tokens: set[bytes]) -> np.ndarray:
    return np.unique(np.fromiter(map(crc32, tokens), np.int64, len(tokens)) % HASHED).astype(np.int32)


@dataclass
class View:
    """A logistic classifier over the presence of a few hashed tokens."""

    weights: dict[int, float]
    bias: float
    slope: float = 1.0
    offset: float = 0.0

    def raw(self, features: list[np.ndarray]) -> np.ndarray:
        """Log-odds before calibration."""
        dense = np.zeros(HASHED)
        dense[list(self.weights)] = list(self.weights.values())
        return np.array([dense[x].sum() for x in features]) + self.bias

    def score(self, features: list[np.ndarray]) -> np.ndarray:
        return self.slope * self.raw(features) + self.offset


@dataclass
class Model:
    """Both views, and the prior log-odds of a good document that each of them contains."""

    content: View | None = None
    metadata: View | None = None
    prior: float = 0.0
    facts: tuple[str, ...] = ()
    slope: float = 1.0
    offset: float = 0.0
    history: list[dict] = field(default_factory=list)

    def combine(self, content: np.ndarray, metadata: np.ndarray) -> np.ndarray:
        return self.slope * (content + metadata - self.prior) + self.offset


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, penalty: float) -> np.ndarray:
    """Ridge logistic regression by Newton steps; the last column of ``x`` is the constant and is not penalised."""
    beta = np.zeros(x.shape[1])
    ridge = np.full(x.shape[1], penalty)
    ridge[-1] = 1e-6
    for _ in range(25):
        p = _sigmoid(x @ beta)
        slope = x.T @ (weight * (y - p)) - ridge * beta
        curve = (x * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + np.diag(ridge)
        step = np.linalg.solve(curve, slope)
        beta += step * min(1.0, 4 / max(np.abs(step).max(), 1e-12))
        if np.abs(step).max() < 1e-4:
            break
    return beta


def _fit_view(features: list[np.ndarray], y: np.ndarray, weight: np.ndarray) -> View:
    """Keep the tokens that differ most between the classes, by chi-square, and weigh them."""
    owner = np.repeat(np.arange(len(features)), list(map(len, features)))
    tokens = np.concatenate([*features, np.zeros(0, np.int32)])
    with_token = np.bincount(tokens, weight[owner], HASHED)
    good_with = np.bincount(tokens, (weight * y)[owner], HASHED)
    share = (weight * y).sum() / weight.sum()
    expected = with_token * share
    absent = weight.sum() - with_token
    spread = expected * (1 - share) * absent / weight.sum()
    chi = np.where(spread > 0, (good_with - expected) ** 2 / np.maximum(spread, 1e-9), 0)
    kept = np.sort(np.argsort(-chi, kind="stable")[: min(KEPT, int((chi >= LEAST_CHI).sum()))])
    column = np.full(HASHED, -1)
    column[kept] = np.arange(len(kept))
    x = np.zeros((len(features), len(kept) + 1))
    known = column[tokens] >= 0
    x[owner[known], column[tokens[known]]] = 1
    x[:, -1] = 1
    beta = _logistic(x, y, weight, PENALTY)
    return View(dict(zip(kept.tolist(), beta[:-1].tolist())), float(beta[-1]))


def _calibration(raw: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset that make log-odds honest on documents that were not learnt from."""
    x = np.stack([raw, np.ones(len(raw))], axis=1)
    slope, offset = _logistic(x, y, np.ones(len(y)), 1e-2)
    return (float(slope), float(offset)) if slope > 0 else (0.0, float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1))))


#: What a view has been taught by the other: by document the label and the view's features.
Taught = dict[int, tuple[int, np.ndarray]]
#: Finds documents to teach, from both views, what they have been taught, and the share of good ones:
#: (taught view, document, label, features of that view).
Proposer = Callable[[list[View], list[Taught], float], list[tuple[int, int, int, np.ndarray]]]


def cotrain(content: list, metadata: list, y: np.ndarray, aside: np.ndarray, propose: Proposer) -> Model:
    """Both views from labelled features and labels ``y`` (1 is good); rows flagged ``aside`` only calibrate."""
    learnt = np.flatnonzero(~aside)
    held = np.flatnonzero(aside)
    views: list[View] = []
    taught: list[Taught] = [{}, {}]
    labelled = (content, metadata)
    model = Model(prior=float(np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5))))
    for turn in range(COTRAIN_ROUNDS + 1):
        views = []
        for features, pseudo in zip(labelled, taught):
            own = [features[i] for i in learnt] + [more for _, more in pseudo.values()]
            target = np.append(y[learnt], np.array([label for label, _ in pseudo.values()], float))
            view = _fit_view(own, target, np.ones(len(target)))
            view.slope, view.offset = _calibration(view.raw([features[i] for i in held]), y[held])
            views.append(view)
        model.history.append({"round": turn, "taught": [len(t) for t in taught]})
        if turn == COTRAIN_ROUNDS:
            break
        for pupil, doc_id, label, features in propose(views, taught, float(y.mean())):
            taught[pupil].setdefault(doc_id, (label, features))
    model.content, model.metadata = views
    scores = [view.score([features[i] for i in held]) for view, features in zip(views, labelled)]
    model.slope, model.offset = _calibration(model.combine(*scores), y[held])
    return model


def _most_certain(features: DataFrame, known: DataFrame) -> Proposer:
    """Scores all rows of ``features`` (doc_id, content, metadata) that are not ``known``, and takes the best per class and view."""
    spark = features.sparkSession

    def score_both(views: list[View]):
        dense = [np.zeros(HASHED) for _ in views]
        for weights, view in zip(dense, views):
            weights[list(view.weights)] = list(view.weights.values())

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                made = [batch.column("doc_id")]
                for name, weights, view in zip(("content", "metadata"), dense, views):
                    lists = batch.column(name)
                    sums = np.append(0.0, np.cumsum(weights[lists.flatten().to_numpy()]))
                    ends = np.cumsum(np.append(0, lists.value_lengths().to_numpy()))
                    made.append(pa.array(view.slope * (sums[ends[1:]] - sums[ends[:-1]] + view.bias) + view.offset))
                yield pa.RecordBatch.from_arrays(made, names=["doc_id", "content", "metadata"])

        return run

    def propose(views: list[View], taught: list[Taught], share: float) -> list[tuple[int, int, int, np.ndarray]]:
        scores = materialize(map_batches(features, score_both(views), "doc_id long, content double, metadata double"), "scores")
        open_ = scores.join(known.select("doc_id"), "doc_id", "left_anti")
        least, wanted, best = float(np.log(CERTAIN / (1 - CERTAIN))), {}, None
        for pupil, column in ((1, "content"), (0, "metadata")):
            for label in (1, 0):
                certainty = F.col(column) if label else -F.col(column)
                wanted[pupil, label] = int(np.ceil(PER_ROUND * (share if label else 1 - share)))
                sure = open_.filter(certainty >= least).select("doc_id", certainty.alias("certainty"))
                first = sure.orderBy(F.col("certainty").desc(), "doc_id").limit(wanted[pupil, label] + len(taught[pupil]))
                part = first.select("doc_id", "certainty", F.lit(pupil).alias("pupil"), F.lit(label).alias("label"))
                best = part if best is None else best.unionByName(part)
        chosen: dict[tuple[int, int], int] = {}
        for r in sorted(best.collect(), key=lambda r: (-r["certainty"], r["doc_id"])):  # at most what is wanted and has been taught
            new = (r["pupil"], r["doc_id"]) not in chosen and r["doc_id"] not in taught[r["pupil"]]
            if new and wanted[r["pupil"], r["label"]] > 0:
                wanted[r["pupil"], r["label"]] -= 1
                chosen[r["pupil"], r["doc_id"]] = r["label"]
        ids = spark.createDataFrame([(i,) for i in sorted({i for _, i in chosen})], "doc_id long")
        found = features.join(F.broadcast(ids), "doc_id").dropDuplicates(["doc_id"]).toArrow()  # as many rows as chosen
        place = {i: at for at, i in enumerate(found["doc_id"].to_pylist())}
        views_ = ("content", "metadata")
        return [(pupil, i, label, found[views_[pupil]][place[i]].values.to_numpy()) for (pupil, i), label in chosen.items()]

    return propose


def _sampled(ids: DataFrame, at_most: int) -> DataFrame:
    """Ids whose hash is small enough that about ``at_most`` of them remain."""
    n = ids.count()
    even = F.shiftrightunsigned(F.xxhash64("doc_id", F.lit("sample")), 11) / F.lit(float(2**53))
    return ids.filter(even < at_most / max(n, at_most))


def fit(
    docs: DataFrame,
    labels: DataFrame,
    facts: tuple[str, ...] = ("lang", "source"),
    id_col: str = "doc_id",
    text_col: str = "text",
    max_labelled: int = MAX_LABELLED,
) -> Model:
    """Learn from ``labels`` (doc_id, quality, toxic): a document is good if its quality is 1 and it is not toxic.

    Of repeated labels the worst counts; labels with a null, and of unknown documents, do not. At most
    about ``max_labelled`` documents with a label are sampled, by a hash of the id; their features come to the
    driver, and those of the few documents a round picks. All documents without a label take part in
    every round, from a written table of their features; rows with a null id do not, and of rows that repeat an id one is
    learnt from. Without both classes among the sample the model has
    no views and keeps everything. ``facts`` that are no columns of ``docs`` are left out.
    """
    facts = tuple(c for c in facts if c in docs.columns)
    known = labels.filter("doc_id is not null and quality is not null and toxic is not null").groupBy("doc_id").agg(
        F.min("quality").alias("quality"), F.max("toxic").alias("toxic")
    )
    good = known.select("doc_id", ((F.col("quality") == 1) & (F.col("toxic") == 0)).cast("int").alias("good"))
    good = materialize(good, "good")
    texts = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), text_bytes(text_col).alias("text"), *[F.col(c).cast("string").alias(f"fact{i}") for i, c in enumerate(facts)]
    ).filter("doc_id is not null")

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = dict(zip(batch.schema.names, (c.to_pylist() for c in batch.columns)))
            told = list(zip(*(columns[f"fact{i}"] for i in range(len(facts))))) or [()] * len(batch)
            kind = pa.list_(pa.int32())
            content = pa.array([_hashed(content_tokens(t)) for t in columns["text"]], kind)
            metadata = pa.array([_hashed(metadata_tokens(t, f)) for t, f in zip(columns["text"], told)], kind)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), content, metadata], names=["doc_id", "content", "metadata"])

    path = new_path(docs.sparkSession, "features")
    map_batches(texts, made, "doc_id long, content array<int>, metadata array<int>").write.parquet(path)
    features = docs.sparkSession.read.parquet(path)
    chosen = _sampled(good, max_labelled)  # bounded by the limit
    rows = features.join(F.broadcast(chosen), "doc_id").toArrow().sort_by("doc_id")
    content, metadata = ([x.values.to_numpy() for x in rows[c]] for c in ("content", "metadata"))
    y = np.array(rows["good"].to_pylist(), float)
    aside = np.array([crc32(b"aside%d" % i) % 4 == 0 for i in rows["doc_id"].to_pylist()], bool)
    model = Model()
    if all(len(set(part.tolist())) == 2 for part in (y[aside], y[~aside])):
        model = cotrain(content, metadata, y, aside, _most_certain(features, good))
    delete_table(docs.sparkSession, path)
    model.facts = facts
    return model


class _Remembered(dict):
    """Weight of each token that has been met, hashed once."""

    def __init__(self, weights: dict[int, float]) -> None:
        self.weights = weights

    def __missing__(self, token: bytes) -> float:
        if len(self) >= REMEMBERED:
            self.clear()
        weight = self[token] = self.weights.get(crc32(token) % HASHED, 0.0)
        return weight


def score(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """Add ``content_score``, ``metadata_score`` (calibrated log-odds of each view), ``quality`` (probability
    of a good document from both) and ``keep`` (it is at least ``threshold``).

    All rows and other columns stay, repeated rows too; columns of these names are replaced. A null text
    counts as empty, a null fact as a value of its own. With a model without views the scores are null
    and every document is kept.
    """
    new = [("content_score", "double"), ("metadata_score", "double"), ("quality", "double"), ("keep", "boolean")]
    docs = docs.drop(*[name for name, _ in new])
    if model.content is None:
        empty = {name: F.lit(None).cast(kind) for name, kind in new[:3]}
        return docs.withColumns({**empty, "keep": F.lit(True)})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        views = [(v, _Remembered(v.weights)) for v in (model.content, model.metadata)]
        for batch in batches:
            names = batch.schema.names
            told = list(zip(*(map(_as_text, batch.column(names.index(c)).to_pylist()) for c in model.facts))) or [()] * len(batch)
            scores = []
            for text, facts in zip(batch.column(names.index(text_col)).to_pylist(), told):
                text = (text or "").encode()
                found = []
                for (view, weights), tokens in zip(views, (content_tokens(text), metadata_tokens(text, facts))):
                    by_feature = {crc32(t) % HASHED: w for t in tokens if (w := weights[t])}
                    found.append(view.slope * (sum(by_feature.values()) + view.bias) + view.offset)
                scores.append(found)
            content, metadata = np.array(scores).reshape(-1, 2).T
            quality = _sigmoid(model.combine(content, metadata))
            columns = (content, metadata, quality, quality >= threshold)
            yield appended(batch, {name: pa.array(c) for (name, _), c in zip(new, columns)})

    return map_batches(docs, run, with_fields(docs, *new))


def _as_text(value: object) -> str:
    return str(value)
