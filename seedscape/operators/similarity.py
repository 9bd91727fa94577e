"""Similarity of texts and vectors to the seeds."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from seedscape.functions.text import terms
from seedscape.functions.vectors import cosine
from seedscape.operators.totals import attach_totals
from seedscape.scratch import materialize

ROLE = "is_seed"
#: Terms of a task, and the least that are worth one. Bytes of a text for a term.
TASK_TERMS, LEAST_TERMS, TERM_BYTES = 1 << 20, 1 << 14, 7
#: The terms in most texts that go to every task; the others are shuffled.
MOST_COMMON = 1 << 16


def candidates_and_seeds(
    candidates: DataFrame, seeds: DataFrame, by: Sequence[str] = (), text_col: str = "title"
) -> DataFrame:
    """Candidate texts followed by seed texts; an item in both stays twice, told apart by ``is_seed``."""
    return candidates.select(*by, "id", text_col, F.lit(False).alias(ROLE)).unionByName(
        seeds.select(*by, "id", text_col, F.lit(True).alias(ROLE))
    )


def term_counts(texts: DataFrame, keys: Sequence[str] = ("id",), text_col: str = "title") -> DataFrame:
    """``(keys, term, tf)`` of every text."""
    return count_listed(texts, keys, terms(F.col(text_col)), F.octet_length(F.col(text_col)) / TERM_BYTES)


def count_listed(rows: DataFrame, keys: Sequence[str], listed: Column, size: Column | None = None, tasks: int | None = None) -> DataFrame:
    """``(keys, term, tf)`` of an array of terms in every row. ``size`` is about its length, if that is known more cheaply,
    and ``tasks`` the number of tasks, if that is known.

    Texts are dealt out by their keys before they are cut into terms, so all cores share the work
    however few files there are, and the counts need no further shuffle: cutting, spreading and counting
    are one compiled stage. Rows that repeat their keys are counted together.
    """
    tasks = tasks or tasks_for(rows, F.size(listed) if size is None else size)
    dealt = rows.repartition(tasks, *[F.col(k) for k in keys])
    return dealt.select(*keys, F.explode(listed).alias("term")).groupBy(*keys, "term").agg(F.count(F.lit(1)).alias("tf"))


def positions(texts: DataFrame, keys: Sequence[str] = ("id",), text_col: str = "text", out_col: str = "index") -> DataFrame:
    """``(keys, out_col)``: a map from each term of a text to its places in order. Texts without terms drop out.

    Texts are dealt out by their keys, and nothing moves after that.
    """
    dealt = deal(texts, keys, F.octet_length(F.col(text_col)) / TERM_BYTES)
    words = dealt.select(*keys, F.posexplode(terms(F.col(text_col))).alias("_at", "_word"))
    spots = words.groupBy(*keys, "_word").agg(F.sort_array(F.collect_list("_at")).alias("_spots"))
    return spots.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("_word", "_spots"))).alias(out_col))


def deal(rows: DataFrame, keys: Sequence[str], size: Column) -> DataFrame:
    """``rows`` dealt out by ``keys`` to as many tasks as hold ``TASK_TERMS`` each, by the sum of ``size``."""
    return rows.repartition(tasks_for(rows, size), *[F.col(k) for k in keys])


def tasks_for(rows: DataFrame, size: Column) -> int:
    """Tasks for ``rows`` of ``size`` terms each."""
    return n_tasks(rows, int(rows.agg(F.sum(size).alias("n")).first()["n"] or 0))


def n_tasks(rows: DataFrame, total: int) -> int:
    """Tasks for ``total`` terms: all cores if there are enough terms, and never more than ``TASK_TERMS`` in a task."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return max(1, min(cores, -(-total // LEAST_TERMS)), -(-total // TASK_TERMS))


def vocabulary(counts: DataFrame, n_texts: DataFrame, by: Sequence[str] = (), min_df: int = 1) -> DataFrame:
    """``(by, term, df, idf)`` with the smoothed weight ``ln((1 + n) / (1 + df)) + 1``."""
    used = counts.groupBy(*by, "term").agg(F.sum((F.col("tf") > 0).cast("long")).alias("df"))
    common = attach_totals(used.where(F.col("df") >= min_df), n_texts, by, salt_on=["term"])
    idf = F.ln((1.0 + F.col("n_texts")) / (1.0 + F.col("df"))) + 1.0
    return common.select(*by, "term", "df", idf.alias("idf"))


def _weighted(counts: DataFrame, words: DataFrame, by: Sequence[str]) -> list[DataFrame]:
    """``counts`` with the columns of their terms in ``words``, in parts: common terms and others.

    Counts and words are written tables. Most counts are of few terms, and those of the most common ones, a
    bounded table, stay where they are. The others meet their terms in a shuffle, where no term is hot. A session that
    forbids broadcasts gets one plain join, in which the adaptive skew join splits a very common term.
    """
    on = [*by, "term"]
    if counts.sparkSession.conf.get("spark.sql.autoBroadcastJoinThreshold").startswith("-"):
        return [counts.join(words, on)]
    if words.count() <= MOST_COMMON:
        return [counts.join(F.broadcast(words), on)]
    common = materialize(words.orderBy(F.desc("df"), *on).limit(MOST_COMMON), "common")
    others = counts.join(F.broadcast(common.select(*on)), on, "left_anti")
    dealt = others.repartition(n_tasks(counts, counts.count()), *[F.col(c) for c in on])
    return [counts.join(F.broadcast(common), on), dealt.join(words, on)]


def _scaled(counts: DataFrame, words: DataFrame, by: Sequence[str], ids: Sequence[str]) -> DataFrame:
    """TF-IDF weights scaled to length 1; a window over one text never holds more than that text's terms."""
    w = F.col("tf") * F.col("idf")
    parts = [p.select(*ids, "term", w.alias("_w")) for p in _weighted(counts, words.select(*by, "term", "df", "idf"), by)]
    dealt = reduce(DataFrame.unionByName, parts).repartition(n_tasks(counts, counts.count()), *[F.col(c) for c in ids])
    length = F.sqrt(F.sum(F.col("_w") * F.col("_w")).over(W.partitionBy(*ids)))
    return dealt.select(*ids, "term", (F.col("_w") / length).alias("weight"))


def tfidf(
    texts: DataFrame, by: Sequence[str] = (), text_col: str = "title", keys: Sequence[str] = ("id",), min_df: int = 1
) -> DataFrame:
    """Rows ``(by, keys, term, weight)``, each text scaled to length 1. Terms in fewer than ``min_df`` texts are left out."""
    ids = [*by, *keys]
    counts = materialize(term_counts(texts, ids, text_col), "terms")
    n_texts = texts.groupBy(*by).agg(F.count("*").alias("n_texts"))
    words = materialize(vocabulary(counts, n_texts, by, min_df), "vocabulary")
    return _scaled(counts, words, by, ids)


def title_similarity(
    candidates: DataFrame,
    seeds: DataFrame,
    by: Sequence[str] = (),
    text_col: str = "title",
    out_col: str = "title_similarity",
) -> DataFrame:
    """Cosine of each candidate's TF-IDF row with the mean row of the seeds; 0 for an empty text.

    The vocabulary covers candidates and seeds. Every text is read and cut into
    terms once, beside a look at their lengths; the counts are written and serve the vocabulary, the seeds and the
    candidates. The seeds' mean weight travels in the vocabulary row of its term,
    so the candidate terms are joined once and summed once for both the product
    and the length.
    """
    ids = [*by, "id", ROLE]
    texts = candidates_and_seeds(candidates, seeds, by, text_col)
    counts = materialize(term_counts(texts, ids, text_col), "terms")
    n_texts = texts.groupBy(*by).agg(F.count("*").alias("n_texts"))
    words = materialize(vocabulary(counts, n_texts, by), "vocabulary")

    n_seeds = seeds.groupBy(*by).agg(F.count("*").alias("_n_seeds"))
    sums = _scaled(counts.where(ROLE), words, by, ids).groupBy(*by, "term").agg(F.sum("weight").alias("_sum"))
    mean = attach_totals(sums, n_seeds, by, salt_on=["term"]).select(
        *by, "term", (F.col("_sum") / F.col("_n_seeds")).alias("_mean")
    )
    weights = materialize(words.join(mean, [*by, "term"], "left").select(*by, "term", "df", "idf", "_mean"), "weights")
    mean_length = weights.groupBy(*by).agg(F.sqrt(F.sum(F.col("_mean") * F.col("_mean"))).alias("_mean_length"))

    w = F.col("tf") * F.col("idf")
    sums = {"_squares": F.sum(w * w), "_dot": F.sum(w * F.col("_mean"))}
    parts = [
        p.groupBy(*by, "id").agg(*[x.alias(name) for name, x in sums.items()])
        for p in _weighted(counts.where(~F.col(ROLE)), weights, by)
    ]
    scored = (
        reduce(DataFrame.unionByName, parts)
        .groupBy(*by, "id")
        .agg(F.sqrt(F.sum("_squares")).alias("_length"), F.coalesce(F.sum("_dot"), F.lit(0.0)).alias("_dot"))
    )
    similar = attach_totals(scored, mean_length, by, salt_on=["id"]).select(
        *by, "id", F.try_divide("_dot", F.col("_length") * F.col("_mean_length")).alias(out_col)
    )
    joined = candidates.join(similar, [*by, "id"], "left")
    return joined.withColumn(out_col, F.coalesce(out_col, F.lit(0.0)))


def mean_vector(vectors: DataFrame, by: Sequence[str] = (), vector_col: str = "embedding") -> DataFrame:
    """The element-wise mean per run; only as many values meet in one group as a vector has."""
    values = vectors.select(*by, F.posexplode(vector_col).alias("at", "value"))
    means = values.groupBy(*by, "at").agg(F.avg("value").alias("value"))
    ordered = F.array_sort(F.collect_list(F.struct("at", "value")))
    return means.groupBy(*by).agg(F.transform(ordered, lambda s: s["value"]).alias("mean_vector"))


def embedding_similarity(
    candidates: DataFrame,
    seeds: DataFrame,
    embeddings: DataFrame,
    by: Sequence[str] = (),
    out_col: str = "embedding_similarity",
) -> DataFrame:
    """Cosine of each candidate's vector with the seeds' mean vector; null without a vector."""
    mean = mean_vector(seeds.select(*by, "id").join(embeddings, "id"), by)
    known = candidates.select(*by, "id").join(embeddings, "id")
    scored = attach_totals(known, mean, by, salt_on=["id"]).select(
        *by, "id", cosine(F.col("embedding"), F.col("mean_vector")).alias(out_col)
    )
    return candidates.join(scored, [*by, "id"], "left")
