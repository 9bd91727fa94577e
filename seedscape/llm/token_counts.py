"""Exact histogram of encoded lengths, and what its suffix sums answer.

The corpus is reduced to one row per distinct length; every total, quantile and
truncated total, for any context limit, follows from sums over that table alone.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seedscape.llm import bpe
from seedscape.operators.ordering import running_totals


def length_histogram(docs: DataFrame, ranks_path: str, pattern: str, text_col: str = "text") -> DataFrame:
    """One row per distinct encoded length, in tokens: ``n_tokens``, ``n_docs`` and the sums over all
    texts at least as long (``docs_from``, ``tokens_from``) and over all (``docs_total``, ``tokens_total``).

    Null and empty texts have length 0, repeated rows count each; no documents give no rows.
    """
    counted = bpe.encode(docs.select(F.col(text_col).alias("text")), ranks_path, pattern, out_col="n_tokens", count=True)
    lengths = counted.groupBy("n_tokens").agg(F.count(F.lit(1)).alias("n_docs"))
    sums = {"docs_from": F.col("n_docs"), "tokens_from": F.col("n_docs") * F.col("n_tokens")}
    placed = running_totals(lengths, [F.col("n_tokens").desc()], sums)
    return placed.select(
        "n_tokens",
        "n_docs",
        "docs_from",
        "tokens_from",
        F.col("docs_from_total").alias("docs_total"),
        F.col("tokens_from_total").alias("tokens_total"),
    )


def with_limits(histogram: DataFrame) -> DataFrame:
    """Take each length as a context limit: tokens left after truncating there (``kept_tokens``) and lost
    (``cut_tokens``), texts that are cut (``cut_docs``), and ``quantile``, the share of texts up to it."""
    below = F.col("tokens_total") - F.col("tokens_from")
    kept = below + F.col("n_tokens") * F.col("docs_from")
    longer = F.col("docs_from") - F.col("n_docs")
    return histogram.withColumns(
        {
            "kept_tokens": kept,
            "cut_tokens": F.col("tokens_total") - kept,
            "cut_docs": longer,
            "quantile": (F.col("docs_total") - longer) / F.col("docs_total"),
        }
    )


def totals_at(histogram: DataFrame, limits: Sequence[int]) -> DataFrame:
    """The same answers for stated limits, which need not be lengths in the table."""
    asked = histogram.sparkSession.createDataFrame([(int(x),) for x in limits], "context_limit long")
    reach = F.col("n_tokens") >= F.col("context_limit")
    beyond = F.col("n_tokens") > F.col("context_limit")
    zero = F.lit(0).cast("long")
    sums = histogram.join(F.broadcast(asked)).groupBy("context_limit").agg(
        F.coalesce(F.sum(F.when(reach, F.col("n_docs"))), zero).alias("docs_from"),
        F.coalesce(F.sum(F.when(beyond, F.col("n_docs"))), zero).alias("cut_docs"),
        F.coalesce(F.sum(F.when(~reach, F.col("n_docs") * F.col("n_tokens"))), zero).alias("below"),
    )
    return sums.select(
        "context_limit", "cut_docs", (F.col("below") + F.col("context_limit") * F.col("docs_from")).alias("kept_tokens")
    )


def quantiles(histogram: DataFrame, shares: Sequence[float]) -> DataFrame:
    """The smallest length that at least a given share of the texts does not exceed."""
    asked = histogram.sparkSession.createDataFrame([(float(x),) for x in shares], "share double")
    reached = F.col("docs_total") - F.col("docs_from") + F.col("n_docs") >= F.col("share") * F.col("docs_total")
    return histogram.join(F.broadcast(asked), reached).groupBy("share").agg(F.min("n_tokens").alias("n_tokens"))
