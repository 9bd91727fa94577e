"""Mix sources to target weights: quotas of blocks, dealt to shards by a multivariate-hypergeometric splitting tree.

The rows of a source are put in a repeatable random order and cut into blocks of about equal size.
A source's target is a quota of block draws: every whole epoch draws each block once, the rest are the
first blocks of the order. A binary tree over the output shards splits the quotas of all sources
exactly: a node draws how many of each source's blocks go to its left half, as many in all as that
half has room for, by the multivariate hypergeometric law. Shards then own disjoint runs of the
draws, and are shuffled by themselves.

Rows of more than 1/``FINE`` of their source are blocks of their own, and their quota is filled first, so that
what they miss or exceed is made up by the blocks of smaller rows.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seedscape.operators.ordering import running_totals
from seedscape.operators.skew import lookup_join
from seedscape.scratch import materialize

#: Blocks of a source, unless they would be larger than ``BLOCK_WORDS``; and a bound on the blocks of all sources.
FINE, BLOCK_WORDS, MAX_BLOCKS = 4096, 1 << 16, 500_000_000
#: Quotas that one task splits; more are dealt into buckets, whose totals are split first.
QUOTAS = 8192


def word_count(text: str = "text") -> Column:
    """Number of runs of anything but blanks, tabs and line ends; 0 for null."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: Sequence[int] = (5, 2, 1), share: float = 1.5, cap: int = 2) -> DataFrame:
    """Every row of ``sizes`` (of, is_null, source_size), one per source, with its ``target``.

    Sources in order, null last, take the weights in turn. They share ``share`` times all sizes by weight; a target
    stops at ``cap`` times the source's size, and what is left over is shared by the others, until none is above.
    """
    ordered = running_totals(sizes, [F.col("is_null"), F.col("of")])
    turn = F.pmod(F.col("rank") - 1, F.lit(len(weights))).cast("int")
    weighed = ordered.withColumn("weight", F.get(F.array(*[F.lit(int(w)) for w in weights]), turn).cast("long"))
    most = weighed.withColumn("most", F.col("source_size") * cap).drop("rank", "n_rows")
    # in the order in which rising levels fill them, a source is full if its own level is within the budget
    filled = running_totals(
        most.withColumn("level", F.col("most") / F.col("weight")),
        [F.col("level"), F.col("of")],
        {"full": F.col("most"), "heavy": F.col("weight"), "all": F.col("source_size")},
    )
    budget = F.col("all_total") * F.lit(float(share))
    filled = filled.withColumn("budget", budget).withColumn(
        "is_full", F.col("full") + F.col("level") * (F.col("heavy_total") - F.col("heavy")) <= F.col("budget")
    )
    filled = materialize(filled, "levels")
    open_ = filled.agg(
        F.max("budget"), F.sum(F.when(F.col("is_full"), F.col("most"))), F.sum(F.when(~F.col("is_full"), F.col("weight")))
    ).first()
    level = (open_[0] - (open_[1] or 0)) / open_[2] if open_[2] else 0.0
    target = F.when(F.col("is_full"), F.col("most").cast("double")).otherwise(F.col("weight") * F.lit(level))
    return filled.select("of", "source_size", target.alias("target"))


def split_tree(draws: np.ndarray, room: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Rows of ``draws`` split over the shards with this ``room``; rows and columns of the result add up to both."""
    if len(room) == 1:
        return draws[:, None]
    half = len(room) // 2
    left = rng.multivariate_hypergeometric(draws, int(room[:half].sum()), method="marginals")
    return np.hstack([split_tree(left, room[:half], rng), split_tree(draws - left, room[half:], rng)])


def _split_bucket(seed: int):
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("name")
        draws, room = table["draws"].to_numpy(), np.array(table["room"][0].as_py(), np.int64)
        counts = split_tree(draws, room, np.random.default_rng([seed, table["bucket"][0].as_py()]))
        return pa.table({"name": table["name"], "counts": pa.array(list(counts), pa.list_(pa.int64()))})

    return run


def split_quotas(quotas: DataFrame, room: Sequence[int] | None, seed: int) -> DataFrame:
    """(name, counts): how many of the ``draws`` of each ``name`` go to each shard; every shard gets its ``room``."""
    n = quotas.count()
    if n <= QUOTAS:
        dealt = quotas.select("name", "draws", F.lit(0).alias("bucket"), F.array(*[F.lit(int(r)) for r in room]).cast("array<long>").alias("room"))
    else:
        buckets = quotas.withColumn("bucket", F.pmod(F.xxhash64("name"), F.lit(-(-2 * n // QUOTAS))).cast("int"))
        totals = buckets.groupBy(F.col("bucket").cast("string").alias("name")).agg(F.sum("draws").alias("draws"))
        share = split_quotas(materialize(totals, "buckets"), room, seed + 1)
        dealt = buckets.join(share.select(F.col("name").cast("int").alias("bucket"), F.col("counts").alias("room")), "bucket")
    return materialize(dealt.groupBy("bucket").applyInArrow(_split_bucket(seed), "name string, counts array<long>"), "splits")


def assign(
    docs: DataFrame,
    size: Column,
    source_col: str = "source",
    id_col: str = "doc_id",
    keep: Sequence[str] | None = None,
    weights: Sequence[int] = (5, 2, 1),
    share: float = 1.5,
    cap: int = 2,
    n_shards: int = 8,
    seed: int = 11,
) -> DataFrame:
    """The ``keep`` columns (default: all) of every row with ``size``, ``source_size``, the ``target`` of its source, and
    ``shards``: the output shard of each copy that the mix takes, none if it takes none.

    Rows are whole: a source's words miss its target by about half of one of its smaller rows, or where it has few rows
    by half a row at most, and no row is taken more than ``cap`` times. The order is by the MD5 of ``seed:id``,
    then by the kept columns' hash, so reruns agree; equal rows may stand for each other. A null source is a source; null and
    repeated ids are rows like any other. Rows of size 0 add nothing to either side. No rows give no rows. ``size`` is
    taken where the rows are, so very long texts travel only if they are kept. Added columns replace kept ones of their names.
    """
    keep = list(docs.columns if keep is None else keep)
    sized = materialize(
        docs.select(
            F.struct(*[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)], F.lit(0).alias("none")).alias("row"),
            F.coalesce(F.concat(F.lit("="), F.col(source_col).cast("string")), F.lit("")).alias("of"),
            size.cast("long").alias("size"),
            F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("")))).alias("key"),
        ).withColumn("tie", F.xxhash64("row", "size")),
        "sized",
    )
    sizes = sized.groupBy("of", (F.col("of") == "").alias("is_null")).agg(F.sum("size").alias("source_size"))
    sources = materialize(targets(sizes, weights, share, cap), "targets")
    with_source = lookup_join(sized, sources, ["of"], "inner").withColumn("long", F.col("size") * FINE > F.col("source_size"))
    placed = running_totals(with_source, [F.col("key"), F.col("tie")], {"words": F.col("size")}, by=["of", "long"])
    placed = materialize(placed.withColumn("middle", 2 * F.col("words") - F.col("size")), "placed")

    # the rows that are blocks of their own: whole epochs, then those whose middle lies before the rest
    epochs = F.floor(F.col("target") / F.col("source_size"))
    part = F.col("target") / F.col("source_size") - epochs
    first = F.col("middle") < 2 * part * F.col("words_total")
    longs = placed.filter("long").groupBy("of").agg(
        F.count(F.lit(1)).alias("blocks"),
        F.sum(first.cast("long")).alias("rest"),
        F.first(epochs).alias("epochs"),
        F.sum(F.col("size") * (epochs + first.cast("long"))).alias("taken"),
    )
    shorts = placed.filter("not long").groupBy("of").agg(F.first("words_total").alias("words"))
    total = sources.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]
    width = F.greatest(F.lit(-(-total // MAX_BLOCKS)), F.least(F.lit(BLOCK_WORDS), F.ceil(F.col("source_size") / FINE)), F.lit(1)).cast("long")
    wanted = shorts.join(sources, "of").join(longs.select("of", "taken"), "of", "left").filter("words > 0")
    wanted = wanted.withColumn("times", (F.col("target") - F.coalesce("taken", F.lit(0))) / F.col("words"))
    wanted = wanted.withColumn("times", F.least(F.lit(float(cap)), F.greatest(F.lit(0.0), "times"))).withColumn("width", width)
    whole = F.floor("times")
    runs = wanted.select(
        "of",
        F.lit(False).alias("long"),
        F.ceil(F.col("words") / F.col("width")).alias("blocks"),
        F.round((F.col("times") - whole) * F.col("words") / F.col("width")).cast("long").alias("rest"),
        whole.alias("epochs"),
        "width",
    )
    own = longs.select("of", F.lit(True).alias("long"), "blocks", "rest", "epochs", F.lit(1).cast("long").alias("width"))
    strata = own.unionByName(runs).withColumn("draws", F.col("epochs") * F.col("blocks") + F.col("rest"))
    strata = materialize(strata.withColumn("name", F.concat(F.when(F.col("long"), "1").otherwise("0"), "of")), "quotas")

    n_draws = strata.agg(F.coalesce(F.sum("draws"), F.lit(0))).first()[0]
    room = [n_draws * (k + 1) // n_shards - n_draws * k // n_shards for k in range(n_shards)]
    split = split_quotas(strata.select("name", "draws"), room, seed)
    run_end = lambda c, i: F.aggregate(F.slice("counts", 1, i + 1), F.lit(0).cast("long"), lambda s, x: s + x)
    dealt = strata.join(split, "name").select("of", "long", "blocks", "draws", "width", F.transform("counts", run_end).alias("ends"))
    drawn = lookup_join(placed, materialize(dealt, "dealt"), ["of", "long"], "left")
    block = F.when(F.col("long"), F.col("rank") - 1).otherwise(F.expr("middle div (2 * width)"))
    # the copies of a block are the draws block, block + blocks, ...; shards own runs of the draws
    copies = F.coalesce(F.ceil((F.col("draws") - block) / F.col("blocks")), F.lit(0)).cast("int")
    at = F.transform(F.sequence(F.lit(0), copies - 1), lambda i: block + i * F.col("blocks"))
    shard = lambda draw: F.size(F.filter("ends", lambda end: end <= draw))
    made = drawn.withColumn("shards", F.when(copies > 0, F.transform(at, shard)).otherwise(F.array().cast("array<int>")))
    added = ["size", "source_size", "target", "shards"]
    return made.select(*[F.col(f"row.k{i}").alias(c) for i, c in enumerate(keep) if c not in added], *added)


def mixed(assigned: DataFrame, id_col: str = "doc_id", seed: int = 11) -> DataFrame:
    """One row per copy that the mix takes, with its ``shard`` and the random ``place`` that orders it there."""
    kept = [c for c in assigned.columns if c not in ("shards", "shard", "copy", "place")]
    rows = assigned.select(*kept, F.posexplode("shards").alias("copy", "shard"))
    return rows.withColumn("place", F.xxhash64(F.lit(seed), id_col, "copy", *kept))


def write_mix(assigned: DataFrame, path: str, id_col: str = "doc_id", seed: int = 11) -> None:
    """Write the mix below ``path``, one folder per shard, in files that are shuffled and follow each other by name."""
    rows = mixed(assigned, id_col, seed).repartitionByRange("shard", "place").sortWithinPartitions("shard", "place")
    rows.write.partitionBy("shard").parquet(path)
