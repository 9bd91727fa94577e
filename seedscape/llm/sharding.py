"""Shards of near equal size, by sampled splitters.

Records are ordered by a hash of their text. A sample of the keys, drawn in proportion
to size, gives quantile boundaries that cut this order into ranges of about equal size;
a range that comes out too large all the same (one text may hold a third of the corpus)
is subdivided. Each range is then summed up alone, and the shards are cut from the
order at exact fractions of the total size.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from seedscape.scratch import materialize

#: Expected sample keys per range, and the least ranges per shard.
SAMPLES_PER_RANGE, RANGES_PER_SHARD = 64, 4
#: A range of more than this many times its share is subdivided.
OVERFULL = 2
#: Equal texts stay in one shard if together they are at most this part of a shard.
KEPT_TOGETHER = 1 / 128


def text_size(text: str = "text") -> Column:
    """UTF-8 bytes of the text (none if null) plus 1."""
    return F.coalesce(F.octet_length(F.col(text)), F.lit(0)).cast("long") + 1


def splitters(keyed: DataFrame, n_ranges: int, total: int) -> list[int]:
    """At most ``n_ranges - 1`` increasing keys: quantiles of a sample weighted by size."""
    share = F.least(F.lit(1.0), F.col("size") * (SAMPLES_PER_RANGE * n_ranges / max(total, 1)))
    even = F.shiftrightunsigned(F.xxhash64("key", "doc_id", "size"), 11) / F.lit(float(2**53))
    cuts = [i / n_ranges for i in range(1, n_ranges)]
    picked = keyed.filter(even < share).agg(F.percentile_approx("key", cuts, 100 * n_ranges)).first()[0]
    return sorted(set(picked or []))


def range_number(key: Column, bounds: Sequence[int]) -> Column:
    """How many bounds are not above ``key``, by binary search."""
    if not bounds:
        return F.lit(0)
    steps = [1 << i for i in reversed(range(len(bounds).bit_length()))]
    held = F.array(*[F.lit(b) for b in bounds])
    step_up = lambda at, step: F.when(F.get(held, at + step - 1) <= key, at + step).otherwise(at)
    return F.aggregate(F.array(*[F.lit(s) for s in steps]), F.lit(0), step_up)


def assign_shards(docs: DataFrame, n_shards: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Put every row into a shard from 0 to ``n_shards - 1``: (doc_id, size, text_crc32, law, shard, slot, grown_shard).

    The law is ``bytes``: shards are equal in size up to one record, or up to half of 1/128 of a
    shard where equal texts are kept together. Larger groups of equal texts are split, or no
    shard could be near its share. ``slot`` counts from 0 in a shard, without gaps. Sizes of
    null and empty texts are 1, the checksum of a null text is null. Null and repeated ids and
    repeated rows are records like any other; no rows give no rows. Other columns take no part.
    """
    spark = docs.sparkSession
    text = F.col(text_col)
    keyed = materialize(
        docs.select(
            F.col(id_col).alias("doc_id"),
            text_size(text_col).alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            F.xxhash64(text).alias("key"),
        ),
        "keys",
    )
    n_rows, total = keyed.agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0))).first()
    n_ranges = max(RANGES_PER_SHARD * n_shards, int(spark.conf.get("spark.sql.shuffle.partitions")))
    bounds = splitters(keyed, n_ranges, total)
    ranged = keyed.withColumn("range", range_number(F.col("key"), bounds))

    # pieces of a range follow each other in the order; there are at most 2 * n_ranges of them
    loads = ranged.groupBy("range").agg(F.sum("size").alias("load"))
    pieces = F.when(F.col("load") > OVERFULL * total / n_ranges, F.ceil(F.col("load") * n_ranges / total)).otherwise(1)
    pieces = materialize(loads.select("range", pieces.cast("int").alias("pieces")), "pieces")
    piece = F.pmod(F.xxhash64("doc_id", "size"), F.col("pieces")).cast("int")
    dealt = ranged.join(F.broadcast(pieces), "range").withColumn("piece", piece)

    sums = dealt.groupBy("range", "piece").agg(F.sum("size").alias("load"), F.count(F.lit(1)).alias("rows"))
    before = W.orderBy("range", "piece").rowsBetween(W.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    offsets = sums.select(
        "range",
        "piece",
        F.coalesce(F.sum("load").over(before), zero).alias("bytes_before"),
        F.coalesce(F.sum("rows").over(before), zero).alias("rows_before"),
    )
    here = W.partitionBy("range", "piece")
    along = here.orderBy("key", "doc_id", "size", "text_crc32").rowsBetween(W.unboundedPreceding, W.currentRow)
    equal = W.partitionBy("range", "piece", "key")
    placed = (
        dealt.repartition("range", "piece")
        .withColumn("behind", F.sum("size").over(along))
        .withColumn("nth", F.row_number().over(here.orderBy("key", "doc_id", "size", "text_crc32")).cast("long"))
        .withColumn("group_size", F.sum("size").over(equal))
        .withColumn("group_behind", F.max("behind").over(equal))
        .join(F.broadcast(offsets), ["range", "piece"])
    )
    own = F.col("bytes_before") + F.col("behind") - F.col("size")
    middle = F.col("bytes_before") + F.col("group_behind") - F.shiftright("group_size", 1)
    together = (F.col("pieces") == 1) & (F.col("group_size") <= F.lit(total * KEPT_TOGETHER / n_shards))
    at = F.when(together, middle).otherwise(own)
    shard = F.least(F.lit(n_shards - 1), F.floor(at * n_shards / F.lit(max(total, 1)))).cast("int")
    cut = materialize(
        placed.select("doc_id", "size", "text_crc32", shard.alias("shard"), (F.col("rows_before") + F.col("nth") - 1).alias("nth")),
        "shards",
    )
    firsts = cut.groupBy("shard").agg(F.min("nth").alias("first"))  # one row per shard
    return cut.join(F.broadcast(firsts), "shard").select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("nth") - F.col("first")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


def write_shards(docs: DataFrame, assigned: DataFrame, path: str, id_col: str = "doc_id") -> None:
    """Write whole rows below ``path``, one folder per shard. Ids must be unique."""
    placed = docs.join(assigned.select(F.col("doc_id").alias(id_col), "shard", "slot"), id_col)
    placed.repartition("shard", F.shiftright("slot", 16)).write.partitionBy("shard").parquet(path)
