"""Exact join of texts by the similarity of their sets of word shingles.

Prefix filter: the hashes of a set are put in one order that holds for all sets. Sets of n
shingles that are ``t`` alike (Jaccard) or more share at least one of the first
``n - ceil(t n) + 1``, so only sets that meet in a prefix are candidates, and none is missed.
The order decides how many candidates there are, never which pairs are linked: shingles in
many prefixes come last. Candidates are counted on the prefixes and then verified on the whole sets.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from math import ceil

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seedscape.llm.common import map_batches, with_fields
from seedscape.llm.components import connected_components
from seedscape.scratch import materialize

#: Leading bits of a hash that name its place in a bitmap; equal places only make more candidates.
PLACE_BITS = 26
#: Prefixes with a shingle beyond which it comes last in the order.
COMMON = 10


def prefix_of(hashed: np.ndarray, similarity: Fraction, common: np.ndarray | None = None) -> np.ndarray:
    """The hashes of a sorted set of which similar sets share at least one."""
    if common is not None:
        last = _marked(common, hashed)
        hashed = np.concatenate([hashed[~last], hashed[last]])
    return hashed[: len(hashed) - ceil(similarity * len(hashed)) + 1]


def name_of(hashed: np.ndarray) -> int:
    """Sets are told apart by 64 bits."""
    return xxhash.xxh64_intdigest(hashed.tobytes())


def _bitmap(hashes: DataFrame, column: str):
    """Broadcast bits of the places of the hashes in ``column``; its size does not depend on their number."""
    place = F.shiftrightunsigned(column, 64 - PLACE_BITS)
    word, bit = F.shiftright(place, 6).cast("int"), F.expr("shiftleft(1L, cast(place & 63 as int))")
    found = hashes.select(place.alias("place"), word.alias("word")).groupBy("word").agg(F.bit_or(bit).alias("bits")).toArrow()
    table = np.zeros(1 << (PLACE_BITS - 6), np.uint64)
    table[found["word"].to_numpy()] = found["bits"].to_numpy().astype(np.int64).view(np.uint64)
    return hashes.sparkSession.sparkContext.broadcast(table)


def _marked(table: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    place = hashes >> np.uint64(64 - PLACE_BITS)
    return (table[place >> np.uint64(6)] >> (place & np.uint64(63)) & np.uint64(1)).astype(bool)


def _prefixes(source: DataFrame, set_of, similarity: Fraction, common=None) -> DataFrame:
    """Every row with (node, n, prefix) in the place of its text: the name and size of its set, and the prefix in order."""
    given = source.columns[:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = common.value if common else None
        for batch in batches:
            sets = [set_of(text) for text in batch.columns[-1].to_pylist()]
            made = [prefix_of(s, similarity, table) for s in sets]
            names = np.array([name_of(s) for s in sets], np.uint64).view(np.int64)
            ends = np.cumsum([0, *map(len, made)]).astype(np.int32)
            values = np.concatenate([np.zeros(0, np.uint64), *made]).view(np.int64)
            columns = [*batch.columns[:-1], pa.array(names), pa.array(np.array([len(s) for s in sets], np.int64))]
            columns.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(values)))
            yield pa.RecordBatch.from_arrays(columns, names=[*given, "node", "n", "prefix"])

    fields = with_fields(source, ("node", "long"), ("n", "long"), ("prefix", "array<long>"))
    return map_batches(source, run, T.StructType([fields[c] for c in (*given, "node", "n", "prefix")]))


def _sets(source: DataFrame, set_of, needed) -> DataFrame:
    """(node, hashes as bytes) of the sets whose places are ``needed``, each once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [set_of(text) for text in batch.columns[-1].to_pylist()]
            names = np.array([name_of(s) for s in sets], np.uint64)
            chosen = np.flatnonzero(_marked(needed.value, names))
            packed = pa.array([sets[i].tobytes() for i in chosen], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(names[chosen].view(np.int64)), packed], names=["node", "hashes"])

    return map_batches(source, run, "node long, hashes binary").groupBy("node").agg(F.first("hashes").alias("hashes"))


def _alike(similarity: Fraction):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            alike = []
            for one, other in zip(batch.column(2), batch.column(3)):
                x, y = (np.frombuffer(v.as_buffer(), "<u8") for v in (one, other))
                both = len(np.intersect1d(x, y, assume_unique=True))
                alike.append(both >= similarity * (len(x) + len(y) - both))
            chosen = pa.array(np.flatnonzero(alike))
            yield pa.RecordBatch.from_arrays([batch.column(i).take(chosen) for i in (0, 1)], names=["a", "b"])

    return run


def _verified(pairs: DataFrame, source: DataFrame, set_of, similarity: Fraction) -> DataFrame:
    """The (a, b) of ``pairs`` whose whole sets are alike."""
    needed = _bitmap(pairs.select(F.explode(F.array("a", "b")).alias("node")), "node")
    sets = materialize(_sets(source, set_of, needed), "sets")
    side = lambda name: sets.select(F.col("node").alias(name), F.col("hashes").alias(f"of_{name}"))
    whole = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "of_a", "of_b")
    return materialize(map_batches(whole, _alike(similarity), "a long, b long"), "links")


def _possible(met: DataFrame, similarity: Fraction) -> DataFrame:
    """The pairs (a, b) of rows that met in a shingle, without those that cannot be alike.

    The common shingles up to the last one in both prefixes have been counted, and those behind it are
    no more than either set has left. Besides, the prefix that ends first has no others.
    """
    p, q = similarity.numerator, similarity.denominator
    pairs = met.groupBy("a", "b").agg(F.count(F.lit(1)).alias("c"), *[F.max(x).alias(x) for x in ("na", "nb", "at_a", "at_b")])
    behind = F.least(F.col("na") - F.col("at_a"), F.col("nb") - F.col("at_b")) - 1
    # the shingles behind a prefix of n are ceil(t n) - 1
    rest = lambda n: F.expr(f"({n} * {p} + {q - 1}) div {q} - 1")
    most = F.col("c") + F.least(behind, F.greatest(rest("na"), rest("nb")))
    return pairs.filter(most * (p + q) >= (F.col("na") + F.col("nb")) * p).select("a", "b")


def similar_sets(source: DataFrame, set_of, similarity: float) -> tuple[DataFrame, DataFrame]:
    """Every row of ``source`` with its node in the place of the last column, the text, and (node, root) of the nodes
    linked with others.

    A node is a set, as ``set_of`` makes it of a text: sorted hashes, each once. Nodes are linked if their
    Jaccard similarity is ``similarity`` or more. All such pairs are found, except that a pair already known to
    be connected by others is left out: nodes that meet are first compared with the least and the greatest of
    them, then every pair that is still in different components.
    """
    t = Fraction(str(similarity))
    p, q = t.numerator, t.denominator
    seen = _prefixes(source, set_of, t).select(F.explode("prefix").alias("token"))
    common = _bitmap(seen.groupBy("token").agg(F.count(F.lit(1)).alias("times")).filter(F.col("times") > COMMON), "token")
    prints = materialize(_prefixes(source, set_of, t, common), "prints")
    rows = prints.select("node", "n", F.posexplode("prefix").alias("at", "token"))
    cells = rows.groupBy("token").agg(F.min("node").alias("least"), F.max("node").alias("most")).filter("least <> most")
    members = materialize(rows.join(materialize(cells, "cells"), "token").distinct(), "members")
    near = lambda a, b: (F.col(a) * q >= F.col(b) * p) & (F.col(b) * q >= F.col(a) * p)
    side = lambda frame, name, *more: frame.select("token", *more, F.col("node").alias(name), F.col("n").alias(f"n{name}"), F.col("at").alias(f"at_{name}"))

    # a hub is compared with all that meet it
    hub = lambda end: side(members.filter(F.col("node") == F.col(end)), "a").join(side(members, "b"), "token")
    stars = [_possible(hub(end).filter((F.col("a") != F.col("b")) & near("na", "nb")), t) for end in ("least", "most")]
    ordered = lambda pairs: pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    tested = materialize(ordered(stars[0].unionByName(stars[1])).distinct(), "pairs")
    links = _verified(tested, source, set_of, t)
    roots = connected_components(links)

    rooted = materialize(members.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")), "rooted")
    open_ = rooted.groupBy("token").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low <> high")
    left = materialize(rooted.join(open_.select("token"), "token").select("token", "node", "n", "at", "root"), "open")
    met = side(left, "a", F.col("root").alias("of")).join(side(left, "b", "root"), "token")
    met = met.filter((F.col("a") < F.col("b")) & (F.col("of") != F.col("root")) & near("na", "nb"))
    rest = materialize(_possible(met, t).join(tested, ["a", "b"], "left_anti"), "pairs")
    more = _verified(rest, source, set_of, t)
    return prints.drop("n", "prefix"), connected_components(links.unionByName(more))
