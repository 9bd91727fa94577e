"""Near copies by the similarity of their sets of word shingles, found through SimHash.

Every different set gets a wide SimHash fingerprint. The Gray-ordered index deals fingerprints out by masked bit
patterns and links those within a radius that hardly any similar pair exceeds. This gives clusters, each of
which holds all the true links of its members; most documents are in none. Sets are then made
once more for the members alone and meet in their clusters, where the same index goes through the pairs within the radius, nearest
first, and only compares what is not known to be connected yet. A link counts if the sets
themselves have the similarity. Only links that connect something new are returned, so
a group of copies gives as many rows as it has members.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from math import acos, comb, log, log2, pi, sqrt

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seedscape.llm.common import map_batches
from seedscape.llm.components import connected_components
from seedscape.llm.simhash import SEED, GrayIndex, _find_links, _source, word_slices
from seedscape.scratch import materialize

#: 64-bit words of a fingerprint, and the levels of its index.
WORDS, LEVELS = 4, tuple(range(32, 257, 32))
#: Standard errors by which pairs at the similarity may exceed their mean distance; chance that no mask covers such a pair.
SPREAD, MISSED = 4.0, 0.0005
#: Mean fingerprints under one masked pattern, and those beyond which a pattern is cut into blocks that meet in pairs.
MEAN_GROUP, PATTERN_BLOCK = 64, 16_384
#: Sets of a block of a cluster: ten times the root of the cluster's size, within these bounds.
LEAST_BLOCK, MOST_BLOCK = 512, 4096
#: Shingles whose bits are counted at once; words whose hashes a process remembers.
COUNTED, REMEMBERED = 1 << 15, 100_000

_CODE = [f"w{i}" for i in range(WORDS)]


class _WordHashes(dict):
    """Hash of each word that has been met."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        made = self[word] = xxhash.xxh64_intdigest(word, SEED)
        return made


def _mixed(x: np.ndarray) -> np.ndarray:
    """The SplitMix64 finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: bytes, size: int, words: dict[bytes, int]) -> np.ndarray:
    """Sorted 64-bit hashes of the different shingles of ``size`` words, lower case in A-Z; of the whole text if it
    has fewer words, none without words. Each is put together from the hashes of its words, in order."""
    slices = [np.fromiter(map(words.__getitem__, listed), np.uint64, len(listed)) for listed in word_slices(text)]
    numbers = np.concatenate([*slices, np.zeros(0, np.uint64)])
    if not len(numbers):
        return numbers
    size = min(size, len(numbers))
    n = len(numbers) - size + 1
    made = np.full(n, size, np.uint64)
    for i in range(size):
        made = _mixed(made * np.uint64(0x9E3779B97F4A7C15) + numbers[i : i + n])
    return np.unique(made)


def name_of(hashed: np.ndarray) -> int:
    """Sets are told apart by 64 bits."""
    return xxhash.xxh64_intdigest(hashed.tobytes())


def wide_fingerprint(hashed: np.ndarray) -> np.ndarray:
    """SimHash of ``WORDS`` words over a set of hashes; ties fall to each side in turn, an empty set gives zeros."""
    if not len(hashed):
        return np.zeros(WORDS, np.uint64)
    ones = np.arange(64 * WORDS) % 2  # a tie sets every other bit
    for at in range(0, len(hashed), COUNTED):
        part = hashed[at : at + COUNTED, None] + np.arange(1, WORDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        bits = np.unpackbits(np.ascontiguousarray(_mixed(part)).view(np.uint8), axis=1, bitorder="little")
        ones = ones + 2 * bits.sum(axis=0, dtype=np.uint16).astype(np.int64)
    return np.packbits(ones > len(hashed), bitorder="little").view("<u8")


def angle(similarity: float) -> float:
    """Share of the bits in which sets of equal size and this similarity differ."""
    return acos(2 * similarity / (1 + similarity)) / pi


def radius(similarity: float) -> int:
    """Differing bits up to which pairs are looked at: the mean at ``similarity`` and ``SPREAD`` standard errors."""
    share, bits = angle(similarity), 64 * WORDS
    return round(bits * share + SPREAD * sqrt(bits * share * (1 - share)))


def missed(n_bits: int, n_masks: int, similarity: float) -> float:
    """Chance that no mask of ``n_bits`` covers equal bits only, for a pair at ``similarity``."""
    bits, share = 64 * WORDS, angle(similarity)
    total = 0.0
    for differing in range(radius(similarity) + 1):
        chance = comb(bits, differing) * share**differing * (1 - share) ** (bits - differing)
        covered = comb(bits - differing, n_bits) / comb(bits, n_bits)
        total += chance * (1 - covered) ** n_masks
    return total


def random_masks(n: int, similarity: float) -> list[list[int]]:
    """Masks, as words: of as many bits as leave few unlike fingerprints together, and as many as ``MISSED`` asks for."""
    n_bits = max(6, round(log2(max(n, 1) / MEAN_GROUP)))
    n_masks = 1
    while missed(n_bits, n_masks, similarity) > MISSED:
        n_masks += 1 + n_masks // 50
    rng = np.random.default_rng(SEED)
    made = []
    for _ in range(n_masks):
        chosen = np.zeros(64 * WORDS, np.uint8)
        chosen[rng.choice(64 * WORDS, n_bits, replace=False)] = 1
        made.append(np.packbits(chosen, bitorder="little").view("<i8").tolist())
    return made


def _prints(source: DataFrame, size: int) -> DataFrame:
    """(doc_id, text_key, node, w0, ...) of every row: the name of its set and the fingerprint."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _WordHashes()
        for batch in batches:
            sets = [shingle_set(text, size, words) for text in batch.column(2).to_pylist()]
            names = np.array([name_of(s) for s in sets], np.uint64).view(np.int64)
            codes = np.array([wide_fingerprint(s) for s in sets], np.uint64).reshape(-1, WORDS).view(np.int64)
            columns = [batch.column(0), batch.column(1), pa.array(names), *map(pa.array, np.ascontiguousarray(codes.T))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "text_key", "node", *_CODE])

    schema = "doc_id long, text_key string, node long, " + ", ".join(f"{c} long" for c in _CODE)
    return materialize(map_batches(source, run, schema), "prints")


def _cells(members: DataFrame, key: str, large: DataFrame) -> DataFrame:
    """Members with the cell (key, i, j) they meet in; those of ``large`` keys (key, blocks) are in several."""
    placed = members.join(large, key, "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    placed = placed.withColumn("own", F.pmod(F.xxhash64("node"), "blocks").cast("int"))
    met = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks").cast("int") - 1)))
    return met.withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other")).drop("blocks", "other")


def clusters(nodes: DataFrame, similarity: float) -> DataFrame:
    """(node, cluster) of the nodes that the index links with others within the radius."""
    chosen = random_masks(nodes.count(), similarity)
    masks = F.array(*[F.array(*[F.lit(w) for w in mask]) for mask in chosen])
    keyed = nodes.select("node", *_CODE, F.posexplode(masks).alias("mask", "bits"))
    pattern = F.xxhash64("mask", *[F.col(c).bitwiseAND(F.col("bits")[i]) for i, c in enumerate(_CODE)])
    keyed = keyed.select(pattern.alias("pattern"), "node", *_CODE)
    counts = keyed.groupBy("pattern").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > PATTERN_BLOCK)
    large = materialize(counts.select("pattern", F.ceil(F.col("n") / PATTERN_BLOCK).cast("int").alias("blocks")), "large")
    dealt = _cells(keyed, "pattern", large).select("pattern", "i", "j", "node", *_CODE).repartition("pattern", "i", "j")
    links = map_batches(dealt.sortWithinPartitions("pattern", "i", "j"), _find_links(radius(similarity), 3, LEVELS), "a long, b long")
    return connected_components(materialize(links.distinct(), "near")).select("node", F.col("root").alias("cluster"))


def alike(x: np.ndarray, y: np.ndarray, similarity: Fraction) -> bool:
    """Whether two sets have at least this Jaccard similarity, exactly."""
    p, q = similarity.numerator, similarity.denominator
    if min(len(x), len(y)) * q < max(len(x), len(y)) * p:
        return False
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both * (p + q) >= (len(x) + len(y)) * p


def _verified(similarity: Fraction, reach: int):
    """Links of a cell's sets, from rows (cluster, i, j, own, node, w0, ..., hashes) sorted by cell."""

    def links(cell: list[tuple]) -> tuple[list[int], list[int]]:
        sets = [np.frombuffer(row[-1], "<u8") for row in cell]
        crossing = cell[0][1] != cell[0][2]  # two blocks: pairs inside one are met in its own cell
        owners, names = [row[3] for row in cell], [row[4] for row in cell]

        def same(a: int, b: int) -> bool:
            return not (crossing and owners[a] == owners[b]) and alike(sets[a], sets[b], similarity)

        codes = np.array([row[5:-1] for row in cell], np.int64).view(np.uint64)
        first, second = GrayIndex(np.zeros(len(cell), np.int64), codes, reach, LEVELS, same).places()
        return [names[x] for x in first], [names[x] for x in second]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found(cell: list[tuple]) -> pa.RecordBatch:
            a, b = links(cell) if len(cell) > 1 else ([], [])
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

        cell: list[tuple] = []
        for batch in batches:
            for row in zip(*(column.to_pylist() for column in batch.columns)):
                if cell and row[:3] != cell[0][:3]:
                    yield found(cell)
                    cell = []
                cell.append(row)
        if cell:
            yield found(cell)

    return run


def _sets(texts: DataFrame, size: int) -> DataFrame:
    """(node, hashes as bytes) of (node, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _WordHashes()
        for batch in batches:
            packed = [shingle_set(text, size, words).tobytes() for text in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(packed, pa.binary())], names=["node", "hashes"])

    return materialize(map_batches(texts, run, "node long, hashes binary"), "sets")


def set_links(source: DataFrame, nodes: DataFrame, size: int, similarity: float) -> DataFrame:
    """Links (a, b) that connect all nodes (node, text_key, w0, ...) whose sets are similar, about one per member."""
    t = Fraction(str(similarity))
    members = materialize(nodes.join(clusters(nodes.select("node", *_CODE), similarity), "node"), "members")
    texts = source.groupBy("text_key").agg(F.first("text").alias("text"))
    sets = _sets(texts.join(members.select("text_key", "node"), "text_key").select("node", "text"), size)
    sizes = members.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"))
    block = F.least(F.lit(MOST_BLOCK), F.greatest(F.lit(LEAST_BLOCK), F.sqrt("n") * 10))
    large = sizes.filter(F.col("n") > LEAST_BLOCK).select("cluster", F.ceil(F.col("n") / block).cast("int").alias("blocks"))
    cells = _cells(members.select("cluster", "node", *_CODE), "cluster", materialize(large, "large")).join(sets, "node")
    dealt = cells.select("cluster", "i", "j", "own", "node", *_CODE, "hashes").repartition("cluster", "i", "j")
    return map_batches(dealt.sortWithinPartitions("cluster", "i", "j", "node"), _verified(t, radius(similarity)), "a long, b long")


def near_copies(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, similarity: float = 0.8, keyed: bool = False
) -> DataFrame:
    """(doc_id, component_id) of every row: texts whose sets of ``size``-word shingles have a Jaccard similarity of
    ``similarity`` or more are linked, and the component is named by the smallest id in it.

    No pair below the similarity is linked. Of pairs exactly at it the fingerprints are made to miss one in two thousand, of more
    similar ones fewer, unless others connect them. Equal sets are one node, so copies never meet as pairs. Texts without words
    (null, empty) are copies of one another. Rows with a null id stay and are linked, but name no component; a component
    without any id has a null name. Repeated rows stay. No rows give no rows. Other columns take no part. If ``keyed``,
    text_key and root, which tell texts and components apart, are added.

    A cluster of n sets is dealt out in blocks of about ``10 sqrt(n)`` that meet in pairs, so each of its sets
    travels about ``sqrt(n) / 10`` times.
    """
    source = _source(docs, id_col, text_col)
    prints = _prints(source, size)
    firsts = [F.first(c).alias(c) for c in _CODE]
    nodes = prints.groupBy("node").agg(F.min("doc_id").alias("least"), F.min("text_key").alias("text_key"), *firsts)
    nodes = materialize(nodes, "nodes")
    linked = connected_components(materialize(set_links(source, nodes, size, similarity), "links"))
    rooted = materialize(nodes.select("node", "least").join(linked, "node", "left").withColumn("root", F.coalesce("root", "node")), "rooted")
    names = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(names, "root").select("node", "root", "component_id")
    more = ["text_key", "root"] if keyed else []
    return prints.join(named, "node").select("doc_id", "component_id", *more)
