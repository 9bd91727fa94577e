"""SimHash near-duplicates by a Gray-ordered hierarchical index.

Fingerprints within d differing bits agree on all bits of at least one of a few masks.
Each mask's shared bit patterns are the top nodes of the index and deal the work out.
Below, a task sorts the fingerprints by Gray rank, so that neighbours differ in few bits,
and builds nodes over runs with equal leading bits; a node knows the bits that all of its
members share. Two nodes are compared on the bits that both share: the differences only
add up on the way down, and once there are more than d, all pairs below are pruned.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seedscape.llm.common import map_batches, text_bytes
from seedscape.llm.components import connected_components
from seedscape.scratch import materialize

BITS, SEED = 64, 42
#: Fingerprints under one masked pattern that are compared in one piece; larger groups are compared block by block.
BLOCK = 65_536
#: Mean fingerprints per masked pattern up to which a set of masks is used.
MEAN_GROUP = 8
#: Leading bits of a node, level by level; pairs of nodes compared at once.
LEVELS, FRONTIER = (8, 16, 24, 32, 40, 48, 56, 64), 1 << 20
#: Bytes of a text that are cut into words at once.
SLICE = 1 << 19
#: Fingerprints that a task gathers before it builds an index.
GATHER = 200_000

_BLANK = re.compile(rb"[\x09-\x0d ]")


def word_slices(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text, lower case in A-Z, by slices of about ``SLICE`` bytes."""
    at = 0
    while at < len(text):
        blank = _BLANK.search(text, at + SLICE)
        end = blank.start() if blank else len(text)
        yield text[at:end].lower().split()
        at = end


def _hashes(words: list[bytes], size: int) -> np.ndarray:
    """Hashes of all shingles of ``size`` words; of all words together if they are fewer."""
    joined = b" ".join(words)
    ends = list(accumulate(map(len, words), lambda end, n: end + 1 + n))
    size = min(size, len(words))
    starts = [0, *(end + 1 for end in ends[: len(words) - size])]
    return np.array([xxhash.xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts, ends[size - 1 :])], "<u8")


def hash_slices(text: bytes, size: int) -> Iterator[np.ndarray]:
    """Hashes of the shingles of ``size`` words, slice by slice; of the whole text if it has fewer words, none without words."""
    held: list[bytes] = []
    whole = True
    for words in word_slices(text):
        held += words
        if len(held) >= size:
            yield _hashes(held, size)
            held, whole = held[len(held) - size + 1 :], False
    if whole and held:
        yield _hashes(held, size)


def fingerprint(text: bytes, size: int) -> int:
    """64-bit SimHash over the hashes of all shingles of ``size`` words, each counted as often as it occurs."""
    ones, n = np.zeros(BITS, np.int64), 0
    for hashed in hash_slices(text, size):
        bits = np.unpackbits(hashed.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
        n += len(hashed)
    return int(np.packbits(ones * 2 > n, bitorder="little").view("<u8")[0])


def _source(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, text_key, text): rows are told apart by their id and a digest of their text."""
    text = text_bytes(text_col)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.md5(text).alias("text_key"), text.alias("text"))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 4) -> DataFrame:
    """(doc_id, text_key, fingerprint as long) of every row; null and empty texts have fingerprint zero."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = np.array([fingerprint(text, size) for text in batch.column(2).to_pylist()], np.uint64)
            columns = [batch.column(0), batch.column(1), pa.array(made.view(np.int64))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "text_key", "fingerprint"])

    return map_batches(_source(docs, id_col, text_col), run, "doc_id long, text_key string, fingerprint long")


def masks(n: int, distance: int) -> list[int]:
    """Masks of which at least one covers only equal bits, for any two fingerprints within ``distance``.

    The bits are cut into blocks, and every choice of blocks that leaves ``distance`` out is a
    mask. More blocks make longer patterns and so smaller groups; how many depends on ``n``.
    """
    for blocks in range(distance + 1, distance + 5):
        kept = blocks - distance
        if blocks == distance + 4 or n <= MEAN_GROUP << (BITS * kept // blocks):
            break
    edges = [BITS * i // blocks for i in range(blocks + 1)]
    block = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:])]
    return [sum(chosen) for chosen in combinations(block, kept)]


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """Position of each code in the reflected Gray order; codes of several words are rows, the leading word first."""
    rank = codes.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    if codes.ndim > 1:  # an odd number of bits before a word turns its order round
        odd = np.cumsum(np.bitwise_count(codes), axis=1, dtype=np.int64)[:, :-1] & 1
        rank[:, 1:] ^= (-odd).view(np.uint64)
    return rank


class GrayIndex:
    """Hierarchical index over the fingerprints of many groups; only members of one group are compared.

    ``same``, if given, decides by the places of two members within the distance whether they are linked.
    """

    def __init__(
        self,
        group: np.ndarray,
        codes: np.ndarray,
        distance: int,
        levels: tuple[int, ...] = LEVELS,
        same: Callable[[int, int], bool] | None = None,
    ) -> None:
        codes = codes.reshape(len(codes), -1)
        self.same = same
        self.order = np.lexsort((*gray_rank(codes).T[::-1], group))
        self.codes, self.group, self.distance, self.depth = codes[self.order], group[self.order], distance, len(levels)
        self.label = np.arange(len(codes))  # the smallest member it is known to be linked with
        new = np.ones(len(codes), bool)
        new[1:] = self.group[1:] != self.group[:-1]
        self.starts = [np.flatnonzero(new)]
        for bits in levels:
            word = (bits - 1) // BITS
            lead = self.codes[:, word] >> np.uint64(BITS * (word + 1) - bits)
            new[1:] |= lead[1:] != lead[:-1]
            self.starts.append(np.flatnonzero(new))
        self.every = [np.bitwise_and.reduceat(self.codes, at) for at in self.starts]
        # bits in which all members of a node agree
        self.shared = [~(np.bitwise_or.reduceat(self.codes, at) ^ both) for at, both in zip(self.starts, self.every)]
        bounds = [np.append(at, len(codes)) for at in self.starts]
        self.children = [np.searchsorted(low, at) for low, at in zip(self.starts[1:], bounds[:-1])]

    def _link(self, a: np.ndarray, b: np.ndarray) -> None:
        while True:
            low = np.minimum(self.label[a], self.label[b])
            before = self.label.copy()
            np.minimum.at(self.label, self.label[a], low)
            np.minimum.at(self.label, self.label[b], low)
            while not np.array_equal(up := self.label[self.label], self.label):
                self.label = up
            if np.array_equal(before, self.label):
                return

    def _accept(self, a: np.ndarray, b: np.ndarray) -> None:
        """Link near members; where ``same`` decides, nearest first, and only those not connected yet are asked for."""
        if self.same is None:
            self._link(a, b)
            return
        apart = np.bitwise_count(self.codes[a] ^ self.codes[b]).sum(axis=1, dtype=np.int64)
        for k in np.argsort(apart, kind="stable").tolist():
            x, y = int(a[k]), int(b[k])
            if self.label[x] != self.label[y] and self.same(int(self.order[x]), int(self.order[y])):
                low, high = sorted((self.label[x], self.label[y]))
                self.label[self.label == high] = low

    def _one_component(self, level: int) -> tuple[np.ndarray, np.ndarray]:
        """Per node: its members' smallest label, and whether they all have it."""
        least = np.minimum.reduceat(self.label, self.starts[level])
        return least, least == np.maximum.reduceat(self.label, self.starts[level])

    def _near(self, level: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        differing = (self.every[level][a] ^ self.every[level][b]) & self.shared[level][a] & self.shared[level][b]
        return np.bitwise_count(differing).sum(axis=1, dtype=np.int64) <= self.distance

    def links(self) -> tuple[np.ndarray, np.ndarray]:
        """Links that connect all members that are connected within a group, at most one per member, as their codes."""
        given = np.empty_like(self.codes)
        given[self.order] = self.codes
        return tuple(given[at].squeeze(1) for at in self.places())

    def places(self) -> tuple[np.ndarray, np.ndarray]:
        """The same links, as places in the given order."""
        if len(self.codes) > 1:  # neighbours in Gray order first: most of a dense group is one component then
            near = np.bitwise_count(self.codes[1:] ^ self.codes[:-1]).sum(axis=1, dtype=np.int64) <= self.distance
            a = np.flatnonzero(near & (self.group[1:] == self.group[:-1]))
            self._accept(a, a + 1)
            roots = np.arange(len(self.starts[0]))
            stack = [(0, roots, roots)]
            while stack:
                self._descend(*stack.pop(), stack)
        linked = np.flatnonzero(self.label != np.arange(len(self.label)))
        return self.order[self.label[linked]], self.order[linked]

    def _descend(self, level: int, a: np.ndarray, b: np.ndarray, stack: list) -> None:
        least, whole = self._one_component(level)
        open_ = ~(whole[a] & whole[b] & (least[a] == least[b]))
        a, b = a[open_], b[open_]
        if level == self.depth:
            self._accept(a, b)
            return
        first, behind = self.children[level][:-1], self.children[level][1:]
        n = (behind - first)[a] * (behind - first)[b]
        if n.sum() > FRONTIER and len(a) > 1:
            half = len(a) // 2
            stack += [(level, a[half:], b[half:]), (level, a[:half], b[:half])]
            return
        pair = np.repeat(np.arange(len(a)), n)
        nth = np.arange(len(pair)) - np.repeat(np.cumsum(n) - n, n)
        width = (behind - first)[b][pair]
        low, high = first[a][pair] + nth // np.maximum(width, 1), first[b][pair] + nth % np.maximum(width, 1)
        keep = low <= high
        low, high = low[keep], high[keep]
        near = self._near(level + 1, low, high)
        stack.append((level + 1, low[near], high[near]))


def _groups(batches: Iterator[pa.RecordBatch], n_keys: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Group numbers and the columns behind the keys, gathered from sorted batches up to a change of the group."""
    held: list[np.ndarray] = []
    size = 0
    for batch in batches:
        if not len(batch):
            continue
        held.append(np.stack([np.asarray(column).astype(np.int64) for column in batch.columns], axis=1))
        size += len(batch)
        if size >= GATHER:
            rows = np.concatenate(held)
            change = np.flatnonzero((rows[1:, :n_keys] != rows[:-1, :n_keys]).any(axis=1))
            if len(change):
                cut = change[-1] + 1
                yield _numbered(rows[:cut, :n_keys]), rows[:cut, n_keys:]
                rows = rows[cut:]
            held, size = [rows], len(rows)
    if held:
        rows = np.concatenate(held)
        yield _numbered(rows[:, :n_keys]), rows[:, n_keys:]


def _numbered(keys: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum((keys[1:] != keys[:-1]).any(axis=1))])


def _find_links(distance: int, n_keys: int, levels: tuple[int, ...] = LEVELS):
    """Links between rows of keys, a name and the words of a code; where there are no words, the name is the code."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group, rows in _groups(batches, n_keys):
            names, codes = rows[:, 0], np.ascontiguousarray(rows[:, 1:] if rows.shape[1] > 1 else rows)
            a, b = GrayIndex(group, codes.view(np.uint64), distance, levels).places()
            yield pa.RecordBatch.from_arrays([pa.array(names[x]) for x in (a, b)], names=["a", "b"])

    return run


def fingerprint_links(distinct: DataFrame, distance: int) -> DataFrame:
    """Links (a, b) that connect all ``fingerprint`` values within ``distance`` bits; every one occurs once."""
    chosen = masks(distinct.count(), distance)
    signed = [m - (1 << BITS) if m >> (BITS - 1) else m for m in chosen]
    mask = F.element_at(F.array(*[F.lit(m) for m in signed]), F.col("mask") + 1)
    keyed = distinct.select("fingerprint", F.explode(F.sequence(F.lit(0), F.lit(len(chosen) - 1))).alias("mask"))
    keyed = keyed.withColumn("pattern", F.col("fingerprint").bitwiseAND(mask))
    groups = keyed.groupBy("mask", "pattern").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    # a large group is cut into blocks that meet each other in pairs, in a task each
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("fingerprint"), blocks).cast("int")
    members = keyed.join(groups, ["mask", "pattern"]).withColumn("own", own)
    met = members.withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    cells = met.select("mask", "pattern", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "fingerprint")
    dealt = cells.repartition("mask", "pattern", "i", "j").sortWithinPartitions("mask", "pattern", "i", "j")
    return map_batches(dealt, _find_links(distance, 4), "a long, b long")


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 4, distance: int = 4, keyed: bool = False
) -> DataFrame:
    """(doc_id, fingerprint as long, component_id) of every row: fingerprints within ``distance`` bits are
    linked, and the component is named by the smallest id in it.

    Rows with equal fingerprints are one node, so copies never meet as pairs. Texts without words
    (null, empty) have fingerprint zero and are linked like any other. Rows with a null id stay and
    are linked, but name no component; a component without any id has a null name. Repeated rows
    stay. No rows give no rows. Other columns take no part. If ``keyed``, text_key and root, which tell texts and
    components apart, are added.
    """
    prints = materialize(fingerprints(docs, id_col, text_col, size), "fingerprints")
    distinct = materialize(prints.groupBy("fingerprint").agg(F.min("doc_id").alias("least")), "distinct")
    linked = connected_components(materialize(fingerprint_links(distinct.select("fingerprint"), distance), "links"))
    rooted = distinct.join(linked.withColumnRenamed("node", "fingerprint"), "fingerprint", "left").withColumn(
        "root", F.coalesce("root", "fingerprint")
    )
    names = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(names, "root").select("fingerprint", "root", "component_id")
    more = ["text_key", "root"] if keyed else []
    return prints.join(named, "fingerprint").select("doc_id", "fingerprint", "component_id", *more)


def one_per_component(docs: DataFrame, find: Callable[..., DataFrame] = near_duplicates, **options) -> DataFrame:
    """The document with the smallest id of each component that ``find`` names, in all its columns.

    Rows are told apart by id and text: of different texts with that id in one component, the one with the least
    digest stays; in different components, each stays. Of equal texts that share an id, one row stays. Rows
    with a null id cannot be told apart and all stay.
    """
    id_col, text_col = options.get("id_col", "doc_id"), options.get("text_col", "text")
    first = find(docs, keyed=True, **options).filter("doc_id = component_id").groupBy("root", "doc_id").agg(F.min("text_key").alias("_key"))
    kept = first.select(F.col("doc_id").alias(id_col), "_key", F.lit(True).alias("_kept"))
    flagged = docs.withColumn("_key", F.md5(text_bytes(text_col))).join(kept, [id_col, "_key"], "left")
    alone = F.when(F.col(id_col).isNull(), F.monotonically_increasing_id())
    rows = flagged.filter(F.col("_kept") | F.col(id_col).isNull()).withColumn("_row", alone)
    return rows.dropDuplicates([id_col, "_key", "_row"]).select(*docs.columns)


def __getattr__(name: str):
    """``near_copies`` has its own module, which builds on this one; its old name here stays good."""
    if name == "near_copies":
        from seedscape.llm.near_copies import near_copies

        return near_copies
    raise AttributeError(f"module {__name__!r} has no attribute {name!r}")
