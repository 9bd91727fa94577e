"""Benchmark decontamination by a prefix-filtered join on shingles.

An item's window (13 consecutive words, or the whole of a shorter item) is contained in
a document only if all its shingles are, so one of them is enough to find it: the rarest
in the corpus, the window's prefix in an order by rarity. Documents meet windows in a join
on these shingles; the offset of the shingle in the window and both lengths bound where the
window may lie, and the words there are then joined with the words of the windows.

Windows, counts and places are tables, so a benchmark of any size takes the same steps: the
corpus is read once to count the shingles of the benchmark, once to search, and once for the
result. All that is broadcast is a filter of shingles, of a bounded number of bits; what it
lets through by mistake is dropped by the joins.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seedscape.llm.common import map_batches, text_bytes
from seedscape.operators.skew import lookup_join
from seedscape.scratch import materialize

#: Words of a window and of a shingle.
WINDOW, SHINGLE = 13, 3
#: Most bits of a filter of shingles (32 MB). Up to 4 million shingles have 64 bits each; with more of them
#: it lets more of the others through.
FILTER_BITS, BITS_EACH = 1 << 28, 64
#: Bytes of a text that are cut into words at once, and windows of a batch.
SLICE, BATCH = 1 << 20, 1 << 14

#: Bytes to lower-case words parted by blanks: letters, digits and all bytes beyond ASCII are word bytes.
_WORDS = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256)
)
#: The same as patterns: a character of a word, and one between words.
_INSIDE, _BETWEEN = r"[0-9A-Za-z\x{80}-\x{10FFFF}]", r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_WORDS).split()


def windows_of(words: list[bytes], size: int = WINDOW) -> list[tuple[bytes, ...]]:
    """The windows of an item: all runs of ``size`` words, or the item itself if it is shorter."""
    if not words:
        return []
    size = min(size, len(words))
    return [tuple(words[i : i + size]) for i in range(len(words) - size + 1)]


@dataclass
class Part:
    """Words of some whole texts, or of a part of a long one: where they lie in ``data``, their texts and their numbers there.

    Every word of a text is between ``low`` and ``high`` in exactly one part, with as many words on either side of it
    as were asked for, as far as the text has them.
    """

    data: bytes
    starts: np.ndarray
    ends: np.ndarray
    text: np.ndarray
    place: np.ndarray
    low: int
    high: int

    def shingles(self, numbers: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the runs of ``size`` words that begin between ``low`` and ``high``, and their first words."""
        at = np.arange(self.low, max(self.low, min(self.high, len(numbers) - size + 1)))
        at = at[self.text[at] == self.text[at + size - 1]]
        return shingle_hashes(numbers, size)[at], at


def _edges(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Where the words of translated bytes begin and end."""
    inside = np.frombuffer(b" " + data + b" ", np.uint8) != 0x20
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    return edges[::2], edges[1::2]


def parts_of(texts: Iterable[bytes | None], margin: int, size: int = SLICE) -> Iterator[Part]:
    """The words of texts in parts of about ``size`` bytes (or one word, if that is longer)."""
    short: list[tuple[int, bytes]] = []

    def together() -> Iterator[Part]:
        if short:
            data = b" ".join(t for _, t in short)
            begins = np.cumsum([0] + [len(t) + 1 for _, t in short[:-1]])
            starts, ends = _edges(data)
            own = np.searchsorted(begins, starts, "right") - 1
            place = np.arange(len(starts)) - np.searchsorted(starts, begins)[own]
            yield Part(data, starts, ends, np.array([i for i, _ in short])[own], place, 0, len(starts))
            short.clear()

    waiting = 0
    for i, text in enumerate(texts):
        text = (text or b"").translate(_WORDS)
        if len(text) <= size:
            if waiting + len(text) > size:
                yield from together()
                waiting = 0
            short.append((i, text))
            waiting += len(text)
            continue
        begin = first = low = at = 0
        while at < len(text):
            end = text.find(b" ", at + size)
            at = len(text) if end < 0 else end
            data = text[begin:at]
            starts, ends = _edges(data)
            n = len(starts)
            high = n if at == len(text) else max(low, n - margin)
            if high > low:
                yield Part(data, starts, ends, np.full(n, i), np.arange(first, first + n), low, high)
            kept = max(0, high - margin)
            begin = begin + int(starts[kept]) if kept < n else at
            first, low = first + kept, high - kept
    yield from together()


# A random number for each byte (none for the blank) and a power for each place in a word; the places behind share the last one.
_BYTES = np.random.default_rng(1).integers(1, 1 << 63, 256, np.uint64)
_BYTES[0x20] = 0
_POWERS = np.cumprod(np.full(256, 0x9E3779B97F4A7C15, np.uint64))


def word_hashes(part: Part) -> np.ndarray:
    """A number for each word that depends on its bytes only."""
    if not len(part.starts):
        return np.zeros(0, np.uint64)
    data = np.frombuffer(part.data, np.uint8)[part.starts[0] :]
    lengths = np.diff(np.append(part.starts, len(part.data)))
    begins = part.starts - part.starts[0]
    offset = np.arange(len(data), dtype=np.int32) - np.repeat(begins.astype(np.int32), lengths)
    made = _POWERS[np.minimum(offset, len(_POWERS) - 1, out=offset)]
    made *= _BYTES[data]
    sums = np.add.reduceat(made, begins)
    return sums ^ (sums >> np.uint64(31))


def shingle_hashes(numbers: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of ``size`` words from the hashes of the words."""
    n = max(len(numbers) - size + 1, 0)
    made = np.full(n, size, np.uint64)
    for i in range(size):
        made = (made + numbers[i : i + n]) * np.uint64(0x9E3779B97F4A7C15)
        made ^= made >> np.uint64(29)
    return made


def _filter(hashes: DataFrame, most_bits: int) -> Broadcast:
    """Broadcast bits, two for each of the different hashes."""
    n = hashes.agg(F.count_distinct("hash")).first()[0]
    bits = 64
    while bits < min(n * BITS_EACH, most_bits):
        bits *= 2
    mask = F.lit(bits - 1).cast("long")
    places = F.array(F.col("hash").bitwiseAND(mask), F.shiftrightunsigned("hash", 32).bitwiseAND(mask))
    place = hashes.select(F.explode(places).alias("place"))
    word = place.groupBy(F.shiftright("place", 6).cast("int").alias("word"))
    found = word.agg(F.bit_or(F.expr("shiftleft(1L, cast(place & 63 as int))")).alias("bits")).toArrow()
    table = np.zeros(bits // 64, np.uint64)
    table[found["word"].to_numpy()] = found["bits"].to_numpy().astype(np.int64).view(np.uint64)
    return hashes.sparkSession.sparkContext.broadcast(table)


def _passing(table: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Positions of the hashes that pass the filter."""
    mask = np.uint64(len(table) * 64 - 1)
    at = np.arange(len(hashes))
    for shift in (0, 32):
        place = hashes[at] >> np.uint64(shift) & mask
        at = at[(table[place >> np.uint64(6)] >> (place & np.uint64(63)) & np.uint64(1)).astype(bool)]
    return at


def _windows(items: DataFrame, window: int, shingle: int) -> DataFrame:
    """A row for each window of each item: its words, their number, the longest, and the hashes of its shingles."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for part in parts_of([text], window):
                    words = part.data.split()
                    length = min(window, len(words))
                    size = min(shingle, length)
                    made = shingle_hashes(word_hashes(part), size).view(np.int64)
                    high = min(part.high, len(words) - length + 1)
                    for start in range(part.low, high, BATCH):
                        runs = range(start, min(start + BATCH, high))
                        yield pa.RecordBatch.from_pydict(
                            {
                                "item": pa.array([item] * len(runs), pa.string()),
                                "window": pa.array([b" ".join(words[i : i + length]).decode() for i in runs], pa.string()),
                                "length": pa.array([length] * len(runs), pa.int32()),
                                "longest": pa.array([max(map(len, words[i : i + length])) for i in runs], pa.int64()),
                                "hashes": pa.array([made[i : i + length - size + 1] for i in runs], pa.list_(pa.int64())),
                            }
                        )

    return map_batches(items, cut, "item string, window string, length int, longest long, hashes array<long>")


def _count_shingles(texts: DataFrame, sizes: list[int], wanted: Broadcast) -> DataFrame:
    """How often each shingle that passes the filter occurs in the corpus."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen = [np.zeros(0, np.uint64)]
            for part in parts_of(batch.column(0).to_pylist(), max(sizes)):
                numbers = word_hashes(part)
                for size in sizes:
                    made, _ = part.shingles(numbers, size)
                    seen.append(made[_passing(wanted.value, made)])
            found, n = np.unique(np.concatenate(seen), return_counts=True)
            yield pa.RecordBatch.from_pydict({"hash": pa.array(found.view(np.int64)), "n": pa.array(n, pa.int64())})

    return map_batches(texts, count, "hash long, n long").groupBy("hash").agg(F.sum("n").alias("n"))


def _candidates(texts: DataFrame, sizes: list[int], wanted: Broadcast, window: int, longest: int) -> DataFrame:
    """Where a text has a shingle that passes the filter, with the words around it, ``lead`` of them before it.

    Words longer than any of the benchmark are left empty, as no window holds them.
    """

    def around(part: Part, begin: np.ndarray, end: np.ndarray) -> Iterator[str]:
        """The words from ``begin`` to before ``end``, parted by one blank."""
        giants = np.flatnonzero(part.ends - part.starts > longest)
        some = np.searchsorted(giants, begin) < np.searchsorted(giants, end)
        from_, to = part.starts[begin], part.ends[end - 1]
        for i, j, a, b, giant in zip(begin.tolist(), end.tolist(), from_.tolist(), to.tolist(), some.tolist()):
            if giant:
                own = zip(part.starts[i:j].tolist(), part.ends[i:j].tolist())
                yield b" ".join([part.data[c:d] if d - c <= longest else b"" for c, d in own]).decode()
            else:
                yield b" ".join(part.data[a:b].split()).decode()

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(0)
            for part in parts_of(batch.column(1).to_pylist(), window):
                numbers = word_hashes(part)
                for size in sizes:
                    made, firsts = part.shingles(numbers, size)
                    passing = _passing(wanted.value, made)
                    for start in range(0, len(passing), BATCH):
                        some = passing[start : start + BATCH]
                        at = firsts[some]
                        lead = np.minimum(part.place[at], window - 1)
                        end = np.minimum(at + window, np.searchsorted(part.text, part.text[at], "right"))
                        yield pa.RecordBatch.from_pydict(
                            {
                                "key": keys.take(pa.array(part.text[at])),
                                "hash": pa.array(made[some].view(np.int64)),
                                "at": pa.array(part.place[at], pa.int32()),
                                "lead": pa.array(lead, pa.int32()),
                                "around": pa.array(list(around(part, at - lead, end)), pa.string()),
                            }
                        )

    return map_batches(texts, search, "key string, hash long, at int, lead int, around string")


def _merged(matches: DataFrame) -> DataFrame:
    """Overlapping and touching runs of a text as one, in order."""
    before = Window.partitionBy("key").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy("key").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, 0)
    runs = matches.select("key", "start", (F.col("start") + F.col("length")).alias("end")).distinct()
    apart = runs.withColumn("new", (F.col("start") > F.coalesce(F.max("end").over(before), F.lit(-1))).cast("int"))
    islands = apart.withColumn("island", F.sum("new").over(upto)).groupBy("key", "island")
    spans = islands.agg(F.min("start").alias("start"), F.max("end").alias("end"))
    return spans.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("hits"))


def find_windows(
    docs: DataFrame,
    benchmark: DataFrame,
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = WINDOW,
    shingle: int = SHINGLE,
    filter_bits: int = FILTER_BITS,
) -> DataFrame:
    """Add ``n_words``, ``hits`` (runs of hit words: first, behind the last) and ``items`` (whose windows occur).

    All rows and columns stay, repeated rows too; columns of these three names are replaced.
    Null and empty texts have no words and no hits; null and empty items, and an empty
    benchmark, hit nothing. Items are named as strings, a null id as the empty string; items
    with the same id count as one. Texts of any length are read in parts.

    Equal texts are found once: what is found belongs to the SHA-256 of a text. ``filter_bits``
    (a power of two) bounds the memory of the filters and changes nothing in the result.
    """
    names = ("n_words", "hits", "items")
    items = benchmark.select(
        F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("item"), text_bytes(item_text_col).alias("text")
    )
    listed = materialize(_windows(items, window, shingle), "listed")
    owners = materialize(listed.select("item", "window").distinct(), "owners")
    windows = materialize(listed.dropDuplicates(["window"]).select("window", "length", "hashes"), "windows")
    shape = listed.agg(F.collect_set(F.least("length", F.lit(shingle))), F.max("longest")).first()
    sizes, longest = sorted(shape[0]), shape[1] or 0  # at most one size for each up to that of a shingle

    text = text_bytes(text_col)
    found = docs.drop(*names)
    key = "_text_key"
    while key in found.columns:
        key += "_"
    none = F.array().cast("array<struct<start:int,end:int>>"), F.array().cast("array<string>")
    whole = F.col(text_col).cast("string")
    count = F.length(F.regexp_replace(whole, f"{_BETWEEN}*+{_INSIDE}++{_BETWEEN}*+", "x"))
    n_words = F.when(whole.rlike(_INSIDE), count).otherwise(0).cast("long")
    if not sizes:
        return found.withColumns(dict(zip(names, (n_words, *none))))

    shingles = windows.select("window", "length", F.posexplode("hashes").alias("offset", "hash"))
    wanted = _filter(shingles, filter_bits)
    counts = materialize(_count_shingles(docs.select(text.alias("text")), sizes, wanted), "counts")
    wanted.destroy()
    rarity = F.struct(F.coalesce("n", F.lit(0)).alias("n"), "hash", "offset")
    rarest = lookup_join(shingles, counts, ["hash"]).groupBy("window", "length").agg(F.min(rarity).alias("prefix"))
    places = materialize(rarest.select("prefix.hash", "prefix.offset", "length").distinct(), "places")

    wanted = _filter(places, filter_bits)
    texts = docs.select(F.sha2(text, 256).alias("key"), text.alias("text"))
    met = _candidates(texts, sizes, wanted, window, longest).join(places, "hash")
    inside = F.col("lead") - F.col("offset")
    met = met.withColumn("around", F.split("around", " ")).where((inside >= 0) & (inside + F.col("length") <= F.size("around")))
    met = met.select(
        "key", (F.col("at") - F.col("offset")).alias("start"), "length", F.array_join(F.slice("around", inside + 1, F.col("length")), " ").alias("window")
    )
    matches = materialize(met.join(windows.select("window"), "window", "left_semi").distinct(), "matches")
    wanted.destroy()

    named = matches.select("key", "window").distinct().join(owners, "window")
    ids = named.groupBy("key").agg(F.sort_array(F.collect_set("item")).alias("items"))
    hits = materialize(_merged(matches).join(ids, "key").withColumnRenamed("key", key), "hits")
    # words are counted before the join, so a text that is not asked for does not travel
    keyed = found.withColumns({key: F.sha2(text, 256), "n_words": n_words}).join(hits.hint("merge"), key, "left")
    values = {"hits": F.coalesce("hits", none[0]), "items": F.coalesce("items", none[1])}
    return keyed.select(*found.columns, "n_words", *[value.alias(name) for name, value in values.items()])


def n_hit() -> Column:
    """Number of hit words, from ``hits``."""
    return F.aggregate("hits", F.lit(0).cast("long"), lambda total, h: total + h["end"] - h["start"])


def is_contaminated() -> Column:
    """At least one word in twenty is hit."""
    return (n_hit() > 0) & (20 * n_hit() >= F.col("n_words"))
