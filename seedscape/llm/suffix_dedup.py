"""Removal of long strings that occur earlier in the corpus, by run-length indexes.

No one index can hold the corpus, so the corpus is first dealt out such that equal strings
meet: every ``length``-byte string is filed under the least hash of its shorter substrings,
which equal strings share. Neighbouring strings mostly share it too, so they travel as one
segment, named by a keyed hash of its bytes; the key is drawn anew for every run, so that no
text can be made to pass for another. Where a whole segment came before, all its strings did. What is left, different segments under one hash, is where copies begin and end: their
bytes are fetched, each block of them gets a run-length index, and the matching statistics
streamed along it mark the strings with an earlier occurrence.
"""

from __future__ import annotations

import secrets
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seedscape.llm.common import appended, map_batches, text_bytes, with_fields
from seedscape.llm.run_index import RunIndex
from seedscape.operators.ordering import running_totals
from seedscape.scratch import materialize

#: String starts of one segment, at most; the hashed substrings are this much shorter than a string, less one.
SPAN = 64
#: Bytes hashed at a time, and bytes of one run-length index.
HASH_BYTES, INDEX_BYTES = 1 << 20, 1 << 20
#: Segments under one hash up to which they share an index. Beyond, their strings are dealt out one by one.
GROUP = 8_192

_BASE = 0x9E3779B97F4A7C15
_BYTE = np.random.default_rng(10).integers(0, 2**64, 256, np.uint64)  # a random number for each byte

COVERED, WHOLE = 0, 1


def _mixed(x: np.ndarray) -> np.ndarray:
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(32)
    return x


def _rolling(levels: list[np.ndarray], length: int) -> np.ndarray:
    """Polynomial hashes of all substrings of ``length``, from those of 1, 2, 4 ... bytes."""
    total, done = None, 0
    for i, level in enumerate(levels):
        if length >> i & 1:
            if total is None:
                total = level.copy()
            else:
                n = len(level) - done
                total = total[:n] * np.uint64(pow(_BASE, 1 << i, 1 << 64)) + level[done:]
            done += 1 << i
    return total


def _levels(data: np.ndarray, longest: int) -> list[np.ndarray]:
    levels = [_BYTE[data]]
    for i in range(longest.bit_length() - 1):
        half = 1 << i
        last = levels[-1]
        levels.append(last[:-half] * np.uint64(pow(_BASE, half, 1 << 64)) + last[half:])
    return levels


def segments(texts: list[bytes], length: int, secret: bytes = b"") -> tuple[np.ndarray, ...]:
    """Segments of some texts: (text number, first start, number of starts, key, name, tied).

    Each start of a ``length``-byte string is in one segment. ``key`` is the least hash in each of
    its strings and ``name`` a hash of all its bytes under ``secret``. ``tied``: the least hash occurs more than
    once, so that a string may occur twice in the segment.
    """
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    joined = b"".join(texts)
    data = np.frombuffer(joined, np.uint8)
    n = len(data) - length + 1
    empty = np.zeros(0, np.int64)
    if n < 1:
        return empty, empty, empty, empty.astype(np.uint64), empty.astype(np.uint64), empty.astype(bool)
    span = min(SPAN, length)
    least = hashes = _mixed(_rolling(_levels(data, length - span + 1), length - span + 1))
    width = 1
    while width < span:
        step = min(width, span - width)
        least = np.minimum(least[:-step], least[step:])
        width += step
    first = np.cumsum(lengths) - lengths
    number = np.repeat(np.arange(len(texts)), np.maximum(lengths - length + 1, 0))
    starts = first[number] + np.arange(len(number)) - np.repeat(*_runs(number)) if len(number) else empty
    new = np.ones(len(starts), bool)
    new[1:] = (least[starts[1:]] != least[starts[:-1]]) | (number[1:] != number[:-1])
    run = np.maximum.accumulate(np.where(new, np.arange(len(starts)), 0))
    new |= (np.arange(len(starts)) - run) % span == 0
    at = np.flatnonzero(new)
    begin, count = starts[at], np.diff(np.append(at, len(starts)))
    key = least[begin]
    window = np.minimum(begin[:, None] + np.arange(span), len(hashes) - 1)
    anchor = (hashes[window] == key[:, None]).argmax(axis=1)
    tied = count - 1 > anchor
    return number[at], begin - first[number[at]], count, key, _names(joined, begin, count + length - 1, secret), tied


def _runs(number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    begin = np.flatnonzero(np.append(True, number[1:] != number[:-1]))
    return begin, np.diff(np.append(begin, len(number)))


def _names(data: bytes, begin: np.ndarray, size: np.ndarray, secret: bytes) -> np.ndarray:
    """Hashes of the bytes from ``begin``, ``size`` of them, under ``secret``."""
    keyed, made = blake2b(digest_size=8, key=secret), []
    for a, b in zip(begin.tolist(), (begin + size).tolist()):
        name = keyed.copy()
        name.update(data[a:b])
        made.append(name.digest())
    return np.frombuffer(b"".join(made), "<u8")


def _cut(docs: DataFrame, length: int, secret: bytes = b"") -> DataFrame:
    """Segments of all documents (deal, key, name, doc, start, n, known). Those that came before in the same
    batch are ``known`` to be covered and are dealt out at random, so that no key is hot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0).to_numpy(), batch.column(1).to_pylist()
            # long texts are cut so that every string is whole in one piece; segments depend on nothing else
            cuts = [(i, at) for i, text in enumerate(texts) for at in range(0, max(1, len(text) - length + 1), HASH_BYTES)]
            part, size = [], 0
            found = []
            for k, (i, at) in enumerate(cuts):
                part.append(texts[i][at : at + HASH_BYTES + length - 1])
                size += len(part[-1])
                if size >= HASH_BYTES or k == len(cuts) - 1:
                    number, start, count, key, name, tied = segments(part, length, secret)
                    own = np.array(cuts[k + 1 - len(part) : k + 1])[number].reshape(-1, 2)
                    found.append((ids[own[:, 0]], start + own[:, 1], count, key, name, tied))
                    part, size = [], 0
            doc, start, count, key, name, tied = (np.concatenate(x) for x in zip(*found))
            order = np.lexsort((start, doc, name, key))
            doc, start, count, key, name, tied = (x[order] for x in (doc, start, count, key, name, tied))
            known = np.zeros(len(doc), bool)
            known[1:] = (key[1:] == key[:-1]) & (name[1:] == name[:-1])
            deal = np.where(known, _mixed(doc.view(np.uint64) * np.uint64(_BASE) + start.view(np.uint64)), key)
            kind = np.where(known, 1, 0) | np.where(tied, 2, 0)
            columns = [deal.view(np.int64), np.where(known, 0, name.view(np.int64)), doc, start << 16 | count << 2 | kind]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["deal", "name", "doc", "place"])

    return map_batches(docs.select("_doc", text_bytes("_text")), run, "deal long, name long, doc long, place long")


def _first_of_each(segments_: DataFrame) -> DataFrame:
    """Keep what repeats, as (kind, key, doc, start, n): segments that came before are COVERED; first
    segments of which another has the same key, or that are tied, are WHOLE, to be looked into.

    Rows are sorted by key, name and place. The state between batches is one row, whatever the
    size of a group: the key's first segment, as long as no other has been seen.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, pending = (None, None), None
        for batch in batches:
            rows = np.stack([np.asarray(c) for c in batch.columns])
            if not rows.shape[1]:
                continue
            key, name, _, place = rows
            known, tied = place & 1 > 0, place & 2 > 0
            new_key = np.append(key[0] != last[0], key[1:] != key[:-1]) | known
            first = new_key | np.append(name[0] != last[1], name[1:] != name[:-1])
            group = np.cumsum(new_key)
            later = first & ~new_key
            shared = np.bincount(group[later], minlength=group[-1] + 1) > 0
            opens = new_key & ~known
            looked_into = later | opens & (tied | shared[group])
            covered = known | ~first
            keep = covered | looked_into
            made, kinds = rows[:, keep], np.where(covered[keep], COVERED, WHOLE)
            if pending is not None and shared[0]:
                made, kinds = np.append(pending, made, axis=1), np.append(WHOLE, kinds)
                pending = None
            if group[-1]:
                at = np.flatnonzero(opens)
                waits = len(at) and group[at[-1]] == group[-1] and not looked_into[at[-1]]
                pending = rows[:, at[-1:]] if waits else None
            last = (key[-1], name[-1])
            place = made[3]
            columns = [kinds, made[0], made[2], place >> 16, place >> 2 & 0x3FFF]
            types = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["kind", "key", "doc", "start", "n"])

    dealt = segments_.repartition("deal").sortWithinPartitions("deal", "name", "doc", "place")
    return map_batches(dealt, run, "kind int, key long, doc long, start long, n int")


def _bytes_of(wanted: DataFrame, docs: DataFrame, length: int) -> DataFrame:
    """The segments (key, doc, start, n) with their bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("key", pa.int64()), ("doc", pa.int64()), ("start", pa.int64()), ("piece", pa.binary())])
        for batch in batches:
            doc, text, places = (c.to_pylist() for c in batch.columns)
            rows = [
                (p["key"], i, p["start"], t[p["start"] : p["start"] + p["n"] + length - 1])
                for i, t, own in zip(doc, text, places)
                for p in own
            ]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    places = wanted.groupBy("doc").agg(F.collect_list(F.struct("key", "start", "n")).alias("places"))
    found = docs.select(F.col("_doc").alias("doc"), text_bytes("_text").alias("text")).join(places, "doc")
    return map_batches(found, run, "key long, doc long, start long, piece binary")


def _spans(doc: np.ndarray, start: np.ndarray) -> pa.RecordBatch:
    """Starts in order as runs (doc, start, n)."""
    new = np.append(True, (doc[1:] != doc[:-1]) | (start[1:] != start[:-1] + 1))[: len(doc)]
    at = np.flatnonzero(new)
    columns = [pa.array(doc[at]), pa.array(start[at]), pa.array(np.diff(np.append(at, len(doc))), pa.int32())]
    return pa.RecordBatch.from_arrays(columns, names=["doc", "start", "n"])


def _indexed(pieces: DataFrame, length: int) -> DataFrame:
    """Starts that came before within groups of one key, by a run-length index over each block of groups."""

    def marked(block: list[tuple]) -> pa.RecordBatch:
        block.sort()  # by place, the order in which the strings are streamed
        index = RunIndex([piece for _, _, piece in block])
        before = index.repeats_earlier(length)
        number = np.repeat(np.arange(len(block)), [len(piece) + 1 for _, _, piece in block])
        at = np.flatnonzero(before)
        doc = np.fromiter((x[0] for x in block), np.int64, len(block))[number[at]]
        begin = np.fromiter((x[1] for x in block), np.int64, len(block)) - index.starts
        return _spans(doc, begin[number[at]] + at)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, size, last = [], 0, None
        for batch in batches:
            for key, doc, start, piece in zip(*(c.to_pylist() for c in batch.columns)):
                if key != last and size >= INDEX_BYTES:
                    yield marked(block)
                    block, size = [], 0
                block.append((doc, start, piece))
                size += len(piece)
                last = key
        if block:
            yield marked(block)

    dealt = pieces.repartition("key").sortWithinPartitions("key")
    return map_batches(dealt, run, "doc long, start long, n int")


def _one_by_one(pieces: DataFrame, length: int) -> DataFrame:
    """The same for groups too large for an index: their strings are counted as rows of their own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key, doc, start, piece = (c.to_pylist() for c in batch.columns)
            rows = [(k, d, s + i, p[i : i + length]) for k, d, s, p in zip(key, doc, start, piece) for i in range(len(p) - length + 1)]
            columns = list(zip(*rows)) or [[]] * 4
            types = [pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["key", "doc", "start", "string"])

    strings = map_batches(pieces, run, "key long, doc long, start long, string binary")
    named = strings.select("doc", "start", F.unhex(F.sha2("string", 256)).alias("name"))
    first = named.groupBy("name").agg(F.min(F.struct("doc", "start")).alias("first"))
    later = named.join(first, "name").filter(F.struct("doc", "start") > F.col("first"))
    return later.select("doc", "start", F.lit(1).alias("n"))


def repeated_starts(docs: DataFrame, length: int) -> DataFrame:
    """Runs (doc, start, n) of starts in ``docs`` (_doc, _text) whose ``length``-byte string starts earlier.
    Runs may touch, but hold every such start once or more."""
    found = materialize(_first_of_each(_cut(docs, length, secrets.token_bytes(32))), "segments")
    covered = found.filter(F.col("kind") == COVERED).select("doc", "start", "n")
    pieces = materialize(_bytes_of(found.filter(F.col("kind") == WHOLE), docs, length), "pieces")
    large = materialize(pieces.groupBy("key").count().filter(F.col("count") > GROUP).select("key"), "large")
    common = pieces.join(large, "key", "left_anti")
    return covered.unionByName(_indexed(common, length)).unionByName(_one_by_one(pieces.join(large, "key"), length))


def _numbered(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """``docs`` with ``_doc``, a number that orders them (the id itself if every row has its own), and the
    different documents as (_doc, _text)."""
    number = F.col(id_col).cast("long")
    ids = docs.select(number.alias("i")).groupBy("i").agg(F.count(F.lit(1)).alias("n"))
    if ids.filter("i is null or n > 1").isEmpty():
        numbered = docs.withColumn("_doc", number)
        return numbered, numbered.select("_doc", F.col(text_col).alias("_text"))
    kept = materialize(docs.withColumn("_sum", F.sha2(F.coalesce(F.col(text_col).cast("binary"), F.lit(b"")), 256)), "documents")
    distinct = kept.select(number.alias("i"), F.col("_sum").alias("s")).distinct()
    ranked = running_totals(distinct, [F.col("i").asc_nulls_first(), F.col("s")]).select("i", "s", F.col("rank").alias("_doc"))
    same = number.eqNullSafe(F.col("i")) & (F.col("_sum") == F.col("s"))
    numbered = materialize(kept.join(ranked, same).drop("i", "s", "_sum"), "numbered")
    return numbered, numbered.select("_doc", F.col(text_col).alias("_text")).dropDuplicates(["_doc"])


def remove_repeats(docs: DataFrame, length: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Add ``removed``, the runs of bytes (start, end) covered by ``length``-byte strings that also start
    earlier (in a smaller id, or in the same text further left), and ``kept``, the bytes that remain.

    Strings are judged on the input texts and never cross them. All rows and columns stay; columns
    of these two names are replaced. Null and empty texts, and texts shorter than ``length``, lose
    nothing. Null ids come first in the order; rows that repeat an id are ordered by a hash of their
    text, and rows that also repeat the text are one document and lose the same.
    """
    docs = docs.drop("removed", "kept")
    numbered, different = _numbered(docs, id_col, text_col)
    starts = repeated_starts(different, length)
    runs = starts.groupBy("doc").agg(F.collect_list(F.struct("start", "n")).alias("_runs")).withColumnRenamed("doc", "_doc")
    joined = numbered.join(runs, "_doc", "left")
    spans = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.schema.names.index(text_col)).to_pylist()
            removed, kept = [], []
            for text, own in zip(texts, batch.column(batch.schema.names.index("_runs")).to_pylist()):
                text = text.encode() if isinstance(text, str) else text or b""
                gone, left, at = [], [], 0
                for start, end in sorted((r["start"], r["start"] + r["n"] + length - 1) for r in own or ()):
                    if gone and start <= gone[-1]["end"]:
                        gone[-1]["end"] = max(end, gone[-1]["end"])
                    else:
                        gone.append({"start": start, "end": end})
                for run in gone:
                    left.append(text[at : run["start"]])
                    at = run["end"]
                removed.append(gone)
                kept.append(b"".join([*left, text[at:]]))
            yield appended(batch, {"removed": pa.array(removed, spans), "kept": pa.array(kept, pa.binary())}).drop_columns(["_doc", "_runs"])

    made = with_fields(docs, ("removed", "array<struct<start:long,end:long>>"), ("kept", "binary"))
    return map_batches(joined, cut, made)
