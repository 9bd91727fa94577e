"""Align two tokenizers: which tokens of one overlap which tokens of the other, and how often in the corpus.

Whole texts are encoded by both. Where tokens of both end at the same byte and both next tokens begin with
a space, the document is cut into windows of ids; such a window is about a word, so the same ones return all
the time, and the alignment of each is remembered under its two tuples of ids.

Documents are packed into blocks that name every pair of ids once. Only these pairs travel: they are counted over the
corpus, and each block gets the counts of its own pairs back.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seedscape.llm.common import map_batches
from seedscape.scratch import materialize

#: Pairs, counted per document, and documents after which a block ends.
BLOCK_PAIRS, BLOCK_DOCS = 1 << 17, 2048
#: Windows remembered as met lately (as many again as met before), and the most ids of a remembered one.
WINDOWS, WINDOW_IDS = 1 << 17, 48
#: Texts longer than this many characters are encoded in pieces cut before a space between two letters, see ``Pair``.
PIECE = 1 << 17
#: Characters of the texts that are encoded at once.
AT_ONCE = 1 << 20

# Fixed value: how byte-level vocabularies of this kind cut a text before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Characters on whose class engines of patterns might differ; texts that hold one are left to A's own library.
UNUSUAL = re.compile("[^\t-\r -~\u00a1-\u024f]")

_DOC = "struct<doc_id:long,n_a:long,n_b:long,n_groups:long,n_links:long,groups:string,at:array<int>,times:array<int>>"
_BLOCKS = f"block long, pairs array<long>, held array<long>, docs array<{_DOC}>"


def byte_level_alphabet() -> dict[str, int]:
    """Byte of each character of byte-level vocabularies: printable bytes stand for themselves, others follow from 256."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


class Pair:
    """A byte-level BPE (A, a tokenizers file) and a piece model (B, a sentencepiece file), with the bytes of their tokens."""

    def __init__(self, a_path: str, b_path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        import tiktoken
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        given = json.load(open(a_path, encoding="utf-8"))
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        byte_of = byte_level_alphabet()
        added = {t["id"] for t in given.get("added_tokens", [])}
        names = {i: token for token, i in self.a.get_vocab().items()}
        self.a_bytes = [
            names.get(i, "").encode() if i in added or i not in names else bytes(byte_of[c] for c in names[i]) for i in range(max(names) + 1)
        ]
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        is_byte = re.compile("<0x([0-9A-F]{2})>")
        self.b_bytes = [bytes.fromhex(m[1]) if (m := is_byte.fullmatch(p)) else p.replace("▁", " ").encode() for p in pieces]
        # where ids follow the order of the merges, merging by rank gives the same ids, and is faster
        vocab = given["model"]["vocab"]
        merged = [vocab["".join(m if isinstance(m, list) else m.split(" "))] for m in given["model"]["merges"]]
        ranks = {self.a_bytes[i]: i for token, i in vocab.items() if i not in added}
        in_order = merged == list(range(len(ranks) - len(merged), len(ranks))) and given["pre_tokenizer"].get("use_regex")
        self.by_rank = tiktoken.Encoding("A", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}) if in_order else None
        # a token in the text of a group, inside its side and at its end
        self.a_parts = np.array([[f"{i}{mark}" for i in range(len(self.a_bytes))] for mark in (",", "|")], object)
        self.b_parts = np.array([[f"{i}{mark}" for i in range(len(self.b_bytes))] for mark in (",", ";")], object)
        self.a_sizes, self.b_sizes = (np.array([len(t) for t in x], np.int64) for x in (self.a_bytes, self.b_bytes))
        self.a_spaced, self.b_spaced = (np.array([t[:1] == b" " for t in x]) for x in (self.a_bytes, self.b_bytes))
        # no piece goes on over a space, so nothing is merged across one: pieces cut there encode as they do in the text
        self.cuts_at_spaces = not any(re.search("[^▁]▁", p) for p in pieces)

    def pieces(self, text: str) -> list[str]:
        """``text`` cut before spaces between two ASCII letters; each piece but the first lacks the space it was cut at."""
        if len(text) <= PIECE or not self.cuts_at_spaces:
            return [text]
        made, start = [], 0
        between = re.compile("(?<=[A-Za-z]) (?=[A-Za-z])")
        while len(text) - start > PIECE and (cut := between.search(text, start + PIECE)):
            made.append(text[start : cut.start()])
            start = cut.end()
        return [*made, text[start:]]

    def _encode_a(self, text: str) -> list[int]:
        if self.by_rank and not UNUSUAL.search(text):
            return self.by_rank.encode_ordinary(text)
        return self.a.encode(text, add_special_tokens=False).ids

    def encode(self, texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Ids of a space and the text by A and of the text by B; both empty where their bytes are not a space and the text."""
        cut = [self.pieces(t) for t in texts]
        flat = [p for pieces in cut for p in pieces]
        a_ids = [self._encode_a(" " + p) for p in flat]
        b_ids = self.b.encode(flat, num_threads=1)
        at = 0
        for text, pieces in zip(texts, cut):
            a = [i for ids in a_ids[at : at + len(pieces)] for i in ids]
            b = [i for ids in b_ids[at : at + len(pieces)] for i in ids]
            at += len(pieces)
            given = b" " + text.encode()
            same = text and b"".join(map(self.a_bytes.__getitem__, a)) == given and b"".join(map(self.b_bytes.__getitem__, b)) == given
            yield (np.array(a, np.int32), np.array(b, np.int32)) if same else (np.zeros(0, np.int32), np.zeros(0, np.int32))


@lru_cache(maxsize=2)
def pair(a_path: str, b_path: str) -> Pair:
    return Pair(a_path, b_path)


def align_windows(a: np.ndarray, b: np.ndarray, a_to: np.ndarray, b_to: np.ndarray, of: Pair) -> list[tuple[str, int, bytes]]:
    """Per window its groups as text, their number, and every overlapping pair as a packed number.

    Windows hold the same bytes on both sides, so all of them are aligned as one sequence. Between two neighbouring
    ends, of whichever side, lies one overlapping pair.
    """
    a_ends, b_ends = np.cumsum(of.a_sizes[a]), np.cumsum(of.b_sizes[b])
    ends = np.union1d(a_ends, b_ends)
    pairs = a[np.searchsorted(a_ends, ends)].astype(np.int64) << 32 | b[np.searchsorted(b_ends, ends)]
    shared = np.intersect1d(a_ends, b_ends, assume_unique=True)
    a_group, b_group = np.searchsorted(shared, a_ends), np.searchsorted(shared, b_ends)
    a_last, b_last = (np.append(group[1:] != group[:-1], True) for group in (a_group, b_group))
    parts = np.concatenate([of.a_parts[a_last.astype(int), a], of.b_parts[b_last.astype(int), b]])
    parts = parts[np.argsort(np.concatenate([2 * a_group, 2 * b_group + 1]), kind="stable")].tolist()

    window_ends = a_ends[a_to - 1]
    part_to, pair_to = (a_to + b_to).tolist(), np.searchsorted(ends, window_ends, side="right").tolist()
    group_to = np.searchsorted(shared, window_ends, side="right")
    sizes, raw = np.diff(group_to, prepend=0).tolist(), pairs.tobytes()
    made, part, pair_ = [], 0, 0
    for to_part, to_pair, n_groups in zip(part_to, pair_to, sizes):
        made.append(("".join(parts[part:to_part])[:-1], n_groups, raw[8 * pair_ : 8 * to_pair]))
        part, pair_ = to_part, to_pair
    return made


class Windows:
    """The alignments of windows, remembered by their ids: those met lately, and those met before them."""

    def __init__(self, of: Pair) -> None:
        self.of = of
        self.lately: dict[tuple[bytes, bytes], tuple[str, int, bytes]] = {}
        self.before: dict[tuple[bytes, bytes], tuple[str, int, bytes]] = {}

    def bounds(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where windows end in the tokens of A and B: shared ends before space-marked tokens, and the end."""
        a_ends, b_ends = np.cumsum(self.of.a_sizes[a]), np.cumsum(self.of.b_sizes[b])
        at_a = np.flatnonzero(self.of.a_spaced[a[1:]])  # tokens with a space-marked one behind
        at_b = np.searchsorted(b_ends, a_ends[at_a])
        good = b_ends[at_b] == a_ends[at_a]
        at_a, at_b = at_a[good], at_b[good]
        good = self.of.b_spaced[b[at_b + 1]]
        return np.append(at_a[good] + 1, len(a)), np.append(at_b[good] + 1, len(b))

    def aligned(self, a: np.ndarray, b: np.ndarray, a_to: np.ndarray, b_to: np.ndarray) -> tuple[list[tuple[str, int, bytes]], np.ndarray]:
        """The different windows, aligned, and for each window which one it is."""
        first, which = _different((a, a_to), (b, b_to))
        a_raw, b_raw = a.tobytes(), b.tobytes()
        found: list = []
        new: list[tuple] = []
        for i, to_a, j, to_b in zip(_starts(a_to)[first].tolist(), a_to[first].tolist(), _starts(b_to)[first].tolist(), b_to[first].tolist()):
            key = (a_raw[4 * i : 4 * to_a], b_raw[4 * j : 4 * to_b])
            known = self.lately.get(key)
            if known is None and (known := self.before.get(key)) is None:
                new.append((len(found), key))
            found.append(known)
        if new:
            sides = [b"".join(key[side] for _, key in new) for side in (0, 1)]
            sizes = [np.cumsum([len(key[side]) // 4 for _, key in new]) for side in (0, 1)]
            made = align_windows(*(np.frombuffer(raw, np.int32) for raw in sides), *sizes, self.of)
            for (at, key), known in zip(new, made):
                found[at] = known
                if len(key[0]) + len(key[1]) <= 4 * WINDOW_IDS:
                    if len(self.lately) >= WINDOWS:
                        self.before, self.lately = self.lately, {}
                    self.lately[key] = known
        return found, which


def _starts(ends: np.ndarray) -> np.ndarray:
    return np.append(0, ends[:-1])


def _different(*sides: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Places of the first of each kind of window, and the kind of every window, by the ids of both ``sides`` (ids, ends).

    Windows are told apart by sums of their ids, each times a number for its place; then the ids themselves are compared.
    """
    rng = np.random.default_rng(13)
    keys = []
    for ids, ends in sides:
        starts = _starts(ends)
        sizes = ends - starts
        factors = rng.integers(1, 1 << 62, int(sizes.max()), np.int64) * 2 + 1
        place = np.arange(len(ids)) - np.repeat(starts, sizes)
        keys += [np.add.reduceat((ids + 1) * factors[place], starts), sizes]
    order = np.lexsort(keys)
    new = np.ones(len(order), bool)
    new[1:] = np.any([k[order][1:] != k[order][:-1] for k in keys], axis=0)
    which = np.empty(len(order), np.int64)
    which[order] = np.cumsum(new) - 1
    first = order[new]
    for ids, ends in sides:
        starts = _starts(ends)
        sizes = ends - starts
        place = np.arange(len(ids)) - np.repeat(starts, sizes)
        if not np.array_equal(ids, ids[np.repeat(starts[first[which]], sizes) + place]):
            return np.arange(len(order)), np.arange(len(order))
    return first, which


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[str]]]:
    """Ids and texts of a few documents at a time."""
    for batch in batches:
        ids, texts, size = [], [], 0
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            ids.append(doc_id)
            texts.append(text.as_py() or "")
            size += len(texts[-1])
            if size >= AT_ONCE:
                yield ids, texts
                ids, texts, size = [], [], 0
        if ids:
            yield ids, texts


def _documents(ids: list, encoded: list[tuple[np.ndarray, np.ndarray]], windows: Windows, digest: bool) -> Iterator[tuple]:
    """(doc_id, n_a, n_b, n_groups, n_links, groups, pairs, times) of each document."""
    a_sizes, b_sizes = ([len(x[k]) for x in encoded] for k in (0, 1))
    none = np.zeros(0, np.int64)
    if not sum(a_sizes):
        yield from ((doc_id, 0, 0, 0, 0, "", none, none) for doc_id in ids)
        return
    a, b = (np.concatenate([x[k] for x in encoded]) for k in (0, 1))
    # texts begin with a space in both encodings, so a window ends where a document does
    a_to, b_to = windows.bounds(a, b)
    kinds, which = windows.aligned(a, b, a_to, b_to)
    last = np.searchsorted(a_to, np.cumsum(a_sizes), side="right")
    sizes = np.array([len(k[2]) // 8 for k in kinds])
    links, starts = np.frombuffer(b"".join(k[2] for k in kinds), np.int64), np.cumsum(sizes) - sizes
    n_groups, texts, chosen = np.array([k[1] for k in kinds]), [k[0] for k in kinds], which.tolist()
    for k, doc_id in enumerate(ids):
        if not a_sizes[k]:
            yield doc_id, 0, 0, 0, 0, "", none, none
            continue
        low, high = int(last[k - 1]) if k else 0, int(last[k])
        own, often = np.unique(which[low:high], return_counts=True)
        at = np.arange(sizes[own].sum()) + np.repeat(starts[own] - np.cumsum(sizes[own]) + sizes[own], sizes[own])
        pairs, place = np.unique(links[at], return_inverse=True)
        times = np.bincount(place, np.repeat(often, sizes[own])).astype(np.int64)
        groups = ";".join(map(texts.__getitem__, chosen[low:high]))
        text = hashlib.sha256(groups.encode()).hexdigest() if digest else groups
        yield doc_id, a_sizes[k], b_sizes[k], int(n_groups[own] @ often), int(times.sum()), text, pairs, times


def _block(number: int, docs: list[tuple]) -> pa.RecordBatch:
    sizes = [len(d[6]) for d in docs]
    pairs, place, held = np.unique(np.concatenate([d[6] for d in docs]), return_inverse=True, return_counts=True)
    ends = pa.array(np.cumsum([0, *sizes]), pa.int32())
    inner = [
        pa.array([d[0] for d in docs], pa.int64()),
        *[pa.array([d[k] for d in docs], pa.int64()) for k in (1, 2, 3, 4)],
        pa.array([d[5] for d in docs], pa.string()),
        pa.ListArray.from_arrays(ends, pa.array(place.astype(np.int32))),
        pa.ListArray.from_arrays(ends, pa.array(np.concatenate([d[7] for d in docs]).astype(np.int32))),
    ]
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups", "at", "times"]
    one = lambda values: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
    columns = [pa.array([number], pa.int64()), one(pa.array(pairs)), one(pa.array(held.astype(np.int64)))]
    columns.append(one(pa.StructArray.from_arrays(inner, names=names)))
    return pa.RecordBatch.from_arrays(columns, names=["block", "pairs", "held", "docs"])


def link_blocks(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text", digest: bool = False) -> DataFrame:
    """Documents in blocks (block, pairs, held, docs): the distinct pairs of ids linked in the block, how many of
    its documents hold each, and the documents with their counts, groups, and places and occurrences of their pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = pair(a_path, b_path)
        windows = Windows(both)
        number = TaskContext.get().partitionId() << 32
        waiting: list[tuple] = []
        size = 0
        for ids, texts in _texts(batches):
            for made in _documents(ids, list(both.encode(texts)), windows, digest):
                waiting.append(made)
                size += len(waiting[-1][6])
                if size >= BLOCK_PAIRS or len(waiting) >= BLOCK_DOCS:
                    yield _block(number, waiting)
                    waiting, size, number = [], 0, number + 1
        if waiting:
            yield _block(number, waiting)

    given = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return materialize(map_batches(given, run, _BLOCKS), "links")


def pair_counts(blocks: DataFrame) -> DataFrame:
    """(pair, a, b, n_docs, best): documents that hold a linked pair of ids, and whether no other pair with its ``a`` is in more."""
    seen = blocks.select(F.explode(F.arrays_zip("pairs", "held")).alias("x")).select("x.pairs", "x.held")
    counts = materialize(seen.groupBy(F.col("pairs").alias("pair")).agg(F.sum("held").alias("n_docs")), "counts")
    named = counts.withColumn("a", F.shiftright("pair", 32)).withColumn("b", F.col("pair").bitwiseAND((1 << 32) - 1))
    most = named.groupBy("a").agg(F.max("n_docs").alias("most"))
    return named.join(most, "a").select("pair", "a", "b", "n_docs", (F.col("n_docs") == F.col("most")).alias("best"))


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents of a block with the counts of their links added up."""
    for batch in batches:
        for row in range(len(batch)):
            docs = batch.column(0)[row].values
            found = batch.column(1)[row].values
            *columns, at, times = docs.flatten()
            n_best, count_sum = np.zeros(len(docs), np.int64), np.zeros(len(docs), np.int64)
            if found is not None and len(found):
                place, n_docs, best = found.flatten()
                order = np.argsort(place.to_numpy())
                counts, best = n_docs.to_numpy()[order], best.to_numpy(zero_copy_only=False)[order]
                of = np.repeat(np.arange(len(docs)), np.diff(at.offsets.to_numpy()))
                place, often = at.flatten().to_numpy(), times.flatten().to_numpy().astype(np.int64)
                np.add.at(n_best, of, often * best[place])
                np.add.at(count_sum, of, often * counts[place])
            names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups", "n_best", "count_sum"]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(n_best), pa.array(count_sum)], names=names)


def align(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text", digest: bool = False) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, groups, n_best, count_sum) of every row.

    Tokens are those of a space and the text, by A and by B. ``groups`` lists the stretches between bytes where tokens of
    both end, as ``a1,a2|b1;a3|b2``, or its SHA-256 if ``digest``. Links are all pairs of tokens whose
    bytes overlap; ``count_sum`` adds up, over a document's links, how many documents hold that pair of ids linked, and
    ``n_best`` counts the links whose pair is, with ties, in the most documents of all with that id of A. Texts that are null or empty, or
    that a tokenizer does not give back byte by byte, have no tokens: zeros and an empty string. Very long texts are
    encoded in pieces that encode alike. Null and repeated ids are rows like any other; no rows give no rows. Other columns take no part.
    """
    blocks = link_blocks(docs, a_path, b_path, id_col, text_col, digest)
    counts = materialize(pair_counts(blocks), "pairs")
    asked = blocks.select("block", F.posexplode("pairs").alias("at", "pair"))
    found = asked.join(counts.select("pair", "n_docs", "best"), "pair").groupBy("block")
    answers = found.agg(F.collect_list(F.struct("at", "n_docs", "best")).alias("found"))
    met = blocks.select("block", "docs").join(answers, "block", "left").select("docs", "found")
    schema = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups string, n_best long, count_sum long"
    return map_batches(met, _sums, schema)
