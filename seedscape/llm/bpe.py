"""Byte-level BPE encoding and decoding of texts of any length.

Pre-tokens never depend on what lies left of them, so two scans of a text that share
a boundary agree from there on. A long text is therefore cut into overlapping chunks
that are pre-tokenised apart from each other, on whichever executor; two neighbours
are stitched at the first boundary in their overlap that both have found, and the
pieces between the stitches are encoded, again apart. Decoding concatenates bytes.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from seedscape.llm.common import appended, map_batches, with_fields
from seedscape.scratch import materialize

#: Characters of a chunk and of the overlap with the next.
CHUNK, OVERLAP = 32_768, 1_024
#: How many characters behind a boundary can still move it, at most (contractions, look-ahead).
LOOK_AHEAD = 8


@lru_cache(maxsize=2)
def tokenizer(ranks_path: str, pattern: str) -> tiktoken.Encoding:
    """The tokenizer of a rank file, without special tokens. Each worker loads it once."""
    with open(ranks_path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


@lru_cache(maxsize=2)
def token_bytes(ranks_path: str) -> dict[int, bytes]:
    with open(ranks_path, "rb") as lines:
        return {int(rank): base64.b64decode(token) for token, rank in map(bytes.split, lines)}


def boundaries(pattern: regex.Pattern, text: str, is_last: bool) -> list[int]:
    """Ends of the pre-tokens of ``text`` at which it may be cut.

    Not those that text behind the chunk could move, nor those behind white space,
    whose pre-token looks at the next character. The end of the last chunk counts.
    """
    sure = len(text) if is_last else len(text) - LOOK_AHEAD
    ends = [m.end() for m in pattern.finditer(text) if m.end() <= sure and not text[m.end() - 1].isspace()]
    return [*ends, len(text)] if is_last and (not ends or ends[-1] != len(text)) else ends


def cut_chunks(texts: DataFrame, pattern: str, size: int, overlap: int) -> DataFrame:
    """Chunks of texts (key, text), pre-tokenised: ``head`` and ``tail`` are the boundaries in the
    overlaps with the chunk before and the one behind, as positions in the text."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, text in zip(*(c.to_pylist() for c in batch.columns)):
                for no, start in enumerate(range(0, max(len(text), 1), size)):
                    end = start + size + overlap
                    yield pa.RecordBatch.from_pydict(
                        {
                            "key": [key],
                            "no": pa.array([no], pa.int32()),
                            "start": pa.array([start], pa.int64()),
                            "length": pa.array([len(text)], pa.int64()),
                            "is_last": [end >= len(text)],
                            "chunk": [text[start:end]],
                        }
                    )

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled = regex.compile(pattern)
        for batch in batches:
            heads, tails = [], []
            for start, chunk, is_last in zip(*(batch.column(n).to_pylist() for n in ("start", "chunk", "is_last"))):
                ends = boundaries(compiled, chunk, is_last)
                heads.append([start + p for p in ends if p <= overlap or (is_last and p == len(chunk))])
                tails.append([start + p for p in ends if p >= size])
            kind = pa.list_(pa.int64())
            yield appended(batch, {"head": pa.array(heads, kind), "tail": pa.array(tails, kind)})

    chunks = map_batches(texts, cut, "key string, no int, start long, length long, is_last boolean, chunk string")
    spread = chunks.repartition("key", "no")
    return map_batches(spread, scan, with_fields(spread, ("head", "array<long>"), ("tail", "array<long>")))


def stitches(chunks: DataFrame) -> DataFrame:
    """Where each chunk's piece begins and ends; ``begin`` is null if the overlap holds no common boundary."""
    in_text = W.partitionBy("key").orderBy("no")
    shared = F.array_min(F.array_intersect("head", F.lag("tail").over(in_text)))
    begins = chunks.select("key", "no", "head", "tail", "length").withColumn(
        "begin", F.when(F.col("no") == 0, F.lit(0).cast("long")).otherwise(shared)
    )
    ends = F.coalesce(F.lead("begin").over(in_text), F.when(F.lead("no").over(in_text).isNull(), F.col("length")))
    return begins.withColumn("end", ends).select("key", "no", "begin", "end")


def encode_long(texts: DataFrame, ranks_path: str, pattern: str, size: int, overlap: int, count: bool) -> DataFrame:
    """Token ids of long texts (key, text) as (key, tokens)."""
    done, left = None, texts
    while True:
        chunks = materialize(cut_chunks(left, pattern, size, overlap), "chunks")
        cuts = materialize(stitches(chunks), "stitches")
        open_keys = cuts.filter("begin is null or end is null").select("key").distinct()
        ready = chunks.join(cuts.join(open_keys, "key", "left_anti"), ["key", "no"])

        def encode_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            encode = tokenizer(ranks_path, pattern).encode_ordinary
            for batch in batches:
                rows = zip(*(batch.column(n).to_pylist() for n in ("chunk", "start", "begin", "end")))
                ids = [encode(chunk[begin - start : end - start]) for chunk, start, begin, end in rows]
                made = pa.array([[len(x)] for x in ids] if count else ids, pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("no"), made], names=["key", "no", "ids"])

        pieces = map_batches(
            ready.select("key", "no", "chunk", "start", "begin", "end"), encode_pieces, "key string, no int, ids array<int>"
        )
        whole = pieces.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("no", "ids"))).alias("parts"))
        whole = whole.select("key", F.flatten("parts.ids").alias("tokens"))
        done = whole if done is None else done.unionByName(whole)
        if open_keys.isEmpty():
            return done
        left = left.join(open_keys, "key", "left_semi")  # a run without a boundary longer than the overlap
        size, overlap = size * 16, overlap * 16


def encode(
    docs: DataFrame,
    ranks_path: str,
    pattern: str,
    text_col: str = "text",
    out_col: str = "ids",
    count: bool = False,
    size: int = CHUNK,
    overlap: int = OVERLAP,
    decoded_col: str | None = None,
) -> DataFrame:
    """Add the token ids of ``text_col`` as ``out_col`` (array<int>), or their number (long) if ``count``.

    With ``decoded_col`` the ids are decoded in the same pass, as :func:`decode` does it.

    All rows and columns stay, repeated rows too; a column named ``out_col`` is replaced.
    A null text counts as empty; an empty text has no tokens. ``ranks_path`` must open on
    every worker. ``overlap`` may be half of ``size`` at most.
    """
    if overlap * 2 > size:
        raise ValueError("the overlap may be half of a chunk at most")
    if count and decoded_col:
        raise ValueError("numbers of tokens cannot be decoded")
    docs = docs.drop(out_col, *([decoded_col] if decoded_col else []))
    kind = "long" if count else "array<int>"
    is_long = F.coalesce(F.length(text_col) > size + overlap, F.lit(False))

    def encode_short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = tokenizer(ranks_path, pattern).encode_ordinary
        for batch in batches:
            ids = [encoding(text or "") for text in batch.column(text_col).to_pylist()]
            made = {out_col: pa.array(map(len, ids), pa.int64()) if count else pa.array(ids, pa.list_(pa.int32()))}
            if decoded_col:
                vocabulary = token_bytes(ranks_path)
                made[decoded_col] = pa.array([b"".join(map(vocabulary.__getitem__, x)) for x in ids], pa.binary())
            yield appended(batch, made)

    added = [(out_col, kind), *([(decoded_col, "binary")] if decoded_col else [])]
    short = map_batches(docs.filter(~is_long), encode_short, with_fields(docs, *added))
    long = docs.filter(is_long).withColumn("_bpe_key", F.sha2(text_col, 256))
    texts = long.groupBy(F.col("_bpe_key").alias("key")).agg(F.first(text_col).alias("text"))
    tokens = encode_long(texts, ranks_path, pattern, size, overlap, count)
    made = F.aggregate("tokens", F.lit(0).cast("long"), lambda a, b: a + b) if count else F.col("tokens")
    tokens = tokens.select(F.col("key").alias("_bpe_key"), made.alias(out_col))
    found = long.join(tokens, "_bpe_key").drop("_bpe_key")
    return short.unionByName(decode(found, ranks_path, out_col, decoded_col) if decoded_col else found)


def decode(df: DataFrame, ranks_path: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """Add the bytes that the ids of ``ids_col`` stand for as ``out_col`` (binary).

    Null ids, or a list that holds a null or an id outside the vocabulary, give null.
    """
    df = df.drop(out_col)

    def join_bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = token_bytes(ranks_path)

        def joined(ids: list[int] | None) -> bytes | None:
            try:
                return None if ids is None else b"".join(map(vocabulary.__getitem__, ids))
            except KeyError:
                return None

        for batch in batches:
            made = [joined(ids) for ids in batch.column(ids_col).to_pylist()]
            yield appended(batch, {out_col: pa.array(made, pa.binary())})

    return map_batches(df, join_bytes, with_fields(df, (out_col, "binary")))
