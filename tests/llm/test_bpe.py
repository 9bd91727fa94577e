import random

import public_tokenizers
import pytest
import regex

from seedscape.llm import bpe, token_counts

RANKS, PATTERN = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def expected(text):
    return bpe.tokenizer(RANKS, PATTERN).encode_ordinary(text or "")


@pytest.mark.parametrize("size, overlap", [(32_768, 1_024), (64, 16), (16, 2)])
def test_ids_equal_the_whole_text_at_once(docs, size, overlap):
    rows = bpe.encode(docs, RANKS, PATTERN, size=size, overlap=overlap).collect()
    assert len(rows) == docs.count()
    assert set(rows[0].asDict()) == set(docs.columns)
    for row in rows:
        assert row.ids == expected(row.text)


def test_hard_texts_in_small_chunks(spark):
    rng = random.Random(1)
    alphabet = ["a", "b", " ", "  ", "\n", "'", "'re", "1", ",", "é", "　", "ll"]
    texts = ["".join(rng.choices(alphabet, k=rng.randint(40, 400))) for _ in range(150)] + ["a" * 900, " " * 900, "\n" * 50 + "x" * 50]
    frame = spark.createDataFrame([(t,) for t in texts], "text string")
    for row in bpe.encode(frame, RANKS, PATTERN, size=32, overlap=16).collect():
        assert row.ids == expected(row.text)


def test_counts_and_round_trip(docs):
    coded = bpe.encode(docs, RANKS, PATTERN)
    for row in bpe.decode(coded, RANKS).collect():
        assert bytes(row.decoded) == (row.text or "").encode()
    for row in bpe.encode(docs, RANKS, PATTERN, out_col="n", count=True, size=64, overlap=16).collect():
        assert row.n == len(expected(row.text))


def test_unknown_ids_decode_to_null(spark):
    frame = spark.createDataFrame([([1, 2],), ([],), (None,), ([1, None],), ([10**9],)], "ids array<int>")
    decoded = [r.decoded for r in bpe.decode(frame, RANKS).collect()]
    assert decoded[1] == b"" and decoded[2:] == [None] * 3 and decoded[0]


def test_boundaries_do_not_depend_on_what_follows():
    text = "we're  here\n\n now we'"
    compiled = regex.compile(PATTERN)
    whole = set(bpe.boundaries(compiled, text + "ll see. More text", True))
    assert set(bpe.boundaries(compiled, text, False)) <= whole


def test_empty_table(no_docs):
    assert bpe.decode(bpe.encode(no_docs, RANKS, PATTERN), RANKS).count() == 0
    assert token_counts.length_histogram(no_docs, RANKS, PATTERN).count() == 0


def test_length_histogram(docs, texts):
    lengths = sorted(len(expected(t)) for t in [*texts, texts[0]])
    table = token_counts.length_histogram(docs, RANKS, PATTERN)
    rows = {r.n_tokens: r for r in token_counts.with_limits(table).collect()}
    assert sorted(rows) == sorted(set(lengths))
    for n, row in rows.items():
        assert row.n_docs == lengths.count(n)
        assert row.tokens_total == sum(lengths) and row.docs_total == len(lengths)
        assert row.tokens_from == sum(x for x in lengths if x >= n)
        assert row.kept_tokens == sum(min(x, n) for x in lengths)
        assert row.cut_docs == sum(x > n for x in lengths)
        assert row.quantile == sum(x <= n for x in lengths) / len(lengths)
    for row in token_counts.totals_at(table, [0, 5, 17, 10**6]).collect():
        assert row.kept_tokens == sum(min(x, row.context_limit) for x in lengths)
        assert row.cut_docs == sum(x > row.context_limit for x in lengths)
    for row in token_counts.quantiles(table, [0.0, 0.5, 0.9, 1.0]).collect():
        assert row.n_tokens == next(x for x in lengths if sum(y <= x for y in lengths) >= row.share * len(lengths))
