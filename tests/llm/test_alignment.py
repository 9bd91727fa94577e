"""Alignments against plain byte ranges over all pairs of tokens."""

import hashlib
from bisect import bisect_left
from collections import Counter, defaultdict

import numpy as np
import pytest

from seedscape.llm import alignment
from seedscape.llm.queries import BYTE_BPE, PIECES, QUERIES

SF = "/root/testdata/sf0.001"


def tokens_of(text):
    """(id, start, end) of each token of A and B; none if the bytes are not those of a space and the text."""
    both = alignment.pair(BYTE_BPE, PIECES)
    if not text:
        return [], []
    made = []
    given = (" " + text).encode()
    for ids, names in ((both.a.encode(" " + text, add_special_tokens=False).ids, both.a_bytes), (both.b.encode(text), both.b_bytes)):
        at, spans = 0, []
        for i in ids:
            spans.append((i, at, at + len(names[i])))
            at += len(names[i])
        if b"".join(names[i] for i in ids) != given:
            return [], []
        made.append(spans)
    return made


def expected(rows):
    """The contract in plain loops: (doc_id, n_a, n_b, n_groups, n_links, groups, n_best, count_sum)."""
    found, held = [], Counter()
    for doc_id, text in rows:
        a, b = tokens_of(text)
        links, low = [], 0
        for i, start, end in a:
            while low < len(b) and b[low][2] <= start:
                low += 1
            links += _near(i, start, end, b, low)
        cuts = sorted({e for _, _, e in a} & {e for _, _, e in b})
        a_at, b_at = ([start for _, start, _ in side] for side in (a, b))
        groups, last = [], 0
        for cut in cuts:
            inside = [",".join(str(i) for i, _, _ in side[bisect_left(at, last) : bisect_left(at, cut)]) for side, at in ((a, a_at), (b, b_at))]
            groups.append("|".join(inside))
            last = cut
        held.update(set(links))
        found.append((doc_id, len(a), len(b), links, groups))
    most = defaultdict(int)
    for (a, _), n in held.items():
        most[a] = max(most[a], n)
    return [
        (d, n_a, n_b, len(groups), len(links), ";".join(groups), sum(held[x] == most[x[0]] for x in links), sum(held[x] for x in links))
        for d, n_a, n_b, links, groups in found
    ]


def _near(i, start, end, b, low):
    made = []
    while low < len(b) and b[low][1] < end:
        made.append((i, b[low][0]))
        low += 1
    return made


def rows_of(made):
    return [tuple(r) for r in made.collect()]


ODD = [None, "", " ", "  two  spaces \n\n x ", "<|endoftext|> <s></s> <0x41>", "東京 tower résumé größe", "a▁b", "😀😀 é", "tab\tand\r\nlines", "z" * 3000]


@pytest.fixture()
def odd(spark):
    rows = [(i if i != 3 else None, t, "x") for i, t in enumerate(ODD + ODD)]
    return spark.createDataFrame(rows, "doc_id long, text string, groups string"), [(r[0], r[1]) for r in rows]


@pytest.mark.parametrize("block", [(1 << 17, 2048), (20, 3)])
def test_against_plain_ranges(spark, odd, monkeypatch, block):
    frame, rows = odd
    monkeypatch.setattr(alignment, "BLOCK_PAIRS", block[0])
    monkeypatch.setattr(alignment, "BLOCK_DOCS", block[1])
    assert sorted(map(str, rows_of(alignment.align(frame, BYTE_BPE, PIECES)))) == sorted(map(str, expected(rows)))


def test_query_against_plain_ranges(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    wanted = [(*r[:5], hashlib.sha256(r[5].encode()).hexdigest() if r[1] else "", *r[6:]) for r in expected(docs)]
    made = QUERIES["op13_tokenizer_alignment"](spark, SF)
    assert made.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "n_best", "count_sum"]
    assert sorted(rows_of(made)) == sorted(wanted)


def test_pieces_of_long_texts_encode_as_the_whole(monkeypatch):
    both = alignment.pair(BYTE_BPE, PIECES)
    text = "Some words, 12 numbers and  double  spaces; it's mixed: résumé 東京.\n\n\tNew line " * 400
    whole = [x.tolist() for x in next(both.encode([text]))]
    monkeypatch.setattr(alignment, "PIECE", 500)
    assert len(both.pieces(text)) > 20
    assert [x.tolist() for x in next(both.encode([text]))] == whole
    assert "z" * 5000 == "".join(both.pieces("z" * 5000))


def test_windows_are_remembered_and_forgotten(monkeypatch):
    windows = alignment.Windows(alignment.pair(BYTE_BPE, PIECES))
    a, b = next(windows.of.encode(["the same words and the same words again"]))
    kinds, which = windows.aligned(a, b, *windows.bounds(a, b))
    assert len(which) == 8 and len(kinds) == 5 == len(windows.lately)
    monkeypatch.setattr(alignment, "WINDOWS", 2)
    again, same = windows.aligned(a, b, *windows.bounds(a, b))
    assert (again, same.tolist()) == (kinds, which.tolist())
    a, b = next(windows.of.encode(["other words entirely"]))
    windows.aligned(a, b, *windows.bounds(a, b))
    assert len(windows.lately) <= 2 and len(windows.before) in (2, 5)


def test_equal_sums_of_different_windows_are_noticed(monkeypatch):
    """With factors of 1 the sums of permuted ids are equal; the ids then tell the windows apart."""
    ends = np.array([2, 4])
    monkeypatch.setattr(alignment.np.random, "default_rng", lambda seed: type("R", (), {"integers": lambda *x: np.zeros(2, np.int64)})())
    first, which = alignment._different((np.array([1, 2, 2, 1], np.int32), ends), (np.array([5, 5, 5, 5], np.int32), ends))
    assert first.tolist() == which.tolist() == [0, 1]


def test_both_ways_to_encode_give_the_same_ids(spark):
    both = alignment.pair(BYTE_BPE, PIECES)
    texts = [r.text or "" for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect()]
    assert both.by_rank is not None
    for text in texts:
        assert both._encode_a(" " + text) == both.a.encode(" " + text, add_special_tokens=False).ids
    assert alignment.UNUSUAL.search("a\u00a0b") and alignment.UNUSUAL.search("\x1c") and not alignment.UNUSUAL.search("Größe, ñ\n")


def test_no_documents(odd):
    assert alignment.align(odd[0].limit(0), BYTE_BPE, PIECES).count() == 0
