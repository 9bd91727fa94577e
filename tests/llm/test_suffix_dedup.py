import hashlib
import random

import numpy as np
import pytest

from seedscape.llm import suffix_dedup
from seedscape.llm.run_index import RunIndex


def brute(rows, length):
    """Removed runs and kept bytes of (order, bytes) rows."""
    seen, out = set(), {}
    for key, text in sorted(set(rows)):
        gone = bytearray(len(text))
        for i in range(len(text) - length + 1):
            window = text[i : i + length]
            if window in seen:
                gone[i : i + length] = b"\1" * length
            seen.add(window)
        spans, at = [], 0
        for part in bytes(gone).split(b"\0"):
            if part:
                spans.append((at, at + len(part)))
            at += len(part) + 1
        out[key] = (spans, bytes(t for t, g in zip(text, gone) if not g))
    return out


def order(doc_id, text):
    return (doc_id is not None, doc_id or 0, hashlib.sha256(text).hexdigest())


@pytest.mark.parametrize("length", [5, 12, 100])
def test_equals_brute_force(docs, length, monkeypatch):
    given = [(r.doc_id, (r.text or "").encode()) for r in docs.collect()]
    expected = brute([(order(*g), g[1]) for g in given], length)
    for name, value in (("INDEX_BYTES", 2_000), ("GROUP", 30), ("HASH_BYTES", 700), ("HASH_BYTES", 700)):
        found = suffix_dedup.remove_repeats(docs, length)
        rows = found.collect()
        assert len(rows) == len(given) and set(found.columns) == {*docs.columns, "removed", "kept"}
        for r in rows:
            spans, kept = expected[order(r.doc_id, (r.text or "").encode())]
            assert ([(s["start"], s["end"]) for s in r.removed], bytes(r.kept)) == (spans, kept)
        monkeypatch.setattr(suffix_dedup, name, value)


def test_periodic_texts_and_shared_passages(spark, monkeypatch):
    rng = random.Random(4)
    passage = "".join(rng.choices("abcdefgh ", k=400))
    texts = ["a" * 700, "b" + "a" * 300, "ab" * 300, passage, passage[50:350] * 3, "", "a" * 99]
    for i in range(60):
        a = rng.randint(0, 250)
        texts.append("".join(rng.choices("xyz", k=30)) + passage[a : a + rng.randint(80, 150)] + "".join(rng.choices("xyz", k=120)))
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    expected = brute([(i, t.encode()) for i, t in enumerate(texts)], 100)
    for group in (8_192, 10):
        monkeypatch.setattr(suffix_dedup, "GROUP", group)
        for r in suffix_dedup.remove_repeats(frame, 100).collect():
            assert ([(s["start"], s["end"]) for s in r.removed], bytes(r.kept)) == expected[r.doc_id]


def test_empty_table(no_docs):
    assert suffix_dedup.remove_repeats(no_docs).count() == 0


def test_segments_hold_every_start_once():
    rng = random.Random(6)
    texts = [bytes(rng.choices(b"ab", k=rng.choice([0, 3, 40, 300]))) for _ in range(30)]
    for length in (1, 7, 64, 100):
        number, start, count, key, name, tied = suffix_dedup.segments(texts, length)
        found = sorted((int(i), int(s) + j) for i, s, n in zip(number, start, count) for j in range(n))
        assert found == [(i, j) for i, t in enumerate(texts) for j in range(len(t) - length + 1)]
        assert count.max(initial=0) <= suffix_dedup.SPAN
        keys = {}
        for i, s, n, k in zip(number, start, count, key):
            for j in range(s, s + n):
                assert keys.setdefault(texts[i][j : j + length], k) == k


def test_run_index():
    rng = random.Random(1)
    for _ in range(60):
        letters = rng.choice([b"ab", b"a", b"abc\0", bytes(range(256))])
        base = bytes(rng.choices(letters, k=rng.randint(0, 60)))
        strings = []
        for _ in range(rng.randint(0, 8)):
            a = rng.randint(0, len(base))
            strings.append(base[a : rng.randint(a, len(base))] + bytes(rng.choices(letters, k=rng.randint(0, 9))))
        length = rng.randint(1, 12)
        seen, earlier, longest = set(), [], []
        for s in strings:
            for i in range(len(s) + 1):
                window = s[i : i + length]
                earlier.append(len(window) == length and window in seen)
                seen.add(window)
                others = [t[j:] for t in strings for j in range(len(t)) if (t is not s or j != i)]
                longest.append(max((_common(s[i:], o) for o in others), default=0))
        index = RunIndex(strings)
        assert index.repeats_earlier(length).tolist() == earlier
        if len(set(map(id, strings))) == len(strings):
            assert index.matching_statistics().tolist() == longest


def _common(a, b):
    n = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    return n


def test_index_of_copies_has_few_runs():
    text = bytes(np.random.default_rng(1).integers(97, 123, 500, np.uint8))
    assert RunIndex([text] * 50).runs < 3 * RunIndex([text]).runs


def test_names_depend_on_the_key_and_tell_bytes_apart():
    rng = random.Random(8)
    texts = [bytes(rng.choices(b"ab", k=300)) for _ in range(20)] * 2
    by_key = []
    for secret in (b"one", b"two"):
        number, start, count, _, name, _ = suffix_dedup.segments(texts, 20, secret)
        pieces = [texts[i][s : s + n + 19] for i, s, n in zip(number, start, count)]
        assert len(set(zip(pieces, name.tolist()))) == len(set(pieces)) == len(set(name.tolist()))
        by_key.append(set(name.tolist()))
    assert not by_key[0] & by_key[1]


def test_sequences_that_make_polynomial_hashes_collide(spark, monkeypatch):
    """Thue-Morse sequences and their complements have equal polynomial hashes in wrapping arithmetic from some length on."""
    even = "".join("ab"[bin(i).count("1") % 2] for i in range(4096))
    odd = even.translate(str.maketrans("ab", "ba"))
    texts = [even[:2048], odd[:2048], even + odd, odd[1000:3000]]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for length in (100, 1500):
        expected = brute([(i, t.encode()) for i, t in enumerate(texts)], length)
        for r in suffix_dedup.remove_repeats(frame, length).collect():
            assert ([(s["start"], s["end"]) for s in r.removed], bytes(r.kept)) == expected[r.doc_id]
