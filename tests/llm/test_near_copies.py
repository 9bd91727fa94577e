"""Near copies against true similarities over all pairs."""

import random

import numpy as np
import pytest

from seedscape.llm import near_copies as nc


def graded(seed=11):
    """Texts and copies that differ in ever more words, short and long, a large group of copies, and a common line."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=6))
    line = [word() for _ in range(12)]
    made = []
    for length, copies, most in [(19, 3, 2)] * 12 + [(60, 5, 3)] * 10 + [(300, 6, 20)] * 10 + [(200, 40, 6)]:
        words = [word() for _ in range(length)] + (line if rng.random() < 0.6 else [])
        made.append(words)
        for _ in range(copies):
            changed = list(words)
            for at in rng.sample(range(length), rng.randint(1, most)):
                changed[at] = word()
            made.append(changed)
    rng.shuffle(made)
    return [" ".join(words) for words in made]


def shingles(text, size=5):
    words = text.split()
    return frozenset(" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1)))


def alike_pairs(texts, low, high=2.0):
    sets = [shingles(t) for t in texts]
    share = lambda x, y: len(x & y) / len(x | y)
    return [(i, j) for j in range(len(sets)) for i in range(j) if low <= share(sets[i], sets[j]) < high]


def smallest(n, pairs):
    root = list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in pairs:
        x, y = find(i), find(j)
        root[max(x, y)] = min(x, y)
    return [find(i) for i in range(n)]


def found_components(spark, texts):
    rows = nc.near_copies(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    return [name for _, name in sorted((r.doc_id, r.component_id) for r in rows)]


@pytest.mark.parametrize("block", [512, 5])
def test_components_are_those_of_all_pairs(spark, monkeypatch, block):
    """Pairs all around the similarity, also where clusters and patterns are cut into blocks."""
    monkeypatch.setattr(nc, "LEAST_BLOCK", block)
    monkeypatch.setattr(nc, "MOST_BLOCK", max(block, 8))
    monkeypatch.setattr(nc, "PATTERN_BLOCK", 16_384 if block > 5 else 7)
    texts = graded()
    pairs = alike_pairs(texts, 0.8)
    assert len(pairs) > 150 and len(alike_pairs(texts, 0.7, 0.8)) > 100
    found, wanted = found_components(spark, texts), smallest(len(texts), pairs)
    wrong = sum(a != b for a, b in zip(found, wanted))
    assert wrong <= 1  # one pair in two thousand at the similarity may be missed
    assert all(len({wanted[i] for i in range(len(texts)) if found[i] == f}) == 1 for f in set(found))


def test_every_pair_is_found_in_the_documents(spark):
    """On the driver's documents: components by the true similarity of all pairs that share a shingle."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r.doc_id, frozenset(_shingles(r.text or ""))) for r in docs.collect()]
    held = {}
    for i, (_, s) in enumerate(rows):
        for x in s:
            held.setdefault(x, []).append(i)
    met = {(a, b) for members in held.values() for k, b in enumerate(members) for a in members[:k]}
    share = lambda x, y: len(x & y) / len(x | y)
    empty = [i for i, (_, s) in enumerate(rows) if not s]
    pairs = [(a, b) for a, b in met if share(rows[a][1], rows[b][1]) >= 0.8] + [(empty[0], i) for i in empty]
    names = smallest(len(rows), pairs)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        least[names[i]] = min(doc_id, least.get(names[i], doc_id))
    wanted = {doc_id: least[names[i]] for i, (doc_id, _) in enumerate(rows)}
    found = {r.doc_id: r.component_id for r in nc.near_copies(docs).collect()}
    assert sum(found[i] != wanted[i] for i in wanted) <= 1
    assert len(set(wanted.values())) < len(wanted) - 20


def _shingles(text, size=5):
    words = text.encode().lower().split()
    return {b" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))} if words else set()


def test_sets_and_fingerprints_by_hand():
    words = nc._WordHashes()
    for text in ("a", "b a", "A B c d e f g", " ".join(map(str, range(nc.COUNTED + 50))), "a b c d e " * 9, ""):
        hashed = nc.shingle_set(text.encode(), 5, words)
        assert len(hashed) == len(_shingles(text)) and (np.diff(hashed.astype(object)) > 0).all()
        code = nc.wide_fingerprint(hashed)
        for bit in (0, 1, 2, 63, 64, 129, 255) if text else ():
            word = np.uint64(bit // 64 + 1) * np.uint64(0x9E3779B97F4A7C15)
            ones = int((nc._mixed(hashed + word) >> np.uint64(bit % 64) & np.uint64(1)).sum())
            assert int(code[bit // 64]) >> (bit % 64) & 1 == (2 * ones + bit % 2 > len(hashed))
    assert nc.shingle_set(b"A b C", 5, words).tolist() == nc.shingle_set(b" a\tB\nc ", 5, words).tolist()
    assert nc.shingle_set(b"a b", 5, words).tolist() != nc.shingle_set(b"b a", 5, words).tolist()


def test_masks_cover_what_they_are_made_for():
    """Pairs of random fingerprints that differ as pairs at the similarity do: hardly one is under no mask."""
    rng = np.random.default_rng(1)
    for n in (500, 40_000, 10**6):
        masks = np.array(nc.random_masks(n, 0.8)).view(np.uint64)
        missed = 0
        for _ in range(4000):
            bits = (rng.random(256) < nc.angle(0.8)).astype(np.uint8)
            differing = np.packbits(bits, bitorder="little").view("<u8")
            missed += not ((masks & differing) == 0).all(axis=1).any()
        assert missed <= 12


def test_near_copies_of_odd_rows(docs, texts, no_docs):
    rows = nc.near_copies(docs).collect()
    assert len(rows) == docs.count() and rows[0].asDict().keys() == {"doc_id", "component_id"}
    named = {r.doc_id: r.component_id for r in rows}
    empty = [i for i, t in enumerate(texts) if not (t or "").split()]
    assert {named[i] for i in empty} == {min(empty)}
    assert named[45] == named[44] == named[0] == 0
    assert nc.near_copies(no_docs).count() == 0


def test_very_long_text_and_its_near_copy(spark):
    rng = random.Random(1)
    words = [str(rng.randint(0, 10**6)) for _ in range(200_000)]
    rows = [(1, " ".join(words)), (2, " ".join(words[:-9000])), (3, " ".join(words[:120_000]))]
    found = {r.doc_id: r.component_id for r in nc.near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found == {1: 1, 2: 1, 3: 3}
