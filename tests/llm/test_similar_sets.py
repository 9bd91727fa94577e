import random
from collections import defaultdict
from fractions import Fraction

import numpy as np

from seedscape.llm import similar_sets, simhash


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
    rows = simhash.near_copies(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    return [name for _, name in sorted((r.doc_id, r.component_id) for r in rows)]


def test_no_text_below_the_similarity_is_linked(spark):
    texts = graded()
    names, expected = found_components(spark, texts), smallest(len(texts), alike_pairs(texts, 0.8))
    below = [(i, j) for i, j in alike_pairs(texts, 0.6, 0.8) if expected[i] != expected[j]]
    assert len(below) > 30 and not [pair for pair in below if names[pair[0]] == names[pair[1]]]


def test_every_pair_is_found_whatever_the_order(spark, monkeypatch):
    """All pairs by true similarity give the same components, also where every shingle or none comes last."""
    texts = graded(12)
    pairs = alike_pairs(texts, 0.8)
    assert len(pairs) > 200 and len(alike_pairs(texts, 0.8, 0.82)) > 5
    for common in (10, 0, 10**6):
        monkeypatch.setattr(similar_sets, "COMMON", common)
        assert found_components(spark, texts) == smallest(len(texts), pairs)


def test_similarity_of_exactly_four_fifths(spark):
    """9 and 9 shingles, 8 of them common; 8 and 10, all 8 common; 9 and 9, 7 common, are not enough."""
    words = "a b c d e f g h i j k l m n".split()
    one, end, longer, less = words[:13], [*words[:12], "x"], words[:14], [*words[:11], "x", "y"]
    texts = [" ".join(w) for w in (one, end, less, words[:12], longer)]
    assert found_components(spark, texts) == smallest(5, alike_pairs(texts, 0.8)) == [0, 0, 2, 0, 0]


def test_prefixes_of_alike_sets_meet():
    rng = random.Random(4)
    t = Fraction("0.8")
    table = np.array([rng.getrandbits(64) for _ in range(1 << (similar_sets.PLACE_BITS - 6))], np.uint64)
    for _ in range(500):
        both = [rng.getrandbits(64) for _ in range(rng.randint(1, 60))]
        more = [rng.getrandbits(64) for _ in range(len(both) // 4)]
        cut = rng.randint(0, len(more))
        sets = [np.array(sorted(both + x), np.uint64) for x in (more[:cut], more[cut:])]
        for common in (None, table):
            a, b = (set(similar_sets.prefix_of(s, t, common).tolist()) for s in sets)
            assert a & b
