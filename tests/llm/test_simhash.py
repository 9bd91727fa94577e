import random

import numpy as np
import xxhash

from seedscape.llm import simhash
from seedscape.llm.components import connected_components
from seedscape.llm.near_copies import near_copies


def naive_print(text, size=4):
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").split(" ") if w]
    if not words:
        return 0
    size = min(size, len(words))
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + size]).encode(), 42) for i in range(len(words) - size + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def reachable(prints, distance):
    """Smallest id per row, by searching all pairs of different fingerprints."""
    codes = sorted({p for _, p in prints})
    root = {c: c for c in codes}

    def find(c):
        while root[c] != c:
            c = root[c]
        return c

    for i, a in enumerate(codes):
        for b in codes[i + 1 :]:
            if (a ^ b).bit_count() <= distance:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    least = {}
    for i, p in prints:
        if i is not None:
            least[find(p)] = min(i, least.get(find(p), i))
    return {p: least.get(find(p)) for p in codes}


def test_fingerprints_and_components(docs, texts):
    rows = simhash.near_duplicates(docs).collect()
    given = [(i if i != 3 else None, naive_print(t)) for i, t in enumerate(texts)] + [(0, naive_print(texts[0]))]
    assert sorted(map(str, given)) == sorted(str((r.doc_id, r.fingerprint & (2**64 - 1))) for r in rows)
    names = reachable(given, 4)
    assert all(r.component_id == names[r.fingerprint & (2**64 - 1)] for r in rows)


def clustered(n, seed=5):
    rng = random.Random(seed)
    codes = set()
    while len(codes) < n:
        center = rng.getrandbits(64)
        for _ in range(rng.choice([1, 1, 30])):
            code = center
            for _ in range(rng.randint(0, 5)):
                code ^= 1 << rng.randrange(64)
            codes.add(code)
    return sorted(codes)[:n]


def test_index_finds_all_links(spark, monkeypatch):
    codes = clustered(1500)
    frame = spark.createDataFrame([(c - 2**64 if c >> 63 else c,) for c in codes], "fingerprint long")
    names = reachable([(c, c) for c in codes], 4)
    for block in (65_536, 3):
        monkeypatch.setattr(simhash, "BLOCK", block)
        linked = connected_components(simhash.fingerprint_links(frame, 4))
        roots = {r.node & (2**64 - 1): r.root for r in linked.collect()}
        parts, expected = {}, {}
        for c in codes:
            parts.setdefault(roots.get(c, c - 2**64 if c >> 63 else c), set()).add(c)
            expected.setdefault(names[c], set()).add(c)
        assert sorted(map(sorted, parts.values())) == sorted(map(sorted, expected.values()))


def test_one_group_index_and_small_frontier(monkeypatch):
    monkeypatch.setattr(simhash, "FRONTIER", 50)
    codes = np.array(clustered(600, 9), np.uint64)
    a, b = simhash.GrayIndex(np.zeros(len(codes), np.int64), codes, 4).links()
    parts = reachable([(int(c), int(c)) for c in codes], 4)
    assert len(a) == len(codes) - len(set(parts.values()))
    assert all(parts[int(x)] == parts[int(y)] for x, y in zip(a, b))


def test_masks_leave_no_pair_out():
    rng = random.Random(2)
    for n in (10, 10**6, 10**9, 10**12):
        chosen = simhash.masks(n, 4)
        for _ in range(300):
            flips = sum(1 << b for b in rng.sample(range(64), 4))
            assert any(flips & m == 0 for m in chosen)


def test_gray_rank():
    codes = np.array([i ^ i >> 1 for i in range(1000)], np.uint64)
    assert simhash.gray_rank(codes).tolist() == list(range(1000))


def test_components_of_a_chain_a_hub_and_nulls(spark):
    edges = [(i, i + 1) for i in range(60)] + [(500, 500 + i) for i in range(1, 200)] + [(900, 900), (None, 3), (7, 7)]
    found = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {i: 0 for i in range(61)} | {i: 500 for i in range(500, 700)}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_index_that_asks_links_only_what_it_is_told(monkeypatch):
    """Members that may not be linked stay apart."""
    codes = np.array(clustered(300, 4), np.uint64)
    asked = []

    def same(a, b):
        asked.append((a, b))
        return a % 2 == b % 2

    index = simhash.GrayIndex(np.zeros(len(codes), np.int64), codes, 4, simhash.LEVELS, same)
    found = smallest_of(len(codes), zip(*(x.tolist() for x in index.places())))
    near = lambda a, b: int(codes[a] ^ codes[b]).bit_count() <= 4
    wanted = smallest_of(len(codes), [(a, b) for b in range(len(codes)) for a in range(b) if near(a, b) and a % 2 == b % 2])
    assert found == wanted and len(asked) < 3 * len(codes) + sum(a != b for a, b in enumerate(wanted)) * 20


def smallest_of(n, pairs):
    root = list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in pairs:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return [find(i) for i in range(n)]


def test_gray_rank_of_several_words():
    rank = [(i >> 64 << 64) | (i & (2**64 - 1)) for i in (0, 1, 2**63, 2**64 - 1, 2**64, 2**64 + 5, 3 << 64, (3 << 64) + 9)]
    codes = [i ^ i >> 1 for i in rank]
    words = np.array([(c >> 64, c & (2**64 - 1)) for c in codes], np.uint64)
    assert [(int(a) << 64) + int(b) for a, b in simhash.gray_rank(words)] == rank


def test_one_per_component(docs, no_docs):
    kept = simhash.one_per_component(docs)
    assert kept.columns == docs.columns
    rows = kept.collect()
    names = {r.doc_id: r.component_id for r in simhash.near_duplicates(docs).collect() if r.doc_id is not None}
    assert sorted(r.doc_id for r in rows if r.doc_id is not None) == sorted(set(names.values()) - {None})
    assert sum(r.doc_id is None for r in rows) == 1
    assert simhash.one_per_component(no_docs).count() == 0


def test_different_texts_with_one_id(spark):
    """Id 2 has a copy of text 1 and two texts of its own; the copy goes, and both own texts stay."""
    one, own, other = ("a b c d e f g h i j", "k l m n o p q r s t", "u v w x y z 1 2 3 4")
    rows = [(1, one, "rep"), (2, one, "copy"), (2, own, "own"), (2, other, "other"), (2, other, "other"), (3, own, "late")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, kind string")
    for find in (near_copies, simhash.near_duplicates):
        assert sorted(r.kind for r in simhash.one_per_component(frame, find).collect()) == ["other", "own", "rep"]
