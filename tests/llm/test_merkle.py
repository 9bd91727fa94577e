"""The manifest against a tree built by plain hashing."""

from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from seedscape.llm import merkle

COLUMNS = ["doc_id", "text"]


def digest(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def leaf_of(*values):
    return digest(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def levels_of(nodes):
    made = [nodes]
    while len(made[-1]) > 1:
        made.append([digest(*made[-1][i : i + 8]) for i in range(0, len(made[-1]), 8)])
    return made


def path_of(levels, at):
    path = []
    for nodes in levels[:-1]:
        first = at - at % 8
        path.append(("".join(nodes[first:at]), "".join(nodes[at + 1 : first + 8])))
        at //= 8
    return path


def expected(rows, replaced):
    """(doc_id, leaf, subroot, root, proof, folded_root) of each row (doc_id, lang, text)."""
    low = lambda x: (x is not None, x or 0)
    groups = {}
    for row in rows:
        groups.setdefault(row[1], []).append((low(row[0]), leaf_of(row[0], row[2]), leaf_of(row[0], replaced(row)), row[0]))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: levels_of([x[1] for x in sorted(groups[g])]) for g in names}
    top = levels_of([trees[g][-1][0] for g in names])
    found = []
    for place, g in enumerate(names):
        for at, (_, leaf, other, doc_id) in enumerate(sorted(groups[g])):
            path = path_of(trees[g], at) + path_of(top, place)
            folded = other
            for left, right in path:
                folded = digest(left, folded, right)
            found.append((doc_id, leaf, trees[g][-1][0], top[-1][0], path, folded))
    return found


def found_rows(made):
    return [(r.doc_id, r.leaf, r.subroot, r.root, [tuple(p) for p in r.proof], r.folded_root) for r in made.collect()]


@pytest.mark.parametrize("langs", [1, 20])
def test_against_plain_hashing(spark, langs):
    """Blocks of one level, so that trees of some hundred leaves have several tiers of blocks."""
    rows = [(i if i % 50 else None, None if i % langs == 1 else f"l{i % langs}ä", None if i % 7 == 0 else "Text é " * (i % 5)) for i in range(150)]
    rows += rows[:3] + [(1000, "x", "A very long text " * 20_000), (1001, "y", "")]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string").withColumns({c: F.lit("clash") for c in ("pos", "tree", "leaf", "rank")})
    made = merkle.manifest(docs, COLUMNS, "lang", "doc_id", {"text": F.upper("text")}, keep=["doc_id"], levels=1)
    assert sorted(map(str, found_rows(made))) == sorted(map(str, expected(rows, lambda r: r[2] and r[2].upper())))


def test_whole_blocks(spark):
    rows = [(i, "en" if i < 1500 else "de", f"text {i}") for i in range(2000)]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    made = found_rows(merkle.manifest(docs, COLUMNS, "lang", "doc_id", keep=["doc_id"]))
    assert sorted(map(str, made)) == sorted(map(str, expected(rows, lambda r: r[2])))
    assert all(r[3] == r[5] for r in made)


def test_one_row_and_none(spark):
    docs = spark.createDataFrame([(None, None, None)], "doc_id long, lang string, text string")
    row = merkle.manifest(docs, COLUMNS, "lang", "doc_id", keep=["doc_id"]).first()
    assert row.leaf == row.subroot == row.root == row.folded_root == leaf_of(None, None) and row.proof == []
    assert merkle.manifest(docs.limit(0), COLUMNS, "lang", "doc_id").count() == 0


def test_states_are_resumed_with_right_siblings_only():
    block = merkle.Block([digest(str(i)).encode() for i in range(100)], 100, 3)
    for at in (0, 7, 8, 63, 99):
        rights = [right for _, right in block.siblings(at)]
        assert block.fold(at, block.digests[0][at], rights) == block.digests[-1][0]
        assert block.fold(at, digest("other").encode(), rights) != block.digests[-1][0]
