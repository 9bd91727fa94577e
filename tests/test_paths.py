import random
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from seedscape.functions import paths
from seedscape.operators.clusters import average_distance, distances_between, distances_within


def plain_shared(a: str, b: str) -> int:
    n = 0
    for x, y in zip(a.split(":"), b.split(":")):
        if x != y:
            break
        n += 1
    return n


def plain_distance(a: str, b: str) -> float:
    mean_depth = (len(a.split(":")) + len(b.split(":"))) / 2
    return (mean_depth - plain_shared(a, b)) / mean_depth


def plain_length(a: str, b: str) -> int:
    return len(a.split(":")) + len(b.split(":")) - 2 * plain_shared(a, b)


def random_paths(n: int, seed: int) -> list[str]:
    rng = random.Random(seed)
    return [":".join(str(rng.randint(1, 3)) for _ in range(rng.randint(1, 5))) for _ in range(n)]


CASES = [
    ("3:12:7", "3:12:7", 0.0, 0),
    ("3:12:7", "3:12:8", 1 / 3, 2),
    ("3:12:7", "3:1", 0.6, 3),
    ("3", "4", 1.0, 2),
    ("1:1:1", "2:1:1", 1.0, 6),
    ("12:3", "1:23", 1.0, 4),
]


@pytest.mark.parametrize("a, b, distance, length", CASES)
def test_known_distances(spark, a, b, distance, length):
    row = spark.createDataFrame([(a, b)], "a string, b string").select(
        paths.tree_distance(F.col("a"), F.col("b")),
        paths.tree_distance(F.col("b"), F.col("a")),
        paths.path_length(F.col("a"), F.col("b")),
    ).first()
    assert row[0] == pytest.approx(distance)
    assert row[1] == pytest.approx(distance)
    assert row[2] == length


def test_other_separator_and_first_part(spark):
    df = spark.createDataFrame([("7.1.2", "7.1.9"), ("x.1", "x.1")], "a string, b string")
    rows = df.select(
        paths.tree_distance(F.col("a"), F.col("b"), "."), paths.first_part(F.col("a"), ".")
    ).collect()
    assert rows[0][0] == pytest.approx(1 / 3) and rows[0][1] == 7
    assert rows[1][0] == 0.0 and rows[1][1] is None


@pytest.mark.parametrize("seed", [1, 2])
def test_average_distance_equals_brute_force(spark, seed):
    near = [("a", p) for p in random_paths(15, seed)] + [("b", p) for p in random_paths(4, seed + 10)]
    far = [(run, i, p) for run in "ab" for i, p in enumerate(random_paths(60, seed + 20))]
    papers = spark.createDataFrame(far + [("a", 99, None)], "run string, id long, cl string")
    seeds = spark.createDataFrame(near, "run string, cl string")
    found = {(r["run"], r["id"]): r["avg_distance"] for r in average_distance(papers, seeds, ["run"]).collect()}
    assert len(found) == len(far) + 1 and found[("a", 99)] is None
    for run, i, p in far:
        distances = [plain_distance(p, s) for r, s in near if r == run]
        assert found[(run, i)] == pytest.approx(sum(distances) / len(distances))
        assert 0 <= found[(run, i)] <= 1


def test_pair_counts_equal_brute_force(spark):
    left, right = random_paths(40, 5), random_paths(30, 6)
    a = spark.createDataFrame([(p,) for p in left], "cl string")
    b = spark.createDataFrame([(p,) for p in right], "cl string")

    def plain(pairs):
        counts = {}
        for x, y in pairs:
            counts[plain_length(x, y)] = counts.get(plain_length(x, y), 0) + 1
        return counts

    between = {r["distance"]: int(r["n_pairs"]) for r in distances_between(a, b).collect()}
    assert between == plain((x, y) for x in left for y in right if x != y)
    within = {r["distance"]: int(r["n_pairs"]) for r in distances_within(a).collect()}
    assert within == plain(combinations(left, 2))
