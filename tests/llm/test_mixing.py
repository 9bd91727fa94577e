"""The mix against targets shared out by repeated rounds, and splits against their sums."""

from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from seedscape.llm import mixing


def targets_of(sizes, weights=(5, 2, 1), share=1.5, cap=2):
    """Share out by weight, stop at the caps, share the excess again, until none is above."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    full = set()
    while True:
        left = share * sum(sizes.values()) - sum(cap * sizes[s] for s in full)
        open_ = sum(weight[s] for s in order if s not in full)
        given = {s: cap * sizes[s] if s in full else left * weight[s] / open_ for s in order}
        above = {s for s in order if s not in full and given[s] > cap * sizes[s]}
        if not above:
            return given
        full |= above


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(3)
    sources = ["a", "b", "ü", None, "C", "", "d"] + ["hot"] * 6
    made = [(i, sources[i % len(sources)], " ".join(["w"] * int(rng.pareto(1.2) * 20))) for i in range(6000)]
    return made + [(None, "a", None), (None, "b", ""), (7, "a", "the same"), (7, "a", "the same"), (9000, "hot", "long " * 30_000)]


@pytest.fixture(scope="module")
def assigned(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    docs = docs.withColumns({c: F.lit("clash") for c in ("rank", "words", "of", "size", "n_rows")})
    return mixing.assign(docs, mixing.word_count("text")).cache()


def test_targets_and_sizes(assigned, rows):
    sizes = defaultdict(int)
    for _, source, text in rows:
        sizes[source] += len((text or "").split())
    targets = targets_of(sizes)
    for r in assigned.collect():
        assert r.size == len((r.text or "").split()) and r.source_size == sizes[r.source]
        assert r.target == pytest.approx(targets[r.source])
        assert len(r.shards) <= 2


def test_sources_come_near_their_targets(assigned):
    found = assigned.groupBy("source").agg(
        F.sum(F.col("size") * F.size("shards")).alias("taken"), F.first("target").alias("target"), F.max("size").alias("largest")
    )
    for r in found.collect():
        assert abs(r.taken - r.target) <= max(0.02 * r.target, 0.5 * r.largest)


def test_shards_are_equal_in_blocks_and_rows_stay(assigned, rows):
    made = assigned.collect()
    assert Counter((r.doc_id, r.source, r.text) for r in made) == Counter(rows)
    load = Counter()
    for r in made:
        for shard in r.shards:
            load[shard] += 1
    assert set(load) == set(range(8)) and max(load.values()) < 1.3 * min(load.values())


def test_reruns_agree_whatever_the_partitions(spark, rows, assigned):
    docs = spark.createDataFrame(rows[::-1], "doc_id long, source string, text string").repartition(7)
    again = mixing.assign(docs, mixing.word_count("text"), keep=["doc_id", "source"]).select("doc_id", "source", "size", F.size("shards"))
    assert sorted(map(str, again.collect())) == sorted(map(str, assigned.select("doc_id", "source", "size", F.size("shards")).collect()))


@pytest.mark.parametrize("room", [[5, 5, 5], [15], [0, 7, 8, 0]])
def test_split_tree_keeps_both_sums(room):
    draws = np.array([0, 9, 1, 5])
    split = mixing.split_tree(draws, np.array(room), np.random.default_rng(1))
    assert (split >= 0).all() and (split.sum(axis=1) == draws).all() and (split.sum(axis=0) == room).all()


def test_split_tree_has_the_hypergeometric_mean():
    draws, room = np.array([40, 10]), np.array([10, 30, 10])
    runs = [mixing.split_tree(draws, room, np.random.default_rng(s)) for s in range(2000)]
    assert np.allclose(np.mean(runs, axis=0), np.outer(draws, room) / 50, atol=0.15)


def test_many_quotas_go_through_buckets(spark, monkeypatch):
    monkeypatch.setattr(mixing, "QUOTAS", 16)
    quotas = spark.range(200).select(F.col("id").cast("string").alias("name"), (F.col("id") % 7).alias("draws"))
    total = quotas.agg(F.sum("draws")).first()[0]
    room = [total * (k + 1) // 5 - total * k // 5 for k in range(5)]
    split = {r.name: r.counts for r in mixing.split_quotas(quotas, room, 1).collect()}
    assert {n: sum(c) for n, c in split.items()} == {str(i): i % 7 for i in range(200)}
    assert [sum(c[k] for c in split.values()) for k in range(5)] == room


def test_written_shards_hold_every_copy_once(spark, assigned, tmp_path):
    mixing.write_mix(assigned.drop("n_rows", "of", "words", "rank"), str(tmp_path / "mix"))
    back = spark.read.parquet(str(tmp_path / "mix"))
    wanted = Counter((r.doc_id, r.source, r.text, s) for r in assigned.collect() for s in r.shards)
    assert Counter((r.doc_id, r.source, r.text, r.shard) for r in back.collect()) == wanted


def test_empty_and_wordless(spark):
    docs = spark.createDataFrame([(1, "a", None), (2, None, "")], "doc_id long, source string, text string")
    assert [(r.size, r.target, r.shards) for r in mixing.assign(docs, mixing.word_count("text")).collect()] == [(0, 0.0, [])] * 2
    assert mixing.assign(docs.limit(0), mixing.word_count("text")).count() == 0
