import zlib
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from seedscape.llm import sharding


def check(rows, given, n_shards):
    size = lambda t: len((t or "").encode()) + 1
    crc = lambda t: None if t is None else zlib.crc32(t.encode())
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in rows) == Counter((i, size(t), crc(t)) for i, t in given)
    slots, loads = defaultdict(list), Counter()
    for r in rows:
        assert 0 <= r.shard < n_shards and r.law == "bytes" and r.grown_shard is None
        slots[r.shard].append(r.slot)
        loads[r.shard] += r["size"]
    for found in slots.values():
        assert sorted(found) == list(range(len(found)))
    return loads


def test_small_table(docs, texts):
    rows = sharding.assign_shards(docs, 8).collect()
    check(rows, [(i if i != 3 else None, t) for i, t in enumerate(texts)] + [(0, texts[0])], 8)


def test_hot_text_and_equal_sizes(spark):
    given = [(i, "copy" * 50 if i % 3 == 0 else f"text {i} " * (i % 40)) for i in range(6000)]
    loads = check(sharding.assign_shards(spark.createDataFrame(given, "doc_id long, text string"), 8).collect(), given, 8)
    share = sum(loads.values()) / 8
    assert all(abs(x - share) <= share * 0.02 for x in loads.values())


def test_small_groups_stay_together(spark):
    given = [(i, f"text {i % 2000}") for i in range(6000)]
    rows = sharding.assign_shards(spark.createDataFrame(given, "doc_id long, text string"), 8).collect()
    shards = defaultdict(set)
    for r in rows:
        shards[r.text_crc32].add(r.shard)
    assert all(len(x) == 1 for x in shards.values())


def test_empty_and_no_python(no_docs, docs):
    assert sharding.assign_shards(no_docs, 8).count() == 0
    plan = sharding.assign_shards(docs, 8)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_written_shards(spark, tmp_path):
    frame = spark.createDataFrame([(i, f"text {i}") for i in range(100)], "doc_id long, text string")
    assigned = sharding.assign_shards(frame, 4)
    sharding.write_shards(frame, assigned, str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == 100 and back.agg(F.countDistinct("shard")).first()[0] == 4
