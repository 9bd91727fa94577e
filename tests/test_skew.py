"""A key with a third of the rows is split over tasks, not sent to one."""

import pytest
from pyspark.sql import functions as F

from seedscape.operators.graph import follow_citations
from seedscape.operators.similarity import tfidf
from seedscape.operators.skew import lookup_join
from seedscape.scratch import materialize

SMALL_CLUSTER = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1KB",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.2",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "2KB",
    "spark.sql.shuffle.partitions": "8",
}


@pytest.fixture
def tight(spark):
    before = {k: spark.conf.get(k, None) for k in SMALL_CLUSTER}
    for key, value in SMALL_CLUSTER.items():
        spark.conf.set(key, value)
    yield spark
    for key, value in before.items():
        if value is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, value)


def plan_after_run(df):
    rows = df.collect()
    return rows, df._jdf.queryExecution().executedPlan().toString()


def hub_edges(spark):
    cited = F.when(F.col("id") % 3 == 0, "hub").otherwise((F.col("id") % 500).cast("string"))
    return materialize(spark.range(60_000, numPartitions=8).select(F.col("id").cast("string").alias("id"), cited.alias("cited_id")))


def test_hub_is_split_when_followed(tight):
    ring = materialize(tight.createDataFrame([("hub",), ("5",), ("17",)], "id string"))
    rows, plan = plan_after_run(follow_citations(ring, hub_edges(tight)))
    assert "SortMergeJoin(skew=true)" in plan
    plain = {str(i) for i in range(60_000) if i % 3 == 0 or i % 500 in (5, 17)} | {"hub", "5", "17"}
    assert {r["id"] for r in rows} >= plain


def test_hot_key_is_split_when_totals_are_attached(tight):
    rows = hub_edges(tight)
    sizes = rows.groupBy("cited_id").agg(F.count("*").alias("n"))
    got, plan = plan_after_run(lookup_join(rows, sizes, ["cited_id"], "left", ["id"]))
    assert "SortMergeJoin(skew=true)" in plan
    assert len(got) == 60_000 and {r["n"] for r in got if r["cited_id"] == "hub"} == {20_000}


def test_common_term_is_split(tight):
    """A term that stands in every text meets its one vocabulary row in many tasks."""
    title = F.concat(F.lit("common t"), F.col("id").cast("string"))
    texts = materialize(tight.range(40_000, numPartitions=8).select("id", title.alias("title")))
    rows, plan = plan_after_run(tfidf(texts))
    assert "SortMergeJoin(skew=true)" in plan
    assert len(rows) == 80_000
