"""Connected components of a graph of any shape, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seedscape.llm.common import delete_table
from seedscape.scratch import new_path


def _large_star(edges: DataFrame) -> DataFrame:
    """Link each node's larger neighbours with the smallest of the node and its neighbours."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Link each node and its smaller neighbours with the smallest of them; ``u > v`` in every edge."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    among = edges.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return among.unionByName(least.select("u", F.col("m").alias("v")))


def connected_components(edges: DataFrame) -> DataFrame:
    """The smallest node reachable from each linked node, as (node, root).

    ``edges`` has two columns of longs, in any direction, repeated or not. Roots are listed too;
    loops and rows with a null link nothing. Minima are aggregated before the shuffle and the
    joins are plain, so a node with very many neighbours is split. Every half round is a table
    in the shared folder; the one before is deleted.
    """
    spark = edges.sparkSession
    a, b = edges.columns
    state = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v").distinct()
    path, mark = None, None
    while True:
        for step in (_large_star, _small_star) if path else (lambda x: x,):
            old, path = path, new_path(spark, "stars")
            step(state).distinct().write.parquet(path)
            state = spark.read.schema("u long, v long").parquet(path)
            if old:
                delete_table(spark, old)
        found = state.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        if found == mark or not found[0]:
            break
        mark = found
    roots = state.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return state.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
