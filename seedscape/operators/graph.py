"""Following citations.

Edges are ``(id, cited_id)``; a set of items is a table with an ``id`` column and,
for many runs at once, the run's key columns (``by``). Runs travel along the edges as
bits: an ID has one row for up to 64 runs that have reached it, so edges are joined once per ID,
however many runs there are.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seedscape.operators.newton import join_runs
from seedscape.operators.ordering import running_totals
from seedscape.operators.similarity import n_tasks
from seedscape.scratch import materialize

#: Runs that one row of an ID stands for.
RUNS_PER_ROW = 64


def out_citations(edges: DataFrame, ids: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Edges whose citing side is in the set."""
    return edges.join(ids.select(*by, "id"), "id").select(*by, "id", "cited_id")


def in_citations(edges: DataFrame, ids: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Edges whose cited side is in the set."""
    cited = ids.select(*by, F.col("id").alias("cited_id"))
    return edges.join(cited, "cited_id").select(*by, "id", "cited_id")


def combine_ids(tables: Sequence[DataFrame], by: Sequence[str] = ()) -> DataFrame:
    """Distinct IDs on either side of the given edge tables."""
    ends = [t.select(*by, F.explode(F.array("id", "cited_id")).alias("id")) for t in tables]
    united = ends[0]
    for more in ends[1:]:
        united = united.unionByName(more)
    return united.distinct()


def both_ways(edges: DataFrame) -> DataFrame:
    """Each edge seen from both of its sides, as ``(near, far)``.

    One scan and one join then follow in- and out-citations together.
    """
    ways = F.array(
        F.struct(F.col("id").alias("near"), F.col("cited_id").alias("far")),
        F.struct(F.col("cited_id").alias("near"), F.col("id").alias("far")),
    )
    return edges.select(F.inline(ways))


def _neighbours(ids: DataFrame, edges: DataFrame, by: Sequence[str]) -> DataFrame:
    near = ids.select(*by, F.col("id").alias("near"))
    return both_ways(edges).join(near, "near").select(*by, "near", "far")


def follow_citations(ids: DataFrame, edges: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """IDs on any edge that touches the set. A start ID stays only if it has an edge."""
    steps = _neighbours(ids, edges, by)
    return steps.select(*by, F.explode(F.array("near", "far")).alias("id")).distinct()


def number_runs(ids: DataFrame, by: Sequence[str]) -> DataFrame:
    """``(by, chunk, bit)``: where in the rows of an ID each run has its bit."""
    numbered = running_totals(ids.select(*by).distinct(), [F.col(k) for k in by])
    at = F.col("rank") - 1
    placed = numbered.select(*by, F.floor(at / RUNS_PER_ROW).cast("long").alias("chunk"), (at % RUNS_PER_ROW).cast("int").alias("place"))
    return materialize(placed.select(*by, "chunk", F.expr("shiftleft(1L, place)").alias("bit")), "runs")


def to_bits(ids: DataFrame, runs: DataFrame, by: Sequence[str]) -> DataFrame:
    """``(id, chunk, bits)``: the runs that each ID belongs to."""
    return join_runs(ids.select(*by, "id"), runs, by).groupBy("id", "chunk").agg(F.bit_or("bit").alias("bits"))


def from_bits(reached: DataFrame, runs: DataFrame, by: Sequence[str], more: Sequence[str] = ()) -> DataFrame:
    """``(by, id)`` of rows ``(id, chunk, bits)``."""
    held = reached.join(runs, "chunk").where(F.col("bits").bitwiseAND(F.col("bit")) != 0)
    return held.select(*by, "id", *more)


def expand(seeds: DataFrame, edges: DataFrame, degrees: int = 2, by: Sequence[str] = ()) -> DataFrame:
    """Follow citations ``degrees`` times.

    Every ring of IDs is distinct before the next join, and is written so that it
    is computed once and so that the next join knows how large it is: a small ring
    is broadcast, a large one is shuffled. Being a plain scan, it leaves the join
    open to the adaptive split of hubs; the seeds should be a plain table as well.
    """
    if by:
        return _expand_runs(seeds, edges, degrees, by)
    ring = seeds.select("id")
    for step in range(degrees):
        ring = follow_citations(ring, edges)
        if step < degrees - 1:
            ring = materialize(ring, "ring")
    return ring


def _expand_runs(seeds: DataFrame, edges: DataFrame, degrees: int, by: Sequence[str]) -> DataFrame:
    runs = number_runs(seeds, by)
    ring = materialize(to_bits(seeds, runs, by), "ring")
    for _ in range(degrees):
        steps = both_ways(edges).join(ring.withColumnRenamed("id", "near"), "near")
        ends = steps.select(F.explode(F.array("near", "far")).alias("id"), "chunk", "bits")
        ring = materialize(ends.groupBy("id", "chunk").agg(F.bit_or("bits").alias("bits")), "ring")
    return from_bits(ring, runs, by)


def attach_papers(ids: DataFrame, papers: DataFrame) -> DataFrame:
    """The paper record of each ID; IDs without a record drop out."""
    return ids.join(papers, "id")


def references_of(edges: DataFrame, paper_id: str, direction: str = "out") -> DataFrame:
    """IDs that one paper cites or, with ``direction='in'``, IDs that cite it."""
    if direction.lower().startswith("in"):
        return edges.where(F.col("cited_id") == paper_id).select("id")
    return edges.where(F.col("id") == paper_id).select(F.col("cited_id").alias("id"))


def neighbour_counts(ids: DataFrame, edges: DataFrame, degrees: int = 2, by: Sequence[str] = ()) -> DataFrame:
    """How often each ID is reached over all steps, counting every edge."""
    if by:
        return _count_for_runs(ids, edges, degrees, by)
    ring = materialize(ids.select("id").distinct(), "ring")
    reached = []
    for step in range(degrees):
        hits = _neighbours(ring, edges, ()).groupBy(F.col("far").alias("id")).agg(F.count("*").alias("n"))
        if step < degrees - 1:
            hits = materialize(hits, "reached")
        reached.append(hits)
        ring = hits.select("id")
    total = reached[0]
    for more in reached[1:]:
        total = total.unionByName(more)
    return total.groupBy("id").agg(F.sum("n").alias("n_reached"))


def _count_for_runs(ids: DataFrame, edges: DataFrame, degrees: int, by: Sequence[str]) -> DataFrame:
    """Edges into an ID are counted per set of runs first, and only then run by run."""
    runs = number_runs(ids, by)
    ring, total = materialize(to_bits(ids, runs, by), "ring"), None
    for _ in range(degrees):
        steps = both_ways(edges).join(ring.withColumnRenamed("id", "near"), "near")
        hits = materialize(steps.groupBy(F.col("far").alias("id"), "chunk", "bits").agg(F.count("*").alias("n")), "reached")
        total = hits if total is None else total.unionByName(hits)
        ring = hits.groupBy("id", "chunk").agg(F.bit_or("bits").alias("bits"))
    sums = total.groupBy("id", "chunk", "bits").agg(F.sum("n").alias("n"))
    return from_bits(sums, runs, by, ["n"]).groupBy(*by, "id").agg(F.sum("n").alias("n_reached"))


def lists_of_reviews(edges: DataFrame, reviews: DataFrame, direction: str = "out") -> DataFrame:
    """The references (or the citing papers) of many papers at once, as ``(review_id, id)``.

    Edges and reviews are dealt out once, to as many tasks as their numbers ask for, so that a task does not grow with
    the tables; reviews and pairs are made distinct where they are joined.
    """
    own, other = ("id", "cited_id") if direction == "out" else ("cited_id", "id")
    wanted = materialize(reviews.select(F.col("id").alias("review_id")), "reviews")
    pairs = edges.select(F.col(own).alias("review_id"), F.col(other).alias("id"))
    n = n_tasks(edges, max(edges.count(), wanted.count()))
    return pairs.repartition(n, "review_id").join(wanted.repartition(n, "review_id").distinct(), "review_id").distinct()
