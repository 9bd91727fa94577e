"""Exact top-k search by inner product, term at a time.

A task holds a block of stored vectors as postings: for every dimension the rows that
have a weight there. A block of sparse queries is run through them one dimension after
another, each scattering its weighted postings into a dense array of scores; the best k
are then selected by partition, not by sorting, and the tasks' lists are merged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from seedscape.llm.common import map_batches
from seedscape.scratch import materialize

#: Stored vectors and queries of one dense score array, which should stay in a core's cache.
BLOCK_ROWS, BLOCK_QUERIES = 2_048, 64
#: Stored vectors and queries that meet in one task.
TASK_ROWS, TASK_QUERIES = 16_384, 4_096


def quantized(vector: Column, scale: int = 64) -> Column:
    """floor(scale * x) of every component as long; null if the vector or a component is null or not finite."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    cast = vector.cast("array<double>")
    return F.when(F.forall(cast, finite), F.transform(cast, lambda x: F.floor(F.lit(float(scale)) * x).cast("long")))


def postings_of(block: np.ndarray) -> list[tuple[np.ndarray | None, np.ndarray]]:
    """Per dimension the rows that have a weight and their weights; the whole column where most rows have one."""
    postings = []
    for column in np.ascontiguousarray(block.T):
        (rows,) = np.nonzero(column)
        postings.append((rows, column[rows]) if len(rows) * 4 < len(column) else (None, column))
    return postings


def scatter_scores(queries: np.ndarray, postings: list[tuple[np.ndarray | None, np.ndarray]], n_rows: int) -> np.ndarray:
    """Scores of ``queries`` (rows) against ``n_rows`` stored vectors."""
    scores = np.zeros((len(queries), n_rows), queries.dtype)
    gain = np.empty_like(scores)
    for d, (rows, weights) in enumerate(postings):
        (active,) = np.nonzero(queries[:, d])
        if not len(weights) or not len(active):
            continue
        if rows is not None:
            scores[np.ix_(active, rows)] += queries[active, d, None] * weights
        elif len(active) * 2 < len(queries):
            scores[active] += queries[active, d, None] * weights
        else:
            scores += np.multiply(queries[:, d, None], weights, out=gain)
    return scores


def best_of(scores: np.ndarray, own: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Query and column numbers of the k highest scores of each row without the columns flagged in ``own``;
    equal scores go to the lower column."""
    n = scores.shape[1]
    spare = k + int(own.sum(axis=1).max(initial=0))
    if n > spare:
        least = np.partition(scores, n - spare, axis=1)[:, n - spare]
        q, column = np.nonzero((scores >= least[:, None]) & ~own)
    else:
        q, column = np.nonzero(~own)
    keep = _first(k, q, column, scores[q, column])
    return q[keep], column[keep]


def _first(k: int, q: np.ndarray, place: np.ndarray, score: np.ndarray) -> np.ndarray:
    """Which entries are the first k of their query, by score and then by place, in this order."""
    order = np.lexsort((place, ~score, q))
    nth = np.arange(len(q)) - np.searchsorted(q[order], q[order])
    return order[nth < k]


def _matrix(rows: pa.Table, width: int) -> np.ndarray:
    """The vectors as rows, shorter ones filled up with zeros."""
    sizes = pc.list_value_length(rows["vector"]).to_numpy()
    made = np.zeros((len(rows), width), np.int64)
    made[np.arange(width) < sizes[:, None]] = pc.list_flatten(rows["vector"]).to_numpy()
    return made


def top_k(
    queries: DataFrame, stored: DataFrame, id_col: str, vector_col: str, k: int = 20, query_id_col: str | None = None
) -> DataFrame:
    """The ``k`` stored vectors with the highest integer inner product for each query:
    (query_id, rank from 1, ``id_col`` as vec_id, score), ties to the smaller id.

    Vectors are arrays of long (see ``quantized``); a null vector takes no part, and shorter ones count as filled up with
    zeros. Every stored row is a candidate of its own, also where rows repeat an id or are equal; a query never finds
    its own row, that is one row with its id and vector. Rows without an id are candidates too, behind others of their
    score, and may ask. Queries that repeat an id have a list each. Fewer than ``k`` candidates give shorter lists, no
    candidates or queries give no rows. Sums beyond 64 bits wrap around.

    Work is cut into cells of stored vectors and queries, whose numbers follow the input; each
    cell is one group of bounded size and returns at most ``k`` rows per query. Equal rows travel once, with their number.
    """
    query_id_col = query_id_col or id_col

    def once(df: DataFrame, name: str) -> DataFrame:
        usable = df.select(F.col(name).cast("long").alias("id"), F.col(vector_col).alias("vector")).filter("vector is not null")
        counted = usable.groupBy("id", "vector").agg(F.count(F.lit(1)).alias("copies"))
        return counted.select(F.coalesce("id", F.lit(0).cast("long")).alias("id"), F.col("id").isNull().alias("nameless"), "vector", "copies")

    rows = materialize(once(stored, id_col), "stored")
    asked = materialize(once(queries, query_id_col), "queries")
    row_cells = max(1, -(-rows.count() // TASK_ROWS))
    query_cells = max(1, -(-asked.count() // TASK_QUERIES))
    dealt = lambda n: F.pmod(F.xxhash64("id", "vector"), F.lit(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    sides = (
        rows.select(dealt(row_cells).alias("r"), each(query_cells).alias("q"), "id", "nameless", "vector", "copies", F.lit(False).alias("asks"))
        .unionByName(asked.select(each(row_cells).alias("r"), dealt(query_cells).alias("q"), "id", "nameless", "vector", "copies", F.lit(True).alias("asks")))
    )

    def search(cell: pa.Table) -> Iterator[pa.RecordBatch]:
        kept, asked_ = (cell.filter(pc.equal(cell["asks"], x)) for x in (False, True))
        if not len(kept) or not len(asked_):
            return
        kept = kept.sort_by([("nameless", "ascending"), ("id", "ascending")])  # a lower column is a smaller id
        width = pc.max(pc.list_value_length(cell["vector"])).as_py()
        stored_rows, query_rows = _matrix(kept, width), _matrix(asked_, width)
        ids, nameless, copies = (kept[c].to_numpy() for c in ("id", "nameless", "copies"))
        query_ids, query_nameless, query_copies = (asked_[c].to_numpy() for c in ("id", "nameless", "copies"))
        query_no = np.array([xxhash.xxh64_intdigest(v.tobytes()) for v in query_rows], np.uint64).view(np.int64)
        bound = int(np.abs(stored_rows).max(initial=0)) * int(np.abs(query_rows).max(initial=0)) * stored_rows.shape[1]
        kind = np.int32 if bound < 2**31 else np.int64
        stored_rows, query_rows = stored_rows.astype(kind), query_rows.astype(kind)
        blocks = [(at, stored_rows[at : at + BLOCK_ROWS]) for at in range(0, len(ids), BLOCK_ROWS)]
        blocks = [(at, len(block), postings_of(block)) for at, block in blocks]
        for first in range(0, len(query_ids), BLOCK_QUERIES):
            asking = query_rows[first : first + BLOCK_QUERIES]
            part = slice(first, first + len(asking))
            parts = []
            for at, n, postings in blocks:
                scores = scatter_scores(asking, postings, n)
                here = slice(at, at + n)
                own = (query_ids[part, None] == ids[None, here]) & (query_nameless[part, None] == nameless[None, here])
                q, column = np.nonzero(own)
                own[q, column] = (asking[q] == stored_rows[at + column]).all(axis=1)
                left = np.broadcast_to(copies[here], own.shape) - own
                q, column = best_of(scores, left == 0, k)
                parts.append((q, at + column, scores[q, column].astype(np.int64), left[q, column]))
            q, found, score, left = map(np.concatenate, zip(*parts))
            keep = _first(k, q, found, score)  # the blocks' lists merged
            q, found = part.start + q[keep], found[keep]
            columns = [
                pa.array(query_ids[q], mask=query_nameless[q]),
                pa.array(query_no[q]),
                pa.array(query_copies[q]),
                pa.array(ids[found], mask=nameless[found]),
                pa.array(score[keep]),
                pa.array(left[keep].astype(np.int64)),
            ]
            yield pa.RecordBatch.from_arrays(columns, schema=made)

    names = ("query_id", "query_no", "query_copies", "vec_id", "score", "copies")
    made = pa.schema([(name, pa.int64()) for name in names])
    lists = sides.groupBy("r", "q").applyInArrow(
        lambda cell: pa.Table.from_batches(search(cell), made), ", ".join(f"{name} long" for name in names)
    )
    # equal candidates stand behind each other, each with a rank of its own
    order = W.partitionBy("query_id", "query_no").orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last())
    nth = lists.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    last = F.sum("copies").over(order.rowsBetween(W.unboundedPreceding, W.currentRow))
    placed = nth.withColumn("last", last).withColumn("first", F.col("last") - F.col("copies") + 1).filter(F.col("first") <= k)
    ranks = F.explode(F.sequence("first", F.least("last", F.lit(k)))).alias("rank")
    ranked = placed.select("query_id", "query_copies", ranks, "vec_id", "score")
    repeated = ranked.select("*", F.explode(F.sequence(F.lit(1).cast("long"), "query_copies")).alias("list"))
    return repeated.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
