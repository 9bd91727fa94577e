"""Views over the driver's tables, in SQL text that Spark and DuckDB both read.

``{name}`` stands for a table or for another view. Spark gets it as a DataFrame,
DuckDB as a common table expression.
"""

from __future__ import annotations

import string
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType

from seedscape.operators.ordering import running_totals
from seedscape.operators.sampling import split_seeds
from seedscape.operators.similarity import title_similarity
from seedscape.plans.review import PaperSets, collect_papers
from seedscape.scratch import materialize

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)

VIEWS = {
    "citations": """
        SELECT 'o' || CAST(l_orderkey AS STRING) AS id, 'p' || CAST(l_partkey AS STRING) AS cited_id FROM {lineitem}""",
    "part_papers": """
        SELECT 'p' || CAST(p_partkey AS STRING) AS id, p_name AS title, 1950 + p_size AS year, p_retailprice AS ef,
               p_type || ':' || p_brand || ':' || CAST(p_size AS STRING) AS cl
        FROM {part}""",
    "order_papers": """
        SELECT 'o' || CAST(o_orderkey AS STRING) AS id, nullif(o_orderpriority, '5-LOW') AS title,
               CAST(year(o_orderdate) AS INT) AS year, o_totalprice AS ef,
               CASE WHEN o_orderstatus = 'P' THEN NULL
                    ELSE r_name || ':' || n_name || ':' || c_mktsegment END AS cl
        FROM {orders} JOIN {customer} ON o_custkey = c_custkey
             JOIN {nation} ON c_nationkey = n_nationkey JOIN {region} ON n_regionkey = r_regionkey""",
    "papers": "SELECT * FROM {part_papers} UNION ALL SELECT * FROM {order_papers}",
    "id_list": "SELECT 'p' || CAST(p_partkey AS STRING) AS id FROM {part} WHERE p_size = 7",
    "texts": "SELECT doc_id AS id, text FROM {documents}",
    "text_seeds": """
        SELECT d.doc_id AS id, text FROM {documents} d JOIN {labels} l ON d.doc_id = l.doc_id
        WHERE quality = 1 AND toxic = 1""",
    "text_candidates": """
        SELECT d.doc_id AS id, text, coalesce(quality, 0) = 1 AS target
        FROM {documents} d LEFT JOIN {labels} l ON d.doc_id = l.doc_id
        WHERE coalesce(quality, 0) = 0 OR coalesce(toxic, 0) = 0""",
    "vectors": "SELECT vec_id AS id, embedding FROM {embeddings}",
    "vector_seeds": "SELECT vec_id AS id FROM {embeddings} WHERE label = 3",
    "run_scores": """
        SELECT 'run-' || CAST(c_nationkey AS STRING) AS run_id, o_orderkey AS id,
               CAST(floor(o_totalprice / 1000) AS DOUBLE) / 1000 AS score, o_orderpriority = '1-URGENT' AS target
        FROM {orders} JOIN {customer} ON o_custkey = c_custkey""",
    "log": """
        SELECT o_orderkey AS id, o_custkey AS review_paper_id, o_orderkey % 5 AS random_seed,
               'data/review_' || CAST(o_custkey AS STRING) || '/seed_' || CAST(o_orderkey % 5 AS STRING) AS datadir,
               50 AS num_seed_papers, 15 + o_orderkey % 60 AS num_target_papers,
               15 + o_orderkey % 60 - o_orderkey % 4 AS num_target_in_candidates,
               CAST(floor(o_totalprice) AS BIGINT) AS num_candidates, o_totalprice / 1000000 AS score_correctly_predicted,
               o_orderpriority AS clf, o_orderstatus AS features, o_orderdate AS datetime_added,
               c_name || ' review ' || o_orderpriority AS wos_title, n_name AS wos_title_source,
               CAST(year(o_orderdate) AS INT) AS wos_year,
               CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'Engineering; Thermodynamics' WHEN 'BUILDING' THEN 'Materials Science'
                    WHEN 'HOUSEHOLD' THEN 'Psychology; Anthropology' WHEN 'MACHINERY' THEN 'Physics; Optics'
                    ELSE 'Furniture; Art' END AS subject_extended
        FROM {orders} JOIN {customer} ON o_custkey = c_custkey JOIN {nation} ON c_nationkey = n_nationkey""",
    "subjects": """
        SELECT id, review_paper_id, score_correctly_predicted AS score, num_target_papers,
               split_part(subject_extended, '; ', 1) AS subject
        FROM {log}""",
    "venues": """
        SELECT DISTINCT n_name AS title_source, substr(n_name, 1, 3) AS title_source_abbrev,
               c_mktsegment || '; ' || r_name AS subject_extended, c_mktsegment AS subject_traditional,
               CASE n_regionkey WHEN 0 THEN 'Science & Technology' WHEN 1 THEN NULL ELSE 'Social Sciences' END AS heading,
               r_name AS subheading
        FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey JOIN {region} ON n_regionkey = r_regionkey""",
    "reviews": """
        SELECT o_orderkey AS id, CASE WHEN o_orderstatus = 'P' THEN NULL ELSE '10.1/' || CAST(o_custkey AS STRING) END AS doi,
               CAST(o_orderdate AS DATE) AS pub_date, o_orderpriority AS title, o_orderstatus AS title_source,
               CASE WHEN o_orderstatus = 'F' THEN 'Review; Review' ELSE 'Article' END AS doc_type
        FROM {orders}""",
    "review_edges": "SELECT l_orderkey AS id, l_partkey AS cited_id FROM {lineitem}",
    "records": """
        SELECT p_partkey AS id, '10.1/' || CAST(CASE WHEN p_size < 30 THEN p_partkey - p_partkey % 3 ELSE p_partkey END AS STRING) AS doi,
               1950 + p_size AS date, p_name AS title, CAST(p_size AS DOUBLE) AS pagerank
        FROM {part}""",
    "meta": "SELECT n_nationkey AS toplevel_in_tree, CAST(n_regionkey AS STRING) || ':' || CAST(n_nationkey AS STRING) AS meta_cl FROM {nation}",
    "tree_papers": """
        SELECT 'p' || CAST(p_partkey AS STRING) AS id, CAST(p_size AS STRING) || ':' || p_type || ':' || p_brand AS cl
        FROM {part}""",
    "model_scores": """
        SELECT 'run-' || CAST(c_nationkey AS STRING) AS run_id, o_orderpriority AS clf,
               CAST(substr(o_orderpriority, 1, 1) AS INT) AS position,
               avg(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS r_precision
        FROM {orders} JOIN {customer} ON o_custkey = c_custkey GROUP BY 1, 2, 3""",
    "predicted": "SELECT o_totalprice > 250000 AS label, o_orderstatus = 'F' AS prediction FROM {orders}",
}


def _names(sql: str) -> list[str]:
    return sorted({name for _, name, _, _ in string.Formatter().parse(sql) if name})


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table or a view as a DataFrame."""
    if name in TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    sql = VIEWS[name]
    return spark.sql(sql, **{dep: view(spark, sf_dir, dep) for dep in _names(sql)})


# What the operators themselves compute, spelled out for DuckDB only.

def follow_sql(ids: str) -> str:
    touched = f"c.id IN (SELECT id FROM {ids}) OR c.cited_id IN (SELECT id FROM {ids})"
    return f"""
        SELECT DISTINCT unnest([c.id, c.cited_id]) AS id FROM {{citations}} c WHERE {touched}"""


TOKENS = r"regexp_extract_all(lower({text}), '[\p{{{{L}}}}\p{{{{N}}}}_]{{{{2,}}}}')"


def tokens_sql(text: str = "text") -> str:
    return TOKENS.format(text=text)


def prefix_sql(a: str, b: str) -> str:
    """Levels shared by two path lists."""
    return f"len(list_filter(range(1, least(len({a}), len({b})) + 1), lambda i: {a}[1:i] = {b}[1:i]))"


LADDER_SQL = "10, 50, 100, 500, 1000, 10000, 50000, 100000, 500000, 1000000, 5000000, 10000000, 50000000, 100000000"

SQL_VIEWS = VIEWS | {
    "split": """
        SELECT id, row_number() OVER (ORDER BY md5('999:' || id), id) <= CASE WHEN count(*) OVER () < 21 THEN 3 ELSE 20 END AS is_seed
        FROM {id_list}""",
    "seed_ids": "SELECT id FROM {split} WHERE is_seed",
    "target_ids": "SELECT id FROM {split} WHERE NOT is_seed",
    "ring1": follow_sql("{seed_ids}"),
    "ring2": follow_sql("{ring1}"),
    "known_papers": "SELECT * FROM {papers} WHERE cl IS NOT NULL",
    "seeds": "SELECT p.* FROM {known_papers} p JOIN {seed_ids} s ON p.id = s.id",
    "candidates": "SELECT p.* FROM {known_papers} p JOIN {ring2} r ON p.id = r.id",
    "prepared": """
        SELECT c.*, c.id IN (SELECT id FROM {target_ids}) AS target FROM {candidates} c
        WHERE title IS NOT NULL AND c.id NOT IN (SELECT id FROM {seed_ids})""",
    "distances": """
        SELECT cl, avg(((len(a) + len(b)) / 2 - """ + prefix_sql("a", "b") + """) / ((len(a) + len(b)) / 2)) AS avg_distance
        FROM (SELECT DISTINCT cl, string_split(cl, ':') AS a FROM {candidates}) CROSS JOIN
             (SELECT string_split(cl, ':') AS b FROM {seeds}) GROUP BY cl""",
    "all_texts": """
        SELECT id, FALSE AS is_seed, text FROM {text_candidates}
        UNION ALL SELECT id, TRUE, text FROM {text_seeds}""",
    "text_terms": "SELECT id, is_seed, unnest(" + tokens_sql() + ") AS term FROM {all_texts}",
    "text_tf": "SELECT id, is_seed, term, count(*) AS tf FROM {text_terms} GROUP BY ALL",
    "text_idf": """
        SELECT term, ln((1.0 + (SELECT count(*) FROM {all_texts})) / (1.0 + count(*))) + 1.0 AS idf
        FROM {text_tf} GROUP BY term""",
    "text_weights": """
        SELECT id, is_seed, term, tf * idf / sqrt(sum(tf * idf * tf * idf) OVER (PARTITION BY id, is_seed)) AS w
        FROM {text_tf} JOIN {text_idf} USING (term)""",
    "text_mean": """
        SELECT term, sum(w) / (SELECT count(*) FROM {text_seeds}) AS m FROM {text_weights} WHERE is_seed GROUP BY term""",
    "text_similarity": """
        SELECT c.id, any_value(target) AS target,
               coalesce(sum(w * m), 0) / (SELECT sqrt(sum(m * m)) FROM {text_mean}) AS similarity
        FROM {text_candidates} c LEFT JOIN (SELECT * FROM {text_weights} WHERE NOT is_seed) w ON c.id = w.id
             LEFT JOIN {text_mean} m ON w.term = m.term
        GROUP BY c.id""",
    "text_scores": "SELECT id, round(similarity, 9) AS score, target FROM {text_similarity}",
    "text_ranked": """
        SELECT *, row_number() OVER (ORDER BY score DESC, id) AS rank, count(*) OVER () AS n_rows,
               sum(CAST(target AS BIGINT)) OVER (ORDER BY score DESC, id ROWS UNBOUNDED PRECEDING) AS hits,
               sum(CAST(target AS BIGINT)) OVER () AS hits_total
        FROM {text_scores}""",
    "run_ranked": """
        SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY score DESC, id) AS rank,
               count(*) OVER (PARTITION BY run_id) AS n_rows,
               sum(CAST(target AS BIGINT)) OVER (PARTITION BY run_id ORDER BY score DESC, id ROWS UNBOUNDED PRECEDING) AS hits,
               sum(CAST(target AS BIGINT)) OVER (PARTITION BY run_id) AS hits_total
        FROM {run_scores}""",
    "run_steps": """
        SELECT run_id, score, n, pos, row_number() OVER w AS step, sum(n) OVER w AS seen, sum(pos) OVER w AS tp,
               sum(n) OVER (PARTITION BY run_id) AS seen_total, sum(pos) OVER (PARTITION BY run_id) AS tp_total
        FROM (SELECT run_id, score, count(*) AS n, sum(CAST(target AS BIGINT)) AS pos FROM {run_scores} GROUP BY ALL)
        WINDOW w AS (PARTITION BY run_id ORDER BY score DESC ROWS UNBOUNDED PRECEDING)""",
    "top_results": """
        SELECT * FROM {log}
        QUALIFY row_number() OVER (PARTITION BY review_paper_id, random_seed ORDER BY score_correctly_predicted DESC, id) = 1""",
}


def sql(body: str) -> str:
    """A DuckDB statement with the views that ``body`` names as common table expressions."""
    order: list[str] = []

    def need(name: str) -> None:
        if name in TABLES or name in order:
            return
        for dep in _names(SQL_VIEWS[name]):
            need(dep)
        order.append(name)

    for name in _names(body):
        need(name)
    plain = {name: name for name in (*TABLES, *SQL_VIEWS)}
    parts = [f"{name} AS MATERIALIZED ({SQL_VIEWS[name].format(**plain)})" for name in order]
    own = body.format(**plain).strip()
    if not parts:
        return own
    joint = f",\n{own.removeprefix('WITH ')}" if own.startswith("WITH ") else f"\n{own}"
    return "WITH " + ",\n".join(parts) + joint


# The same inputs on the Spark side, through the library.

def seed_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.when(F.col("n_rows") < 21, 3).otherwise(20)
    return split_seeds(view(spark, sf_dir, "id_list"), size, 999)


def seed_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return seed_split(spark, sf_dir).where("is_seed").select("id")


def target_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return seed_split(spark, sf_dir).where("NOT is_seed").select("id")


def paper_sets(spark: SparkSession, sf_dir: str) -> PaperSets:
    """Seeds, targets and candidates of the citation graph."""
    size = F.when(F.col("n_rows") < 21, 3).otherwise(20)
    tables = [view(spark, sf_dir, name) for name in ("id_list", "papers", "citations")]
    return collect_papers(*tables, sample_size=size)


def text_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = title_similarity(
        view(spark, sf_dir, "text_candidates"), view(spark, sf_dir, "text_seeds"), text_col="text", out_col="score"
    )
    return scored.select("id", F.round("score", 9).alias("score"), "target")


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    """All fractional columns to a fixed number of places."""
    return df.select(
        *[
            F.round(F.col(f.name).cast("double"), places).alias(f.name) if isinstance(f.dataType, (DoubleType, FloatType)) else f.name
            for f in df.schema.fields
        ]
    )


Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its own name, with the DuckDB statement that must agree with it."""

    def register(function: Query) -> Query:
        QUERIES[function.__name__] = function
        if oracle is not None:
            ORACLES[function.__name__] = sql(oracle)
        return function

    return register


def union_all(tables: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, tables)


def places_in_files(written: DataFrame) -> DataFrame:
    """Rows of numbered part files with their ``place`` over all of them, from 1."""
    rows = written.withColumns({"_file": F.col("_metadata.file_name"), "_at": F.monotonically_increasing_id()})
    ranked = running_totals(materialize(rows, "rows"), [F.col("_file"), F.col("_at")])
    return ranked.withColumnRenamed("rank", "place").drop("_file", "_at", "n_rows")
