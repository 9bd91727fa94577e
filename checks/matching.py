"""Catalogue matching."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks.fixtures import query, rounded, view
from seedscape.operators import matching
from seedscape.operators.prep import with_doi_and_citations


@query("SELECT p.id, title, year, round(ef, 6) AS ef, cl FROM {part_papers} p WHERE p.id IN (SELECT cited_id FROM {citations})")
def assembled_papers(spark: SparkSession, sf: str) -> DataFrame:
    papers = view(spark, sf, "part_papers")
    wanted = view(spark, sf, "citations").select(F.col("cited_id").alias("id")).distinct()
    parts = papers.select("id", "title", "year"), papers.select("id", "ef"), papers.select("id", "cl")
    return rounded(matching.assemble_papers(wanted, *parts))


@query("""SELECT r.id, doc_type, count(e.id) AS num_citations FROM {reviews} r LEFT JOIN {review_edges} e ON r.id = e.id
          WHERE doc_type = 'Review; Review' GROUP BY ALL""")
def citation_counts(spark: SparkSession, sf: str) -> DataFrame:
    reviews = view(spark, sf, "reviews").where("doc_type = 'Review; Review'").select("id", "doc_type")
    return matching.citation_counts(reviews, view(spark, sf, "review_edges"))


@query("SELECT p_partkey AS id, count(l_partkey) AS num_citations FROM {part} LEFT JOIN {lineitem} ON p_partkey = l_partkey GROUP BY ALL")
def times_cited(spark: SparkSession, sf: str) -> DataFrame:
    parts = view(spark, sf, "part").select(F.col("p_partkey").alias("id"))
    return matching.citation_counts(parts, view(spark, sf, "review_edges"), "cited")


BEST = """(SELECT doi, CAST(count(*) AS BIGINT) AS n_matches,
           CASE WHEN count(*) FILTER (pagerank = top) = 1 THEN min(id) FILTER (pagerank = top) END AS match_id
           FROM (SELECT *, max(pagerank) OVER (PARTITION BY doi) AS top FROM {records}) GROUP BY doi)"""


@query("""SELECT r.id, r.doi, coalesce(n_matches, 0) AS n_matches, match_id,
                 CASE WHEN n_matches > 1 THEN 1 ELSE 0 END AS multiple_match_flag
          FROM {reviews} r LEFT JOIN """ + BEST + " b ON r.doi = b.doi")
def doi_matches(spark: SparkSession, sf: str) -> DataFrame:
    found = matching.match_by_doi(view(spark, sf, "reviews"), view(spark, sf, "records"))
    return found.select("id", "doi", "n_matches", "match_id", "multiple_match_flag")


@query("""SELECT r.id AS wos_id, match_id AS mag_id, r.doi, r.pub_date AS wos_date, r.title AS wos_title,
                 r.title_source AS wos_title_source, n AS wos_num_citations, m.date AS mag_date, m.title AS mag_title,
                 m.pagerank AS mag_pagerank, CASE WHEN n_matches > 1 THEN 1 ELSE 0 END AS multiple_match_flag
          FROM {reviews} r JOIN (SELECT id, count(*) AS n FROM {review_edges} GROUP BY id) c ON r.id = c.id
               JOIN """ + BEST + """ b ON r.doi = b.doi JOIN {records} m ON m.id = b.match_id WHERE n >= 2""")
def doi_match_table(spark: SparkSession, sf: str) -> DataFrame:
    counted = matching.citation_counts(view(spark, sf, "reviews"), view(spark, sf, "review_edges"))
    return matching.doi_match_table(with_doi_and_citations(counted, 2), view(spark, sf, "records"))


@query("""SELECT n_hits, count(*) AS n_reviews FROM (
            SELECT r.id, count(m.id) AS n_hits FROM {reviews} r LEFT JOIN {records} m ON r.doi = m.doi
            WHERE r.doi IS NOT NULL GROUP BY r.id) GROUP BY n_hits""")
def hits_per_doi(spark: SparkSession, sf: str) -> DataFrame:
    return matching.hits_per_doi(view(spark, sf, "reviews"), view(spark, sf, "records"))


@query("""SELECT id, wos_title_source AS title_source, v.subject_extended, heading FROM {log} l
          LEFT JOIN (SELECT * FROM {venues} QUALIFY row_number() OVER (PARTITION BY title_source ORDER BY subject_extended) = 1) v
          ON l.wos_title_source = v.title_source""")
def log_with_venue(spark: SparkSession, sf: str) -> DataFrame:
    log = view(spark, sf, "log").select("id", F.col("wos_title_source").alias("title_source"))
    joined = matching.join_venues(log, view(spark, sf, "venues"), ["subject_extended"])
    return joined.select("id", "title_source", "subject_extended", "heading")


@query("SELECT id, review_paper_id, c_name AS wos_title FROM {log} LEFT JOIN {customer} ON review_paper_id = c_custkey AND c_acctbal > 0")
def log_with_paper_info(spark: SparkSession, sf: str) -> DataFrame:
    info = view(spark, sf, "customer").where("c_acctbal > 0").select(
        F.col("c_custkey").alias("review_paper_id"), F.col("c_name").alias("wos_title")
    )
    log = view(spark, sf, "log").select("id", "review_paper_id")
    return matching.join_paper_info(log, info)


@query("""SELECT id, cl, CAST(split_part(cl, ':', 1) AS INT) AS toplevel, meta_cl AS cl_meta FROM {tree_papers}
          LEFT JOIN {meta} ON toplevel_in_tree = CAST(split_part(cl, ':', 1) AS INT)""")
def meta_clusters(spark: SparkSession, sf: str) -> DataFrame:
    return matching.meta_clusters(view(spark, sf, "tree_papers"), view(spark, sf, "meta"))


SAVED = "(SELECT o_orderkey AS saved_model, datadir, o_orderpriority AS clf, o_orderstatus AS features FROM {orders} JOIN {log} ON id = o_orderkey)"


@query("""SELECT m.saved_model, m.datadir, m.clf, m.features, CASE WHEN count(l.id) = 1 THEN min(l.id) END AS log_id,
                 count(l.id) AS n_rows,
                 CASE count(l.id) WHEN 1 THEN 'matched' WHEN 0 THEN 'none' ELSE 'many' END AS status
          FROM """ + SAVED + """ m LEFT JOIN (SELECT * FROM {log} WHERE num_candidates > 50000) l
          ON m.datadir = l.datadir AND m.clf = l.clf AND m.features = l.features GROUP BY ALL""")
def models_in_log(spark: SparkSession, sf: str) -> DataFrame:
    log = view(spark, sf, "log")
    models = log.select(F.col("id").alias("saved_model"), "datadir", "clf", "features")
    return matching.match_models_to_log(models, log.where("num_candidates > 50000"))


@query("""SELECT l.id, l.datadir, l.clf, s.clf AS saved_clf, l.clf = s.clf AS agrees
          FROM {log} l
          JOIN (SELECT * FROM {log} QUALIFY row_number() OVER (PARTITION BY datadir ORDER BY id) = 1) s ON l.datadir = s.datadir""")
def saved_model_agrees(spark: SparkSession, sf: str) -> DataFrame:
    log = view(spark, sf, "log").select("id", "datadir", "clf")
    saved = matching.first_row_per(log, "datadir", ["id"])
    return matching.saved_model_agrees(log, saved)


@query("SELECT o_orderkey AS id, o_custkey AS journal_id FROM {orders} WHERE o_custkey = 3")
def papers_of_journal(spark: SparkSession, sf: str) -> DataFrame:
    papers = view(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("journal_id"))
    return matching.papers_of_journal(papers, 3)


@query("SELECT l_orderkey AS id, o_orderpriority AS title FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey WHERE l_suppkey = 3")
def papers_of_author(spark: SparkSession, sf: str) -> DataFrame:
    authorship = view(spark, sf, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_suppkey").alias("author_id"))
    papers = view(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("title"))
    return matching.papers_of_author(authorship, papers, 3)
