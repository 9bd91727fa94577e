"""Cleaning, flags, splits."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks.fixtures import query, rounded, seed_ids, seed_split, target_ids, view
from seedscape.functions.text import first_listed
from seedscape.operators import matching, prep, sampling, subjects, summary
from seedscape.operators.graph import attach_papers, expand
from seedscape.operators.matching import first_row_per
from seedscape.operators.subjects import BROAD_FIELDS
from seedscape.sources.readers import read_papers

FIELD_ROWS = ", ".join(f"('{s}', '{f}')" for s, f in BROAD_FIELDS.items())
FIELDS_SQL = f"(VALUES {FIELD_ROWS}) AS fields(subject, field)"


@query("SELECT id, title, CAST(year AS INT) AS year, round(ef, 6) AS ef, cl FROM {papers}")
def canonical_names(spark: SparkSession, sf: str) -> DataFrame:
    papers = view(spark, sf, "papers").withColumnsRenamed({"id": "UID", "ef": "flow"})
    return rounded(read_papers(spark, papers, {"UID": "id", "flow": "ef"}).select("id", "title", "year", "ef", "cl"))


@query("SELECT CAST(l_orderkey AS STRING) AS id, CAST(l_partkey AS STRING) AS cited_id FROM {lineitem}")
def ids_cast_to_strings(spark: SparkSession, sf: str) -> DataFrame:
    edges = view(spark, sf, "review_edges")
    return prep.ids_as_strings(edges, "id", "cited_id")


@query("SELECT id, cl FROM {papers} WHERE cl IS NOT NULL")
def drop_unclustered(spark: SparkSession, sf: str) -> DataFrame:
    return prep.drop_unclustered(view(spark, sf, "papers")).select("id", "cl")


@query("SELECT id, title FROM {papers} WHERE title IS NOT NULL")
def drop_missing_titles(spark: SparkSession, sf: str) -> DataFrame:
    return prep.drop_missing_titles(view(spark, sf, "papers")).select("id", "title")


@query("SELECT count(*) AS n_before, count(*) - count(title) AS n_removed, count(title) AS n_after FROM {papers}")
def count_missing_titles(spark: SparkSession, sf: str) -> DataFrame:
    return prep.count_missing(view(spark, sf, "papers"), "title")


@query("SELECT year, count(*) AS n FROM {papers} GROUP BY year")
def papers_per_inferred_year(spark: SparkSession, sf: str) -> DataFrame:
    papers = view(spark, sf, "papers").withColumnRenamed("year", "Paper_Year")
    column = prep.infer_year_column(papers.columns)
    return papers.groupBy(F.col(column).alias("year")).agg(F.count("*").alias("n"))


@query("SELECT id, year FROM {papers} WHERE year <= 1996")
def year_lowpass(spark: SparkSession, sf: str) -> DataFrame:
    return prep.year_lowpass_filter(view(spark, sf, "papers"), 1996).select("id", "year")


@query("SELECT o_orderkey AS id, CASE WHEN o_orderstatus = 'P' THEN NULL ELSE CAST(year(o_orderdate) AS INT) END AS year FROM {orders}")
def year_of_date(spark: SparkSession, sf: str) -> DataFrame:
    date = F.when(F.col("o_orderstatus") != "P", F.col("o_orderdate"))
    return view(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.year(date).alias("year"))


@query("SELECT id, id IN (SELECT id FROM {target_ids}) AS target FROM {papers}")
def target_flag(spark: SparkSession, sf: str) -> DataFrame:
    return prep.flag_targets(view(spark, sf, "papers"), target_ids(spark, sf)).select("id", "target")


@query("SELECT id FROM {papers} WHERE id NOT IN (SELECT id FROM {seed_ids})")
def without_seeds(spark: SparkSession, sf: str) -> DataFrame:
    return prep.remove_seeds(view(spark, sf, "papers"), seed_ids(spark, sf)).select("id")


@query("SELECT id, title, year, target FROM {prepared} WHERE year <= 1997")
def prepared_candidates(spark: SparkSession, sf: str) -> DataFrame:
    known = prep.drop_unclustered(view(spark, sf, "papers"))
    seeds, targets = seed_ids(spark, sf), target_ids(spark, sf)
    reached = attach_papers(expand(seeds, view(spark, sf, "citations")), known)
    return prep.prepare_candidates(reached, seeds, targets, 1997).select("id", "title", "year", "target")


@query("""SELECT r.id, r.doi, num_citations FROM {reviews} r
          JOIN (SELECT id, count(*) AS num_citations FROM {review_edges} GROUP BY id) c ON r.id = c.id
          WHERE doi IS NOT NULL AND num_citations >= 3""")
def doi_and_citation_filter(spark: SparkSession, sf: str) -> DataFrame:
    counted = matching.citation_counts(view(spark, sf, "reviews"), view(spark, sf, "review_edges"))
    return prep.with_doi_and_citations(counted, 3).select("id", "doi", "num_citations")


@query("SELECT id, round(ef, 6) AS ef FROM {papers} WHERE ef > (SELECT min(ef) FROM {papers})")
def above_rank_floor(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(prep.above_rank_floor(view(spark, sf, "papers").select("id", "ef")))


@query("""SELECT o_orderkey AS id, strftime(o_orderdate, '%Y-%m-%d') AS mag_date, CAST(o_orderkey % 2 AS INT) AS multiple_match_flag
          FROM {orders} WHERE o_orderstatus <> 'P' AND o_orderpriority <> '5-LOW'""")
def clean_review_matches(spark: SparkSession, sf: str) -> DataFrame:
    raw = view(spark, sf, "orders").select(
        F.col("o_orderkey").alias("id"),
        F.when(F.col("o_orderstatus") != "P", F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss")).alias("mag_date"),
        F.when(F.col("o_orderpriority") != "5-LOW", (F.col("o_orderkey") % 2).cast("double").cast("string")).alias(
            "multiple_match_flag"
        ),
    )
    return prep.clean_review_matches(raw).withColumn("mag_date", F.date_format("mag_date", "yyyy-MM-dd"))


@query("SELECT id, split_part(subject_extended, '; ', 1) AS subject FROM {log}")
def first_subject(spark: SparkSession, sf: str) -> DataFrame:
    return view(spark, sf, "log").select("id", first_listed(F.col("subject_extended")).alias("subject"))


@query("SELECT id, s.subject, coalesce(field, 'Other') AS field FROM {subjects} s LEFT JOIN " + FIELDS_SQL + " ON s.subject = fields.subject")
def subject_roll_up(spark: SparkSession, sf: str) -> DataFrame:
    return subjects.roll_up(view(spark, sf, "subjects"), "subject").select("id", "subject", "field")


@query("SELECT subject, count(*) AS n FROM {subjects} WHERE subject NOT IN (SELECT subject FROM " + FIELDS_SQL + ") GROUP BY subject")
def unmapped_subjects(spark: SparkSession, sf: str) -> DataFrame:
    return subjects.unmapped(view(spark, sf, "subjects"), "subject")


@query("""SELECT round(avg(CASE WHEN contains(lower(wos_title), 'urgent') THEN 1 ELSE 0 END), 6) AS share,
                 round(avg(score_correctly_predicted) FILTER (contains(lower(wos_title), 'urgent')), 6) AS mean_score FROM {log}""")
def titles_with_word(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(summary.share_with_word(view(spark, sf, "log"), "wos_title", "Urgent", "score_correctly_predicted"))


@query("SELECT id, num_target_papers FROM {log} WHERE 0.2 < score_correctly_predicted AND score_correctly_predicted < 0.4 AND num_target_papers >= 20")
def range_filter(spark: SparkSession, sf: str) -> DataFrame:
    score = F.col("score_correctly_predicted")
    kept = view(spark, sf, "log").where((score > 0.2) & (score < 0.4) & (F.col("num_target_papers") >= 20))
    return kept.select("id", "num_target_papers")


@query("SELECT id, doi, doc_type FROM {reviews}")
def doc_type_columns(spark: SparkSession, sf: str) -> DataFrame:
    return view(spark, sf, "reviews").select("id", "doi", "doc_type")


@query("""SELECT id, num_target_papers - num_target_in_candidates AS num_target_not_in_candidates,
                 round(num_target_in_candidates / num_target_papers, 6) AS share_in_candidates,
                 num_seed_papers + num_target_papers AS num_references FROM {log}""")
def run_shares(spark: SparkSession, sf: str) -> DataFrame:
    shares = summary.run_shares(view(spark, sf, "log"))
    return rounded(shares.select("id", "num_target_not_in_candidates", "share_in_candidates", "num_references"))


FIRST_PER_REVIEW = """(SELECT * FROM {log} QUALIFY row_number() OVER (PARTITION BY review_paper_id ORDER BY id) = 1) l
    LEFT JOIN (SELECT * FROM {venues} QUALIFY row_number() OVER (PARTITION BY title_source ORDER BY subject_extended) = 1) v
    ON l.wos_title_source = v.title_source"""


def _reviews_with_venue(spark: SparkSession, sf: str) -> DataFrame:
    reviews = first_row_per(view(spark, sf, "log"), "review_paper_id", ["id"])
    renamed = reviews.withColumnRenamed("wos_title_source", "title_source").drop("subject_extended")
    return matching.join_venues(renamed, view(spark, sf, "venues"), ["subject_extended"])


@query("SELECT review_paper_id, heading FROM " + FIRST_PER_REVIEW + " WHERE heading = 'Science & Technology'")
def reviews_of_heading(spark: SparkSession, sf: str) -> DataFrame:
    found = _reviews_with_venue(spark, sf)
    return found.where("heading = 'Science & Technology'").select("review_paper_id", "heading")


@query("SELECT review_paper_id, title_source FROM " + FIRST_PER_REVIEW + " WHERE heading IS NULL")
def reviews_without_heading(spark: SparkSession, sf: str) -> DataFrame:
    return _reviews_with_venue(spark, sf).where("heading IS NULL").select("review_paper_id", "title_source")


@query("SELECT id, is_seed FROM {split}")
def seed_target_split(spark: SparkSession, sf: str) -> DataFrame:
    return seed_split(spark, sf)


@query("""SELECT o_orderkey AS id, row_number() OVER (ORDER BY md5('999:' || CAST(o_orderkey AS STRING)), o_orderkey)
          <= count(*) OVER () * 4 // 5 AS is_train FROM {orders}""")
def train_test_split(spark: SparkSession, sf: str) -> DataFrame:
    return sampling.split_train(view(spark, sf, "orders").select(F.col("o_orderkey").alias("id")))


@query("SELECT doc_id AS id FROM {documents} ORDER BY md5('5:' || CAST(doc_id AS STRING)), doc_id LIMIT 100")
def sampled_rows(spark: SparkSession, sf: str) -> DataFrame:
    return sampling.sample_rows(view(spark, sf, "texts").select("id"), 100, seed=5)
