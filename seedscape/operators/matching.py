"""Matching records of different catalogues to each other."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seedscape.functions.paths import SEPARATOR, first_part
from seedscape.operators.skew import lookup_join


def assemble_papers(ids: DataFrame, papers: DataFrame, ranks: DataFrame, tree: DataFrame) -> DataFrame:
    """Title, year, rank and cluster path of the wanted IDs that all three tables know."""
    wanted = papers.join(ids.select("id"), "id", "left_semi").select("id", "title", "year")
    return wanted.join(ranks.select("id", "ef"), "id").join(tree.select("id", "cl"), "id")


def citation_counts(papers: DataFrame, edges: DataFrame, side: str = "citing") -> DataFrame:
    """Papers with ``num_citations``, the number of edges that have them on the given side."""
    end = {"citing": "id", "cited": "cited_id"}[side]
    counts = edges.groupBy(F.col(end).alias("id")).agg(F.count("*").alias("num_citations"))
    joined = papers.join(counts, "id", "left")
    return joined.withColumn("num_citations", F.coalesce("num_citations", F.lit(0)))


def best_record_per_doi(records: DataFrame) -> DataFrame:
    """One row per DOI: its number of records and the single highest-ranked record, if there is one.

    Records are counted per (DOI, rank) first, so that a DOI shared by very many
    records shrinks before it meets the others.
    """
    fields = [c for c in records.columns if c != "doi"]
    per_rank = (
        records.where(F.col("doi").isNotNull())
        .groupBy("doi", "pagerank")
        .agg(F.count("*").alias("n"), F.min(F.struct(*fields)).alias("record"))
    )
    best = per_rank.groupBy("doi").agg(
        F.sum("n").alias("n_matches"), F.max_by(F.struct("n", "record"), F.struct("pagerank")).alias("top")
    )
    alone = F.col("top.n") == 1
    return best.select(
        "doi",
        "n_matches",
        (F.col("n_matches") > 1).cast("int").alias("multiple_match_flag"),
        *[F.when(alone, F.col(f"top.record.{c}")).alias(f"match_{c}") for c in fields],
    )


def match_by_doi(reviews: DataFrame, records: DataFrame) -> DataFrame:
    """Each review with the record its DOI points to; no record when none exists or the first place is tied."""
    wanted = records.join(reviews.select("doi").distinct(), "doi", "left_semi")
    found = lookup_join(reviews, best_record_per_doi(wanted), ["doi"], "left", salt_on=["id"])
    return found.withColumns(
        {
            "n_matches": F.coalesce("n_matches", F.lit(0)),
            "multiple_match_flag": F.coalesce("multiple_match_flag", F.lit(0)),
        }
    )


def doi_match_table(reviews: DataFrame, records: DataFrame) -> DataFrame:
    """The report of matched reviews, with both sides' date and title."""
    found = match_by_doi(reviews, records).where(F.col("match_id").isNotNull())
    return found.select(
        F.col("id").alias("wos_id"),
        F.col("match_id").alias("mag_id"),
        "doi",
        F.col("pub_date").alias("wos_date"),
        F.col("title").alias("wos_title"),
        F.col("title_source").alias("wos_title_source"),
        F.col("num_citations").alias("wos_num_citations"),
        F.col("match_date").alias("mag_date"),
        F.col("match_title").alias("mag_title"),
        F.col("match_pagerank").alias("mag_pagerank"),
        "multiple_match_flag",
    )


def hits_per_doi(reviews: DataFrame, records: DataFrame) -> DataFrame:
    """How many reviews have 0, 1, 2, ... records with their DOI."""
    per_doi = records.where(F.col("doi").isNotNull()).groupBy("doi").agg(F.count("*").alias("n_hits"))
    asked = reviews.where(F.col("doi").isNotNull()).groupBy("doi").agg(F.count("*").alias("n_asked"))
    hits = asked.join(per_doi, "doi", "left").select(F.coalesce("n_hits", F.lit(0)).alias("n_hits"), "n_asked")
    return hits.groupBy("n_hits").agg(F.sum("n_asked").alias("n_reviews"))


def first_row_per(table: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """The first row of each key in the given order, without sorting any group."""
    rest = [c for c in table.columns if c != key]
    first = table.groupBy(key).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("row"))
    return first.select(key, "row.*")


def join_venues(
    rows: DataFrame, venues: DataFrame, order: Sequence[str], key: str = "title_source", salt_on: Sequence[str] = ("id",)
) -> DataFrame:
    """Left join with the venue table, cut to one row per venue first."""
    return lookup_join(rows, first_row_per(venues, key, order), [key], "left", salt_on)


def join_paper_info(log: DataFrame, info: DataFrame, key: str = "review_paper_id") -> DataFrame:
    """Left join of log rows with the review's info record."""
    return lookup_join(log, info, [key], "left", salt_on=["id"])


def meta_clusters(papers: DataFrame, meta: DataFrame, path_col: str = "cl", sep: str = SEPARATOR) -> DataFrame:
    """Add ``cl_meta``, the broader cluster of the path's top level; null where the map has none."""
    top = papers.withColumn("toplevel", first_part(F.col(path_col), sep))
    lookup = meta.select(F.col("toplevel_in_tree").alias("toplevel"), F.col("meta_cl").alias("cl_meta"))
    return lookup_join(top, lookup, ["toplevel"], "left", salt_on=["id"])


def match_models_to_log(models: DataFrame, log: DataFrame) -> DataFrame:
    """The log row of each saved model, accepted only when exactly one fits."""
    key = ["datadir", "clf", "features"]
    logged = log.groupBy(*key).agg(F.count("*").alias("n_rows"), F.min("id").alias("log_id"))
    found = lookup_join(models, logged, key, "left", salt_on=["saved_model"])
    n_rows = F.coalesce("n_rows", F.lit(0))
    return found.select(
        "saved_model",
        *key,
        F.when(n_rows == 1, F.col("log_id")).alias("log_id"),
        n_rows.alias("n_rows"),
        F.when(n_rows == 1, "matched").when(n_rows == 0, "none").otherwise("many").alias("status"),
    )


def saved_model_agrees(runs: DataFrame, models: DataFrame) -> DataFrame:
    """Per logged run, whether the saved classifier is the logged one."""
    saved = models.select("datadir", F.col("clf").alias("saved_clf"))
    joined = lookup_join(runs, saved, ["datadir"], "inner", salt_on=["id"])
    return joined.select("id", "datadir", "clf", "saved_clf", (F.col("clf") == F.col("saved_clf")).alias("agrees"))


def papers_of_journal(papers: DataFrame, journal_id: int) -> DataFrame:
    return papers.where(F.col("journal_id") == journal_id)


def papers_of_author(authorship: DataFrame, papers: DataFrame, author_id: int) -> DataFrame:
    """Papers of one author, one row per authorship with a known paper."""
    return authorship.where(F.col("author_id") == author_id).select("id").join(papers, "id")
