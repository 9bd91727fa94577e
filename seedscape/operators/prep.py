"""Cleaning and flagging candidates before a model sees them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def canonical(df: DataFrame, names: Mapping[str, str], types: Mapping[str, str] | None = None) -> DataFrame:
    """Rename ``names`` (given to canonical), cast ``types``, and fail on a missing column."""
    missing = [given for given in names if given not in df.columns]
    if missing:
        raise ValueError(f"columns not found: {missing}; the table has {df.columns}")
    renamed = df.withColumnsRenamed(dict(names))
    return renamed.withColumns({c: F.col(c).cast(t) for c, t in (types or {}).items() if c in renamed.columns})


def ids_as_strings(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("string") for c in columns})


def drop_unclustered(papers: DataFrame, cluster_col: str = "cl") -> DataFrame:
    return papers.dropna(subset=[cluster_col])


def drop_missing_titles(papers: DataFrame, title_col: str = "title") -> DataFrame:
    return papers.dropna(subset=[title_col])


def count_missing(papers: DataFrame, column: str) -> DataFrame:
    """Rows before a null filter, rows it removes, and rows after."""
    return papers.agg(
        F.count("*").alias("n_before"),
        F.count_if(F.col(column).isNull()).alias("n_removed"),
        F.count(column).alias("n_after"),
    )


def infer_year_column(columns: Sequence[str]) -> str | None:
    """Best guess at the year column: an exact name first, then any name with "year" in it."""
    by_name: dict[str, str] = {}
    for column in columns:
        by_name.setdefault(column.lower(), column)
    for wanted in ("year", "paper_year", "pub_year"):
        if wanted in by_name:
            return by_name[wanted]
    return next((c for c in columns if "year" in c.lower()), None)


def year_lowpass_filter(papers: DataFrame, year: int | Column | None, year_col: str | None = None) -> DataFrame:
    """Keep papers up to ``year``; without a year nothing is removed."""
    if year is None:
        return papers
    return papers.where(F.col(year_col or infer_year_column(papers.columns) or "year") <= year)


def flag_targets(candidates: DataFrame, targets: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Add ``target``: is the candidate one of the held-out papers."""
    hits = targets.select(*by, "id", F.lit(True).alias("_hit")).distinct()
    flagged = candidates.join(hits, [*by, "id"], "left")
    return flagged.withColumn("target", F.col("_hit").isNotNull()).drop("_hit")


def remove_seeds(candidates: DataFrame, seeds: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return candidates.join(seeds.select(*by, "id"), [*by, "id"], "left_anti")


def prepare_candidates(
    candidates: DataFrame,
    seeds: DataFrame,
    targets: DataFrame,
    year: int | Column | None = None,
    title_col: str = "title",
    by: Sequence[str] = (),
) -> DataFrame:
    """Seeds out, targets flagged, missing titles out, late years out."""
    kept = drop_missing_titles(remove_seeds(candidates, seeds, by), title_col)
    return flag_targets(year_lowpass_filter(kept, year), targets, by)


def with_doi_and_citations(papers: DataFrame, min_citations: int) -> DataFrame:
    """Papers with a DOI and enough citations, most cited first."""
    kept = papers.where(F.col("doi").isNotNull() & (F.col("num_citations") >= min_citations))
    return kept.orderBy(F.col("num_citations").desc(), "id")


def above_rank_floor(papers: DataFrame, rank_col: str = "ef") -> DataFrame:
    """Drop papers whose rank equals the lowest rank of all."""
    return papers.where(F.col(rank_col) > papers.agg(F.min(rank_col)).scalar())


def clean_review_matches(matches: DataFrame) -> DataFrame:
    """Matches with a date and a flag, both in their own types."""
    kept = matches.dropna(subset=["mag_date", "multiple_match_flag"])
    return kept.withColumns(
        {
            "mag_date": F.to_timestamp("mag_date"),
            "multiple_match_flag": F.col("multiple_match_flag").cast("double").cast("int"),
        }
    )
