"""Column expressions on texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: a term is a run of two or more word characters.
TERM_PATTERN = r"[\p{L}\p{N}_]{2,}"


def terms(text: Column) -> Column:
    """Lower-case terms of a text in order; a null text has none."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TERM_PATTERN), F.lit(0))


def contains_word(text: Column, word: str) -> Column:
    """Whether the lower-case text holds ``word`` anywhere."""
    return F.lower(text).contains(word.lower())


def first_listed(listing: Column, sep: str = "; ") -> Column:
    """First item of a separated list."""
    return F.call_function("substring_index", listing, F.lit(sep), F.lit(1))


def text_from_positions(index: Column) -> Column:
    """Words of an inverted index (word to positions) put back in order; absent positions are skipped."""
    placed = F.flatten(
        F.transform(
            F.map_entries(index),
            lambda e: F.transform(e["value"], lambda p: F.struct(p.alias("at"), e["key"].alias("word"))),
        )
    )
    return F.transform(F.array_sort(placed), lambda s: s["word"])


def text_from_json(record: Column) -> Column:
    """The same from a JSON record of an inverted index and its length; null if the record is not of that form."""
    index = F.from_json(record, "IndexLength int, InvertedIndex map<string, array<int>>")["InvertedIndex"]
    return text_from_positions(index)
