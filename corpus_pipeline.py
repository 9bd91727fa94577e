"""From raw documents to token ids: keep good ones, one of each group of near copies, none that holds
benchmark text, with personal values replaced, and encode them.

Each stage takes the documents that the one before has kept, in the columns of ``documents``, and
reads other tables from ``sf_dir`` itself. What each of them does with nulls, repeated rows and
empty tables is said at the operator it calls; rows with a null id are never dropped as copies.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seedscape.llm import bpe, decontaminate, pii, quality, simhash
from seedscape.llm.common import delete_table, read_table
from seedscape.llm.near_copies import near_copies
from seedscape.llm.queries import PATTERN, PSEUDONYM_KEY, RANKS
from seedscape.scratch import new_path


def _kept(docs: DataFrame, judged: Callable[[DataFrame], DataFrame], names: set[str]) -> DataFrame:
    """The rows that ``judged`` leaves, in their own columns also where those have the ``names`` it adds."""
    aside = {c: f"_given_{c}" for c in docs.columns if c in names}
    return judged(docs.withColumnsRenamed(aside)).select(*[F.col(aside.get(c, c)).alias(c) for c in docs.columns])


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that the classifier, fitted on the labelled ones among them, rejects."""
    model = quality.fit(docs, read_table(spark, sf_dir, "labels"))
    added = {"content_score", "metadata_score", "quality", "keep"}
    return _kept(docs, lambda given: quality.score(given, model).filter("keep"), added)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the smallest id of each group of near copies: five-word shingles, a similarity of 0.8 or more."""
    return simhash.one_per_component(docs, near_copies, size=5, similarity=0.8)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents of which at least one word in twenty lies in a passage of a benchmark item."""
    items = read_table(spark, sf_dir, "benchmark")
    clean = lambda given: decontaminate.find_windows(given, items).filter(~decontaminate.is_contaminated())
    return _kept(docs, clean, {"n_words", "hits", "items"})


def replace_personal_values(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Put pseudonyms in the place of personal values; ``n_chars`` follows the new text."""
    changed = pii.pseudonymize(docs, PSEUDONYM_KEY, out_col="_places")
    if "n_chars" in docs.columns:
        length = F.when(F.size("_places") > 0, F.length("text")).otherwise(F.col("n_chars"))
        changed = changed.withColumn("n_chars", length.cast(docs.schema["n_chars"].dataType))
    return changed.select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, and a digest of what they decode to."""
    coded = bpe.encode(docs.select("doc_id", "text"), RANKS, PATTERN, decoded_col="decoded")
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("quality_classifier", keep_good),
    ("simhash_near_dedup", drop_near_copies),
    ("benchmark_decontamination", drop_contaminated),
    ("pii", replace_personal_values),
    ("bpe", encode),
]

#: No SQL form: a fitted classifier, XXH64 fingerprints and a tokenizer. tests/llm holds it against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages on ``documents``. What one has kept is written to the shared folder, read by the next and then deleted."""
    docs = read_table(spark, sf_dir, "documents")
    written = None
    for name, stage in STAGES[:-1]:
        path = new_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if written:
            delete_table(spark, written)
        written = path
    return STAGES[-1][1](spark, docs, sf_dir)
