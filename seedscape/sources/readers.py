"""Reading papers, citations, ID lists and results."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from seedscape.operators.prep import canonical

# Canonical column types.
PAPER_TYPES = {"id": "string", "title": "string", "year": "int", "ef": "double", "cl": "string"}
EDGE_TYPES = {"id": "string", "cited_id": "string"}


def is_tab_separated(path: str, fmt: str | None = None) -> bool:
    """Tab-separated if the format or the path says so; anything else is parquet."""
    name = path.lower()
    if (fmt or "").lower() == "tsv":
        return True
    return "parquet" not in name and ("csv" in name or "tsv" in name)


def read_table(spark: SparkSession, path: str, fmt: str | None = None, schema: StructType | str | None = None) -> DataFrame:
    """A tab-separated file with a header (strings, unless a schema is given) or parquet."""
    reader = spark.read.schema(schema) if schema else spark.read
    if is_tab_separated(str(path), fmt):
        return reader.csv(str(path), sep="\t", header=True)
    return reader.parquet(str(path))


def load(spark: SparkSession, source: str | DataFrame, fmt: str | None = None) -> DataFrame:
    """A path to read, or a table already at hand."""
    if isinstance(source, DataFrame):
        return source
    if isinstance(source, str):
        return read_table(spark, source, fmt)
    raise TypeError(f"expected a path or a DataFrame, got {type(source).__name__}")


def read_papers(spark: SparkSession, source: str | DataFrame, names: Mapping[str, str], fmt: str | None = None) -> DataFrame:
    """Papers under canonical names and types."""
    return canonical(load(spark, source, fmt), names, PAPER_TYPES)


def read_citations(
    spark: SparkSession, source: str | DataFrame, citing: str = "id", cited: str = "cited_id", fmt: str | None = None
) -> DataFrame:
    """Edges ``(id, cited_id)``; other columns are not read."""
    edges = canonical(load(spark, source, fmt), {citing: "id", cited: "cited_id"}, EDGE_TYPES)
    return edges.select("id", "cited_id")


def clean_ids(lines: DataFrame, column: str = "value") -> DataFrame:
    """Trimmed, non-empty IDs as strings."""
    trimmed = lines.select(F.trim(F.col(column).cast("string")).alias("id"))
    return trimmed.where(F.col("id") != "")


def read_id_list(spark: SparkSession, path: str, header: bool = False, keep_blank: bool = False) -> DataFrame:
    """One ID per line. ``header`` skips the first line of each file; ``keep_blank`` keeps empty lines."""
    lines = spark.read.text(path)
    if header:
        lines = _without_first_lines(lines)
    if keep_blank:
        return lines.select(F.trim("value").alias("id"))
    return clean_ids(lines)


def _without_first_lines(lines: DataFrame) -> DataFrame:
    """Lines of text files without each file's first: the one that comes first in the file's first block."""
    placed = lines.select("value", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"))
    placed = placed.withColumn("_at", F.monotonically_increasing_id())
    first = placed.where("_block = 0").groupBy("_file").agg(F.min("_at").alias("_at"))
    return placed.join(first, ["_file", "_at"], "left_anti").select("value")


def read_log(spark: SparkSession, source: str, **options: str) -> DataFrame:
    """The whole experiment log: a JDBC table when ``url`` is given, a known table name, or a path."""
    if "url" in options:
        return spark.read.format("jdbc").options(dbtable=source, **options).load()
    is_path = "/" in source or "\\" in source
    return read_table(spark, source) if is_path else spark.table(source)


def read_paper_info(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """JSON records, one per line, with the year of ``mag_date`` (milliseconds, UTC)."""
    info = spark.read.schema(schema).json(path)
    return info.withColumn("year", year_of_millis(F.col("mag_date")))


def only_paper_info(info: DataFrame, condition: Column) -> DataFrame:
    """The one record that meets the condition; fails unless it is exactly one."""
    found = info.where(condition)
    if len(found.take(2)) != 1:
        raise RuntimeError("expected exactly one record for the paper, but there is none or more than one")
    return found


def year_of_millis(millis: Column) -> Column:
    """Calendar year in UTC of a number of milliseconds since 1970."""
    day = F.date_add(F.lit("1970-01-01").cast("date"), F.floor(millis / 86_400_000).cast("int"))
    return F.year(day)


def read_paper_sets(
    spark: SparkSession, folder: str, names: tuple[str, ...] = ("test_papers", "seed_papers", "target_papers")
) -> dict[str, DataFrame]:
    """The saved paper sets without exact duplicate rows."""
    return {name: spark.read.parquet(f"{folder}/{name}.parquet").dropDuplicates() for name in names}


def read_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def find_model(path: str) -> PipelineModel | None:
    """The model saved at ``path``, or None if there is no such folder."""
    spark = SparkSession.active()
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder)
    return read_model(path) if there else None


def _full_name(spark: SparkSession, path: str) -> str | None:
    """A folder as Spark names it in the paths of its files; None if it does not exist."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return system.makeQualified(folder).toUri().toString() if system.exists(folder) else None


def read_of_runs(spark: SparkSession, folders: dict[object, str], name: str, run: str = "run_id", kind: str = "string") -> DataFrame | None:
    """The table ``name`` of many runs in one scan, with the run each row belongs to; None if no run has it.

    ``folders`` maps runs to their folders. Runs without such a table have no rows; the tables must have the same columns.
    """
    names = [(key, path, _full_name(spark, path)) for key, folder in folders.items() for path in [f"{folder}/{name}"]]
    found = [(key, full) for key, _, full in names if full]
    if not found:
        return None
    plain = lambda path: F.regexp_replace(path, "^([A-Za-z0-9]+):/+", "$1:/")
    runs = spark.createDataFrame(found, f"`{run}` {kind}, _path string").withColumn("_path", plain(F.col("_path")))
    rows = spark.read.parquet(*sorted({path for _, path, full in names if full}))
    placed = rows.withColumn("_path", plain(F.regexp_replace(F.col("_metadata.file_path"), "/[^/]*$", "")))
    return placed.join(runs, "_path").drop("_path")
