"""Writing paper sets, predictions, models and logs."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seedscape.operators.model_tables import parts_of
from seedscape.operators.prep import infer_year_column
from seedscape.scratch import new_path


def write_new(df: DataFrame, path: str) -> None:
    """Parquet at a path that must not exist."""
    df.write.mode("errorifexists").parquet(path)


def with_year_and_rank(papers: DataFrame) -> DataFrame:
    """The saved form: a ``year`` from ``pub_date`` where there is no year column, and ``flow`` named ``ef``."""
    out = papers
    if infer_year_column(papers.columns) is None:
        out = out.withColumn("year", F.year("pub_date"))
    return out.withColumnRenamed("flow", "ef")


def save_paper_set(papers: DataFrame, folder: str, name: str) -> None:
    write_new(with_year_and_rank(papers), f"{folder}/{name}.parquet")


def non_targets(predictions: DataFrame) -> DataFrame:
    return predictions.where(~F.col("target")).drop("target")


def top_predictions(predictions: DataFrame, n: int | None = None, score: str = "pred_ranks") -> DataFrame:
    """Best non-targets first, all of them or ``n``."""
    ordered = non_targets(predictions).orderBy(F.col(score).desc(), "id")
    return ordered if n is None else ordered.limit(n)


def write_predictions(predictions: DataFrame, folder: str, score: str = "pred_ranks") -> None:
    """Every target flag in rank order (compressed, no header) and the best 100 non-targets (tab-separated).

    The sort leaves the flags in numbered part files that follow each other.
    """
    ordered = predictions.orderBy(F.col(score).desc(), "id").select("target")
    ordered.write.mode("errorifexists").csv(f"{folder}/all_pred_y_target.csv.gz", compression="gzip", header=False)
    top_predictions(predictions, 100, score).write.mode("errorifexists").csv(
        f"{folder}/predictions.tsv", sep="\t", header=True
    )


def write_id_list(ids: DataFrame, path: str) -> None:
    """One ID per line."""
    ids.select(F.col("id").cast("string").alias("value")).write.mode("errorifexists").text(path)


def write_paper_info(info: DataFrame, path: str) -> None:
    """One JSON record per line."""
    info.write.mode("errorifexists").json(path)


def append_log(rows: DataFrame, path: str) -> None:
    """Add experiment rows; the first call creates the table."""
    rows.write.mode("append").parquet(path)


def save_model(model: PipelineModel, path: str) -> None:
    """Save a model as the library does, and beside it, where its kind has such a form, as a table of its parts."""
    model.write().save(path)
    spark = SparkSession.active()
    parts = parts_of(spark, model, new_path(spark, "forest"))
    if parts is not None:
        write_new(parts, f"{path}_parts.parquet")
