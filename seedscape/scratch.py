"""Shared storage for intermediate tables.

A cut in the lineage is a parquet table in the folder the session names in
``spark.checkpoint.dir``, so a lost executor never loses it, and the reader sees
the real size of the table when it picks a join.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession

# Fixed value: the setting of Spark that drops the shuffle files of a query at its end.
DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder for intermediate tables; only local sessions may fall back to one of our own."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if folder:
        return folder
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return _own_folder(context.applicationId)


@lru_cache(maxsize=None)
def _own_folder(application: str) -> str:
    return tempfile.mkdtemp(prefix="seedscape-")


def new_path(spark: SparkSession, label: str = "table") -> str:
    """A path below the shared folder that nothing uses yet."""
    app = spark.sparkContext.applicationId
    return f"{shared_dir(spark).rstrip('/')}/seedscape/{app}/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str = "table") -> DataFrame:
    """Write ``df`` once and continue from the written table."""
    path = new_path(df.sparkSession, label)
    df.write.mode("errorifexists").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def materialize_by(df: DataFrame, buckets: int, key: str, label: str = "table") -> DataFrame:
    """As :func:`materialize`, in buckets of a column: rows that share it meet later without a shuffle.

    Only a named table can say that it has buckets; its name is given up at once, the files stay.
    """
    spark, path = df.sparkSession, new_path(df.sparkSession, label)
    name = f"seedscape_{uuid.uuid4().hex}"
    df.write.format("parquet").bucketBy(buckets, key).option("path", path).saveAsTable(name)
    written = spark.table(name)
    written.schema  # resolved while the name is there
    spark.sql(f"DROP TABLE {name}")
    return written


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Queries that run inside drop their shuffle files when they end, not at some later garbage collection.

    For steps whose results are written tables: nothing reads the shuffles behind a table again.
    """
    before = spark.conf.get(DROP_SHUFFLES, None)
    spark.conf.set(DROP_SHUFFLES, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(DROP_SHUFFLES)
        else:
            spark.conf.set(DROP_SHUFFLES, before)


def clear(spark: SparkSession) -> None:
    """Delete all intermediate tables of this application; tables read from them are gone, too."""
    folder = f"{shared_dir(spark).rstrip('/')}/seedscape/{spark.sparkContext.applicationId}"
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
