"""Small helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of one Arrow batch handed to a Python worker, so that long texts do not add up to a large batch.
BATCH_BYTES = 2 << 20


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def map_batches(
    df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterable[pa.RecordBatch]], schema: T.StructType | str
) -> DataFrame:
    """``mapInArrow`` with batches bounded in bytes as well as in rows."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return df.mapInArrow(fn, schema)


def with_fields(df: DataFrame, *fields: tuple[str, str]) -> T.StructType:
    """The schema of ``df`` with further fields; a field of the same name is replaced."""
    new = {name for name, _ in fields}
    kept = [f for f in df.schema.fields if f.name not in new]
    return T.StructType(kept + [T.StructField(name, T._parse_datatype_string(kind)) for name, kind in fields])


def appended(batch: pa.RecordBatch, columns: dict[str, pa.Array]) -> pa.RecordBatch:
    """``batch`` with further columns at its end; columns of the same name are replaced."""
    kept = [i for i, name in enumerate(batch.schema.names) if name not in columns]
    names = [batch.schema.names[i] for i in kept] + list(columns)
    return pa.RecordBatch.from_arrays([batch.column(i) for i in kept] + list(columns.values()), names=names)


def delete_table(spark: SparkSession, path: str) -> None:
    """Delete an intermediate table that nothing reads any more."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def text_bytes(name: str = "text"):
    """The text as UTF-8 bytes; a null text is empty."""
    return F.coalesce(F.col(name).cast("binary"), F.lit(b""))
