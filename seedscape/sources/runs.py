"""Collections that can be restarted.

Output is partitioned by run. A run counts as done only through the table of
completed runs, which is written after its output; a run that stopped halfway is
simply collected again and its partition replaced.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from seedscape.scratch import materialize

RUN_KEYS = ("review_id", "split_seed")
#: Files a run is written to, at most.
FILES_PER_RUN = 4


def pending_runs(runs: DataFrame, completed: DataFrame, keys: Sequence[str] = RUN_KEYS) -> DataFrame:
    """Runs that have no completion record."""
    return runs.join(completed.select(*keys).distinct(), list(keys), "left_anti")


def completed_runs(runs: DataFrame, folder: str, keys: Sequence[str] = RUN_KEYS) -> DataFrame:
    """Completion records written so far."""
    try:
        return runs.sparkSession.read.parquet(f"{folder}/completed.parquet")
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return runs.select(*keys).limit(0)


def collect_pending(
    runs: DataFrame,
    folder: str,
    collect: Callable[[DataFrame], DataFrame],
    keys: Sequence[str] = RUN_KEYS,
    group_size: int = 100,
) -> None:
    """Collect the pending runs in groups of about ``group_size``, one job each, and record each group when
    it is done, so that a failure costs one group at most.

    Only the partitions of a group's runs are replaced. Rows are placed by run, and those of
    one run in ``FILES_PER_RUN`` tasks, so that a run has few files and a large one is split.
    """
    open_runs = materialize(pending_runs(runs, completed_runs(runs, folder, keys), keys).select(*keys).distinct(), "open")
    groups = -(-open_runs.count() // group_size)
    for number in range(groups):
        own = open_runs.where(F.pmod(F.xxhash64(*keys), F.lit(groups)) == number)
        collected = collect(own)
        others = [c for c in collected.columns if c not in keys]
        placed = collected.repartition(*keys, F.pmod(F.xxhash64(*others), F.lit(FILES_PER_RUN)))
        writer = placed.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        writer.partitionBy(*keys).parquet(f"{folder}/papers.parquet")
        own.write.mode("append").parquet(f"{folder}/completed.parquet")


def read_collection(spark: SparkSession, folder: str, key_types: Mapping[str, str]) -> DataFrame:
    """What has been collected. The run keys are folder names, so their types are stated, not guessed:
    a review ``007`` stays one."""
    path = f"{folder}/papers.parquet"
    stored = [f for f in spark.read.parquet(path).schema.fields if f.name not in key_types]
    schema = StructType(stored + StructType.fromDDL(", ".join(f"`{name}` {kind}" for name, kind in key_types.items())).fields)
    return spark.read.schema(schema).parquet(path)
