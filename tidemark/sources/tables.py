"""Tables that a job writes once in the folder that driver and executors share, and reads again."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

FOLDER = "spark.checkpoint.dir"
#: Folders within the shared one that tables go to at the moment, the innermost last.
_RUNS: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only where all run in one process (local, local[..])."""
    named = spark.conf.get(FOLDER, None)
    if not named:
        master = spark.conf.get("spark.master", "")
        if master != "local" and not master.startswith("local["):
            raise ValueError(f"{FOLDER} must name a folder that driver and executors share")
        named = tempfile.mkdtemp(prefix="tidemark-")
        spark.conf.set(FOLDER, named)
    return named.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """The same rows from a table in the shared folder: computed once, cuts the lineage, and there when an executor is lost."""
    spark = df.sparkSession
    path = "/".join([shared_folder(spark), *_RUNS[-1:], f"{name}-{uuid.uuid4().hex}"])
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def removed(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def dropped(spark: SparkSession, df: DataFrame) -> None:
    """Delete a table made by stored() that nothing will read again."""
    for file in df.inputFiles()[:1]:
        removed(spark, file.rsplit("/", 1)[0])


@contextlib.contextmanager
def run_tables(spark: SparkSession) -> Iterator[None]:
    """Tables stored within the block go to a folder of their own, which is deleted at its end.

    DataFrames read such tables when they run, so results must be written or collected within the block.
    """
    _RUNS.append(f"run-{uuid.uuid4().hex}")
    path = f"{shared_folder(spark)}/{_RUNS[-1]}"
    try:
        yield
    finally:
        _RUNS.pop()
        removed(spark, path)


def spread(df: DataFrame) -> DataFrame:
    """df over at least as many partitions as there are cores: a small table of one file would keep the others idle.

    A table that has them already, as any large one, is left as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


#: Rows of an Arrow batch of whole texts.
BATCH_ROWS = 1000


def small_batches(spark: SparkSession) -> None:
    """Send texts to Python workers BATCH_ROWS at a time, unless the session sets a number of its own.

    The default of 10,000 rows (up to 64 MB) is held several times over, beside the heap of the executor and in the worker.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name) == "10000":
        spark.conf.set(name, str(BATCH_ROWS))
