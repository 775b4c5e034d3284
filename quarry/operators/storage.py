"""Tables that a job writes for itself, and joins that hot keys don't slow."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder under the shared one that spark.checkpoint.dir names; on one machine, where it is unset, a temporary one is set."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="spark-quarry-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


#: Whether shuffle files go as soon as the query that made them ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame, name: str) -> DataFrame:
    """The table, written and read back: later steps start from its files, whatever executors are lost, and its shuffles are removed."""
    spark = df.sparkSession
    path, before = scratch(spark, name), spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        # Made here: a plan keeps the setting that it was made with.
        df.select("*").write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before) if before is not None else spark.conf.unset(CLEANUP)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def batches_of(spark: SparkSession, rows: int) -> Iterator[None]:
    """What runs within sends tasks' Python workers at most that many rows at once: for rows that are large each."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def forget(*tables: DataFrame) -> None:
    """Remove the files of stored tables that no later step reads."""
    for table in tables:
        files = table.inputFiles()
        if files:
            spark = table.sparkSession
            folder = spark._jvm.org.apache.hadoop.fs.Path(files[0]).getParent()
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def meet(rows: DataFrame, table: DataFrame, key: str, total: int, how: str = "inner") -> DataFrame:
    """rows joined with table(key, ..., n), which has one row a key and how many of `total` rows have it.

    Keys of more than a hundred-thousandth of the rows (so fewer than 100,000 of them) are sent to every task and their
    rows stay where they are; the others are shuffled.
    """
    many = max(1000, total // 100_000)
    hot, cold = table.where(F.col("n") > many).drop("n"), table.where(F.col("n") <= many).drop("n")
    near = rows.join(F.broadcast(hot), key, how)
    return near.unionByName(rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(cold, key, how)) if how == "inner" else near
