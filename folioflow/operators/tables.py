"""Tables between stages, in the folder that all executors share."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared folder for intermediate tables, named by spark.checkpoint.dir; a folder of this machine only where all tasks run on it, as in tests."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp())
    return sc.getCheckpointDir()


#: Rows that are worth a task of their own, and rows of one task at most, where each row is much work.
LEAST_ROWS, MOST_ROWS = 250, 4_000


#: The same of lines, of which each is little work.
LEAST_LINES, MOST_LINES = 25_000, 250_000


def tasks(df: DataFrame, least: int = LEAST_LINES, most: int = MOST_LINES) -> int:
    """Tasks for df's rows, which are counted: as many as cores, fewer for less than least rows each, more for more than most."""
    rows = df.count()
    cores = min(df.sparkSession.sparkContext.defaultParallelism, -(-rows // least))
    return max(1, cores, -(-rows // most))


def spread(df: DataFrame, *by: str, least: int = LEAST_ROWS, most: int = MOST_ROWS) -> DataFrame:
    """df with the rows of a key in one task, in as many tasks as its counted rows ask for: the cores' number, more for more than most rows a task.

    A small table is one or two splits, however many rows it has, and what is made of each row would all be made there.
    """
    return df.repartition(tasks(df, least, most), *by)


def durable(df: DataFrame) -> DataFrame:
    """The rows in the shared folder: computed once, without lineage, safe when executors go."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)
