"""Cuts of lineage: rows that several branches or rounds read are written once to the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder of the session; where it names none and all runs in one process (tests) a temporary one is set."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        where = spark.conf.get("spark.checkpoint.dir", None)
        if not where:
            if not context.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            where = "file://" + tempfile.mkdtemp(prefix="lexigrid-")
        context.setCheckpointDir(where)
    return context.getCheckpointDir()


def new_folder(spark: SparkSession, name: str) -> str:
    """The path of a folder of its own for files, which does not exist yet."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """``df`` from a reliable checkpoint in ``spark.checkpoint.dir``: its plan is a scan, and a lost executor costs a re-read.

    Runs a job at once. ``spark.cleaner.referenceTracking.cleanCheckpoints`` makes Spark delete what no DataFrame refers to any more.
    """
    shared_folder(df.sparkSession)
    return df.checkpoint()


#: Rows of a task whose time goes by rows.
TASK_ROWS = 20_000


def dealt(df: DataFrame, n: int, *columns: str) -> DataFrame:
    """``df`` in as many partitions as at most ``n`` rows ask for. Spark merges no partitions of a given number; else it would by their
    bytes, and small rows that Python works on would be one task's."""
    return df.repartition(max(1, -(-n // TASK_ROWS)), *columns)


#: Rows and bytes of a batch on its way to a Python worker: the worker's memory depends on them and not on the size of a partition.
BATCH_ROWS, BATCH_BYTES = 1000, 4 << 20


def bound_batches(spark: SparkSession) -> None:
    """Lower the session's bounds of Arrow batches to the above, unless they are lower; Spark has them for a session alone."""
    for key, most, default in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS, "10000"), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES, None)):
        now = spark.conf.get(key, default)
        if now is not None and not (now.rstrip("bB").isdigit() and 0 < int(now.rstrip("bB")) <= most):
            spark.conf.set(key, str(most))
