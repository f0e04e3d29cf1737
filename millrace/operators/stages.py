"""Cutting lineage between the rounds of an iterative job, and folders that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared(spark: SparkSession) -> str:
    """The checkpoint folder: that of spark.checkpoint.dir; only a local session without it gets one of its own."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = context.getConf().get("spark.checkpoint.dir")
        if named is None and not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="millrace-"))
    return context.getCheckpointDir()


def fresh_folder(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing has yet."""
    return f"{shared(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """df, written to the checkpoint folder and read from there: later rounds start from files, whichever executor is lost."""
    shared(df.sparkSession)
    return df.checkpoint()


def tasks_for(rows: DataFrame, rows_a_task: int) -> int:
    """How many tasks to deal rows to: the session's shuffle partitions, or more if each would get more than rows_a_task. Counts the rows."""
    least = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(least, -(-rows.count() // rows_a_task))
