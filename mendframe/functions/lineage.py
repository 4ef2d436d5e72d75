"""Materialising an intermediate table in the shared checkpoint folder, and the number of tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from mendframe.session import ensure_checkpoint_dir


def materialize(df: DataFrame) -> DataFrame:
    """Writes `df` once to the checkpoint folder and reads it from there.

    Used where a small result of a large scan is needed several times, and to
    cut the plan of a loop. It survives the loss of executors.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def shuffle_partitions(spark: SparkSession) -> int:
    """The session's number of shuffle partitions, for rows whose work says more than their bytes.

    Partitions of a shuffle without a number are merged by their bytes, down to a single task.
    """
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
