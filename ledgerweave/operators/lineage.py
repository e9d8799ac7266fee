"""Cuts of lineage for loops: what a round found is kept in a folder that all executors share."""

from __future__ import annotations

import tempfile
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession


def shared(spark: SparkSession) -> str:
    """The folder that all executors share, as the session names it; only on one machine is one made where none is set."""
    context = spark.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if context.master != "local" and not context.master.startswith("local["):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="checkpoints-")
        context.setCheckpointDir(folder)
    return context._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """df computed once, as a table in the shared folder, so that a lost executor costs nothing and plans stay short; it goes when the driver ends.

    A written table rather than a checkpoint, which computes df twice and reads all columns.
    """
    spark = df.sparkSession
    folder = f"{shared(spark)}/cut-{uuid4().hex}"
    remove_at_exit(spark, folder)
    df.write.parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)


def remove_at_exit(spark: SparkSession, folder: str) -> None:
    """Deletes a folder of the shared store when the driver ends."""
    place = spark._jvm.org.apache.hadoop.fs.Path(folder)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(place)
