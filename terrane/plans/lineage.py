"""Cutting the lineage of iterative jobs in a way that survives lost executors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only on a local master that names none."""
    context = spark.sparkContext
    where = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir", None)
    if where is None and not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return (where or _own.setdefault(context.applicationId, f"file://{tempfile.mkdtemp(prefix='terrane-')}")).rstrip("/")


def cut(df: DataFrame, *spent: DataFrame) -> DataFrame:
    """The rows as a table written to the shared folder; ``spent`` are earlier results of this function to delete then.

    A table, unlike a checkpoint, is planned with its true size.  What a checkpoint is thought
    to hold multiplies with every join, so that after some rounds planning takes longer than
    running.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    for old in spent:
        forget(old)
    return spark.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, folder: str) -> None:
    """Delete a folder that this library wrote."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def forget(df: DataFrame) -> None:
    """Delete a table that ``cut`` wrote, once nothing reads it any more."""
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if folder.rsplit("/", 1)[1].startswith("cut-"):
            delete(df.sparkSession, folder)
