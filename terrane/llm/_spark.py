"""Small Spark helpers of the text operators."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import wraps

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bitmaps that ``may_hold`` sends, 32,768 bits (4 KB) each: 4 MB however large the tables are.
_BITMAPS = 1024

_own: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only where none is set (tests)."""
    context = spark.sparkContext
    where = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir", None)
    return (where or _own.setdefault(context.applicationId, f"file://{tempfile.mkdtemp(prefix='terrane-')}")).rstrip("/")


def keep(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def forget(*kept: DataFrame) -> None:
    """Delete tables that ``keep`` wrote, once nothing reads them any more."""
    for df in kept:
        if files := df.inputFiles():
            delete(df.sparkSession, files[0].rsplit("/", 1)[0])


def delete(spark: SparkSession, path: str) -> None:
    """Delete a folder that this library wrote."""
    context = spark.sparkContext
    folder = context._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(context._jsc.hadoopConfiguration()).delete(folder, True)


def may_hold(df: DataFrame, value: Column, of: DataFrame) -> DataFrame:
    """``df`` with a column ``__may``: false only where ``value``, a long, surely isn't in the one column of ``of``.

    Rows without the mark need no exchange to be told apart; the others are left to an exact
    join.  The bits have a fixed number, so a very large ``of`` marks more rows in vain.
    """

    def slot(v: Column) -> Column:
        return F.pmod(F.xxhash64(v), F.lit(_BITMAPS * 32768)) + 1

    at = of.select(slot(F.col(of.columns[0])).alias("__slot")).distinct()
    bits = at.groupBy(F.bitmap_bucket_number("__slot").alias("__bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("__slot")).alias("__bits"))
    marked = df.withColumn("__slot", slot(value)).withColumn("__bucket", F.bitmap_bucket_number("__slot")).join(F.broadcast(bits), "__bucket", "left")
    place = F.bitmap_bit_position("__slot")
    byte = F.conv(F.hex(F.substring(F.col("__bits"), (F.floor(place / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return marked.withColumn("__may", F.coalesce(F.getbit(byte, (place % 8).cast("int")) == 1, F.lit(False))).drop("__slot", "__bucket", "__bits")


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` for a worker that gives its free memory back when a task ends.

    Workers are kept for later tasks, and idle ones for a minute, with all that their largest task touched.
    """

    @wraps(run)
    def out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return out


def give_back() -> None:
    """Hands memory that is free, but held by the allocators of this process, to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:  # of the C library of Linux
        trim(0)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole_keys(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.Table]:
    """Runs of whole keys, about ``rows`` rows each; the batches come sorted by key, their first column."""
    kept: list[pa.RecordBatch] = []
    n = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        kept.append(batch)
        n += batch.num_rows
        if n >= rows:
            t = pa.Table.from_batches(kept)
            key = t.column(0).to_numpy()
            cut = int(np.searchsorted(key, key[-1], "left"))
            if cut:
                yield t.slice(0, cut)
                kept, n = t.slice(cut).to_batches(), len(t) - cut
    if kept:
        yield pa.Table.from_batches(kept)
