"""Positions and running sums over groups of any size, without one task that holds a group."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terrane.plans.lineage import cut

#: Rows of a group that one task adds up; the sums of such segments are added up again.
SEGMENT = 4096


def placed(rows: DataFrame, by: Sequence[str], order: Sequence[str], name: str = "place") -> DataFrame:
    """Each row with its position in its group, from 0, in the order of columns (nulls first).

    Rows are dealt out by ranges of group and order, so equal rows alone stay together; a
    position is the row's place in its range and the counts of the group's ranges before it.
    """
    parts = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    keys = [*by, *order]
    sorted_ = rows.repartitionByRange(parts, *keys).sortWithinPartitions(*keys)
    at = cut(sorted_.withColumns({"__at": F.monotonically_increasing_id(), "__part": F.spark_partition_id()}))
    runs = at.groupBy(*by, "__part").agg(F.count(F.lit(1)).alias("__rows"), F.min("__at").alias("__first"))
    w = Window.partitionBy(*by).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    runs = runs.select(*(F.col(c).alias(f"__{c}") for c in by), F.col("__part").alias("__run"), "__first", F.coalesce(F.sum("__rows").over(w), F.lit(0)).alias("__before"))
    same = F.col("__part") == F.col("__run")
    for c in by:
        same &= F.col(c).eqNullSafe(F.col(f"__{c}"))
    return at.join(runs, same).select(*rows.columns, (F.col("__before") + F.col("__at") - F.col("__first")).alias(name))


def running(rows: DataFrame, by: Sequence[str], place: str, column: str, segment: int = SEGMENT) -> DataFrame:
    """The rows, ``column`` (an array of numbers) replaced by its running sum over the group in the order of ``place``.

    Places are whole numbers from 0.  Sums run inside segments of places, then over the
    segments' last sums; a task streams through segments and holds one batch.
    """
    dealt = rows.withColumn("__segment", F.floor(F.col(place) / segment).cast("long"))

    def fold(keys: Sequence[str]) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            key, total = None, None
            for t in frames:
                if t.empty:
                    continue
                new = np.ones(len(t), bool)
                new[1:] = np.any([t[k].to_numpy()[1:] != t[k].to_numpy()[:-1] for k in keys], axis=0)
                v = np.stack(t[column].to_numpy())
                if key == tuple(t[k].iloc[0] for k in keys):
                    v[0] += total
                begin = np.flatnonzero(new)
                for a, b in zip(begin, np.append(begin[1:], len(t)), strict=True):
                    np.cumsum(v[a:b], axis=0, out=v[a:b])
                key, total = tuple(t[k].iloc[-1] for k in keys), v[-1]
                yield t.assign(**{column: list(v)})

        return run

    inner = dealt.repartition(*by, "__segment").sortWithinPartitions(*by, "__segment", place).mapInPandas(fold([*by, "__segment"]), dealt.schema)
    totals = inner.groupBy(*by, "__segment").agg(F.max_by(column, place).alias(column))
    outer = totals.repartition(*by).sortWithinPartitions(*by, "__segment").mapInPandas(fold(by), totals.schema)
    done = inner.join(outer.select(*by, (F.col("__segment") + 1).alias("__segment"), F.col(column).alias("__before")), [*by, "__segment"], "left")
    whole = F.when(F.col("__before").isNull(), F.col(column)).otherwise(F.zip_with(column, "__before", lambda x, y: x + y))
    return done.select(*(whole.alias(c) if c == column else c for c in rows.columns))
