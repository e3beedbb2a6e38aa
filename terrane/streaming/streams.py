"""Streaming forms of the time-ordered operators; each gives the batch result for any split of the input."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from terrane.operators.mapping import SEGMENTS, Segmenter, take_scans
from terrane.operators.voxel import dense_state, merge_states


def read_stream(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 1) -> DataFrame:
    """A folder of Parquet files as a stream; how much one batch takes is bounded here."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def drop_late(rows: DataFrame, arrival: str = "arrival_seq", tie: str = "event_id") -> DataFrame:
    """Rows of each session that are not older than the newest seen before them."""

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        newest = state.get[0] if state.exists else -1
        t = pd.concat(list(frames)).sort_values([arrival, tie], kind="stable")
        before = t["t_ticks"].cummax().clip(lower=newest)
        state.update((int(before.iloc[-1]),))
        yield t[t["t_ticks"] >= before]

    return rows.groupBy("session_id").applyInPandasWithState(run, rows.schema, "newest long", "append", GroupStateTimeout.NoTimeout)


def count_batches(scans: DataFrame, n: int, skip: int = 5) -> DataFrame:
    """Full batches of n scans of each session in arrival order, after the first ``skip``.

    (session_id, batch, stamp, items); scans are (session_id, t_ticks, event_id).
    """

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen, done, ids, stamps = state.get if state.exists else (0, 0, [], [])
        ids, stamps, out = list(ids), list(stamps), []
        t = pd.concat(list(frames)).sort_values(["t_ticks", "event_id"], kind="stable")
        for i, s in zip(t["event_id"].tolist(), t["t_ticks"].tolist(), strict=True):
            seen += 1
            if seen <= skip:
                continue
            ids.append(i)
            stamps.append(s)
            if len(ids) == n:
                out.append((key[0], done, max(stamps), ids))
                done, ids, stamps = done + 1, [], []
        state.update((seen, done, ids, stamps))
        yield pd.DataFrame(out, columns=["session_id", "batch", "stamp", "items"])

    narrow = scans.select("session_id", "t_ticks", "event_id")
    return narrow.groupBy("session_id").applyInPandasWithState(run, "session_id long, batch long, stamp long, items array<long>", "seen long, done long, ids array<long>, stamps array<long>", "append", GroupStateTimeout.NoTimeout)


def segment_submaps(scans: DataFrame, **settings: float) -> DataFrame:
    """The submap of each scan as it comes, the rows of ``mapping.segment_submaps`` for any split of the input.

    The state of a session is its segmenter: submaps' origins and centres, occupied cells, edges
    and the ring of last scans.
    """

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        s = pickle.loads(state.get[0]) if state.exists else Segmenter(**settings)
        out = take_scans(s, key[0], pd.concat(list(frames)))
        state.update((pickle.dumps(s),))
        yield out

    return scans.groupBy("session_id").applyInPandasWithState(run, SEGMENTS, "segmenter binary", "append", GroupStateTimeout.NoTimeout)


def emit_once(poses: DataFrame) -> DataFrame:
    """A pose only if its time differs from the last one given out for its session, however old it is.

    Poses of a batch are taken in the order of time.
    """

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        t = pd.concat(list(frames)).sort_values("t_ticks", kind="stable")
        before = t["t_ticks"].shift(fill_value=state.get[0] if state.exists else -1)
        state.update((int(t["t_ticks"].iloc[-1]),))
        yield t[t["t_ticks"] != before]

    return poses.groupBy("session_id").applyInPandasWithState(run, poses.schema, "last long", "append", GroupStateTimeout.NoTimeout)


def valid_scans(scans: DataFrame) -> DataFrame:
    return scans.where("t_ticks > 0 and n_points > 0")


def finished_sessions(rows: DataFrame, idle: str = "10 minutes") -> DataFrame:
    """Sessions without a row for ``idle`` of event time: (session_id, last); ``rows`` has a column ts."""
    idle_ms = int(pd.Timedelta(idle).total_seconds() * 1000)

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            last = state.get[0]
            state.remove()
            yield pd.DataFrame({"session_id": [key[0]], "last": [last]})
            return
        last = max([state.get[0] if state.exists else 0, *(int(f["t_ticks"].max()) for f in frames)])
        state.update((last,))
        stamp = (last - 621_355_968_000_000_000) // 10_000
        state.setTimeoutTimestamp(max(stamp + idle_ms, state.getCurrentWatermarkMs() + 1))

    return rows.withWatermark("ts", "0 seconds").groupBy("session_id").applyInPandasWithState(run, "session_id long, last long", "last long", "append", GroupStateTimeout.EventTimeTimeout)


def dense_map_sink(spark: SparkSession, path: str, size: float) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function that adds registered points to a table of mergeable voxel sums.

    Each batch is written under its number, so a batch that runs again replaces itself;
    ``read_dense_map`` merges them.
    """

    def run(batch: DataFrame, number: int) -> None:
        dense_state(batch, size, by=("submap_id",), extra=("r", "g", "b")).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return run


def read_dense_map(spark: SparkSession, path: str) -> DataFrame:
    return merge_states(spark.read.parquet(path).drop("batch"), by=("submap_id",))


def replay(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Run a stream over all that is there, with back-pressure by batch size, and stop."""
    stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def split_at_resets(scans: DataFrame, resets: DataFrame) -> DataFrame:
    """Scans with the number of pose resets of their session at or before them: trajectories start anew in each segment.

    Batch form; ``split_at_resets_live`` gives the same from streams.
    """
    both = scans.withColumn("reset", F.lit(0)).unionByName(resets.select("session_id", "t_ticks", F.lit(1).alias("reset")), allowMissingColumns=True)
    w = Window.partitionBy("session_id").orderBy("t_ticks", F.col("reset").desc())
    return both.withColumn("segment", F.sum("reset").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("long")).where("reset = 0").drop("reset")


def split_at_resets_live(scans: DataFrame, resets: DataFrame) -> DataFrame:
    """The same of two streams that meet in one keyed state, for input in the order of time from batch to batch.

    A reset holds from its time on; one that comes after later scans were given out counts
    for the scans that follow it.
    """
    both = scans.withColumn("reset", F.lit(0)).unionByName(resets.select("session_id", "t_ticks", F.lit(1).alias("reset")), allowMissingColumns=True)
    names = scans.columns

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        t = pd.concat(list(frames)).sort_values(["t_ticks", "reset"], ascending=[True, False], kind="stable")
        segment = t["reset"].cumsum() + (state.get[0] if state.exists else 0)
        state.update((int(segment.iloc[-1]),))
        yield t.assign(segment=segment.astype("int64"))[t["reset"] == 0][[*names, "segment"]]

    shape = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in scans.schema) + ", segment long"
    return both.groupBy("session_id").applyInPandasWithState(run, shape, "segment long", "append", GroupStateTimeout.NoTimeout)


class WorkTable:
    """Events that wait for the next stage of a chain, each taken exactly once by a consumer.

    A producer's batch puts its events under its number and a consumer's batch takes all
    that was put since its last one; what it took is noted before it works.  A batch of
    either that runs again puts or takes the same, so a chain that is killed between two
    stages goes on where it stood.
    """

    def __init__(self, spark: SparkSession, root: str, schema: str) -> None:
        self.spark, self.root, self.schema = spark, root.rstrip("/"), schema

    def put(self, events: DataFrame, number: int) -> None:
        events.write.mode("overwrite").parquet(f"{self.root}/events/batch={number}")

    def _numbers(self, folder: str) -> list[int]:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{folder}")
        files = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        there = [x.getPath().getName() for x in files.listStatus(path)] if files.exists(path) else []
        done = [n for n in there if files.exists(self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{folder}/{n}/_SUCCESS"))]
        return sorted(int(n.split("=")[1]) for n in done)

    def take(self, consumer: str, number: int) -> DataFrame:
        """The events of the consumer's batch ``number``."""
        notes = f"{self.root}/taken/{consumer}"
        known = self._numbers(f"taken/{consumer}")
        if number not in known:
            end = max(self._numbers("events"), default=-1)
            self.spark.range(1).select(F.lit(end).alias("end")).write.mode("overwrite").parquet(f"{notes}/batch={number}")
        last = max((n for n in known if n < number), default=None)
        ends = [self.spark.read.parquet(f"{notes}/batch={n}").first().end if n is not None else -1 for n in (last, number)]
        paths = [f"{self.root}/events/batch={n}" for n in self._numbers("events") if ends[0] < n <= ends[1]]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)


FINISHED = "session_id long, submap_id long, t_ticks long, forced boolean"


def finished_submaps(segments: DataFrame) -> DataFrame:
    """Events (FINISHED) of the submaps that scans left; ``segments`` are rows of ``mapping.segment_submaps``."""
    return segments.where("submap_id <> active_after").select("session_id", "submap_id", "t_ticks", F.lit(False).alias("forced"))


def flushed_submaps(segments: DataFrame, ended: DataFrame) -> DataFrame:
    """At the end of sessions (session_id), their last active submaps as finished, which forces the last closures and the correction."""
    last = segments.groupBy("session_id").agg(F.max_by("active_after", "t_ticks").alias("submap_id"), F.max("t_ticks").alias("t_ticks"))
    return last.join(ended.select("session_id").distinct(), "session_id", "left_semi").select("session_id", "submap_id", "t_ticks", F.lit(True).alias("forced"))


def chain(work: WorkTable, consumer: str, stage: Callable[[DataFrame, int], None]) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function: each batch, whatever wakes it, hands ``stage`` all events that wait, and their number."""

    def run(_: DataFrame, number: int) -> None:
        events = work.take(consumer, number)
        if not events.isEmpty():
            stage(events, number)

    return run


def on_events(events: DataFrame, stage: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Run a stage (features, candidates, constraints, optimisation) on each batch of all events that are there."""
    events.writeStream.foreachBatch(stage).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
