"""PCD files as a sink with a commit protocol, and as a live source.

Both work on folders that the driver and all executors can open.

* ``points.write.format("pcd_files")`` takes rows (name, content), as ``clouds.pcd_files`` makes
  them.  A task writes into a folder of its own attempt; only the commit of the whole job
  moves the files of the attempts that succeeded to their names.  A job that fails leaves
  nothing, and what stood there before stays.
* ``spark.readStream.format("pcd_scans")`` takes files ``<session>_<ticks>.pcd`` as they arrive,
  in the order of their names, at most ``filesPerBatch`` in a batch.
"""

from __future__ import annotations

import json
import os
import re
import shutil
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from pathlib import Path

from pyspark import TaskContext
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from terrane.sources.clouds import decode_pcd, pcd_files

_SCAN = re.compile(r"(\d+)_(\d+)\.pcd")


def local_path(path: str) -> Path:
    return Path(re.sub(r"^file:(//)?", "", path))


class PcdFiles(DataSource):
    """The sink: rows (name string, content binary); ``overwrite`` removes the folder's other PCD files at the commit."""

    @classmethod
    def name(cls) -> str:
        return "pcd_files"

    def schema(self) -> str:
        return "name string, content binary"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return _PcdWriter(local_path(self.options["path"]), overwrite)


@dataclass
class _Written(WriterCommitMessage):
    attempt: str
    names: list[str]


class _PcdWriter(DataSourceWriter):
    def __init__(self, path: Path, overwrite: bool) -> None:
        self.path, self.overwrite = path, overwrite
        self.staging = path / f".staging-{uuid.uuid4().hex}"

    def write(self, rows: Iterator[Row]) -> WriterCommitMessage:
        attempt = str(TaskContext.get().taskAttemptId())
        folder = self.staging / attempt
        folder.mkdir(parents=True)
        names = []
        for row in rows:
            if not row.name or Path(row.name).name != row.name or row.name in names:
                raise ValueError(f"not a name for a file of its own: {row.name!r}")
            (folder / row.name).write_bytes(bytes(row.content))
            names.append(row.name)
        return _Written(attempt, names)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        new = [(m.attempt, n) for m in messages if m is not None for n in m.names]
        if len({n for _, n in new}) < len(new):
            self.abort(messages)
            raise ValueError("two tasks wrote a file of the same name")
        self.path.mkdir(parents=True, exist_ok=True)
        for attempt, name in new:
            os.replace(self.staging / attempt / name, self.path / name)
        if self.overwrite:
            for old in set(self.path.glob("*.pcd")) - {self.path / n for _, n in new}:
                old.unlink()
        shutil.rmtree(self.staging, ignore_errors=True)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        shutil.rmtree(self.staging, ignore_errors=True)


class PcdScans(DataSource):
    """The live source; ``position`` is a file that keeps the last file taken, beside the stream's checkpoint."""

    @classmethod
    def name(cls) -> str:
        return "pcd_scans"

    def schema(self) -> str:
        return "session_id long, t_ticks long, point_id long, x double, y double, z double"

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return _ScanReader(local_path(self.options["path"]), local_path(self.options["position"]), int(self.options.get("filesPerBatch", "100")))


class _ScanReader(DataSourceStreamReader):
    """Offsets are names of files; what has arrived since is given out in bounded steps.

    Spark asks for the latest offset without telling where it stands.  The position is kept
    at each commit; it can lag by the batch that was running when a stream ended, and a
    question that leads to no batch is then answered one step further.
    """

    def __init__(self, path: Path, position: Path, most: int) -> None:
        self.path, self.position, self.most, self.idle = path, position, most, 0
        self.last = json.loads(position.read_text())["file"] if position.exists() else ""

    def initialOffset(self) -> dict:
        return {"file": ""}

    def _names(self, after: str, until: str | None = None) -> list[str]:
        return sorted(n for n in os.listdir(self.path) if _SCAN.fullmatch(n) and n > after and (until is None or n <= until))

    def latestOffset(self) -> dict:
        self.idle += 1
        names = self._names(self.last)[: self.most * self.idle]
        return {"file": names[-1] if names else self.last}

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        self.last, self.idle = max(self.last, end["file"]), 0
        return [InputPartition(n) for n in self._names(start["file"], end["file"])]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        session, ticks = map(int, _SCAN.fullmatch(partition.value).groups())
        got = decode_pcd((self.path / partition.value).read_bytes())
        for k, row in enumerate(zip(*(got[c].astype(float).tolist() for c in "xyz"), strict=True)):
            yield (session, ticks, k, *row)

    def commit(self, end: dict) -> None:
        self.position.parent.mkdir(parents=True, exist_ok=True)
        new = self.position.with_name(f"{self.position.name}.new")
        new.write_text(json.dumps(end))
        os.replace(new, self.position)


def register_formats(spark: SparkSession) -> None:
    for source in (PcdFiles, PcdScans):
        spark.dataSource.register(source)


def save_pcd(points: DataFrame, path: str, by: str, columns: Sequence[str] = ("x", "y", "z"), overwrite: bool = False) -> None:
    """One file for each value of ``by``, ``.pcd`` added where it is missing; points in the order of point_id."""
    register_formats(points.sparkSession)
    pcd_files(points, by, columns).coalesce(64).write.format("pcd_files").mode("overwrite" if overwrite else "append").option("path", path).save()


def save_submaps(points: DataFrame, path: str, name: str = "submap", columns: Sequence[str] = ("x", "y", "z"), phase: str | None = None) -> None:
    """``<name>_<submap>.pcd`` for each submap; a phase (before, after a correction) has a folder of its own."""
    named = points.withColumn("file", F.concat(F.lit(f"{name}_"), F.col("submap_id").cast("string")))
    save_pcd(named, f"{path}/{phase}" if phase else path, "file", columns, overwrite=True)


def save_alignment(source: DataFrame, target: DataFrame, aligned: DataFrame, path: str) -> None:
    """For inspection, the clouds of each pair (pair_id, point_id, x, y, z) by role: source, target, and source as aligned."""
    both = None
    for role, cloud in (("source", source), ("target", target), ("aligned", aligned)):
        part = cloud.select(F.concat(F.regexp_replace(F.col("pair_id").cast("string"), "/", "-"), F.lit(f"_{role}")).alias("file"), "point_id", "x", "y", "z")
        both = part if both is None else both.unionByName(part)
    save_pcd(both, path, "file")


@dataclass(frozen=True)
class AtEnd:
    """What is saved when a session ends."""

    map: bool = True
    submaps: bool = False
    dense_submaps: bool = False


def save_at_end(flags: AtEnd, path: str, cloud: DataFrame, submaps: DataFrame, dense: DataFrame) -> None:
    """The map (map_id, ...), the submaps and the dense submaps (submap_id, point_id, x, y, z), as the flags tell."""
    if flags.map:
        save_pcd(cloud, path, "map_id")
    if flags.submaps:
        save_submaps(submaps, f"{path}/submaps", "submap")
    if flags.dense_submaps:
        save_submaps(dense, f"{path}/dense_submaps", "submap_dense")
