"""Point clouds in files and messages: PCD maps, packed cloud messages, meshes, recorded logs."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

#: Wire codes of the number types of message fields.
NUMBERS = {1: "i1", 2: "u1", 3: "i2", 4: "u2", 5: "i4", 6: "u4", 7: "f4", 8: "f8"}
FIELDS = "array<struct<name:string,offset:int,datatype:int,count:int>>"
MESSAGES = f"topic string, stamp_ticks long, frame_id string, height int, width int, point_step int, is_bigendian boolean, is_dense boolean, fields {FIELDS}, data binary"
PCD_KINDS = {("F", 4): "f4", ("F", 8): "f8", ("U", 1): "u1", ("U", 2): "u2", ("U", 4): "u4", ("I", 1): "i1", ("I", 2): "i2", ("I", 4): "i4"}


def decode_cloud(fields: list, n: int, step: int, data: bytes, bigendian: bool = False) -> dict[str, np.ndarray]:
    """Columns of a packed cloud by field name; ``rgb`` gives bytes r, g and b."""
    order = ">" if bigendian else "<"
    out: dict[str, np.ndarray] = {}
    for f in fields:
        name, code = f["name"], NUMBERS[f["datatype"]]
        if name in ("rgb", "rgba"):
            raw = np.ndarray((n, 4), "u1", data, f["offset"], (step, 1)) if n else np.zeros((0, 4), "u1")
            red, green, blue = (1, 2, 3) if bigendian else (2, 1, 0)
            out |= {"r": raw[:, red], "g": raw[:, green], "b": raw[:, blue]}
        else:
            out[name] = np.ndarray((n,), order + code, data, f["offset"], (step,)) if n else np.zeros(0, code)
    return out


def points_of_messages(messages: DataFrame, skip_colors: bool = False, attributes: Sequence[str] = ()) -> DataFrame:
    """One row per point: (topic, stamp_ticks, point_id, x, y, z, r, g, b, intensity, *attributes).

    Colours are bytes over 255.  Absent fields are null; non-finite points stay, see
    ``crop.is_finite``.
    """
    names = ["x", "y", "z", "r", "g", "b", "intensity", *attributes]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for m in batch.to_pylist():
                n = m["width"] * m["height"]
                got = decode_cloud(m["fields"], n, m["point_step"], m["data"], m["is_bigendian"])
                columns = []
                for c in names:
                    if c not in got or (skip_colors and c in "rgb"):
                        columns.append(pa.nulls(n, pa.float64()))
                    else:
                        v = got[c].astype(float)
                        columns.append(pa.array(v / 255.0 if c in "rgb" else v))
                yield pa.RecordBatch.from_arrays([pa.array([m["topic"]] * n, pa.string()), pa.array([m["stamp_ticks"]] * n, pa.int64()), pa.array(np.arange(n)), *columns], ["topic", "stamp_ticks", "point_id", *names])

    return messages.select(*(c.split()[0] for c in MESSAGES.split(", "))).mapInArrow(run, "topic string, stamp_ticks long, point_id long, " + ", ".join(f"{c} double" for c in names))


def messages_of_points(points: DataFrame, frame: str, fields: Sequence[tuple[str, str]] = (), colors: bool = True) -> DataFrame:
    """One packed message per (topic, stamp_ticks) of points ordered by point_id.

    ``fields`` lists further columns with ``float`` or ``int``; another type is an error
    before any job.  A scan's points form one message, as on the wire.
    """
    for name, kind in fields:
        if kind not in ("float", "int"):
            raise ValueError(f"field {name!r}: unknown type {kind!r}, not float or int")
    colored = colors and "r" in points.columns
    layout, at = [], 0
    for name, code in [("x", 7), ("y", 7), ("z", 7), *([("rgb", 7)] if colored else []), *((n, 7 if k == "float" else 5) for n, k in fields)]:
        layout.append({"name": name, "offset": at, "datatype": code, "count": 1})
        at += 4
    step = at

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by("point_id")
        n = t.num_rows
        raw = np.zeros((n, step), "u1")
        for f in layout:
            a = f["offset"]
            if f["name"] == "rgb":
                for k, c in enumerate("bgr"):
                    raw[:, a + k] = np.floor(255 * t.column(c).to_numpy())
            else:
                raw[:, a : a + 4] = t.column(f["name"]).to_numpy().astype("<" + NUMBERS[f["datatype"]])[:, None].view("u1")
        row = {"topic": t.column("topic")[0].as_py(), "stamp_ticks": t.column("stamp_ticks")[0].as_py(), "frame_id": frame, "height": 1, "width": n, "point_step": step, "is_bigendian": False, "is_dense": True, "fields": layout, "data": raw.tobytes()}
        return pa.Table.from_pylist([row], schema=_ARROW)

    return points.groupBy("topic", "stamp_ticks").applyInArrow(run, MESSAGES)


_FIELD = pa.struct([("name", pa.string()), ("offset", pa.int32()), ("datatype", pa.int32()), ("count", pa.int32())])
_ARROW = pa.schema([("topic", pa.string()), ("stamp_ticks", pa.int64()), ("frame_id", pa.string()), ("height", pa.int32()), ("width", pa.int32()), ("point_step", pa.int32()), ("is_bigendian", pa.bool_()), ("is_dense", pa.bool_()), ("fields", pa.list_(_FIELD)), ("data", pa.binary())])


def messages_of_topic(messages: DataFrame, topic: str) -> DataFrame:
    """Messages of a topic, written with or without its slash; the filter reaches the scan."""
    name = topic.lstrip("/")
    return messages.where(F.col("topic").isin(name, "/" + name))


def mesh_tables(meshes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(mesh_id, vertices, polygons) to vertex and triangle tables; a polygon that is no triangle is an error."""
    vertices = meshes.select("mesh_id", F.posexplode("vertices").alias("vertex_id", "v")).select("mesh_id", "vertex_id", "v.*")
    p = meshes.select("mesh_id", F.posexplode("polygons").alias("triangle_id", "p"))
    ok = F.assert_true(F.size("p") == 3, F.lit("only triangles are supported"))
    return vertices, p.where(ok.isNull()).select("mesh_id", "triangle_id", *(F.element_at("p", k + 1).alias(f"i{k}") for k in range(3)))


def meshes_of_tables(vertices: DataFrame, triangles: DataFrame) -> DataFrame:
    v = vertices.groupBy("mesh_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("vertex_id", "x", "y", "z"))), lambda r: F.struct(r["x"].alias("x"), r["y"].alias("y"), r["z"].alias("z"))).alias("vertices"))
    t = triangles.groupBy("mesh_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("triangle_id", F.array("i0", "i1", "i2").alias("p")))), lambda r: r["p"]).alias("polygons"))
    return v.join(t, "mesh_id", "left")


def decode_pcd(raw: bytes) -> dict[str, np.ndarray]:
    """Columns of a PCD file, ascii or binary."""
    m = re.search(rb"DATA (\w+)\r?\n", raw)
    if not m:
        raise ValueError("no DATA line in the PCD header")
    head = {k: v.split() for k, _, v in (line.partition(" ") for line in raw[: m.start()].decode().splitlines()) if k}
    names, n = head["FIELDS"], int(head["POINTS"][0])
    counts = [int(c) for c in head.get("COUNT", ["1"] * len(names))]
    kinds = [PCD_KINDS[t, int(s)] for t, s in zip(head["TYPE"], head["SIZE"], strict=True)]
    if m[1] == b"ascii":
        rows = [r.split() for r in raw[m.end() :].decode().splitlines() if r.strip()]
        return {c: np.array([r[k] for r in rows], float).astype(t) for k, (c, t) in enumerate(zip(names, kinds, strict=True))}
    if m[1] != b"binary":
        raise ValueError(f"PCD body {m[1].decode()!r} is not supported")
    kind = np.dtype([(c, "<" + t, (k,)) if k > 1 else (c, "<" + t) for c, t, k in zip(names, kinds, counts, strict=True)])
    table = np.frombuffer(raw, kind, n, m.end())
    return {c: table[c] for c in names}


def encode_pcd(columns: dict[str, np.ndarray]) -> bytes:
    n = len(next(iter(columns.values())))
    names = " ".join(columns)
    head = f"# .PCD v0.7\nVERSION 0.7\nFIELDS {names}\nSIZE {' '.join(['8'] * len(columns))}\nTYPE {' '.join(['F'] * len(columns))}\nCOUNT {' '.join(['1'] * len(columns))}\nWIDTH {n}\nHEIGHT 1\nVIEWPOINT 0 0 0 1 0 0 0\nPOINTS {n}\nDATA binary\n"
    return head.encode() + np.stack([np.asarray(c, "<f8") for c in columns.values()], axis=1).tobytes()


def read_pcd(spark: SparkSession, path: str, columns: Sequence[str] = ("x", "y", "z")) -> DataFrame:
    """(path, point_id, *columns) of all PCD files under a path that Spark can read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, raw in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                got = decode_pcd(raw.as_py())
                n = len(next(iter(got.values()))) if got else 0
                cols = [pa.array(got[c].astype(float)) if c in got else pa.nulls(n, pa.float64()) for c in columns]
                yield pa.RecordBatch.from_arrays([pa.array([name] * n, pa.string()), pa.array(np.arange(n)), *cols], ["path", "point_id", *columns])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "path string, point_id long, " + ", ".join(f"{c} double" for c in columns))


def pcd_files(points: DataFrame, by: str, columns: Sequence[str] = ("x", "y", "z")) -> DataFrame:
    """(name, content): one PCD file per value of ``by``; a submap's cloud fits one file."""

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by("point_id")
        name = str(t.column(by)[0].as_py())
        return pa.table([[name if name.endswith(".pcd") else name + ".pcd"], pa.array([encode_pcd({c: t.column(c).to_numpy() for c in columns})], pa.binary())], names=["name", "content"])

    return points.groupBy(by).applyInArrow(run, "name string, content binary")


class PcdDataSource(DataSource):
    """``spark.read.format("pcd").option("path", ...)`` for folders that every task can open."""

    @classmethod
    def name(cls) -> str:
        return "pcd"

    def schema(self) -> str:
        return "file string, point_id long, x double, y double, z double"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _PcdReader(self.options["path"])


class _PcdReader(DataSourceReader):
    def __init__(self, path: str) -> None:
        self.path = path

    def partitions(self) -> list[InputPartition]:
        from pathlib import Path

        root = Path(self.path)
        return [InputPartition(str(p)) for p in (sorted(root.glob("*.pcd")) if root.is_dir() else [root])]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        got = decode_pcd(open(partition.value, "rb").read())
        for k, row in enumerate(zip(*(got[c].astype(float).tolist() for c in "xyz"), strict=True)):
            yield (partition.value, k, *row)


def save_map(points: DataFrame, path: str, overwrite: bool = False) -> None:
    points.write.mode("overwrite" if overwrite else "ignore").parquet(path)


def save_submaps(points: DataFrame, path: str, by: Sequence[str] = ("submap_id",)) -> None:
    """One folder per submap (and phase, pair or role, as ``by`` tells)."""
    points.write.mode("overwrite").partitionBy(*by).parquet(path)
