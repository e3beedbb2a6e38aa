"""Centroid clustering in exact integers, searched progressively in the Walsh-Hadamard domain.

The transform keeps squared distances, up to a factor of its length.  A vector meets all
centroids on its first, coarsest coefficients; the centroid that looks nearest is finished at
once, and each other one is left as soon as what it has accumulated is strictly more.  Those
that reach the last coefficient have their whole distance, so the result is that of comparing
everything, ties included.

Vectors are transformed once and written; each round reads them, and sums per task meet in one
row for each centroid.  Only centroids, their sums and counts reach the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrane.llm._spark import forget, keep

#: Bound of a grid value: 64 coefficients of differences of 2 * 64 times it, squared and summed, fit a long.
_BOUND = 1 << 24
_ROWS = 4096


@dataclass(frozen=True)
class Clusters:
    """Length of the vectors (a power of two), number of centroids, rounds that move them, grid points per unit, seed of the choice, coefficients looked at first."""

    length: int = 64
    centroids: int = 40
    rounds: int = 5
    scale: int = 256
    seed: int = 2
    first: int = 8


def centroid_clusters(vectors: DataFrame, spec: Clusters = Clusters(), id_column: str = "vec_id", column: str = "embedding") -> DataFrame:
    """(id, cluster, distance, cluster_inertia, inertia, centroid_sha256), a row for each vector that takes part.

    Null vectors, those of another length and those with null or non-finite components take
    no part.  Repeated rows all count.  Vectors of one id begin as centroids in the order of
    their components; vectors of a null id are clustered, and begin only after all others.
    Fewer vectors than centroids give fewer centroids; an empty table gives no rows.  Other
    columns, whatever their names, are ignored.  Components of 2^24 grid points and more
    raise: their squared distances would not fit a long.
    """
    kind = dict(vectors.dtypes)[id_column]
    rows = vectors.select(F.col(id_column).alias("id"), F.col(column).cast("array<double>").alias("v"))
    rows = rows.where((F.size("v") == spec.length) & F.forall("v", _finite))
    transformed = keep(rows.mapInArrow(_Transform(spec), f"id {kind}, c array<long>"), "coefficients")
    centres = _begin(transformed, spec)
    for _ in range(spec.rounds if len(centres) else 0):
        centres = _moved(transformed, centres, spec)
    nearest = keep(transformed.mapInArrow(_Assign(centres, spec), f"id {kind}, cluster int, distance long"), "nearest")
    forget(transformed)
    sums = {r.cluster: r.s for r in nearest.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}  # a row per centroid
    stats = [(i, sums.get(i, 0), sum(sums.values()), hashlib.sha256(",".join(map(str, inverse(c.tolist()))).encode()).hexdigest()) for i, c in enumerate(centres)]
    known = vectors.sparkSession.createDataFrame(stats, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return nearest.join(F.broadcast(known), "cluster").select(F.col("id").alias(id_column), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")  # spec.centroids rows are sent


def _finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))


def _begin(transformed: DataFrame, spec: Clusters) -> np.ndarray:
    """The coefficients of the first centroids, in ascending order of their ids' digests."""
    name = F.sha2(F.concat(F.lit(f"{spec.seed}:"), F.col("id").cast("string")), 256)
    rows = transformed.select(name.alias("name"), "c").orderBy(F.asc_nulls_last("name"), "c").limit(spec.centroids).collect()
    return np.array([r.c for r in rows], np.int64).reshape(-1, spec.length)


def _moved(transformed: DataFrame, centres: np.ndarray, spec: Clusters) -> np.ndarray:
    """The centroids after one round: sums of coefficients are those of the sums of components."""
    parts = transformed.mapInArrow(_Sum(centres, spec), "cluster int, n long, s array<long>")
    sums = [F.sum(F.element_at("s", i + 1).cast("decimal(38,0)")).alias(f"s{i}") for i in range(spec.length)]
    moved = centres.copy()
    for r in parts.groupBy("cluster").agg(F.sum("n").alias("n"), *sums).collect():  # a row per centroid
        components = inverse([int(r[f"s{i}"]) for i in range(spec.length)])
        moved[r.cluster] = coefficients(np.array([[x // r.n for x in components]], np.int64))[0]
    return moved


def coarse_first(n: int) -> np.ndarray:
    """Order of the transform's rows by their changes of sign."""
    rows = _butterflies(np.eye(n, dtype=np.int64))
    return np.argsort((np.diff(rows, axis=1) != 0).sum(1), kind="stable")


def _butterflies(a: np.ndarray) -> np.ndarray:
    n, step = a.shape[1], 1
    while step < n:
        pairs = a.reshape(len(a), -1, 2, step)
        a = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], axis=2).reshape(len(a), n)
        step *= 2
    return a


def coefficients(grid: np.ndarray) -> np.ndarray:
    """The Walsh-Hadamard transform of integer rows, coarse coefficients first."""
    return _butterflies(grid)[:, coarse_first(grid.shape[1])]


def inverse(row: list[int]) -> list[int]:
    """The integers of which ``row`` holds the coefficients, exact at any size."""
    natural = np.empty((1, len(row)), object)
    natural[0, coarse_first(len(row))] = row
    return [x // len(row) for x in _butterflies(natural)[0]]


def nearest_centroids(rows: np.ndarray, centres: np.ndarray, first: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centre of each row and their squared distance in coefficients; of equal ones, the first."""
    width = rows.shape[1]
    stop = min(first, width)
    part = np.zeros((len(rows), len(centres)), np.int64)
    for i in range(stop):
        part += (rows[:, i, None] - centres[None, :, i]) ** 2
    ahead = part.argmin(1)
    bound = ((rows - centres[ahead]) ** 2).sum(1)
    r, c = np.nonzero(part <= bound[:, None])
    at = part[r, c]
    while stop < width:
        end = min(2 * stop, width)
        at += ((rows[r, stop:end] - centres[c, stop:end]) ** 2).sum(1)
        left = at <= bound[r]
        r, c, at, stop = r[left], c[left], at[left], end
    order = np.lexsort((c, at, r))
    best = order[np.searchsorted(r[order], np.arange(len(rows)))]
    return c[best], at[best]


def _rows(batch: pa.RecordBatch, width: int, step: int = _ROWS) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Pieces of a batch whose second column holds lists of ``width`` numbers, and the numbers."""
    for at in range(0, batch.num_rows, step):
        piece = batch.slice(at, step)
        yield piece, piece.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


class _Transform:
    def __init__(self, spec: Clusters) -> None:
        self.spec = spec

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spec = self.spec
        for batch in batches:
            for piece, values in _rows(batch, spec.length):
                grid = np.floor(spec.scale * values)
                if (np.abs(grid) >= _BOUND).any():
                    raise ValueError(f"components must stay below {_BOUND} grid points: squared distances would not fit a long")
                flat = coefficients(grid.astype(np.int64)).ravel()
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, spec.length, dtype=np.int32)), pa.array(flat))
                yield pa.RecordBatch.from_arrays([piece.column(0), lists], ["id", "c"])


class _Assign:
    def __init__(self, centres: np.ndarray, spec: Clusters) -> None:
        self.centres, self.spec = centres, spec

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece, rows in _rows(batch, self.spec.length):
                cluster, distance = nearest_centroids(rows, self.centres, self.spec.first)
                yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(cluster.astype(np.int32)), pa.array(distance // self.spec.length)], ["id", "cluster", "distance"])


class _Sum:
    """One row for each centroid that a task's vectors are nearest to, whatever their number."""

    def __init__(self, centres: np.ndarray, spec: Clusters) -> None:
        self.centres, self.spec = centres, spec

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k, width = self.centres.shape
        n, s = np.zeros(k, np.int64), np.zeros((k, width), np.int64)
        for batch in batches:
            for _, rows in _rows(batch, width):
                cluster, _ = nearest_centroids(rows, self.centres, self.spec.first)
                n += np.bincount(cluster, minlength=k)
                np.add.at(s, cluster, rows)
        there = np.flatnonzero(n)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(there) * width + 1, width, dtype=np.int32)), pa.array(s[there].ravel()))
        yield pa.RecordBatch.from_arrays([pa.array(there.astype(np.int32)), pa.array(n[there]), lists], ["cluster", "n", "s"])
