"""Space carving: points that a ray from the sensor passes through are removed from a map.

Rays go whole to the tiles in which they take steps, and so does what the map holds there.
Steps are worked out in the tile: none is moved.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrane.operators.voxel import VOXEL, drop_voxels, with_voxel

#: Voxels of a tile along each axis.
_TILE = 16
#: Rays and map points of a group beyond which they are dealt into parts; rows of a task.
_RAYS, _HELD, _ROWS = 500_000, 100_000, 1_000_000
#: Rays, and pairs of a ray and a map point, that are laid out at once.
_AT_ONCE, _PAIRS = 4096, 1_000_000
_ENDS = ("sx", "sy", "sz", "x", "y", "z")
_TILES = ("tile_x", "tile_y", "tile_z")


def ray_steps(scans: DataFrame, step: float, longest: float, truncation: float) -> DataFrame:
    """Points along each ray from the sensor (sx, sy, sz) to (x, y, z), a step apart, with the ray's direction.

    The path ends ``truncation`` before the point and after ``longest`` at most, but is one
    step long at least.  Rays of length zero are left out.
    """
    d = [F.col(c) - F.col(f"s{c}") for c in "xyz"]
    rays = scans.withColumn("length", F.sqrt(d[0] * d[0] + d[1] * d[1] + d[2] * d[2])).where("length > 0")
    rays = rays.withColumns({f"d{c}": v / F.col("length") for c, v in zip("xyz", d, strict=True)})
    path = F.greatest(F.lit(step), F.least(F.col("length") - truncation, F.lit(longest)))
    rays = rays.withColumn("k", F.explode(F.sequence(F.lit(0), F.ceil(path / step).cast("int") - 1)))
    return rays.withColumns({f"p{c}": F.col(f"s{c}") + F.col(f"d{c}") * (F.col("k") * F.lit(step)) for c in "xyz"})


def carved_points(scans: DataFrame, map_points: DataFrame, size: float, longest: float, truncation: float, least_dot: float, on: Sequence[str] = ("submap_id",)) -> DataFrame:
    """Ids of map points in voxels that a ray passes, unless the ray runs along their surface.

    A map point counts only if the ray meets it at |direction . normal| above ``least_dot``;
    map points carry nx, ny, nz.  Points look for one such ray, and leave once it is found.
    Rays without a length or a place are left out.
    """
    points = with_voxel(map_points, size).dropna(subset=["nx", "ny", "nz"]).select(*on, "point_id", "nx", "ny", "nz", *VOXEL)

    def search(held: dict[str, np.ndarray], hit: np.ndarray, tile: np.ndarray, steps: Steps) -> None:
        inside, cell = _cells(steps.voxels(size), tile, 0)
        ray = steps.ray[inside]
        own = _cells(np.stack([held[v] for v in VOXEL], axis=1), tile, 0)[1]
        normal = np.stack([held[f"n{c}"] for c in "xyz"], axis=1)
        at = 0
        while at < len(cell) and not hit.all():
            left = np.flatnonzero(~hit)
            left = left[np.argsort(own[left], kind="stable")]
            first, end = (np.searchsorted(own[left], cell[at:], side) for side in ("left", "right"))
            many = end - first
            n = max(1, int(np.searchsorted(np.cumsum(many), _PAIRS, "right")))
            first, many, r = first[:n], many[:n], ray[at : at + n]
            point = left[np.arange(many.sum()) - np.repeat(np.cumsum(many) - many - first, many)]
            u, v = steps.along[np.repeat(r, many)], normal[point]
            dot = np.abs(u[:, 0] * v[:, 0] + u[:, 1] * v[:, 1] + u[:, 2] * v[:, 2])
            hit[point[~(dot <= least_dot)]] = True
            at += n

    return _found(scans, points, search, size, size, longest, truncation, 0, on, ["point_id"], _HELD)


def carved_voxels(scans: DataFrame, occupied: DataFrame, size: float, longest: float, truncation: float, radius: float, on: Sequence[str] = ("submap_id",)) -> DataFrame:
    """Occupied voxels within ``radius`` of a ray, which advances by twice that, or in which it takes a step."""
    halo = math.floor(radius / size + 0.5 + 1e-9)

    def search(held: dict[str, np.ndarray], hit: np.ndarray, tile: np.ndarray, steps: Steps) -> None:
        voxel = np.stack([held[v] for v in VOXEL], axis=1)
        middle = voxel * size + size / 2
        side = _TILE + 2 * halo
        grid = np.full(side**3, -1, np.int32)
        left = np.flatnonzero(~hit)
        grid[_cells(voxel[left], tile, halo)[1]] = left
        inside, cell = _cells(steps.voxels(size), tile, 0, halo)
        p = steps.at[inside]
        around = range(-halo, halo + 1)
        for i, j, k in ((i, j, k) for i in around for j in around for k in around):
            which = grid[cell + (i * side + j) * side + k]
            some = np.flatnonzero(which >= 0)
            which = which[some]
            if i or j or k:
                d = middle[which] - p[some]
                which = which[d[:, 0] * d[:, 0] + d[:, 1] * d[:, 1] + d[:, 2] * d[:, 2] <= radius * radius]
            hit[which] = True

    return _found(scans, occupied.select(*on, *VOXEL).distinct(), search, size, 2 * radius, longest, truncation, halo, on, list(VOXEL), None)


class Steps:
    """The steps of some rays: position of each and the ray it belongs to; the rays' directions."""

    def __init__(self, ends: dict[str, np.ndarray], step: float, longest: float, truncation: float) -> None:
        s = np.stack([ends[f"s{c}"] for c in "xyz"], axis=1)
        d = np.stack([ends[c] for c in "xyz"], axis=1) - s
        length = np.sqrt(d[:, 0] * d[:, 0] + d[:, 1] * d[:, 1] + d[:, 2] * d[:, 2])
        n = np.ceil(np.maximum(step, np.minimum(length - truncation, longest)) / step).astype(np.int64)
        self.along = d / length[:, None]
        self.ray = np.repeat(np.arange(len(n)), n)
        k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        self.at = s[self.ray] + self.along[self.ray] * (k * step)[:, None]

    def voxels(self, size: float) -> np.ndarray:
        return np.floor(self.at / size).astype(np.int64)


def _cells(voxel: np.ndarray, tile: np.ndarray, halo: int, room: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Which voxels lie in a tile or within ``halo`` of it, and their cells in a grid with ``room`` around the tile."""
    room = halo if room is None else room
    side = _TILE + 2 * room
    p = voxel - tile * _TILE
    inside = np.flatnonzero(((p >= -halo) & (p < _TILE + halo)).all(axis=1))
    p = p[inside] + room
    return inside, (p[:, 0] * side + p[:, 1]) * side + p[:, 2]


def _dealt(rows: DataFrame, counts: DataFrame, on: Sequence[str], own: str, mine: Column, met: str, theirs: Column, salt: Sequence[str]) -> DataFrame:
    """Rows dealt into parts of their group, each row sent to all parts of the other side."""
    parts = rows.join(counts, list(on), "left").withColumn(own, F.pmod(F.xxhash64(*salt), F.coalesce(mine, F.lit(1))).cast("int"))
    return parts.withColumn(met, F.explode(F.sequence(F.lit(0), F.coalesce(theirs, F.lit(1)).cast("int") - 1))).drop(*(c for c in counts.columns if c not in on))


def _found(scans: DataFrame, held: DataFrame, search: Callable[[dict[str, np.ndarray], np.ndarray, np.ndarray, Steps], None], size: float, step: float, longest: float, truncation: float, halo: int, on: Sequence[str], result: Sequence[str], most: int | None) -> DataFrame:
    """Rows of ``held`` that ``search`` marks along the rays: (on, result).

    Rows of ``held`` have ``VOXEL`` of ``size`` and go to each tile within ``halo`` voxels, rays to
    each tile in which they take a step.  A task holds a tile's rows and streams through its
    rays.  Where a tile's rows aren't ``VOXEL`` alone they have no bound: groups of more than
    ``most`` of them, or of many rays, are dealt into parts that meet each other.
    """
    on = list(on)
    d = [F.col(c) - F.col(f"s{c}") for c in "xyz"]
    rays = scans.select(*on, *(F.col(c).cast("double") for c in _ENDS)).withColumn("__length", F.sqrt(d[0] * d[0] + d[1] * d[1] + d[2] * d[2])).dropna(subset=on).where("__length > 0 and __length < double('inf')")
    counts = rays.groupBy(*on).agg(F.count("*").alias("__rays"))
    if most is not None:
        counts = counts.join(held.groupBy(*on).agg(F.count("*").alias("__held")), on)
    size_of = counts.agg(F.sum("__rays").alias("all"), F.max("__rays").alias("rays"), *([F.max("__held").alias("held")] if most is not None else [])).first()
    ray_parts, held_parts = F.ceil(F.col("__rays") / _RAYS), F.ceil(F.col("__held") / most) if most is not None else F.lit(1)
    split = [] if (size_of["rays"] or 0) <= _RAYS and (most is None or (size_of["held"] or 0) <= most) else ["part_ray", "part_row"]
    if split:
        rays = _dealt(rays, counts, on, "part_ray", ray_parts, "part_row", held_parts, _ENDS)
        held = _dealt(held, counts, on, "part_row", held_parts, "part_ray", ray_parts, result)
    last = F.ceil(F.greatest(F.lit(step), F.least(F.col("__length") - truncation, F.lit(longest))) / step).cast("int") - 1

    def tile(k: Column) -> Column:
        at = (F.col(f"s{c}") + v / F.col("__length") * (k * F.lit(step)) for c, v in zip("xyz", d, strict=True))
        return F.struct(*(F.floor(F.floor(a / size) / _TILE).alias(t) for a, t in zip(at, _TILES, strict=True)))

    rays = rays.withColumn("__tile", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(0), last), tile))))
    rays = rays.select(*on, *split, *(F.col(f"__tile.{t}").alias(t) for t in _TILES), F.lit(True).alias("is_ray"), *(F.col(c).alias(f"ray_{c}") for c in _ENDS))
    mine = [c for c in held.columns if c not in (*on, *split)]
    for t, v in zip(_TILES, VOXEL, strict=True):
        near = [F.floor((F.col(v) + o) / _TILE) for o in sorted({-halo, halo})]
        held = held.withColumn(t, F.explode(F.array_distinct(F.array(*near))))
    key = [*on, *split, *_TILES]
    both = held.select(*key, F.lit(False).alias("is_ray"), *mine).unionByName(rays, allowMissingColumns=True)
    parts = max(int(scans.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-(size_of["all"] or 0) // _ROWS))
    sorted_ = both.repartition(parts, *key).sortWithinPartitions(*key, "is_ray")

    def marked(group: pa.Table, hit: np.ndarray) -> Iterator[pa.RecordBatch]:
        yield from group.select([*on, *result]).filter(pa.array(hit)).combine_chunks().to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows, group, arrays, hit, at = None, [], None, {}, np.zeros(0, bool), None
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            own = [batch.column(c) for c in key]
            new = np.zeros(n, bool)
            new[0] = now is None or [c[0] for c in own] != now
            for c in own:
                new[1:] |= np.asarray(pc.fill_null(pc.not_equal(c.slice(1), c.slice(0, n - 1)), True))
            is_ray = batch.column("is_ray").to_numpy(zero_copy_only=False)
            turn = new.copy()
            turn[0] = True
            turn[1:] |= is_ray[1:] != is_ray[:-1]
            starts = np.flatnonzero(turn)
            for a, b in zip(starts.tolist(), np.append(starts[1:], n).tolist(), strict=True):
                if new[a]:
                    if hit.any():
                        yield from marked(group, hit)
                    rows, group, hit = [], None, np.zeros(0, bool)
                if not is_ray[a]:
                    rows.append(batch.slice(a, b - a))
                elif rows:
                    if group is None:
                        group = pa.Table.from_batches(rows)
                        arrays = {c: group.column(c).to_numpy() for c in mine if c != "point_id"}
                        hit, at = np.zeros(len(group), bool), np.array([group.column(t)[0].as_py() for t in _TILES])
                    for i in range(a, b, _AT_ONCE):
                        if not hit.all():
                            search(arrays, hit, at, Steps({c: batch.column(f"ray_{c}").slice(i, min(_AT_ONCE, b - i)).to_numpy() for c in _ENDS}, step, longest, truncation))
            now = [c[n - 1] for c in own]
        if hit.any():
            yield from marked(group, hit)

    kinds = dict(held.dtypes)
    return sorted_.mapInArrow(run, ", ".join(f"{c} {kinds[c]}" for c in (*on, *result))).distinct()


def carve(map_points: DataFrame, scans: DataFrame, size: float, longest: float, truncation: float, least_dot: float, on: Sequence[str] = ("submap_id",)) -> DataFrame:
    return map_points.join(carved_points(scans, map_points, size, longest, truncation, least_dot, on), [*on, "point_id"], "left_anti")


def carve_dense(map_points: DataFrame, scans: DataFrame, size: float, longest: float, truncation: float, radius: float, on: Sequence[str] = ("submap_id",)) -> DataFrame:
    occupied = with_voxel(map_points, size).select(*on, *VOXEL).distinct()
    return drop_voxels(map_points, carved_voxels(scans, occupied, size, longest, truncation, radius, on), size, on)


def due(sequence: Column, every: int) -> Column:
    """Scans 1, 1 + every, ... are carved."""
    return F.pmod(sequence, F.lit(every)) == F.lit(1 % every)
