"""A growing map kept in tiles of whole voxels, from which a scan takes the tiles around it."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrane.operators.voxel import VOXEL, dense_state, merge_states, state_means

TILE = ("tx", "ty", "tz")


def tiled(points: DataFrame, voxel: float, tile: float) -> DataFrame:
    """Mergeable voxel sums of each session's points with the tile of each voxel, in the order of tiles.

    A tile is a cube of whole voxels, so that its edges cut none.
    """
    return in_tiles(dense_state(points, voxel, by=("session_id",)), voxel, tile)


def in_tiles(state: DataFrame, voxel: float, tile: float) -> DataFrame:
    """Voxel sums with the tile of each voxel, in the order of tiles."""
    per = max(1, round(tile / voxel))
    state = state.withColumns({t: F.floor(F.col(v) / per).cast("int") for t, v in zip(TILE, VOXEL, strict=True)})
    return state.sortWithinPartitions("session_id", *TILE)


def tiles_around(poses: DataFrame, reach: float, voxel: float, tile: float) -> DataFrame:
    """(session_id, pair_id, tx, ty, tz, pose): the tiles that a ball of radius ``reach`` around each pose can touch."""
    side = max(1, round(tile / voxel)) * voxel
    n = math.ceil(reach / side)
    steps = F.sequence(F.lit(-n), F.lit(n))
    out = poses.select("session_id", "pair_id", "pose")
    for axis, t in zip("xyz", TILE, strict=True):
        out = out.withColumn("step", F.explode(steps)).withColumn(t, F.floor(F.col(f"pose.t{axis}") / side).cast("int") + F.col("step"))
    return out.drop("step")


def patches(state: DataFrame, poses: DataFrame, reach: float, voxel: float, tile: float) -> DataFrame:
    """(pair_id, point_id, x, y, z): for each pose the map within ``reach`` of it, one mean point for each voxel.

    Only tiles around a pose are joined; the bounds of all of them go down to the scan of the
    map, whose files are sorted by tile.
    """
    around = tiles_around(poses, reach, voxel, tile)
    ends = around.agg(*(f(t).alias(f"{n}_{t}") for t in TILE for n, f in (("low", F.min), ("high", F.max)))).first()
    for t in TILE:
        if ends[f"low_{t}"] is not None:
            state = state.where(F.col(t).between(ends[f"low_{t}"], ends[f"high_{t}"]))
    met = state.join(around, ["session_id", *TILE])
    means = state_means(merge_states(met.select("pair_id", *VOXEL, "n", "sx", "sy", "sz"), by=("pair_id",)), by=("pair_id",))
    near = means.join(poses.select("pair_id", "pose"), "pair_id")
    away = [F.col(c) - F.col(f"pose.t{c}") for c in "xyz"]
    inside = near.where(away[0] * away[0] + away[1] * away[1] + away[2] * away[2] <= reach * reach)
    return inside.select("pair_id", F.xxhash64(*VOXEL).alias("point_id"), "x", "y", "z")
