"""Voxel aggregates, voxel joins and cloud statistics.

Sums are kept in millionths as whole numbers, so results do not depend on the order of rows
and partial states can be merged.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrane.functions.geometry import exact_mean, micro, voxel_center, voxel_key

VOXEL = ("vx", "vy", "vz")
XYZ = ("x", "y", "z")


def with_voxel(points: DataFrame, size: float) -> DataFrame:
    return points.withColumns(dict(zip(VOXEL, voxel_key(*XYZ, size), strict=True)))


def downsample(points: DataFrame, size: float, by: Sequence[str] = ("scan_id",)) -> DataFrame:
    """One mean point per voxel and group; a size of zero or less changes nothing."""
    if size <= 0:
        return points
    return with_voxel(points, size).groupBy(*by, *VOXEL).agg(F.count("*").alias("n"), *(exact_mean(c).alias(c) for c in XYZ))


def downsample_within(points: DataFrame, size: float, inside: Column) -> DataFrame:
    """Voxel means inside the volume, points outside as they are.

    Normals: mean of those that are set, of length one.  Colour: of the last point (greatest
    id) that has one.
    """
    attrs = [c for c in ("nx", "ny", "nz") if c in points.columns]
    colored = "r" in points.columns
    keyed = with_voxel(points, size).withColumn("own", F.when(inside, F.lit(-1).cast("long")).otherwise(F.col("point_id")))
    key = [F.when(inside, F.col(v)).otherwise(0).alias(v) for v in VOXEL]
    keyed = keyed.select("scan_id", "own", *key, "point_id", *XYZ, *attrs, *(["r", "g", "b"] if colored else []))
    out = [F.count("*").alias("n"), *(exact_mean(c).alias(c) for c in XYZ)]
    out += [F.sum(F.when(~F.isnan(c), micro(c))).alias(c) for c in attrs]
    if colored:
        out.append(F.max_by(F.struct("r", "g", "b"), F.when(F.col("r").isNotNull(), F.col("point_id"))).alias("rgb"))
    got = keyed.groupBy("scan_id", "own", *VOXEL).agg(*out)
    if attrs:
        length = F.sqrt(sum((F.col(c).cast("double") * F.col(c) for c in attrs[1:]), F.col(attrs[0]).cast("double") * F.col(attrs[0])))
        got = got.withColumns({c: F.col(c) / length for c in attrs})
    return got.select(*(c for c in got.columns if c != "rgb"), *(["rgb.r", "rgb.g", "rgb.b"] if colored else []))


def neighbourhood(points: DataFrame, radius: float, size: float, names: Sequence[str] = VOXEL) -> DataFrame:
    """A row for each voxel whose centre is within the radius of a point, and for its own, under ``names``.

    One axis after the other: what is too far along one is not multiplied by the next, and no
    array of voxels is built for a point.
    """
    reach = int(radius / size) + 1
    out, far, own = points, F.lit(0.0), F.lit(True)
    for c, key, name in zip(XYZ, voxel_key(*XYZ, size), names, strict=True):
        out = out.withColumn(name, F.explode(F.array(*(key + F.lit(k) for k in range(-reach, reach + 1)))))
        d = voxel_center(name, size) - F.col(c)
        far, own = far + d * d, own & (F.col(name) == key)
        out = out.where((far <= radius * radius) | own)
    return out


def first_per_voxel(points: DataFrame, size: float, by: Sequence[str] = ("scan_id",)) -> DataFrame:
    """The point of the least id in each voxel."""
    rest = [c for c in points.columns if c not in (*by, "point_id")]
    got = with_voxel(points, size).groupBy(*by, *VOXEL).agg(F.min(F.struct("point_id", *rest)).alias("p"))
    return got.select(*by, *VOXEL, "p.*")


STATE = ("n", *(f"s{c}" for c in XYZ))


def dense_state(points: DataFrame, size: float, by: Sequence[str] = ("scan_id",), extra: Sequence[str] = ()) -> DataFrame:
    """Mergeable voxel sums: counts and sums (in millionths) of coordinates and ``extra`` columns."""
    return with_voxel(points, size).groupBy(*by, *VOXEL).agg(F.count("*").alias("n"), *(F.sum(micro(c)).alias(f"s{c}") for c in (*XYZ, *extra)))


def merge_states(*states: DataFrame, by: Sequence[str] = ("scan_id",)) -> DataFrame:
    """The state of all points, from states of any split of them."""
    both = states[0]
    for s in states[1:]:
        both = both.unionByName(s)
    sums = [c for c in both.columns if c not in (*by, *VOXEL)]
    return both.groupBy(*by, *VOXEL).agg(*(F.sum(c).alias(c) for c in sums))


def state_means(state: DataFrame, by: Sequence[str] = ("scan_id",)) -> DataFrame:
    sums = [c for c in state.columns if c not in (*by, *VOXEL, "n")]
    return state.select(*by, *VOXEL, "n", *((F.col(c) / 1e6 / F.col("n")).alias(c[1:]) for c in sums))


def cloud_stats(points: DataFrame, size: float, by: Sequence[str] = ("scan_id",)) -> DataFrame:
    """Count, centroid, bounds padded by half a voxel, and mean and sample deviation of the height."""
    n = F.count("*")
    z, zz = F.sum(micro("z")), F.sum((micro("z") * micro("z")).cast("decimal(38,0)"))
    var = (zz.cast("double") - z.cast("double") * z.cast("double") / n) / (n - 1)
    bounds = [f(c).alias(f"{name}_{c}") for c in XYZ for f, name in ((lambda c: F.min(c) - size / 2, "low"), (lambda c: F.max(c) + size / 2, "high"))]
    return points.groupBy(*by).agg(n.alias("n"), *(exact_mean(c).alias(f"c{c}") for c in XYZ), *bounds, F.coalesce(F.floor(F.when(n > 1, F.sqrt(F.greatest(var, F.lit(0.0)))) / 100).cast("long"), F.lit(0).cast("long")).alias("sd_z_e4"))


def voxel_counts(points: DataFrame, size: float) -> DataFrame:
    return with_voxel(points, size).agg(F.count("*").alias("points"), F.countDistinct(*VOXEL).alias("voxels"), F.countDistinct("scan_id").alias("clouds"))


def overlap(source: DataFrame, target: DataFrame, size: float, least: int, pair: Sequence[str] = ("pair_id",)) -> DataFrame:
    """Voxels of each pair that hold at least ``least`` points of both sides."""
    a = with_voxel(source, size).groupBy(*pair, *VOXEL).agg(F.count("*").alias("n_source")).where(F.col("n_source") >= least)
    b = with_voxel(target, size).groupBy(*pair, *VOXEL).agg(F.count("*").alias("n_target")).where(F.col("n_target") >= least)
    return a.join(b, [*pair, *VOXEL])


def overlapping_points(points: DataFrame, voxels: DataFrame, size: float, pair: Sequence[str] = ("pair_id",)) -> DataFrame:
    return with_voxel(points, size).join(voxels, [*pair, *VOXEL], "left_semi").drop(*VOXEL)


def occupancy_ratio(points: DataFrame, occupied: DataFrame, size: float, by: Sequence[str]) -> DataFrame:
    """Share of each group's points that lie in an occupied voxel (vx, vy, vz) of the same group."""
    hit = with_voxel(points, size).join(occupied.select(*by, *VOXEL).distinct().withColumn("hit", F.lit(1)), [*by, *VOXEL], "left")
    return hit.groupBy(*by).agg(F.count("*").alias("n"), F.count("hit").alias("hits")).withColumn("ratio", F.col("hits") / F.col("n"))


def drop_voxels(points: DataFrame, gone: DataFrame, size: float, by: Sequence[str] = ()) -> DataFrame:
    return with_voxel(points, size).join(gone, [*by, *VOXEL], "left_anti").drop(*VOXEL)


def layered_index(points: DataFrame, size: float, layer: Column) -> DataFrame:
    """(layer, voxel, point): the long form of an inverted index."""
    return with_voxel(points, size).select(layer.alias("layer"), *VOXEL, "scan_id", "point_id")


def layers_of_voxels(index: DataFrame) -> DataFrame:
    """MAP layer -> point ids for each voxel."""
    per = index.groupBy(*VOXEL, "layer").agg(F.sort_array(F.collect_list("point_id")).alias("ids"))
    return per.groupBy(*VOXEL).agg(F.map_from_entries(F.collect_list(F.struct("layer", "ids"))).alias("layers"))


def points_in_voxels(index: DataFrame, layer: str, voxels: DataFrame) -> DataFrame:
    return index.where(F.col("layer") == layer).join(voxels, list(VOXEL), "left_semi")
