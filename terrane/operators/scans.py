"""Composite steps over whole sets of scans."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrane.config import Cropping
from terrane.operators.crop import crop_predicate, is_finite
from terrane.operators.neighbours import normals
from terrane.operators.voxel import VOXEL, downsample


def sample_voxels(voxels: DataFrame, ratio: float, seed: int = 0) -> DataFrame:
    """A repeatable share of a voxelised cloud; 1 or more keeps all."""
    if ratio >= 1:
        return voxels
    mixed = F.col("vx").cast("long") * 73856093 + F.col("vy").cast("long") * 19349663 + F.col("vz").cast("long") * 83492791 + F.col("scan_id") * 7919 + seed
    return voxels.filter(F.pmod(mixed, F.lit(1_000_003)) * 7919 % 1000 < int(ratio * 1000))


def preprocess(points: DataFrame, cropping: Cropping, voxel_size: float, ratio: float, normal_radius: float = 0.0, normal_k: int = 5, center: tuple = (0.0, 0.0, 0.0)) -> DataFrame:
    """Drop non-finite points, crop, voxelise, estimate normals where a radius is given, sample; all scans at once."""
    kept = points.filter(is_finite() & crop_predicate(cropping.kind, center, **cropping.arguments()))
    thin = downsample(kept, voxel_size)
    if normal_radius > 0:
        thin = thin.withColumn("h", F.xxhash64(*VOXEL))
        n = normals(thin.select(F.col("scan_id").alias("cloud_id"), F.col("h").alias("point_id"), "x", "y", "z"), normal_radius, normal_k)
        thin = thin.join(n.select(F.col("cloud_id").alias("scan_id"), F.col("point_id").alias("h"), "nx", "ny", "nz"), ["scan_id", "h"], "left").drop("h")
    return sample_voxels(thin, ratio)


def merge_and_match(points: DataFrame, merge: Cropping, match: Cropping, center: tuple = (0.0, 0.0, 0.0)) -> DataFrame:
    """One pass over the scans with the flags ``is_merge`` (wide crop, goes into the map) and ``is_match`` (narrow crop, is registered)."""
    flags = {name: crop_predicate(c.kind, center, **c.arguments()) for name, c in (("is_merge", merge), ("is_match", match))}
    return points.withColumns(flags).where("is_merge or is_match")


def empty_scans(flagged: DataFrame) -> DataFrame:
    """Scans without a point to register, which are an error for the mapper."""
    return flagged.groupBy("scan_id").agg(F.count_if("is_match").alias("n_match"), F.count_if("is_merge").alias("n_merge")).where("n_match = 0 or n_merge = 0")


def prepare_map(points: DataFrame, voxel_size: float, normal_radius: float, normal_k: int) -> DataFrame:
    """A loaded map, thinned and with normals, to localise in."""
    return preprocess(points.withColumn("scan_id", F.lit(0).cast("long")), Cropping("PassThrough"), voxel_size, 1.0, normal_radius, normal_k)


def pose_record(stamp: str, frame: str, child: str, pose: Column) -> Column:
    """A pose in the shape in which it is published."""
    return F.named_struct(F.lit("stamp"), F.col(stamp), F.lit("frame_id"), F.lit(frame), F.lit("child_frame_id"), F.lit(child), F.lit("translation"), F.struct(*(pose[f"t{c}"].alias(c) for c in "xyz")), F.lit("rotation"), F.struct(*(pose[f"q{c}"].alias(c) for c in "xyzw")))


def validate(df: DataFrame, rules: dict[str, Column], by: Sequence[str] = ()) -> DataFrame:
    """How many rows break each rule: (.., rule, broken)."""
    counts = df.groupBy(*by).agg(*(F.count_if(~F.coalesce(c, F.lit(False))).alias(n) for n, c in rules.items()))
    return counts.select(*by, F.explode(F.array(*(F.struct(F.lit(n).alias("rule"), F.col(n).alias("broken")) for n in rules))).alias("r")).select(*by, "r.*")
