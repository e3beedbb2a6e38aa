"""Filters on points and poses."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrane.functions.geometry import pose_mul, quat_to_rpy

_CROPPERS: dict[str, Callable[..., Column]] = {}


def register_cropper(name: str, predicate: Callable[..., Column]) -> None:
    """Make ``predicate(dx, dy, dz, z, **parameters)`` available to ``crop`` by name."""
    _CROPPERS[name] = predicate


def _square(dx: Column, dy: Column, dz: Column) -> Column:
    return dx * dx + dy * dy + dz * dz


register_cropper("MaxRadius", lambda dx, dy, dz, z, radius: F.sqrt(_square(dx, dy, dz)) <= radius)
register_cropper("MinRadius", lambda dx, dy, dz, z, radius: F.sqrt(_square(dx, dy, dz)) >= radius)
register_cropper("MinMaxRadius", lambda dx, dy, dz, z, low, high: F.sqrt(_square(dx, dy, dz)).between(low, high))
register_cropper("Cylinder", lambda dx, dy, dz, z, radius, low, high: z.between(low, high) & (F.sqrt(dx * dx + dy * dy) <= radius))
register_cropper("PassThrough", lambda dx, dy, dz, z: F.lit(True))


def crop_predicate(kind: str, center: tuple = (0.0, 0.0, 0.0), inverted: bool = False, point: tuple[str, str, str] = ("x", "y", "z"), **parameters: float) -> Column:
    """Whether a point lies in the volume around ``center`` (numbers or columns).

    The height limits of a cylinder are absolute.  An unknown kind is an error before any job.
    """
    if kind not in _CROPPERS:
        raise ValueError(f"unknown cropper {kind!r}; known: {', '.join(sorted(_CROPPERS))}")
    x, y, z = (F.col(p) for p in point)
    cx, cy, cz = (c if isinstance(c, Column) else F.lit(float(c)) for c in center)
    inside = _CROPPERS[kind](x - cx, y - cy, z - cz, z, **parameters)
    return ~inside if inverted else inside


def crop(points: DataFrame, kind: str, center: tuple = (0.0, 0.0, 0.0), inverted: bool = False, **parameters: float) -> DataFrame:
    return points.filter(crop_predicate(kind, center, inverted, **parameters))


def ids_within(points: DataFrame, kind: str, center: tuple = (0.0, 0.0, 0.0), **parameters: float) -> DataFrame:
    return crop(points, kind, center, **parameters).select("scan_id", "point_id")


def color_in_range(low: float = 0.0, high: float = 1.0) -> Column:
    """All channels within the range; a point without colour passes."""
    r, g, b = (F.col(c) for c in "rgb")
    return r.isNull() | (r.between(low, high) & g.between(low, high) & b.between(low, high))


def is_finite(*columns: str) -> Column:
    good = F.lit(True)
    for c in columns or ("x", "y", "z"):
        good = good & F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    return good


def keep_ids(points: DataFrame, ids: DataFrame, on: Iterable[str] = ("scan_id", "point_id")) -> DataFrame:
    return points.join(ids, list(on), "left_semi")


def drop_ids(points: DataFrame, ids: DataFrame, on: Iterable[str] = ("scan_id", "point_id")) -> DataFrame:
    return points.join(ids, list(on), "left_anti")


def sample_by_hash(points: DataFrame, ratio: float, seed: int = 0) -> DataFrame:
    """A repeatable share of the points; 1 or more keeps all."""
    if ratio >= 1:
        return points
    spread = F.pmod(F.col("scan_id") * 7919 + F.col("point_id") * 104729 + seed, F.lit(1_000_003)) * 7919 % 1000
    return points.filter(spread < int(ratio * 1000))


def consistency_reasons(pose: Column, degrees: tuple[float, float, float] = (90, 90, 90), metres: tuple[float, float, float] = (10, 10, 15)) -> Column:
    """Names of the limits that a registration breaks; empty if it passes."""
    angles = [F.degrees(a) for a in quat_to_rpy([pose[n] for n in ("qx", "qy", "qz", "qw")])]
    checks = [(n, F.abs(a) > m) for n, a, m in zip(("roll", "pitch", "yaw"), angles, degrees, strict=True)]
    checks += [(n, F.abs(pose[f"t{n}"]) > m) for n, m in zip("xyz", metres, strict=True)]
    return F.array_compact(F.array(*(F.when(bad, F.lit(n)) for n, bad in checks)))


def quality_status(fitness: Column | str, least: float, ignore: bool = False) -> Column:
    f = F.col(fitness) if isinstance(fitness, str) else fitness
    return F.when(F.lit(ignore) | (f >= least), "accepted").otherwise("rejected")


def scans_ready(points: DataFrame, kind: str) -> DataFrame:
    """Scans fit to be merged: point-to-plane needs normals on all points, generalised needs covariances or normals."""
    has = {"PointToPoint": F.lit(True), "PointToPlane": F.col("nx").isNotNull(), "Generalized": F.col("nx").isNotNull() | (F.col("cov").isNotNull() if "cov" in points.columns else F.lit(False))}
    if kind not in has:
        raise ValueError(f"unknown registration {kind!r}")
    return points.groupBy("scan_id").agg(F.bool_and(has[kind]).alias("ready"))


def move_in_interval(poses: DataFrame, move: Column, begin: int, end: int) -> DataFrame:
    """Poses with ``move`` applied on the right within the closed time interval."""
    return poses.withColumn("pose", F.when(F.col("t_ticks").between(begin, end), pose_mul(F.col("pose"), move)).otherwise(F.col("pose")))


def every_nth(df: DataFrame, n: int, by: str, order: str) -> DataFrame:
    """Rows 1, n + 1, 2n + 1, ... of each group."""
    rn = F.row_number().over(Window.partitionBy(by).orderBy(order))
    return df.withColumn("rn", rn.cast("long")).filter((F.col("rn") - 1) % n == 0)


