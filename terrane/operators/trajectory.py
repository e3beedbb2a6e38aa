"""Time series of poses: lookups, windows, products and gating, per session."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrane.functions.geometry import TICKS_PER_SECOND, interpolate, pose_inv, pose_mul

BY, TIME = "session_id", "t_ticks"


def _forward() -> Window:
    return Window.partitionBy(BY).orderBy(TIME, F.col("is_query"))


def as_of(poses: DataFrame, queries: DataFrame) -> DataFrame:
    """Interpolated pose at each query time, held at the ends: queries' columns, ``pose`` and ``covered``.

    One shuffle: poses and queries of a session are sorted together, and each query takes the
    last pose before and the first after it.
    """
    rest = [c for c in queries.columns if c not in (BY, TIME)]
    p = poses.select(BY, TIME, "pose", F.lit(0).alias("is_query"))
    q = queries.select(BY, TIME, F.lit(1).alias("is_query"), *rest)
    both = p.unionByName(q, allowMissingColumns=True)
    known = F.when(F.col("is_query") == 0, F.struct(TIME, "pose"))
    before = F.last(known, ignorenulls=True).over(_forward().rowsBetween(Window.unboundedPreceding, 0))
    after = F.first(known, ignorenulls=True).over(_forward().rowsBetween(0, Window.unboundedFollowing))
    both = both.withColumns({"a": before, "b": after}).where("is_query = 1")
    at = F.col(TIME)
    exact = F.col(f"a.{TIME}") == at
    mid = interpolate(F.col("a.pose"), F.col(f"a.{TIME}"), F.col("b.pose"), F.col(f"b.{TIME}"), at)
    pose = F.when(exact, F.col("a.pose")).otherwise(F.coalesce(mid, F.col("a.pose"), F.col("b.pose")))
    return both.select(BY, TIME, *rest, pose.alias("pose"), (exact | (F.col("a").isNotNull() & F.col("b").isNotNull())).alias("covered"))


def consecutive(scans: DataFrame, order: str = TIME, item: str = "scan_id") -> DataFrame:
    w = Window.partitionBy(BY).orderBy(order, item)
    return scans.withColumn("previous", F.lag(item).over(w)).where("previous is not null")


def motion_between(poses: DataFrame, steps: int = 1) -> DataFrame:
    w = Window.partitionBy(BY).orderBy(TIME)
    back = F.lag("pose", steps).over(w)
    return poses.withColumn("motion", F.when(back.isNotNull(), pose_mul(pose_inv(back), F.col("pose"))))


def velocity(poses: DataFrame, steps: int) -> DataFrame:
    """Translation per second from the pose ``steps`` rows back; zero with a status where there are too few."""
    w = Window.partitionBy(BY).orderBy(TIME)
    seconds = (F.col(TIME) - F.lag(TIME, steps).over(w)) / TICKS_PER_SECOND + 1e-6
    v = {f"v{c}": F.coalesce((F.col(f"t{c}") - F.lag(f"t{c}", steps).over(w)) / seconds, F.lit(0.0)) for c in "xyz"}
    return poses.withColumns(v | {"velocity_status": F.when(F.lag(TIME, steps).over(w).isNull(), "too few poses").otherwise("ok")})


def nth_latest(poses: DataFrame, offset: int) -> DataFrame:
    w = Window.partitionBy(BY).orderBy(F.col(TIME).desc())
    return poses.withColumn("rn", F.row_number().over(w)).where(F.col("rn") == offset + 1).drop("rn")


def last_n(poses: DataFrame, n: int) -> DataFrame:
    w = Window.partitionBy(BY).orderBy(F.col(TIME).desc())
    return poses.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= n).drop("rn")


def time_span(poses: DataFrame) -> DataFrame:
    return poses.groupBy(BY).agg(F.min(TIME).alias("earliest"), F.max(TIME).alias("latest"), F.count("*").alias("size"))


def since_first(poses: DataFrame) -> Column:
    return (F.col(TIME) - F.min(TIME).over(Window.partitionBy(BY))) / TICKS_PER_SECOND


def overlap_replay(scans: DataFrame, n: int, switch: Column, item: str = "scan_id") -> DataFrame:
    """At each switching scan, the last n scans up to it, which the next submap receives again."""
    w = Window.partitionBy(BY).orderBy(TIME)
    recent = F.collect_list(item).over(w.rowsBetween(1 - n, 0))
    return scans.withColumn("replayed", recent).where(switch).select(BY, F.col(item).alias("switch"), F.explode("replayed").alias("replayed"))


def count_batches(scans: DataFrame, n: int, skip: int = 0, item: str = "scan_id") -> DataFrame:
    """Full batches of n scans in time order after the first ``skip``: number, stamp of the last, first and last scan."""
    rn = F.row_number().over(Window.partitionBy(BY).orderBy(TIME))
    batch = scans.withColumn("rn", rn.cast("long") - skip).where("rn > 0").withColumn("batch", F.floor((F.col("rn") - 1) / n))
    got = batch.groupBy(BY, "batch").agg(F.count("*").alias("size"), F.max(TIME).alias("stamp"), F.min_by(item, TIME).alias("first_item"), F.max_by(item, TIME).alias("last_item"))
    return got.where(F.col("size") == n)


def drop_late(rows: DataFrame, arrival: str = "arrival_seq", tie: str = "event_id") -> DataFrame:
    """Rows not older than the newest that arrived before them."""
    w = Window.partitionBy(BY).orderBy(arrival, tie).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("newest", F.max(TIME).over(w)).where(F.col(TIME) >= F.col("newest")).drop("newest")


def planar_product(steps: DataFrame) -> DataFrame:
    """Running product of planar motions (dx, dy, dyaw) per session, as running sums.

    The heading before a step is the sum of the turns before it; the step, turned by it, adds
    to the place.
    """
    w = Window.partitionBy(BY).orderBy(TIME)
    before = F.coalesce(F.sum("dyaw").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    s = steps.withColumn("heading", before)
    s = s.withColumns({"gx": F.cos("heading") * F.col("dx") - F.sin("heading") * F.col("dy"), "gy": F.sin("heading") * F.col("dx") + F.cos("heading") * F.col("dy")})
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    return s.withColumns({"px": F.sum("gx").over(run), "py": F.sum("gy").over(run), "pyaw": F.sum("dyaw").over(run)}).drop("heading", "gx", "gy")


def pose_product(steps: DataFrame, segment: int = 1024) -> DataFrame:
    """Running product of general motions (``pose``) per session in time order, as ``product``.

    Two levels: products within segments of rows, then of the segment totals, then both are
    composed.  A task streams through its segments or sessions in order and holds one batch.
    """
    rn = F.row_number().over(Window.partitionBy(BY).orderBy(TIME))
    s = steps.withColumn("segment", F.floor((rn - 1) / segment)).select(BY, "segment", TIME, *(F.col("pose")[n].alias(n) for n in _NAMES))

    def fold(by: int):
        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            key, total = None, None
            for t in frames:
                if t.empty:
                    continue
                codes = np.stack([pd.factorize(t.iloc[:, i], use_na_sentinel=False)[0] for i in range(by)])
                new = np.ones(len(t), bool)
                new[1:] = (codes[:, 1:] != codes[:, :-1]).any(axis=0)
                p = t[list(_NAMES)].to_numpy(np.float64).copy()
                if key == tuple(t.iloc[0, :by]):
                    p[0] = multiply(total[None], p[:1])[0]
                place = np.arange(len(t)) - np.maximum.accumulate(np.where(new, np.arange(len(t)), 0))
                step = 1
                while step <= place.max():
                    i = np.flatnonzero(place >= step)
                    p[i] = multiply(p[i - step], p[i])
                    step *= 2
                key, total = tuple(t.iloc[-1, :by]), p[-1]
                yield t.assign(**{n: p[:, k] for k, n in enumerate(_NAMES)})

        return run

    product = F.struct(*_NAMES).alias("product")
    inner = s.repartition(BY, "segment").sortWithinPartitions(BY, "segment", TIME).mapInPandas(fold(2), s.schema).select(BY, "segment", TIME, product)
    totals = inner.groupBy(BY, "segment").agg(F.max_by("product", TIME).alias("p")).select(BY, "segment", *(F.col("p")[n].alias(n) for n in _NAMES))
    outer = totals.repartition(BY).sortWithinPartitions(BY, "segment").mapInPandas(fold(1), totals.schema).select(BY, (F.col("segment") + 1).alias("segment"), F.struct(*_NAMES).alias("before"))
    done = inner.join(outer, [BY, "segment"], "left")
    return done.select(BY, TIME, F.when(F.col("before").isNull(), F.col("product")).otherwise(pose_mul(F.col("before"), F.col("product"))).alias("product"))


_NAMES = ("tx", "ty", "tz", "qx", "qy", "qz", "qw")


def multiply(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products of the poses in the rows of a and b, quaternions brought back to length one."""
    out = np.empty_like(b)
    u, w, v = a[:, 3:6], a[:, 6:7], b[:, :3]
    turn = np.cross(u, v)
    out[:, :3] = a[:, :3] + v + 2 * (w * turn + np.cross(u, turn))
    x, s = b[:, 3:6], b[:, 6:7]
    out[:, 3:6] = w * x + s * u + np.cross(u, x)
    out[:, 6:7] = w * s - (u * x).sum(axis=1, keepdims=True)
    out[:, 3:] /= np.sqrt((out[:, 3:] ** 2).sum(axis=1, keepdims=True))
    return out


def turns(q: np.ndarray) -> np.ndarray:
    """Rotation matrices of unit quaternions (x, y, z, w)."""
    x, y, z, w = q.T
    rows = [[1 - 2 * (y * y + z * z), 2 * (x * y - z * w), 2 * (x * z + y * w)], [2 * (x * y + z * w), 1 - 2 * (x * x + z * z), 2 * (y * z - x * w)], [2 * (x * z - y * w), 2 * (y * z + x * w), 1 - 2 * (x * x + y * y)]]
    return np.moveaxis(np.array(rows), -1, 0).reshape(-1, 3, 3)


def inverses(p: np.ndarray) -> np.ndarray:
    """The poses in the rows of p, undone."""
    out = np.concatenate([np.zeros((len(p), 3)), -p[:, 3:6], p[:, 6:]], axis=1)
    out[:, :3] = -(turns(out[:, 3:]) @ p[:, :3, None])[:, :, 0]
    return out


def chain_difference(odometry: DataFrame, maps: DataFrame, far: int = 60, near: int = 20) -> DataFrame:
    """(session_id, reached, estimated, distance): whether odometry tells the motion that the map tells.

    Both trajectories (session_id, t_ticks, pose) are read ``far`` and ``near`` poses back from
    their ends.  ``reached`` is the map's nearer pose, ``estimated`` its farther one moved on by
    the odometry in between.  Sessions with too few poses in either have no row.
    """
    ends = None
    for name, poses in (("odometry", odometry), ("map", maps)):
        back = F.row_number().over(Window.partitionBy(BY).orderBy(F.col(TIME).desc())) - 1
        rows = poses.select(BY, "pose", back.alias("back")).where(F.col("back").isin(far, near))
        pair = rows.groupBy(BY).agg(*(F.max(F.when(F.col("back") == n, F.col("pose"))).alias(f"{name}_{k}") for k, n in (("far", far), ("near", near))))
        pair = pair.where(F.col(f"{name}_far").isNotNull() & F.col(f"{name}_near").isNotNull())
        ends = pair if ends is None else ends.join(pair, BY)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for t in batches:
            p = {c: np.array([[x[n] for n in _NAMES] for x in t[c]], float).reshape(-1, 7) for c in t.columns if c != BY}
            motion = multiply(inverses(p["odometry_far"]), p["odometry_near"])
            estimated = multiply(p["map_far"], motion)
            away = np.linalg.norm(estimated[:, :3] - p["map_near"][:, :3], axis=1)
            yield pd.DataFrame({BY: t[BY], "reached": t["map_near"], "estimated": [dict(zip(_NAMES, map(float, x), strict=True)) for x in estimated], "distance": away})

    pose = ends.schema["map_near"].dataType.simpleString()
    return ends.mapInPandas(run, f"{BY} {dict(ends.dtypes)[BY]}, reached {pose}, estimated {pose}, distance double")


def key_scans(poses: DataFrame, least: float) -> DataFrame:
    """Scans that moved at least ``least`` from the last one kept; the first of a session is kept."""
    narrow = poses.select(BY, TIME, "event_id", "tx", "ty", "tz")

    def run(t: pd.DataFrame) -> pd.DataFrame:
        t = t.sort_values(TIME, kind="stable")
        last, keep = None, []
        for p in zip(t["tx"], t["ty"], t["tz"], strict=True):
            moved = last is None or sum((a - b) ** 2 for a, b in zip(p, last, strict=True)) ** 0.5 >= least
            keep.append(moved)
            last = p if moved else last
        return t[keep]

    return narrow.groupBy(BY).applyInPandas(run, narrow.schema)
