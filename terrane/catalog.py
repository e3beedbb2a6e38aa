"""The registered queries of the mapping operators and their SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from terrane.config import Cropping
from terrane.functions import geometry as g
from terrane.operators import carving, closing, crop, features, graph, mapping, neighbours, ordering, posegraph, registration, scans, trajectory, voxel
from terrane.plans.lineage import shared_folder
from terrane.plans.views import duck, view
from terrane.sources import clouds
from terrane.streaming.mapper import Mapping, SessionMapper

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    """Register a function under its name, with the SQL that gives the same rows."""

    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def _v(c: str, size: float) -> str:
    return f"cast(floor({c} / {size}) as integer)"


def _m(c: str) -> str:
    return f"cast(floor(({c}) * 1e6 + 0.5) as bigint)"


def _mean(c: str, name: str) -> str:
    return f"cast(sum({_m(c)}) as bigint) / 1e6 / count(*) as {name}"


_KEY2 = f"{_v('x', 2.0)} as vx, {_v('y', 2.0)} as vy, {_v('z', 2.0)} as vz"
_MEANS = ", ".join(_mean(c, c) for c in "xyz")
_R = "sqrt(x * x + y * y + z * z)"
_P = duck("points_v")


# points: crops and voxels


@query(f"{_P} select scan_id, {_KEY2}, count(*) as n, {_MEANS} from points_v where {_R} between 2 and 30 group by all")
def voxel_downsample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return voxel.downsample(crop.crop(view(spark, sf_dir, "points_v"), "MinMaxRadius", low=2.0, high=30.0), 2.0)


def _cropped(name: str, where: str, kind: str, **more) -> None:
    def f(spark: SparkSession, sf_dir: str) -> DataFrame:
        return crop.crop(view(spark, sf_dir, "points_v"), kind, **more).select("scan_id", "point_id", "x", "y", "z")

    f.__name__ = name
    query(f"{_P} select scan_id, point_id, x, y, z from points_v where {where}")(f)


_cropped("crop_max_radius", f"{_R} <= 15", "MaxRadius", radius=15.0)
_cropped("crop_min_radius", f"{_R} >= 15", "MinRadius", radius=15.0)
_cropped("crop_minmax", "sqrt((x - 3) * (x - 3) + (y + 2) * (y + 2) + (z - 1) * (z - 1)) between 5 and 20", "MinMaxRadius", center=(3.0, -2.0, 1.0), low=5.0, high=20.0)
_cropped("crop_cylinder", "z between -3 and 4 and sqrt(x * x + y * y) <= 12", "Cylinder", radius=12.0, low=-3.0, high=4.0)
_cropped("crop_inverted", f"not ({_R} <= 15)", "MaxRadius", radius=15.0, inverted=True)
_cropped("crop_pass_through", "true", "PassThrough")


@query(f"{_P} select scan_id, point_id from points_v where r between 0.1 and 0.8 and g between 0.1 and 0.8 and b between 0.1 and 0.8 and isfinite(x)")
def color_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "points_v").filter(crop.color_in_range(0.1, 0.8) & crop.is_finite()).select("scan_id", "point_id")


@query(f"{_P} select p.scan_id, p.point_id from (select * from points_v where {_R} <= 20) p anti join (select scan_id, point_id from points_v where r > 0.5) q using (scan_id, point_id)")
def select_and_drop_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = view(spark, sf_dir, "points_v")
    kept = crop.keep_ids(p, crop.ids_within(p, "MaxRadius", radius=20.0))
    return crop.drop_ids(kept, p.where("r > 0.5").select("scan_id", "point_id")).select("scan_id", "point_id")


@query(f"{_P} select scan_id, point_id from points_v where (((scan_id * 7919 + point_id * 104729) % 1000003) * 7919) % 1000 < 300")
def hash_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crop.sample_by_hash(view(spark, sf_dir, "points_v"), 0.3).select("scan_id", "point_id")


_IN = f"{_R} <= 15"


@query(
    f"{_P}, k as (select *, case when {_IN} then -1 else point_id end as own, case when {_IN} then {_v('x', 3.0)} else 0 end as vx, case when {_IN} then {_v('y', 3.0)} else 0 end as vy, case when {_IN} then {_v('z', 3.0)} else 0 end as vz from points_v) "
    f"select scan_id, own, vx, vy, vz, count(*) as n, {_MEANS}, arg_max(r, point_id) as r, arg_max(g, point_id) as g, arg_max(b, point_id) as b from k group by scan_id, own, vx, vy, vz"
)
def voxelize_in_volume(spark: SparkSession, sf_dir: str) -> DataFrame:
    return voxel.downsample_within(view(spark, sf_dir, "points_v"), 3.0, crop.crop_predicate("MaxRadius", radius=15.0))


@query(f"{_P} select scan_id, {_KEY2}, min(point_id) as point_id, arg_min(x, point_id) as x, arg_min(y, point_id) as y, arg_min(z, point_id) as z from points_v group by all")
def first_point_per_voxel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return voxel.first_per_voxel(view(spark, sf_dir, "points_v").select("scan_id", "point_id", "x", "y", "z"), 2.0)


_SUMS = ", ".join(f"cast(sum({_m(c)}) as bigint) as s{c}" for c in "xyzrgb")


@query(f"{_P} select scan_id, {_KEY2}, count(*) as n, {_SUMS} from points_v group by all")
def dense_voxel_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return voxel.dense_state(view(spark, sf_dir, "points_v"), 2.0, extra=("r", "g", "b"))


@query(f"{_P} select scan_id, {_KEY2}, count(*) as n, {', '.join(_mean(c, c) for c in 'xyzrgb')} from points_v group by all")
def dense_voxel_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = view(spark, sf_dir, "points_v")
    parts = [voxel.dense_state(p.where(F.col("point_id") % 3 == k), 2.0, extra=("r", "g", "b")) for k in range(3)]
    return voxel.state_means(voxel.merge_states(*parts))


@query(
    f"{_P} select scan_id, count(*) as n, {', '.join(_mean(c, 'c' + c) for c in 'xyz')}, "
    + ", ".join(f"min({c}) - 1.0 as low_{c}, max({c}) + 1.0 as high_{c}" for c in "xyz")
    + f", cast(coalesce(floor(case when count(*) > 1 then sqrt(greatest((cast(sum(cast({_m('z')} as hugeint) * {_m('z')}) as double) - cast(sum({_m('z')}) as double) * cast(sum({_m('z')}) as double) / count(*)) / (count(*) - 1), 0)) end / 100), 0) as bigint) as sd_z_e4 from points_v group by scan_id"
)
def cloud_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return voxel.cloud_stats(view(spark, sf_dir, "points_v"), 2.0)


@query(f"{_P} select count(*) as points, count(distinct ({_v('x', 2.0)}, {_v('y', 2.0)}, {_v('z', 2.0)})) as voxels, count(distinct scan_id) as clouds from points_v")
def voxel_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return voxel.voxel_counts(view(spark, sf_dir, "points_v"), 2.0)


@query(f"{_P} select scan_id, point_id, {_v('x', 1.5)} as vx, {_v('x', 1.5)} * 1.5e0 + 0.75e0 as center, {_v('x', 1.5)} * 1.5e0 as low, {_v('x', 1.5)} * 1.5e0 + 1.5e0 as high, x between -5 and 5 and y between -5 and 5 and z between -2 and 2 as boxed from points_v")
def voxel_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = view(spark, sf_dir, "points_v").withColumn("vx", g.voxel_key("x", "y", "z", 1.5)[0])
    return p.select("scan_id", "point_id", "vx", g.voxel_center("vx", 1.5).alias("center"), g.voxel_low("vx", 1.5).alias("low"), g.voxel_high("vx", 1.5).alias("high"), g.in_box("x", "y", "z", (-5, -5, -2), (5, 5, 2)).alias("boxed"))


@query(
    f"{_P}, s as (select unnest(range(-1, 5)) as k), big as (select distinct {_v('x', 6.0)} as bx, {_v('y', 6.0)} as b_y, {_v('z', 6.0)} as bz from points_v) "
    "select bx, b_y, bz, cast(floor(bx * 6.0 / 2.0) as integer) + i.k as vx, cast(floor(b_y * 6.0 / 2.0) as integer) + j.k as vy, cast(floor(bz * 6.0 / 2.0) as integer) + k.k as vz from big, s i, s j, s k "
    "where i.k between 0 and 2 and j.k between 0 and 2 and k.k between 0 and 2"
)
def smaller_voxels(spark: SparkSession, sf_dir: str) -> DataFrame:
    big = view(spark, sf_dir, "points_v").select(*(k.alias(n) for k, n in zip(g.voxel_key("x", "y", "z", 6.0), ("bx", "b_y", "bz"), strict=True))).distinct()
    return big.select("bx", "b_y", "bz", F.explode(g.smaller_voxels("bx", "b_y", "bz", 6.0, 2.0)).alias("v")).select("bx", "b_y", "bz", *(F.col(f"v.{n}").cast("int").alias(n) for n in ("vx", "vy", "vz")))


@query(
    f"{_P}, s as (select cast(unnest(range(-2, 3)) as integer) as k), p as (select scan_id, point_id, x, y, z, {_KEY2} from points_v) "
    "select scan_id, point_id, vx + i.k as nx, vy + j.k as ny, vz + k.k as nz from p, s i, s j, s k where (i.k = 0 and j.k = 0 and k.k = 0) or "
    "((vx + i.k) * 2.0 + 1.0 - x) * ((vx + i.k) * 2.0 + 1.0 - x) + ((vy + j.k) * 2.0 + 1.0 - y) * ((vy + j.k) * 2.0 + 1.0 - y) + ((vz + k.k) * 2.0 + 1.0 - z) * ((vz + k.k) * 2.0 + 1.0 - z) <= 6.25"
)
def voxel_neighbourhood(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = view(spark, sf_dir, "points_v")
    return voxel.neighbourhood(p, 2.5, 2.0, ("nx", "ny", "nz")).select("scan_id", "point_id", "nx", "ny", "nz")


_KEY4 = f"{_v('x', 4.0)} as vx, {_v('y', 4.0)} as vy, {_v('z', 4.0)} as vz"


@query(
    f"{_P}, a as (select scan_id as pair_id, {_KEY4}, count(*) as n_source from points_v group by all having count(*) >= 2), b as (select scan_id - 1 as pair_id, {_KEY4}, count(*) as n_target from points_v group by all having count(*) >= 2) select * from a join b using (pair_id, vx, vy, vz)"
)
def voxel_overlap_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Voxels that each scan shares with the next."""
    p = view(spark, sf_dir, "points_v")
    return voxel.overlap(p.withColumn("pair_id", F.col("scan_id")), p.withColumn("pair_id", F.col("scan_id") - 1), 4.0, 2)


@query(
    f"{_P}, p as (select *, {_KEY4} from points_v), o as (select distinct scan_id - 1 as scan_id, vx, vy, vz, 1 as hit from p), h as (select p.scan_id, hit from p left join o using (scan_id, vx, vy, vz)) select scan_id, count(*) as n, count(hit) as hits, count(hit) / count(*) as ratio from h group by scan_id"
)
def occupancy_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = view(spark, sf_dir, "points_v")
    return voxel.occupancy_ratio(p, voxel.with_voxel(p, 4.0).withColumn("scan_id", F.col("scan_id") - 1), 4.0, ["scan_id"])


@query(f"{_P}, p as (select *, {_KEY4} from points_v), o as (select distinct scan_id - 1 as scan_id, vx, vy, vz from p) select scan_id, point_id from p anti join o using (scan_id, vx, vy, vz)")
def carve_antijoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = view(spark, sf_dir, "points_v")
    gone = voxel.with_voxel(p, 4.0).select((F.col("scan_id") - 1).alias("scan_id"), "vx", "vy", "vz").distinct()
    return voxel.drop_voxels(p, gone, 4.0, ["scan_id"]).select("scan_id", "point_id")


@query(f"{_P} select case when {_R} <= 15 then 'near' else 'far' end as layer, {_KEY4}, count(*) as n, min(scan_id * 100000 + point_id) as first from points_v group by all")
def layered_voxel_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    layer = F.when(crop.crop_predicate("MaxRadius", radius=15.0), "near").otherwise("far")
    index = voxel.layered_index(view(spark, sf_dir, "points_v"), 4.0, layer)
    return index.groupBy("layer", "vx", "vy", "vz").agg(F.count("*").alias("n"), F.min(F.col("scan_id") * 100000 + F.col("point_id")).alias("first"))


_MOVE = duck("points_v", "scan_poses_v")
_MOVED = "cos(yaw) * x - sin(yaw) * y + tx as mx, sin(yaw) * x + cos(yaw) * y + ty as my, z + tz as mz"


def _moved(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = view(spark, sf_dir, "points_v").join(view(spark, sf_dir, "scan_poses_v"), "scan_id")
    new = g.pose_apply(g.planar_pose("tx", "ty", "tz", "yaw"), "x", "y", "z")
    return p.select("scan_id", "point_id", *(c.alias(f"m{a}") for a, c in zip("xyz", new, strict=True)))


def _e4(*names: str) -> list:
    return [F.floor(F.col(n) * 1e4 + 0.5).cast("long").alias(n) for n in names]


def _sql4(*names: str) -> str:
    return ", ".join(f"cast(floor({n} * 1e4 + 0.5) as bigint) as {n}" for n in names)


@query(f"{_MOVE}, m as (select scan_id, point_id, {_MOVED} from points_v join scan_poses_v using (scan_id)) select scan_id, point_id, {_sql4('mx', 'my', 'mz')} from m")
def transform_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _moved(spark, sf_dir).select("scan_id", "point_id", *_e4("mx", "my", "mz"))


_FACE = [f"cast(floor({_m('m' + c)} / 2e6) as integer) as v{c}" for c in "xyz"]


@query(
    f"{_MOVE}, m as (select scan_id, point_id, {_MOVED} from points_v join scan_poses_v using (scan_id)), c as (select scan_id // 10 as submap_id, {', '.join(_FACE)} from m) select submap_id, vx, vy, vz, count(*) as n from c group by all"
)
def assembled_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Voxels of all scans moved to the map, by submap; coordinates count in whole millionths, so a point on a face belongs to the voxel above it."""
    key = [F.floor(g.micro(f"m{c}") / 2e6).cast("int").alias(f"v{c}") for c in "xyz"]
    return _moved(spark, sf_dir).groupBy(F.floor(F.col("scan_id") / 10).cast("long").alias("submap_id"), *key).agg(F.count("*").alias("n"))


@query(
    f"{_P}, a as (select scan_id, point_id, case when atan2(y, x) < 0 then atan2(y, x) + 2 * 3.141592653589793 else atan2(y, x) end / (2 * 3.141592653589793) as phase from points_v where x <> 0 or y <> 0) select scan_id, point_id, cast(floor((1 - phase) * 1e6 + 0.5) as bigint) as phase from a"
)
def azimuth_phase(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = view(spark, sf_dir, "points_v").where("x <> 0 or y <> 0")
    return p.select("scan_id", "point_id", g.micro(g.azimuth_phase("x", "y")).alias("phase"))


@query(
    f"{_P}, a as (select *, (1 - case when atan2(y, x) < 0 then atan2(y, x) + 2 * 3.141592653589793 else atan2(y, x) end / (2 * 3.141592653589793)) * 0.1 as s from points_v where x <> 0 or y <> 0), m as (select scan_id, point_id, cos(0.4 * s) * x - sin(0.4 * s) * y + 2.0 * s as mx, sin(0.4 * s) * x + cos(0.4 * s) * y - 1.0 * s as my, z as mz from a) select scan_id, point_id, {_sql4('mx', 'my', 'mz')} from m"
)
def deskew(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = view(spark, sf_dir, "points_v").where("x <> 0 or y <> 0")
    new = g.deskew("x", "y", "z", g.azimuth_phase("x", "y"), (2.0, -1.0, 0.0), (0.0, 0.0, 0.4))
    return p.select("scan_id", "point_id", *(c.alias(f"m{a}") for a, c in zip("xyz", new, strict=True))).select("scan_id", "point_id", *_e4("mx", "my", "mz"))


@query(f"{_P} select scan_id, point_id, cast(floor(255 * r) as integer) as byte, cast(floor(255 * r) as integer) / 255.0 as unit, least(greatest(g * 1.5, 0.0), 1.0) as scaled from points_v")
def color_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = view(spark, sf_dir, "points_v")
    byte = g.color_to_byte("r")
    return p.select("scan_id", "point_id", byte.alias("byte"), g.byte_to_color(byte).alias("unit"), g.scale_color("g", 1.5).alias("scaled"))


# poses

_Q = duck("poses_v")


@query(
    f"{_Q} select event_id, {_m('sin(yaw / 2)')} as qz, {_m('cos(yaw / 2)')} as qw, {_m('yaw')} as back, 0 as roll_pitch from poses_v where abs(yaw) < 3.1"
)
def rpy_quat_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = view(spark, sf_dir, "poses_v").where(F.abs("yaw") < 3.1)
    q = g.rpy_to_quat(0.0, 0.0, "yaw")
    roll, pitch, yaw = g.quat_to_rpy(q)
    return p.select("event_id", g.micro(q[2]).alias("qz"), g.micro(q[3]).alias("qw"), g.micro(yaw).alias("back"), (g.micro(roll) + g.micro(pitch)).cast("int").alias("roll_pitch"))


@query(f"{_Q} select event_id, t_ticks, (t_ticks - 621355968000000000) * 100 as unix_nanos, t_ticks > 0 as valid, cast(t_ticks as varchar) as text, t_ticks - min(t_ticks) over (partition by session_id) as since from poses_v")
def time_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = view(spark, sf_dir, "poses_v")
    since = g.seconds_to_ticks(trajectory.since_first(p))
    return p.select("event_id", "t_ticks", g.ticks_to_unix_nanos("t_ticks").alias("unix_nanos"), g.is_valid_time("t_ticks").alias("valid"), F.col("t_ticks").cast("string").alias("text"), since.alias("since"))


@query(
    f"{_Q} select event_id, printf('t:[%f, %f, %f] ; q:[%f, %f, %f, %f] ; rpy (deg):[%f, %f, %f]', tx, ty, tz, cast(0 as double), cast(0 as double), sin(yaw / 2), cos(yaw / 2), cast(0 as double), cast(0 as double), degrees(yaw)) as text from poses_v"
)
def pose_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "poses_v").select("event_id", g.pose_text(g.planar_pose("tx", "ty", "tz", "yaw")).alias("text"))


@query(f"{_Q} select session_id, event_id, lag(event_id) over w as previous from poses_v window w as (partition by session_id order by t_ticks, event_id) qualify previous is not null")
def scan_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trajectory.consecutive(view(spark, sf_dir, "poses_v"), item="event_id").select("session_id", "event_id", "previous")


@query(
    f"{_Q}, h as (select *, coalesce(sum(dyaw) over (partition by session_id order by t_ticks rows between unbounded preceding and 1 preceding), 0) as heading from poses_v), p as (select event_id, sum(cos(heading) * dx - sin(heading) * dy) over w as px, sum(sin(heading) * dx + cos(heading) * dy) over w as py, sum(dyaw) over w as pyaw from h window w as (partition by session_id order by t_ticks rows unbounded preceding)) select event_id, {_sql4('px', 'py', 'pyaw')} from p"
)
def planar_odometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trajectory.planar_product(view(spark, sf_dir, "poses_v")).select("event_id", *_e4("px", "py", "pyaw"))


@query(
    f"{_Q}, h as (select *, coalesce(sum(dyaw) over (partition by session_id order by t_ticks rows between unbounded preceding and 1 preceding), 0) as heading from poses_v), p as (select session_id, t_ticks, sum(cos(heading) * dx - sin(heading) * dy) over w as px, sum(sin(heading) * dx + cos(heading) * dy) over w as py from h window w as (partition by session_id order by t_ticks rows unbounded preceding)) select session_id, t_ticks, {_sql4('px', 'py')} from p"
)
def pose_product(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same trajectories as general pose products, in segments of 32 rows so that small sessions have several."""
    p = view(spark, sf_dir, "poses_v").select("session_id", "t_ticks", g.planar_pose("dx", "dy", 0.0, "dyaw").alias("pose"))
    got = trajectory.pose_product(p, segment=32)
    return got.select("session_id", "t_ticks", F.col("product.tx").alias("px"), F.col("product.ty").alias("py")).select("session_id", "t_ticks", *_e4("px", "py"))


@query(
    f"{_Q} select event_id, {_m('coalesce((tx - lag(tx, 3) over w) / ((t_ticks - lag(t_ticks, 3) over w) / 1e7 + 1e-6), 0)')} as vx, {_m('coalesce((ty - lag(ty, 3) over w) / ((t_ticks - lag(t_ticks, 3) over w) / 1e7 + 1e-6), 0)')} as vy, case when lag(t_ticks, 3) over w is null then 'too few poses' else 'ok' end as velocity_status from poses_v window w as (partition by session_id order by t_ticks)"
)
def velocity_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trajectory.velocity(view(spark, sf_dir, "poses_v"), 3).select("event_id", g.micro("vx").alias("vx"), g.micro("vy").alias("vy"), "velocity_status")


@query(f"{_Q} select session_id, event_id, t_ticks from poses_v qualify row_number() over (partition by session_id order by t_ticks desc) = 3")
def nth_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trajectory.nth_latest(view(spark, sf_dir, "poses_v"), 2).select("session_id", "event_id", "t_ticks")


@query(f"{_Q} select session_id, event_id from poses_v qualify row_number() over (partition by session_id order by t_ticks desc) <= 20")
def last_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trajectory.last_n(view(spark, sf_dir, "poses_v"), 20).select("session_id", "event_id")


@query(f"{_Q} select session_id, min(t_ticks) as earliest, max(t_ticks) as latest, count(*) as size from poses_v group by session_id")
def session_span(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trajectory.time_span(view(spark, sf_dir, "poses_v"))


@query(f"{_Q}, n as (select session_id, event_id, row_number() over (partition by session_id order by t_ticks) as rn from poses_v) select * from n where (rn - 1) % 10 = 0")
def every_nth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crop.every_nth(view(spark, sf_dir, "poses_v"), 10, "session_id", "t_ticks").select("session_id", "event_id", "rn")


@query(f"{_Q}, n as (select session_id, event_id, row_number() over (partition by session_id order by t_ticks) as rn from poses_v) select a.session_id, a.event_id as switch, b.event_id as replayed from n a join n b on a.session_id = b.session_id and b.rn between a.rn - 2 and a.rn where a.event_id % 7 = 0")
def overlap_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trajectory.overlap_replay(view(spark, sf_dir, "poses_v"), 3, F.col("event_id") % 7 == 0, "event_id")


@query(
    f"{_Q}, n as (select *, row_number() over (partition by session_id order by t_ticks) - 5 as rn from poses_v), b as (select *, (rn - 1) // 4 as batch from n where rn > 0) select session_id, batch, count(*) as size, max(t_ticks) as stamp, arg_min(event_id, t_ticks) as first_item, arg_max(event_id, t_ticks) as last_item from b group by session_id, batch having count(*) = 4"
)
def count_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trajectory.count_batches(view(spark, sf_dir, "poses_v"), 4, skip=5, item="event_id")


@query(f"{_Q} select session_id, event_id, t_ticks from poses_v qualify t_ticks >= max(t_ticks) over (partition by session_id order by arrival_seq, event_id rows unbounded preceding)")
def late_drop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trajectory.drop_late(view(spark, sf_dir, "poses_v")).select("session_id", "event_id", "t_ticks")


@query(
    f"with recursive poses as ({_Q[len('with poses_v as ') :]}), n as (select session_id, event_id, tx, ty, row_number() over (partition by session_id order by t_ticks) as rn from poses), "
    "k as (select session_id, event_id, rn, tx as lx, ty as ly, true as kept from n where rn = 1 union all select n.session_id, n.event_id, n.rn, "
    "case when sqrt((n.tx - lx) * (n.tx - lx) + (n.ty - ly) * (n.ty - ly)) >= 4 then n.tx else lx end, case when sqrt((n.tx - lx) * (n.tx - lx) + (n.ty - ly) * (n.ty - ly)) >= 4 then n.ty else ly end, "
    "sqrt((n.tx - lx) * (n.tx - lx) + (n.ty - ly) * (n.ty - ly)) >= 4 from k join n on n.session_id = k.session_id and n.rn = k.rn + 1) select session_id, event_id from k where kept"
)
def keyscan_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trajectory.key_scans(view(spark, sf_dir, "poses_v"), 4.0).select("session_id", "event_id")


@query(
    f"{_Q}, q as (select session_id, t_ticks + 30000000 as t, event_id from poses_v), "
    "j as (select q.session_id, q.t, q.event_id, a.t_ticks as ta, a.tx as ax, a.ty as ay, b.t_ticks as tb, b.tx as bx, b.ty as b_y from q asof left join poses_v a on q.session_id = a.session_id and q.t >= a.t_ticks asof left join poses_v b on q.session_id = b.session_id and q.t <= b.t_ticks), "
    "f as (select *, ((t - ta) / 1e7) / ((tb - ta) / 1e7 + 1e-6) as f from j), r as (select event_id, case when ta = t then ax when tb is null then ax else ax + f * (bx - ax) end as px, case when ta = t then ay when tb is null then ay else ay + f * (b_y - ay) end as py, ta = t or tb is not null as covered from f) "
    f"select event_id, {_sql4('px', 'py')}, covered from r"
)
def pose_asof_interp(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = view(spark, sf_dir, "poses_v")
    q = p.select("session_id", (F.col("t_ticks") + 30_000_000).alias("t_ticks"), "event_id")
    got = trajectory.as_of(p.withColumn("pose", g.planar_pose("tx", "ty", "tz", "yaw")), q)
    return got.select("event_id", F.col("pose.tx").alias("px"), F.col("pose.ty").alias("py"), "covered").select("event_id", *_e4("px", "py"), "covered")


@query(
    f"{_Q}, m as (select event_id, yaw, dx, dy, dyaw, lag(tx) over w as lx, lag(ty) over w as ly, lag(yaw) over w as lyaw, tx, ty from poses_v window w as (partition by session_id order by t_ticks)), r as (select event_id, cos(lyaw) * (tx - lx) + sin(lyaw) * (ty - ly) as mx, -sin(lyaw) * (tx - lx) + cos(lyaw) * (ty - ly) as my from m where lx is not null) select event_id, {_sql4('mx', 'my')} from r"
)
def motion_between(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = view(spark, sf_dir, "poses_v").withColumn("pose", g.planar_pose("tx", "ty", "tz", "yaw"))
    return trajectory.motion_between(p).where("motion is not null").select("event_id", F.col("motion.tx").alias("mx"), F.col("motion.ty").alias("my")).select("event_id", *_e4("mx", "my"))


@query(
    f"{_Q}, c as (select event_id, degrees(yaw) as d, tx, ty from poses_v) select event_id, concat_ws(',', case when abs(d) > 90 then 'yaw' end, case when abs(tx) > 10 then 'x' end, case when abs(ty) > 8 then 'y' end) as reasons from c where abs(abs(d) - 90) > 1e-6 and abs(d) < 179"
)
def consistency_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = view(spark, sf_dir, "poses_v").where("abs(abs(degrees(yaw)) - 90) > 1e-6 and abs(degrees(yaw)) < 179")
    return p.select("event_id", F.array_join(crop.consistency_reasons(g.planar_pose("tx", "ty", "tz", "yaw"), metres=(10, 8, 15)), ",").alias("reasons"))


# neighbours

_N = duck("vec_points_v")
_D2 = "(s.x - t.x) * (s.x - t.x) + (s.y - t.y) * (s.y - t.y) + (s.z - t.z) * (s.z - t.z)"


@query(f"{_N} select s.cloud_id, s.point_id as source_id, t.point_id as target_id, {_D2} as d2 from vec_points_v s join vec_points_v t on s.cloud_id = t.cloud_id where {_D2} <= 0.1 * 0.1")
def radius_nn(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = view(spark, sf_dir, "vec_points_v")
    return neighbours.radius_pairs(p, p, 0.1, ["cloud_id"]).select("cloud_id", "source_id", "target_id", "d2")


@query(f"{_N}, n as (select s.cloud_id, s.point_id as source_id, t.point_id as target_id, {_D2} as d2, row_number() over (partition by s.cloud_id, s.point_id order by {_D2}, t.point_id) as rank from vec_points_v s join vec_points_v t on s.cloud_id = t.cloud_id where {_D2} <= 0.15 * 0.15) select * from n where rank <= 5")
def hybrid_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.k_nearest(view(spark, sf_dir, "vec_points_v"), 0.15, 5).select("cloud_id", "source_id", "target_id", "d2", "rank")


@query(f"{_N}, n as (select s.cloud_id, s.point_id as source_id, t.point_id as target_id, {_D2} as d2, row_number() over (partition by s.cloud_id, s.point_id order by {_D2}, t.point_id) as rank from vec_points_v s join vec_points_v t on s.cloud_id = t.cloud_id) select * from n where rank <= 8")
def pure_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The eight nearest at any distance."""
    return neighbours.k_nearest_any(view(spark, sf_dir, "vec_points_v"), 8, 0.1).select("cloud_id", "source_id", "target_id", "d2", "rank")


@query(
    f"{_N}, c as (select cloud_id, lead(cloud_id) over (order by cloud_id) as other from (select distinct cloud_id from vec_points_v)), n as (select c.cloud_id as pair_id, s.point_id as source_id, t.point_id as target_id, {_D2} as d2 from c join vec_points_v s on s.cloud_id = c.cloud_id join vec_points_v t on t.cloud_id = c.other) select pair_id, source_id, arg_min(target_id, (d2, target_id)) as target_id, min(d2) as d2 from n group by pair_id, source_id"
)
def nn_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearest point of the next cloud, at any distance."""
    p = view(spark, sf_dir, "vec_points_v")
    return neighbours.nearest(*_cloud_pairs(p), 0.05, ["pair_id"])


def _cloud_pairs(p: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Each cloud as source and the next one as its target."""
    clouds = p.select("cloud_id").distinct()
    after = clouds.select(F.col("cloud_id").alias("pair_id"), F.lead("cloud_id").over(Window.orderBy("cloud_id")).alias("cloud_id")).where("cloud_id is not null")
    source = p.select(F.col("cloud_id").alias("pair_id"), "point_id", "x", "y", "z")
    return source, p.join(after, "cloud_id").select("pair_id", "point_id", "x", "y", "z")


@query(
    f"{_N}, c as (select cloud_id, lead(cloud_id) over (order by cloud_id) as other from (select distinct cloud_id from vec_points_v)), n as (select c.cloud_id as pair_id, s.point_id as source_id, t.point_id as target_id, {_D2} as d2, t.x, t.y, t.z from c join vec_points_v s on s.cloud_id = c.cloud_id join vec_points_v t on t.cloud_id = c.other where {_D2} <= 0.3 * 0.3 qualify row_number() over (partition by pair_id, source_id order by {_D2}, t.point_id) = 1) select pair_id, "
    + ", ".join(f"cast(sum({_m(c)}) as bigint) / 1e6 as i_{i}" for i, c in (("00", "z * z + y * y"), ("01", "-x * y"), ("02", "-x * z"), ("03", "0"), ("04", "-z"), ("05", "y"), ("11", "z * z + x * x"), ("12", "-y * z"), ("13", "z"), ("15", "-x"), ("22", "y * y + x * x"), ("23", "-y"), ("24", "x"), ("33", "1")))
    + ", count(*) as n_corr from n group by pair_id"
)
def info_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    source, target = _cloud_pairs(view(spark, sf_dir, "vec_points_v"))
    pairs = neighbours.correspondences(source, target, 0.3)
    m = neighbours.information_matrix(pairs)
    n = pairs.groupBy("pair_id").agg(F.count("*").alias("n_corr"))
    return m.join(n, "pair_id").select("pair_id", *(f"i_{i}" for i in ("00", "01", "02", "03", "04", "05", "11", "12", "13", "15", "22", "23", "24", "33")), "n_corr")


@query(
    f"{duck('features_v')}, c as (select label, lead(label) over (order by label) as other from (select distinct label from features_v)), e as (select a.label as source, a.vec_id as a, b.vec_id as b, list_sum(list_transform(range(1, 34), lambda i: power({_m('a.f[i]')} - {_m('b.f[i]')}, 2))) as d2 from c join features_v a on a.label = c.label join features_v b on b.label = c.other), "
    "x as (select source, a, arg_min(b, (d2, b)) as b, min(d2) as d2 from e group by source, a), y as (select source, b, arg_min(a, (d2, a)) as a from e group by source, b) select x.source, x.a, x.b, cast(x.d2 as bigint) as d2 from x join y on x.source = y.source and x.a = y.a and x.b = y.b"
)
def feature_mutual_nn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mutual matches of every cloud with the next."""
    f = view(spark, sf_dir, "features_v").withColumnRenamed("label", "cloud_id")
    clouds_ = f.select("cloud_id").distinct()
    pairs = clouds_.select(F.col("cloud_id").alias("source"), F.lead("cloud_id").over(Window.orderBy("cloud_id")).alias("target")).where("target is not null")
    return neighbours.mutual_matches(f, pairs).select("source", "a", "b", "d2")


@query()
def normals_pca(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.normals(view(spark, sf_dir, "vec_points_v"), 0.2, 10)


# carving

_RAYS = f"{_P}, r as (select scan_id // 10 as submap_id, scan_id * 100000 + point_id as ray_id, x, y, z, {_R} as len from points_v where {_R} > 0), st as (select *, unnest(range(0, cast(ceil(greatest(1.5, least(len - 0.1, 20.0)) / 1.5) as bigint))) as k from r), v as (select distinct submap_id, ray_id, x / len as dx, y / len as dy, z / len as dz, cast(floor((x / len) * (k * 1.5) / 1.5) as integer) as vx, cast(floor((y / len) * (k * 1.5) / 1.5) as integer) as vy, cast(floor((z / len) * (k * 1.5) / 1.5) as integer) as vz from st)"


def _scene(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Rays from the origin to all points of each scan, and all points of its submap as a map with outward normals."""
    p = view(spark, sf_dir, "points_v").withColumns({"submap_id": F.floor(F.col("scan_id") / 10).cast("long"), "ray_id": F.col("scan_id") * 100000 + F.col("point_id")})
    zero = F.lit(0.0)
    rays = p.select("submap_id", "ray_id", "x", "y", "z", zero.alias("sx"), zero.alias("sy"), zero.alias("sz"))
    r = F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y") + F.col("z") * F.col("z"))
    rest = p.where(r > 0).select("submap_id", F.col("ray_id").alias("point_id"), "x", "y", "z", *((F.col(c) / r).alias(f"n{c}") for c in "xyz"))
    return rays, rest


@query(
    f"{_RAYS}, m as (select scan_id // 10 as submap_id, scan_id * 100000 + point_id as point_id, x / {_R} as nx, y / {_R} as ny, z / {_R} as nz, {_v('x', 1.5)} as vx, {_v('y', 1.5)} as vy, {_v('z', 1.5)} as vz from points_v where {_R} > 0) select distinct submap_id, point_id from m join v using (submap_id, vx, vy, vz) where abs(dx * nx + dy * ny + dz * nz) > 0.9"
)
def ray_carve_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    rays, rest = _scene(spark, sf_dir)
    return carving.carved_points(rays, rest, 1.5, 20.0, 0.1, 0.9)


@query(
    f"{_P}, r as (select scan_id // 10 as submap_id, x, y, z, {_R} as len from points_v where {_R} > 0), st as (select *, unnest(range(0, cast(ceil(greatest(2.0, least(len - 0.1, 20.0)) / 2.0) as bigint))) as k from r), "
    f"p as (select submap_id, (x / len) * (k * 2.0) as px, (y / len) * (k * 2.0) as py, (z / len) * (k * 2.0) as pz from st), "
    f"o as (select distinct scan_id // 10 as submap_id, {_v('x', 0.8)} as vx, {_v('y', 0.8)} as vy, {_v('z', 0.8)} as vz from points_v where {_R} > 0), s as (select cast(unnest(range(-1, 2)) as integer) as k), "
    f"c as (select o.*, {_v('(vx * 0.8 + 0.4)', 1.0)} + i.k as hx, {_v('(vy * 0.8 + 0.4)', 1.0)} + j.k as hy, {_v('(vz * 0.8 + 0.4)', 1.0)} + k.k as hz from o, s i, s j, s k) "
    f"select distinct c.submap_id, vx, vy, vz from c join (select *, {_v('px', 1.0)} as hx, {_v('py', 1.0)} as hy, {_v('pz', 1.0)} as hz from p) q using (submap_id, hx, hy, hz) "
    f"where power(vx * 0.8 + 0.4 - px, 2) + power(vy * 0.8 + 0.4 - py, 2) + power(vz * 0.8 + 0.4 - pz, 2) <= 1.0 or (vx = {_v('px', 0.8)} and vy = {_v('py', 0.8)} and vz = {_v('pz', 0.8)})"
)
def ray_carve_voxels(spark: SparkSession, sf_dir: str) -> DataFrame:
    rays, rest = _scene(spark, sf_dir)
    occupied = voxel.with_voxel(rest, 0.8).select("submap_id", "vx", "vy", "vz").distinct()
    return carving.carved_voxels(rays, occupied, 0.8, 20.0, 0.1, 1.0)


# submaps

_S = duck("submaps_v")


@query(f"{duck('submaps_v', 'poses_v')}, d as (select event_id as pose_id, submap_id, (tx - cx) * (tx - cx) + (ty - cy) * (ty - cy) + (tz - cz) * (tz - cz) as d2 from poses_v, submaps_v) select pose_id, arg_min(submap_id, (d2, submap_id)) as submap_id, min(d2) as d2 from d group by pose_id")
def nearest_submap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.nearest_submap(view(spark, sf_dir, "poses_v").withColumnRenamed("event_id", "pose_id"), view(spark, sf_dir, "submaps_v"))


def _tree(s: DataFrame) -> DataFrame:
    return s.select(F.col("submap_id").alias("src"), F.col("parent_id").alias("dst"))


@query(f"{_S} select a.submap_id as a, b.submap_id as b, (a.cx - b.cx) * (a.cx - b.cx) + (a.cy - b.cy) * (a.cy - b.cy) + (a.cz - b.cz) * (a.cz - b.cz) as d2 from submaps_v a join submaps_v b on b.submap_id - a.submap_id > 2 where (a.cx - b.cx) * (a.cx - b.cx) + (a.cy - b.cy) * (a.cy - b.cy) + (a.cz - b.cz) * (a.cz - b.cz) <= 20.0 * 20.0 and b.parent_id <> a.submap_id and a.parent_id <> b.submap_id")
def loop_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = view(spark, sf_dir, "submaps_v")
    return graph.loop_candidates(s, _tree(s), 20.0, 10.0).select("a", "b", "d2")


@query(f"{_S}, f as (select submap_id as source_id, submap_id // 3 as target_id, cx from submaps_v union all select submap_id - submap_id % 2, submap_id // 3, cx - 1 from submaps_v), o as (select submap_id as source_id, parent_id as target_id from submaps_v) select source_id, target_id, min(cx) as cx from f anti join o using (source_id, target_id) group by source_id, target_id")
def constraint_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = view(spark, sf_dir, "submaps_v")
    third = F.floor(F.col("submap_id") / 3).cast("long").alias("target_id")
    fresh = s.select(F.col("submap_id").alias("source_id"), third, "cx").union(s.select(F.col("submap_id") - F.col("submap_id") % 2, third, F.col("cx") - 1))
    return graph.new_constraints(s.select(F.col("submap_id").alias("source_id"), F.col("parent_id").alias("target_id")), fresh, "cx")


@query(f"{_S}, e as (select submap_id as s, parent_id as d from submaps_v where submap_id <> parent_id), u as (select s, d from e union select d, s from e) select s as src, array_to_string(list_sort(list(distinct d)), ',') as neighbours from u group by s")
def adjacency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.adjacency_lists(_tree(view(spark, sf_dir, "submaps_v"))).select("src", F.array_join(F.transform("neighbours", lambda x: x.cast("string")), ",").alias("neighbours"))


@query(
    f"with recursive {_S[5:]}, e as (select submap_id as s, parent_id as d from submaps_v where submap_id <> parent_id), u as (select s, d from e union select d, s from e), b as (select submap_id as id, 0 as hops from submaps_v where submap_id % 10 = 0 union select u.d, hops + 1 from b join u on u.s = b.id where hops < 12), m as (select id, min(hops) as h from b group by id) select submap_id as id, case when h is not null then greatest(h - 1, 0) end as distance from submaps_v left join m on id = submap_id"
)
def bfs_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = view(spark, sf_dir, "submaps_v")
    return graph.loop_distance(s.select(F.col("submap_id").alias("id"), (F.col("submap_id") % 10 == 0).alias("is_lc")), _tree(s))


@query(
    f"with recursive {_S[5:]}, c as (select submap_id, submap_id as v, 0 as depth from submaps_v union all select c.submap_id, s.parent_id, depth + 1 from c join submaps_v s on s.submap_id = c.v where c.v % 3 <> 0 and s.parent_id <> c.v) select submap_id, v as ancestor, depth from c where v % 3 = 0"
)
def parent_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = view(spark, sf_dir, "submaps_v")
    return graph.resolved_ancestor(s, s.where("submap_id % 3 = 0"))


_COLORS = ", ".join(f"{{'r': {r}e0, 'g': {gr}e0, 'b': {b}e0}}" for r, gr, b in g.PALETTE)


@query(f"{_S}, p as (select submap_id, [{_COLORS}][submap_id % 11 + 3] as c, cx, cy, cz from submaps_v) select submap_id, c.r as r, c.g as g, c.b as b, printf('(%d)', submap_id) as label, cx, cy, cz from p")
def submap_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = view(spark, sf_dir, "submaps_v").withColumn("c", g.palette_color("submap_id"))
    return s.select("submap_id", "c.r", "c.g", "c.b", F.format_string("(%d)", "submap_id").alias("label"), "cx", "cy", "cz")


# registration and maps; results of iterations, tested against known motions


def _motion_pairs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Each scan's points, made unit-sized, and the same moved by a known pose that depends on the scan."""
    p = view(spark, sf_dir, "points_v").select(F.col("scan_id").alias("pair_id"), "point_id", (F.col("x") / 10).alias("x"), (F.col("y") / 10).alias("y"), (F.col("z") / 10).alias("z"))
    k = F.col("pair_id") % 5
    known = g.planar_pose(k * 0.01 - 0.02, F.lit(0.015), F.lit(-0.01), k * 0.004)
    target = p.withColumns(dict(zip("xyz", g.pose_apply(known, "x", "y", "z"), strict=True)))
    return p, target


@query()
def icp_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    source, target = _motion_pairs(spark, sf_dir)
    got = registration.register(source, target, "PointToPoint", 0.3, rounds=8)
    return got.select("pair_id", "n_source", "n_corr", "fitness", "inlier_rmse", "pose.tx", "pose.ty", "pose.tz", "pose.qz", "pose.qw")


_SEEN = "cast(round({0} * 1000) as bigint)"


def _session_scans(spark: SparkSession, sf_dir: str, n: int) -> DataFrame:
    """Each scan's points as a world of their own, seen from ``n`` poses on a path that depends on the scan."""
    k = F.col("t_ticks") - 1
    true = g.planar_pose(k * 0.2, k * (F.col("session_id") % 3) * 0.1, F.lit(0.0), k * 0.004)
    p = view(spark, sf_dir, "points_v").withColumn("t_ticks", F.explode(F.sequence(F.lit(1), F.lit(n)))).withColumn("session_id", F.col("scan_id").cast("long"))
    # a column for each number of the poses: nested expressions would grow into plans that take longer than the rows
    here = {c: F.col(f"__{c}") for c in g.POSE}
    back = {c: -here[c] for c in ("qx", "qy", "qz")} | {"qw": here["qw"]}
    undone = dict(zip(("tx", "ty", "tz"), g.rotate(back, [-here[c] for c in ("tx", "ty", "tz")]), strict=True)) | back
    for at in (true, undone):
        p = p.withColumns({f"__{c}": at[c] for c in g.POSE})
    seen = p.withColumns(dict(zip("xyz", g.pose_apply(here, "x", "y", "z"), strict=True)))
    return seen.select("session_id", F.col("t_ticks").cast("long").alias("t_ticks"), "point_id", "x", "y", "z")


def _true_path(n: int, first: int) -> str:
    path = f"p as (select distinct cast(l_suppkey as bigint) as session_id, t - 1 as k from lineitem, unnest(range({first}, {n + 1})) as r(t))"
    return f"with {path} select session_id, k + 1 as t_ticks, k * 200 as tx, k * (session_id % 3) * 100 as ty, {_SEEN.format('sin(k * 0.002)')} as qz from p"


def _thousandths(pose: str) -> list[Column]:
    return [F.round(F.col(f"{pose}.{c}") * 1000).cast("long").alias(c) for c in ("tx", "ty", "qz")]


@query(_true_path(3, 2))
def odometry_poses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scan-to-scan odometry of every session; SQL has the path on which the scans were taken, in thousandths."""
    _, path = registration.odometry(_session_scans(spark, sf_dir, 3), "PointToPoint", 0.6)
    return path.select("session_id", "t_ticks", *_thousandths("product"))


@query(_true_path(3, 1))
def mapped_poses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scans registered to each session's growing tiled map, one after the other; SQL has the true path, in thousandths."""
    mapper = SessionMapper(spark, f"{shared_folder(spark)}/sessions-{uuid.uuid4().hex}", Mapping(radius=0.6, reach=60.0, voxel=0.05, tile=20.0))
    mapper(_session_scans(spark, sf_dir, 3), 0)
    return mapper.poses().where("status <> 'rejected'").select("session_id", "t_ticks", *_thousandths("pose"))


@query()
def fpfh(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = view(spark, sf_dir, "vec_points_v")
    n = neighbours.normals(p, 0.3, 12).where("not isnan(nx)").select("cloud_id", "point_id", "nx", "ny", "nz")
    return features.fpfh(p.join(n, ["cloud_id", "point_id"]), 0.4, 20)


@query()
def ransac_global(spark: SparkSession, sf_dir: str) -> DataFrame:
    source, target = _motion_pairs(spark, sf_dir)
    t = target.select("pair_id", "point_id", F.col("x").alias("tx"), F.col("y").alias("ty"), F.col("z").alias("tz"))
    m = source.join(t, ["pair_id", "point_id"]).select("pair_id", F.col("x").alias("sx"), F.col("y").alias("sy"), F.col("z").alias("sz"), "tx", "ty", "tz")
    return features.ransac(m, 0.01).select("pair_id", "n_inliers", "n_matches", "pose.tx", "pose.ty", "pose.tz", "pose.qz")


@query()
def pose_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Submaps on their parent tree as one pose graph per nation, with measured edges between neighbours."""
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet").select((F.col("s_nationkey") % 5).cast("long").alias("graph_id"), F.col("s_suppkey").cast("long").alias("node_id"), (F.col("s_acctbal") / 1000).alias("d"))
    rank = F.row_number().over(Window.partitionBy("graph_id").orderBy("node_id")).cast("long") - 1
    s = s.withColumn("node_id", rank)
    nodes = s.select("graph_id", "node_id", g.planar_pose(F.col("node_id") + F.col("d") * 0.01, 0.0, 0.0, 0.0).alias("pose"))
    step = s.where("node_id > 0").select("graph_id", F.col("node_id").alias("source_id"), (F.col("node_id") - 1).alias("target_id"), g.planar_pose(1.0, 0.0, 0.0, 0.0).alias("pose"), F.lit(1.0).alias("weight"), F.lit(False).alias("uncertain"))
    loop = s.where("node_id >= 5").select("graph_id", F.col("node_id").alias("source_id"), (F.col("node_id") - 5).alias("target_id"), g.planar_pose(5.0, 0.0, 0.0, 0.0).alias("pose"), F.lit(2.0).alias("weight"), F.lit(True).alias("uncertain"))
    return posegraph.solve(nodes, step.union(loop)).select("graph_id", "node_id", *_solved())


_T = "cast(round(({}) * 10000) as bigint)"
_STEPS = "s as (select session_id, row_number() over (partition by session_id order by t_ticks) - 1 as r, dx, dy, dyaw from poses_v), h as (select session_id, r, dx, dy, coalesce(sum(dyaw) over (partition by session_id order by r rows between unbounded preceding and 1 preceding), 0) as h from s where r > 0)"


@query(
    f"{_Q}, {_STEPS} select session_id as graph_id, 0 as node_id, 0 as x, 0 as y from s where r = 0 union all select session_id, r, {_T.format('sum(cos(h) * dx - sin(h) * dy) over w')}, {_T.format('sum(sin(h) * dx + cos(h) * dy) over w')} from h window w as (partition by session_id order by r)"
)
def graph_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of each session's pose graph, chained along its odometry constraints from smaller to larger ids; graphs of one pose have none."""
    p = view(spark, sf_dir, "poses_v").withColumn("r", F.row_number().over(Window.partitionBy("session_id").orderBy("t_ticks")).cast("long") - 1)
    motion = g.planar_pose("dx", "dy", F.lit(0.0), "dyaw")
    constraints = p.where("r > 0").select(F.col("session_id").alias("graph_id"), (F.col("r") - 1).alias("source_id"), F.col("r").alias("target_id"), g.pose_inv(motion).alias("pose"))
    nodes, _ = posegraph.build(constraints, constraints.limit(0))
    alone = p.groupBy("session_id").agg(F.max("r").alias("last")).where("last = 0").select(F.col("session_id").alias("graph_id"), F.lit(0).cast("long").alias("node_id"), g.pose(0.0, 0.0, 0.0).alias("pose"))
    return nodes.unionByName(alone).select("graph_id", "node_id", *(F.round(F.col(f"pose.t{c}") * 10000).cast("long").alias(c) for c in "xy"))


@query(
    f"{_S}, k as (select a.submap_id as source_id, b.submap_id as target_id from submaps_v a join submaps_v b on a.submap_id > b.submap_id + 1 and abs(a.cx - b.cx) < 2 and abs(a.cy - b.cy) < 2), "
    "e as (select submap_id as a, parent_id as b from submaps_v union select source_id, target_id from k), "
    "l as (select a as id, b as other from e where a <> b union select b, a from e where a <> b) "
    "select s.submap_id as id, count(distinct other) as degree, s.submap_id in (select source_id from k union select target_id from k) as is_lc from submaps_v s left join l on l.id = s.submap_id group by s.submap_id"
)
def closure_adjacency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Submaps after closures between close ones were recorded: neighbours and marks."""
    s = view(spark, sf_dir, "submaps_v")
    cell = [F.floor(F.col(c) / 2).alias(f"k{c}") for c in ("cx", "cy")]
    around = lambda c: F.explode(F.sequence(F.floor(F.col(c) / 2) - 1, F.floor(F.col(c) / 2) + 1))
    a = s.select(F.col("submap_id").alias("source_id"), F.col("cx").alias("ax"), F.col("cy").alias("ay")).withColumn("kcx", around("ax")).withColumn("kcy", around("ay"))
    b = s.select(F.col("submap_id").alias("target_id"), "cx", "cy", *cell)
    close = (F.abs(F.col("ax") - F.col("cx")) < 2) & (F.abs(F.col("ay") - F.col("cy")) < 2) & (F.col("source_id") > F.col("target_id") + 1)
    accepted = a.join(b, ["kcx", "kcy"]).where(close).select("source_id", "target_id")
    nodes, edges = closing.record_closures(s.select(F.col("submap_id").alias("id"), F.lit(False).alias("is_lc")), s.select(F.col("submap_id").alias("src"), F.col("parent_id").alias("dst")), accepted)
    degrees = graph.undirected(edges).groupBy("src").agg(F.count("*").alias("degree"))
    return nodes.join(degrees, nodes.id == degrees.src, "left").select("id", F.coalesce("degree", F.lit(0)).alias("degree"), "is_lc")


def _solved() -> list:
    return [F.round(F.col(f"pose.{c}"), 4).alias(c) for c in ("tx", "ty", "tz")]


@query()
def submap_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = view(spark, sf_dir, "poses_v").select("session_id", "t_ticks", "event_id", "tx", "ty", "tz", F.col("tx").alias("cx"), F.col("ty").alias("cy"), F.col("tz").alias("cz"), F.lit(1).alias("n"))
    return mapping.segment_submaps(p, radius=6.0, least_scans=5)


@query(
    f"{_P} select scan_id, count(*) as n, sum(cast(floor(255 * r) as bigint)) as red, sum(cast(floor(255 * b) as bigint)) as blue, min(cast(cast(x as float) as double)) as low, max(cast(cast(y as float) as double)) as high from points_v group by scan_id"
)
def message_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scans packed into cloud messages and unpacked again."""
    p = view(spark, sf_dir, "points_v").select(F.col("scan_id").cast("string").alias("topic"), F.col("scan_id").alias("stamp_ticks"), "point_id", "x", "y", "z", "r", "g", "b")
    back = clouds.points_of_messages(clouds.messages_of_points(p, "map"))
    return back.groupBy(F.col("stamp_ticks").alias("scan_id")).agg(F.count("*").alias("n"), F.sum(F.round(F.col("r") * 255).cast("long")).alias("red"), F.sum(F.round(F.col("b") * 255).cast("long")).alias("blue"), F.min("x").alias("low"), F.max("y").alias("high"))


# constraints, gates and reports


@query(f"{_S}, c as (select submap_id as source_id, parent_id as target_id, cx from submaps_v) select row_number() over (order by source_id, target_id) as place, source_id, target_id from c")
def sorted_constraints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Constraints numbered by source, then target, without one task for all rows."""
    c = view(spark, sf_dir, "submaps_v").select(F.col("submap_id").alias("source_id"), F.col("parent_id").alias("target_id"))
    return ordering.placed(c, [], ["source_id", "target_id"]).select((F.col("place") + 1).alias("place"), "source_id", "target_id")


@query(f"{_S}, u as (select submap_id from submaps_v except select parent_id from submaps_v) select submap_id, row_number() over (order by submap_id) - 1 as place from u")
def sorted_unoptimised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Submaps that nothing hangs on, in the order of their ids."""
    s = view(spark, sf_dir, "submaps_v")
    return ordering.placed(s.select("submap_id").exceptAll(s.select("parent_id").distinct()).distinct(), [], ["submap_id"])


_CLOSURES = "c as (select session_id, event_id as source_id, lag(event_id) over (partition by session_id order by t_ticks) as target_id, t_ticks from poses_v)"


@query(f"{_Q}, {_CLOSURES} select session_id, max(t_ticks) as t_ticks, arg_max(source_id, t_ticks) as source_id, arg_max(target_id, t_ticks) as target_id from c where target_id is not null group by session_id")
def latest_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest constraint of each session, each pose tied to the one before it."""
    tied = trajectory.consecutive(view(spark, sf_dir, "poses_v"), item="event_id")
    newest = F.max_by(F.struct("t_ticks", F.col("event_id").alias("source_id"), F.col("previous").alias("target_id")), "t_ticks")
    return tied.groupBy("session_id").agg(newest.alias("c")).select("session_id", "c.*")


@query(
    f"{_Q}, o as (select session_id, tx, ty, yaw, row_number() over (partition by session_id order by t_ticks desc) - 1 as b, case when event_id % 2 = 0 then 0.3 else 0.1 end as cx, case when event_id % 2 = 0 then 0.02 else 0.01 end as cr from poses_v), "
    "m as (select *, cx + cos(cr) * tx - sin(cr) * ty as mx, sin(cr) * tx + cos(cr) * ty as my, cr + yaw as mr from o), "
    "p as (select f.session_id, f.mx as fx, f.my as fy, f.mr as fr, n.mx as nx, n.my as ny, cos(f.yaw) * (n.tx - f.tx) + sin(f.yaw) * (n.ty - f.ty) as rx, cos(f.yaw) * (n.ty - f.ty) - sin(f.yaw) * (n.tx - f.tx) as ry from m f join m n on f.session_id = n.session_id and f.b = 60 and n.b = 20), "
    "e as (select *, fx + cos(fr) * rx - sin(fr) * ry as ex, fy + sin(fr) * rx + cos(fr) * ry as ey from p) "
    f"select session_id, {_T.format('nx')} as x, {_T.format('ny')} as y, {_T.format('ex')} as ex, {_T.format('ey')} as ey, {_T.format('sqrt((ex - nx) * (ex - nx) + (ey - ny) * (ey - ny))')} as distance from e"
)
def chain_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Odometry against map between 60 and 20 poses back; the map's poses are corrected in one of two ways."""
    p = view(spark, sf_dir, "poses_v")
    even = F.col("event_id") % 2 == 0
    odometry = p.select("session_id", "t_ticks", g.planar_pose("tx", "ty", "tz", "yaw").alias("pose"))
    corrected = g.pose_mul(g.planar_pose(F.when(even, 0.3).otherwise(0.1), F.lit(0.0), F.lit(0.0), F.when(even, 0.02).otherwise(0.01)), g.planar_pose("tx", "ty", "tz", "yaw"))
    d = trajectory.chain_difference(odometry, p.select("session_id", "t_ticks", corrected.alias("pose")))
    tenth = lambda c, n: F.round(F.col(c) * 10000).cast("long").alias(n)
    return d.select("session_id", tenth("reached.tx", "x"), tenth("reached.ty", "y"), tenth("estimated.tx", "ex"), tenth("estimated.ty", "ey"), tenth("distance", "distance"))


_RPY = "select scan_id, point_id, x, y, z, cos(x / 30) as cr, sin(x / 30) as sr, cos(y / 40) as cp, sin(y / 40) as sp, cos(z / 5) as cy, sin(z / 5) as sy from points_v"


@query(
    f"{_P}, a as ({_RPY}) select scan_id, point_id, {_T.format('cy * cp * y + (cy * sp * sr - sy * cr) * z + (cy * sp * cr + sy * sr) * x + x')} as tx, "
    f"{_T.format('sy * cp * y + (sy * sp * sr + cy * cr) * z + (sy * sp * cr - cy * sr) * x + y')} as ty, {_T.format('cp * sr * z - sp * y + cp * cr * x + z')} as tz from a"
)
def turned_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points (y, z, x) moved by poses that turn about all three axes; SQL has the matrix of roll, pitch and yaw."""
    pose = g.pose_rpy("x", "y", "z", F.col("x") / 30, F.col("y") / 40, F.col("z") / 5)
    p = view(spark, sf_dir, "points_v").withColumn("pose", pose)
    new = g.pose_apply(F.col("pose"), "y", "z", "x")
    return p.select("scan_id", "point_id", *(F.round(c * 10000).cast("long").alias(n) for n, c in zip(("tx", "ty", "tz"), new, strict=True)))


@query(f"{_Q} select session_id, max(t_ticks) as t_ticks, arg_max(event_id, t_ticks) as event_id from poses_v group by session_id")
def latest_constraint(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = view(spark, sf_dir, "poses_v")
    return p.groupBy("session_id").agg(F.max("t_ticks").alias("t_ticks"), F.max_by("event_id", "t_ticks").alias("event_id"))


@query(f"{_S} select submap_id from submaps_v except select parent_id from submaps_v")
def unoptimised_submaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = view(spark, sf_dir, "submaps_v")
    return s.select("submap_id").exceptAll(s.select("parent_id").distinct()).distinct()


@query("select event_type, count(*) as n, cast(sum(cast(floor(value * 1e6 + 0.5) as bigint)) as bigint) / 1e6 / count(*) as mean_ms, 1000 / (cast(sum(cast(floor(value * 1e6 + 0.5) as bigint)) as bigint) / 1e6 / count(*)) as hz from events group by event_type")
def stage_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean duration and rate of each stage of a run, events standing for a table of measurements."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.groupBy("event_type").agg(F.count("*").alias("n"), g.exact_mean("value").alias("mean_ms")).withColumn("hz", 1000 / F.col("mean_ms"))


@query(f"{_S}, e as (select submap_id as a, parent_id as b from submaps_v where submap_id <> parent_id), u as (select a, b from e union select b, a from e), p as (select submap_id as a, submap_id // 2 as b from submaps_v union all select submap_id, submap_id // 3 from submaps_v) select p.a, p.b, p.a = p.b or u.a is not null as adjacent from p left join u on p.a = u.a and p.b = u.b")
def adjacency_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = view(spark, sf_dir, "submaps_v")
    pairs = s.select(F.col("submap_id").alias("a"), F.floor(F.col("submap_id") / 2).cast("long").alias("b")).union(s.select("submap_id", F.floor(F.col("submap_id") / 3).cast("long")))
    return graph.is_adjacent(pairs, _tree(s))


@query(f"{_P} select scan_id, bool_and(r is not null) as ready from points_v group by scan_id")
def scans_ready(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = view(spark, sf_dir, "points_v").withColumn("nx", F.col("r"))
    return crop.scans_ready(p, "PointToPlane")


@query(f"{_Q} select event_id, case when t_ticks % 3 = 0 then 'accepted' when tx >= 5 then 'accepted' else 'rejected' end as status from poses_v")
def quality_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = view(spark, sf_dir, "poses_v")
    return p.select("event_id", F.when(F.col("t_ticks") % 3 == 0, crop.quality_status("tx", 5.0, ignore=True)).otherwise(crop.quality_status("tx", 5.0)).alias("status"))


_MID = 638396640071795750


@query(f"{_Q}, m as (select event_id, case when t_ticks between {_MID} and {_MID + 10**13} then tx + cos(yaw) * 2 - sin(yaw) * 1 else tx end as px, case when t_ticks between {_MID} and {_MID + 10**13} then ty + sin(yaw) * 2 + cos(yaw) * 1 else ty end as py from poses_v) select event_id, {_sql4('px', 'py')} from m")
def moved_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = view(spark, sf_dir, "poses_v").withColumn("pose", g.planar_pose("tx", "ty", "tz", "yaw"))
    got = crop.move_in_interval(p, g.pose(2.0, 1.0, 0.0), _MID, _MID + 10**13)
    return got.select("event_id", F.col("pose.tx").alias("px"), F.col("pose.ty").alias("py")).select("event_id", *_e4("px", "py"))


@query(f"{_Q}, m as (select event_id, tx - (cos(yaw - yaw / 2) * dx - sin(yaw - yaw / 2) * dy) as px, ty - (sin(yaw - yaw / 2) * dx + cos(yaw - yaw / 2) * dy) as py from poses_v) select event_id, {_sql4('px', 'py')} from m")
def map_to_odometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Correction from an odometry pose (dx, dy, half the heading) to the map pose."""
    p = view(spark, sf_dir, "poses_v")
    c = graph.map_to_odometry(g.planar_pose("tx", "ty", "tz", "yaw"), g.planar_pose("dx", "dy", 0.0, F.col("yaw") / 2))
    return p.select("event_id", c.alias("c")).select("event_id", F.col("c.tx").alias("px"), F.col("c.ty").alias("py")).select("event_id", *_e4("px", "py"))


@query(
    f"{_P}, k as (select scan_id // 10 as submap_id, {_KEY4}, x from points_v), d as (select submap_id, vx, vy, vz, count(*) as n, {_mean('x', 'x')} from k group by all) select d.*, [{_COLORS}][submap_id % 11 + 3].r as r from d"
)
def colored_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Down-sampled map, coloured by submap."""
    p = view(spark, sf_dir, "points_v").withColumn("submap_id", F.floor(F.col("scan_id") / 10).cast("long"))
    return voxel.downsample(p, 4.0, by=("submap_id",)).select("submap_id", "vx", "vy", "vz", "n", "x", g.palette_color("submap_id")["r"].alias("r"))


@query(
    f"{_Q}, w as (select event_id, row_number() over o as rn, tx - lag(tx, 20) over o as mx, ty - lag(ty, 20) over o as my from poses_v window o as (partition by session_id order by t_ticks)) select event_id, {_m('sqrt(mx * mx + my * my)')} as moved, abs(mx) < 1.0 as still from w where rn > 20"
)
def chain_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far each pose lies from the one twenty rows before."""
    w = Window.partitionBy("session_id").orderBy("t_ticks")
    p = view(spark, sf_dir, "poses_v").withColumns({"mx": F.col("tx") - F.lag("tx", 20).over(w), "my": F.col("ty") - F.lag("ty", 20).over(w)}).where("mx is not null")
    return p.select("event_id", g.micro(F.sqrt(F.col("mx") * F.col("mx") + F.col("my") * F.col("my"))).alias("moved"), g.is_close("mx", 0.0, 1.0).alias("still"))


@query(
    f"{_P}, d as (select scan_id, {_KEY2}, count(*) as n, {_MEANS} from points_v where {_R} between 2 and 30 group by all), m as (select *, (cast(vx as bigint) * 73856093 + cast(vy as bigint) * 19349663 + cast(vz as bigint) * 83492791 + scan_id * 7919) % 1000003 as h from d) select scan_id, vx, vy, vz, n, x, y, z from m where ((h + 1000003) % 1000003) * 7919 % 1000 < 300"
)
def preprocess_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scans.preprocess(view(spark, sf_dir, "points_v"), Cropping("MinMaxRadius", min_radius=2.0, max_radius=30.0), 2.0, 0.3)


@query(
    f"{_P}, f as (select scan_id, {_R} <= 20 as is_merge, {_R} between 2 and 8 as is_match from points_v) select scan_id, count(*) filter (is_match) as n_match, count(*) filter (is_merge) as n_merge from f group by scan_id"
)
def merge_match_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = view(spark, sf_dir, "points_v")
    flagged = scans.merge_and_match(p, Cropping(max_radius=20.0), Cropping("MinMaxRadius", min_radius=2.0, max_radius=8.0))
    return flagged.groupBy("scan_id").agg(F.count_if("is_match").alias("n_match"), F.count_if("is_merge").alias("n_merge"))


@query(f"{_P}, c as (select count(*) filter (not ({_R} <= 15)) as far, count(*) filter (not (r <= 0.5)) as red from points_v) select 'far' as rule, far as broken from c union all select 'red', red from c")
def validation_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scans.validate(view(spark, sf_dir, "points_v"), {"far": crop.crop_predicate("MaxRadius", radius=15.0), "red": F.col("r") <= 0.5})


@query(f"{_Q} select event_id, t_ticks as stamp, 'map' as frame_id, tx as x, ty as y from poses_v")
def published_poses(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = scans.pose_record("t_ticks", "map", "range_sensor", g.planar_pose("tx", "ty", "tz", "yaw"))
    return view(spark, sf_dir, "poses_v").select("event_id", r.alias("r")).select("event_id", "r.stamp", "r.frame_id", "r.translation.x", "r.translation.y")
