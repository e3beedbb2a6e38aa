"""Column functions on poses, points, colours and times.

A pose is a struct (tx, ty, tz, qx, qy, qz, qw); a rotation is applied by its quaternion.
Everything here is plain column arithmetic and stays inside generated code.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

POSE = ("tx", "ty", "tz", "qx", "qy", "qz", "qw")
TICKS_PER_SECOND = 10_000_000
#: Ticks of 100 ns from 0001-01-01 to 1970-01-01.
UNIX_TICKS = 621_355_968_000_000_000
#: White, black, gray, red, green, blue, yellow, orange, purple, chartreuse, teal, pink, magenta.
PALETTE = (
    (1.0, 1.0, 1.0), (0.0, 0.0, 0.0), (0.5, 0.5, 0.5), (1.0, 0.0, 0.0), (0.0, 1.0, 0.0), (0.0, 0.0, 1.0), (1.0, 1.0, 0.0),
    (1.0, 0.5, 0.0), (0.5, 0.0, 1.0), (0.5, 1.0, 0.0), (0.0, 1.0, 1.0), (1.0, 0.0, 0.5), (0.78, 0.0, 0.9),
)


def _c(x: Column | str | float) -> Column:
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(float(x))


def pose(tx, ty, tz, qx=0.0, qy=0.0, qz=0.0, qw=1.0) -> Column:
    return F.struct(*(_c(v).cast("double").alias(n) for n, v in zip(POSE, (tx, ty, tz, qx, qy, qz, qw), strict=True)))


def pose_rpy(tx, ty, tz, roll, pitch, yaw) -> Column:
    """Pose from a translation and roll, pitch and yaw in radians."""
    return pose(tx, ty, tz, *rpy_to_quat(roll, pitch, yaw))


def planar_pose(tx, ty, tz, yaw) -> Column:
    half = _c(yaw) / 2
    return pose(tx, ty, tz, 0.0, 0.0, F.sin(half), F.cos(half))


def pose_from_matrix(m: Column) -> Column:
    """Pose from a row-major ARRAY<DOUBLE>(16); the quaternion's w is not negative."""
    e = [F.element_at(m, i + 1) for i in range(16)]
    w = F.sqrt(F.greatest(F.lit(0.0), 1 + e[0] + e[5] + e[10])) / 2
    x = F.sqrt(F.greatest(F.lit(0.0), 1 + e[0] - e[5] - e[10])) / 2
    y = F.sqrt(F.greatest(F.lit(0.0), 1 - e[0] + e[5] - e[10])) / 2
    z = F.sqrt(F.greatest(F.lit(0.0), 1 - e[0] - e[5] + e[10])) / 2
    # the greatest of the four is divided by, so that none is lost near a half turn
    big = F.greatest(w, x, y, z)
    quad = (
        F.when(w == big, F.array((e[9] - e[6]) / (4 * w), (e[2] - e[8]) / (4 * w), (e[4] - e[1]) / (4 * w), w))
        .when(x == big, F.array(x, (e[1] + e[4]) / (4 * x), (e[2] + e[8]) / (4 * x), (e[9] - e[6]) / (4 * x)))
        .when(y == big, F.array((e[1] + e[4]) / (4 * y), y, (e[6] + e[9]) / (4 * y), (e[2] - e[8]) / (4 * y)))
        .otherwise(F.array((e[2] + e[8]) / (4 * z), (e[6] + e[9]) / (4 * z), z, (e[4] - e[1]) / (4 * z)))
    )
    return pose(e[3], e[7], e[11], *(F.element_at(quad, i + 1) for i in range(4)))


def rotation(q: Sequence[Column]) -> list[list[Column]]:
    """The 3x3 rotation matrix of a unit quaternion (x, y, z, w)."""
    x, y, z, w = q
    return [
        [1 - 2 * (y * y + z * z), 2 * (x * y - z * w), 2 * (x * z + y * w)],
        [2 * (x * y + z * w), 1 - 2 * (x * x + z * z), 2 * (y * z - x * w)],
        [2 * (x * z - y * w), 2 * (y * z + x * w), 1 - 2 * (x * x + y * y)],
    ]


def _quat(p: Column) -> list[Column]:
    return [p[n] for n in POSE[3:]]


def rotate(p: Column, v: Sequence[Column]) -> list[Column]:
    return [sum((a * b for a, b in zip(row[1:], v[1:], strict=True)), row[0] * v[0]) for row in rotation(_quat(p))]


def pose_apply(p: Column, x, y, z) -> list[Column]:
    """The point moved by the pose."""
    return [a + p[n] for a, n in zip(rotate(p, [_c(x), _c(y), _c(z)]), POSE[:3], strict=True)]


def covariance_apply(p: Column, c: Column) -> Column:
    """R C R^T of a row-major ARRAY<DOUBLE>(9)."""
    r = rotation(_quat(p))
    e = [[F.element_at(c, 3 * i + j + 1) for j in range(3)] for i in range(3)]

    def cell(i: int, j: int) -> Column:
        return reduce(lambda a, b: a + b, (r[i][k] * e[k][m] * r[j][m] for k in range(3) for m in range(3)))

    return F.array(*(cell(i, j) for i in range(3) for j in range(3)))


def quat_mul(a: Sequence[Column], b: Sequence[Column]) -> list[Column]:
    ax, ay, az, aw = a
    bx, by, bz, bw = b
    return [aw * bx + ax * bw + ay * bz - az * by, aw * by - ax * bz + ay * bw + az * bx, aw * bz + ax * by - ay * bx + az * bw, aw * bw - ax * bx - ay * by - az * bz]


def pose_mul(a: Column, b: Column) -> Column:
    """a after b."""
    return pose(*pose_apply(a, b["tx"], b["ty"], b["tz"]), *quat_mul(_quat(a), _quat(b)))


def pose_inv(p: Column) -> Column:
    back = pose(0.0, 0.0, 0.0, -p["qx"], -p["qy"], -p["qz"], p["qw"])
    return pose(*rotate(back, [-p["tx"], -p["ty"], -p["tz"]]), -p["qx"], -p["qy"], -p["qz"], p["qw"])


def rpy_to_quat(roll, pitch, yaw) -> list[Column]:
    """Quaternion (x, y, z, w) of yaw * pitch * roll."""
    r, p, y = (_c(v) / 2 for v in (roll, pitch, yaw))
    sr, cr, sp, cp, sy, cy = F.sin(r), F.cos(r), F.sin(p), F.cos(p), F.sin(y), F.cos(y)
    return [sr * cp * cy - cr * sp * sy, cr * sp * cy + sr * cp * sy, cr * cp * sy - sr * sp * cy, cr * cp * cy + sr * sp * sy]


def quat_to_rpy(q: Sequence[Column]) -> list[Column]:
    """Roll, pitch and yaw of a quaternion (x, y, z, w) of any length."""
    n = F.sqrt(sum((c * c for c in q[1:]), q[0] * q[0]))
    x, y, z, w = (c / n for c in q)
    return [
        F.atan2(2 * (w * x + y * z), 1 - 2 * (x * x + y * y)),
        F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), 2 * (w * y - z * x)))),
        F.atan2(2 * (w * z + x * y), 1 - 2 * (y * y + z * z)),
    ]


def is_close(a, b, threshold: float) -> Column:
    return F.abs(_c(a) - _c(b)) < threshold


def interpolate(a: Column, ta: Column, b: Column, tb: Column, t: Column) -> Column:
    """Pose between two at ticks ta <= t <= tb: linear in place, spherical in rotation; null outside."""
    seconds = (tb - ta) / TICKS_PER_SECOND
    f = ((t - ta) / TICKS_PER_SECOND) / (seconds + 1e-6)
    qa, qb = _quat(a), _quat(b)
    dot = sum((x * y for x, y in zip(qa[1:], qb[1:], strict=True)), qa[0] * qb[0])
    sign = F.when(dot < 0, -1.0).otherwise(1.0)
    angle = F.acos(F.least(F.abs(dot), F.lit(1.0)))
    straight = F.abs(dot) > 1 - 1e-9
    wa = F.when(straight, 1 - f).otherwise(F.sin((1 - f) * angle) / F.sin(angle))
    wb = F.when(straight, f).otherwise(F.sin(f * angle) / F.sin(angle)) * sign
    mid = pose(*(a[n] + f * (b[n] - a[n]) for n in POSE[:3]), *(wa * x + wb * y for x, y in zip(qa, qb, strict=True)))
    return F.when((t >= ta) & (t <= tb), mid)


def azimuth_phase(x, y, clockwise: bool = True) -> Column:
    """Share of a turn at which a rotating sensor saw the point, in [0, 1]."""
    angle = F.atan2(_c(y), _c(x))
    share = F.when(angle < 0, angle + 2 * 3.141592653589793).otherwise(angle) / (2 * 3.141592653589793)
    return 1 - share if clockwise else share


def deskew(x, y, z, phase: Column, velocity: Sequence[Column], turn: Sequence[Column], scan_seconds: float = 0.1) -> list[Column]:
    """The point moved to where it was at the scan's start: motion of phase * duration at constant velocity."""
    s = phase * scan_seconds
    return pose_apply(pose_rpy(*(_c(v) * s for v in velocity), *(_c(w) * s for w in turn)), x, y, z)


def voxel_key(x, y, z, size: float) -> list[Column]:
    """Integer voxel of a point, by division, in every operator alike."""
    return [F.floor(_c(v) / size).cast("int") for v in (x, y, z)]


def voxel_center(v: Column | str, size: float) -> Column:
    return _c(v) * size + size / 2


def voxel_low(v: Column | str, size: float) -> Column:
    return _c(v) * size


def voxel_high(v: Column | str, size: float) -> Column:
    return _c(v) * size + size


def in_box(x, y, z, low: Sequence, high: Sequence) -> Column:
    """Inclusive on all sides."""
    return reduce(lambda a, b: a & b, (_c(v).between(_c(a), _c(b)) for v, a, b in zip((x, y, z), low, high, strict=True)))


def smaller_voxels(vx, vy, vz, size: float, small: float) -> Column:
    """ARRAY<STRUCT<vx, vy, vz>> of the small voxels whose centre lies in the big voxel."""
    if round(size / small) == 1:
        return F.array(F.struct(*(_c(v).cast("int").alias(n) for v, n in zip((vx, vy, vz), ("vx", "vy", "vz"), strict=True))))

    def axis(v) -> Column:
        low, high = voxel_low(v, size), voxel_high(v, size)
        first, last = F.floor(low / small).cast("int") - 1, F.floor(high / small).cast("int") + 1
        return F.filter(F.sequence(first, last), lambda k: (voxel_center(k, small) >= low) & (voxel_center(k, small) <= high))

    return _grid(axis(vx), axis(vy), axis(vz))


def _grid(xs: Column, ys: Column, zs: Column) -> Column:
    return F.flatten(F.flatten(F.transform(xs, lambda a: F.transform(ys, lambda b: F.transform(zs, lambda c: F.struct(a.alias("vx"), b.alias("vy"), c.alias("vz")))))))


def voxels_around(x, y, z, radius: float, size: float) -> Column:
    """ARRAY<STRUCT<vx, vy, vz>> of voxels whose centre is within the radius of the point, and its own."""
    reach = int(radius / size) + 1
    own = voxel_key(x, y, z, size)
    around = _grid(*(F.sequence(v - reach, v + reach) for v in own))

    def near(v: Column) -> Column:
        d = [voxel_center(v[n], size) - _c(p) for n, p in zip(("vx", "vy", "vz"), (x, y, z), strict=True)]
        return (d[0] * d[0] + d[1] * d[1] + d[2] * d[2] <= radius * radius) | reduce(lambda a, b: a & b, (v[n] == o for n, o in zip(("vx", "vy", "vz"), own, strict=True)))

    return F.filter(around, near)


def adaptive_distance(voxel: float, factor: float, fallback: float = 0.05) -> float:
    """``factor`` voxels, or the fallback where no voxel size is set (1.5: information matrix, 2: registration)."""
    return fallback if abs(voxel) < 1e-3 else factor * voxel


def unix_to_ticks(seconds, nanoseconds) -> Column:
    """Ticks since year 1; null for times before 1970."""
    s = _c(seconds).cast("long")
    return F.when(s >= 0, s * TICKS_PER_SECOND + UNIX_TICKS + F.floor((_c(nanoseconds).cast("long") + 50) / 100).cast("long"))


def ticks_to_unix_nanos(ticks) -> Column:
    return (_c(ticks) - UNIX_TICKS) * 100


def ticks_to_timestamp(ticks) -> Column:
    return F.timestamp_micros(F.floor((_c(ticks) - UNIX_TICKS) / 10).cast("long"))


def seconds_to_ticks(s) -> Column:
    return F.floor(_c(s) * TICKS_PER_SECOND + 0.5).cast("long")


def ticks_to_seconds(t) -> Column:
    return _c(t) / TICKS_PER_SECOND


def is_valid_time(t) -> Column:
    return _c(t) > 0


def pose_text(p: Column) -> Column:
    roll, pitch, yaw = (F.degrees(a) for a in quat_to_rpy(_quat(p)))
    return F.format_string("t:[%f, %f, %f] ; q:[%f, %f, %f, %f] ; rpy (deg):[%f, %f, %f]", *(p[n] for n in POSE), roll, pitch, yaw)


def palette_color(i) -> Column:
    """Colour struct of a submap, cycling through the palette without black and white."""
    table = F.array(*(F.struct(*(F.lit(v).alias(n) for v, n in zip(c, "rgb", strict=True))) for c in PALETTE))
    return F.element_at(table, (F.pmod(_c(i), F.lit(len(PALETTE) - 2)) + 3).cast("int"))


def scale_color(c, k: float) -> Column:
    return F.least(F.greatest(_c(c) * k, F.lit(0.0)), F.lit(1.0))


def color_to_byte(c) -> Column:
    return F.floor(_c(c) * 255).cast("int")


def byte_to_color(b) -> Column:
    return _c(b) / 255.0


def micro(c) -> Column:
    """Millionths as a whole number: sums of it don't depend on their order, so results repeat exactly."""
    return F.floor(_c(c) * 1e6 + 0.5).cast("long")


def exact_mean(c) -> Column:
    return F.sum(micro(c)) / 1e6 / F.count(_c(c))


def all_true(conditions: dict[str, Column]) -> Column:
    """True, or an error that names the first failed condition."""
    return F.coalesce(*(F.assert_true(c, F.lit(f"failed: {name}")).cast("boolean") for name, c in conditions.items()), F.lit(True))
