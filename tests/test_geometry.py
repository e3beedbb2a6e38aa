import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrane.functions import geometry as g
from terrane.operators.trajectory import multiply

POSES = [(1.0, 2.0, 3.0, 0.1, -0.2, 0.3), (-4.0, 0.5, 0.0, -1.2, 0.7, 2.9), (0.0, 0.0, 0.0, 0.0, 0.0, 0.0)]


@pytest.fixture(scope="module")
def poses(spark):
    return spark.createDataFrame([(i, *p) for i, p in enumerate(POSES)], "id long, x double, y double, z double, roll double, pitch double, yaw double").withColumn("p", g.pose_rpy("x", "y", "z", "roll", "pitch", "yaw"))


def test_inverse_undoes_a_pose(poses):
    for r in poses.select(g.pose_mul(F.col("p"), g.pose_inv(F.col("p"))).alias("e")).collect():
        assert list(r.e) == pytest.approx([0, 0, 0, 0, 0, 0, 1], abs=1e-12)


def test_rpy_comes_back(poses):
    q = [F.col(f"p.{n}") for n in ("qx", "qy", "qz", "qw")]
    for r in poses.select("roll", "pitch", "yaw", *(c.alias(n) for c, n in zip(g.quat_to_rpy(q), "abc", strict=True))).collect():
        assert (r.a, r.b, r.c) == pytest.approx((r.roll, r.pitch, r.yaw), abs=1e-12)


def test_product_equals_plain_python(poses):
    rows = [tuple(r.p) for r in poses.orderBy("id").collect()]
    got = poses.where("id = 0").select(g.pose_mul(F.col("p"), g.pose(*rows[1])).alias("m")).first().m
    # an independent product: by the Hamilton product of quaternions as complex pairs, and by 4x4 matrices
    (ax, ay, az, aw), (bx, by, bz, bw) = rows[0][3:], rows[1][3:]
    a, b, c, d = complex(aw, ax), complex(ay, az), complex(bw, bx), complex(by, bz)
    one, two = a * c - b * d.conjugate(), a * d + b * c.conjugate()
    want = (_four(rows[0]) @ _four(rows[1]))[:3, 3].tolist() + [one.imag, two.real, two.imag, one.real]
    assert tuple(got) == pytest.approx(want, abs=1e-12)
    assert multiply(np.array([rows[0]]), np.array([rows[1]]))[0].tolist() == pytest.approx(want, abs=1e-12)


def _four(p):
    x, y, z, w = p[3:]
    u, s = np.array([x, y, z]), np.array([[0, -z, y], [z, 0, -x], [-y, x, 0]])
    m = np.eye(4)
    m[:3, :3] = (w * w - u @ u) * np.eye(3) + 2 * np.outer(u, u) + 2 * w * s
    m[:3, 3] = p[:3]
    return m


def test_matrix_gives_the_pose_back(spark, poses):
    from terrane.operators.graph import _matrix

    for r in poses.collect():
        m = _matrix(r.p.asDict()).ravel().tolist()
        back = spark.createDataFrame([(m,)], "m array<double>").select(g.pose_from_matrix(F.col("m")).alias("p")).first().p
        sign = 1 if back.qw * r.p.qw >= 0 else -1
        assert list(back)[:3] == pytest.approx(list(r.p)[:3])
        assert [sign * v for v in list(back)[3:]] == pytest.approx(list(r.p)[3:], abs=1e-9)


def test_interpolation_ends_and_middle(spark):
    row = spark.range(1).select(g.planar_pose(0.0, 0.0, 0.0, 0.0).alias("a"), g.planar_pose(2.0, 0.0, 0.0, 1.0).alias("b"))
    mid = row.select(g.interpolate(F.col("a"), F.lit(0), F.col("b"), F.lit(100_000_000), F.lit(50_000_000)).alias("m")).first().m
    assert mid.tx == pytest.approx(1.0, abs=1e-6) and mid.qz == pytest.approx(math.sin(0.25), abs=1e-6)
    out = row.select(g.interpolate(F.col("a"), F.lit(0), F.col("b"), F.lit(10), F.lit(11)).alias("m")).first().m
    assert out is None


def test_phase_and_times(spark):
    r = spark.createDataFrame([(1.0, 0.0), (0.0, 1.0), (-1.0, 0.0), (0.0, -1.0)], "x double, y double")
    assert [x[0] for x in r.select(g.azimuth_phase("x", "y", clockwise=False)).collect()] == pytest.approx([0, 0.25, 0.5, 0.75])
    t = spark.range(1).select(g.unix_to_ticks(F.lit(1), F.lit(49)).alias("a"), g.unix_to_ticks(F.lit(1), F.lit(50)).alias("b"), g.unix_to_ticks(F.lit(-1), F.lit(0)).alias("c"), g.ticks_to_unix_nanos(F.lit(g.UNIX_TICKS + 3)).alias("d")).first()
    assert (t.a, t.b, t.c, t.d) == (g.UNIX_TICKS + 10_000_000, g.UNIX_TICKS + 10_000_001, None, 300)


def test_points_lie_in_their_neighbourhood(spark):
    rng = random.Random(1)
    df = spark.createDataFrame([tuple(rng.uniform(-5, 5) for _ in range(3)) for _ in range(20)], "x double, y double, z double")
    for r in df.withColumn("v", g.voxels_around("x", "y", "z", 1.2, 0.5)).collect():
        own = tuple(math.floor(c / 0.5) for c in (r.x, r.y, r.z))
        want = {(a, b, c) for a in range(own[0] - 4, own[0] + 5) for b in range(own[1] - 4, own[1] + 5) for c in range(own[2] - 4, own[2] + 5) if math.dist((a * 0.5 + 0.25, b * 0.5 + 0.25, c * 0.5 + 0.25), (r.x, r.y, r.z)) <= 1.2} | {own}
        assert {tuple(v) for v in r.v} == want


def test_covariance_turns_with_the_pose(spark):
    row = spark.range(1).select(g.covariance_apply(g.planar_pose(0.0, 0.0, 0.0, math.pi / 2), F.array(*map(F.lit, (4.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 9.0)))).alias("c")).first()
    assert row.c == pytest.approx([1, 0, 0, 0, 4, 0, 0, 0, 9], abs=1e-12)
