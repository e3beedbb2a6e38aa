import inspect
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrane import catalog
from terrane.config import PlaceRecognition
from terrane.functions import geometry as g
from terrane.operators import blocks, carving, closing, crop, features, graph, mapping, neighbours, posegraph, registration, trajectory, voxel

EDGES = [(0, 1), (0, 4), (4, 5), (3, 4), (1, 3), (2, 1), (2, 6), (6, 7), (3, 7), (4, 9), (3, 8), (8, 11), (12, 11), (12, 10), (7, 10)]


def cloud(spark, n=300, seed=3, pair="a"):
    """Three planes of a room's corner, with jitter and normals."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        u, v, k = rng.uniform(0.2, 2), rng.uniform(0.2, 2), i % 3
        p = [u, v]
        p.insert(k, 0.0)
        nrm = [0.0, 0.0, 0.0]
        nrm[k] = 1.0
        rows.append((pair, i, *p, *nrm))
    return spark.createDataFrame(rows, "pair_id string, point_id long, x double, y double, z double, nx double, ny double, nz double")


def test_crop_and_its_inverse_part_the_points(spark):
    p = cloud(spark).withColumn("scan_id", F.lit(1))
    for kind, args in (("MaxRadius", {"radius": 1.0}), ("MinMaxRadius", {"low": 0.5, "high": 1.5}), ("Cylinder", {"radius": 1.0, "low": 0.0, "high": 1.0})):
        assert crop.crop(p, kind, **args).count() + crop.crop(p, kind, inverted=True, **args).count() == p.count()
    with pytest.raises(ValueError):
        crop.crop(p, "Cone")
    crop.register_cropper("Slab", lambda dx, dy, dz, z, high: z <= high)
    assert crop.crop(p, "Slab", high=1.0).where("z > 1").count() == 0


def test_voxel_means_lie_in_their_voxel_and_merge(spark):
    p = cloud(spark).withColumn("scan_id", F.lit(1))
    for r in voxel.downsample(p, 0.5).collect():
        assert all(v * 0.5 <= c < v * 0.5 + 0.5 for v, c in ((r.vx, r.x), (r.vy, r.y), (r.vz, r.z)))
    whole = voxel.dense_state(p, 0.5)
    parts = voxel.merge_states(*(voxel.dense_state(p.where(F.col("point_id") % 4 == k), 0.5) for k in range(4)))
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, parts.collect()))


@pytest.mark.parametrize("kind", ["PointToPoint", "PointToPlane", "Generalized"])
def test_registration_recovers_a_known_motion(spark, kind):
    target = cloud(spark, 600)
    known = g.pose_rpy(0.02, -0.015, 0.01, 0.01, -0.008, 0.015)
    source = registration.moved(target, spark.range(1).select(F.lit("a").alias("pair_id"), g.pose_inv(known).alias("pose")))
    got = registration.register(source, target, kind, 0.3, rounds=25).first()
    want = spark.range(1).select(known.alias("p")).first().p
    assert list(got.pose) == pytest.approx(list(want), abs=1e-3)
    assert got.fitness > 0.95


def test_nearest_equals_brute_force(spark):
    rng = np.random.default_rng(2)
    a, b = rng.uniform(0, 4, (40, 3)), rng.uniform(0, 4, (50, 3))
    df = lambda v: spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(v)], "point_id long, x double, y double, z double")
    got = {r.source_id: r.target_id for r in neighbours.nearest(df(a), df(b), 0.2).collect()}
    assert got == {i: int(((b - p) ** 2).sum(axis=1).argmin()) for i, p in enumerate(a)}


def test_normals_of_planes(spark):
    p = cloud(spark, 600).withColumnRenamed("pair_id", "cloud_id").where("x > 0.5 and y > 0.5 and z = 0 or z > 0.5")
    flat = p.where("z = 0").select("cloud_id", "point_id", "x", "y", (F.col("z") + 1).alias("z"))
    for r in neighbours.normals(flat, 0.5, 12).where("not isnan(nx)").collect():
        assert abs(r.nz) == pytest.approx(1.0, abs=1e-6) and r.nz < 0


def test_loop_distances_of_the_small_graph(spark):
    nodes = spark.createDataFrame([(i, i in (2, 10)) for i in range(13)], "id long, is_lc boolean")
    edges = spark.createDataFrame(EDGES, "src long, dst long")
    got = {r.id: r.distance for r in graph.loop_distance(nodes, edges).collect()}
    assert got == dict(enumerate([1, 0, 0, 1, 2, 3, 0, 0, 2, 3, 0, 1, 0]))
    alone = spark.createDataFrame([(99, False), (2, True)], "id long, is_lc boolean")
    assert {r.id: r.distance for r in graph.loop_distance(alone, edges).collect()} == {99: None, 2: 0}


def test_parent_chains(spark):
    s = spark.createDataFrame([(0, 0), (1, 0), (2, 1), (3, 2), (4, 3), (9, 9)], "submap_id long, parent_id long")
    got = {r.submap_id: (r.ancestor, r.depth) for r in graph.resolved_ancestor(s, s.where("submap_id = 1")).collect()}
    assert got == {0: (None, None), 1: (1, 0), 2: (1, 1), 3: (1, 2), 4: (1, 3), 9: (None, None)}
    with pytest.raises(ValueError):
        graph.resolved_ancestor(spark.createDataFrame([(1, 2), (2, 1)], "submap_id long, parent_id long"), s.where("submap_id = 0"), limit=5)


def test_pose_graph_pulls_a_drifted_loop_together(spark):
    n = 12
    true = [(math.cos(2 * math.pi * k / n), math.sin(2 * math.pi * k / n), 2 * math.pi * k / n) for k in range(n)]
    drift = [(x + 0.01 * k, y - 0.008 * k, a) for k, (x, y, a) in enumerate(true)]

    def tie(a, b):
        dx, dy = a[0] - b[0], a[1] - b[1]
        c, s = math.cos(-b[2]), math.sin(-b[2])
        return (c * dx - s * dy, s * dx + c * dy, a[2] - b[2])

    half = lambda x, y, a: {"tx": x, "ty": y, "tz": 0.0, "qx": 0.0, "qy": 0.0, "qz": math.sin(a / 2), "qw": math.cos(a / 2)}
    nodes = [{"node_id": k, "pose": half(*p)} for k, p in enumerate(drift)]
    edges = [{"source_id": (k + 1) % n, "target_id": k, "pose": half(*tie(true[(k + 1) % n], true[k])), "weight": 1.0, "uncertain": k == n - 1} for k in range(n)]
    edges.append({"source_id": 6, "target_id": 0, "pose": half(50.0, 50.0, 0.0), "weight": 1.0, "uncertain": True})  # a wrong loop
    ids, poses, _ = graph.solve_graph(nodes, edges, 30, 0.2, 2.0, 0)
    assert max(math.dist((p["tx"], p["ty"]), t[:2]) for p, t in zip(poses, true, strict=True)) < 1e-4


def test_graph_json_round_trip(spark):
    nodes = spark.range(3).select(F.lit(1).cast("long").alias("graph_id"), F.col("id").alias("node_id"), g.planar_pose(F.col("id"), 0.0, 0.0, 0.5).alias("pose"))
    edges = spark.range(2).select(F.lit(1).cast("long").alias("graph_id"), (F.col("id") + 1).alias("source_id"), F.col("id").alias("target_id"), g.planar_pose(1.0, 0.0, 0.0, 0.0).alias("pose"), F.lit(1.0).alias("weight"), F.lit(False).alias("uncertain"))
    n, e = graph.from_json(graph.to_json(nodes, edges))
    assert sorted(map(str, n.collect())) == sorted(map(str, nodes.collect()))
    assert sorted(map(str, e.collect())) == sorted(map(str, edges.collect()))


@pytest.mark.parametrize("most", [500_000, 7])
def test_carving_moves_rays_not_steps(spark, monkeypatch, most):
    monkeypatch.setattr(carving, "_RAYS", most)
    monkeypatch.setattr(carving, "_HELD", most)
    rng = random.Random(8)
    xyz = [(s, i, *(rng.uniform(-30, 30) for _ in range(3))) for s in (1, 2) for i in range(40)]
    rays = spark.createDataFrame([(s, 0.3, -0.2, 0.1, x, y, z) for s, _, x, y, z in xyz] + [(1, 0.3, -0.2, 0.1, 0.3, -0.2, 0.1)], "submap_id long, sx double, sy double, sz double, x double, y double, z double")
    rest = [(rng.choice((1, 2)), i, *(rng.uniform(-6, 6) for _ in range(3)), 0.6, 0.8, 0.0) for i in range(400)] + [(1, 400, 0.4, -0.3, 0.2, 1.0, 0.0, 0.0), (3, 401, 0.4, -0.3, 0.2, 1.0, 0.0, 0.0)]
    points = spark.createDataFrame(rest, "submap_id long, point_id long, x double, y double, z double, nx double, ny double, nz double")
    cell = lambda p, size: tuple(math.floor(v / size) for v in p)

    def steps(step):
        for s, _, x, y, z in xyz:
            d = (x - 0.3, y + 0.2, z - 0.1)
            n = math.sqrt(sum(v * v for v in d))
            u = [v / n for v in d]
            for k in range(math.ceil(max(step, min(n - 0.1, 20.0)) / step)):
                yield s, u, [a + b * (k * step) for a, b in zip((0.3, -0.2, 0.1), u)]

    walked = list(steps(1.5))
    want = {(s, i) for s, i, x, y, z, *n in rest if any(s == t and cell(p, 1.5) == cell((x, y, z), 1.5) and abs(sum(a * b for a, b in zip(u, n))) > 0.5 for t, u, p in walked)}
    got = carving.carved_points(rays, points, 1.5, 20.0, 0.1, 0.5)
    assert len(want) > 10 and sorted((r.submap_id, r.point_id) for r in got.collect()) == sorted(want)
    occupied = {(s, *cell((x, y, z), 0.8)) for s, _, x, y, z, *_ in rest}
    walked = list(steps(2.0))
    want = {(s, *v) for s, *v in occupied if any(s == t and (cell(p, 0.8) == tuple(v) or sum((c * 0.8 + 0.4 - a) ** 2 for c, a in zip(v, p)) <= 1.0) for t, _, p in walked)}
    cells = voxel.with_voxel(points, 0.8).select("submap_id", "vx", "vy", "vz").distinct()
    found = carving.carved_voxels(rays, cells, 0.8, 20.0, 0.1, 1.0)
    assert len(want) > 10 and sorted(map(tuple, found.collect())) == sorted(want)
    for df in (got, found):
        assert "LeftSemi" not in df._jdf.queryExecution().optimizedPlan().toString()


def test_carving_takes_what_stands_before_the_wall(spark):
    wall = [(1, k, 5.0, 0.1 * k + 0.05, 0.05, -1.0, 0.0, 0.0) for k in range(5)]
    ghost = [(1, 100 + k, 2.0, 0.04 * k + 0.02, 0.02, -1.0, 0.0, 0.0) for k in range(5)]
    points = spark.createDataFrame(wall + ghost, "submap_id long, point_id long, x double, y double, z double, nx double, ny double, nz double")
    rays = points.where("point_id < 100").select("submap_id", F.col("point_id").alias("ray_id"), "x", "y", "z", *(F.lit(0.0).alias(f"s{c}") for c in "xyz"))
    left = {r.point_id for r in carving.carve(points, rays, 0.1, 20.0, 0.1, 0.5).collect()}
    assert left == {0, 1, 2, 3, 4}


def test_segments_fold_to_the_same_product(spark):
    rng = random.Random(4)
    rows = [(s, k, rng.uniform(-1, 1), rng.uniform(-1, 1), rng.uniform(-0.5, 0.5)) for s in (1, 2) for k in range(70)]
    df = spark.createDataFrame(rows, "session_id long, t_ticks long, dx double, dy double, dyaw double")
    steps = df.select("session_id", "t_ticks", g.planar_pose("dx", "dy", 0.1, "dyaw").alias("pose"))
    short = {(r.session_id, r.t_ticks): tuple(r.product) for r in trajectory.pose_product(steps, segment=8).collect()}
    long = {(r.session_id, r.t_ticks): tuple(r.product) for r in trajectory.pose_product(steps, segment=1000).collect()}
    assert short.keys() == long.keys()
    assert all(short[k] == pytest.approx(long[k], abs=1e-9) for k in short)


def test_ransac_finds_the_motion_among_wrong_matches():
    rng = np.random.default_rng(5)
    p = rng.uniform(-3, 3, (80, 3))
    c, s = math.cos(0.4), math.sin(0.4)
    q = p @ np.array([[c, -s, 0], [s, c, 0], [0, 0, 1]]).T + (1.0, -2.0, 0.5)
    q[50:] = rng.uniform(-3, 3, (30, 3))
    pose, n = features.best_pose(p, q, 0.05, 0.5, 4096, 0.99, 1)
    assert n >= 50 and pose[:3, 3] == pytest.approx([1.0, -2.0, 0.5], abs=1e-6)


def test_submap_transitions():
    s = mapping.Segmenter(radius=2.0, least_scans=2, replay=2)
    got = [s.step(k, (float(k), 0.0, 0.0), (float(k), 0.0, 0.0), 10) for k in range(8)]
    assert got[0] == (0, 0, [])
    switch = next(x for x in got if x[0] != x[1])
    assert switch[:2] == (0, 1) and len(switch[2]) == 2
    assert s.finished == {0, 1} or 0 in s.finished
    assert (0, 1) in s.edges


def test_loops_close_between_moved_copies(spark):
    room = cloud(spark, 900, seed=8).withColumn("cloud_id", F.lit(1).cast("long")).drop("pair_id")
    move = g.planar_pose(0.3, -0.2, 0.1, 0.2)
    other = room.withColumns(dict(zip("xyz", g.pose_apply(move, "x", "y", "z"), strict=True))).withColumns(dict(zip(("nx", "ny", "nz"), g.rotate(move, [F.col("nx"), F.col("ny"), F.col("nz")]), strict=True))).withColumn("cloud_id", F.lit(2).cast("long"))
    both = room.unionByName(other)
    f = both.join(features.fpfh(both, 0.6, 30), ["cloud_id", "point_id"])
    pairs = spark.createDataFrame([(1, 2)], "source long, target long")
    got = mapping.close_loops(pairs, f, mapping.LoopSettings(ransac_distance=0.1, icp_distance=0.2)).first()
    assert got.status == "accepted"
    want = spark.range(1).select(move.alias("p")).first().p
    assert list(got.pose) == pytest.approx(list(want), abs=1e-3)


def test_pose_graph_solves_every_node(spark, tmp_path):
    rows = [(i, i % 25, float(i % 7) * 100) for i in range(250)]
    spark.createDataFrame(rows, "s_suppkey long, s_nationkey int, s_acctbal double").write.parquet(f"{tmp_path}/supplier.parquet")
    got = catalog.QUERIES["pose_graph"](spark, str(tmp_path)).collect()
    assert sorted((r.graph_id, r.node_id) for r in got) == [(g, n) for g in range(5) for n in range(50)]
    first = {r.graph_id: r.tx for r in got if r.node_id == 0}
    assert all(abs(r.tx - first[r.graph_id] - r.node_id) < 1e-3 and abs(r.ty) < 1e-3 for r in got)


def test_ransac_default_finds_few_true_matches():
    rng = np.random.default_rng(9)
    tries = inspect.signature(features.ransac).parameters["hypotheses"].default
    assert tries == mapping.LoopSettings().ransac_hypotheses == PlaceRecognition().ransac_hypotheses
    for seed in range(6):
        p, q = rng.uniform(-10, 10, (2, 600, 3))
        q[:30] = p[:30] + [1.0, 2.0, 0.5]
        pose, n = features.best_pose(p, q, 0.05, 0.5, tries, 0.99, seed)
        assert n >= 30 and np.allclose(pose[:3, 3], [1.0, 2.0, 0.5], atol=0.05)


def test_nearest_has_no_farthest_reach(spark):
    """A point thousands of reaches away is found; one without a place, or without a target in its group, has no neighbour."""
    kind = "pair_id long, point_id long, x double, y double, z double"
    a = spark.createDataFrame([(1, 1, 0.0, 0.0, 0.0), (1, 2, 9000.0, 0.0, 0.0), (1, 3, None, 0.0, 0.0), (1, 4, float("nan"), 0.0, 0.0), (2, 5, 0.0, 0.0, 0.0)], kind)
    b = spark.createDataFrame([(1, 7, 0.5, 0.0, 0.0), (1, 8, 1.0, 0.0, 0.0)], kind)
    assert {(r.source_id, r.target_id) for r in neighbours.nearest(a, b, 0.2, ["pair_id"]).collect()} == {(1, 7), (2, 8)}
    assert neighbours.nearest(a, b.limit(0), 0.2, ["pair_id"]).collect() == []


def test_mutual_matches_in_blocks(spark):
    rng = random.Random(2)
    rows = [(i % 3, i, [round(rng.uniform(-1, 1), 2) for _ in range(4)]) for i in range(90)]
    f = spark.createDataFrame(rows, "cloud_id long, vec_id long, f array<double>")
    pairs = spark.createDataFrame([(0, 1), (1, 2), (2, 9)], "source long, target long")
    d = lambda x, y: sum(round((p - q) * 1e6) ** 2 for p, q in zip(x, y, strict=True))
    want = set()
    for s, t in ((0, 1), (1, 2)):
        va, vb = ([(i, v) for c, i, v in rows if c == k] for k in (s, t))
        for i, v in va:
            j, w = min(vb, key=lambda x: (d(v, x[1]), x[0]))
            if min(va, key=lambda x: (d(w, x[1]), x[0]))[0] == i:
                want.add((s, t, i, j, d(v, w)))
    for block in (7, 512):
        assert {tuple(r) for r in neighbours.mutual_matches(f, pairs, block).collect()} == want


def test_overlap_decides_whether_a_submap_is_taken_up_again(spark):
    """There and back: the way back enters the first submap only if the scan lies in cells that it occupies."""

    def walk(here):
        s = mapping.Segmenter(radius=3.0, least_scans=2, least_overlap=0.4, replay=1)
        out = []
        for k, x in enumerate([0.0, 1.0, 2.0, 3.5, 4.5, 5.5, 4.0, 2.0, 0.5, 0.2, 0.1]):
            cells = {round(x): 6, round(x) + 100 * (k if not here and k > 6 else 0): 4} if here or k <= 6 else {1000 + k: 10}
            out.append(s.step(k, (x, 0.0, 0.0), (x, 0.0, 0.0), 10, cells))
        return s, [after for _, after, _ in out]

    s, taken = walk(True)
    assert taken[-1] == 0 and max(taken) == 1 and s.overlap(0, {0: 1, 77: 1}) == 0.5
    s, taken = walk(False)
    assert taken[-1] != 0 and len(s.origins) >= 2  # no switch: kept, or a new one beyond the radius


def test_neighbours_at_any_distance(spark):
    rng = random.Random(4)
    rows = [(c, i, *(rng.gauss(0, 1) * (1 if i % 9 else 60) for _ in range(3))) for c in (1, 2) for i in range(40)] + [(3, i, 0.0, 0.0, 0.0) for i in range(3)] + [(4, 0, float("nan"), 0.0, 0.0)]
    df = spark.createDataFrame(rows, "cloud_id long, point_id long, x double, y double, z double")
    got = {(r.cloud_id, r.source_id, r["rank"]): r.target_id for r in neighbours.k_nearest_any(df, 4, 0.5).collect()}
    want = {}
    for c, i, *p in rows[:-1]:
        near = sorted((sum((a - b) ** 2 for a, b in zip(p, q, strict=True)), j) for d, j, *q in rows if d == c)[:4]
        want |= {(c, i, k + 1): j for k, (_, j) in enumerate(near)}
    assert got == want


def test_closures_feed_back_until_none_is_left(spark):
    """A ring of submaps that drifted: landmarks seen twice close it, and it ends nearer to the truth."""
    n, rng = 10, np.random.default_rng(3)
    turn = 2 * np.pi * np.arange(n) / n
    true = np.stack([12 * np.cos(turn), 12 * np.sin(turn), np.zeros(n), np.zeros(n), np.zeros(n), np.sin(turn / 2), np.cos(turn / 2)], axis=1)
    drift = np.repeat([[0.0, 0, 0, 0, 0, 0, 1]], n, axis=0)
    for k in range(1, n):
        drift[k : k + 1] = posegraph.multiply(drift[k - 1 : k], posegraph.steps(np.array([[0, 0, 0.01, 0.05, -0.03, 0.02]])))
    marks = rng.uniform(-2, 2, (n, 25, 3)) + true[:, None, :3]
    points = []
    for k in range(n):
        seen = [(m, i) for m in {k, (k - 1) % n, (k + 1) % n} for i in range(25)]
        for m, i in seen:
            here = posegraph.turns(drift[k : k + 1, 3:])[0] @ marks[m, i] + drift[k, :3]
            points.append((k, m * 100 + i, *map(float, here)))
    clouds = spark.createDataFrame(points, "submap_id long, point_id long, x double, y double, z double")
    submaps = spark.createDataFrame([(k, max(0, k - 1)) for k in range(n)] + [(77, n - 1)], "submap_id long, parent_id long")
    pose = "struct<tx:double,ty:double,tz:double,qx:double,qy:double,qz:double,qw:double>"
    poses = spark.createDataFrame([(k, tuple(map(float, posegraph.multiply(drift[k : k + 1], true[k : k + 1])[0]))) for k in range(n)] + [(77, tuple(map(float, posegraph.multiply(drift[-1:], true[-1:])[0])))], f"submap_id long, pose {pose}")
    odometry = spark.createDataFrame([(k - 1, k, (0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 1.0), 1.0) for k in range(1, n)], f"source_id long, target_id long, pose {pose}, weight double")
    asked = []

    def find(candidates, now):
        """Rigid motions between landmarks that both clouds of a candidate hold."""
        rows, out = now.collect(), []
        where = {}
        for r in rows:
            where.setdefault(r.submap_id, {})[r.point_id] = (r.x, r.y, r.z)
        for c in candidates.collect():
            both = sorted(where[c.a].keys() & where[c.b].keys())
            if len(both) >= 10:
                p, q = (np.array([where[s][m] for m in both]) for s in (c.b, c.a))
                u, _, vt = np.linalg.svd((p - p.mean(0)).T @ (q - q.mean(0)))
                r = vt.T @ np.diag([1, 1, np.sign(np.linalg.det(vt.T @ u.T))]) @ u.T
                m = np.eye(4)
                m[:3, :3], m[:3, 3] = r, q.mean(0) - r @ p.mean(0)
                out.append((c.b, c.a, tuple(graph.matrix_pose(m).values()), 5.0))
        asked.append(len(out))
        return spark.createDataFrame(out, f"source_id long, target_id long, pose {pose}, weight double")

    got, trajectory_, closures = closing.close_and_correct(submaps, clouds, poses, odometry, find, radius=9.0, size=9.0, preference=50.0)
    assert asked[0] >= 1 and asked[-1] == 0 and closures.count() >= 1

    def error(frame):
        return max(math.dist((r.pose.tx, r.pose.ty, r.pose.tz), true[min(r.submap_id, n - 1), :3]) for r in frame.collect())

    assert error(trajectory_) < error(poses) / 2
    head = {r.submap_id: r.pose for r in trajectory_.collect()}
    assert tuple(head[77]) == pytest.approx(tuple(head[n - 1]))  # an orphan follows its ancestor


def _dense(spark, n, seed=3):
    """Clouds in which all points lie within each other's reach, with exact copies of places."""
    r = np.random.default_rng(seed)
    rows = [(c, i, *map(float, r.integers(0, 40, 3) / 100)) for c in (1, 2) for i in range(n)]
    return rows, spark.createDataFrame(rows, "cloud_id long, point_id long, x double, y double, z double")


def _brute(source, target, k, limit=float("inf")):
    d2 = lambda a, b: (a[2] - b[2]) * (a[2] - b[2]) + (a[3] - b[3]) * (a[3] - b[3]) + (a[4] - b[4]) * (a[4] - b[4])
    return {(a[0], a[1]): sorted((d2(a, b), b[1]) for b in target if a[0] == b[0] and d2(a, b) <= limit)[:k] for a in source}


def test_nearest_in_dense_places_moves_blocks_not_pairs(spark):
    """One row of points a block is moved, however many targets lie in reach."""
    from terrane.operators import blocks

    rows, df = _dense(spark, 700)
    own = df.where("point_id % 2 = 0")
    other = df.where("point_id % 2 = 1")
    got = {(r.cloud_id, r.source_id): (r.d2, r.target_id) for r in neighbours.nearest(own, other, 0.2, ["cloud_id"]).collect()}
    want = _brute([x for x in rows if x[1] % 2 == 0], [x for x in rows if x[1] % 2], 1)
    assert got == {k: v[0] for k, v in want.items()}
    packed = blocks.in_blocks(df, ["cloud_id"])
    assert packed.count() <= 2 * -(-700 // 256) + 4 and packed.agg(F.sum("n")).first()[0] == 1400
    alone = neighbours.nearest(own.drop("cloud_id").where("point_id < 9"), other.where("cloud_id = 1").drop("cloud_id"), 0.2)
    assert alone.count() == 10


def test_nearest_in_one_place_takes_the_least_ids(spark):
    rows = [(1, i, 0.5, 0.5, 0.5) for i in range(3000)]
    df = spark.createDataFrame(rows, "cloud_id long, point_id long, x double, y double, z double")
    got = neighbours.k_nearest_any(df, 4, 0.1).groupBy("source_id").agg(F.sort_array(F.collect_list("target_id")).alias("t"))
    assert got.count() == 3000 and {tuple(r.t) for r in got.collect()} == {(0, 1, 2, 3)}


def test_registration_packs_again_what_moved_out_of_its_reach(spark):
    """Poses far from those that rows were packed for find their targets too, and rounds move no points."""
    from terrane.operators.blocks import in_blocks

    rows = [(k, i, float(i), 0.0, 0.0) for k in (1, 2) for i in range(40)]
    p = spark.createDataFrame(rows, "pair_id long, point_id long, x double, y double, z double")
    mine, theirs = (in_blocks(x, ["pair_id"], 16) for x in (p, p.withColumn("y", F.col("pair_id") * 3.0)))
    poses = lambda far: p.select("pair_id").distinct().withColumn("pose", g.pose(F.lit(0.0), F.when(F.col("pair_id") == 2, far).otherwise(0.0), F.lit(0.0)))
    packed = registration._reachable(mine, theirs, poses(0.0), 0.5)
    names = ["point_id", "x", "y", "z"]
    sums = [F.count("d2").alias("n"), F.sum("d2").alias("d2"), F.sum((F.col("s_x") == F.col("t_point_id")).cast("long")).alias("same")]
    found, again = registration._summed(packed, poses(6.0), mine, theirs, (names, names), 0.5, sums)
    assert [(r.pair_id, r.n, r.d2, r.same) for r in found.collect()] == [(2, 40, 0.0, 40)] and len(again) == 2
    found, more = registration._summed(again, poses(6.0), mine, theirs, (names, names), 0.5, sums)
    assert [(r.pair_id, r.n) for r in found.collect()] == [(2, 40)] and len(more) == 2
    t = {"point_id": np.array([5, 3, 9]), "x": np.array([1.0, 1.0, 9.0]), "y": np.zeros(3), "z": np.zeros(3)}
    at, which, d2 = registration.nearest_within(np.array([[1.0, 0.1, 0.0], [4.0, 0.0, 0.0]]), t, 0.5)
    assert list(at) == [0] and t["point_id"][which[0]] == 3 and d2[0] == pytest.approx(0.01)


def test_neighbourhood_has_the_voxels_around_each_point(spark):
    p = spark.createDataFrame([(i, i * 0.37 - 3, 1.9 - i * 0.11, i * 0.05) for i in range(60)], "point_id long, x double, y double, z double")
    for radius, size in ((2.5, 2.0), (0.3, 1.0), (1.0, 0.8)):
        want = p.select("point_id", F.explode(g.voxels_around("x", "y", "z", radius, size)).alias("v")).select("point_id", "v.*")
        got = voxel.neighbourhood(p, radius, size).select("point_id", *voxel.VOXEL)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_ransac_stops_at_a_hypothesis_that_fits_all():
    class Counted(np.ndarray):
        tried = 0

        def __matmul__(self, other):
            Counted.tried += 1
            return np.asarray(self) @ other

    p = np.random.default_rng(1).uniform(-1, 1, (50, 3))
    pose, n = features.best_pose(p.view(Counted), p + 0.5, 0.01, 0.5, 1_000_000, 0.99, 7)
    assert n == 50 and np.allclose(pose[:3, 3], 0.5) and Counted.tried <= 4


def test_segments_stream_through_sessions(spark):
    """Sessions of a task follow one another without a call for each."""
    rows = [(s, t, t, float(t % 40), 0.0, 0.0, float(t % 40), 0.0, 0.0, 1) for s in range(30) for t in range(60)]
    df = spark.createDataFrame(rows, "session_id long, t_ticks long, event_id long, tx double, ty double, tz double, cx double, cy double, cz double, n long")
    out = mapping.segment_submaps(df, radius=6.0, least_scans=5)
    assert "FlatMapGroups" not in out._jdf.queryExecution().toString()
    got = {}
    for r in out.collect():
        got.setdefault(r.session_id, []).append(tuple(r)[1:])
    want = mapping.take_scans(mapping.Segmenter(radius=6.0, least_scans=5), 0, df.where("session_id = 0").toPandas())
    assert len(got) == 30 and all(sorted(v) == sorted(tuple(x)[1:] for x in want.itertuples(index=False, name=None)) for v in got.values())


def test_windows_of_the_point_view_get_tasks_by_its_size(spark, monkeypatch):
    from terrane.plans import views

    monkeypatch.setattr(views, "_ROWS", 500)
    p = views.view(spark, "/root/testdata/sf0.001", "points_v")
    assert p.rdd.getNumPartitions() == -(-spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").count() // 500)


def test_long_graphs_are_eliminated_in_few_rounds(spark, monkeypatch):
    monkeypatch.setattr(posegraph, "_NODES", 4)
    monkeypatch.setattr(posegraph, "_FAN", 3)
    monkeypatch.setattr(posegraph, "_by_gradients", None)
    rng = random.Random(6)
    nodes, edges = [], []
    for graph in (1, 2):
        at = [(k + rng.uniform(-0.1, 0.1), rng.uniform(-0.1, 0.1)) for k in range(40 * graph)]
        nodes += [(graph, k, *p) for k, p in enumerate(at)]
        pairs = [(k + 1, k) for k in range(len(at) - 1) if k != 9] + [(k + s, k) for s in (3, 5, 17) for k in range(0, len(at) - s, 2)]
        edges += [(graph, s, t, s - t + rng.uniform(-0.02, 0.02), rng.uniform(-0.02, 0.02), 2.0, s - t > 1) for s, t in pairs]
    n = spark.createDataFrame(nodes, "graph_id long, node_id long, x double, y double").select("graph_id", "node_id", g.planar_pose("x", "y", F.lit(0.0), F.col("y") * 0.02).alias("pose"))
    e = spark.createDataFrame(edges, "graph_id long, source_id long, target_id long, x double, y double, weight double, uncertain boolean").select("graph_id", "source_id", "target_id", g.planar_pose("x", "y", F.lit(0.0), F.col("y") * 0.02).alias("pose"), "weight", "uncertain")
    got, want = ({(r.graph_id, r.node_id): list(r.pose) for r in posegraph.solve(n, e, rounds=2, direct=d).collect()} for d in (0, 10_000))
    assert len(want) == 120 and got.keys() == want.keys()
    assert max(abs(a - b) for k in want for a, b in zip(got[k], want[k])) < 1e-6


def test_odometry_packs_each_scan_once(spark, monkeypatch):
    rng = random.Random(2)
    world = [(i, rng.uniform(0, 4), rng.uniform(0, 4), rng.uniform(0, 4)) for i in range(80)]
    rows = [(1, t, i, x - 0.02 * t, y, z) for t in range(3) for i, x, y, z in world] + [(1, 2, 99, None, 0.0, 0.0), (2, 0, 0, 0.0, 0.0, 0.0), (3, 0, 0, None, 0.0, 0.0), (3, 1, 0, 1.0, 0.0, 0.0)]
    scans = spark.createDataFrame(rows, "session_id long, t_ticks long, point_id long, x double, y double, z double")
    packed, in_blocks = [], registration.in_blocks

    def counted(points, *more, **named):
        packed.append(points)
        return in_blocks(points, *more, **named)

    monkeypatch.setattr(registration, "in_blocks", counted)
    found, path = registration.odometry(scans, "PointToPoint", 0.3)
    got = {r.pair_id: r for r in found.collect()}
    assert len(packed) == 1 and set(got) == {"1/1", "1/2", "3/1"}
    assert (got["1/1"].n_source, got["1/2"].n_source, got["3/1"].n_source, got["3/1"].n_corr) == (80, 81, 1, 0)
    assert [round(r.product.tx, 4) for r in path.where("session_id = 1").orderBy("t_ticks").collect()][-1] == 0.04


@pytest.mark.parametrize("sent", [500_000, 10])
def test_sources_of_a_crowded_cell_are_dealt_into_tasks(spark, monkeypatch, sent):
    monkeypatch.setattr(neighbours, "_TARGETS", 20)
    monkeypatch.setattr(neighbours, "_SENT", sent)
    rng = random.Random(3)
    xyz = [(i, rng.random(), rng.random(), rng.random()) for i in range(120)]
    p = spark.createDataFrame(xyz, "point_id long, x double, y double, z double").coalesce(1)
    got = neighbours.radius_pairs(p, p, 2.0)
    assert sorted((r.source_id, r.target_id) for r in got.collect()) == [(a, b) for a in range(120) for b in range(120)]
    if sent > 120:
        assert got.select(F.spark_partition_id()).distinct().count() > 2


@pytest.mark.parametrize("radius", [None, 0.1])
def test_a_block_of_targets_goes_to_a_group_of_source_blocks_once(spark, monkeypatch, radius):
    monkeypatch.setattr(blocks, "_GROUP", 2)
    rng = np.random.default_rng(4)
    xyz, cloud = np.round(rng.random((3000, 3)), 3), rng.integers(0, 2, 3000)
    rows = [(int(c), i, *map(float, p)) for i, (c, p) in enumerate(zip(cloud, xyz, strict=True))]
    points = spark.createDataFrame(rows, "cloud_id long, point_id long, x double, y double, z double")
    found = blocks.k_best(points, points, 3, ["cloud_id"], radius)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "group" in plan and "Aggregate [cloud_id" in plan  # pairs of group and target block are distinct
    got = sorted((r.s_point_id, r["rank"], r.t_point_id) for r in found.collect())
    want = []
    for i, p in enumerate(xyz):
        d2 = ((p - xyz) ** 2).T
        d2 = d2[0] + d2[1] + d2[2]
        near = [j for j in np.lexsort((np.arange(len(d2)), d2)) if cloud[j] == cloud[i] and (radius is None or d2[j] <= radius * radius)][:3]
        want += [(i, n, int(j)) for n, j in enumerate(near, 1)]
    assert got == want


def test_pairs_of_small_clouds_need_no_rounds(spark, monkeypatch):
    """Also where the packing cuts a pair apart."""
    rows = [(f"{p}", k, float(k % 7), float(k % 5) * 1.3, float(k % 11) * 0.7) for p in range(5) for k in range(80)]
    target = spark.createDataFrame(rows, "pair_id string, point_id long, x double, y double, z double")
    source = target.withColumn("x", F.col("x") - 0.1).withColumn("y", F.col("y") + 0.05)
    monkeypatch.setattr(registration, "_summed", None)
    got = registration.register(source, target, "PointToPoint", 0.3, rounds=10).collect()
    assert len(got) == 5 and all(r.n_corr == 80 and r.settled and abs(r.pose.tx - 0.1) < 1e-6 and abs(r.pose.ty + 0.05) < 1e-6 for r in got)


def test_scans_of_small_sessions_are_registered_side_by_side(spark, monkeypatch):
    """As in rounds, also with ties, points without a place, empty scans and large sessions among small ones."""
    rng = random.Random(9)
    rows = []
    for session, size in ((1, 60), (2, 60), (3, 300)):
        world = [tuple(rng.choice([rng.uniform(0, 4), rng.randint(0, 8) / 2]) for _ in range(3)) for _ in range(size)]
        rows += [(session, t, i, x - 0.03 * t, y + 0.02 * t * session, z) for t in range(3) for i, (x, y, z) in enumerate(world)]
    rows += [(1, 5, 0, None, 0.0, 0.0), (1, 6, 0, float("nan"), 0.0, 0.0), (1, 6, 1, 1.0, 1.0, 1.0), (4, 0, 0, 0.0, 0.0, 0.0), (None, 0, 0, 0.0, 0.0, 0.0), (2, None, 0, 0.0, 0.0, 0.0)]
    scans = spark.createDataFrame(rows, "session_id long, t_ticks long, point_id long, x double, y double, z double")
    got, rounds = [], registration._registered
    for most, in_rounds in ((0, rounds), (400, rounds), (10_000, None)):
        monkeypatch.setattr(registration, "_SESSION", most)
        monkeypatch.setattr(registration, "_registered", in_rounds)
        found, path = registration.odometry(scans, "PointToPoint", 0.3)
        got.append(({r.pair_id: r for r in found.collect()}, {(r.session_id, r.t_ticks): r.product for r in path.collect()}))
    (want, steps), *others = got
    assert set(want) == {"1/1", "1/2", "1/5", "1/6", "2/1", "2/2", "3/1", "3/2"}
    for found, path in others:
        assert found.keys() == want.keys() and path.keys() == steps.keys()
        for k, r in want.items():
            assert found[k][2:5] == r[2:5] and found[k].settled == r.settled and found[k].accepted == r.accepted
            assert (found[k].inlier_rmse is None) == (r.inlier_rmse is None) and (found[k].inlier_rmse or 0.0) == pytest.approx(r.inlier_rmse or 0.0, abs=1e-9)
            assert tuple(found[k].pose) == pytest.approx(tuple(r.pose), abs=1e-9)


@pytest.mark.parametrize("listed", [0, 16])
def test_pairs_side_by_side_end_where_single_ones_do(monkeypatch, listed):
    from terrane.operators import fits

    monkeypatch.setattr(fits, "_LISTED", listed)  # 0: no targets are listed, each round searches them
    rng = np.random.default_rng(5)
    _, solve, terms = registration._REGISTRATIONS["PointToPoint"]
    clouds = [rng.integers(0, 9, (n, 3)) / 2 + (0 if n % 2 else 0.1 * rng.random((n, 3))) for n in (40, 3, 55, 0, 70)]
    moved_ = [c + (0.05 * k, -0.1, 0.02 * k) for k, c in enumerate(clouds)]
    of = np.repeat(np.arange(5), [len(c) for c in clouds])
    ids = np.concatenate([rng.permutation(len(c)) for c in clouds])
    rest = np.tile([0.0, 0, 0, 0, 0, 0, 1], (5, 1))

    def fit(k):
        on = np.isin(of, k)
        return fits.fit_all(np.concatenate(clouds)[on], np.searchsorted(k, of[on]), np.concatenate(moved_)[on], np.searchsorted(k, of[on]), ids[on], rest[k], 0.4, 20, solve, terms)

    together = fit(np.arange(5))
    for k in range(5):
        for a, b in zip(together, fit(np.array([k])), strict=True):
            assert a[k] == pytest.approx(b[0], abs=1e-12, nan_ok=True)
    assert together[2].tolist()[3] == 0 and (together[2][[0, 2, 4]] > 20).all()
    new = fits.placed(clouds[2], together[0][2:3], np.zeros(55, int))
    order = np.argsort(ids[of == 2])
    at, which, d2 = registration.nearest_within(new, {c: moved_[2][order, k] for k, c in enumerate("xyz")} | {"point_id": np.arange(55)}, 0.4)
    i, j, e2 = fits._nearest(new, moved_[2][order], 0.4)
    assert len(i) == together[2][2] and dict(zip(at.tolist(), which.tolist(), strict=True)) == dict(zip(i.tolist(), j.tolist(), strict=True)) and np.allclose(np.sort(d2), np.sort(e2))


def test_poses_of_made_scans_stay_short_expressions(spark):
    from terrane import catalog

    scans = catalog._session_scans(spark, "/root/testdata/sf0.001", 3)
    assert len(scans._jdf.queryExecution().analyzed().toString()) < 40_000
