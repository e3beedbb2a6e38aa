"""Submaps: cutting a session into them, building them, closing loops and correcting the map."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terrane.functions.geometry import pose, pose_mul
from terrane.operators import posegraph
from terrane.operators.carving import carve, carve_dense
from terrane.operators.crop import color_in_range, consistency_reasons, crop_predicate
from terrane.operators.features import fpfh, ransac
from terrane.operators.graph import apply_corrections, resolved_ancestor
from terrane.operators.neighbours import correspondences, information_matrix, mutual_matches, normals
from terrane.operators.registration import moved, register
from terrane.operators.voxel import dense_state, downsample, downsample_within, overlap, overlapping_points, with_voxel
from terrane.plans.lineage import cut


@dataclass
class Segmenter:
    """State machine of one session; the same in batch and in streams.

    Decision per scan, first match wins: forced: create; too few scans in the active submap:
    keep; nearest centre not within the radius: create; nearest is active: keep; nearest is
    adjacent and overlaps enough: switch; active centre out of the radius: create; else keep.

    The overlap is the share of the scan's points in coarse cells that the nearest submap
    occupies.  Of each submap the occupied cells are kept; scans that are replayed into a
    submap count there too.
    """

    radius: float = 20.0
    least_scans: int = 5
    least_overlap: float = 0.4
    replay: int = 3
    active: int = -1
    scans: int = 0
    origins: list = field(default_factory=list)
    sums: list = field(default_factory=list)
    finished: set = field(default_factory=set)
    edges: set = field(default_factory=set)
    recent: list = field(default_factory=list)
    occupied: list = field(default_factory=list)
    parents: list = field(default_factory=list)

    def center(self, k: int) -> tuple:
        n, *s = self.sums[k]
        return tuple(v / n for v in s) if k in self.finished and n else self.origins[k]

    def overlap(self, k: int, cells: dict[int, int]) -> float:
        """Share of a scan's points, given by cell, that lie in occupied cells of a submap."""
        return sum(n for c, n in cells.items() if c in self.occupied[k]) / max(1, sum(cells.values()))

    def step(self, scan: int, place: tuple, centroid: tuple, points: int, cells: dict[int, int] | None = None, forced: bool = False) -> tuple[int, int, list[int]]:
        """(submap that takes the scan, submap active afterwards, scans that the latter gets again).

        ``cells`` are the scan's points by coarse cell of the map; without them every overlap
        is taken as sufficient.
        """
        self.recent = [*self.recent, (scan, frozenset(cells or ()))][-self.replay :]
        if self.active < 0:
            self._create(place)
        before = self.active
        target = self._choose(place, cells, forced)
        if target is None:
            self._create(place)
        else:
            self.active = target
        n, *s = self.sums[before]
        self.sums[before] = [n + points, *(a + points * c for a, c in zip(s, centroid, strict=True))]
        self.scans += 1
        self.occupied[before] |= set(cells or ())
        if self.active == before:
            return before, before, []
        self.finished.add(before)
        self.edges.add((min(before, self.active), max(before, self.active)))
        self.scans = 0
        again, self.recent = self.recent, []
        for _, own in again:
            self.occupied[self.active] |= own
        return before, self.active, [scan for scan, _ in again]

    def _create(self, place: tuple) -> None:
        self.origins.append(place)
        self.sums.append([0, 0.0, 0.0, 0.0])
        self.occupied.append(set())
        self.active = len(self.origins) - 1

    def _choose(self, place: tuple, cells: dict[int, int] | None, forced: bool) -> int | None:
        def far(k: int) -> float:
            return sum((a - b) ** 2 for a, b in zip(place, self.center(k), strict=True)) ** 0.5

        if forced:
            return None
        if self.scans < self.least_scans:
            return self.active
        nearest = min(range(len(self.origins)), key=lambda k: (far(k), k))
        if far(nearest) >= self.radius:
            return None
        if nearest == self.active:
            return self.active
        if (min(nearest, self.active), max(nearest, self.active)) in self.edges and (cells is None or self.overlap(nearest, cells) > self.least_overlap):
            return nearest
        return None if far(self.active) > self.radius else self.active


SEGMENTS = "session_id long, t_ticks long, event_id long, submap_id long, active_after long, parent_id long, replayed array<long>"


def scan_cells(points: DataFrame, size: float) -> DataFrame:
    """(session_id, event_id, cells, counts): each scan's points, in the map frame, by coarse cell."""
    per = with_voxel(points, size).groupBy("session_id", "event_id", F.xxhash64("vx", "vy", "vz").alias("cell")).agg(F.count("*").alias("n"))
    both = F.sort_array(F.collect_list(F.struct("cell", "n")))
    return per.groupBy("session_id", "event_id").agg(both.alias("b")).select("session_id", "event_id", F.col("b.cell").alias("cells"), F.col("b.n").alias("counts"))


def take_scans(s: Segmenter, session: int, scans: pd.DataFrame) -> pd.DataFrame:
    """The rows of ``SEGMENTS`` for one session's next scans, which are taken in the order of time; ``s`` moves on."""
    place = {c: i for i, c in enumerate(scans.columns)}
    rows = scans.sort_values(["t_ticks", "event_id"], kind="stable").itertuples(index=False, name=None)
    return pd.DataFrame(taken(s, session, rows, place), columns=_COLUMNS)


_COLUMNS = ["session_id", "t_ticks", "event_id", "submap_id", "active_after", "parent_id", "replayed"]


def taken(s: Segmenter, session: int, rows: Iterable[tuple], place: dict[str, int]) -> list[tuple]:
    """The same of rows in the order of time, whose columns stand at ``place``."""
    time, event, n, with_cells = place["t_ticks"], place["event_id"], place["n"], "cells" in place
    at, middle = ([place[f"{e}{c}"] for c in "xyz"] for e in "tc")
    out = []
    for r in rows:
        known, before = len(s.origins), s.active
        cells = dict(zip(r[place["cells"]], r[place["counts"]], strict=True)) if with_cells and r[place["cells"]] is not None else None
        into, after, again = s.step(int(r[event]), tuple(r[i] for i in at), tuple(r[i] for i in middle), int(r[n]), cells)
        s.parents += [max(before, 0)] * (len(s.origins) - known)
        out.append((session, r[time], r[event], into, after, s.parents[into], again))
    return out


def segment_submaps(scans: DataFrame, **settings: float) -> DataFrame:
    """The submap of each scan: ``scans`` is (session_id, t_ticks, event_id, tx, ty, tz, cx, cy, cz, n[, cells, counts]), one row a scan.

    ``cells`` and ``counts`` come from ``scan_cells``; without them, or where they are null,
    overlap with a revisited submap is taken as sufficient.  One small row a scan; a task
    streams through its sessions in order and holds the state of one.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, state = None, None
        for t in batches:
            out = []
            for session, part in t.groupby("session_id", sort=False, dropna=False):
                if state is None or session != now:
                    now, state = session, Segmenter(**settings)
                out += taken(state, session, part.itertuples(index=False, name=None), place)
            yield pd.DataFrame(out, columns=_COLUMNS)

    place = {c: i for i, c in enumerate(scans.columns)}
    parts = max(int(scans.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    return scans.repartition(parts, "session_id").sortWithinPartitions("session_id", "t_ticks", "event_id").mapInPandas(run, SEGMENTS)


def build_submaps(points: DataFrame, poses: DataFrame, size: float, radius: float, carving: dict | None = None) -> DataFrame:
    """Submap clouds: scans moved by their poses, voxel means within ``radius`` of the last pose, carved on request.

    ``points``: (submap_id, pair_id, point_id, x, y, z[, nx, ny, nz]); ``poses``: (pair_id, pose).
    """
    placed = moved(points, poses)
    last = points.select("submap_id", "pair_id").distinct().join(poses, "pair_id").groupBy("submap_id").agg(F.max_by("pose", "pair_id").alias("last"))
    cloud = placed.join(last, "submap_id")
    if carving:
        sensor = points.select("submap_id", "pair_id").distinct().join(poses, "pair_id").select("pair_id", *(F.col(f"pose.t{c}").alias(f"s{c}") for c in "xyz"))
        rays = placed.join(sensor, "pair_id").select("submap_id", F.col("point_id").alias("ray_id"), "x", "y", "z", "sx", "sy", "sz")
        cloud = carve(cloud, rays, **carving)
    inside = crop_predicate("MaxRadius", tuple(F.col(f"last.t{c}") for c in "xyz"), radius=radius)
    return downsample_within(cloud.withColumn("scan_id", F.col("submap_id")), size, inside).withColumnRenamed("scan_id", "submap_id")


def dense_map(points: DataFrame, poses: DataFrame, size: float, kind: str, colors: tuple[float, float] = (0.0, 1.0), carving: dict | None = None, **cropper: float) -> DataFrame:
    """Mergeable dense coloured voxels of each submap: crop, colour filter, move, sum, carve."""
    kept = points.filter(crop_predicate(kind, **cropper) & color_in_range(*colors))
    placed = moved(kept, poses)
    if carving:
        sensor = poses.select("pair_id", *(F.col(f"pose.t{c}").alias(f"s{c}") for c in "xyz"))
        rays = placed.join(sensor, "pair_id").select("submap_id", F.col("point_id").alias("ray_id"), "x", "y", "z", "sx", "sy", "sz")
        placed = carve_dense(placed, rays, size, **carving)
    return dense_state(placed, size, by=("submap_id",), extra=("r", "g", "b"))


def submap_features(clouds: DataFrame, voxel_size: float, normal_radius: float, normal_k: int, radius: float, k: int) -> DataFrame:
    """Sparse cloud of each submap with normals and descriptors: (cloud_id, point_id, x, y, z, nx, ny, nz, fpfh)."""
    sparse = downsample(clouds, voxel_size, by=("cloud_id",))
    ids = F.row_number().over(Window.partitionBy("cloud_id").orderBy("vx", "vy", "vz")).cast("long")
    sparse = cut(sparse.select("cloud_id", ids.alias("point_id"), "x", "y", "z"))
    n = normals(sparse, normal_radius, normal_k).where("not isnan(nx)").select("cloud_id", "point_id", "nx", "ny", "nz")
    full = sparse.join(n, ["cloud_id", "point_id"])
    return cut(full.join(fpfh(full, radius, k), ["cloud_id", "point_id"]))


@dataclass(frozen=True)
class LoopSettings:
    ransac_distance: float = 0.75
    ransac_edge: float = 0.5
    ransac_hypotheses: int = 1_000_000
    least_matches: int = 25
    overlap_voxel: float = 1.0
    overlap_points: int = 1
    icp_distance: float = 0.3
    least_fitness: float = 0.7


def close_loops(candidates: DataFrame, features: DataFrame, s: LoopSettings | None = None, **limits: tuple) -> DataFrame:
    """Each candidate pair (source, target) with a status, and pose and information where accepted.

    Feature matches, RANSAC, consistency, overlap, point-to-plane refinement, gates again.
    """
    s = s or LoopSettings()
    f = features.select("cloud_id", F.col("point_id").alias("vec_id"), F.col("fpfh").alias("f"))
    pair = F.concat_ws("/", "source", "target").alias("pair_id")
    m = mutual_matches(f, candidates.select("source", "target"))
    xyz = features.select("cloud_id", "point_id", "x", "y", "z")
    src = xyz.select(F.col("cloud_id").alias("source"), F.col("point_id").alias("a"), *(F.col(c).alias(f"s{c}") for c in "xyz"))
    tgt = xyz.select(F.col("cloud_id").alias("target"), F.col("point_id").alias("b"), *(F.col(c).alias(f"t{c}") for c in "xyz"))
    matches = m.join(src, ["source", "a"]).join(tgt, ["target", "b"]).select(pair, *(f"s{c}" for c in "xyz"), *(f"t{c}" for c in "xyz"))
    coarse = cut(ransac(matches, s.ransac_distance, s.ransac_edge, s.ransac_hypotheses))
    reasons = consistency_reasons(F.col("pose"), **limits)
    good = coarse.where((F.col("n_inliers") >= s.least_matches) & (F.size(reasons) == 0)).select("pair_id", "pose")
    keyed = candidates.select("source", "target", pair)
    points = ["point_id", "x", "y", "z", "nx", "ny", "nz"]
    a = keyed.join(features, keyed.source == features.cloud_id).select("pair_id", *points).join(good.select("pair_id"), "pair_id", "left_semi")
    b = keyed.join(features, keyed.target == features.cloud_id).select("pair_id", *points).join(good.select("pair_id"), "pair_id", "left_semi")
    shared = overlap(moved(a, good), b, s.overlap_voxel, s.overlap_points)
    near_a = a.join(overlapping_points(moved(a, good), shared, s.overlap_voxel).select("pair_id", "point_id"), ["pair_id", "point_id"], "left_semi")
    near_b = overlapping_points(b, shared, s.overlap_voxel)
    fine = register(near_a, near_b, "PointToPlane", s.icp_distance, good, rounds=30)
    refined = fine.select("pair_id", "pose", "fitness", "inlier_rmse")
    info = information_matrix(correspondences(moved(near_a, refined.select("pair_id", "pose")), near_b, s.icp_distance))
    out = keyed.join(coarse.withColumnsRenamed({"pose": "coarse_pose"}), "pair_id", "left").join(refined, "pair_id", "left").join(info, "pair_id", "left")
    status = (
        F.when(F.col("n_inliers").isNull() | (F.col("n_inliers") < s.least_matches), "too few matches")
        .when(F.col("pose").isNull(), "inconsistent")
        .when(F.col("fitness") < s.least_fitness, "poor fit")
        .when(F.size(consistency_reasons(F.col("pose"), **limits)) > 0, "inconsistent")
        .otherwise("accepted")
    )
    return out.withColumn("status", status)


def odometry_constraints(submaps: DataFrame, clouds: DataFrame, size: float, radius: float) -> DataFrame:
    """Edge from each submap to its parent, with the information of the points they share.

    Clouds are in the map frame already, so the unrefined edge is rest.
    """
    pairs = submaps.where("parent_id <> submap_id").select(F.concat_ws("/", "submap_id", "parent_id").alias("pair_id"), F.col("submap_id").alias("source_id"), F.col("parent_id").alias("target_id"))
    a = pairs.join(clouds, pairs.source_id == clouds.cloud_id).select("pair_id", "point_id", "x", "y", "z")
    b = pairs.join(clouds, pairs.target_id == clouds.cloud_id).select("pair_id", "point_id", "x", "y", "z")
    shared = overlap(a, b, size, 1)
    near = correspondences(overlapping_points(a, shared, size), overlapping_points(b, shared, size), radius)
    return pairs.join(information_matrix(near), "pair_id", "left").withColumn("pose", pose(0.0, 0.0, 0.0))


def correct(points: DataFrame, poses: DataFrame, submaps: DataFrame, nodes: DataFrame, edges: DataFrame, preference: float = 2.0) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Optimise the pose graph and apply it: (points, poses, corrections), orphans moved as their nearest corrected ancestor."""
    solved = posegraph.solve(nodes, edges, preference=preference).select(F.col("node_id").alias("ancestor"), "pose")
    up = resolved_ancestor(submaps, nodes.select(F.col("node_id").alias("submap_id")))
    corrections = cut(up.join(solved, "ancestor").select("submap_id", "pose"))
    moved_poses = poses.join(corrections.withColumnRenamed("pose", "__c"), "submap_id", "left").withColumn("pose", F.when(F.col("__c").isNull(), F.col("pose")).otherwise(pose_mul(F.col("__c"), F.col("pose")))).drop("__c")
    return apply_corrections(points, corrections), moved_poses, corrections


def map_in_blocks(scans: DataFrame, odometry: DataFrame, block: int, kind: str, radius: float, size: float, least_fitness: float = 0.7) -> tuple[DataFrame, DataFrame]:
    """Refine scans against the growing map, ``block`` scans of every session at a time: (poses, map).

    ``scans``: (session_id, k, point_id, x, y, z, ...), k counting from 0; ``odometry``:
    (session_id, k, pose).  Within a block scans see the map of the blocks before, so a block
    of one is the strictly sequential order.  Rejected scans keep their predicted pose and
    add nothing to the map.
    """
    last = scans.agg(F.max("k")).first()[0]
    poses = map_ = None
    for start in range(0, (last or 0) + 1, block):
        now = scans.where(F.col("k").between(start, start + block - 1)).withColumn("pair_id", F.concat_ws("/", "session_id", "k"))
        guess = odometry.where(F.col("k").between(start, start + block - 1)).withColumn("pair_id", F.concat_ws("/", "session_id", "k"))
        if map_ is None:
            found = guess.select("session_id", "k", "pair_id", "pose", F.lit(1.0).alias("fitness"))
        else:
            keys = guess.select("session_id", "k", "pair_id")
            target = keys.join(map_, "session_id").drop("session_id", "k")
            fit = register(now.drop("session_id", "k"), target, kind, radius, guess.select("pair_id", "pose"), rounds=20)
            found = keys.join(fit, "pair_id").select("session_id", "k", "pair_id", "pose", "fitness")
        found = cut(found)
        good = found.where(F.col("fitness") >= least_fitness).select("pair_id", "pose")
        fresh = moved(now, good).select("session_id", "point_id", "x", "y", "z")
        every = fresh if map_ is None else map_.select("session_id", "point_id", "x", "y", "z").unionByName(fresh)
        thin = with_voxel(every, size).groupBy("session_id", "vx", "vy", "vz").agg(F.min("point_id").alias("point_id"), *(F.avg(c).alias(c) for c in "xyz"))
        map_ = cut(thin.drop("vx", "vy", "vz"))
        poses = found if poses is None else poses.unionByName(found)
    return poses, map_


def replay_rows(segments: DataFrame) -> DataFrame:
    """(session_id, submap_id, event_id, carve): every scan in its submap, and again, uncarved, in the one that follows."""
    own = segments.select("session_id", "submap_id", "event_id", F.lit(True).alias("carve"))
    again = segments.select("session_id", F.col("active_after").alias("submap_id"), F.explode("replayed").alias("event_id"), F.lit(False).alias("carve"))
    return own.unionByName(again)
