"""Submap adjacency, parents, loop candidates, constraints and pose graphs."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrane.functions.geometry import pose_apply, pose_inv, pose_mul
from terrane.operators.neighbours import nearest, radius_pairs
from terrane.plans.lineage import cut


def undirected(edges: DataFrame) -> DataFrame:
    """Each edge (src, dst) both ways, once; loops to itself left out."""
    e = edges.where("src <> dst").select("src", "dst")
    return e.union(e.select("dst", "src")).distinct()


def adjacency_lists(edges: DataFrame) -> DataFrame:
    return undirected(edges).groupBy("src").agg(F.array_sort(F.collect_set("dst")).alias("neighbours"))


def is_adjacent(pairs: DataFrame, edges: DataFrame) -> DataFrame:
    """Flag for each (a, b): equal or joined by an edge."""
    both = undirected(edges).select(F.col("src").alias("a"), F.col("dst").alias("b"), F.lit(True).alias("edge"))
    return pairs.join(both, ["a", "b"], "left").withColumn("adjacent", (F.col("a") == F.col("b")) | F.coalesce("edge", F.lit(False))).drop("edge")


def loop_distance(nodes: DataFrame, edges: DataFrame, checkpoint_every: int = 4) -> DataFrame:
    """Hops from each node (id, is_lc) to the nearest marked one, less one and not below zero; null if none is reachable.

    Breadth first from all marked nodes at once; one join a round over the frontier alone.
    """
    both = undirected(edges)
    seen = nodes.where("is_lc").select("id", F.lit(0).alias("hops")).distinct()
    front, hops = seen, 0
    while not front.isEmpty():
        hops += 1
        front = both.join(front, both.src == front.id).select(F.col("dst").alias("id")).distinct().join(seen, "id", "left_anti").withColumn("hops", F.lit(hops))
        seen = seen.union(front)
        if hops % checkpoint_every == 0:
            seen, front = cut(seen), cut(front)
    return nodes.join(seen, "id", "left").select("id", F.when(F.col("hops").isNotNull(), F.greatest(F.col("hops") - 1, F.lit(0))).alias("distance"))


def resolved_ancestor(submaps: DataFrame, optimised: DataFrame, limit: int = 64) -> DataFrame:
    """For each submap the nearest optimised one on its parent chain, itself included: (submap_id, ancestor, depth).

    Pointer jumping: each round doubles the reach, so a chain of n needs log n joins.  A
    submap without such an ancestor gets null; ``limit`` rounds mean a cycle.
    """
    good = optimised.select(F.col("submap_id").alias("g")).distinct().withColumn("good", F.lit(True))
    state = submaps.join(good, F.col("submap_id") == F.col("g"), "left").select("submap_id", F.when(F.col("good"), F.col("submap_id")).alias("ancestor"), F.when(F.col("good"), 0).otherwise(1).alias("depth"), F.when(F.col("good") | (F.col("parent_id") == F.col("submap_id")), F.lit(None)).otherwise(F.col("parent_id")).alias("jump"))
    for _ in range(limit):
        if state.where("jump is not null").isEmpty():
            return state.select("submap_id", "ancestor", F.when(F.col("ancestor").isNotNull(), F.col("depth")).alias("depth"))
        far = state.select(F.col("submap_id").alias("s"), F.col("ancestor").alias("a2"), F.col("jump").alias("j2"), F.col("depth").alias("d2"))
        step = state.join(far, F.col("jump") == F.col("s"), "left")
        state = cut(step.select("submap_id", F.coalesce("ancestor", "a2").alias("ancestor"), F.when(F.col("jump").isNull(), F.col("depth")).otherwise(F.col("depth") + F.coalesce("d2", F.lit(0))).alias("depth"), F.when(F.col("a2").isNull(), F.col("j2")).alias("jump")))
    raise ValueError("the parent chain has a cycle")


def nearest_submap(poses: DataFrame, submaps: DataFrame, radius: float = 16.0) -> DataFrame:
    """The submap of the least distance from each pose (ties: the least id): (pose_id, submap_id, d2).

    Searched among blocks of submaps, so that it grows with the number of poses, not with how dense submaps lie.
    """
    p = poses.select(F.col("pose_id").alias("point_id"), F.col("tx").alias("x"), F.col("ty").alias("y"), F.col("tz").alias("z"))
    s = submaps.select(F.col("submap_id").alias("point_id"), F.col("cx").alias("x"), F.col("cy").alias("y"), F.col("cz").alias("z"))
    return nearest(p, s, radius).select(F.col("source_id").alias("pose_id"), F.col("target_id").alias("submap_id"), "d2")


#: Edges that are sent to the tasks; more of them are joined.
_SENT = 1_000_000


def loop_candidates(submaps: DataFrame, edges: DataFrame, radius: float, size: float, active: Column | None = None, distances: DataFrame | None = None, least_distance: int = 0) -> DataFrame:
    """Pairs of submaps close in space but not in the graph: (a, b, d2), a < b.

    Centres within ``radius`` (grid join), ids further apart than ceil(radius / size) and not
    successive, not adjacent, neither active, and far enough from the last loop closure.
    """
    p = submaps.select(F.col("submap_id").alias("point_id"), F.col("cx").alias("x"), F.col("cy").alias("y"), F.col("cz").alias("z"), (active if active is not None else F.lit(False)).alias("active")).where("not active").drop("active")
    near = radius_pairs(p, p, radius).select(F.col("source_id").alias("a"), F.col("target_id").alias("b"), "d2").where("a < b")
    gap = max(1, math.ceil(radius / size))
    near = near.where(F.col("b") - F.col("a") > gap)
    both = undirected(edges).select(F.col("src").alias("a"), F.col("dst").alias("b")).where("a < b")
    if both.count() <= _SENT:
        both = F.broadcast(both)  # the pairs, which are many more, stay where they are
    near = near.join(both, ["a", "b"], "left_anti")
    if distances is not None:
        far = distances.where(F.col("distance").isNull() | (F.col("distance") >= least_distance)).select(F.col("id").alias("a"))
        near = near.join(far, "a", "left_semi")
    return near


def new_constraints(old: DataFrame, fresh: DataFrame, order: str) -> DataFrame:
    """Fresh constraints whose (source_id, target_id) is not there yet, the first of each pair by ``order``."""
    first = fresh.groupBy("source_id", "target_id").agg(F.min(F.struct(order, *(c for c in fresh.columns if c not in ("source_id", "target_id", order)))).alias("c"))
    return first.select("source_id", "target_id", "c.*").join(old.select("source_id", "target_id"), ["source_id", "target_id"], "left_anti")


def apply_corrections(points: DataFrame, corrections: DataFrame) -> DataFrame:
    """Points moved by the correction pose of their submap; others stay."""
    c = corrections.select("submap_id", F.col("pose").alias("correction"))
    joined = points.join(c, "submap_id", "left")
    moved = pose_apply(F.col("correction"), "x", "y", "z")
    return joined.withColumns({n: F.when(F.col("correction").isNull(), F.col(n)).otherwise(m) for n, m in zip("xyz", moved, strict=True)}).drop("correction")


def map_to_odometry(map_pose: Column, odometry_pose: Column) -> Column:
    return pose_mul(map_pose, pose_inv(odometry_pose))


def to_json(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One JSON text per graph."""
    n = nodes.groupBy("graph_id").agg(F.sort_array(F.collect_list(F.struct("node_id", "pose"))).alias("nodes"))
    e = edges.groupBy("graph_id").agg(F.sort_array(F.collect_list(F.struct("source_id", "target_id", "pose", "weight", "uncertain"))).alias("edges"))
    return n.join(e, "graph_id", "left").select("graph_id", F.to_json(F.struct("nodes", "edges")).alias("value"))


_POSE = "struct<tx:double,ty:double,tz:double,qx:double,qy:double,qz:double,qw:double>"


def from_json(graphs: DataFrame) -> tuple[DataFrame, DataFrame]:
    kind = f"nodes array<struct<node_id:long,pose:{_POSE}>>, edges array<struct<source_id:long,target_id:long,pose:{_POSE},weight:double,uncertain:boolean>>"
    g = graphs.select("graph_id", F.from_json("value", kind).alias("g"))
    return g.select("graph_id", F.explode("g.nodes").alias("n")).select("graph_id", "n.*"), g.select("graph_id", F.explode("g.edges").alias("e")).select("graph_id", "e.*")


def optimise(nodes: DataFrame, edges: DataFrame, rounds: int = 20, prune: float = 0.2, preference: float = 2.0, reference: int = 0) -> DataFrame:
    """Corrected poses of all graphs: (graph_id, node_id, pose, residual).

    Gauss-Newton with a line process on uncertain edges (Choi, Zhou and Koltun 2015): an edge
    whose residual is large against ``preference`` loses weight and is left out below
    ``prune``.  A graph has as many nodes as a session has submaps, so one group holds one
    graph, and graphs are solved in parallel.
    """
    n = nodes.groupBy("graph_id").agg(F.sort_array(F.collect_list(F.struct("node_id", "pose"))).alias("nodes"))
    e = edges.groupBy("graph_id").agg(F.collect_list(F.struct("source_id", "target_id", "pose", "weight", "uncertain")).alias("edges"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for t in batches:
            for graph, own, ties in zip(t["graph_id"], t["nodes"], t["edges"], strict=True):
                ids, poses, cost = solve_graph(own, ties if ties is not None else [], rounds, prune, preference, reference)
                yield pd.DataFrame({"graph_id": graph, "node_id": ids, "pose": poses, "residual": cost})

    kind = nodes.schema["graph_id"].dataType.simpleString()
    return n.join(e, "graph_id", "left").mapInPandas(run, f"graph_id {kind}, node_id long, pose {_POSE}, residual double")


def _matrix(p: dict) -> np.ndarray:
    x, y, z, w = (p[k] for k in ("qx", "qy", "qz", "qw"))
    m = np.eye(4)
    m[:3, :3] = [[1 - 2 * (y * y + z * z), 2 * (x * y - z * w), 2 * (x * z + y * w)], [2 * (x * y + z * w), 1 - 2 * (x * x + z * z), 2 * (y * z - x * w)], [2 * (x * z - y * w), 2 * (y * z + x * w), 1 - 2 * (x * x + y * y)]]
    m[:3, 3] = p["tx"], p["ty"], p["tz"]
    return m


def matrix_pose(m: np.ndarray) -> dict:
    """Pose of a 4x4 matrix."""
    w2 = max(0.0, 1 + m[0, 0] + m[1, 1] + m[2, 2])
    if w2 > 1e-6:
        w = w2**0.5 / 2
        q = ((m[2, 1] - m[1, 2]) / (4 * w), (m[0, 2] - m[2, 0]) / (4 * w), (m[1, 0] - m[0, 1]) / (4 * w), w)
    else:
        i = int(np.argmax(np.diag(m)[:3]))
        j, k = (i + 1) % 3, (i + 2) % 3
        r = max(1e-12, 1 + m[i, i] - m[j, j] - m[k, k]) ** 0.5
        v = [0.0, 0.0, 0.0]
        v[i], v[j], v[k] = r / 2, (m[j, i] + m[i, j]) / (2 * r), (m[k, i] + m[i, k]) / (2 * r)
        q = (*v, (m[k, j] - m[j, k]) / (2 * r))
    return dict(zip(("tx", "ty", "tz", "qx", "qy", "qz", "qw"), (*map(float, m[:3, 3]), *map(float, q)), strict=True))


def _vector(m: np.ndarray) -> np.ndarray:
    """Small-motion coordinates of a pose: twice the quaternion's axis part, then the translation."""
    p = matrix_pose(m)
    s = 2.0 if p["qw"] >= 0 else -2.0
    return np.array([s * p["qx"], s * p["qy"], s * p["qz"], p["tx"], p["ty"], p["tz"]])


def step_matrix(d: np.ndarray) -> np.ndarray:
    """Pose of small-motion coordinates."""
    angle = float(np.linalg.norm(d[:3]))
    axis = d[:3] / angle if angle > 1e-12 else np.array([1.0, 0.0, 0.0])
    s, c = math.sin(angle / 2), math.cos(angle / 2)
    return _matrix(dict(zip(("tx", "ty", "tz", "qx", "qy", "qz", "qw"), (*d[3:], *(axis * s), c), strict=True)))


def solve_graph(nodes: list, edges: list, rounds: int, prune: float, preference: float, reference: int) -> tuple[list, list, float]:
    ids = [x["node_id"] for x in nodes]
    place = {i: k for k, i in enumerate(ids)}
    pose = [_matrix(x["pose"]) for x in nodes]
    ties = [(place[e["source_id"]], place[e["target_id"]], np.linalg.inv(_matrix(e["pose"])), e["weight"], e["uncertain"]) for e in edges if e["source_id"] in place and e["target_id"] in place]
    fixed = place.get(reference, 0)
    cost, h = 0.0, 1e-6
    steps = [step_matrix(np.eye(6)[k] * h) for k in range(6)]
    for _ in range(rounds):
        a = np.zeros((6 * len(ids), 6 * len(ids)))
        g = np.zeros(6 * len(ids))
        cost = 0.0
        for s, t, back, weight, uncertain in ties:
            inv = np.linalg.inv(pose[t])
            e = _vector(back @ inv @ pose[s])
            line = (preference / (preference + weight * float(e @ e))) ** 2 if uncertain else 1.0
            if line < prune:
                continue
            w = weight * line
            cost += w * float(e @ e)
            js = np.stack([(_vector(back @ inv @ x @ pose[s]) - e) / h for x in steps], axis=1)
            jt = np.stack([(_vector(back @ inv @ np.linalg.inv(x) @ pose[s]) - e) / h for x in steps], axis=1)
            i, j = slice(6 * s, 6 * s + 6), slice(6 * t, 6 * t + 6)
            a[i, i] += w * js.T @ js
            a[j, j] += w * jt.T @ jt
            a[i, j] += w * js.T @ jt
            a[j, i] += w * jt.T @ js
            g[i] += w * js.T @ e
            g[j] += w * jt.T @ e
        free = np.ones(len(g), bool)
        free[6 * fixed : 6 * fixed + 6] = False
        a = a[np.ix_(free, free)] + 1e-9 * np.eye(int(free.sum()))
        d = np.zeros(len(g))
        d[free] = np.linalg.solve(a, -g[free])
        pose = [step_matrix(d[6 * k : 6 * k + 6]) @ p for k, p in enumerate(pose)]
        if np.abs(d).max(initial=0.0) < 1e-9:
            break
    return ids, [matrix_pose(p) for p in pose], cost
