"""The loop of closing loops: what is accepted corrects the map, and the corrected map shows further loops."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrane.functions.geometry import POSE
from terrane.operators import posegraph
from terrane.operators.graph import loop_candidates, loop_distance, new_constraints, undirected
from terrane.operators.mapping import correct
from terrane.operators.trajectory import multiply
from terrane.plans.lineage import cut


def record_closures(nodes: DataFrame, edges: DataFrame, accepted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The adjacency (id, is_lc), (src, dst) with accepted closures as edges and both their ends marked."""
    more = accepted.select(F.col("source_id").alias("src"), F.col("target_id").alias("dst"))
    ends = undirected(more).select(F.col("src").alias("id")).distinct().withColumn("hit", F.lit(True))
    marked = nodes.join(ends, "id", "left").select("id", (F.coalesce("is_lc", F.lit(False)) | F.coalesce("hit", F.lit(False))).alias("is_lc"))
    return marked, edges.select("src", "dst").unionByName(more).distinct()


def moved_constraints(constraints: DataFrame, corrections: DataFrame) -> DataFrame:
    """Constraints between clouds, as they read after the clouds were moved by their corrections."""
    names = constraints.columns
    ends = corrections.select("submap_id", F.col("pose").alias("c"))
    met = constraints.join(ends.withColumnsRenamed({"submap_id": "source_id", "c": "cs"}), "source_id", "left").join(ends.withColumnsRenamed({"submap_id": "target_id", "c": "ct"}), "target_id", "left")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def array(poses: pd.Series) -> np.ndarray:
            return np.array([[p[n] for n in POSE] if p is not None else [0, 0, 0, 0, 0, 0, 1] for p in poses], float).reshape(-1, 7)

        for t in batches:
            new = multiply(array(t["ct"]), multiply(array(t["pose"]), posegraph.inverses(array(t["cs"]))))
            yield t.drop(columns=["cs", "ct"]).assign(pose=[dict(zip(POSE, map(float, p), strict=True)) for p in new])[names]

    return met.mapInPandas(run, constraints.schema)


def close_and_correct(
    submaps: DataFrame,
    clouds: DataFrame,
    poses: DataFrame,
    odometry: DataFrame,
    find: Callable[[DataFrame, DataFrame], DataFrame],
    radius: float,
    size: float,
    least_distance: int = 0,
    rounds: int = 10,
    preference: float = 2.0,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(clouds, poses, closures) once no further loop is found.

    ``submaps`` (submap_id, parent_id), ``clouds`` (submap_id, point_id, x, y, z) and ``poses``
    (submap_id, ..., pose; the trajectory, head included) are of one map, ``odometry``
    (source_id, target_id, pose[, weight, information]) its certain constraints from smaller
    to larger ids.  A round takes candidates among the clouds as they lie, asks ``find`` for
    those that it accepts (source_id, target_id, pose, ...), larger to smaller, adds them to
    the graph, solves it over all constraints, and moves clouds, poses and constraints;
    submaps outside the graph follow their nearest ancestor in it.
    """
    odometry = cut(odometry)
    nodes = submaps.select(F.col("submap_id").alias("id"), F.lit(False).alias("is_lc"))
    edges = odometry.select(F.col("source_id").alias("src"), F.col("target_id").alias("dst"))
    closures = None
    for _ in range(rounds):
        centers = clouds.groupBy("submap_id").agg(*(F.avg(c).alias(f"c{c}") for c in "xyz"))
        candidates = cut(loop_candidates(centers, edges, radius, size, distances=loop_distance(nodes, edges), least_distance=least_distance))
        fresh = find(candidates, clouds)
        fresh = cut(new_constraints(closures if closures is not None else fresh.limit(0), fresh.withColumn("order", F.lit(0)), "order").select(*fresh.columns))
        if fresh.isEmpty():
            break
        closures = fresh if closures is None else closures.unionByName(fresh)
        nodes, edges = (cut(x) for x in record_closures(nodes, edges, fresh))
        graph_nodes, graph_edges = posegraph.build(*(c.withColumn("graph_id", F.lit(0)) for c in (odometry, closures)))
        clouds, poses, corrections = correct(clouds, poses, submaps, graph_nodes, graph_edges, preference)
        clouds, poses = cut(clouds), cut(poses)
        odometry, closures = cut(moved_constraints(odometry, corrections)), cut(moved_constraints(closures, corrections))
    return clouds, poses, closures if closures is not None else fresh
