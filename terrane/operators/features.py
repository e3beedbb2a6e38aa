"""Point descriptors and global registration from them."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrane.operators.graph import _POSE, matrix_pose
from terrane.operators.neighbours import k_nearest
from terrane.operators.registration import _point_solve
from terrane.plans.lineage import cut

BINS = 11


def _dot(a: Sequence[Column], b: Sequence[Column]) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def _cross(a: Sequence[Column], b: Sequence[Column]) -> list[Column]:
    return [a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]]


def _bin(v: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(F.floor((v - low) / (high - low) * BINS), F.lit(0)), F.lit(BINS - 1)).cast("int")


def fpfh(points: DataFrame, radius: float, k: int, on: Sequence[str] = ("cloud_id",)) -> DataFrame:
    """(.., point_id, fpfh ARRAY<DOUBLE>(33)): Rusu et al. 2009.

    Angles between the normals of a point and each neighbour fill three histograms of eleven
    bins; those of the neighbours are added, weighted by nearness.
    """
    near = k_nearest(cut(points), radius, k, on).where("source_id <> target_id and d2 > 0")
    d = [F.col(f"t_{c}") - F.col(f"s_{c}") for c in "xyz"]
    length = F.sqrt(F.col("d2"))
    u = [F.col(f"s_n{c}") for c in "xyz"]
    nt = [F.col(f"t_n{c}") for c in "xyz"]
    v = _cross([x / length for x in d], u)
    size = F.sqrt(_dot(v, v))
    v = [F.when(size > 0, x / size).otherwise(0.0) for x in v]
    w = _cross(u, v)
    angles = near.select(*on, "source_id", "target_id", length.alias("d"), _bin(_dot(v, nt), -1, 1).alias("b1"), _bin(_dot(u, d) / length, -1, 1).alias("b2"), _bin(F.atan2(_dot(w, nt), _dot(u, nt)), -np.pi, np.pi).alias("b3"))
    slots = [F.sum(F.when(F.col(f"b{g + 1}") == i, 1.0).otherwise(0.0)) / F.count("*") for g in range(3) for i in range(BINS)]
    simple = angles.groupBy(*on, "source_id").agg(F.array(*slots).alias("spfh"))
    other = simple.select(*on, F.col("source_id").alias("target_id"), F.col("spfh").alias("theirs"))
    weighed = angles.select(*on, "source_id", "target_id", "d").join(other, [*on, "target_id"])
    sums = weighed.groupBy(*on, "source_id").agg(F.array(*(F.avg(F.element_at("theirs", i + 1) / F.col("d")) for i in range(3 * BINS))).alias("around"))
    raw = simple.join(sums, [*on, "source_id"], "left").select(*on, F.col("source_id").alias("point_id"), F.when(F.col("around").isNull(), F.col("spfh")).otherwise(F.zip_with("spfh", "around", lambda a, b: a + b)).alias("h"))
    parts = [F.slice("h", 1 + g * BINS, BINS) for g in range(3)]

    def norm(p: Column) -> Column:
        total = F.aggregate(p, F.lit(0.0), lambda a, b: a + b)
        return F.transform(p, lambda x: F.when(total > 0, 100 * x / total).otherwise(0.0))

    return raw.select(*on, "point_id", F.concat(*map(norm, parts)).alias("fpfh"))


def ransac(matches: DataFrame, distance: float, edge: float = 0.5, hypotheses: int = 1_000_000, confidence: float = 0.99, seed: int = 7) -> DataFrame:
    """Rigid pose of each pair from point matches: (pair_id, pose, n_inliers, n_matches).

    ``matches``: (pair_id, sx, sy, sz, tx, ty, tz).  Three matches make a hypothesis if the
    lengths of their triangles agree to the factor ``edge`` and the pose they give brings them
    within ``distance``; the one with the most inliers wins and is fitted again to these.  A
    pair has as many matches as a submap has features; each is one row, pairs run in parallel.
    """
    per = matches.groupBy("pair_id").agg(F.flatten(F.sort_array(F.collect_list(F.array("sx", "sy", "sz", "tx", "ty", "tz")))).alias("m"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for t in batches:
            for pair, m in zip(t["pair_id"], t["m"], strict=True):
                m = np.asarray(m, float).reshape(-1, 6)
                pose, inliers = best_pose(m[:, :3], m[:, 3:], distance, edge, hypotheses, confidence, seed)
                yield pd.DataFrame({"pair_id": [pair], "pose": [matrix_pose(pose)], "n_inliers": [inliers], "n_matches": [len(m)]})

    kind = matches.schema["pair_id"].dataType.simpleString()
    return per.mapInPandas(run, f"pair_id {kind}, pose {_POSE}, n_inliers long, n_matches long")


def _moments(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Rows of sums that the point-to-point solver takes, for stacks of matched points."""
    n = np.full((len(p), 1), float(p.shape[1]))
    cross = np.einsum("hki,hkj->hij", p, q).reshape(len(p), 9)
    return np.concatenate([n, p.sum(axis=1), q.sum(axis=1), cross], axis=1)


def best_pose(p: np.ndarray, q: np.ndarray, distance: float, edge: float, hypotheses: int, confidence: float, seed: int) -> tuple[np.ndarray, int]:
    best, most = np.eye(4), 0
    if len(p) < 3:
        return best, most
    rng = np.random.default_rng(seed)
    done, wanted = 0, float(hypotheses)
    while done < min(wanted, hypotheses):
        pick = rng.integers(0, len(p), (min(512, hypotheses), 3))
        done += len(pick)
        pick = pick[(pick[:, 0] != pick[:, 1]) & (pick[:, 1] != pick[:, 2]) & (pick[:, 0] != pick[:, 2])]
        a, b = p[pick], q[pick]
        la, lb = (np.linalg.norm(x - x[:, [1, 2, 0]], axis=2) for x in (a, b))
        ok = ((la >= edge * lb) & (lb >= edge * la) & (la > 0)).all(axis=1)
        a, b = a[ok], b[ok]
        if not len(a):
            continue
        pose = _point_solve(_moments(a, b))
        moved = np.einsum("hij,hkj->hki", pose[:, :3, :3], a) + pose[:, None, :3, 3]
        for t in pose[(np.linalg.norm(moved - b, axis=2) <= distance).all(axis=1)]:
            n = int((np.linalg.norm(p @ t[:3, :3].T + t[:3, 3] - q, axis=1) <= distance).sum())
            if n > most:
                best, most = t, n
                share = (n / len(p)) ** 3
                wanted = np.log(1 - confidence) / np.log(1 - share) if share < 1 else 1
                if most == len(p):  # no hypothesis can have more
                    break
    if most >= 3:
        near = np.linalg.norm(p @ best[:3, :3].T + best[:3, 3] - q, axis=1) <= distance
        best = _point_solve(_moments(p[None, near], q[None, near]))[0]
    return best, most
