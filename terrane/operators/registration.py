"""Registration of many pairs of clouds at once, scan-to-scan odometry and localisation.

An iteration is: move the source by the pose so far, join nearest targets on a grid, sum the
normal equations per pair, solve 6x6 or 3x3 systems in batches, and compose.  Pairs that have
converged leave the next iteration's joins.  Pairs of small clouds iterate where they lie.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from functools import reduce
from operator import add, sub

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from terrane.functions.geometry import POSE, pose, pose_apply
from terrane.operators.graph import _POSE, matrix_pose, step_matrix
from terrane.operators.blocks import box_distances, in_blocks, values
from terrane.operators.fits import fit_all, rows_of, runs, whole_groups
from terrane.operators.neighbours import CELL, correspondences, in_cells, in_near_cells
from terrane.operators.trajectory import consecutive, multiply, pose_product, turns
from terrane.plans.lineage import cut, delete, forget, shared_folder

_REGISTRATIONS: dict[str, tuple[Callable[[], list], Callable[[np.ndarray], np.ndarray], Callable | None]] = {}


def register_registration(name: str, sums: Callable[[], list], solve: Callable[[np.ndarray], np.ndarray], terms: Callable | None = None) -> None:
    """``sums()``: aggregate columns over correspondences (p*, t_*); ``solve``: rows of them to 4x4 motions.

    ``terms(v)``: what is summed, of columns or arrays ``v(name)``; with it, a pair that fits one packed row needs no Spark rounds.
    """
    _REGISTRATIONS[name] = sums, solve, terms


def _point_terms(v: Callable) -> list:
    p, q = [v(f"s_{c}") for c in "xyz"], [v(f"t_{c}") for c in "xyz"]
    return [p[0] * 0.0 + 1.0, *p, *q, *(a * b for a in p for b in q)]


def _point_solve(m: np.ndarray) -> np.ndarray:
    n = m[:, :1]
    p, q = m[:, 1:4] / n, m[:, 4:7] / n
    cross = m[:, 7:16].reshape(-1, 3, 3) / n[:, :, None] - p[:, :, None] * q[:, None, :]
    u, _, vt = np.linalg.svd(cross)
    v = np.swapaxes(vt, 1, 2)
    flip = np.ones((len(m), 3))
    flip[:, 2] = np.sign(np.linalg.det(v @ np.swapaxes(u, 1, 2)))
    r = v @ (flip[:, :, None] * np.swapaxes(u, 1, 2))
    out = np.tile(np.eye(4), (len(m), 1, 1))
    out[:, :3, :3] = r
    out[:, :3, 3] = q - (r @ p[:, :, None])[:, :, 0]
    return out


def _plane_terms(v: Callable) -> list:
    px, py, pz = (v(f"s_{c}") for c in "xyz")
    nx, ny, nz = (v(f"t_n{c}") for c in "xyz")
    r = (px - v("t_x")) * nx + (py - v("t_y")) * ny + (pz - v("t_z")) * nz
    j = [py * nz - pz * ny, pz * nx - px * nz, px * ny - py * nx, nx, ny, nz]
    return [*(j[a] * j[b] for a in range(6) for b in range(a, 6)), *(a * r for a in j)]


def _normal_solve(m: np.ndarray) -> np.ndarray:
    a = np.zeros((len(m), 6, 6))
    up = np.triu_indices(6)
    a[:, up[0], up[1]] = a[:, up[1], up[0]] = m[:, :21]
    d = np.linalg.solve(a + 1e-9 * np.eye(6), -m[:, 21:27, None])[:, :, 0]
    return np.stack([step_matrix(x) for x in d])


def _generalised_terms(v: Callable, eps: float = 1e-3) -> list:
    """Both sides as discs across their normals; the inverse of the summed covariances weighs the residual."""
    n = [v(f"t_n{c}") for c in "xyz"]
    s = [v(f"s_n{c}") for c in "xyz"]
    c = [[(2.0 if i == j else 0.0) - (1 - eps) * (n[i] * n[j] + s[i] * s[j]) for j in range(3)] for i in range(3)]
    cof = [[c[(i + 1) % 3][(j + 1) % 3] * c[(i + 2) % 3][(j + 2) % 3] - c[(i + 1) % 3][(j + 2) % 3] * c[(i + 2) % 3][(j + 1) % 3] for j in range(3)] for i in range(3)]
    det = c[0][0] * cof[0][0] + c[0][1] * cof[0][1] + c[0][2] * cof[0][2]
    m = [[cof[j][i] / det for j in range(3)] for i in range(3)]
    x, y, z = (v(f"s_{k}") for k in "xyz")
    zero, one = 0.0, 1.0
    a = [[zero, z, -y, one, zero, zero], [-z, zero, x, zero, one, zero], [y, -x, zero, zero, zero, one]]
    d = [v(f"s_{k}") - v(f"t_{k}") for k in "xyz"]
    ma = [[sum((m[i][k] * a[k][j] for k in (1, 2)), m[i][0] * a[0][j]) for j in range(6)] for i in range(3)]
    return [*(sum((a[k][i] * ma[k][j] for k in (1, 2)), a[0][i] * ma[0][j]) for i in range(6) for j in range(i, 6)), *(sum((ma[k][i] * d[k] for k in (1, 2)), ma[0][i] * d[0]) for i in range(6))]


for _name, _terms, _solve in (("PointToPoint", _point_terms, _point_solve), ("PointToPlane", _plane_terms, _normal_solve), ("Generalized", _generalised_terms, _normal_solve)):
    register_registration(_name, lambda of=_terms: [F.sum(x) for x in of(F.col)], _solve, _terms)


def moved(points: DataFrame, poses: DataFrame, on: str = "pair_id") -> DataFrame:
    """Points, and their normals if they have any, moved by the pose of their group."""
    j = points.join(poses.select(on, F.col("pose").alias("__pose")), on)
    new = dict(zip("xyz", pose_apply(F.col("__pose"), "x", "y", "z"), strict=True))
    if "nx" in points.columns:
        turn = F.struct(F.lit(0.0).alias("tx"), F.lit(0.0).alias("ty"), F.lit(0.0).alias("tz"), *(F.col(f"__pose.{q}").alias(q) for q in ("qx", "qy", "qz", "qw")))
        new |= dict(zip(("nx", "ny", "nz"), pose_apply(turn, "nx", "ny", "nz"), strict=True))
    return j.withColumns(new).drop("__pose")


def evaluate(source: DataFrame, target: DataFrame, poses: DataFrame, radius: float) -> DataFrame:
    """Fitness (share of matched source points) and root mean square distance of each pair."""
    n = source.groupBy("pair_id").agg(F.count("*").alias("n_source"))
    got = correspondences(moved(source, poses), target, radius).groupBy("pair_id").agg(F.count("*").alias("n_corr"), F.sqrt(F.avg("d2")).alias("inlier_rmse"))
    return poses.join(n, "pair_id", "left").join(got, "pair_id", "left").select("pair_id", "pose", "n_source", F.coalesce("n_corr", F.lit(0)).alias("n_corr"), (F.coalesce("n_corr", F.lit(0)) / F.col("n_source")).alias("fitness"), "inlier_rmse")


def register(source: DataFrame, target: DataFrame, kind: str, radius: float, start: DataFrame | None = None, rounds: int = 50, settle: float = 1e-6) -> DataFrame:
    """Pose of each pair that lays source on target: (pair_id, pose, n_source, n_corr, fitness, inlier_rmse, settled).

    Points are (pair_id, point_id, x, y, z), with nx, ny, nz where the kind needs them.  Pairs
    start from ``start`` (pair_id, pose) or rest; one stops when its pose moves less than
    ``settle``, and is not ``settled`` if it still moved more in the last round.

    Source and target are packed once: a row holds some hundred source points that lie close
    together and the target points that they can reach until they have moved by ``radius``.  A
    round reads these rows where they are, and moves poses and sums alone; pairs that moved
    farther are packed again.
    """
    _known(kind)
    source = cut(source)
    mine, theirs = in_blocks(source, ["pair_id"], _PACKED, written=True), in_blocks(target, ["pair_id"], _PACKED)
    n_source = cut(source.groupBy("pair_id").agg(F.count("*").alias("n_source")))
    forget(source)
    got = _registered(mine, theirs, n_source, kind, radius, start if start is not None else n_source.select("pair_id", pose(0.0, 0.0, 0.0).alias("pose")), rounds, settle)
    for spent in (mine, theirs, n_source):
        forget(spent)
    return got


def _known(kind: str) -> None:
    if kind not in _REGISTRATIONS:
        raise ValueError(f"unknown registration {kind!r}; known: {', '.join(sorted(_REGISTRATIONS))}")


def by_place(kind: str) -> bool:
    """Whether the kind needs no more of a point than its place."""
    _known(kind)
    return _REGISTRATIONS[kind][2] is _point_terms


def steps_of(kind: str) -> tuple[Callable[[np.ndarray], np.ndarray], Callable | None]:
    """What solves a round of the kind, and the terms that it sums."""
    _known(kind)
    return _REGISTRATIONS[kind][1:]


def _columns(blocks: DataFrame) -> list[str]:
    """The columns that a point of packed rows has."""
    return [c for c in blocks.columns if c not in _FIXED]


def _registered(mine: DataFrame, theirs: DataFrame, n_source: DataFrame, kind: str, radius: float, start: DataFrame, rounds: int, settle: float = 1e-6) -> DataFrame:
    """``register`` for points that are packed by pair already; ``n_source`` is (pair_id, n_source)."""
    sums, solve, terms = _REGISTRATIONS[kind]
    poses = cut(start.select("pair_id", "pose").withColumn("open", F.lit(True)))
    packed = _reachable(mine, theirs, poses, radius)
    columns = _columns(mine), _columns(theirs)
    alone = _alone(packed[0], poses, mine, theirs, columns, radius, rounds, settle, solve, terms) if terms else None
    if alone is not None:
        poses = cut(poses.join(alone, "pair_id", "left_anti"), poses)
    of_pair = [F.count("*").alias("k"), *(c.alias(f"m{i}") for i, c in enumerate(sums()))]

    def step(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for t in batches:
            known = t["k"].to_numpy() >= 6
            m = t.loc[known, [c for c in t.columns if c[0] == "m" and c[1:].isdigit()]].to_numpy(float)
            motion = np.tile(np.eye(4), (len(t), 1, 1))
            if len(m):
                motion[known] = solve(m)
            old = np.array([[p[n] for n in POSE] for p in t["pose"]]).reshape(-1, 7)
            new = multiply(np.array([[*matrix_pose(x).values()] for x in motion]).reshape(-1, 7), old)
            size = np.abs(motion - np.eye(4)).max(axis=(1, 2)) if len(t) else np.zeros(0)
            yield pd.DataFrame({"pair_id": t["pair_id"], "pose": [dict(zip(POSE, map(float, p), strict=True)) for p in new], "open": size > settle})

    shape = f"pair_id {mine.schema['pair_id'].dataType.simpleString()}, pose {_POSE}, open boolean"

    for _ in range(rounds):
        live = poses.where("open")
        if live.isEmpty():
            break
        summed, packed = _summed(packed, live, mine, theirs, columns, radius, of_pair)
        moved_on = live.join(summed, "pair_id", "left").na.fill(0).mapInPandas(step, shape)
        poses = cut(moved_on.unionByName(poses.where("not open")), poses)
        forget(summed)
    if alone is None or not poses.isEmpty():
        hits, packed = _summed(packed, poses, mine, theirs, columns, radius, [F.count("*").alias("n_corr"), F.sqrt(F.avg("d2")).alias("inlier_rmse")])
        ends = poses.join(hits, "pair_id", "left").withColumn("n_corr", F.coalesce("n_corr", F.lit(0).cast("long")))
        ends = ends if alone is None else ends.unionByName(alone)
    else:
        hits, ends = None, alone
    got = ends.join(n_source, "pair_id", "left")
    got = cut(got.select("pair_id", "pose", "n_source", "n_corr", (F.col("n_corr") / F.col("n_source")).alias("fitness"), "inlier_rmse", (~F.col("open")).alias("settled")))
    for spent in (poses, hits, alone):
        if spent is not None:
            forget(spent)
    _drop(packed)
    return got


def _alone(packed: DataFrame, poses: DataFrame, mine: DataFrame, theirs: DataFrame, columns: tuple[list[str], list[str]], radius: float, rounds: int, settle: float, solve: Callable[[np.ndarray], np.ndarray], terms: Callable) -> DataFrame:
    """Registered pairs whose source fits one packed row: (pair_id, pose, open, n_corr, inlier_rmse).

    Such a row holds all that the pair's rounds need, so they follow each other where it lies.  A
    pair that leaves the reach of its row goes on from there once it is packed again.
    """
    turned = [c for c in ("nx", "ny", "nz") if c in columns[0]]
    source = [c for c in columns[0] if c != "point_id"]
    kind = mine.schema["pair_id"].dataType.simpleString()
    names = ["pair_id", "pose", "open", "used", "astray", "n_corr", "inlier_rmse"]
    struct = pa.struct([(n, pa.float64()) for n in POSE])

    def fit(s: dict[str, np.ndarray], t: dict[str, np.ndarray] | None, laid: np.ndarray, now: np.ndarray, open_: bool, used: int) -> tuple:
        p = np.stack([s[c] for c in "xyz"], axis=1)
        old = p @ turns(laid[None, 3:])[0].T + laid[:3]
        while True:
            turn = turns(now[None, 3:])[0]
            new = p @ turn.T + now[:3]
            if ((new - old) ** 2).sum(axis=1).max(initial=0.0) > radius * radius:
                return now, open_, used, True, 0, None
            at, which, d2 = nearest_within(new, t, radius) if t else (np.zeros(0, int), np.zeros(0, int), np.zeros(0))
            if not open_ or used >= rounds:
                return now, open_, used, False, len(at), float(np.sqrt(d2.mean())) if len(at) else None
            motion = np.eye(4)
            if len(at) >= 6:
                v = {f"s_{c}": s[c][at] for c in source} | {f"t_{c}": t[c][which] for c in columns[1]} | {f"s_{c}": x[at] for c, x in zip("xyz", new.T, strict=True)}
                if turned:
                    v |= {f"s_{c}": x[at] for c, x in zip(turned, turn @ np.stack([s[c] for c in turned]), strict=True)}
                motion = solve(np.array([[np.sum(x) for x in terms(v.__getitem__)]]))[0]
            now = multiply(np.array([[*matrix_pose(motion).values()]]), now[None])[0]
            open_, used = bool(np.abs(motion - np.eye(4)).max() > settle), used + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = {c: batch.column(c) for c in batch.schema.names}
            now, laid = (np.stack([column[c].field(n).to_numpy(zero_copy_only=False) for n in POSE], axis=1) for c in ("pose", "laid"))
            out = []
            for i in range(batch.num_rows):
                s = {c: values(column[f"s_{c}"], i) for c in source}
                t = {c: values(column[f"t_{c}"], i) for c in columns[1]} if column["t_x"][i].is_valid else None
                out.append(fit(s, t, laid[i], now[i], column["open"][i].as_py(), column["used"][i].as_py()))
            pose_, *rest = zip(*out, strict=True) if out else ((),) * 6
            yield pa.RecordBatch.from_arrays([column["pair_id"], pa.array([dict(zip(POSE, map(float, x), strict=True)) for x in pose_], struct), *(pa.array(x, k) for x, k in zip(rest, (pa.bool_(), pa.int32(), pa.bool_(), pa.int64(), pa.float64()), strict=True))], names=names)

    shape = f"pair_id {kind}, pose {_POSE}, open boolean, used int, astray boolean, n_corr long, inlier_rmse double"
    rows, todo, done, again = packed, poses.withColumn("used", F.lit(0)), None, []
    while True:
        got = cut(rows.where("alone").drop("alone").join(todo.hint("shuffle_hash"), "pair_id").mapInArrow(run, shape))
        ended = got.where("not astray").select("pair_id", "pose", "open", "n_corr", "inlier_rmse")
        done = ended if done is None else done.unionByName(ended)
        left = got.where("astray")
        again.append(got)
        if left.isEmpty():
            break
        if rows is not packed:
            _drop([rows])
        todo = left.select("pair_id", "pose", "open", "used")
        rows = _reachable(mine.join(todo, "pair_id", "left_semi"), theirs.join(todo, "pair_id", "left_semi"), todo, radius)[0]
    if rows is not packed:
        _drop([rows])
    return cut(done, *again) if len(again) > 1 else done


#: Points of a block of registration, and blocks of a file of packed rows.
_PACKED, _FILE = 1024, 256
#: Columns of packed rows that aren't a point's.
_FIXED = ("pair_id", "block", "n", *(f"{e}_{c}" for e in ("low", "high") for c in "xyz"))


def _reachable(mine: DataFrame, theirs: DataFrame, poses: DataFrame, radius: float) -> list[DataFrame]:
    """Source blocks of the poses' pairs, each with the target points in reach while it moves by less than ``radius``, dealt into files by pair."""
    spark = mine.sparkSession
    half = F.sqrt(reduce(add, ((F.col(f"high_{c}") - F.col(f"low_{c}")) * (F.col(f"high_{c}") - F.col(f"low_{c}")) for c in "xyz"))) / 2
    middle = pose_apply(F.col("laid"), *((F.col(f"high_{c}") + F.col(f"low_{c}")) / 2 for c in "xyz"))
    placed = mine.join(poses.select("pair_id", F.col("pose").alias("laid")), "pair_id").withColumns({"half": half, **{f"m{c}": m for c, m in zip("xyz", middle, strict=True)}})
    boxes = placed.select("pair_id", F.col("block").alias("s_block"), *(f(F.col(f"m{c}"), F.col("half")).alias(f"s_{e}_{c}") for c in "xyz" for e, f in (("low", sub), ("high", add))))
    others = theirs.select("pair_id", F.col("block").alias("t_block"), *(F.col(f"{e}_{c}").alias(f"t_{e}_{c}") for c in "xyz" for e in ("low", "high")))
    near = cut(boxes.join(others, "pair_id").where(box_distances("s_", "t_")[0] <= 4 * radius * radius * 1.000001).select("pair_id", "s_block", "t_block"))
    sc, tc = _columns(mine), _columns(theirs)
    own = placed.select("pair_id", F.col("block").alias("s_block"), F.lit(0).alias("kind"), "laid", *(F.col(c).alias(f"s_{c}") for c in sc))
    there = near.join(theirs.select(F.col("block").alias("t_block"), *(F.col(c).alias(f"t_{c}") for c in tc)), "t_block").drop("t_block").withColumn("kind", F.lit(1))
    files = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-mine.count() // _FILE))
    both = own.unionByName(there, allowMissingColumns=True).repartition(files, "pair_id").sortWithinPartitions("pair_id", "s_block", "kind")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, found, last, size = None, {}, None, 0

        def packed(after: object) -> pa.RecordBatch:
            nonlocal last
            own = head.column("pair_id")[0]
            alone, last = own != last and own != after, own
            flat = {c: pa.concat_arrays(v) for c, v in found.items() if v}
            lists = [pa.ListArray.from_arrays(pa.array([0, len(flat[c])], pa.int32()), flat[c]) if c in flat else pa.nulls(1, types[c]) for c in found]
            return pa.RecordBatch.from_arrays([head.column("pair_id"), head.column("laid"), *lists, pa.array([alone])], names=["pair_id", "laid", *found, "alone"])

        for batch in batches:
            begins = batch.column("kind").to_numpy() == 0
            turns_ = np.unique(np.append(0, np.flatnonzero(begins))).tolist() if batch.num_rows else []
            for a, b in zip(turns_, [*turns_[1:], batch.num_rows], strict=True):
                if begins[a]:
                    row, more = batch.slice(a, 1), len(batch.column(f"s_{sc[0]}")[a].values)
                    pair = row.column("pair_id")[0]
                    # blocks of a small cloud that the packing cut apart go to one row; a target in reach of both is there twice
                    if head is None or pair != head.column("pair_id")[0] or size + more > _PACKED:
                        if head is not None:
                            yield packed(pair)
                        head, size, found = row, 0, {f"{e}_{c}": [] for e, own in (("s", sc), ("t", tc)) for c in own}
                    for c in sc:
                        found[f"s_{c}"].append(row.column(f"s_{c}").flatten())
                    size, a = size + more, a + 1
                if b > a:
                    for c in tc:
                        found[f"t_{c}"].append(batch.column(f"t_{c}").slice(a, b - a).flatten())
        if head is not None:
            yield packed(None)

    types = {f"{e}_{c}": to_arrow_type(d.schema[c].dataType) for e, d, own in (("s", mine, sc), ("t", theirs, tc)) for c in own}
    kinds = dict(own.dtypes) | dict(there.dtypes)
    rows = both.mapInArrow(pack, ", ".join(f"{c} {kinds[c]}" for c in ("pair_id", "laid", *types)) + ", alone boolean")
    name = f"packed_{uuid.uuid4().hex}"
    rows.write.bucketBy(files, "pair_id").option("path", f"{shared_folder(spark)}/{name}").saveAsTable(name)
    forget(near)
    return [spark.table(name)]


def _drop(packed: list[DataFrame]) -> None:
    for rows in packed:
        folder = rows.inputFiles()[0].rsplit("/", 1)[0] if rows.inputFiles() else None
        if folder:
            name = folder.rsplit("/", 1)[1]
            rows.sparkSession.sql(f"drop table if exists {name}")
            delete(rows.sparkSession, folder)


def _summed(packed: list[DataFrame], poses: DataFrame, mine: DataFrame, theirs: DataFrame, columns: tuple[list[str], list[str]], radius: float, sums: list[Column]) -> tuple[DataFrame, list[DataFrame]]:
    """``sums`` over each pair's source points, laid by the poses, and their nearest targets; and the packed rows, more if some pair left its reach.

    A pair is read from the newest rows that hold it.
    """
    found, left = None, poses.select("pair_id", "pose")
    for rows in reversed(packed):
        got = cut(_matched(rows, left, columns, radius).groupBy("pair_id").agg(F.bool_or("astray").alias("astray"), *sums))
        found = got if found is None else cut(found.unionByName(got), found, got)
        left = poses.select("pair_id", "pose").join(found, "pair_id", "left_anti") if len(packed) > 1 else left
    astray = found.where("astray").select("pair_id")
    if not astray.isEmpty():
        again = cut(poses.join(astray, "pair_id").select("pair_id", "pose"))
        packed = [*packed, _reachable(mine.join(astray, "pair_id", "left_semi"), theirs.join(astray, "pair_id", "left_semi"), again, radius)[0]]
        got = _matched(packed[-1], again, columns, radius).groupBy("pair_id").agg(F.bool_or("astray").alias("astray"), *sums)
        found = cut(found.where("not astray").unionByName(got), found)
        forget(again)
    return found.drop("astray"), packed


def _matched(packed: DataFrame, poses: DataFrame, columns: tuple[list[str], list[str]], radius: float) -> DataFrame:
    """Source points laid by the poses with their nearest targets: (pair_id, d2, s_*, t_*, astray).

    The rows stay where they are, poses go to them.  A pair that has moved too far since it
    was packed has one row, marked ``astray``.
    """
    turned = [c for c in ("nx", "ny", "nz") if c in columns[0]]
    source = [c for c in columns[0] if c != "point_id"]
    kinds = dict(packed.dtypes)
    shape = f"pair_id {kinds['pair_id']}, d2 double, " + ", ".join(f"{n} {kinds[n][6:-1]}" for n in (*(f"s_{c}" for c in source), *(f"t_{c}" for c in columns[1]))) + ", astray boolean"
    names = [f.strip().split(" ", 1)[0] for f in shape.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = {c: batch.column(c) for c in batch.schema.names}
            pose_, laid = (np.stack([column[c].field(n).to_numpy(zero_copy_only=False) for n in POSE], axis=1) for c in ("pose", "laid"))
            turn, was = turns(pose_[:, 3:]), turns(laid[:, 3:])
            for i in range(batch.num_rows):
                s = {c: values(column[f"s_{c}"], i) for c in source}
                p = np.stack([s[c] for c in "xyz"], axis=1)
                new = p @ turn[i].T + pose_[i, :3]
                key = column["pair_id"].slice(i, 1)
                if (((new - (p @ was[i].T + laid[i, :3])) ** 2).sum(axis=1) > radius * radius).any():
                    yield pa.RecordBatch.from_arrays([key, *(pa.nulls(1, types[n]) for n in names[1:-1]), pa.array([True])], names=names)
                    continue
                if not column["t_x"][i].is_valid:
                    continue
                t = {c: values(column[f"t_{c}"], i) for c in columns[1]}
                s |= dict(zip("xyz", new.T, strict=True))
                if turned:
                    s |= dict(zip(turned, turn[i] @ np.stack([s[c] for c in turned]), strict=True))
                at, which, d2 = nearest_within(new, t, radius)
                keys = pa.concat_arrays([key]).take(pa.array(np.zeros(len(at), int)))
                yield pa.RecordBatch.from_arrays([keys, pa.array(d2), *(pa.array(s[c][at]) for c in source), *(pa.array(t[c][which]) for c in columns[1]), pa.array(np.zeros(len(at), bool))], names=names)

    types = {n: to_arrow_type(packed.schema[n].dataType.elementType) for n in names[2:-1]} | {"d2": pa.float64()}
    return packed.drop("alone").join(poses.select("pair_id", "pose").hint("shuffle_hash"), "pair_id").mapInArrow(run, shape)


def nearest_within(p: np.ndarray, t: dict[str, np.ndarray], radius: float, chunk: int = 64) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of p, row of t, square distance) of the nearest t of each p within the radius, ties to the least point_id.

    Both are gone through in the order of x, so that a chunk of p is compared with the targets beside it only.
    """
    order = np.lexsort((t["point_id"], t["x"]))
    q, ids = np.stack([t[c][order] for c in "xyz"], axis=1), t["point_id"][order]
    own = np.argsort(p[:, 0], kind="stable")
    out: tuple[list, list, list] = [own[:0]], [order[:0]], [p[:0, 0]]
    for i in range(0, len(own), chunk):
        at = own[i : i + chunk]
        a, b = np.searchsorted(q[:, 0], [p[at[0], 0] - radius * (1 + 1e-9) - 1e-12, p[at[-1], 0] + radius * (1 + 1e-9) + 1e-12])
        if a == b:
            continue
        d = [p[at, k][:, None] - q[None, a:b, k] for k in range(3)]
        d2 = d[0] * d[0] + d[1] * d[1] + d[2] * d[2]
        which, rows = d2.argmin(axis=1), np.arange(len(at))
        best = d2[rows, which]
        for j in np.flatnonzero((d2 == best[:, None]).sum(axis=1) > 1):
            same = np.flatnonzero(d2[j] == best[j])
            which[j] = same[np.argmin(ids[a:b][same])]
        ok = best <= radius * radius
        for o, v in zip(out, (at[ok], order[a + which[ok]], best[ok]), strict=True):
            o.append(v)
    return np.concatenate(out[0]), np.concatenate(out[1]), np.concatenate(out[2])


def odometry(scans: DataFrame, kind: str, radius: float, least_fitness: float = 0.1, rounds: int = 50) -> tuple[DataFrame, DataFrame]:
    """Scan-to-scan registration of all successive pairs, and the trajectory they make.

    ``scans``: (session_id, t_ticks, point_id, x, y, z, ...).  Every pair starts from rest, so
    all pairs are independent.  A rejected pair leaves no pose and counts as no motion.
    Each scan is packed once, for the pair that it ends and the one that it begins.  Sessions of
    few points go to one task each, where their pairs are registered side by side.
    """
    _known(kind)
    counts = cut(scans.groupBy("session_id", "t_ticks").agg(F.count("*").alias("n")))
    stamps = counts.select("session_id", "t_ticks")
    pairs = consecutive(stamps.withColumn("scan_id", F.col("t_ticks"))).select("session_id", F.col("scan_id").alias("now"), F.col("previous").alias("before"), F.concat_ws("/", "session_id", "scan_id").alias("pair_id"))
    pairs = cut(pairs)
    by = ["session_id", "t_ticks"]
    sizes = counts.where("session_id is not null").groupBy("session_id").agg(F.sum("n").alias("n"), F.max("n").alias("most"))
    total = sizes.agg(F.sum("n").alias("n"), F.max("most").alias("most"), F.count_if(F.col("n") > _SESSION).alias("large")).first()
    some = by_place(kind)
    once, packed = some and not total["large"], (total["most"] or 0) <= _PACKED
    blocks = in_blocks(scans, by, _PACKED, whole=(total["n"] or 0) if packed else None)
    blocks = cut(blocks) if packed and not once else blocks
    found, n_source = None, None
    if some:
        small = sizes.where(F.col("n") <= _SESSION).select("session_id") if total["large"] else None
        found = _in_sessions(counts, blocks, small, total["n"] or 0, kind, radius, rounds)
    if not once:
        rest = pairs.join(sizes.where(F.col("n") > _SESSION), "session_id", "left_semi") if some else pairs
        mine, theirs = (rest.select("session_id", F.col(c).alias("t_ticks"), "pair_id").join(blocks, by).drop(*by) for c in ("now", "before"))
        n_source = cut(rest.select("pair_id", "session_id", F.col("now").alias("t_ticks")).join(counts.withColumnRenamed("n", "n_source"), by).select("pair_id", "n_source"))
        start = n_source.select("pair_id", pose(0.0, 0.0, 0.0).alias("pose"))
        others = _registered(mine, theirs, n_source, kind, radius, start, rounds)
        found = others if found is None else found.unionByName(others)
    found = found.withColumn("accepted", F.col("fitness") > least_fitness)
    for spent in (None if once and packed else blocks, n_source, counts):
        if spent is not None:
            forget(spent)
    steps = pairs.join(found.where("accepted"), "pair_id").select("session_id", F.col("now").alias("t_ticks"), "pose")
    return found, pose_product(steps)


#: Points of a session whose scans are registered in one task, and points of such a task and of the arrays that it holds.
_SESSION, _TASK, _HELD = 50_000, 200_000, 65_536


def _in_sessions(counts: DataFrame, blocks: DataFrame, small: DataFrame | None, points: int, kind: str, radius: float, rounds: int) -> DataFrame:
    """``_registered`` for the successive scans of sessions that fit a task each; of all sessions if ``small`` is None.

    A scan goes to its session's task once.  Scans without a point that has a place are known from ``counts``.
    """
    solve, terms = steps_of(kind)
    known = "session_id is not null and t_ticks is not null"
    rows = counts.where(known).unionByName(blocks.where(known).select("session_id", "t_ticks", "point_id", "x", "y", "z"), allowMissingColumns=True)
    rows = rows if small is None else rows.join(small, "session_id", "left_semi")
    parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-points // _TASK))
    rows = rows.repartition(parts, "session_id").sortWithinPartitions("session_id", "t_ticks")
    names = ["session_id", "t_ticks", "pose", "n_source", "n_corr", "inlier_rmse", "settled"]
    struct = pa.struct([(n, pa.float64()) for n in POSE])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, max(1, _HELD // _PACKED)):
            session, time = (t.column(c).combine_chunks() for c in ("session_id", "t_ticks"))
            begin = runs(*(c.dictionary_encode().indices.to_numpy() for c in (session, time)))
            first = pa.array(begin[:-1])
            session, time = session.take(first), time.take(first)
            scan = np.repeat(np.arange(len(first)), np.diff(begin))
            many = np.add.reduceat(pc.fill_null(t.column("n"), 0).to_numpy(), begin[:-1])
            of = np.repeat(scan, pc.fill_null(pc.list_value_length(t.column("x")), 0).to_numpy())
            ids, *xyz = (t.column(c).combine_chunks().flatten().to_numpy(zero_copy_only=False) for c in ("point_id", "x", "y", "z"))
            order = np.lexsort((ids, of))
            ids, p = ids[order], np.stack([c.astype(float) for c in xyz], axis=1)[order]
            same = session.dictionary_encode().indices.to_numpy()
            pairs = np.flatnonzero(same[1:] == same[:-1]) + 1
            at = np.searchsorted(of, np.arange(len(first) + 1))
            (i, mine), (j, theirs) = (rows_of(at[k], at[k + 1]) for k in (pairs, pairs - 1))
            rest = np.tile([0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 1.0], (len(pairs), 1))
            got, open_, n, rmse = fit_all(p[i], mine, p[j], theirs, ids[j], rest, radius, rounds, solve, terms)
            poses = pa.StructArray.from_arrays([pa.array(c) for c in got.T], fields=list(struct))
            yield pa.RecordBatch.from_arrays([session.take(pa.array(pairs)), time.take(pa.array(pairs)), poses, pa.array(many[pairs]), pa.array(n), pa.array(rmse, mask=n == 0), pa.array(~open_)], names=names)

    kinds = dict(counts.dtypes)
    shape = f"session_id {kinds['session_id']}, t_ticks {kinds['t_ticks']}, pose {_POSE}, n_source long, n_corr long, inlier_rmse double, settled boolean"
    got = rows.mapInArrow(run, shape)
    return cut(got.select(F.concat_ws("/", "session_id", "t_ticks").alias("pair_id"), "pose", "n_source", "n_corr", (F.col("n_corr") / F.col("n_source")).alias("fitness"), "inlier_rmse", "settled"))


def localise(scans: DataFrame, map_points: DataFrame, guess: DataFrame, kind: str, radius: float, rounds: int = 50) -> DataFrame:
    """Pose of each scan (pair_id) in one frozen map.

    The target of a scan is the map around it: the map points in the coarse cells that the
    scan, moved by its guess, touches, and in the cells next to them.
    """
    size = 4 * radius
    touched = in_cells(moved(scans, guess), ("x", "y", "z"), size).select("pair_id", *CELL).distinct()
    middle = touched.select("pair_id", *((F.col(c) * size + size / 2).alias(a) for c, a in zip(CELL, "xyz", strict=True)))
    around = in_near_cells(middle, ("x", "y", "z"), size).select("pair_id", *CELL).distinct()
    patch = in_cells(map_points, ("x", "y", "z"), size).join(around, list(CELL)).select("pair_id", *map_points.columns)
    return register(scans, patch, kind, radius, guess, rounds)
