"""Pose graphs of any size: building them, and solving all of them at once.

A step (w, v) moves a pose in the map frame: turn by w, then shift by v.  To first order the
residual of an edge then depends on the difference of its ends' steps alone,

    e(d) = e + A (d_source - d_target),

so an edge asks the steps to grow by m between its ends, with the information W = A' I A.
The nodes of a graph stand in a row.  Edges between neighbours carry the row, each with a
covariance C = W^-1; covariances and wishes of a stretch add up.  Every other edge is a tie
over a stretch.  The forces L of the ties solve

    C_tie L_tie + sum over its stretch of C_k (sum of the forces over k) = m_tie - sum of m_k

which are as many unknowns as there are ties, not nodes.  Graphs with few ties are solved in
one go, by running sums over the row.  In others, nodes are eliminated segment by segment of
the row, in tiers of longer and longer segments; only graphs whose segments hold too many ties
to others are left to preconditioned conjugate gradients in Spark rounds.  No task holds a graph.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrane.functions.geometry import POSE, pose, pose_inv
from terrane.operators.ordering import placed, running
from terrane.operators.trajectory import inverses, multiply, pose_product, turns
from terrane.plans.lineage import cut

_POSE = "struct<" + ",".join(f"{n}:double" for n in POSE) + ">"


def crosses(v: np.ndarray) -> np.ndarray:
    """Matrices that take the cross product with each vector from the left."""
    out = np.zeros((len(v), 3, 3))
    out[:, 0, 1], out[:, 0, 2], out[:, 1, 2] = -v[:, 2], v[:, 1], -v[:, 0]
    return out - out.transpose(0, 2, 1)


def linearised(source: np.ndarray, target: np.ndarray, measured: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Residuals (rows of six: turn, then shift) of edges, and their derivatives by the difference of the ends' steps."""
    off = multiply(inverses(measured), multiply(inverses(target), source))
    sign = np.where(off[:, 6] < 0, -1.0, 1.0)[:, None]
    residual = np.concatenate([2 * sign * off[:, 3:6], off[:, :3]], axis=1)
    own = np.zeros((len(off), 6, 6))
    own[:, :3, :3] = sign[:, :, None] * (off[:, 6, None, None] * np.eye(3) + crosses(off[:, 3:6]))
    own[:, 3:, 3:] = turns(off[:, 3:])
    back = turns(source[:, 3:]).transpose(0, 2, 1)
    moved = np.zeros((len(off), 6, 6))
    moved[:, :3, :3] = moved[:, 3:, 3:] = back
    moved[:, 3:, :3] = -back @ crosses(source[:, :3])
    return residual, own @ moved


def steps(d: np.ndarray) -> np.ndarray:
    """Poses of steps."""
    angle = np.linalg.norm(d[:, :3], axis=1, keepdims=True)
    axis = np.divide(d[:, :3], angle, out=np.zeros_like(d[:, :3]), where=angle > 1e-12)
    return np.concatenate([d[:, 3:], axis * np.sin(angle / 2), np.cos(angle / 2)], axis=1)


def build(odometry: DataFrame, closures: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of pose graphs from constraints (graph_id, source_id, target_id, pose[, weight, information]).

    Odometry constraints go from a smaller to a larger id and are certain, closures go from
    a larger to a smaller and are not; others raise.  Nodes begin where the odometry
    constraints, one after the other, put them, the first at rest.
    """
    def checked(c: DataFrame, uncertain: bool) -> DataFrame:
        right = F.col("source_id") > F.col("target_id") if uncertain else F.col("source_id") < F.col("target_id")
        named = "closures lead from larger to smaller ids" if uncertain else "odometry leads from smaller to larger ids"
        more = [F.col("information") if "information" in c.columns else F.lit(None).cast("array<double>").alias("information")]
        weight = F.col("weight") if "weight" in c.columns else F.lit(1.0).alias("weight")
        c = c.select("graph_id", F.when(F.assert_true(right, F.lit(named)).isNull(), F.col("source_id")).alias("source_id"), "target_id", "pose", weight, *more)
        return c.withColumn("uncertain", F.lit(uncertain))

    certain = checked(odometry, False)
    chain = certain.select(F.col("graph_id").alias("session_id"), F.col("target_id").alias("t_ticks"), pose_inv(F.col("pose")).alias("pose"))
    first = certain.groupBy("graph_id").agg(F.min("source_id").alias("node_id")).withColumn("pose", pose(0.0, 0.0, 0.0))
    nodes = first.unionByName(pose_product(chain).select(F.col("session_id").alias("graph_id"), F.col("t_ticks").alias("node_id"), F.col("product").alias("pose")))
    return nodes, certain.unionByName(checked(closures, True))


def solve(nodes: DataFrame, edges: DataFrame, rounds: int = 20, prune: float = 0.2, preference: float = 2.0, reference: int = 0, direct: int = 256, settle: float = 1e-9) -> DataFrame:
    """Corrected poses of all graphs: (graph_id, node_id, pose, residual).

    ``nodes`` are (graph_id, node_id, pose), ``edges`` (graph_id, source_id, target_id, pose,
    weight, uncertain[, information]), the information six rows of six, turn first; edges
    whose ends are not both nodes are left out.  Gauss-Newton with a line process: an
    uncertain edge whose residual is large against ``preference`` loses weight and is left
    out of a round below ``prune``.  The node ``reference`` stays, or the first where there is
    none.  Where neighbours in the order of ids share no certain edge, a faint one keeps them
    as they are.  Graphs of up to ``direct`` ties are solved in one go, others by elimination.  An empty table of
    nodes gives no rows; nodes of a graph without edges keep their poses.
    """
    at = cut(placed(nodes.select("graph_id", "node_id", "pose"), ["graph_id"], ["node_id"]))
    ties = edges if "information" in edges.columns else edges.withColumn("information", F.lit(None).cast("array<double>"))
    ends = at.select("graph_id", F.col("node_id").alias("source_id"), F.col("place").alias("s"))
    ties = ties.join(ends, ["graph_id", "source_id"]).join(ends.withColumnsRenamed({"source_id": "target_id", "s": "t"}), ["graph_id", "target_id"]).where("s <> t")
    ties = cut(ties.select("graph_id", "s", "t", F.col("pose").alias("measured"), "weight", "uncertain", "information").withColumn("tie", F.monotonically_increasing_id()))
    near = (F.abs(F.col("s") - F.col("t")) == 1) & ~F.col("uncertain")
    row = ties.where(near).groupBy("graph_id", F.greatest("s", "t").alias("place")).agg(F.min("tie").alias("tie"))
    ties = cut(ties.join(row.select("tie", F.lit(True).alias("in_row")), "tie", "left").withColumn("in_row", F.coalesce("in_row", F.lit(False))))
    fixed = at.groupBy("graph_id").agg(F.coalesce(F.min(F.when(F.col("node_id") == reference, F.col("place"))), F.lit(0)).alias("fixed"))
    kinds = dict(at.dtypes)
    shape = f"graph_id {kinds['graph_id']}, node_id {kinds['node_id']}, pose {_POSE}, place bigint, size double"
    cost = ties.select("graph_id", F.lit(0.0).alias("residual")).limit(0)
    for _ in range(rounds):
        wishes = cut(_wishes(ties, at, prune, preference))
        cost = wishes.groupBy("graph_id").agg(F.sum("cost").alias("residual"))
        stepped = cut(_steps(at, wishes, fixed, direct).mapInPandas(_apply, shape))
        at = stepped.drop("size")
        if stepped.where(F.col("size") > settle).isEmpty():
            break
    return at.join(cost, "graph_id", "left").select("graph_id", "node_id", "pose", F.coalesce("residual", F.lit(0.0)).alias("residual"))


def _rows(column: pd.Series, width: int) -> np.ndarray:
    return np.stack(column.to_numpy()) if len(column) else np.zeros((0, width))


def _times(matrices: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    return np.einsum("nij,nj->ni", matrices.reshape(-1, 6, 6), vectors)


def _added(column: str) -> Column:
    """The sum of arrays of six over a group."""
    return F.array(*(F.sum(F.element_at(column, i + 1)) for i in range(6))).alias(column)


_TIE = "tie bigint, lo bigint, hi bigint, "
_ARRAY = "array<double>"


def _wishes(ties: DataFrame, at: DataFrame, prune: float, preference: float) -> DataFrame:
    """What each edge asks of the steps over its stretch (lo, hi]: (graph_id, tie, lo, hi, in_row, cost, m, c)."""
    ends = at.select("graph_id", "place", F.array(*(F.col(f"pose.{n}") for n in POSE)).alias("p"))
    source = ends.select("graph_id", F.col("place").alias("s"), F.col("p").alias("ps"))
    target = ends.select("graph_id", F.col("place").alias("t"), F.col("p").alias("pt"))
    met = ties.withColumn("z", F.array(*(F.col(f"measured.{n}") for n in POSE))).drop("measured").join(source, ["graph_id", "s"]).join(target, ["graph_id", "t"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for t in batches:
            e, a = linearised(_rows(t["ps"], 7), _rows(t["pt"], 7), _rows(t["z"], 7))
            info = np.array([np.eye(6) if x is None else np.reshape(x, (6, 6)) for x in t["information"]]).reshape(-1, 6, 6)
            weight, quad = t["weight"].to_numpy(np.float64), np.einsum("ni,nij,nj->n", e, info, e)
            line = np.where(t["uncertain"].to_numpy(bool), (preference / (preference + weight * quad)) ** 2, 1.0)
            weight = weight * line
            w = weight[:, None, None] * (a.transpose(0, 2, 1) @ info @ a)
            w += (1e-9 * np.trace(w, axis1=1, axis2=2) / 6 + 1e-12)[:, None, None] * np.eye(6)
            m = np.where(t["s"] > t["t"], -1.0, 1.0)[:, None] * (np.linalg.pinv(a) @ e[:, :, None])[:, :, 0]
            out = t[["graph_id", "tie", "in_row"]].assign(lo=t[["s", "t"]].min(axis=1), hi=t[["s", "t"]].max(axis=1), cost=weight * quad, m=list(m), c=list(np.linalg.inv(w).reshape(-1, 36)))
            yield out[line >= prune]

    return met.mapInPandas(run, f"graph_id {dict(at.dtypes)['graph_id']}, {_TIE}in_row boolean, cost double, m {_ARRAY}, c {_ARRAY}")


#: Covariance of the faint edge between neighbours that share none.
_FAINT = 1e6


def _steps(at: DataFrame, wishes: DataFrame, fixed: DataFrame, direct: int) -> DataFrame:
    """The nodes with their steps ``d``."""
    chain = wishes.where("in_row").select("graph_id", F.col("hi").alias("place"), F.concat("m", "c").alias("w"))
    none, faint = ([0.0] * 6 + [scale * (i == j) for i in range(6) for j in range(6)] for scale in (0.0, _FAINT))
    row = at.select("graph_id", "place").join(chain, ["graph_id", "place"], "left")
    row = cut(row.withColumn("w", F.coalesce("w", F.when(F.col("place") == 0, F.lit(none)).otherwise(F.lit(faint)))))
    ties = wishes.where("not in_row").select("graph_id", "tie", "lo", "hi", "m", "c")
    many = ties.groupBy("graph_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > direct).select("graph_id")
    if many.isEmpty():
        moved = _by_forces(row, ties, direct)
    else:
        many = cut(many)
        edges, nodes, tiers, entangled = _tiers(ties.join(many, "graph_id", "left_semi"), row.join(many, "graph_id", "left_semi"))
        good = cut(many.join(entangled, "graph_id", "left_anti"))
        moved = _by_elimination(edges.join(good, "graph_id", "left_semi"), nodes.join(good, "graph_id", "left_semi"), tiers)
        others = row.join(good, "graph_id", "left_anti")
        if not others.isEmpty():
            moved = moved.unionByName(_by_forces(others, ties.join(good, "graph_id", "left_anti"), direct))
    rest = moved.join(fixed, "graph_id").where("place = fixed").select("graph_id", F.col("d").alias("rest"))
    return at.join(moved, ["graph_id", "place"]).join(rest, "graph_id").withColumn("d", F.zip_with("d", "rest", lambda x, y: x - y)).select("graph_id", "node_id", "place", F.array(*(F.col(f"pose.{n}") for n in POSE)).alias("p"), "d")


def _by_forces(row: DataFrame, ties: DataFrame, direct: int) -> DataFrame:
    """(graph_id, place, d): the steps that the row asks for, and what the ties' forces add."""
    graph = f"graph_id {dict(row.dtypes)['graph_id']}"
    sums = cut(running(row, ["graph_id"], "place", "w"))
    for end in ("lo", "hi"):
        ties = ties.join(sums.select("graph_id", F.col("place").alias(end), F.col("w").alias(f"w_{end}")), ["graph_id", end])
    forces = _forces(cut(ties), direct)
    pulls = forces.select("graph_id", F.col("hi").alias("place"), "l").unionByName(forces.select("graph_id", F.col("lo").alias("place"), F.transform("l", lambda x: -x).alias("l")))
    pulled = row.join(pulls.groupBy("graph_id", "place").agg(_added("l")), ["graph_id", "place"], "left").withColumn("l", F.coalesce("l", F.lit([0.0] * 6)))

    def grow(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for t in batches:
            w = _rows(t["w"], 42)
            yield t[["graph_id", "place"]].assign(d=list(w[:, :6] + _times(w[:, 6:], _rows(t["l"], 6) - _rows(t["f"], 6))))

    grown = running(pulled.withColumn("f", F.col("l")), ["graph_id"], "place", "f").mapInPandas(grow, f"{graph}, place bigint, d {_ARRAY}")
    return cut(running(cut(grown), ["graph_id"], "place", "d"))


#: Nodes of a segment of the row that a task eliminates from at first, segments that a segment of the next tier joins, and nodes that a task takes at most.
_NODES, _FAN, _FRONT = 64, 16, 600


def _segment(place: str, tier: int) -> Column:
    return F.floor(F.col(place) / (_NODES * _FAN**tier)).cast("long")


def _tiers(ties: DataFrame, row: DataFrame) -> tuple[DataFrame, DataFrame, int, DataFrame]:
    """(edges with the tier at which one segment holds both ends, nodes with that of their last edge, number of tiers, graphs too entangled)."""
    longest, tiers = row.agg(F.max("place")).first()[0] or 0, 1
    while longest >= _NODES * _FAN ** (tiers - 1):
        tiers += 1
    tier = F.lit(tiers - 1)
    for t in reversed(range(tiers - 1)):
        tier = F.when(_segment("lo", t) == _segment("hi", t), t).otherwise(tier)
    chain = row.where("place > 0").select("graph_id", (F.col("place") - 1).alias("lo"), F.col("place").alias("hi"), F.slice("w", 1, 6).alias("m"), F.slice("w", 7, 36).alias("c"))
    edges = cut(chain.unionByName(ties.select("graph_id", "lo", "hi", "m", "c")).withColumn("tier", tier))
    ends = edges.select("graph_id", F.col("lo").alias("place"), "tier").unionByName(edges.select("graph_id", F.col("hi").alias("place"), "tier"))
    nodes = cut(ends.groupBy("graph_id", "place").agg(F.max("tier").alias("tier")))
    wide = nodes.select("graph_id").limit(0)
    for t in range(1, tiers):
        wide = wide.unionByName(nodes.where(F.col("tier") >= t).groupBy("graph_id", _segment("place", t).alias("segment")).agg(F.count("*").alias("n")).where(F.col("n") > _FRONT).select("graph_id"))
    return edges, nodes, tiers, wide.distinct()


def _by_elimination(edges: DataFrame, nodes: DataFrame, tiers: int) -> DataFrame:
    """(graph_id, place, d): the steps that meet all edges best, the first node at rest.

    The row is cut into segments.  A task takes the edges within one, eliminates the nodes that no
    other edge holds, and hands what is asked of the others on to the next tier, where a
    segment joins ``_FAN`` of these.  Steps then come down the tiers.
    """
    graph = f"graph_id {dict(nodes.dtypes)['graph_id']}"
    shape = f"{graph}, own array<bigint>, others array<bigint>, back {_ARRAY}, y {_ARRAY}, h {_ARRAY}, g {_ARRAY}"

    def eliminated(rest: bool) -> Callable[[pd.DataFrame], pd.DataFrame]:
        def run(t: pd.DataFrame) -> pd.DataFrame:
            node, edge, front = (t[t["kind"] == k] for k in ("node", "edge", "front"))
            node = node.sort_values("lo")
            ids, goes = node["lo"].to_numpy(np.int64), node["goes"].to_numpy(bool)
            n = len(ids)
            h, g = np.zeros((n, n, 6, 6)), np.zeros((n, 6))
            for at, m, b in zip(front["others"], front["h"], front["g"], strict=True):
                k = np.searchsorted(ids, at)
                h[k[:, None], k[None]] += np.reshape(m, (len(k), 6, len(k), 6)).transpose(0, 2, 1, 3)
                g[k] += np.reshape(b, (-1, 6))
            if len(edge):
                lo, hi = (np.searchsorted(ids, edge[e].to_numpy(np.int64)) for e in ("lo", "hi"))
                w = np.linalg.inv(_rows(edge["c"], 36).reshape(-1, 6, 6))
                pull = _times(w, _rows(edge["m"], 6))
                for a, b, sign in ((hi, hi, 1.0), (lo, lo, 1.0), (hi, lo, -1.0), (lo, hi, -1.0)):
                    np.add.at(h, (a, b), sign * w)
                np.add.at(g, hi, pull)
                np.add.at(g, lo, -pull)
            if rest and ids[0] == 0:
                h[0, 0] += np.eye(6)
            full, asked = h.transpose(0, 2, 1, 3).reshape(6 * n, 6 * n), g.ravel()
            i, j = ((6 * np.flatnonzero(x)[:, None] + np.arange(6)).ravel() for x in (goes, ~goes))
            cross = full[np.ix_(i, j)]
            back = np.linalg.solve(full[np.ix_(i, i)], np.column_stack([cross, asked[i]]))
            left, still = full[np.ix_(j, j)] - cross.T @ back[:, :-1], asked[j] - cross.T @ back[:, -1]
            return pd.DataFrame({"graph_id": t["graph_id"].iloc[:1].to_numpy(), "own": [ids[goes]], "others": [ids[~goes]], "back": [back[:, :-1].ravel()], "y": [back[:, -1]], "h": [left.ravel()], "g": [still]})

        return run

    def down(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for t in batches:
            for key, own, back, y, x in zip(t["graph_id"], t["own"], t["back"], t["y"], t["x"], strict=True):
                if len(own):
                    d = y if x is None or not len(x) else y - np.reshape(back, (6 * len(own), -1)) @ np.concatenate(list(x))
                    yield pd.DataFrame({"graph_id": key, "place": own, "d": list(np.reshape(d, (-1, 6)))})

    fronts: list[DataFrame] = []
    for t in range(tiers):
        rows = nodes.where(F.col("tier") >= t).select("graph_id", _segment("place", t).alias("segment"), F.lit("node").alias("kind"), F.col("place").alias("lo"), (F.col("tier") == t).alias("goes"))
        rows = rows.unionByName(edges.where(F.col("tier") == t).select("graph_id", _segment("lo", t).alias("segment"), F.lit("edge").alias("kind"), "lo", "hi", "m", "c"), allowMissingColumns=True)
        if fronts:
            front = fronts[-1].where(F.size("others") > 0).withColumn("lo", F.element_at("others", 1))
            rows = rows.unionByName(front.select("graph_id", _segment("lo", t).alias("segment"), F.lit("front").alias("kind"), "others", "h", "g"), allowMissingColumns=True)
        else:
            rows = rows.withColumns({c: F.lit(None).cast("array<bigint>" if c == "others" else _ARRAY) for c in ("others", "h", "g")})
        fronts.append(cut(rows.groupBy("graph_id", "segment").applyInPandas(eliminated(t == 0), shape).withColumn("segment", F.monotonically_increasing_id())))
    moved = None
    for front in reversed(fronts):
        known = front.withColumn("x", F.lit(None).cast(f"array<{_ARRAY}>"))
        if moved is not None:
            asks = front.select("graph_id", "segment", F.posexplode("others").alias("nth", "place")).join(moved, ["graph_id", "place"])
            given = asks.groupBy("segment").agg(F.transform(F.sort_array(F.collect_list(F.struct("nth", "d"))), lambda s: s["d"]).alias("x"))
            known = front.join(given, "segment", "left")
        step = cut(known.select("graph_id", "own", "back", "y", "x").mapInPandas(down, f"{graph}, place bigint, d {_ARRAY}"))
        moved = step if moved is None else cut(moved.unionByName(step))
    return moved


def _apply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for t in batches:
        d = _rows(t["d"], 6)
        new = multiply(steps(d), _rows(t["p"], 7))
        yield t[["graph_id", "node_id"]].assign(pose=[dict(zip(POSE, map(float, p), strict=True)) for p in new], place=t["place"], size=np.abs(d).max(axis=1, initial=0.0))


def _forces(ties: DataFrame, direct: int) -> DataFrame:
    """(graph_id, lo, hi, l): the forces of all ties."""
    shape = f"graph_id {dict(ties.dtypes)['graph_id']}, lo bigint, hi bigint, l {_ARRAY}"
    many = ties.groupBy("graph_id").agg(F.count(F.lit(1)).alias("n"))
    few, rest = (many.where(x).select("graph_id") for x in (F.col("n") <= direct, F.col("n") > direct))
    at_once = ties.join(few, "graph_id", "left_semi").groupBy("graph_id").applyInPandas(_solved, shape)
    return at_once if rest.isEmpty() else at_once.unionByName(_by_gradients(ties.join(rest, "graph_id", "left_semi")))


def _asked(t: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Covariances of the row up to either end, and what each tie still asks for."""
    lo, hi = _rows(t["w_lo"], 42), _rows(t["w_hi"], 42)
    return lo[:, 6:].reshape(-1, 6, 6), hi[:, 6:].reshape(-1, 6, 6), _rows(t["m"], 6) - hi[:, :6] + lo[:, :6]


def _solved(t: pd.DataFrame) -> pd.DataFrame:
    """The forces of one graph's ties: two ties share the covariance of the stretch that both span."""
    n, (p_lo, p_hi, b) = len(t), _asked(t)
    lo, hi, own = t["lo"].to_numpy(), t["hi"].to_numpy(), np.arange(n)
    last = np.where(hi[:, None] <= hi[None], own[:, None], own[None])
    first = np.where(lo[:, None] >= lo[None], own[:, None], own[None])
    k = np.where((hi[last] > lo[first])[:, :, None, None], p_hi[last] - p_lo[first], 0.0)
    k[own, own] += _rows(t["c"], 36).reshape(n, 6, 6)
    forces = np.linalg.solve(k.transpose(0, 2, 1, 3).reshape(6 * n, 6 * n), b.ravel())
    return t[["graph_id", "lo", "hi"]].assign(l=list(forces.reshape(n, 6)))


def _by_gradients(ties: DataFrame, tolerance: float = 1e-10, most: int = 1000) -> DataFrame:
    """The same by conjugate gradients, all graphs in step, each tie preconditioned by its own stretch."""
    graph = f"graph_id {dict(ties.dtypes)['graph_id']}, "

    def begin(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for t in batches:
            p_lo, p_hi, b = _asked(t)
            own = np.linalg.inv(_rows(t["c"], 36).reshape(-1, 6, 6) + p_hi - p_lo)
            z = _times(own, b)
            yield t[["graph_id", "tie", "lo", "hi", "c"]].assign(v=list(own.reshape(-1, 36)), l=list(np.zeros_like(b)), r=list(b), p=list(z), rz=(b * z).sum(1))

    ends = [ties.select("graph_id", "tie", F.col(e).alias("at"), F.lit(sign).alias("sign"), F.slice(f"w_{e}", 7, 36).alias("g")) for e, sign in (("lo", -1.0), ("hi", 1.0))]
    events = placed(ends[0].unionByName(ends[1]), ["graph_id"], ["at", "tie", "sign"])
    before = events.select("graph_id", (F.col("place") + 1).alias("place"), F.col("g").alias("before"))
    events = cut(events.join(before, ["graph_id", "place"], "left").withColumn("g", F.zip_with("g", F.coalesce("before", "g"), lambda x, y: x - y)).drop("before", "at"))
    state = cut(ties.mapInPandas(begin, f"{graph}{_TIE}" + ", ".join(f"{n} {_ARRAY}" for n in ("c", "v", "l", "r", "p")) + ", rz double"))
    scale = cut(state.groupBy("graph_id").agg(F.sum("rz").alias("rz")).withColumn("rz0", F.col("rz")))

    def pull(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for t in batches:
            yield t[["graph_id", "tie", "place", "sign"]].assign(y=list(_times(_rows(t["g"], 36), _rows(t["a"], 6) - _rows(t["f"], 6))))

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for t in batches:
            p = _rows(t["p"], 6)
            q = _rows(t["y"], 6) + _times(_rows(t["c"], 36), p)
            yield t.drop(columns="y").assign(q=list(q), pq=(p * q).sum(1))

    def advance(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for t in batches:
            along = t["along"].to_numpy()[:, None]
            force, r = _rows(t["l"], 6) + along * _rows(t["p"], 6), _rows(t["r"], 6) - along * _rows(t["q"], 6)
            z = _times(_rows(t["v"], 36), r)
            yield t.drop(columns=["q", "pq", "along"]).assign(l=list(force), r=list(r), z=list(z), rz=(r * z).sum(1))

    for _ in range(most):
        if scale.where(F.col("rz") > F.col("rz0") * tolerance**2).isEmpty():
            break
        pulls = events.join(state.select("graph_id", "tie", "p"), ["graph_id", "tie"]).withColumn("a", F.transform("p", lambda x: x * F.col("sign"))).drop("p").withColumn("f", F.col("a"))
        grown = running(pulls, ["graph_id"], "place", "f").mapInPandas(pull, f"{graph}tie bigint, place bigint, sign double, y {_ARRAY}")
        over = running(cut(grown), ["graph_id"], "place", "y").withColumn("y", F.transform("y", lambda x: x * F.col("sign"))).groupBy("graph_id", "tie").agg(_added("y"))
        kinds = dict(state.dtypes)
        shape = {n: f"{n} {kinds[n]}" for n in ("graph_id", "tie", "lo", "hi", "c", "v", "l", "r", "p", "rz")}
        met = state.select(*shape).join(over, ["graph_id", "tie"]).select(*shape, "y")
        state = cut(met.mapInPandas(measure, ", ".join(shape.values()) + f", q {_ARRAY}, pq double"))
        still = F.col("s.rz") > F.col("rz0") * tolerance**2
        along = scale.alias("s").join(state.groupBy("graph_id").agg(F.sum("pq").alias("sum")), "graph_id").select("graph_id", F.when(still, F.col("s.rz") / F.col("sum")).otherwise(0.0).alias("along"))
        state = cut(state.join(along, "graph_id").mapInPandas(advance, ", ".join(shape.values()) + f", z {_ARRAY}"))
        now = state.groupBy("graph_id").agg(F.sum("rz").alias("now"))
        turned = cut(scale.join(now, "graph_id").select("graph_id", F.col("now").alias("rz"), "rz0", F.when(F.col("rz") > 0, F.col("now") / F.col("rz")).otherwise(0.0).alias("turn")))
        turn = turned.select("graph_id", "turn")
        state = state.join(turn, "graph_id").withColumn("p", F.zip_with("z", F.transform("p", lambda x: x * F.col("turn")), lambda x, y: x + y)).drop("z", "turn")
        scale = turned.drop("turn")
    return state.select("graph_id", "lo", "hi", "l")
