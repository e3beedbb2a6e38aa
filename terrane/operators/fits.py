"""Registration of many pairs of small clouds at once, inside a task.

All pairs of a task go through their rounds side by side, as arrays.  The targets that a source
point can meet while it moves by less than ``radius`` are listed once and listed again for
pairs that moved farther, so that a round compares a few targets for each point.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from terrane.operators.graph import matrix_pose
from terrane.operators.trajectory import multiply, turns

#: Listed targets for each source point of a pair, on average; a pair that has more is searched anew in each round.
_LISTED = 16
#: Points of the source that are compared with the targets beside them at once.
_CHUNK = 64


def whole_groups(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.Table]:
    """Tables of about ``rows`` rows; rows with the same first column, which come together, stay together."""
    held: list[pa.Table] = []
    n = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(pa.Table.from_batches([batch]))
        n += batch.num_rows
        if n >= rows:
            t = pa.concat_tables(held).combine_chunks()
            cut = pc.index(t.column(0), t.column(0)[-1]).as_py()
            if cut:
                yield t.slice(0, cut)
            held, n = [t.slice(cut)], len(t) - cut
    if held:
        yield pa.concat_tables(held).combine_chunks()


def runs(*columns: np.ndarray) -> np.ndarray:
    """Where runs of rows with equal values begin, and the number of rows."""
    new = np.zeros(len(columns[0]), bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return np.append(np.flatnonzero(new), len(new))


def rows_of(begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rows of stretches [begin, end), one stretch after the other, and the stretch of each."""
    size = end - begin
    of = np.repeat(np.arange(len(size)), size)
    return np.arange(len(of)) - (np.cumsum(size) - size)[of] + begin[of], of


def matrix_poses(m: np.ndarray) -> np.ndarray:
    """``matrix_pose`` of many."""
    w2 = np.maximum(0.0, 1 + m[:, 0, 0] + m[:, 1, 1] + m[:, 2, 2])
    plain = w2 > 1e-6
    w = np.sqrt(np.where(plain, w2, 1.0)) / 2
    out = np.stack([m[:, 0, 3], m[:, 1, 3], m[:, 2, 3], (m[:, 2, 1] - m[:, 1, 2]) / (4 * w), (m[:, 0, 2] - m[:, 2, 0]) / (4 * w), (m[:, 1, 0] - m[:, 0, 1]) / (4 * w), w], axis=1)
    for i in np.flatnonzero(~plain):
        out[i] = [*matrix_pose(m[i]).values()]
    return out


def placed(p: np.ndarray, poses: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Points moved by the pose of their group, worked out as ``pose_apply`` does."""
    t = turns(poses[:, 3:])
    return np.stack([t[of, k, 0] * p[:, 0] + t[of, k, 1] * p[:, 1] + t[of, k, 2] * p[:, 2] + poses[of, k] for k in range(3)], axis=1)


def _beside(p: np.ndarray, t: np.ndarray, reach: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(rows of p, rows of t, square distances as a matrix): each point with the targets that lie within reach of it along x, and more."""
    order, own = np.argsort(t[:, 0], kind="stable"), np.argsort(p[:, 0], kind="stable")
    q, room = t[order], reach * (1 + 1e-9) + 1e-12
    for i in range(0, len(own), _CHUNK):
        at = own[i : i + _CHUNK]
        a, b = np.searchsorted(q[:, 0], [p[at[0], 0] - room, p[at[-1], 0] + room])
        if a < b:
            d = [p[at, k][:, None] - q[None, a:b, k] for k in range(3)]
            yield at, order[a:b], d[0] * d[0] + d[1] * d[1] + d[2] * d[2]


def _listed(p: np.ndarray, t: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray] | None:
    """All (row of p, row of t) within reach in this order; None if these are too many."""
    found, n = [(np.zeros(0, int), np.zeros(0, int))], 0
    for at, near, d2 in _beside(p, t, reach):
        i, j = np.nonzero(d2 <= reach * reach)
        n += len(i)
        if n > _LISTED * len(p):
            return None
        found.append((at[i], near[j]))
    i, j = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.lexsort((j, i))
    return i[order], j[order]


def _nearest(p: np.ndarray, t: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of p, row of t, square distance) of the nearest target of each point within the radius, of several the first."""
    found = [(np.zeros(0, int), np.zeros(0, int), np.zeros(0))]
    for at, near, d2 in _beside(p, t, radius):
        least = d2.min(axis=1)
        first = np.where(d2 == least[:, None], near[None], len(t)).min(axis=1)
        ok = least <= radius * radius
        found.append((at[ok], first[ok], least[ok]))
    at, which, d2 = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.argsort(at)
    return at[order], which[order], d2[order]


class _Pairs:
    """Source points and targets of the pairs that still move, with the targets in reach of each point."""

    def __init__(self, p: np.ndarray, of: np.ndarray, t: np.ndarray, to: np.ndarray, count: int, radius: float) -> None:
        self.p, self.of, self.t, self.radius = p, of, t, radius
        self.t_at = np.searchsorted(to, np.arange(count + 1))
        self.base = np.full(p.shape, np.nan)  # where the points lay when their targets were listed
        self.i, self.j = np.zeros(0, int), np.zeros(0, int)
        self.dense: set[int] = set()

    def keep(self, alive: np.ndarray) -> None:
        """Go on with these pairs only."""
        stay = alive[self.of]
        mine = stay[self.i]
        self.i, self.j = (np.cumsum(stay) - 1)[self.i[mine]], self.j[mine]
        self.p, self.of, self.base = self.p[stay], self.of[stay], self.base[stay]

    def _list(self, new: np.ndarray) -> None:
        far = ~(((new - self.base) ** 2).sum(axis=1) <= self.radius * self.radius)
        again = [g for g in np.unique(self.of[far]).tolist() if g not in self.dense]
        if not again:
            return
        left = ~np.isin(self.of[self.i], again)
        parts = [(self.i[left], self.j[left])]
        for g in again:
            a, b = np.searchsorted(self.of, [g, g + 1])
            got = _listed(new[a:b], self.t[self.t_at[g] : self.t_at[g + 1]], 2 * self.radius)
            if got is None:
                self.dense.add(g)
            else:
                parts.append((got[0] + a, got[1] + self.t_at[g]))
            self.base[a:b] = new[a:b]
        i, j = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.argsort(i, kind="stable")  # a point's targets stay in their order
        self.i, self.j = i[order], j[order]

    def nearest(self, new: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(point, target, square distance) of each point that has a target within the radius; ties go to the first target."""
        self._list(new)
        d = [new[self.i, k] - self.t[self.j, k] for k in range(3)]
        d2 = d[0] * d[0] + d[1] * d[1] + d[2] * d[2]
        begin = runs(self.i)
        out = [(np.zeros(0, int), np.zeros(0, int), np.zeros(0))]
        if len(self.i):
            least = np.minimum.reduceat(d2, begin[:-1])
            at = np.flatnonzero(d2 == np.repeat(least, np.diff(begin)))
            at = at[runs(self.i[at])[:-1]]
            at = at[d2[at] <= self.radius * self.radius]
            out.append((self.i[at], self.j[at], d2[at]))
        for g in self.dense:
            a, b = np.searchsorted(self.of, [g, g + 1])
            at, which, far = _nearest(new[a:b], self.t[self.t_at[g] : self.t_at[g + 1]], self.radius)
            out.append((at + a, which + self.t_at[g], far))
        i, j, d2 = (np.concatenate(x) for x in zip(*out, strict=True))
        order = np.argsort(i, kind="stable")
        return i[order], j[order], d2[order]


def fit_all(p: np.ndarray, of: np.ndarray, t: np.ndarray, to: np.ndarray, ids: np.ndarray, start: np.ndarray, radius: float, rounds: int, solve: Callable[[np.ndarray], np.ndarray], terms: Callable, settle: float = 1e-6) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(pose, still open, matches, their root mean square distance) of each pair, as ``register`` finds them.

    ``p`` are source points in the order of their pair ``of``, ``t`` targets with the pair ``to``
    and ``ids``, of which the least wins a tie; all are finite.  ``start`` has a pose for each pair.
    """
    order = np.lexsort((ids, to))
    t, to = t[order], to[order]
    now, open_, count = start.astype(float).copy(), np.ones(len(start), bool), len(start)
    matches, rmse = np.zeros(count, np.int64), np.full(count, np.nan)
    alive = np.ones(count, bool)
    pairs = _Pairs(p, of, t, to, count, radius)
    for used in range(rounds + 1):
        new = placed(pairs.p, now, pairs.of)
        at, which, d2 = pairs.nearest(new)
        g = pairs.of[at]
        n = np.bincount(g, minlength=count)
        ended = alive & (~open_ | (used == rounds))
        total = np.bincount(g, d2, minlength=count)
        some = ended & (n > 0)
        matches[ended], rmse[some] = n[ended], np.sqrt(total[some] / n[some])
        alive &= ~ended
        if not alive.any():
            break
        motion = np.tile(np.eye(4), (count, 1, 1))
        known = alive & (n >= 6)
        if known.any():
            mine = known[g]
            at, which, g = at[mine], which[mine], g[mine]
            v = {f"s_{c}": new[at, k] for k, c in enumerate("xyz")} | {f"t_{c}": t[which, k] for k, c in enumerate("xyz")}
            sums = np.add.reduceat(np.stack(terms(v.__getitem__), axis=1), runs(g)[:-1], axis=0)
            motion[known] = solve(sums)
        now[alive] = multiply(matrix_poses(motion[alive]), now[alive])
        open_[alive] = np.abs(motion[alive] - np.eye(4)).max(axis=(1, 2)) > settle
        if ended.any():
            pairs.keep(alive)
    return now, open_, matches, rmse
