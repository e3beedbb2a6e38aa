"""Odometry and mapping of sessions that fit a task, many of them side by side.

The steps are those of ``mapper``, scan after scan, on arrays of a few sessions at a time: what
a session left and its new scans come sorted to its task, and poses, heads and voxel sums leave it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import TYPE_CHECKING

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from terrane.operators.fits import fit_all, placed, rows_of, runs
from terrane.operators.trajectory import inverses, multiply

if TYPE_CHECKING:
    from terrane.streaming.mapper import Mapping

#: Rows that go to a session's task: its head, its map, its last scan, its new scans.
HEAD, VOXELS, LAST, NEW = range(4)
#: Numbers of a voxel, and poses of a head (null ones are not numbers).
CELL, HEADED = ("vx", "vy", "vz", "n", "sx", "sy", "sz"), ("odometry_now", "odometry", "pose", "inserted", "begin")
#: Poses of a row that comes back, seven numbers each: of the scan, and of the session's newest scan what later ones build on.
NUMBERED = ("odometry", "pose", "last_odometry", "last_pose", "inserted")
#: What comes back: a row for each new scan (``last_ticks`` in a session's newest only) and one for each voxel with new points; narrow, since wide rows of structs are slow to read.
FOLLOWED = "session_id long, t_ticks long, moved boolean, fitness double, status string, numbers array<double>, last_ticks long, " + ", ".join(f"{c} long" for c in CELL)
_REST = np.array([0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 1.0])
_KINDS = {"t_ticks": pa.int64(), "moved": pa.bool_(), "fitness": pa.float64(), "status": pa.string(), "numbers": pa.list_(pa.float64()), "last_ticks": pa.int64()}
_NAMES = ["session_id", *_KINDS, *CELL]


def spark_hash(columns: np.ndarray) -> np.ndarray:
    """``xxhash64`` of int columns, as Spark has it."""
    p1, p2, p3, p5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5))
    h = np.full(len(columns), 42, np.uint64)
    for v in columns.T:
        h = (h + p5 + np.uint64(4)) ^ ((v.astype(np.int64).view(np.uint64) & np.uint64(0xFFFFFFFF)) * p1)
        h = ((h << np.uint64(23)) | (h >> np.uint64(41))) * p2 + p3
        for shift, by in ((33, p2), (29, p3), (32, np.uint64(1))):
            h = (h ^ (h >> np.uint64(shift))) * by
    return h.view(np.int64)


def _merged(of: np.ndarray, cells: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The voxel sums of each session, one row a voxel."""
    order = np.lexsort((cells[:, 2], cells[:, 1], cells[:, 0], of))
    of, cells = of[order], cells[order]
    begin = runs(of, *cells[:, :3].T)[:-1]
    if not len(of):
        return of, cells
    return of[begin], np.concatenate([cells[begin, :3], np.add.reduceat(cells[:, 3:], begin, axis=0)], axis=1)


def _cells(p: np.ndarray, size: float) -> np.ndarray:
    voxels = np.floor(p / size)
    if (np.abs(voxels) >= 2**31).any():
        raise OverflowError("a point lies too far out for the voxels of the map")
    return np.concatenate([voxels, np.ones((len(p), 1)), np.floor(p * 1e6 + 0.5)], axis=1).astype(np.int64)


def follow(t: pa.Table, s: Mapping, solve: Callable[[np.ndarray], np.ndarray], terms: Callable) -> Iterator[pa.RecordBatch]:
    """What the mapper finds for whole sessions: (session_id, kind, t_ticks, point_id, x, y, z, cell, head), sorted up to ``point_id``."""
    number = lambda c, of=t: pc.fill_null(of.column(c), 0).to_numpy()
    session, kind = number("session_id"), number("kind")
    begin = runs(session)
    count, ids = len(begin) - 1, session[begin[:-1]]
    of = np.repeat(np.arange(count), np.diff(begin))
    head = np.full((count, len(HEADED), 7), np.nan)
    head[of[kind == HEAD]] = t.column("head").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, len(HEADED), 7)
    state_of, state = _merged(of[kind == VOXELS], t.column("cell").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, len(CELL)).astype(np.int64))

    points = np.flatnonzero(kind >= LAST)
    p, point_id, of, kind, time = np.stack([number(c)[points] for c in "xyz"], axis=1), number("point_id")[points], of[points], kind[points], number("t_ticks")[points]
    at = runs(of, kind, time)
    scan, fresh, stamp, size = of[at[:-1]], kind[at[:-1]] == NEW, time[at[:-1]], np.diff(at)
    first = np.searchsorted(scan + 0.5 * fresh, np.arange(count) + 0.5)  # a session's first new scan
    steps = np.bincount(scan[fresh], minlength=count)

    # odometry: each new scan on the one before it
    pairs = np.flatnonzero(fresh[1:] & (scan[1:] == scan[:-1])) + 1
    (i, mine), (j, theirs) = (rows_of(at[k], at[k + 1]) for k in (pairs, pairs - 1))
    got, _, n, _ = fit_all(p[i], mine, p[j], theirs, point_id[j], np.tile(_REST, (len(pairs), 1)), s.radius, s.rounds, solve, terms)
    motion, moved = np.tile(_REST, (len(scan), 1)), np.zeros(len(scan), bool)
    moved[pairs] = n / size[pairs] > s.odometry_fitness
    motion[pairs[moved[pairs]]] = got[moved[pairs]]
    for k in range(1, steps.max(initial=0)):
        r = first[steps > k] + k
        motion[r] = multiply(motion[r - 1], motion[r])
    now, last, pose, inserted, start = (head[:, k].copy() for k in range(len(HEADED)))
    odometry = multiply(np.where(np.isnan(now), _REST, now)[scan], motion)
    start = np.where(np.isnan(start), _REST, start)

    found, fitness, status, accepted_at = np.full((len(scan), 7), np.nan), np.full(len(scan), np.nan), np.full(len(scan), "first", object), np.zeros(count, np.int64)
    added_of, added = [state_of[:0]], [state[:0]]
    for k in range(steps.max(initial=0)):
        own = np.flatnonzero(steps > k)
        r = first[own] + k
        known = ~np.isnan(pose[own, 0])
        guess = np.where(known[:, None], pose[own], start[own])
        follows = known & moved[r]
        before = np.where(np.isnan(last[own]), odometry[r], last[own])
        guess[follows] = multiply(guess, multiply(inverses(before), odometry[r]))[follows]
        good, found[r], fitness[r] = ~known, guess, 1.0
        if known.any():
            on, q = np.flatnonzero(known), r[known]
            i, mine = rows_of(at[q], at[q + 1])
            near = np.sqrt(p[i, 0] * p[i, 0] + p[i, 1] * p[i, 1] + p[i, 2] * p[i, 2]) <= s.reach
            i, mine = i[near], mine[near]
            place = np.full(count, -1)
            place[own[on]] = np.arange(len(on))
            to = place[state_of]
            means = state[:, 4:] / 1e6 / state[:, 3:4]
            away = means - guess[on][to, :3]
            inside = (to >= 0) & (away[:, 0] * away[:, 0] + away[:, 1] * away[:, 1] + away[:, 2] * away[:, 2] <= s.reach * s.reach)
            got, _, n, _ = fit_all(p[i], mine, means[inside], to[inside], spark_hash(state[inside, :3]), guess[on], s.radius, s.rounds, solve, terms)
            there = np.bincount(mine, minlength=len(on))
            fitness[q] = np.where(there > 0, n / np.maximum(there, 1), np.nan)
            fits = fitness[q] >= s.refinement_fitness
            found[q[fits]], good[on[fits]] = got[fits], True
            status[q] = np.where(fits, "accepted", "rejected")
        away = found[r, :3] - inserted[own, :3]
        enters = good & ~(np.sqrt(away[:, 0] * away[:, 0] + away[:, 1] * away[:, 1] + away[:, 2] * away[:, 2]) < s.least_move)
        i, which = rows_of(at[r[enters]], at[r[enters] + 1])
        cells, cells_of = _cells(placed(p[i], found[r[enters]], which), s.voxel), own[enters][which]
        added_of.append(cells_of)
        added.append(cells)
        state_of, state = _merged(np.concatenate([state_of, cells_of]), np.concatenate([state, cells]))
        now[own] = odometry[r]
        last[own[good]], pose[own[good]], accepted_at[own[good]] = odometry[r[good]], found[r[good]], stamp[r[good]]
        inserted[own[enters]] = found[r[enters]]

    r = np.flatnonzero(fresh)
    if len(r):
        ends = np.append(scan[r][1:] != scan[r][:-1], True)
        numbers = np.concatenate([odometry[r], found[r], *(x[scan[r]] for x in (last, pose, inserted))], axis=1)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(r) + 1, dtype=np.int32) * numbers.shape[1]), pa.array(numbers.ravel()))
        rows = [pa.array(ids[scan[r]]), pa.array(stamp[r]), pa.array(moved[r]), pa.array(fitness[r], mask=np.isnan(fitness[r])), pa.array(status[r], pa.string()), lists, pa.array(accepted_at[scan[r]], mask=~ends)]
        yield pa.RecordBatch.from_arrays([*rows, *(pa.nulls(len(r), pa.int64()) for _ in CELL)], names=_NAMES)
    of, cells = _merged(np.concatenate(added_of), np.concatenate(added))
    if len(of):
        yield pa.RecordBatch.from_arrays([pa.array(ids[of]), *(pa.nulls(len(of), k) for k in _KINDS.values()), *(pa.array(np.ascontiguousarray(c)) for c in cells.T)], names=_NAMES)
