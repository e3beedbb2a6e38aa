"""Approximate nearest neighbours by robust-pruned directed graphs, one for each shard.

Equal vectors are one node, which names the smallest ids that hold it: no search for k rows
can want more than k + 1 of them.  Nodes are dealt to shards of bounded size by their hash.
In a shard, nodes enter the graph in growing batches: greedy searches propose neighbours, and
an edge goes when a kept neighbour is closer to its end by the factor ``slack``, which keeps
edges in many directions.  Queries go through each shard's graph with a beam, in blocks, and
what the beams hold is measured again in double precision.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrane.llm._spark import forget, keep

_HIT = "array<struct<score:double,vec_id:bigint>>"


@dataclass(frozen=True)
class Graph:
    """Nodes in a shard, edges of a node, width of the beam that builds and of the one that is asked, slack of the pruning, queries in a block, neighbours wanted; hot groups go in ``salts`` parts."""

    shard: int = 4096
    edges: int = 32
    beam: int = 64
    width: int = 128
    slack: float = 1.2
    queries: int = 4096
    k: int = 10
    salts: int = 32


def valid(column: str) -> Column:
    """Whether a vector takes part: there, all components finite numbers, one of them not zero."""
    finite = F.forall(column, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(finite & F.exists(column, lambda x: x != 0), F.lit(False))


def nearest(vectors: DataFrame, wanted: Column, spec: Graph = Graph(), id_column: str = "vec_id", column: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): for each row that ``wanted`` marks, the nearest found among all other rows.

    Null, zero and not quite finite vectors take no part, nor do rows of a null id, which
    could not be named.  Vectors of another length are not neighbours.  Rows that share an
    id are rows of their own: each is asked for, and each can be found; only one row of the
    query's own id and vector is left out, itself.  Equal rows therefore find each other at
    distance 0.  Ties go to the smaller id.  Fewer candidates than k give all that are found,
    an empty table no rows.  Other columns, whatever their names, are ignored.
    """
    rows = vectors.select(F.col(id_column).cast("long").alias("id"), F.col(column).alias("v"), F.coalesce(wanted, F.lit(False)).alias("asked")).where(valid("v") & F.col("id").isNotNull())
    index = build_index(rows.select("id", "v"), spec)
    asked = rows.where("asked").select("id", "v")
    hits = search(index, asked.select("v").distinct(), spec)
    salted = hits.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(spec.salts - 1))))
    met = asked.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(spec.salts)).cast("int")).join(salted, ["v", "salt"])
    own = F.array_position("hits", F.struct(F.lit(0.0).alias("score"), F.col("id").alias("vec_id")))
    others = F.slice(F.filter("hits", lambda x, i: i + 1 != F.col("own")), 1, spec.k)
    found = met.withColumn("own", own).select(F.col("id").alias("query_id"), F.posexplode(others).alias("rank", "hit"))
    return found.select("query_id", (F.col("rank") + 1).cast("int").alias("rank"), "hit.vec_id", "hit.score")


def build_index(rows: DataFrame, spec: Graph = Graph()) -> DataFrame:
    """(shard, shards, size, node, v, ids, edges, entry) of the rows (id, v): all their distinct vectors, each with its smallest ids."""
    kind = dict(rows.dtypes)["v"]
    nodes = rows.mapInArrow(_Classes(spec.k + 1), f"v {kind}, ids array<long>")
    least = F.slice(F.array_sort(F.flatten(F.collect_list("ids"))), 1, spec.k + 1)
    parts = nodes.groupBy("v", (F.monotonically_increasing_id() % spec.salts).alias("salt")).agg(least.alias("ids"))
    classes = keep(parts.groupBy("v").agg(least.alias("ids")), "classes")
    sizes = classes.groupBy(F.size("v").alias("size")).agg(F.ceil(F.count(F.lit(1)) / spec.shard).cast("int").alias("shards"))
    dealt = classes.withColumn("size", F.size("v")).join(sizes, "size").withColumn("shard", F.pmod(F.xxhash64("v"), F.col("shards")).cast("int"))
    shape = f"shard int, shards int, size int, node int, v {kind}, ids array<long>, edges array<int>, entry boolean"
    index = keep(dealt.select("shard", "shards", "size", "v", "ids").groupBy("size", "shard").applyInArrow(_graph(spec), shape), "graph")
    forget(classes)
    return index


def search(index: DataFrame, asked: DataFrame, spec: Graph = Graph()) -> DataFrame:
    """(v, hits): for each of the distinct vectors ``asked``, the k + 1 nearest found, nearest first."""
    kind = dict(asked.dtypes)["v"]
    sizes = index.select("size", "shards").distinct()
    sized = asked.withColumn("size", F.size("v"))
    blocks = sized.groupBy("size").agg(F.ceil(F.count(F.lit(1)) / spec.queries).cast("int").alias("blocks"))
    queries = sized.join(blocks, "size").join(sizes, "size").select("size", "v", F.pmod(F.xxhash64("v", F.lit(1)), F.col("blocks")).cast("int").alias("block"), F.explode(F.sequence(F.lit(0), F.col("shards") - 1)).alias("shard"))
    graphs = index.join(blocks, "size").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks", "shards")
    key = ["size", "shard", "block"]
    met = queries.groupBy(*key).cogroup(graphs.groupBy(*key)).applyInArrow(_found(spec), f"v {kind}, shard int, hits {_HIT}")
    least = F.slice(F.array_sort(F.flatten(F.collect_list("hits"))), 1, spec.k + 1)
    parts = met.groupBy("v", (F.col("shard") % spec.salts).alias("salt")).agg(least.alias("hits"))
    return parts.groupBy("v").agg(least.alias("hits"))


class _Classes:
    """Equal vectors of a batch as one row with their smallest ids."""

    def __init__(self, most: int) -> None:
        self.most = most

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors: dict[bytes, tuple[int, list[int]]] = {}
            lists = batch.column("v")
            values, offsets = lists.flatten().to_numpy(zero_copy_only=False) + 0.0, np.cumsum([0, *lists.value_lengths().to_pylist()])
            for i, x in enumerate(batch.column("id").to_pylist()):
                vectors.setdefault(values[offsets[i] : offsets[i + 1]].tobytes(), (i, []))[1].append(x)
            first = pa.array([i for i, _ in vectors.values()], pa.int64())
            ids = pa.array([sorted(ids)[: self.most] for _, ids in vectors.values()], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([lists.take(first), ids], ["v", "ids"])


def beam_search(x: np.ndarray, edges: np.ndarray, entry: int, queries: np.ndarray, width: int, ahead: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, squared distances), nearest first, of the beam that each query ends with; -1 and infinity fill it up.

    ``ahead`` nodes of each beam are expanded at once, until all its nodes are.
    """
    n = len(queries)
    nodes = np.full((n, width), -1, np.int32)
    dist = np.full((n, width), np.inf, np.float32)
    done = np.ones((n, width), bool)
    nodes[:, 0], dist[:, 0], done[:, 0] = entry, ((x[entry] - queries) ** 2).sum(1), False
    seen = np.full((n, len(x)), -1, np.int32)
    seen[:, entry] = 0
    active = np.arange(n)
    while len(active):
        first = np.argsort(done[active], axis=1, kind="stable")[:, :ahead]
        open_ = ~np.take_along_axis(done[active], first, 1)
        done[active[:, None], first] = True
        spread = edges[np.where(open_, np.take_along_axis(nodes[active], first, 1), 0)]
        spread = np.where(open_[:, :, None], spread, -1).reshape(len(active), -1)
        r, c = np.nonzero(spread >= 0)
        to = spread[r, c]
        new = seen[active[r], to] < 0
        r, c, to = r[new], c[new], to[new]
        seen[active[r], to] = c
        new = seen[active[r], to] == c
        r, c, to = r[new], c[new], to[new]
        gap = x[to] - queries[active[r]]
        fresh = np.full(spread.shape, np.inf, np.float32)
        fresh[r, c] = np.einsum("ij,ij->i", gap, gap)
        all_d = np.concatenate([dist[active], fresh], axis=1)
        all_n = np.concatenate([nodes[active], spread], axis=1)
        all_done = np.concatenate([done[active], np.isinf(fresh)], axis=1)
        best = np.argsort(all_d, axis=1, kind="stable")[:, :width]
        dist[active], nodes[active], done[active] = (np.take_along_axis(a, best, 1) for a in (all_d, all_n, all_done))
        active = active[~done[active].all(1)]
    return np.where(np.isinf(dist), -1, nodes), dist


def robust_prune(x: np.ndarray, at: np.ndarray, candidates: np.ndarray, most: int, slack: float) -> np.ndarray:
    """Up to ``most`` of each node's candidates (-1: none), nearest first: one goes if a kept one is ``slack`` times nearer to it than the node is."""
    own = x[candidates] - x[at][:, None]
    d = np.einsum("ijk,ijk->ij", own, own)
    d[(candidates < 0) | (candidates == at[:, None])] = np.inf
    order = np.argsort(d, axis=1, kind="stable")
    d, candidates = np.take_along_axis(d, order, 1), np.take_along_axis(candidates, order, 1)
    y = np.take_along_axis(own, order[:, :, None], 1)
    norm = np.einsum("ijk,ijk->ij", y, y)
    between = np.maximum(norm[:, :, None] + norm[:, None, :] - 2 * (y @ y.transpose(0, 2, 1)), 0)
    alive = np.isfinite(d)
    alive[:, 1:] &= candidates[:, 1:] != candidates[:, :-1]
    out = np.full((len(at), most), -1, np.int32)
    count = np.zeros(len(at), np.int64)
    rows = np.arange(len(at))
    for i in range(candidates.shape[1]):
        take = alive[:, i] & (count < most)
        out[rows[take], count[take]] = candidates[take, i]
        count[take] += 1
        alive[take] &= slack * slack * between[take, i] > d[take]
    return out


def build_graph(x: np.ndarray, spec: Graph = Graph()) -> tuple[np.ndarray, int]:
    """(edges, entry) over the rows of ``x``: nodes enter in a fixed order, in batches that double up to a limit."""
    n = len(x)
    edges = np.full((n, spec.edges), -1, np.int32)
    entry = int(((x - x.mean(0)) ** 2).sum(1).argmin())
    order = np.random.default_rng(n).permutation(n)
    order = np.concatenate([[entry], order[order != entry]])
    at, step = 1, 1
    while at < n:
        _insert(x, edges, entry, order[at : at + step], spec)
        at, step = at + step, min(2 * step, 256)
    for at in range(0, min(n, 512), 256):  # those that came first found few neighbours
        _insert(x, edges, entry, order[at : at + 256], spec)
    return edges, entry


def _insert(x: np.ndarray, edges: np.ndarray, entry: int, new: np.ndarray, spec: Graph) -> None:
    proposed, _ = beam_search(x, edges, entry, x[new], spec.beam)
    edges[new] = robust_prune(x, new, np.concatenate([proposed, edges[new]], axis=1), spec.edges, spec.slack)
    back = edges[new]
    source, target = np.repeat(new, spec.edges), back.ravel()
    source, target = source[target >= 0], target[target >= 0]
    order = np.argsort(target, kind="stable")
    source, target = source[order], target[order]
    ends, begin, count = np.unique(target, return_index=True, return_counts=True)
    there = (edges[ends] >= 0).sum(1)
    for lot in np.array_split(np.argsort(count, kind="stable"), max(1, len(ends) // 256)):
        width = int(count[lot].max(initial=0))
        more = np.full((len(lot), width), -1, np.int32)
        place = np.arange(width) < count[lot][:, None]
        more[place] = source[np.concatenate([np.arange(b, b + c) for b, c in zip(begin[lot], count[lot], strict=True)])] if len(lot) else []
        both = np.concatenate([edges[ends[lot]], more], axis=1)
        full = there[lot] + count[lot] > spec.edges
        edges[ends[lot[full]]] = robust_prune(x, ends[lot[full]], both[full], spec.edges, spec.slack)
        packed = np.take_along_axis(both, np.argsort(both < 0, axis=1, kind="stable"), 1)[:, : spec.edges]
        edges[ends[lot[~full]]] = packed[~full]


def _matrix(column: pa.ChunkedArray, size: int) -> np.ndarray:
    return column.combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, size).astype(np.float64)


def _graph(spec: Graph) -> Callable[[pa.Table], pa.Table]:
    """The graph over the nodes of one shard."""

    def graph(nodes: pa.Table) -> pa.Table:
        nodes = nodes.take(pa.array(np.argsort([x[0] for x in nodes.column("ids").to_pylist()], kind="stable")))
        edges, entry = build_graph(_matrix(nodes.column("v"), nodes.column("size")[0].as_py()).astype(np.float32), spec)
        n = len(nodes)
        there = edges >= 0
        lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(there.sum(1))).astype(np.int32)), pa.array(edges[there]))
        return pa.table({"shard": nodes.column("shard"), "shards": nodes.column("shards"), "size": nodes.column("size"), "node": np.arange(n, dtype=np.int32), "v": nodes.column("v"), "ids": nodes.column("ids"), "edges": lists, "entry": np.arange(n) == entry})

    return graph


def _found(spec: Graph) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """What the block's queries find in the shard's graph."""

    def found(queries: pa.Table, graph: pa.Table) -> pa.Table:
        hits = list(_hits(queries, graph, spec)) if len(graph) and len(queries) else [[]] * len(queries)
        return pa.table({"v": queries.column("v"), "shard": queries.column("shard"), "hits": pa.array(hits, pa.list_(pa.struct([("score", pa.float64()), ("vec_id", pa.int64())])))})

    return found


def _hits(queries: pa.Table, graph: pa.Table, spec: Graph) -> Iterator[list[dict]]:
    """For each query the nearest nodes of its beam, measured again in double precision."""
    size = graph.column("size")[0].as_py()
    graph = graph.sort_by("node")
    x, q = _matrix(graph.column("v"), size), _matrix(queries.column("v"), size)
    ids, entry = graph.column("ids").to_pylist(), int(np.flatnonzero(graph.column("entry").to_numpy())[0])
    edges = np.full((len(x), spec.edges), -1, np.int32)
    lists = graph.column("edges").combine_chunks()
    length = lists.value_lengths().to_numpy()
    edges[np.arange(spec.edges) < length[:, None]] = lists.flatten().to_numpy()
    small = x.astype(np.float32)
    for at in range(0, len(q), 256):
        part = q[at : at + 256]
        nodes, _ = beam_search(small, edges, entry, part.astype(np.float32), max(spec.width, spec.k + 1))
        score = np.sqrt(((x[nodes] - part[:, None]) ** 2).sum(2))
        for row, far in zip(nodes.tolist(), score.tolist(), strict=True):
            found = sorted((s, i) for n, s in zip(row, far, strict=True) if n >= 0 for i in ids[n])
            yield [{"score": s, "vec_id": i} for s, i in found[: spec.k + 1]]
