"""A Merkle manifest of a dataset: a tree over each source's rows, and a tree over the sources.

A tree is cut into aligned blocks of ``arity ** levels`` nodes.  A block is built in one task as a
persistent tree: putting another digest at a leaf makes a version that copies that leaf's
ancestors and shares every other node.  The roots of blocks are the leaves of the next tier,
which is cut into blocks again; a version goes on where it is, along the siblings that the
blocks above hand down.  So no task ever holds more than a block, however large a source is,
and what moves for a row are its digests, not its text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from terrane.llm._spark import forget, keep, partitions

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")

_PATH = "array<struct<before:string,after:string>>"
_ROWS = 2048
_STEPS = pa.list_(pa.struct([("before", pa.string()), ("after", pa.string())]))


@dataclass(frozen=True)
class Tree:
    """Children of a node, and levels in a block of nodes that one task holds."""

    arity: int = 3
    levels: int = 7

    @property
    def block(self) -> int:
        return self.arity**self.levels

    def height(self, n: int) -> int:
        """Levels above ``n`` nodes, those of one block at most."""
        height = 0
        while n > 1 and height < self.levels:
            n, height = -(-n // self.arity), height + 1
        return height


class Node(NamedTuple):
    digest: str
    children: tuple[Node, ...] = ()


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def grow(leaves: list[str], spec: Tree, height: int) -> Node:
    """The node ``height`` levels above the leaves of one block."""
    nodes = [Node(x) for x in leaves]
    for _ in range(height):
        runs = [tuple(nodes[i : i + spec.arity]) for i in range(0, len(nodes), spec.arity)]
        nodes = [Node(digest("".join(c.digest for c in run)), run) for run in runs]
    return nodes[0]


def put(root: Node, at: int, leaf: str, spec: Tree, height: int) -> Node:
    """A version with another leaf: ancestors are copied, all other nodes are those of ``root``."""
    if not height:
        return Node(leaf)
    child, below = divmod(at, spec.arity ** (height - 1))
    copied = put(root.children[child], below, leaf, spec, height - 1)
    children = (*root.children[:child], copied, *root.children[child + 1 :])
    return Node(digest("".join(c.digest for c in children)), children)


def siblings(root: Node, at: int, spec: Tree, height: int) -> list[tuple[str, str]]:
    """What stands before and after the node's own digest in each run, from the leaf upward."""
    found = []
    for level in range(height - 1, -1, -1):
        child, at = divmod(at, spec.arity**level)
        run = [c.digest for c in root.children]
        found.append(("".join(run[:child]), "".join(run[child + 1 :])))
        root = root.children[child]
    return found[::-1]


def leaf_of(*fields: Column) -> Column:
    """Digest of fields, each its length in UTF-8 bytes, a colon and itself, or a dash if null."""
    texts = [f.cast("string") for f in fields]
    return F.sha2(F.concat(*(F.when(t.isNull(), "-").otherwise(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t)) for t in texts)), 256)


def tampered_text(doc_id: Column, text: Column) -> Column:
    """Every other document, by the CRC-32 of its id, loses its line feeds; null ids and texts stay."""
    return F.when(F.crc32(doc_id.cast("string")) % 2 == 0, F.translate(text, "\n", "")).otherwise(text)


def manifest(docs: DataFrame, now: Column | None = None, spec: Tree = Tree(), proofs: bool = False) -> DataFrame:
    """(doc_id, source, place, leaf, subroot, root, proof_sha256, folded_root, verified), a row for each row of ``docs``.

    ``now`` is the text as it is found later: a row is ``verified`` if the root that its leaf
    of then gives with the siblings of before is the root of before.  With ``proofs`` the
    siblings come too: ``proof``, what stands before and after, from leaf to root.  ``place``
    counts from 0 in the source, by doc_id (null first), then leaf.

    Nulls in any column have leaves of their own, and null is a source like any other.
    Rows that share an id stand in the order of their leaves; equal rows have equal leaves,
    and each has its own place.  An empty table gives no rows.  Columns beyond the five of
    the leaf, whatever their names, are ignored.
    """
    leaf = leaf_of(*map(F.col, FIELDS))
    later = F.lit(None).cast("string") if now is None else F.when(~now.eqNullSafe(F.col("text")), leaf_of(*(F.col(c) if c != "text" else now for c in FIELDS)))
    leaves = keep(docs.select("source", F.col("doc_id").alias("name"), leaf.alias("digest"), later.alias("later"), F.monotonically_increasing_id().alias("dealt")), "leaves")
    at, runs = _in_order(leaves, "source", "name", "digest", "dealt")
    forget(leaves)
    sources = runs.select("source").distinct().withColumn("all", F.lit(0)).withColumn("dealt", F.lit(0))
    trees = keep(_numbered(*_in_order(sources, "all", "source"), "all").select("source", F.col("idx").alias("tree"), F.col("n").alias("of")), "trees")
    runs = runs.alias("r").join(trees.alias("t"), F.col("r.source").eqNullSafe(F.col("t.source"))).select("r.*", "tree")
    rows = _numbered(at, runs, "source")

    tiers, subroots = _climb(rows.select("tree", "idx", "n", "digest"), spec)
    tops = subroots[0]
    for more in subroots[1:]:
        tops = tops.unionByName(more)
    upper, roots = _climb(tops.join(trees, "tree").select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("idx"), F.col("of").alias("n"), "digest"), spec)
    paths = _from_root(upper, [r.select("tree", "block", F.lit(None).cast("string").alias("subroot"), F.col("digest").alias("root"), F.array().cast(_PATH).alias("path")) for r in roots], spec)
    paths = keep(_descend(upper[0], paths, spec).select(F.col("idx").alias("tree"), "root", "path"), "paths")
    above = _from_root(tiers, [r.join(paths, "tree").select("tree", "block", F.col("digest").alias("subroot"), "root", "path") for r in subroots], spec)
    shape = f"doc_id {dict(docs.dtypes)['doc_id']}, source string, place long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    return _blocks(rows.select("tree", "idx", "n", "digest", "name", "source", "later"), spec, above).mapInArrow(_Versions(spec, proofs), shape + f", proof {_PATH}" * proofs)


def _in_order(df: DataFrame, group: str, *order: str) -> tuple[DataFrame, DataFrame]:
    """The rows in the order of group and columns, ``at`` ascending with it, and the runs of groups in partitions.

    Rows are dealt out by ranges of all these columns, so a group of any size is spread.
    """
    ranges = df.repartitionByRange(partitions(df.sparkSession), group, *order).sortWithinPartitions(group, *order)
    at = keep(ranges.withColumn("at", F.monotonically_increasing_id()).withColumn("part", F.spark_partition_id()), "in-order")
    runs = at.groupBy(group, "part").agg(F.count(F.lit(1)).alias("rows"), F.min("at").alias("first"))
    in_group = Window.partitionBy(group)  # a row for each partition that has rows of the group
    before = F.coalesce(F.sum("rows").over(in_group.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return at, runs.select(group, "part", "first", before.alias("before"), F.sum("rows").over(in_group).alias("n"))


def _numbered(at: DataFrame, runs: DataFrame, group: str) -> DataFrame:
    """Each row's ``idx`` in its group, from 0, and the group's size ``n``."""
    met = at.alias("a").join(runs.alias("r"), F.col(f"a.{group}").eqNullSafe(F.col(f"r.{group}")) & (F.col("a.part") == F.col("r.part")))
    more = [f"r.{c}" for c in runs.columns if c not in (group, "part", "first", "before")]
    return met.select("a.*", (F.col("r.before") + F.col("a.at") - F.col("r.first")).alias("idx"), *more)


def _blocks(nodes: DataFrame, spec: Tree, above: DataFrame | None = None) -> DataFrame:
    """Whole blocks side by side in partitions, nodes in order; what stands above a block is its first row, of index -1."""
    rows = nodes.withColumn("block", F.expr(f"idx div {spec.block}"))
    if above is not None:
        rows = rows.unionByName(above.withColumn("idx", F.lit(-1).cast("long")), allowMissingColumns=True)
    return rows.repartition(partitions(nodes.sparkSession), "tree", "block").sortWithinPartitions("tree", "block", "idx")


def _climb(nodes: DataFrame, spec: Tree) -> tuple[list[DataFrame], list[DataFrame]]:
    """The nodes of each tier, and for each tier the roots of the trees that end in it."""
    tiers, ended = [], []
    while True:
        tiers.append(nodes)
        roots = keep(_blocks(nodes, spec).mapInArrow(_Roots(spec), "tree long, idx long, n long, digest string"), "roots")
        ended.append(roots.where("n = 1").select("tree", F.col("idx").alias("block"), "digest"))
        nodes = roots.where("n > 1")
        if nodes.isEmpty():
            return tiers, ended


def _descend(nodes: DataFrame, above: DataFrame, spec: Tree) -> DataFrame:
    """(tree, idx, subroot, root, path): what stands above each node, up to the root of all."""
    return _blocks(nodes, spec, above).mapInArrow(_Paths(spec), f"tree long, idx long, subroot string, root string, path {_PATH}")


def _from_root(tiers: list[DataFrame], ends: list[DataFrame], spec: Tree) -> DataFrame:
    """What stands above each block of the lowest tier."""
    above = ends[-1]
    for nodes, end in zip(tiers[:0:-1], ends[-2::-1], strict=True):
        above = keep(_descend(nodes, above, spec).withColumnRenamed("idx", "block").unionByName(end), "above")
    return above


class _Block:
    """Reads whole blocks, the nodes of one with what stands above it, and writes rows a batch at a time."""

    columns: tuple[str, ...]

    def __init__(self, spec: Tree) -> None:
        self.spec = spec

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[dict] = []
        schema = None
        for kinds, above, nodes in self.read(batches):
            schema = schema or pa.schema([(c, kinds.get(c, pa.string())) for c in self.columns])
            rows.extend(self.rows(above, nodes))
            if len(rows) >= _ROWS:
                yield pa.RecordBatch.from_pylist(rows, schema)
                rows = []
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema)

    def read(self, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict[str, pa.DataType], dict | None, list[dict]]]:
        kinds: dict[str, pa.DataType] = {}
        above, nodes = None, []
        for batch in batches:
            if not kinds:
                kinds = {f.name: f.type for f in batch.schema}
                kinds |= {"doc_id": kinds.get("name"), "place": kinds["idx"], "verified": pa.bool_(), "path": _STEPS, "proof": _STEPS}
            for row in batch.to_pylist():
                if nodes and (row["tree"], row["block"]) != (nodes[0]["tree"], nodes[0]["block"]):
                    yield kinds, above, nodes
                    above, nodes = None, []
                if row["idx"] < 0:
                    above = row
                else:
                    nodes.append(row)
        if nodes:
            yield kinds, above, nodes

    def tree(self, nodes: list[dict]) -> tuple[Node, int]:
        height = self.spec.height(nodes[0]["n"])
        return grow([x["digest"] for x in nodes], self.spec, height), height

    def rows(self, above: dict | None, nodes: list[dict]) -> Iterator[dict]:
        raise NotImplementedError


class _Roots(_Block):
    columns = ("tree", "idx", "n", "digest")

    def rows(self, above: dict | None, nodes: list[dict]) -> Iterator[dict]:
        root, _ = self.tree(nodes)
        yield {"tree": nodes[0]["tree"], "idx": nodes[0]["block"], "n": -(-nodes[0]["n"] // self.spec.block), "digest": root.digest}


class _Paths(_Block):
    columns = ("tree", "idx", "subroot", "root", "path")

    def rows(self, above: dict, nodes: list[dict]) -> Iterator[dict]:
        root, height = self.tree(nodes)
        for i, node in enumerate(nodes):
            path = [{"before": b, "after": a} for b, a in siblings(root, i, self.spec, height)]
            yield {"tree": node["tree"], "idx": node["idx"], "subroot": above["subroot"], "root": above["root"], "path": path + above["path"]}


class _Versions(_Block):
    """Every later leaf makes a version of its block, which goes on along what stands above."""

    columns = ("doc_id", "source", "place", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified", "proof")

    def __init__(self, spec: Tree, proofs: bool) -> None:
        super().__init__(spec)
        if not proofs:
            self.columns = self.columns[:-1]

    def rows(self, above: dict, nodes: list[dict]) -> Iterator[dict]:
        root, height = self.tree(nodes)
        for i, node in enumerate(nodes):
            path = [{"before": b, "after": a} for b, a in siblings(root, i, self.spec, height)] + above["path"]
            version = root if node["later"] is None else put(root, i, node["later"], self.spec, height)
            folded = version.digest
            for step in above["path"]:
                folded = digest(step["before"] + folded + step["after"])
            proof = digest("".join(step["before"] + step["after"] for step in path))
            yield {
                "doc_id": node["name"], "source": node["source"], "place": node["idx"], "leaf": node["digest"], "subroot": above["subroot"], "root": above["root"],
                "proof_sha256": proof, "folded_root": folded, "verified": folded == above["root"], "proof": path,
            }
