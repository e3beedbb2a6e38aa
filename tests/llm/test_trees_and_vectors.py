import hashlib
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrane.llm import hadamard_clusters, merkle_manifest, pruned_graph

DOC = "doc_id long, source string, lang string, n_chars long, text string, leaf string, root int"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(doc_id, source, lang, n_chars, text):
    return sha("".join("-" if x is None else f"{len(str(x).encode())}:{x}" for x in (doc_id, source, lang, n_chars, text)))


def climb(nodes, arity):
    """All levels of a tree, the lowest first."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        below = levels[-1]
        levels.append([sha("".join(below[i : i + arity])) for i in range(0, len(below), arity)])
    return levels


def proof(levels, i, arity):
    for level in levels[:-1]:
        a = i - i % arity
        yield level[a:i], level[i + 1 : a + arity]
        i //= arity


def by_brute_force(docs, arity):
    """The rows of the manifest as a multiset, from whole trees."""
    sources = sorted({d[1] for d in docs}, key=lambda s: (s is not None, (s or "").encode()))
    groups = {s: sorted((d for d in docs if d[1] == s), key=lambda d: (d[0] is not None, d[0] or 0, leaf(*d))) for s in sources}
    trees = {s: climb([leaf(*d) for d in g], arity) for s, g in groups.items()}
    top = climb([trees[s][-1][0] for s in sources], arity)
    out = []
    for k, s in enumerate(sources):
        for i, d in enumerate(groups[s]):
            steps = [*proof(trees[s], i, arity), *proof(top, k, arity)]
            cut = d[0] is not None and d[4] is not None and zlib.crc32(str(d[0]).encode()) % 2 == 0
            folded = leaf(*d[:4], d[4].replace("\n", "") if cut else d[4])
            for before, after in steps:
                folded = sha("".join(before) + folded + "".join(after))
            out.append((d[0], leaf(*d), trees[s][-1][0], top[-1][0], sha("".join("".join(b + a) for b, a in steps)), folded, folded == top[-1][0]))
    return sorted(map(repr, out))


def manifest_of(spark, docs, spec):
    frame = spark.createDataFrame([(*d, "clash", 1) for d in docs], DOC)
    got = merkle_manifest.manifest(frame, now=merkle_manifest.tampered_text(F.col("doc_id"), F.col("text")), spec=spec)
    return sorted(repr(tuple(r)) for r in got.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect())


@pytest.mark.parametrize("levels", [1, 3])
def test_manifest_equals_whole_trees(spark, levels):
    """Blocks of 3 and of 27; null ids, sources and texts, empty and long texts, repeated rows and a hot source."""
    rng = random.Random(3)
    docs = [(i, rng.choice(["a", "a", "a", "ß", None]), "en", 3, rng.choice(["x\ny", "", None, "plain", "\n" * 3, "ü\n" * 5000])) for i in range(60)]
    docs += [(None, "a", None, None, None)] * 3 + [(7, "a", "en", 3, "x\ny")] * 4 + [(1, "alone", "de", None, "one\ntwo")]
    assert manifest_of(spark, docs, merkle_manifest.Tree(3, levels)) == by_brute_force(docs, 3)


def test_manifest_of_nothing_and_of_one(spark):
    assert manifest_of(spark, [], merkle_manifest.Tree()) == []
    assert manifest_of(spark, [(2, None, None, None, "a\n")], merkle_manifest.Tree()) == by_brute_force([(2, None, None, None, "a\n")], 3)


def test_versions_share_untouched_nodes():
    spec = merkle_manifest.Tree(3, 3)
    leaves = [sha(str(i)) for i in range(20)]
    root = merkle_manifest.grow(leaves, spec, 3)
    version = merkle_manifest.put(root, 10, "new", spec, 3)
    assert version.digest == climb([*leaves[:10], "new", *leaves[11:]], 3)[-1][0]
    assert version.children[0] is root.children[0] and version.children[2] is root.children[2]
    assert version.children[1].children[1] is root.children[1].children[1] and version.children[1].children[0] is not root.children[1].children[0]
    assert root.digest == climb(leaves, 3)[-1][0]


def test_transform_keeps_distances_and_search_equals_all_pairs():
    rng = np.random.default_rng(1)
    rows, centres = rng.integers(-300, 300, (400, 64)), rng.integers(-300, 300, (40, 64))
    rows[50:60], centres[7] = rows[3], centres[2]
    a, b = hadamard_clusters.coefficients(rows), hadamard_clusters.coefficients(centres)
    cluster, distance = hadamard_clusters.nearest_centroids(a, b)
    d = ((rows[:, None] - centres[None]) ** 2).sum(2)
    assert (cluster == d.argmin(1)).all() and (distance == 64 * d.min(1)).all()
    assert hadamard_clusters.inverse(a[0].tolist()) == rows[0].tolist()


def lloyd(rows, k, rounds):
    """(id, cluster, distance, inertia of the cluster, inertia, digest) by comparing everything with Python integers."""
    grid = [(i, [math.floor(256 * x) for x in v]) for i, v in rows]
    begun = sorted(grid, key=lambda r: (r[0] is None, sha(f"2:{r[0]}"), hadamard_clusters.coefficients(np.array([r[1]]))[0].tolist()))[:k]
    centres = [v for _, v in begun]

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(centres)) for _, v in grid]

    for _ in range(rounds):
        at = assign()
        for j in range(len(centres)):
            own = [v for (_, v), (_, c) in zip(grid, at, strict=True) if c == j]
            if own:
                centres[j] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    at = assign()
    total = sum(d for d, _ in at)
    return sorted(repr((i, j, d, sum(x for x, y in at if y == j), total, sha(",".join(map(str, centres[j]))))) for (i, _), (d, j) in zip(grid, at, strict=True))


def test_clusters_equal_brute_force(spark):
    """Null, short and non-finite vectors, null and repeated ids, equal rows, clashing columns; fewer vectors than centroids; nothing."""
    rng = np.random.default_rng(4)
    good = [(i, rng.normal(size=8).round(3).tolist()) for i in range(60)]
    good += [(3, rng.normal(size=8).tolist()), (None, [0.0] * 8), (None, [0.5] * 8)] + [(90, [1.0] * 8)] * 5
    bad = [(100, None), (101, [1.0] * 7), (102, [1.0] * 7 + [None]), (103, [1.0] * 7 + [float("nan")]), (104, [1.0] * 7 + [float("inf")])]
    spec = hadamard_clusters.Clusters(length=8, centroids=6, rounds=3, first=2)

    def run(rows):
        frame = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, embedding array<double>, cluster int, id string")
        return sorted(repr(tuple(r)) for r in hadamard_clusters.centroid_clusters(frame, spec).collect())

    assert run(good + bad) == lloyd(good, 6, 3)
    assert run(good[:4]) == lloyd(good[:4], 6, 3)
    assert run(bad) == []


def test_nearest_by_graphs(spark):
    """Recall against brute force with several shards and query blocks; copies, repeated ids and rows that take no part."""
    rng = np.random.default_rng(6)
    rows = [(i, rng.normal(size=16).tolist()) for i in range(900)]
    rows += [(1000 + i, rows[5][1]) for i in range(60)] + [(20, rows[20][1])] * 2  # a group of copies, and a row that is there three times
    rows += [(5000, None), (5010, [0.0] * 16), (5020, [float("nan")] * 16), (5030, [None] * 16), (None, rows[7][1]), (5040, [1.0, 2.0])]
    frame = spark.createDataFrame([(*r, 1, 2.0) for r in rows], "vec_id long, embedding array<float>, rank int, score double")
    spec = pruned_graph.Graph(shard=250, beam=48, width=96, queries=16, salts=3)
    got = {}
    for r in pruned_graph.nearest(frame, F.col("vec_id") % 10 == 0, spec).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.score, r.vec_id))
    kept = [(i, np.array(v, np.float32).astype(np.float64)) for i, v in rows if i is not None and i not in (5000, 5010, 5020, 5030)]
    hits = wanted = 0
    for at, (i, v) in enumerate(kept):
        if i % 10:
            continue
        near = sorted((float(np.sqrt(((v - w) ** 2).sum())), j) for other, (j, w) in enumerate(kept) if other != at and len(w) == len(v))[:10]
        if not near:
            assert i not in got
            continue
        found = [x for x in got[i] if i != 20] or sorted(set(got[i]))
        assert [r for r, _, _ in sorted(found)] == list(range(1, len(near) + 1))
        hits += len({j for _, _, j in found} & {j for _, j in near})
        wanted += len({j for _, j in near})
        if i >= 1000:
            assert [(s, j) for _, s, j in sorted(found)] == near  # copies alone, ties to smaller ids
    assert len([x for x in got[20] if x[0] == 1]) == 3 and hits >= 0.95 * wanted
    assert pruned_graph.nearest(frame.limit(0), F.col("vec_id") % 10 == 0, spec).count() == 0
