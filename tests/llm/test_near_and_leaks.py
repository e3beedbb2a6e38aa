import hashlib
import random
from math import comb

import numpy as np
import xxhash
from pyspark.sql import functions as F

from terrane.llm._spark import may_hold
from terrane.llm.simhash_pivots import SimHash, Similar, _best, _groups, _pivot_table, bucket_edges, estimate, fingerprints, keep_one, simhash_components, similar_components, sketches
from terrane.llm.winnowing import Winnow, contamination, keep_clean


def lower(t: str) -> bytes:
    return bytes(b + 32 if 65 <= b <= 90 else b for b in t.encode())


def shingles(t: str, k: int) -> list[bytes]:
    w = lower(t).split()
    return [b" ".join(w[i : i + k]) for i in range(max(1, len(w) - k + 1))] if w else []


def fingerprint(t: str, k: int = 3) -> int:
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles(t, k)]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def corpus(seed=2, n=40):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 14)))
    base = [[word() for _ in range(150)] for _ in range(n)]
    out = [" ".join(b) for b in base]
    for b in base:
        for edits in (1, 2, 5):
            w = list(b)
            for _ in range(edits):
                w[rng.randrange(len(w))] = word()
            out.append(" ".join(w))
    return [*out, "", "  ", "One", "one", "one TWO", "x " * 700, out[0], out[0].upper()]


def closure(n, links):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def test_fingerprints_equal_brute_force():
    texts = [*corpus(n=6), "a", "Ab c\td\n\x0be", "é ñandú 日本語 " * 9, "w" * 300 + " " + "v" * 5000 + " z", "k " * 3000]
    got = fingerprints([t.encode() for t in texts], SimHash())
    assert [int(x) for x in got] == [fingerprint(t) for t in texts]


def test_components_equal_brute_force(spark):
    texts = corpus()
    fp = [fingerprint(t) for t in texts]
    want = closure(len(fp), [(i, j) for i in range(len(fp)) for j in range(i) if (fp[i] ^ fp[j]).bit_count() <= 3])
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash_components(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got == {i: (f"{f:016x}", c) for i, (f, c) in enumerate(zip(fp, want, strict=True))}


def test_large_buckets_connect_what_pairs_connect():
    rng = np.random.default_rng(3)
    center = rng.integers(0, 1 << 63, 3, dtype=np.uint64)
    fp = np.unique(np.concatenate([c ^ (np.uint64(1) << rng.integers(0, 64, 40, dtype=np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 40, dtype=np.uint64)) for c in center]))
    rep = np.arange(len(fp))
    a, b = bucket_edges(np.zeros(len(fp), np.int64), fp, rep, SimHash())
    links = [(i, j) for i in range(len(fp)) for j in range(i) if int(fp[i] ^ fp[j]).bit_count() <= 3]
    assert closure(len(fp), zip(a.tolist(), b.tolist(), strict=True)) == closure(len(fp), links)


def test_similar_texts_are_linked(spark):
    texts = corpus()
    sets = [set(shingles(t, 5)) for t in texts]
    s = Similar()
    _, sketch, _ = sketches([t.encode() for t in texts], s)
    true = {(i, j): (len(sets[i] & sets[j]) / max(1, len(sets[i] | sets[j])) if sets[i] or sets[j] else 1.0) for i in range(len(texts)) for j in range(i)}
    off = [abs(float(estimate(sketch[i], sketch[j])) - v) for (i, j), v in true.items()]
    assert max(off) < 0.08
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, a string")
    got = dict(similar_components(df, s).collect())
    assert all(got[i] == got[j] for (i, j), v in true.items() if v >= 0.8)
    loose = closure(len(texts), [k for k, v in true.items() if v >= 0.7])
    assert all(loose[i] == loose[c] for i, c in got.items())
    assert dict(similar_components(df, Similar(bucket=1)).collect()) == got
    assert {r.doc_id for r in keep_one(df).collect()} == set(got.values())


def test_repeated_words_do_not_part_similar_texts(spark):
    rng = random.Random(4)
    rows = []
    for i in range(12):
        w = [f"w{rng.randrange(10**9)}" for _ in range(404)]
        rows += [(2 * i, " ".join(w)), (2 * i + 1, " ".join(w + ["="] * 600))]
    got = dict(similar_components(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == {i: i // 2 * 2 for i in range(24)}


def test_a_pivot_table_discards_most_pairs_or_is_left_out():
    fp = np.random.default_rng(3).integers(0, 1 << 63, 2000).astype(np.uint64) * np.uint64(2)
    for how in (SimHash(), Similar().how):
        table = _pivot_table(fp, how.pivots).astype(int)
        assert not how.pivots or (np.abs(table[:, :1000] - table[:, 1000:]).max(axis=0) > how.radius).mean() > 0.99


def test_radius_discards_no_similar_pair():
    def differs(both, a, b):
        """Chance that a bit of two sets differs that share ``both`` shingles and have ``a`` and ``b`` of their own."""
        c, x, y = (np.array([comb(n, k) for k in range(n + 1)]) / 2.0**n for n in (both, a, b))
        out = 0.0
        for k, v in enumerate(c):
            one = sum(p for i, p in enumerate(x) if 2 * (k + i) > both + a)
            two = sum(p for i, p in enumerate(y) if 2 * (k + i) > both + b)
            out += v * (one * (1 - two) + two * (1 - one))
        return out

    p = max(differs(c, a, b) for c in range(4, 61) for a in range(c // 4 + 1) for b in range(a, c // 4 + 1 - a))
    assert sum(comb(64, k) * p**k * (1 - p) ** (64 - k) for k in range(Similar().how.radius + 1, 65)) < 1e-8


def edited(rng, w, k):
    """A copy with a run of k words changed: 4 + k of its shingles are others."""
    at = rng.randrange(10, len(w) - k - 10)
    return w[:at] + [f"n{rng.randrange(10**9)}" for _ in range(k)] + w[at + k :]


def test_links_are_decided_by_the_shingles(spark):
    rng = random.Random(6)
    rows, pairs = [], []
    for i in range(60):
        w = [f"w{rng.randrange(10**9)}" for _ in range(304)]  # 300 shingles
        k = (28, 29, 30, 31)[i % 4]  # similarity 0.807, 0.802, 0.796, 0.791
        rows += [(2 * i, " ".join(w)), (2 * i + 1, " ".join(edited(rng, w, k)))]
        pairs.append(k <= 29)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = dict(similar_components(df).collect())
    assert got == {j: 2 * i if near else j for i, near in enumerate(pairs) for j in (2 * i, 2 * i + 1)}


def test_blocks_of_a_large_bucket_connect_what_pairs_connect(spark):
    rng = random.Random(8)
    base = [f"w{rng.randrange(10**9)}" for _ in range(104)]
    heads = [base] + [edited(rng, base, 12) for _ in range(4)]
    texts = [" ".join(edited(rng, rng.choice(heads), rng.choice((1, 2, 4)))) for _ in range(150)]
    sets = [set(shingles(t, 5)) for t in texts]
    want = closure(len(texts), [(i, j) for i in range(len(texts)) for j in range(i) if len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.8])
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = dict(similar_components(df, Similar(bucket=4, block=8)).collect())
    assert 1 < len(set(want)) < 150 and got == dict(enumerate(want))


def test_groups_are_bounded_and_whole(spark):
    s = Similar(block=10)
    members = spark.createDataFrame([(1, n, 0 if n < 460 else n) for n in range(500)], "key long, node long, label long")
    for turn in (0, 1, 4):
        got = _groups(members, turn, s).collect()
        size = {}
        for r in got:
            size[r.i, r.j] = size.get((r.i, r.j), 0) + 1
        assert max(size.values()) <= 60
    met = {}
    for r in got:
        met.setdefault((r.i, r.j), ([], []))[not r.seek].append(r.node)
    pairs = {(a, b) for seek, all_ in met.values() for a in seek for b in all_}
    assert pairs >= {(a, b) for a in range(460, 500) for b in range(500)}


def test_marks_miss_no_row(spark):
    rows = spark.range(60_000).select(F.when(F.col("id") > 0, F.col("id")).alias("a.b"), F.lit("x").alias("key"))
    held = spark.range(0, 60_000, 7).select("id")
    marked = may_hold(rows, F.col("`a.b`"), held)
    assert marked.columns == ["a.b", "key", "__may"]
    wrong = {r["__may"]: r["count"] for r in marked.where("coalesce(`a.b` % 7, 1) <> 0").groupBy("__may").count().collect()}
    assert marked.count() == 60_000 and wrong.get(True, 0) < 60
    assert marked.where("`a.b` % 7 = 0 and not __may").isEmpty()
    assert may_hold(rows, F.col("`a.b`"), held.limit(0)).where("__may").isEmpty()


def test_odd_rows(spark):
    df = spark.createDataFrame([(7, None, 1), (5, "", 1), (None, "", 1), (9, "a b c d e f", 1), (9, "a b c d e f", 1)], "doc_id long, text string, fp int")
    got = sorted(((r.doc_id, r.component_id) for r in simhash_components(df).collect()), key=str)
    assert got == sorted([(7, 5), (5, 5), (None, 5), (9, 9), (9, 9)], key=str)
    assert simhash_components(df.limit(0)).collect() == [] and similar_components(df.limit(0)).collect() == []


def words(t: str) -> list[bytes]:
    return bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in lower(t)).split(b" ")


def leaks(texts, items, n=10):
    out = {}
    items = {i: [w for w in words(t) if w] for i, t in items.items()}
    for d, t in texts.items():
        w = [x for x in words(t or "") if x]
        hit, found = set(), set()
        for i, x in items.items():
            k = min(n, len(x))
            wins = {tuple(x[a : a + k]) for a in range(len(x) - k + 1)} if k else set()
            for a in range(len(w) - k + 1):
                if k and tuple(w[a : a + k]) in wins:
                    hit |= set(range(a, a + k))
                    found.add(str(i))
        out[d] = (len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit))
    return out


def test_contamination_equals_brute_force_both_ways(spark):
    rng = random.Random(5)
    word = lambda: rng.choice(["Red", "blue", "dog", "cat", "Été", "x9", "of", "the"])
    items = {i: " ".join(word() for _ in range(rng.choice([1, 3, 6, 9, 10, 14, 40]))) for i in range(12)} | {20: "", 21: " -- "}
    texts = {d: " ".join(word() for _ in range(rng.randint(0, 120))) for d in range(30)}
    for d in range(0, 30, 3):
        texts[d] += ", " + items[d % 12].replace(" ", "; ") + "! " + word()
    texts |= {40: None, 41: "", 42: "the " * 5000}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    bench = spark.createDataFrame(list(items.items()), "item_id long, text string")
    want = leaks(texts, items)
    for how in (Winnow(), Winnow(small_bytes=1400), Winnow(small_bytes=300)):
        got = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in contamination(df, bench, how).collect()}
        assert got == want, how
        assert {r.doc_id for r in keep_clean(df, bench, how).collect()} == {d for d, v in want.items() if not v[-1]}
    assert contamination(df.limit(0), bench).collect() == []
    assert not any(r.contaminated for r in contamination(df, bench.limit(0)).collect())


def test_leaks_of_rows_that_share_an_id_or_have_none(spark):
    """One result on both paths: each row has its own hits, and clean rows stay beside bad ones of their id."""
    item = "one two three four five six seven eight nine ten eleven twelve"
    rows = [(1, f"so {item} it goes"), (1, "clean words " * 30), (None, item), (None, "nothing here"), (None, None), (2, ""), (1, f"so {item} it goes"), (3, "a short one")]
    df = spark.createDataFrame([(*r, "kept", i) for i, r in enumerate(rows)], "doc_id long, text string, __bad string, row long")
    bench = spark.createDataFrame([("x", item), ("y", "a short one")], "item_id string, text string")
    hits = [12, 0, 12, 0, 0, 0, 12, 3]
    for how in (Winnow(), Winnow(small_bytes=100)):
        got = sorted((r.doc_id is None, r.doc_id or 0, r.n_words, r.n_hit) for r in contamination(df, bench, how).collect())
        assert got == sorted((d is None, d or 0, len((t or "").split()), h) for (d, t), h in zip(rows, hits, strict=True)), how
        assert sorted(r.row for r in keep_clean(df, bench, how).collect()) == [i for i, h in enumerate(hits) if not h], how


def test_a_candidate_is_named_once_in_the_first_band_it_shares():
    s = Similar()
    fp, sketch, label = np.zeros(6, np.uint64), np.ones((6, s.bins), np.uint8), np.arange(6)
    keys = np.arange(6 * s.bands).reshape(6, s.bands)
    keys[:, 1] = keys[:, 5] = -1
    keys[:3, 0] = -2
    every = np.ones(6, bool)

    def named(seek, band, most=None):
        a, b, more = _best(seek, label, fp, sketch, keys, band, s, most)
        return sorted(zip(a, b, strict=True)), more

    pairs = {(x, y) for x in range(6) for y in range(x)}
    first = {(1, 0), (2, 0), (2, 1)}
    assert {(max(p), min(p)) for p in named(every, 1)[0]} == pairs - first and len(named(every, 1)[0]) == 12
    assert named(every, 5) == ([], False)
    assert named(every, 1, 2)[1] and len(named(every, 1, 2)[0]) == 12
    # those to meet come on their own; members that seek side by side don't meet there
    assert named(np.arange(6) < 2, 1)[0] == [(x, y) for x in (0, 1) for y in (3, 4, 5)]


def test_near_dedup_brings_fingerprints_together_by_pivots(spark, monkeypatch):
    """Copies that share no band are linked through their fingerprints; their sets still decide."""
    from terrane.llm import simhash_pivots

    rng = random.Random(23)
    text = [f"w{rng.randrange(10**9)}" for _ in range(400)]
    docs = spark.createDataFrame([(0, " ".join(text)), (1, " ".join([*text, "end"])), (2, " ".join(reversed(text))), (3, None), (None, " ".join(text))], "doc_id long, text string")
    radii, join = [], simhash_pivots.print_links
    monkeypatch.setattr(simhash_pivots, "print_links", lambda reps, how: radii.append((how.radius, how.pivots)) or join(reps, how))
    no_bands = Similar(bands=1, rows=400)  # a band of so many rows holds no pair that differs
    got = {r.doc_id: r.component_id for r in similar_components(docs, no_bands).collect()}
    assert got[0] == got[1] == 0 and got[2] == 2 and got[3] == 3
    assert sorted(r.doc_id for r in keep_one(docs, no_bands).where("doc_id is not null").collect()) == [0, 2, 3]
    assert radii == [(3, 16)] * 2
