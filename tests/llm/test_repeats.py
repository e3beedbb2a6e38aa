import hashlib
import random
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from terrane.llm import recompression, suffix_dedup
from terrane.llm._repeats import Shape, repeated_spans
from terrane.llm.recompression import Recompression, repeated_words
from terrane.llm.suffix_dedup import Suffixes, remaining_text, repeated_bytes


def sample(seed=1):
    """Texts with shared passages, edits, periods, long runs and copies."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcde") for _ in range(rng.randint(1, 6)))
    base = [[word() for _ in range(rng.randint(20, 400))] for _ in range(6)]
    out = []
    for i in range(40):
        w = list(rng.choice(base)) if i % 2 else [word() for _ in range(rng.randint(0, 200))]
        for _ in range(rng.randint(0, 4)):
            if w:
                w[rng.randrange(len(w))] = word()
        if i % 5 == 0:
            k = rng.randrange(len(w) + 1)
            w = w[:k] + base[0][30:130] + w[k:]
        out.append(" ".join(w))
    return [*out, "", "spam " * 300, "spam " * 200 + "x", "ab" * 700, "é ñ " * 200, out[1], out[1]]


def bytes_by_brute_force(texts: dict, length: int) -> dict:
    seen = {}
    for d, t in texts.items():
        for i in range(len(t) - length + 1):
            seen.setdefault(t[i : i + length], []).append((d, i))
    out = {}
    for d, t in texts.items():
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if len(seen[t[i : i + length]]) > 1:
                gone[i : i + length] = b"\1" * length
        kept = bytes(b for b, g in zip(t, gone, strict=True) if not g)
        out[d] = (len(t), sum(gone), sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone)), hashlib.sha256(kept).hexdigest())
    return out


def words_by_brute_force(texts: dict, window: int) -> dict:
    words = {d: t.split() for d, t in texts.items()}
    first = {}
    for d, w in words.items():
        for i in range(len(w) - window + 1):
            k = tuple(w[i : i + window])
            first[k] = min(first.get(k, d), d)
    out = {}
    for d, w in words.items():
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if first[tuple(w[i : i + window])] < d:
                gone[i : i + window] = [True] * window
        kept = b" ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out[d] = (len(w), sum(gone), hashlib.sha256(kept).hexdigest())
    return out


@pytest.fixture(scope="module")
def docs(spark):
    texts = dict(enumerate(sample()))
    return texts, spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)


def test_bytes(docs):
    texts, df = docs
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in repeated_bytes(df).collect()}
    assert got == bytes_by_brute_force({d: t.encode() for d, t in texts.items()}, 400)


def test_words(docs):
    texts, df = docs
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in repeated_words(df).collect()}
    assert got == words_by_brute_force({d: t.encode() for d, t in texts.items()}, 50)


def test_passages_of_other_rows(docs):
    """Bytes in strings of 250 bytes that a row of another id or text holds."""
    texts, df = docs
    held = {}
    for d, t in texts.items():
        b = t.encode()
        for i in range(len(b) - 249):
            held.setdefault(b[i : i + 250], set()).add(d)
    want = {}
    for d, t in texts.items():
        b = t.encode()
        gone = bytearray(len(b))
        for i in range(len(b) - 249):
            if len(held[b[i : i + 250]]) > 1:
                gone[i : i + 250] = b"\1" * 250
        want[d] = sum(gone)
    assert {r.doc_id: r.n_passage_bytes for r in repeated_bytes(df).collect()} == want


@pytest.mark.parametrize("module, how", [(suffix_dedup, Suffixes(passage=250)), (recompression, Recompression())])
def test_hot_keys_give_the_same(docs, module, how):
    """Keys of more contexts than a task takes are compared by rounds that split ranges of offsets."""
    _, df = docs
    d = df.select(F.col("doc_id").alias("id"), "text")
    found = []
    for limit in (50_000, 1):
        shape: Shape = replace(how.shape, task_contexts=limit)
        spans = repeated_spans(module._anchors(d, how), d, shape, module._contexts)
        found.append({(r.doc, r.kind, i) for r in spans.collect() for i in range(r.lo, r.hi)})
    assert found[0] == found[1] and found[0]


def test_text_without_its_repeats(docs):
    texts, df = docs
    kept = {r.doc_id: r.text for r in remaining_text(df).collect()}
    removed = {r.doc_id: r.n_removed for r in repeated_bytes(df).collect()}
    assert all(kept[d] == t for d, t in texts.items() if not removed[d])
    assert all(len(kept[d].encode()) == len(t.encode()) - removed[d] for d, t in texts.items() if t.isascii())


def test_odd_rows(spark):
    long = " ".join(f"w{i}" for i in range(30000))
    df = spark.createDataFrame([(1, None, 0, "a"), (2, "", 0, "a"), (None, long, 0, "a"), (3, long, 0, "a"), (4, long + " end", 0, "a"), (5, "twice", 0, "a"), (5, "twice", 0, "a")], "doc_id long, text string, key int, id string")
    b = {(r.doc_id, r.n_removed) for r in repeated_bytes(df).collect()}
    n = len(long.encode())
    assert b == {(1, 0), (2, 0), (None, n), (3, n), (4, n), (5, 0)}
    w = {(r.doc_id, r.n_removed) for r in repeated_words(df).collect()}
    assert w == {(1, 0), (2, 0), (None, 0), (3, 0), (4, 30000), (5, 0)}
    assert repeated_bytes(df.limit(0)).collect() == [] and repeated_words(df.limit(0)).collect() == []


def test_rows_that_share_an_id(spark):
    """Rows are told apart by id and text: none takes another's spans, and copies under one id or none repeat each other."""
    rng = random.Random(8)
    a, b, c, d, e = (" ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(100)) for _ in range(5))
    rows = [(1, a), (2, a + " " + b), (2, c), (3, d), (3, d), (None, e), (None, e + " end"), (None, b[:100]), (4, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    texts = {k: (t or "").encode() for k, (_, t) in enumerate(rows)}
    want = bytes_by_brute_force(texts, 400)
    got = repeated_bytes(df).collect()
    assert sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == sorted((str(rows[k][0]), *v) for k, v in want.items())
    left = sorted((str(r.doc_id), r.text) for r in remaining_text(df).collect())
    assert ("2", c) in left and left.count(("3", "")) == 2 and len(left) == len(rows)
    got = {(r.doc_id, r.n_words, r.n_removed) for r in repeated_words(df).collect()}
    assert got == {(1, 100, 0), (2, 200, 100), (2, 100, 0), (3, 100, 0), (None, 100, 0), (None, 101, 0), (None, len(b[:100].split()), 0), (4, 0, 0)}


def test_many_rows_equal_in_id_and_text(spark):
    """Equal rows are asked for once; each gets the result of a text among copies of its own and one near copy."""
    rng = random.Random(9)
    w = [rng.choice("abcdefgh") * rng.randint(1, 4) for _ in range(500)]
    text, near = " ".join(w), " ".join([*w[:250], "other", *w[251:]])
    rows = [(7, text)] * 300 + [(9, near), (None, text), (None, text)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc_id, r.n_bytes, r.n_removed) for r in repeated_bytes(df).collect()}
    whole = len(text.encode())
    assert {x for x in got if x[0] != 9} == {(7, whole, whole), (None, whole, whole)}
    parts = [len(" ".join(w[:250]).encode()) + 1, len(" ".join(w[251:]).encode()) + 1]
    assert {x for x in got if x[0] == 9} == {(9, len(near.encode()), sum(p for p in parts if p >= 400))}
    words = {(r.doc_id, r.n_words, r.n_removed) for r in repeated_words(df).collect()}
    assert {x[1:] for x in words if x[0] == 9} == {(500, 499)}
