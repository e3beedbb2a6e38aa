"""Benchmark decontamination by winnowing (operator 6).

Documents and benchmark items are winnowed alike: of every six consecutive five-word grams the
least hash is kept, so any ten words that both hold share a kept gram at the same place.
Shared fingerprints are joined and the hits extended word by word to whole windows.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrane.llm._spark import lean
from terrane.llm._text import LETTER_WORD, Piece, Words, as_bytes, grams, mix, pieces, prefix, sliding_argmin


@dataclass(frozen=True)
class Winnow:
    window: int = 10
    gram: int = 5
    #: Benchmarks of at most so many bytes go to every task, whose index takes some seventy times that; larger ones are joined by shuffle.
    small_bytes: int = 4 << 20


def _selected(h: np.ndarray, words: Words, how: Winnow) -> np.ndarray:
    """Word positions of the kept grams of a piece."""
    w = how.window - how.gram + 1
    g = grams(prefix(h), how.gram)
    best = sliding_argmin(mix(g), w)
    whole = words.text[: len(best)] == words.text[len(words.text) - len(best) :] if len(best) else np.zeros(0, bool)
    return np.unique(best[whole])


class Index:
    """Fingerprints and windows of the items, for one task's lookups."""

    def __init__(self, ids: list[str], texts: list[bytes], how: Winnow) -> None:
        self.ids = ids
        self.windows: dict[int, dict[int, list[tuple[int, bytes]]]] = {}
        prints = [np.zeros(0, np.uint64)]
        base = 0
        for first, run in pieces(texts):
            piece = Piece(run, lower=True)
            words = piece.words(LETTER_WORD)
            h = words.hashes()
            sums = prefix(h)
            prints.append(grams(sums, how.gram)[_selected(h, words, how)])
            for t in range(len(run)):
                n = int(words.count[t])
                size = min(n, how.window)
                if size:
                    a = int(words.first[t])
                    own = words.of(t)
                    g = grams(sums, size)
                    at = self.windows.setdefault(size, {})
                    for i in range(n - size + 1):
                        at.setdefault(int(g[a + i]), []).append((first + t, b" ".join(own[i : i + size])))
            base += len(run)
        self.prints = np.unique(np.concatenate(prints))
        self.keys = {n: np.sort(np.fromiter(w, np.uint64, len(w))) for n, w in self.windows.items()}


def _member(sorted_: np.ndarray, x: np.ndarray) -> np.ndarray:
    if not len(sorted_):
        return np.zeros(len(x), bool)
    return sorted_[np.minimum(np.searchsorted(sorted_, x), len(sorted_) - 1)] == x


def scan(run: list[bytes], index: Index, how: Winnow) -> tuple[np.ndarray, np.ndarray, list[set[str]]]:
    """(words, hit words, items) of each text."""
    piece = Piece(run, lower=True)
    words = piece.words(LETTER_WORD)
    h = words.hashes()
    sums = prefix(h)
    hit = np.zeros(len(h) + 1, np.int64)
    items: list[set[str]] = [set() for _ in run]
    for size, table in index.windows.items():
        g = grams(sums, size)
        if not len(g):
            continue
        if size == how.window:
            kept = _selected(h, words, how)
            seed = kept[_member(index.prints, grams(sums, how.gram)[kept])]
            # a window around the gram starts up to window - gram words before it
            start = np.unique((seed[:, None] - np.arange(how.window - how.gram + 1)[None, :]).ravel())
            start = start[(start >= 0) & (start < len(g))]
        else:
            start = np.arange(len(g))
        start = start[words.text[start] == words.text[start + size - 1]]
        start = start[_member(index.keys[size], g[start])]
        for s in start.tolist():
            own = b" ".join(piece.raw[a:b] for a, b in zip(words.start[s : s + size].tolist(), words.stop[s : s + size].tolist(), strict=True))
            same = [i for i, text in table[int(g[s])] if text == own]
            if same:
                hit[s] += 1
                hit[s + size] -= 1
                items[words.text[s]].update(index.ids[i] for i in same)
    covered = np.concatenate([[0], np.cumsum(np.cumsum(hit)[:-1] > 0)])
    return words.count, covered[words.first[1:]] - covered[words.first[:-1]], items


def _digest(items: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()


SCHEMA = "n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, items array<string>"


def _items(benchmark: DataFrame, item_col: str, item_text: str) -> DataFrame:
    return benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(item_text).alias("words")).where("item is not null and words is not null").distinct()


def _bytes(bench: DataFrame) -> int:
    return bench.agg(F.sum(F.octet_length("words") + F.lit(64))).first()[0] or 0


def _send(bench: DataFrame) -> Broadcast:
    """To every task; the caller has checked the size."""
    return bench.sparkSession.sparkContext.broadcast([(r[0], r[1].encode()) for r in bench.select("item", "words").collect()])


def contamination(docs: DataFrame, benchmark: DataFrame, how: Winnow | None = None, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """Words of each text that lie in a window of an item: (id, n_words, n_hit, n_items, items_sha256, contaminated, items).

    Null and empty texts have no words; an item without words has no window; an item shorter
    than the window is one window.  Repeated items count once by id, repeated rows of ``docs``
    each get a row, other columns are not read, and empty tables are allowed on either side.
    """
    how = how or Winnow()
    bench = _items(benchmark, item_col, item_text)
    if _bytes(bench) > how.small_bytes:
        return _by_join(docs, bench, how, id_col, text_col)
    sent = _send(bench)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index([x for x, _ in sent.value], [t for _, t in sent.value], how)
        for b in batches:
            n, hits, found = [], [], []
            for _, texts in pieces(as_bytes(b.column(1))):
                words, hit, items = scan(texts, index, how)
                n.append(words)
                hits.append(hit)
                found += [sorted(x) for x in items]
            if b.num_rows:
                hit = np.concatenate(hits)
                columns = [pa.array(np.concatenate(n)), pa.array(hit), pa.array([len(x) for x in found], pa.int64()), pa.array(map(_digest, found)), pa.array(hit > 0), pa.array(found, pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays([b.column(0), *columns], ["id", *(c.split()[0] for c in SCHEMA.split(", "))])

    return docs.select(id_col, text_col).mapInArrow(run, f"id {kind}, {SCHEMA}").withColumnRenamed("id", id_col)


def _grams_with_context(texts: DataFrame, how: Winnow) -> DataFrame:
    """(id, n, at, gram, around): kept grams with the hashes of the words around; texts shorter than the window give one row for each of their stretches that short items could equal."""
    reach = how.window - how.gram

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, run_ in pieces(as_bytes(b.column(1))):
                words = Piece(run_, lower=True).words(LETTER_WORD)
                h = words.hashes()
                at = _selected(h, words, how)
                t = words.text[at]
                grid = at[:, None] + np.arange(-reach, how.window)[None, :]
                inside = (grid >= words.first[t][:, None]) & (grid < words.first[t + 1][:, None])
                around = np.where(inside, h[np.clip(grid, 0, max(0, len(h) - 1))] | np.uint64(1), 0) if len(h) else np.zeros((0, reach + how.window), np.uint64)
                ids = b.column(0).take(pa.array(first + t))
                g = grams(prefix(h), how.gram)[at].view(np.int64)
                flat = pa.FixedSizeListArray.from_arrays(pa.array(around.astype(np.uint64).view(np.int64).ravel()), reach + how.window).cast(pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([ids, pa.array(at - words.first[t]), pa.array(g), flat], ["id", "at", "gram", "around"])

    kind = texts.schema["id"].dataType.simpleString()
    return texts.mapInArrow(run, f"id {kind}, at long, gram long, around array<long>")


def _row(id_col: str, text_col: str) -> Column:
    """What tells a row of ``docs`` from others: its id and its text, either of which may be null."""
    known = [F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("-")) for c in (id_col, text_col)]
    return F.sha2(F.concat(known[0], F.lit("\n"), known[1]), 256)


def _short_hits(docs: DataFrame, short: DataFrame, how: Winnow) -> DataFrame | None:
    """(id, item, lo, hi): where items shorter than the window stand, sent in blocks of ``small_bytes`` however many those are."""
    blocks = -(-_bytes(short) // how.small_bytes)
    found = None
    for k in range(blocks):
        sent = _send(short.where(F.pmod(F.xxhash64("item", "words"), F.lit(blocks)) == k))

        def run(batches: Iterator[pa.RecordBatch], sent: Broadcast = sent) -> Iterator[pa.RecordBatch]:
            index = Index([x for x, _ in sent.value], [t for _, t in sent.value], how)
            for b in batches:
                out = []
                for row, text in zip(b.column(0).to_pylist(), as_bytes(b.column(1)), strict=True):
                    words = Piece([text or b""], lower=True).words(LETTER_WORD)
                    h, own = words.hashes(), words.of(0)
                    for size, table in index.windows.items():
                        g = grams(prefix(h), size)
                        for s in np.flatnonzero(_member(index.keys[size], g)).tolist():
                            same = b" ".join(own[s : s + size])
                            out += [(row, index.ids[i], s, s + size) for i, x in table[int(g[s])] if x == same]
                columns = list(zip(*out, strict=True)) or [()] * 4
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.int64(), pa.int64()), strict=True)], ["id", "item", "lo", "hi"])

        part = docs.mapInArrow(run, "id string, item string, lo long, hi long")
        found = part if found is None else found.unionByName(part)
    return found


def _by_join(docs: DataFrame, bench: DataFrame, how: Winnow, id_col: str, text_col: str) -> DataFrame:
    """The same for benchmarks too large to send: fingerprints meet in a shuffled join, rows told apart by id and text."""
    bench = bench.withColumn("n", F.size(F.array_remove(F.split(F.lower("words"), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), "")))
    reach = how.window - how.gram
    keyed = docs.select(_row(id_col, text_col).alias("id"), F.col(text_col).alias("t"))
    d = _grams_with_context(keyed, how).withColumnsRenamed({"at": "d_at", "around": "d"})
    i = _grams_with_context(bench.where(F.col("n") >= how.window).select(F.col("item").alias("id"), F.col("words").alias("t")), how).select(F.col("id").alias("item"), "gram", F.col("around").alias("i"))
    agree = F.zip_with("d", "i", lambda x, y: (x == y) & (x != 0))
    left = F.coalesce(F.array_position(F.reverse(F.slice("same", 1, reach)), False) - 1, F.lit(reach))
    left = F.when(left < 0, reach).otherwise(left)
    right = F.array_position(F.slice("same", reach + 1, how.window), False) - 1
    right = F.when(right < 0, how.window).otherwise(right)
    hits = d.join(i.distinct(), "gram").withColumn("same", agree).select("id", "item", (F.col("d_at") - left).alias("lo"), (F.col("d_at") + right).alias("hi")).where(F.col("hi") - F.col("lo") >= how.window)
    short = _short_hits(keyed, bench.where(F.col("n").between(1, how.window - 1)), how)
    if short is not None:
        hits = hits.unionByName(short)
    per = hits.groupBy("id").agg(F.array_sort(F.collect_set("item")).alias("items"), F.collect_set(F.struct("lo", "hi")).alias("runs"))
    kind = docs.schema[id_col].dataType.simpleString()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for text, items, runs in zip(as_bytes(b.column(1)), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                n = int(Piece([text or b""], lower=True).words(LETTER_WORD).count[0])
                hit = np.zeros(n, bool)
                for r in runs or ():
                    hit[r["lo"] : r["hi"]] = True
                out.append((n, int(hit.sum()), sorted(items or ())))
            columns = [pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64()), pa.array([len(x[2]) for x in out], pa.int64()), pa.array([_digest(x[2]) for x in out], pa.string()), pa.array([x[1] > 0 for x in out], pa.bool_()), pa.array([x[2] for x in out], pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays([b.column(0), *columns], ["id", *(c.split()[0] for c in SCHEMA.split(", "))])

    both = docs.select(F.col(id_col).alias("id0"), F.col(text_col).alias("t"), _row(id_col, text_col).alias("own")).join(per, F.col("own") == F.col("id"), "left").select("id0", "t", "items", "runs")
    return both.mapInArrow(merge, f"id {kind}, {SCHEMA}").withColumnRenamed("id", id_col)


def keep_clean(docs: DataFrame, benchmark: DataFrame, how: Winnow | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` without a hit, all columns unchanged, whatever their names.

    Null and empty texts have no hit and stay.  Each row is judged by its own text: rows that
    share an id or have none don't share their hits, equal rows stay or go together.
    """
    how = how or Winnow()
    bench = _items(benchmark, "item_id", "text")
    if _bytes(bench) <= how.small_bytes:
        sent, at = _send(bench), docs.columns.index(text_col)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = Index([x for x, _ in sent.value], [t for _, t in sent.value], how)
            for b in batches:
                if b.num_rows:
                    yield b.filter(pa.array(np.concatenate([scan(texts, index, how)[1] == 0 for _, texts in pieces(as_bytes(b.column(at)))])))

        return docs.mapInArrow(lean(run), docs.schema)
    name = f"bad_{uuid.uuid4().hex}"
    told = docs.select(_row(id_col, text_col).alias("row"), F.col(text_col).alias("t"))
    bad = contamination(told, benchmark, how, "row", "t").where("contaminated").select(F.col("row").alias(name)).distinct()
    return docs.join(bad, _row(id_col, text_col) == F.col(name), "left_anti")
