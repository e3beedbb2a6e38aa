"""Repeated windows, found from anchors that equal windows share.

A *symbol* is a byte or a word.  An anchor is a place in a text with a key such that any two
equal windows of the shortest size hold anchors of one key at the same offset, between
``least`` and ``most`` symbols from the window's start.  So windows need comparing only
between anchors of one key, and only through the symbols around the anchor (its context).

1. Keys of one occurrence are dropped; they are most of them.
2. Equal contexts of one key (a class) are counted and then stand for each other, so that what
   is compared are distinct contexts.
3. Where a key has several classes, one member of each is fetched and they are compared by
   interval expansion (``extend``).  A key of more than ``task_contexts`` is compared by Spark
   rounds instead, which no single task bears (``_by_ranges``); both give the same.

Texts are told apart by their row, that is by id and text, never by the id alone.  Rows equal
in both hold the same anchors at the same places, and each is elsewhere to the other.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrane.llm._spark import forget, keep, lean, partitions, whole_keys
from terrane.llm._text import U, as_bytes, mix

ANCHORS = "key long, ctx long, doc long, hash long, at int, lo int, hi int"
SPANS = "doc long, hash long, lo int, hi int, kind int"
#: Contexts that are laid out in memory at once.
_CHUNK = 8_000


def _as_they_are(texts: list[bytes]) -> list[bytes]:
    return texts


@dataclass(frozen=True)
class Window:
    """Windows of ``size`` symbols count that also begin at "any" other place, in another "row", or in a text of an "earlier" id."""

    size: int
    elsewhere: str = "any"


@dataclass(frozen=True)
class Shape:
    windows: tuple[Window, ...]
    least: int
    most: int
    width: int  # bytes of a symbol
    #: Turns stretches of text into the bytes of their symbols.
    symbols: Callable[[list[bytes]], list[bytes]] = _as_they_are
    #: Contexts of one key that a single task compares.
    task_contexts: int = 50_000

    @property
    def right(self) -> int:
        return max(w.size for w in self.windows) - self.least


def _rows(parts: list[bytes], size: int, width: int) -> np.ndarray:
    """Byte strings as rows of symbols, filled up with zeros."""
    rows = np.frombuffer(b"".join(p.ljust(size, b"\0") for p in parts), np.uint8).reshape(len(parts), size)
    return rows if width == 1 else rows.view(np.uint64)


def common_prefixes(key: np.ndarray, follow: np.ndarray) -> np.ndarray:
    """Symbols that each sorted row shares with the one above it; -1 where the key differs.

    Breadth first, by increasing value: all intervals of rows that share a prefix are extended
    by one symbol before any gets the next.  Where an interval splits, the length so far is the
    common prefix there.  What has not split at the full width needs no further look.
    """
    shared = np.full(len(key), -1, np.int64)
    live = np.flatnonzero(key[1:] == key[:-1]) + 1
    shared[live] = follow.shape[1]
    for length, symbol in enumerate(np.ascontiguousarray(follow.T)):
        if not len(live):
            break
        same = symbol[live] == symbol[live - 1]
        shared[live[~same]] = length
        live = live[same]
    return shared


def extend(shape: Shape, key: np.ndarray, doc: np.ndarray, row: np.ndarray, left: list[bytes], right: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """[window kind, context]: the least and the greatest offset of its repeated windows (greatest -1: none).

    The contexts, sorted by key and by what follows the anchor, are the part of a suffix array
    that begins at anchors; the symbol before each row is its Burrows-Wheeler symbol.  The
    common prefixes come by increasing value (``common_prefixes``).  Then an interval of rows is
    extended backwards symbol by symbol, all intervals of one length before those of the next.
    With ``d`` symbols before the anchor shared, rows that also share ``size - d`` symbols
    after it hold the same window.  Lengths beyond the window are never looked at, and
    intervals of one row are dropped.
    """
    n, w = len(key), shape.width
    low, high = np.full((len(shape.windows), n), 1 << 40, np.int64), np.full((len(shape.windows), n), -1, np.int64)
    size = shape.right * w
    follow = _rows(right, size, 1)
    head = key.astype(">i8").view(np.uint8).reshape(n, 8)
    order = np.argsort(np.concatenate([head, follow], axis=1).view(f"S{size + 8}").ravel(), kind="stable")
    key, doc, row = key[order], doc[order], row[order]
    follow = follow[order] if w == 1 else np.ascontiguousarray(follow[order]).view(np.uint64)
    length = np.fromiter(map(len, right), np.int64, n)[order] // w
    before = np.fromiter(map(len, left), np.int64, n)[order] // w
    shared = common_prefixes(key, follow)
    del follow
    back = _rows([x[::-1] for x in left], shape.most * w, w)[order]
    rows = np.arange(n)
    group = np.cumsum(np.diff(key, prepend=key[:1]) != 0)
    for d in range(shape.most + 1):
        if d:
            stay = before[rows] >= d
            rows, group = rows[stay], group[stay]
            symbol = back[rows, d - 1]
            split = np.flatnonzero((group[1:] == group[:-1]) & (symbol[1:] != symbol[:-1]))
            if len(split):
                torn = np.flatnonzero(np.isin(group, group[split]))
                by = torn[np.lexsort((symbol[torn], group[torn]))]
                rows[torn], symbol[torn] = rows[by], symbol[by]
            group = np.cumsum((np.diff(group, prepend=-1) != 0) | (np.diff(symbol.astype(np.int64), prepend=0) != 0))
            many = np.bincount(group)[group] > 1 if len(group) else group > 0
            rows, group = rows[many], group[many]
        if not len(rows):
            break
        if d < shape.least:
            continue
        for k, window in enumerate(shape.windows):
            need = window.size - d
            part = np.cumsum(shared < need)[rows]
            whole = length[rows] >= need
            r, g, p = rows[whole], group[whole], part[whole]
            if not len(r):
                continue
            first = np.flatnonzero((np.diff(g, prepend=-1) != 0) | (np.diff(p, prepend=-1) != 0))
            run = np.diff(np.append(first, len(r)))
            if window.elsewhere == "earlier":
                hit = np.repeat(np.minimum.reduceat(doc[r], first), run) < doc[r]
            elif window.elsewhere == "row":
                hit = np.repeat(np.minimum.reduceat(row[r], first) != np.maximum.reduceat(row[r], first), run)
            else:
                hit = np.repeat(run, run) > 1
            found = order[r[hit]]
            low[k, found] = np.minimum(low[k, found], d)
            high[k, found] = d
    return low, high


def _first_and_last() -> list[Column]:
    place = F.struct("doc", "hash", "at")
    return [F.count("*").alias("n"), F.min(place).alias("first"), F.max(place).alias("last")]


def _twice(elsewhere: str) -> Column:
    """Whether a group of occurrences holds two that are elsewhere to each other."""
    if elsewhere == "any":
        return F.col("n") > 1
    if elsewhere == "row":
        return ~F.struct("first.doc", "first.hash").eqNullSafe(F.struct("last.doc", "last.hash"))
    return F.col("first.doc") < F.col("last.doc")


def _settled(elsewhere: str) -> Column:
    """Whether an occurrence repeats one of its group."""
    return F.col("doc") > F.col("first.doc") if elsewhere == "earlier" else _twice(elsewhere)


def _by_kind(shape: Shape, of: Callable[[Window], Column]) -> Column:
    out = F.lit(None)
    for k, window in enumerate(shape.windows):
        out = F.when(F.col("kind") == k, of(window)).otherwise(out)
    return out


def _is_first() -> Column:
    return F.struct("doc", "hash", "at").eqNullSafe(F.struct("first.doc", "first.hash", "first.at"))


def _parts(n: int) -> Column:
    """The range d1 to d2 in n parts of equal size, the last shorter, as rows ``x``."""
    step = F.ceil((F.col("d2") - F.col("d1") + 1) / n).cast("int")
    return F.explode(F.transform(F.sequence(F.col("d1"), F.col("d2"), step), lambda d: F.struct(d.alias("d1"), F.least(d + step - 1, F.col("d2")).alias("d2"))))


def _by_ranges(contexts: DataFrame, shape: Shape) -> DataFrame:
    """Spans (``SPANS``) of the contexts (key, doc, hash, at, sure, l, r), by Spark rounds that split ranges of offsets.

    All windows of a context that begin ``d1`` to ``d2`` symbols before the anchor share a core
    and lie in a whole.  A core that no other context has ends the range; a whole that is found
    elsewhere settles it; any other range is split.  Of contexts with equal wholes one goes on
    to be met by others.  Cores and wholes are counted by hash (128 bits), combined before the
    shuffle, so that no task meets all contexts of a key.
    """
    w = shape.width
    a, b = F.floor(F.length("l") / w).cast("int"), F.floor(F.length("r") / w).cast("int")
    kinds = F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), F.lit(x.size).alias("size"), F.col("sure").bitwiseAND(1 << k).cast("boolean").alias("done")) for k, x in enumerate(shape.windows))))
    own = ["key", "doc", "hash", "at", "l", "r", "kind", "size", "done"]
    start = contexts.select(*own[:6], kinds.alias("x")).select(*own[:6], "x.*", F.lit(shape.least).alias("d1"), F.lit(shape.most).alias("d2"))
    state = start.withColumn("x", _parts(8)).select(*own, "x.*")
    valid = (F.greatest("d1", F.col("size") - b) <= F.least("d2", a)) & (b >= F.col("size") - F.col("d2"))
    same = ["key", "kind", "d1", "d2", "h1", "h2"]

    def around(before: Column, after: Column) -> Column:
        return F.concat(F.substring("l", F.length("l") - before * w + 1, before * w), F.substring("r", F.lit(1), after * w))

    found = []
    while True:
        core = around(F.col("d1"), F.col("size") - F.col("d2"))
        whole = F.when((a >= F.col("d2")) & (b >= F.col("size") - F.col("d1")), around(F.col("d2"), F.col("size") - F.col("d1")))
        hashes = {"c1": F.xxhash64(core), "c2": F.xxhash64(F.lit(1), core), "w1": F.when(whole.isNotNull(), F.xxhash64(F.lit(2), whole)), "w2": F.xxhash64(F.lit(3), whole)}
        state = keep(state.where(valid).withColumns(hashes), "ranges")
        if found:
            forget(*before)
        if state.isEmpty():
            break
        place = ["key", "kind", "d1", "d2", "doc", "hash", "at"]
        both = state.select(*place, F.col("c1").alias("h1"), F.col("c2").alias("h2")).union(state.where("w1 is not null").select(*place, "w1", "w2"))
        groups = keep(both.groupBy(*same).agg(*_first_and_last()).where(_by_kind(shape, lambda x: _twice(x.elsewhere))), "shared")
        cores = groups.select(*same[:4], F.col("h1").alias("c1"), F.col("h2").alias("c2"))
        wholes = groups.select(*same[:4], F.col("h1").alias("w1"), F.col("h2").alias("w2"), "n", "first", "last")
        met = state.join(cores, [*same[:4], "c1", "c2"]).join(wholes, [*same[:4], "w1", "w2"], "left")
        met = met.withColumn("settled", F.coalesce(_by_kind(shape, lambda x: _settled(x.elsewhere)), F.lit(False)))
        found.append(keep(met.where("settled and not done").select("doc", "hash", (F.col("at") - F.col("d2")).alias("lo"), (F.col("at") - F.col("d1") + F.col("size")).alias("hi"), "kind"), "spans"))
        stay = met.where((F.col("d1") < F.col("d2")) & (~F.col("settled") | _is_first()))
        before = (state, groups)
        state = stay.withColumn("done", F.col("done") | F.col("settled")).withColumn("x", _parts(4)).select(*own, "x.*")
    forget(state)
    out = contexts.sparkSession.createDataFrame([], SPANS)
    for x in found:
        out = out.union(x)
    return out


def repeated_spans(anchors: DataFrame, docs: DataFrame, shape: Shape, context: Callable[[bytes, list[tuple[int, int, int]]], list[tuple[bytes, bytes]]]) -> DataFrame:
    """(doc, hash, lo, hi, kind): stretches of symbols that repeated windows cover; they may overlap.

    ``docs`` is (id, text); ``hash`` is ``xxhash64`` of the text, ``kind`` the place in
    ``shape.windows``.  ``context`` cuts what stands before and after anchors (at, lo, hi) out
    of a text.
    """
    anchors = keep(anchors, "anchors")
    often = F.min("doc") < F.max("doc") if all(x.elsewhere == "earlier" for x in shape.windows) else F.count("*") > 1
    texts = F.min("hash") != F.max("hash") if any(x.elsewhere == "row" for x in shape.windows) else F.lit(True)
    keys = anchors.groupBy("key").agg((F.min("ctx") != F.max("ctx")).alias("multi"), often.alias("often"), texts.alias("texts")).where("often").select("key", "multi", "texts")
    # a table of its own, so that the join may split the rows of a hot key
    keys = keep(keys, "keys")
    hits = keep(anchors.join(keys, "key"), "hits")
    forget(anchors, keys)
    classes = keep(hits.groupBy("key", "ctx").agg(*_first_and_last()), "classes")
    known = keep(hits.join(classes, ["key", "ctx"]), "known")
    forget(hits, classes)
    sure, mask, open_ = [], F.lit(0), _is_first()
    for k, x in enumerate(shape.windows):
        yes = _settled(x.elsewhere)
        sure.append(known.where(yes & (F.col("hi") - F.col("lo") >= x.size)).select("doc", "hash", "lo", "hi", F.lit(k).alias("kind")))
        mask = mask + F.when(yes, 1 << k).otherwise(0)
        # the least of a class stands for it; one that nothing settles yet asks for itself, if other rows could
        open_ = open_ | (~yes & F.col("texts") if x.elsewhere == "row" else ~yes)
    ask = known.where(F.col("multi") & open_).select("key", "doc", "hash", "at", "lo", "hi", mask.alias("sure"))
    wide = keep(ask.groupBy("key").count().where(F.col("count") > shape.task_contexts).select("key", F.lit(True).alias("wide")), "wide")
    none_wide = wide.isEmpty()
    ask = ask.join(wide, "key", "left").groupBy("doc", "hash").agg(F.collect_set(F.struct("key", "at", "lo", "hi", "sure", "wide")).alias("want"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: set[tuple[int | None, int]] = set()  # rows equal in id and text meet here, and one answers for all
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.binary(), pa.binary())
        for b in (x.slice(k, 1000) for x in batches for k in range(0, x.num_rows, 1000)):
            doc, hash_, out = b.column(0).to_pylist(), b.column(1).to_pylist(), []
            for i, (text, want) in enumerate(zip(as_bytes(b.column(2)), b.column(3).to_pylist(), strict=True)):
                if (doc[i], hash_[i]) in done:
                    continue
                done.add((doc[i], hash_[i]))
                found = context(text or b"", [(x["at"], x["lo"], x["hi"]) for x in want])
                out += [(x["key"], doc[i], hash_[i], x["at"], x["sure"], bool(x["wide"]), *y) for x, y in zip(want, found, strict=True)]
            for k in range(0, len(out), 20_000):
                columns = list(zip(*out[k : k + 20_000], strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), *kinds), strict=True)], ["key", "doc", "hash", "at", "sure", "wide", "l", "r"])

    d = docs.select("id", "text", F.xxhash64("text").alias("own"))
    fetched = d.join(ask.hint("shuffle_hash"), F.col("id").eqNullSafe(F.col("doc")) & (F.col("own") == F.col("hash"))).select("doc", "hash", "text", "want").mapInArrow(lean(cut), "key long, doc long, hash long, at int, sure int, wide boolean, l binary, r binary")
    if not none_wide:
        fetched = keep(fetched, "contexts")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_keys(batches, _CHUNK):
            t = t.combine_chunks()
            key, hash_, at, sure = (t.column(i).to_numpy() for i in (0, 2, 3, 4))
            doc = t.column(1).fill_null(0).to_numpy()
            row = mix(doc.view(U) + t.column(1).is_null().to_numpy().astype(U)) ^ hash_.view(U)
            low, high = extend(shape, key, doc, row, shape.symbols(t.column(5).to_pylist()), shape.symbols(t.column(6).to_pylist()))
            for k, window in enumerate(shape.windows):
                yes = np.flatnonzero((high[k] >= 0) & (sure >> k & 1 == 0))
                lo, hi = at[yes] - high[k, yes], at[yes] - low[k, yes] + window.size
                got = t.select([1, 2]).take(pa.array(yes)).combine_chunks().to_batches()
                if got:
                    yield pa.RecordBatch.from_arrays([*got[0].columns, pa.array(lo.astype(np.int32)), pa.array(hi.astype(np.int32)), pa.array(np.full(len(yes), k, np.int32))], ["doc", "hash", "lo", "hi", "kind"])

    spans = fetched.where("not wide").select("key", "doc", "hash", "at", "sure", "l", "r").repartition(partitions(docs.sparkSession) * 2, "key").sortWithinPartitions("key").mapInArrow(lean(compare), SPANS)
    for x in sure:
        spans = spans.union(x)
    if none_wide:
        return spans

    def as_symbols(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns[:5], *(pa.array(shape.symbols(b.column(i).to_pylist()), pa.binary()) for i in (5, 6))], b.schema.names)

    far = fetched.where("wide").select("key", "doc", "hash", "at", "sure", "l", "r")
    return spans.union(_by_ranges(far.mapInArrow(lean(as_symbols), far.schema), shape))


def with_spans(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """All columns of ``docs`` and ``spans`` for every row; a text has at most a few spans for each window of it."""
    per = spans.groupBy("doc", "hash").agg(F.collect_set(F.struct("lo", "hi", "kind")).alias("spans"))
    d = docs.withColumn("__own", F.xxhash64("text"))
    return d.join(per.hint("shuffle_hash"), F.col("id").eqNullSafe(F.col("doc")) & (F.col("__own") == F.col("hash")), "left").select(*(d[c] for c in docs.columns), "spans")


def covered(n: int, spans: list[dict] | None, kind: int = 0) -> np.ndarray:
    """Which of n symbols lie in a span of the kind."""
    edge = np.zeros(n + 1, np.int64)
    for s in spans or ():
        if s["kind"] == kind:
            edge[min(n, s["lo"])] += 1
            edge[min(n, s["hi"])] -= 1
    return np.cumsum(edge[:-1]) > 0
