"""Suffix-array dedup with threshold-bounded interval expansion (operator 3).

Removes each byte covered by a string of ``length`` bytes that also begins anywhere else.  The
suffixes that are sorted begin at anchors: of the grams within a window of the least length the
least hash names the anchor, so equal windows share one.  Intervals of the sorted suffixes are
expanded breadth first, which gives their common prefixes by increasing value, and backwards
over the Burrows-Wheeler symbols, up to the length and no further (see ``_repeats.extend``).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrane.llm._repeats import ANCHORS, Shape, Window, covered, repeated_spans, with_spans
from terrane.llm._spark import lean
from terrane.llm._text import BYTE_VALUE, Piece, as_bytes, grams, pieces, prefix, sliding_argmin


@dataclass(frozen=True)
class Suffixes:
    length: int = 400
    #: Bytes of a passage: shorter strings that are counted, and not removed, if another row holds them too; 0: not counted.
    #: 250 bytes are 50 words of five bytes with their blanks.
    passage: int = 0
    gram: int = 64
    #: Where a string of ``length`` bytes must also begin: at "any" other place, or in another "row".
    elsewhere: str = "any"

    @property
    def least(self) -> int:
        return min(self.length, self.passage or self.length)

    @property
    def shape(self) -> Shape:
        windows = (Window(self.length, self.elsewhere), *([Window(self.passage, "row")] if self.passage else []))
        return Shape(windows, 0, self.least - self.gram, 1)


def anchors(texts: list[bytes | None], how: Suffixes) -> Iterator[tuple[np.ndarray, ...]]:
    """(text, key, ctx, at, lo, hi) arrays of the anchors."""
    reach = how.least - how.gram
    for first, run in pieces(texts, limit=512 << 10):
        piece = Piece(run)
        g = grams(prefix(BYTE_VALUE[piece.data]), how.gram)
        best = sliding_argmin(g, reach + 1)
        n = len(best)
        if not n:
            continue
        mark = np.zeros(n + 1, np.int64)
        stop = piece.end - how.least + 1
        some = stop > piece.begin
        np.add.at(mark, piece.begin[some], 1)
        np.add.at(mark, stop[some], -1)
        at = np.unique(best[np.cumsum(mark[:-1]) > 0])
        text = np.searchsorted(piece.begin, at, "right") - 1
        lo = np.maximum(piece.begin[text], at - reach)
        hi = np.minimum(piece.end[text], at + how.shape.right)
        raw = piece.raw
        ctx = np.fromiter((xxhash.xxh3_64_intdigest(raw[a:b], c) for a, b, c in zip(lo.tolist(), hi.tolist(), (at - lo).tolist(), strict=True)), np.uint64, len(at))
        base = piece.begin[text]
        yield first + text, g[at].view(np.int64), ctx.view(np.int64), at - base, lo - base, hi - base


def _anchors(docs: DataFrame, how: Suffixes) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for text, key, ctx, *place in anchors(as_bytes(b.column(1)), how):
                own = pa.array(text)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(ctx), b.column(0).take(own), b.column(2).take(own), *(pa.array(x.astype(np.int32)) for x in place)], ["key", "ctx", "doc", "hash", "at", "lo", "hi"])

    return docs.select("id", "text", F.xxhash64("text").alias("hash")).mapInArrow(lean(run), ANCHORS)


def _contexts(text: bytes, want: list[tuple[int, int, int]]) -> list[tuple[bytes, bytes]]:
    return [(text[lo:at], text[at:hi]) for at, lo, hi in want]


def _marked(d: DataFrame, how: Suffixes) -> DataFrame:
    plain = d.select("id", "text")
    return with_spans(d, repeated_spans(_anchors(plain, how), plain, how.shape, _contexts))


def repeated_bytes(docs: DataFrame, how: Suffixes | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256, n_passage_bytes) for each row of ``docs``.

    ``n_passage_bytes`` are bytes in strings of ``how.passage`` bytes that another row holds
    too; rows equal in id and text count as one there, and it is zero if none are asked for.
    Null and empty texts have no bytes.  Every row is a text of its own, whatever its id: rows
    that share an id, equal rows and rows of a null id repeat each other like any two texts.
    Other columns are not read; an empty table gives an empty one.
    """
    how = how or Suffixes(passage=250)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for text, spans in zip(as_bytes(b.column(1)), b.column(2).to_pylist(), strict=True):
                text = text or b""
                gone = covered(len(text), spans)
                kept = np.frombuffer(text, np.uint8)[~gone].tobytes() if spans else text
                out.append((len(text), int(gone.sum()), int((np.diff(gone.view(np.int8), prepend=0) == 1).sum()), hashlib.sha256(kept).hexdigest(), int(covered(len(text), spans, 1).sum()) if spans else 0))
            columns = zip(*out, strict=True) if out else ((), (), (), (), ())
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64()), strict=True))], ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_passage_bytes"])

    d = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return _marked(d, how).mapInArrow(run, "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_passage_bytes long").withColumnRenamed("id", id_col)


def remaining_text(docs: DataFrame, how: Suffixes | None = None, id_col: str = "doc_id", text_col: str = "text", carry: bool = False) -> DataFrame:
    """(id, text, n_removed): the texts without repeated bytes; what is left of a cut character goes too.

    With ``carry``, the other columns follow as the struct ``row``.  Each row of ``docs`` gives
    one row; odd rows as in ``repeated_bytes``, and a null text stays null.
    """
    how = how or Suffixes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kept, n = [], []
            for text, spans in zip(as_bytes(b.column(1)), b.column(b.num_columns - 1).to_pylist(), strict=True):
                gone = covered(len(text or b""), spans)
                n.append(int(gone.sum()))
                kept.append(None if text is None else np.frombuffer(text, np.uint8)[~gone].tobytes().decode("utf-8", "ignore") if spans else text.decode("utf-8", "ignore"))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(kept, pa.string()), pa.array(n, pa.int64()), *b.columns[2:-1]], ["id", "text", "n_removed", *(["row"] if carry else [])])

    d = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), *([F.struct(*(c for c in docs.columns if c != text_col)).alias("row")] if carry else []))
    row = f", row {d.schema['row'].dataType.simpleString()}" if carry else ""
    return _marked(d, how).mapInArrow(lean(run), f"id long, text string, n_removed long{row}").withColumnsRenamed({"id": id_col, "text": text_col})
