"""Substring dedup by recompression (operator 7).

Removes each word covered by ``window`` words that also begin, as a sequence, in a text with a
smaller id.  Rounds name runs of a symbol, then pairs of symbols, in the manner of Jeż (2015,
"Recompression"): a fixed rule splits the symbols into left and right ones and each left symbol
is joined with a right one after it.  A name is a hash of what it stands for, so tasks agree on
all names of a round without exchanging them.  Which symbols join depends only on neighbours,
so equal stretches of words get equal symbols except within ``edge`` words of their ends.
Symbols of the last round are thinned out by the least name within a window, and those that two
texts share lead to the repeats, which are then verified word by word.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrane.llm._repeats import ANCHORS, Shape, Window, covered, repeated_spans, with_spans
from terrane.llm._text import Piece, U, as_bytes, mix, pieces, prefix, sliding_argmin, spans

_NONE = U((1 << 64) - 1)


@dataclass(frozen=True)
class Recompression:
    window: int = 50
    #: Runs of exactly two equal words get a name; longer ones stay single words.
    run: int = 2
    #: Most words of a symbol after each round of pairs.
    most: tuple[int, ...] = (3, 4, 6)

    @property
    def edge(self) -> int:
        """Words at either end of equal stretches whose symbols may differ: each round adds the longest symbol before it."""
        return self.run + self.run + sum(self.most[:-1])

    @property
    def inner(self) -> int:
        """Places in a window where a symbol can begin that is sure to be the same in equal windows."""
        return self.window - 2 * self.edge - self.most[-1] + 1

    @property
    def shape(self) -> Shape:
        return Shape((Window(self.window, "earlier"),), self.edge, self.edge + self.inner - 1, 8, symbols=_hashes_of)


def name_symbols(h: np.ndarray, text: np.ndarray, how: Recompression) -> tuple[np.ndarray, np.ndarray]:
    """(first word, name) of the symbols after all rounds over word hashes ``h`` of texts ``text``."""
    at, name = np.arange(len(h)), h.copy()
    size = np.ones(len(h), np.int64)
    if not len(h):
        return at, name
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (text[1:] != text[:-1])
    first = np.flatnonzero(new)
    length = np.diff(np.append(first, len(h)))
    run = first[length == how.run]
    name[run] = mix(name[run] * U(0xA24BAED4963EE407) + U(how.run))
    size[run] = how.run
    stay = np.ones(len(h), bool)
    for k in range(1, how.run):
        stay[run + k] = False
    at, name, size = at[stay], name[stay], size[stay]
    for r, most in enumerate(how.most):
        is_left = (mix(name + U(0x9FB21C651E98DF25 + r)) & U(1)).astype(bool)
        pair = np.flatnonzero(is_left[:-1] & ~is_left[1:] & (text[at[:-1]] == text[at[1:]]) & (size[:-1] + size[1:] <= most))
        name[pair] = mix(name[pair] * U(0x9E6C63D0876A9A47) + name[pair + 1] * U(0xD6E8FEB86659FD93) + U(r))
        size[pair] += size[pair + 1]
        stay = np.ones(len(at), bool)
        stay[pair + 1] = False
        at, name, size = at[stay], name[stay], size[stay]
    return at, name


def anchors(texts: list[bytes | None], how: Recompression) -> Iterator[tuple[np.ndarray, ...]]:
    """(text, key, ctx, at, lo, hi) arrays of the thinned symbols, in words."""
    shape = how.shape
    for first, run in pieces(texts, limit=512 << 10):
        words = Piece(run).words()
        h = words.hashes()
        if len(h) < how.window:
            continue
        name = np.full(len(h), _NONE)
        where, own = name_symbols(h, words.text, how)
        name[where] = own
        best = sliding_argmin(name, how.inner)
        start = np.flatnonzero(words.text[: len(h) - how.window + 1] == words.text[how.window - 1 :])
        at = np.unique(best[start + how.edge])
        at = at[name[at] != _NONE]
        a, b = words.first[words.text[at]], words.first[words.text[at] + 1]
        lo, hi = np.maximum(a, at - shape.most), np.minimum(b, at + shape.right)
        sums = prefix(mix(h))
        ctx = mix(spans(sums, lo, hi) + (at - lo).astype(np.uint64) * U(0x9E3779B97F4A7C15))
        # all windows around a symbol hold these words, so they belong to its key
        core = spans(sums, at - shape.least, at - shape.most + how.window)
        yield first + words.text[at], mix(name[at] + core).view(np.int64), ctx.view(np.int64), at - a, lo - a, hi - a


def _hashes_of(texts: list[bytes]) -> list[bytes]:
    out = []
    for _, run in pieces(texts):
        words = Piece(run).words()
        h, at = words.hashes(), words.first.tolist()
        out += [h[a:b].tobytes() for a, b in zip(at[:-1], at[1:], strict=True)]
    return out


def _anchors(docs: DataFrame, how: Recompression) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for text, key, ctx, *place in anchors(as_bytes(b.column(1)), how):
                own = pa.array(text)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(ctx), b.column(0).take(own), b.column(2).take(own), *(pa.array(x.astype(np.int32)) for x in place)], ["key", "ctx", "doc", "hash", "at", "lo", "hi"])

    return docs.where("id is not null").select("id", "text", F.xxhash64("text").alias("hash")).mapInArrow(run, ANCHORS)


def _contexts(text: bytes, want: list[tuple[int, int, int]]) -> list[tuple[bytes, bytes]]:
    words = Piece([text]).words()
    a, b = words.start.tolist(), words.stop.tolist()
    return [(text[a[lo] : b[at - 1]], text[a[at] : b[hi - 1]]) for at, lo, hi in want]


def repeated_words(docs: DataFrame, how: Recompression | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, n_removed, kept_sha256, kept_text) for each row of ``docs``.

    Words are compared by 64-bit hashes.  Null and empty texts have no words.  Rows that share
    an id each keep their own spans and remove nothing from each other; a null id is smaller
    than none, so its text is left whole and ignored; other columns are not read; an empty
    table gives an empty one.
    """
    how = how or Recompression()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for text, found in zip(as_bytes(b.column(1)), b.column(2).to_pylist(), strict=True):
                words = (text or b"").split()
                gone = covered(len(words), found)
                kept = b" ".join([w for w, g in zip(words, gone.tolist(), strict=True) if not g] if found else words)
                out.append((len(words), int(gone.sum()), hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "replace")))
            columns = zip(*out, strict=True) if out else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True))], ["id", "n_words", "n_removed", "kept_sha256", "kept_text"])

    d = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    marked = with_spans(d, repeated_spans(_anchors(d, how), d, how.shape, _contexts))
    return marked.mapInArrow(run, "id long, n_words long, n_removed long, kept_sha256 string, kept_text string").withColumnRenamed("id", id_col)
