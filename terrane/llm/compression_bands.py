"""Quality rules by compression bands (operator 1).

A text is judged by how far zstandard shrinks it: the whole text, and each whole chunk of a
fixed size.  Repetitive text shrinks too well, random text hardly at all; what is usual
depends on the length, so every length band has limits of its own.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from terrane.llm._spark import lean
from terrane.llm._text import Piece, U, as_bytes, mix, pieces

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_RUN = 5


@dataclass(frozen=True)
class Bands:
    """Limits of compressed size over size.  ``whole``: (up to so many bytes, least, most)."""

    level: int = 3
    whole: tuple[tuple[float, float, float], ...] = (
        (64, 0.75, 1.40),
        (128, 0.70, 1.25),
        (256, 0.60, 1.05),
        (512, 0.54, 0.90),
        (1024, 0.48, 0.80),
        (2048, 0.455, 0.72),
        (4096, 0.435, 0.68),
        (8192, 0.42, 0.65),
        (16384, 0.40, 0.63),
        (65536, 0.375, 0.62),
        (float("inf"), 0.32, 0.62),
    )
    chunk: int = 4096
    chunk_least: float = 0.40
    chunk_most: float = 0.68
    #: A text goes when more than this share of its chunks lies outside.
    chunk_share: float = 0.5
    min_words: int = 10
    max_repeat_percent: int = 20


def _repeated(words, texts: int) -> np.ndarray:
    """Words per text within 5-word windows that the text holds twice or more."""
    out = np.zeros(texts, np.int64)
    h = words.hashes()
    if len(h) <= _RUN:
        return out
    key = mix(words.text.astype(np.uint64) + U(1))[: len(h) - _RUN + 1].copy()
    for i in range(_RUN):
        key = mix(key * U(0x9E3779B97F4A7C15) + h[i : len(h) - _RUN + 1 + i])
    inside = np.flatnonzero(words.text[: len(key)] == words.text[_RUN - 1 :])
    key = key[inside]
    order = np.argsort(key)
    key = key[order]
    same = np.flatnonzero(key[1:] == key[:-1])
    # equal hashes only name the texts to look at; the words themselves decide
    for t in np.unique(words.text[inside[order[same]]]).tolist():
        w = words.of(t)
        windows = list(zip(*(w[i:] for i in range(_RUN)), strict=False))
        often = Counter(windows)
        hit = np.zeros(len(w) + 1, np.int64)
        for i, x in enumerate(windows):
            if often[x] > 1:
                hit[i] += 1
                hit[min(i + _RUN, len(w))] -= 1
        out[t] = int((np.cumsum(hit)[:-1] > 0).sum())
    return out


def _per_text(mask: np.ndarray, piece: Piece) -> np.ndarray:
    return np.add.reduceat(mask.astype(np.int64), piece.begin)


def measure(texts: list[bytes | None], bands: Bands) -> dict[str, np.ndarray]:
    """All columns of the operator for a list of texts."""
    limit = np.array([b[0] for b in bands.whole])
    least, most = (np.array([b[i] for b in bands.whole]) for i in (1, 2))
    squeeze = zstandard.ZstdCompressor(level=bands.level).compress
    parts: dict[str, list[np.ndarray]] = {}
    for _, run in pieces(texts):
        piece = Piece(run)
        words = piece.words()
        letter = words.inside & ((piece.data & 0xC0) != 0x80)
        got = {"n_words": words.count, "word_chars": _per_text(letter, piece), "n_symbols": _per_text(_SYMBOL[piece.data], piece), "n_repeat_words": _repeated(words, len(run))}
        lines = np.zeros(len(run), np.int64)
        for i, t in enumerate(run):
            if b"\n" in t:
                full = [x for x in t.split(b"\n") if x.split(None, 1)]
                lines[i] = len(full) - len(set(full))
        got["n_dup_lines"] = lines
        size = piece.end - piece.begin
        got["ratio"] = np.array([len(squeeze(t)) / len(t) if t else 0.0 for t in run])
        chunks, outside = size // bands.chunk, np.zeros(len(run), np.int64)
        for i in np.flatnonzero(chunks).tolist():
            each = (len(squeeze(run[i][k : k + bands.chunk])) / bands.chunk for k in range(0, int(chunks[i]) * bands.chunk, bands.chunk))
            outside[i] = sum(not bands.chunk_least <= r <= bands.chunk_most for r in each)
        got["n_chunks"], got["n_chunks_outside"] = chunks, outside
        band = np.searchsorted(limit, size)
        good = (got["ratio"] >= least[band]) & (got["ratio"] <= most[band]) & (outside <= bands.chunk_share * chunks)
        got["base_failed"] = (words.count < bands.min_words) | (100 * got["n_repeat_words"] > bands.max_repeat_percent * words.count)
        got["kept"] = ~got["base_failed"] & good
        for k, v in got.items():
            parts.setdefault(k, []).append(v)
    return {k: np.concatenate(v) for k, v in parts.items()}


COLUMNS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, ratio double, n_chunks long, n_chunks_outside long, base_failed boolean, kept boolean"


def compression_bands(docs: DataFrame, bands: Bands | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts, ratios and verdict for each row of ``docs``: (id, *COLUMNS).

    Null and empty texts have no words, ratio 0 and ``base_failed``.  Repeated rows each get a
    row; other columns are not read; an empty table gives an empty one.
    """
    bands = bands or Bands()
    kind = docs.schema[id_col].dataType.simpleString()
    names = [c.split()[0] for c in COLUMNS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                got = measure(as_bytes(b.column(1)), bands)
                yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(got[n]) for n in names)], [id_col, *names])

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, {COLUMNS}")


def keep_good(docs: DataFrame, bands: Bands | None = None, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that the bands keep, all columns unchanged."""
    bands = bands or Bands()
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield b.filter(pa.array(measure(as_bytes(b.column(at)), bands)["kept"]))

    return docs.mapInArrow(lean(run), docs.schema)
