"""Byte, word and rolling-hash helpers that the text operators run inside Arrow tasks.

A *piece* is a run of whole documents joined by one newline, small enough that the arrays
derived from it stay in cache.  Hashes are the same in every process.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

PIECE = 2 << 20
U = np.uint64
_MASK = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (the splitmix64 finaliser)."""
    x = x ^ (x >> U(30))
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


BYTE_VALUE = mix(np.arange(1, 257, dtype=np.uint64) * U(0xD1342543DE82EF95))

_WHITE = np.zeros(256, bool)
_WHITE[[0x20, 9, 10, 11, 12, 13]] = True
#: Bytes of words that white space separates.
PLAIN_WORD = ~_WHITE
#: Bytes of words of ASCII letters, digits and everything beyond ASCII.
LETTER_WORD = np.zeros(256, bool)
LETTER_WORD[0x30:0x3A] = LETTER_WORD[0x61:0x7B] = LETTER_WORD[0x41:0x5B] = LETTER_WORD[0x80:] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32
LOWER_TABLE = LOWER.tobytes()


class _Powers:
    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 1 << 16)
            up, down = np.full(size, U(_BASE)), np.full(size, U(_INVERSE))
            up[0] = down[0] = 1
            self.up, self.down = np.cumprod(up), np.cumprod(down)
        return self.up, self.down


_powers = _Powers()


def prefix(values: np.ndarray) -> np.ndarray:
    """Prefix sums from which ``spans`` takes the polynomial hash of any stretch."""
    up, _ = _powers.get(len(values) + 1)
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[: len(values)], out=out[1:])
    return out


def spans(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the stretches [start, end); equal content, equal hash."""
    _, down = _powers.get(len(sums))
    return mix((sums[end] - sums[start]) * down[start])


def grams(sums: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all stretches of length k."""
    if len(sums) <= k:
        return np.zeros(0, np.uint64)
    _, down = _powers.get(len(sums))
    return mix((sums[k:] - sums[:-k]) * down[: len(sums) - k])


def sliding_argmin(h: np.ndarray, w: int) -> np.ndarray:
    """For each window of w values, the place of its least (by the upper 40 bits; ties: the first).

    The choice depends on what is in the window alone, so equal windows choose alike.
    """
    n = len(h)
    if n < w:
        return np.zeros(0, np.int64)
    if n >= 1 << 24:
        step = 1 << 23
        return np.concatenate([a + sliding_argmin(h[a : a + step + w - 1], w) for a in range(0, n - w + 1, step)])
    key = (h & U(_MASK ^ 0xFFFFFF)) | np.arange(n, dtype=np.uint64)
    return (sliding_min(key, w) & U(0xFFFFFF)).astype(np.int64)


def sliding_min(key: np.ndarray, w: int) -> np.ndarray:
    n = len(key)
    full = -(-n // w) * w
    a = np.full(full, U(_MASK))
    a[:n] = key
    a = a.reshape(-1, w)
    left = np.minimum.accumulate(a, axis=1).ravel()
    right = np.minimum.accumulate(a[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[: n - w + 1], left[w - 1 : n])


def as_bytes(column: pa.Array) -> list[bytes | None]:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return column.cast(kind).to_pylist() if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else [None if x is None else str(x).encode() for x in column.to_pylist()]


def pieces(texts: list[bytes | None], limit: int = PIECE, most: int | None = None) -> Iterator[tuple[int, list[bytes]]]:
    """(index of the first text, texts) in runs of about ``limit`` bytes, and of ``most`` texts at most; null counts as empty."""
    first, run, size = 0, [], 0
    for i, t in enumerate(texts):
        t = t or b""
        if run and (size + len(t) > limit or len(run) == most):
            yield first, run
            first, run, size = i, [], 0
        run.append(t)
        size += len(t) + 1
    if run:
        yield first, run


class Piece:
    """Texts side by side: ``data`` bytes, ``begin`` and ``end`` of each text."""

    def __init__(self, texts: list[bytes], lower: bool = False) -> None:
        raw = b"\n".join(texts) + b"\n"
        self.raw = raw.translate(LOWER_TABLE) if lower else raw
        self.data = np.frombuffer(self.raw, np.uint8)
        size = np.fromiter(map(len, texts), np.int64, len(texts))
        self.end = np.cumsum(size + 1) - 1
        self.begin = self.end - size

    def words(self, table: np.ndarray = PLAIN_WORD) -> Words:
        return Words(self, table)


class Words:
    """Words of a piece: byte spans, the text of each, and the first word of each text."""

    def __init__(self, piece: Piece, table: np.ndarray) -> None:
        self.inside = table[piece.data]
        edge = np.flatnonzero(np.diff(self.inside.view(np.int8), prepend=0))
        self.start, self.stop = edge[0::2], edge[1::2]
        self.first = np.searchsorted(self.start, np.append(piece.begin, len(piece.data)))
        self.count = np.diff(self.first)
        self.text = np.repeat(np.arange(len(piece.begin)), self.count)
        self.piece = piece

    def hashes(self) -> np.ndarray:
        return spans(prefix(BYTE_VALUE[self.piece.data]), self.start, self.stop)

    def of(self, text: int) -> list[bytes]:
        raw = self.piece.raw
        a, b = self.first[text], self.first[text + 1]
        return [raw[s:e] for s, e in zip(self.start[a:b].tolist(), self.stop[a:b].tolist(), strict=True)]
