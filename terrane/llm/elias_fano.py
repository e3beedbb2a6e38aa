"""Elias-Fano sequences and a two-level n-gram trie over them, kept in one memory-mapped file."""

from __future__ import annotations

import json
import tempfile

import numpy as np

from terrane.llm._text import U

_WORD = 64


def _place_in_byte() -> np.ndarray:
    """[byte, r]: place of the r-th set bit."""
    out = np.zeros((256, 8), np.uint8)
    for b in range(256):
        for r, k in enumerate([i for i in range(8) if b >> i & 1]):
            out[b, r] = k
    return out


_PLACE = _place_in_byte()


def _select(words: np.ndarray, before: np.ndarray, i: np.ndarray, flip: bool) -> np.ndarray:
    """Place of the i-th set (flip: clear) bit; ``before`` counts set bits up to and with each word."""
    if flip:
        count = np.arange(1, len(words) + 1) * _WORD - before.astype(np.int64)
        w = np.searchsorted(count, i, "right")
        r = i - np.where(w > 0, count[np.maximum(w, 1) - 1], 0)
        bits = ~words[w]
    else:
        w = np.searchsorted(before, i, "right")
        r = i - np.where(w > 0, before[np.maximum(w, 1) - 1], 0).astype(np.int64)
        bits = words[w]
    each = np.ascontiguousarray(bits).view(np.uint8).reshape(-1, 8)
    total = np.cumsum(np.bitwise_count(each), axis=1, dtype=np.int64)
    b = (total <= r[:, None]).sum(axis=1)
    row = np.arange(len(b))
    r = r - np.where(b > 0, total[row, np.maximum(b, 1) - 1], 0)
    return w * _WORD + b * 8 + _PLACE[each[row, b], r]


class EliasFano:
    """A rising sequence of 64-bit integers: low bits packed, high bits as gaps in unary."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, before: np.ndarray) -> None:
        self.n, self.low_bits, self.low, self.high, self.before = n, low_bits, low, high, before

    @staticmethod
    def build(values: np.ndarray) -> EliasFano:
        n = len(values)
        top = int(values[-1]) if n else 0
        # one more bit per element of low part halves the unary part
        low_bits = min(56, max(0, (top // max(1, n)).bit_length() - 1, top.bit_length() - 62))
        parts = []
        for a in range(0, n, 1 << 16):  # a multiple of 8 values fills whole bytes
            v = values[a : a + (1 << 16)]
            parts.append(np.packbits(((v[:, None] >> np.arange(low_bits, dtype=np.uint64)) & U(1)).astype(np.uint8).ravel(), bitorder="little"))
        low = np.concatenate([*parts, np.zeros(9, np.uint8)])
        gap = (values >> U(low_bits)).astype(np.int64) + np.arange(n)
        size = (int(gap[-1]) if n else 0) // _WORD + 2
        high = np.zeros(size, np.uint64)
        np.bitwise_or.at(high, gap // _WORD, U(1) << (gap % _WORD).astype(np.uint64))
        return EliasFano(n, low_bits, low, high, np.cumsum(np.bitwise_count(high), dtype=np.uint32 if n < 1 << 32 else np.uint64))

    def _low(self, i: np.ndarray) -> np.ndarray:
        bit = i * self.low_bits
        lane = np.ndarray((len(self.low) - 7,), "<u8", self.low, strides=(1,))
        return (lane[bit >> 3] >> (bit & 7).astype(np.uint64)) & U((1 << self.low_bits) - 1)

    def get(self, i: np.ndarray) -> np.ndarray:
        """Values at places i."""
        if not len(i):
            return np.zeros(0, np.uint64)
        return ((_select(self.high, self.before, i, False) - i).astype(np.uint64) << U(self.low_bits)) | self._low(i)

    def successor(self, x: np.ndarray, first: np.ndarray | None = None, last: np.ndarray | None = None) -> np.ndarray:
        """Place of the first value >= x, within [first, last) if given; ``last`` (or n) if there is none."""
        if first is None:
            # the high part of x names a run of values; only their low parts are searched
            h = (x >> U(self.low_bits)).astype(np.int64)
            zeros = len(self.high) * _WORD - self.n
            up = np.minimum(h, zeros - 1)
            end = _select(self.high, self.before, up, True) - up if len(x) else up
            start = np.where(up > 0, _select(self.high, self.before, np.maximum(up - 1, 0), True) - np.maximum(up - 1, 0), 0) if len(x) else up
            first, last = np.minimum(start, self.n), np.minimum(end, self.n)
        lo, hi = first.astype(np.int64).copy(), last.astype(np.int64).copy()
        live = np.flatnonzero(lo < hi)
        while len(live):
            mid = (lo[live] + hi[live]) >> 1
            less = self.get(mid) < x[live]
            lo[live[less]] = mid[less] + 1
            hi[live[~less]] = mid[~less]
            live = live[lo[live] < hi[live]]
        return lo


#: Probabilities are kept as one byte each, evenly spaced in the logarithm; 0 means none.
_LEAST = -9.0


def quantise(p: np.ndarray) -> np.ndarray:
    level = 255 + np.rint(np.log10(np.maximum(p, 1e-300)) * (254 / -_LEAST))
    return np.where(p > 0, np.clip(level, 1, 255), 0).astype(np.uint8)


LEVELS = np.concatenate([[0.0], 10 ** ((np.arange(1, 256) - 255) * (-_LEAST / 254))])

NEXT_BITS = 40


class Trie:
    """Contexts, and under each the words that follow it.

    ``contexts`` holds the context hashes, ``begin`` the monotone pointers to their first
    child, ``children`` the words, each as its place among all pairs: the rank of the context,
    then 40 bits of the word's hash.  Within a context that is a search relative to it.
    """

    def __init__(self, parts: dict[str, np.ndarray], sizes: dict[str, list[int]]) -> None:
        ef = {k: EliasFano(*sizes[k], *(parts[f"{k}.{x}"] for x in ("low", "high", "before"))) for k in sizes}
        self.contexts, self.begin, self.children = ef["contexts"], ef["begin"], ef["children"]
        self.count, self.back_off, self.seen = parts["count"], parts["back_off"], parts["seen"]

    @staticmethod
    def pack(context: np.ndarray, rank: np.ndarray, word: np.ndarray, count: np.ndarray, discount: float) -> bytes:
        """A trie as bytes, from pairs sorted by (rank, word): sorted context hashes, and per pair its context's rank, 40 bits of the word's hash, and how often it occurs."""
        kids = np.bincount(rank, minlength=len(context))
        total = np.bincount(rank, weights=count, minlength=len(context))
        ef = {
            "contexts": EliasFano.build(context),
            "begin": EliasFano.build(np.append(0, np.cumsum(kids)).astype(np.uint64)),
            "children": EliasFano.build((rank.astype(np.uint64) << U(NEXT_BITS)) | word),
        }
        arrays = {f"{k}.{x}": getattr(e, x) for k, e in ef.items() for x in ("low", "high", "before")}
        arrays |= {"count": total.astype(np.int64), "back_off": quantise(discount * kids / np.maximum(1, total)), "seen": quantise((count - discount) / np.maximum(1, total[rank]))}
        head, at, body = {}, 0, []
        for k, a in arrays.items():
            raw = a.tobytes()
            head[k] = [a.dtype.str, len(a), at]
            raw += bytes(-len(raw) % 8)
            at += len(raw)
            body.append(raw)
        first = json.dumps({"arrays": head, "sizes": {k: [e.n, e.low_bits] for k, e in ef.items()}}).encode()
        first += b" " * (-len(first) % 8)
        return len(first).to_bytes(8, "little") + first + b"".join(body)

    @staticmethod
    def load(raw: bytes) -> Trie:
        """Map a packed trie; the file has no name, so nothing is left behind."""
        with tempfile.TemporaryFile() as f:
            f.write(raw)
            f.flush()
            mapped = np.memmap(f, np.uint8, "r")
        size = int.from_bytes(mapped[:8].tobytes(), "little")
        head = json.loads(mapped[8 : 8 + size].tobytes())
        base = 8 + size
        parts = {k: np.ndarray((n,), kind, mapped, base + at) if n else np.zeros(0, kind) for k, (kind, n, at) in head["arrays"].items()}
        return Trie(parts, head["sizes"])

    def find(self, context: np.ndarray) -> np.ndarray:
        """Rank of each context hash, -1 if it is not there."""
        at = self.contexts.successor(context)
        ok = at < self.contexts.n
        ok[ok] = self.contexts.get(at[ok]) == context[ok]
        return np.where(ok, at, -1)

    def seen_codes(self, rank: np.ndarray, word: np.ndarray) -> np.ndarray:
        """Quantised probability of each word after the context of the given rank; 0 if never seen there."""
        out = np.zeros(len(rank), np.uint8)
        known = np.flatnonzero(rank >= 0)
        r = rank[known]
        some, back = np.unique(r, return_inverse=True)
        first, last = self.begin.get(some)[back].astype(np.int64), self.begin.get(some + 1)[back].astype(np.int64)
        x = (r.astype(np.uint64) << U(NEXT_BITS)) | word[known]
        at = self.children.successor(x, first, last)
        hit = np.flatnonzero(at < last)
        hit = hit[self.children.get(at[hit]) == x[hit]]
        out[known[hit]] = self.seen[at[hit]]
        return out
