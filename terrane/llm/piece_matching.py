"""SentencePiece encoding and decoding by suffix-array matching (operator 9).

A batch's distinct words are laid side by side and their suffixes sorted.  Every vocabulary
piece is binary-searched for the range of suffixes that begin with it; each hit is an edge
from where the piece begins to where it ends.  Edges are sorted by position and relaxed: a
prefix of a word has exactly one encoding, so an edge is taken when its piece may follow the
last piece of the prefix that it extends.  The result equals byte-pair merging.

The model is a byte-pair SentencePiece file with byte fallback and an identity normaliser.
White space is a piece of its own kind: no piece has it after another character, so words
are independent, and runs of several spaces are merged by the same rules apart from them.
"""

from __future__ import annotations

import hashlib
import heapq
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrane.llm._spark import lean
from terrane.llm._text import BYTE_VALUE, U, as_bytes, mix, pieces, prefix, spans

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
_SPACE = "▁".encode()
_FENCE = 0xFF  # not a byte of UTF-8
_NEVER = np.int64(1) << 40
#: Bytes of distinct words that are indexed at once; the index and its edges take some 300 times that.
_BLOCK = 1 << 18
#: Bytes of texts that share the encodings of their distinct words, and rows that are unpacked at once.
_LOT, _ROWS = 2 << 20, 500
#: Words of more bytes are laid out apart from shorter ones, since a batch takes a step for each byte of its longest.
_LONG = 400
#: Words of still more bytes are merged pair by pair, which gives the same.
_GIANT = 20_000
NORMAL, BYTE = 1, 6


def _fields(raw: bytes) -> Iterator[tuple[int, object]]:
    """(number, value) of the fields of a protobuf message."""

    def varint(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            value |= (raw[at] & 127) << shift
            shift += 7
            at += 1
            if raw[at - 1] < 128:
                return value, at

    at = 0
    while at < len(raw):
        key, at = varint(at)
        kind = key & 7
        if kind == 0:
            value, at = varint(at)
        elif kind == 2:
            size, at = varint(at)
            value, at = raw[at : at + size], at + size
        else:
            size = 4 if kind == 5 else 8
            value, at = raw[at : at + size], at + size
        yield key >> 3, value


def merge(symbols: list[bytes], rank: dict[bytes, float]) -> tuple[list[bytes], tuple[bytes, bytes] | None]:
    """Byte-pair merging, best rank first and leftmost among equals: (pieces, the last pair merged)."""
    left, right = list(range(-1, len(symbols) - 1)), list(range(1, len(symbols) + 1))
    s: list[bytes | None] = list(symbols)
    heap: list[tuple[float, int, bytes]] = []

    def offer(i: int) -> None:
        if 0 <= i and right[i] < len(s) and (r := rank.get(both := s[i] + s[right[i]])) is not None:
            heapq.heappush(heap, (r, i, both))

    for i in range(len(s) - 1):
        offer(i)
    last = None
    while heap:
        _, i, both = heapq.heappop(heap)
        if s[i] is None or right[i] >= len(s) or s[i] + s[right[i]] != both:
            continue
        j = right[i]
        last, s[i], s[j], right[i] = (s[i], s[j]), both, None, right[j]
        if right[i] < len(s):
            left[right[i]] = i
        offer(i)
        offer(left[i])
    return [x for x in s if x is not None], last


@dataclass
class Model:
    """Compiled vocabulary; ``text[id]`` has white space as one blank."""

    text: list[bytes]
    byte_id: np.ndarray
    blank: int
    ids: np.ndarray  # of pieces that words can end up with
    low: np.ndarray
    low8: np.ndarray
    high8: np.ndarray
    high: np.ndarray
    size: np.ndarray
    rank: np.ndarray
    left: np.ndarray
    right: np.ndarray
    pair: np.ndarray
    pair_rank: np.ndarray
    white_rank: dict[bytes, float]
    word_rank: dict[bytes, float]
    number: dict[bytes, int]
    width: int

    @staticmethod
    def read(path: str = MODEL) -> Model:
        text, score, kind = [], [], []
        for number, value in _fields(open(path, "rb").read()):
            if number == 1:
                f = dict(_fields(value))
                text.append(f[1].replace(_SPACE, b" "))
                score.append(struct.unpack("<f", f[2])[0] if 2 in f else 0.0)
                kind.append(f.get(3, NORMAL))
        n = len(text)
        byte_id = np.zeros(256, np.int64)
        for i in range(n):
            if kind[i] == BYTE:
                byte_id[int(text[i][3:5], 16)] = i
                text[i] = bytes([int(text[i][3:5], 16)])
        number = {t: i for i, t in enumerate(text) if kind[i] == NORMAL}
        rank_of = {t: -score[i] for t, i in number.items() if len(t.decode()) > 1 and t.strip(b" ")}
        white = {t: -score[i] for t, i in number.items() if len(t) > 1 and not t.strip(b" ")}
        rank, left, right = np.full(n, -1, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
        use, pair = [], {}
        for place, (t, i) in enumerate(sorted(number.items(), key=lambda x: -score[x[1]])):
            symbols = [c.encode() for c in t.decode()]
            if t in white:
                continue
            if len(symbols) > 1:
                rank[i] = place
                got, last = merge(symbols, rank_of)
                if len(got) > 1:
                    continue
                left[i], right[i] = number[last[0]], number[last[1]]
                at = 0
                for c in symbols[:-1]:
                    at += len(c)
                    if t[:at] in number and t[at:] in number:
                        pair[number[t[:at]] * n + number[t[at:]]] = place
            use.append(i)
        ids = np.array(use)
        width = max(len(text[i]) for i in use)
        code = np.array(sorted(pair), np.int64)
        pad = lambda fill: np.array([text[i] + fill * (width - len(text[i])) for i in use], f"S{width}")
        eight = lambda fill: np.array([int.from_bytes((text[i] + fill * 8)[:8], "big") for i in use], np.uint64)
        return Model(text, byte_id, number[b" "], ids, pad(b""), eight(b"\x00"), eight(b"\xff"), pad(b"\xff"), np.array([len(t) for t in text]), rank, left, right, code, np.array([pair[c] for c in code.tolist()], np.int64), white, rank_of, number, width)

    def may_follow(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether merging the text of pieces a and b gives just these two.

        Undo the merges at the boundary from the last to the first: a merge across it must not
        come before the one that took a boundary piece away.
        """
        n = len(self.text)
        good = np.ones(len(a), bool)
        live = np.arange(len(a))
        x, y = a.copy(), b.copy()
        up_x, up_y = np.full(len(a), _NEVER), np.full(len(a), _NEVER)
        while len(live):
            code = x * n + y
            at = np.minimum(np.searchsorted(self.pair, code), len(self.pair) - 1)
            r = np.where(self.pair[at] == code, self.pair_rank[at], _NEVER)
            crossed = (r < up_x) & (r <= up_y) & (r < _NEVER)
            good[live[crossed]] = False
            rx, ry = self.rank[x], self.rank[y]
            go = np.flatnonzero(~crossed & ((rx >= 0) | (ry >= 0)))
            live, x, y, up_x, up_y, rx, ry = (v[go] for v in (live, x, y, up_x, up_y, rx, ry))
            undo = rx > ry
            up_x, up_y = np.where(undo, rx, up_x), np.where(undo, up_y, ry)
            x, y = np.where(undo, self.right[x], x), np.where(undo, y, self.left[y])
        return good

    def white(self, n: int) -> list[int]:
        return [self.number[t] for t in merge([b" "] * n, self.white_rank)[0]]

    def giant(self, word: bytes) -> list[int]:
        """Tokens of one word, by merging its pairs from a heap."""
        found = (([self.number[t]] if t in self.number else self.byte_id[list(t)].tolist()) for t in merge([c.encode("utf-8", "surrogatepass") for c in word.decode("utf-8", "surrogatepass")], self.word_rank)[0])
        return [x for t in found for x in t]


def _suffix_order(lane: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes in the order of their first ``width`` bytes at least, and their first eight bytes; by doubling."""
    order = np.argsort(lane)
    head = lane[order]
    step, level = 8, head
    while True:
        rank = np.empty(len(lane) + step, np.int64)
        rank[len(lane) :] = -1
        rank[order] = np.cumsum(np.diff(level, prepend=level[:1]) != 0)
        if step >= width:
            return order, head
        key = (rank[: len(lane)] << 32) + rank[step : step + len(lane)] + 1
        order = np.argsort(key)
        level = key[order]
        step *= 2


def match(m: Model, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Edges (position, piece, relative position) of the words laid side by side, by relative position."""
    raw = b"".join(w + b"\xff" for w in words)
    n = len(raw)
    data = np.frombuffer(raw + b"\xff" * 32, np.uint8)
    lanes = np.ndarray((n + 24,), ">u8", data, strides=(1,))
    order, head = _suffix_order(lanes[:n].astype(np.uint64), m.width)
    lo, hi = np.searchsorted(head, m.low8, "left"), np.searchsorted(head, m.high8, "right")
    deep = np.flatnonzero((m.size[m.ids] > 8) & (hi > lo))  # eight bytes don't settle these
    if len(deep):
        sorted_ = np.lib.stride_tricks.sliding_window_view(data, m.width)[order].view(f"S{m.width}").ravel()
        lo[deep], hi[deep] = np.searchsorted(sorted_, m.low[deep], "left"), np.searchsorted(sorted_, m.high[deep], "right")
    count = hi - lo
    piece = np.repeat(m.ids, count)
    at = order[np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(lo, count)]
    # characters that no piece covers fall back to their bytes
    size = np.fromiter(map(len, words), np.int64, len(words))
    begin = np.cumsum(size + 1) - size - 1
    lead = ((data[:n] & 0xC0) != 0x80) & (data[:n] != _FENCE)
    step = np.where(data[:n] < 0x80, 1, np.where(data[:n] < 0xE0, 2, np.where(data[:n] < 0xF0, 3, 4)))
    single = np.zeros(n, bool)
    single[at[m.size[piece] == step[at]]] = True
    bare = lead & ~single
    for k in range(1, 4):
        bare[k:] |= (lead & ~single & (step > k))[: n - k]
    loose = np.flatnonzero(bare)
    at = np.concatenate([at, loose])
    piece = np.concatenate([piece, m.byte_id[data[loose]]])
    word = np.searchsorted(begin, at, "right") - 1
    relative = (at - begin[word]).astype(np.uint16 if len(size) and size.max() < 65536 else np.int64)
    by = np.argsort(relative, kind="stable")
    return at[by], piece[by], relative[by]


def encode_words(m: Model, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(tokens of all words one after another, tokens of each word)."""
    size = np.fromiter(map(len, words), np.int64, len(words))
    end = np.cumsum(size + 1) - 1
    begin = end - size
    at, piece, relative = match(m, words)
    last = np.full(int(end[-1]) + 1, -1, np.int64)
    last[begin] = -2
    is_byte = np.zeros(len(m.text), bool)
    is_byte[m.byte_id] = True
    cut = np.flatnonzero(np.diff(relative.astype(np.int64), prepend=-1, append=_NEVER))
    n = len(m.text)
    for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
        p, v = at[a:b], piece[a:b]
        u = last[p]
        some = np.flatnonzero(u != -1)
        p, v, u = p[some], v[some], u[some]
        ask = np.flatnonzero((u >= 0) & ~is_byte[v] & ~is_byte[np.maximum(u, 0)])
        if len(ask):
            code, back = np.unique(u[ask] * n + v[ask], return_inverse=True)
            fits = np.ones(len(p), bool)
            fits[ask] = m.may_follow(code // n, code % n)[back]
            p, v = p[fits], v[fits]
        last[p + m.size[v]] = v
    spot, word, trail = end.copy(), np.arange(len(words)), []
    while len(word):
        v = last[spot]
        trail.append((word, v))
        spot = spot - m.size[v]
        more = spot > begin[word]
        spot, word = spot[more], word[more]
    count = np.zeros(len(words), np.int64)
    for w, _ in trail:
        count[w] += 1
    out = np.empty(count.sum(), np.int32)
    stop = np.cumsum(count)
    for k, (w, v) in enumerate(trail):
        out[stop[w] - 1 - k] = v
    return out, count


class Encoder:
    def __init__(self, model: Model) -> None:
        self.m = model

    def _units(self, texts: list[bytes]) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The escaped piece; each run of blanks with the word after it: begin, word begin, word end, text, key."""
        raw = b"".join((b" " + t.replace(_SPACE, b" ") if t else b"") + b"\xff" for t in texts)
        data = np.frombuffer(raw, np.uint8)
        edge = np.flatnonzero(np.diff((data == 32).view(np.int8), prepend=0, append=0))
        start, word = edge[0::2], edge[1::2]
        stops = np.flatnonzero((data == 32) | (data == _FENCE))
        end = stops[np.searchsorted(stops, word)]
        text = np.searchsorted(np.flatnonzero(data == _FENCE), start)
        key = mix(spans(prefix(BYTE_VALUE[data]), word, end) + (word - start).astype(np.uint64) * U(0x9E3779B97F4A7C15))
        return raw, start, word, end, text, key

    def encode(self, texts: list[bytes | None]) -> list[np.ndarray]:
        """Token ids of each text; null and empty texts have none."""
        parts, known, found = [], np.zeros(0, np.uint64), []
        for _, run in pieces(texts):
            raw, start, word, end, text, key = self._units(run)
            parts.append((len(run), text, key))
            some, first = np.unique(key, return_index=True)
            new = ~_in(known, some)
            known = np.union1d(known, some[new])
            found += [(k, r, raw[a:b]) for k, r, a, b in zip(some[new].tolist(), (word - start)[first[new]].tolist(), word[first[new]].tolist(), end[first[new]].tolist(), strict=True)]
        tokens, count, order = self._distinct(found)
        if not len(order):
            return [np.zeros(0, np.int32) for _ in texts]
        keys = np.array([f[0] for f in found], np.uint64)[order]
        by = np.argsort(keys)
        begin = np.cumsum(count) - count
        out = []
        for n, text, key in parts:
            d = by[np.searchsorted(keys[by], key)]
            c = count[d]
            flat = tokens[np.repeat(begin[d] - (np.cumsum(c) - c), c) + np.arange(c.sum())]
            per = np.bincount(text, weights=c, minlength=n).astype(np.int64) if len(text) else np.zeros(n, np.int64)
            out += np.split(flat, np.cumsum(per)[:-1])
        return out

    def _distinct(self, found: list[tuple[int, int, bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Tokens of the distinct units (key, blanks, word): (all tokens, tokens of each, order of the units)."""
        m = self.m
        size = np.array([len(w) for _, _, w in found], np.int64)
        tokens, count, order = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]

        def add(ids: list[int], t: np.ndarray, c: np.ndarray) -> None:
            runs = np.array([found[i][1] for i in ids], np.int64)
            for k in np.flatnonzero(runs > 1).tolist() if len(runs) else ():
                swap[ids[k]] = runs[k]
            tokens.append(t)
            count.append(c)
            order.append(np.array(ids, np.int64))

        swap: dict[int, int] = {}
        for some in (np.flatnonzero((size > 0) & (size <= _LONG)), np.flatnonzero((size > _LONG) & (size <= _GIANT))):
            ids = some[np.argsort(size[some], kind="stable")].tolist() if len(some) and size[some[-1]] > _LONG else some.tolist()
            at = np.cumsum(size[ids] + 2) // _BLOCK if ids else np.zeros(0, np.int64)
            for block in np.unique(at).tolist():
                own = [ids[k] for k in np.flatnonzero(at == block).tolist()]
                add(own, *encode_words(m, [b" " + found[i][2] for i in own]))
        for i in np.flatnonzero((size == 0) | (size > _GIANT)).tolist():
            got = m.giant(b" " + found[i][2]) if size[i] else [m.blank]
            add([i], np.array(got, np.int32), np.array([len(got)]))
        return self._more_blanks(np.concatenate(tokens), np.concatenate(count), np.concatenate(order), swap)

    def _more_blanks(self, tokens: np.ndarray, count: np.ndarray, order: np.ndarray, swap: dict[int, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Units that begin with several blanks: these are merged apart from the word, whose encoding has one of them."""
        if not swap:
            return tokens, count, order
        m, parts, count = self.m, np.split(tokens, np.cumsum(count)[:-1]), count.copy()
        white = {r: m.white(r) for r in {*swap.values(), *(r - 1 for r in swap.values())}}
        for k in np.flatnonzero(np.isin(order, np.fromiter(swap, np.int64))).tolist():
            got, r = parts[k], swap[int(order[k])]
            parts[k] = np.array(white[r] + got[1:].tolist() if got[0] == m.blank else white[r - 1] + got.tolist(), np.int32)
            count[k] = len(parts[k])
        return np.concatenate(parts), count, order

    def decode(self, ids: list[np.ndarray]) -> list[bytes]:
        """The text of each list of token ids."""
        text = self.m.text
        return [b"".join(map(text.__getitem__, x.tolist()))[1:] for x in ids]


def _in(sorted_: np.ndarray, x: np.ndarray) -> np.ndarray:
    if not len(sorted_):
        return np.zeros(len(x), bool)
    return sorted_[np.minimum(np.searchsorted(sorted_, x), len(sorted_) - 1)] == x


def encode(docs: DataFrame, path: str = MODEL, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids) for each row of ``docs``; see ``round_trip`` for odd inputs."""
    sent = docs.sparkSession.sparkContext.broadcast(Model.read(path))
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Encoder(sent.value)
        for b in (whole.slice(i, _ROWS) for whole in batches for i in range(0, whole.num_rows, _ROWS)):
            for first, texts in pieces(as_bytes(b.column(1)), _LOT):
                ids = coder.encode(texts)
                n = np.array([len(x) for x in ids], np.int64)
                offsets = pa.array(np.append(0, np.cumsum(n)).astype(np.int32))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(first, len(texts)), pa.array(n), pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([np.zeros(0, np.int32), *ids])))], ["id", "n_tokens", "ids"])

    return docs.select(id_col, text_col).mapInArrow(lean(run), f"id {kind}, n_tokens long, ids array<int>").withColumnRenamed("id", id_col)


def decode(tokens: DataFrame, path: str = MODEL, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, text) for each row of ``tokens``; a null list is an empty text."""
    sent = tokens.sparkSession.sparkContext.broadcast(Model.read(path))
    kind = tokens.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Encoder(sent.value)
        for b in batches:
            text = coder.decode([np.array(x or [], np.int64) for x in b.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([t.decode("utf-8", "replace") for t in text], pa.string())], ["id", "text"])

    return tokens.select(F.col(id_col), F.col(ids_col)).mapInArrow(run, f"id {kind}, text string").withColumnRenamed("id", id_col)


def round_trip(docs: DataFrame, path: str = MODEL, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids_sha256, text_sha256, exact): encode, decode, and digest both.

    ``ids_sha256`` is over the ids as little-endian 32-bit integers, ``text_sha256`` over the
    decoded text; ``exact`` tells whether that is the text again, which only the character
    that stands for white space in pieces can prevent.  Null and empty texts have no tokens;
    repeated rows each get a row; other columns are not read; an empty table gives an empty one.
    """
    sent = docs.sparkSession.sparkContext.broadcast(Model.read(path))
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Encoder(sent.value)
        for b in batches:
            texts = as_bytes(b.column(1))
            ids = coder.encode(texts)
            back = coder.decode(ids)
            columns = [pa.array([len(x) for x in ids], pa.int64()), pa.array([hashlib.sha256(x.astype("<i4").tobytes()).hexdigest() for x in ids], pa.string()), pa.array([hashlib.sha256(t).hexdigest() for t in back], pa.string()), pa.array([x == (t or b"") for x, t in zip(back, texts, strict=True)], pa.bool_())]
            yield pa.RecordBatch.from_arrays([b.column(0), *columns], ["id", "n_tokens", "ids_sha256", "text_sha256", "exact"])

    return docs.select(id_col, text_col).mapInArrow(run, f"id {kind}, n_tokens long, ids_sha256 string, text_sha256 string, exact boolean").withColumnRenamed("id", id_col)
