"""Language-model scoring with an Elias-Fano n-gram trie (operator 4).

A bigram model with absolute discounting, interpolated with add-``alpha`` unigrams, is counted
on the training texts and scores every text.  Counts, tries and answers move as arrays:

* Texts are dealt into chunks.  A chunk lists its distinct token pairs with their training
  counts, one array per shard; a shard holds a range of context hashes.
* A shard adds up what the chunks counted, packs a trie, maps it into memory and answers each
  chunk's list: the count of each context and the quantised probability of each pair.
* A chunk looks its tokens up in the answers and sums.

So the whole corpus is counted, no table of it is held in one place, and what moves is
distinct pairs per chunk, not tokens.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrane.llm._spark import partitions
from terrane.llm._text import Piece, U, as_bytes, mix, pieces
from terrane.llm.elias_fano import LEVELS, NEXT_BITS, Trie, quantise

#: Stands before the first word and after the last; its hash is no word's in practice.
_END = mix(np.array([0x5851F42D4C957F2D], np.uint64))[0]


@dataclass(frozen=True)
class LanguageModel:
    alpha: float = 0.1
    discount: float = 0.75
    folds: int = 10
    #: About so many bytes of text are handled together.
    chunk_bytes: int = 16 << 20


def held_out(ids: list, folds: int) -> np.ndarray:
    """Texts kept out of training: crc32 of the id as text divides by ``folds``; a null id is an empty text."""
    return np.array([zlib.crc32(b"" if i is None else str(i).encode()) % folds == 0 for i in ids], bool)


class _Tokens:
    """Tokens of a chunk's texts as places in its sorted token hashes and its sorted pairs."""

    def __init__(self, texts: list[bytes | None]) -> None:
        hashes, counts = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for _, run in pieces(texts):
            words = Piece(run, lower=True).words()
            h = words.hashes()
            last = words.first[1:]
            hashes.append(np.insert(h, last, _END))
            counts.append(words.count + 1)
        token, self.count = np.concatenate(hashes), np.concatenate(counts)
        self.stop = np.cumsum(self.count)
        self.vocabulary, self.token = np.unique(token, return_inverse=True)
        before = np.empty_like(self.token)
        before[1:] = self.token[:-1]
        before[self.stop - self.count] = self.token[self.stop - 1] if len(self.stop) else 0
        code = before.astype(np.int64) << 32 | self.token
        pair, self.pair = np.unique(code, return_inverse=True)
        self.first, self.second = pair >> 32, pair & 0xFFFFFFFF

    def sums(self, values: np.ndarray) -> np.ndarray:
        return np.add.reduceat(values.astype(np.float64), self.stop - self.count) if len(self.stop) else np.zeros(0)


def _shard(h: np.ndarray, shards: int) -> np.ndarray:
    return ((h >> U(32)) * U(shards)) >> U(32)


def _list_pairs(t: _Tokens, train: np.ndarray, shards: int) -> list[bytes]:
    """For each shard: contexts, pairs per context, 40 bits of the word after, and training counts."""
    often = np.bincount(t.pair, weights=np.repeat(train, t.count), minlength=len(t.first)).astype("<u4")
    word = t.vocabulary[t.second] >> U(64 - NEXT_BITS)
    cut = np.searchsorted(_shard(t.vocabulary, shards), np.arange(shards + 1))
    edge = np.searchsorted(t.first, cut)
    kids = np.bincount(t.first, minlength=len(t.vocabulary)).astype("<u4")
    out = []
    for a, b, c, d in zip(cut[:-1].tolist(), cut[1:].tolist(), edge[:-1].tolist(), edge[1:].tolist(), strict=True):
        w = word[c:d]
        head = np.array([b - a, d - c], "<u4").tobytes()
        out.append(head + t.vocabulary[a:b].tobytes() + kids[a:b].tobytes() + (w >> U(8)).astype("<u4").tobytes() + (w & U(255)).astype("u1").tobytes() + often[c:d].tobytes())
    return out


def _read_pairs(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    n, m = np.frombuffer(raw, "<u4", 2).tolist()
    at, out = 8, []
    for kind, size, count in (("<u8", 8, n), ("<u4", 4, n), ("<u4", 4, m), ("u1", 1, m), ("<u4", 4, m)):
        out.append(np.frombuffer(raw, kind, count, at))
        at += size * count
    context, kids, high, low, often = out
    return context, kids.astype(np.int64), (high.astype(np.uint64) << U(8)) | low, often


def pack_trie(lists: list[bytes], discount: float) -> bytes:
    """The trie of one shard, from what all chunks listed for it."""
    read = [_read_pairs(x) for x in lists]
    all_contexts = np.unique(np.concatenate([np.zeros(0, np.uint64), *(r[0] for r in read)]))
    if len(all_contexts) >= 1 << (64 - NEXT_BITS):
        raise ValueError("too many contexts in a shard; lower chunk_bytes")
    code = [np.zeros(0, np.uint64)] + [(np.repeat(np.searchsorted(all_contexts, c), k).astype(np.uint64) << U(NEXT_BITS)) | w for c, k, w, _ in read]
    often = [np.zeros(0, np.int64)] + [o.astype(np.int64) for *_, o in read]
    code, often = np.concatenate(code), np.concatenate(often)
    some = often > 0
    code, often = code[some], often[some]
    order = np.argsort(code)
    code, often = code[order], often[order]
    first = np.flatnonzero(np.diff(code, prepend=~code[:1]) != 0) if len(code) else np.zeros(0, np.int64)
    code = code[first]
    often = np.add.reduceat(often, first) if len(first) else often
    old, rank = np.unique(code >> U(NEXT_BITS), return_inverse=True)
    return Trie.pack(all_contexts[old.astype(np.int64)], rank, code & U((1 << NEXT_BITS) - 1), often, discount)


def _answer(trie: Trie, raw: bytes) -> bytes:
    """Count and back-off of each context of a list, then the probability of each pair."""
    context, kids, word, _ = _read_pairs(raw)
    rank = trie.find(context)
    known = rank >= 0
    count, back = np.zeros(len(rank), "<i8"), np.full(len(rank), quantise(np.ones(1))[0], np.uint8)
    count[known], back[known] = trie.count[rank[known]], trie.back_off[rank[known]]
    return np.array([len(context), len(word)], "<u4").tobytes() + count.tobytes() + back.tobytes() + trie.seen_codes(np.repeat(rank, kids), word).tobytes()


def _read_answer(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n, m = np.frombuffer(raw, "<u4", 2).tolist()
    return np.frombuffer(raw, "<i8", n, 8), np.frombuffer(raw, "u1", n, 8 + 8 * n), np.frombuffer(raw, "u1", m, 8 + 9 * n)


SCHEMA = "held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _chunked(docs: DataFrame, how: LanguageModel, id_col: str, text_col: str) -> tuple[DataFrame, int]:
    d = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    size = d.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(partitions(docs.sparkSession), -(-size // how.chunk_bytes))
    return d.withColumn("chunk", F.pmod(F.xxhash64("id", "text"), F.lit(n)).cast("int")), n


def _lists(d: DataFrame, how: LanguageModel, shards: int) -> DataFrame:
    def count(t: pa.Table) -> pa.Table:
        tokens = _Tokens(as_bytes(t.column("text")))
        lists = _list_pairs(tokens, ~held_out(t.column("id").to_pylist(), how.folds), shards)
        chunk = t.column("chunk")[0].as_py()
        return pa.table([pa.array([chunk] * shards, pa.int32()), pa.array(range(shards), pa.int32()), pa.array(lists, pa.binary())], names=["chunk", "shard", "pairs"])

    return d.groupBy("chunk").applyInArrow(count, "chunk int, shard int, pairs binary")


def train(docs: DataFrame, how: LanguageModel | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The model as a table: (shard, trie), each trie a file's bytes for ``Trie.load``."""
    how = how or LanguageModel()
    d, n = _chunked(docs, how, id_col, text_col)

    def build(t: pa.Table) -> pa.Table:
        return pa.table([t.column("shard").slice(0, 1), pa.array([pack_trie(t.column("pairs").to_pylist(), how.discount)], pa.binary())], names=["shard", "trie"])

    return _lists(d, how, n).groupBy("shard").applyInArrow(build, "shard int, trie binary")


def score_texts(docs: DataFrame, how: LanguageModel | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, *SCHEMA) for each row of ``docs``; the model learns from those that are not held out.

    Null and empty texts are one end token.  Repeated rows count and are scored each; other
    columns are not read; an empty table gives an empty one.  If every text is held out all
    counts are zero and each token has the same base score.
    """
    how = how or LanguageModel()
    d, n = _chunked(docs, how, id_col, text_col)
    kind = docs.schema[id_col].dataType.simpleString()

    def serve(t: pa.Table) -> pa.Table:
        lists = t.column("pairs").to_pylist()
        trie = Trie.load(pack_trie(lists, how.discount))
        many = [int(trie.count.sum())] * len(lists)
        return pa.table([t.column("chunk"), t.column("shard"), pa.array([_answer(trie, x) for x in lists], pa.binary()), pa.array(many, pa.int64()), pa.array([trie.contexts.n] * len(lists), pa.int64())], names=["chunk", "shard", "answer", "tokens", "kinds"])

    def finish(texts: pa.Table, answers: pa.Table) -> pa.Table:
        t = _Tokens(as_bytes(texts.column("text")))
        answers = answers.sort_by("shard")
        count, back, seen = (np.concatenate(x) for x in zip(*(_read_answer(a) for a in answers.column("answer").to_pylist()), strict=True))
        if len(count) != len(t.vocabulary) or len(seen) != len(t.first):
            raise ValueError("a chunk was dealt other texts than before; is the input deterministic?")
        total, kinds = sum(answers.column("tokens").to_pylist()), sum(answers.column("kinds").to_pylist())
        p = (count + how.alpha) / (total + how.alpha * (kinds + 1))
        pair = np.log10(LEVELS[seen] + LEVELS[back[t.first]] * p[t.second])
        columns = [pa.array(held_out(texts.column("id").to_pylist(), how.folds)), pa.array(t.count), pa.array(t.sums((count > 0)[t.token]).astype(np.int64)), pa.array(np.full(len(t.count), total)), pa.array(t.sums(np.log10(p)[t.token])), pa.array(t.sums(pair[t.pair]))]
        return pa.table([texts.column("id"), *columns], names=["id", *(c.split()[0] for c in SCHEMA.split(", "))])

    answers = _lists(d, how, n).groupBy("shard").applyInArrow(serve, "chunk int, shard int, answer binary, tokens long, kinds long")
    return d.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(finish, f"id {kind}, {SCHEMA}").withColumnRenamed("id", id_col)
