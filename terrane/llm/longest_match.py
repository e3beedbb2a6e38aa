"""Token counts by a linear longest-match automaton (operator 8).

Greedy word-piece tokenisation takes the longest vocabulary piece at each place.  The trie of
the vocabulary gets failure links in the manner of Song et al. (2021, "Fast WordPiece
Tokenization"): when no edge fits, the pieces that greedy matching has completed by then are
popped and the automaton moves to the state of what is left.  Only the number of popped pieces
is stored, so a word's count comes out in one pass and no piece is ever built.

Words run over white space; A-Z are lower-cased; a word ends with the end-of-word symbol of
the vocabulary.  All distinct words of a piece of text advance side by side.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from terrane.llm._text import Piece, as_bytes, pieces

VOCABULARY = "/opt/tokenizers/word_bpe_49k.json"
_END = 256
_SYMBOLS = 257


def _byte_of_character() -> dict[str, int]:
    """Byte-level vocabularies write each byte as a printable character: itself if printable, else the next free one from 256 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(rest)}


def read_vocabulary(path: str = VOCABULARY, end: str = "</w>") -> list[tuple[int, ...]]:
    """Pieces as symbol sequences: bytes, and 256 for the end of a word."""
    spec = json.load(open(path))
    special = {x["content"] for x in spec.get("added_tokens", ())}
    at = _byte_of_character()
    out = []
    for piece in spec["model"]["vocab"]:
        if piece not in special:
            stop = piece.endswith(end)
            body = piece[: -len(end)] if stop else piece
            out.append((*(at[c] for c in body), *([_END] if stop else [])))
    return out


@dataclass
class Automaton:
    """``key`` (sorted: state * 257 + symbol) and ``to``: edges.  ``fail`` and ``pop``: where a state falls back to and how many pieces that completes."""

    key: np.ndarray
    to: np.ndarray
    fail: np.ndarray
    pop: np.ndarray

    @staticmethod
    def build(vocabulary: list[tuple[int, ...]]) -> Automaton:
        edges: list[dict[int, int]] = [{}]
        final = [False]
        for piece in vocabulary:
            v = 0
            for c in piece:
                if c not in edges[v]:
                    edges[v][c] = len(edges)
                    edges.append({})
                    final.append(False)
                v = edges[v][c]
            final[v] = v != 0
        fail, pop = [-1] * len(edges), [0] * len(edges)
        level = [(0, c, v) for c, v in edges[0].items()]
        while level:  # breadth first: a state's links rest on those of shorter states
            below = []
            for u, c, v in level:
                if final[v]:
                    fail[v], pop[v] = 0, 1
                elif u:
                    z, n = fail[u], pop[u]
                    while z >= 0 and c not in edges[z]:
                        n += pop[z]
                        z = fail[z]
                    if z >= 0:
                        fail[v], pop[v] = edges[z][c], n
                below += [(v, d, w) for d, w in edges[v].items()]
            level = below
        flat = sorted((v * _SYMBOLS + c, w) for v, e in enumerate(edges) for c, w in e.items())
        return Automaton(np.array([k for k, _ in flat], np.int64), np.array([w for _, w in flat], np.int32), np.array(fail, np.int32), np.array(pop, np.int32))

    def _step(self, state: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        key = state.astype(np.int64) * _SYMBOLS + symbol
        at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        return np.where(self.key[at] == key, self.to[at], -1)

    def counts(self, data: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """Pieces of each word data[start:stop]; a word that the vocabulary cannot cover counts as one."""
        n = np.zeros(len(start), np.int64)
        order = np.argsort(start - stop, kind="stable")  # longest first, so those still running are a prefix
        size = (stop - start)[order]
        state = np.zeros(len(start), np.int64)
        lost = np.zeros(len(start), bool)
        for k in range(int(size[0]) + 1 if len(size) else 0):
            running = np.searchsorted(-size, -k, "right")
            todo = np.arange(running)
            symbol = np.where(size[:running] > k, data[np.minimum(start[order[:running]] + k, len(data) - 1)].astype(np.int64), _END)
            while len(todo):
                to = self._step(state[todo], symbol[todo])
                state[todo[to >= 0]] = to[to >= 0]
                todo = todo[to < 0]
                n[todo] += self.pop[state[todo]]
                state[todo] = self.fail[state[todo]]
                stuck = todo[state[todo] < 0]
                lost[stuck] = True
                state[stuck] = 0
                todo = todo[state[todo] >= 0] if not len(stuck) else np.setdiff1d(todo, stuck)
        while len(left := np.flatnonzero(state > 0)):
            n[left] += self.pop[state[left]]
            lost[left[self.fail[state[left]] < 0]] = True
            state[left] = self.fail[state[left]]
        n[lost] = 1
        out = np.empty_like(n)
        out[order] = n
        return out


def count_texts(a: Automaton, texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """(words, pieces) of each text."""
    all_words, all_pieces = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for _, run in pieces(texts):
        piece = Piece(run, lower=True)
        words = piece.words()
        _, first, back = np.unique(words.hashes(), return_index=True, return_inverse=True)
        per = a.counts(piece.data, words.start[first], words.stop[first])[back]
        all_words.append(words.count)
        total = np.append(0, np.cumsum(per))
        all_pieces.append(total[words.first[1:]] - total[words.first[:-1]])
    return np.concatenate(all_words), np.concatenate(all_pieces)


def token_counts(docs: DataFrame, path: str = VOCABULARY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, n_tokens) for each row of ``docs``.

    Null, empty and blank texts have no words and no tokens; repeated rows each get a row;
    other columns are not read; an empty table gives an empty one.
    """
    sent = docs.sparkSession.sparkContext.broadcast(Automaton.build(read_vocabulary(path)))  # grows with the vocabulary alone
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words, tokens = count_texts(sent.value, as_bytes(b.column(1)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(words), pa.array(tokens)], ["id", "n_words", "n_tokens"])

    return docs.select(id_col, text_col).mapInArrow(run, f"id {kind}, n_words long, n_tokens long").withColumnRenamed("id", id_col)
