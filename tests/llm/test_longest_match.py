import random

import numpy as np

from terrane.llm.longest_match import Automaton, count_texts, read_vocabulary, token_counts

END = 256
VOCABULARY = read_vocabulary()
AUTOMATON = Automaton.build(VOCABULARY)


def greedy(word: bytes, pieces: set, longest: int) -> int:
    s, at, n = (*word, END), 0, 0
    while at < len(s):
        size = next((k for k in range(min(longest, len(s) - at), 0, -1) if s[at : at + k] in pieces), 0)
        if not size:
            return 1
        at, n = at + size, n + 1
    return n


def lower(text: str) -> bytes:
    return bytes(b + 32 if 65 <= b <= 90 else b for b in text.encode())


def test_equals_greedy_matching():
    pieces, longest = set(VOCABULARY), max(map(len, VOCABULARY))
    rng = random.Random(5)
    texts = ["", "  ", "The unbelievable Étude—of naïveté!!! 12345 日本語 😀", "\x00\x1f a"]
    texts += ["".join(rng.choice("abcdeiounrst  \n.é") for _ in range(300)) for _ in range(20)]
    words, tokens = count_texts(AUTOMATON, [t.encode() for t in texts])
    for t, w, n in zip(texts, words, tokens, strict=True):
        own = lower(t).split()
        assert (w, n) == (len(own), sum(greedy(x, pieces, longest) for x in own))


def test_failure_links_on_a_small_vocabulary():
    pieces = [tuple(x.encode()) for x in ("a", "b", "c", "abcd", "abc", "bcx", "cx")] + [(END,), (*b"c", END)]
    small, longest = set(pieces), 5
    a = Automaton.build(pieces)
    rng = random.Random(7)
    words = ["".join(rng.choice("abcdx") for _ in range(rng.randint(1, 9))).encode() for _ in range(400)]
    raw = b" ".join(words)
    stop = np.cumsum([len(w) + 1 for w in words]) - 1
    start = stop - [len(w) for w in words]
    got = a.counts(np.frombuffer(raw, np.uint8), start, stop)
    assert got.tolist() == [greedy(w, small, longest) for w in words]


def test_odd_tables(spark):
    schema = "doc_id long, text string, n_words string, id int"
    df = spark.createDataFrame([(1, None, "x", 1), (2, "", "x", 2), (None, "a a", None, None), (3, "a a", "x", 3), (3, "a a", "x", 3), (4, "a " * 50000, "x", 4)], schema)
    got = sorted((tuple(r) for r in token_counts(df).collect()), key=str)
    assert got == sorted([(1, 0, 0), (2, 0, 0), (None, 2, 2), (3, 2, 2), (3, 2, 2), (4, 50000, 50000)], key=str)
    assert token_counts(df.limit(0)).collect() == []
