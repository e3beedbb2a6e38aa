import hashlib
import math
import random
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import sentencepiece
from pyspark.sql import functions as F

from terrane.llm.elias_fano import EliasFano
from terrane.llm.language_model import LanguageModel, score_texts, train
from terrane.llm.piece_matching import MODEL, Encoder, Model, decode, encode, round_trip
from terrane.llm.warc import digest_of_archives, read_warc, write_warc


def test_sequences():
    rng = np.random.default_rng(1)
    for n, top in ((0, 1), (1, 1 << 63), (5, 10), (1000, 1 << 40), (70000, 1 << 63), (300, 5)):
        v = np.sort(rng.integers(0, top, n, dtype=np.uint64))
        e = EliasFano.build(v)
        assert (e.get(np.arange(n)) == v).all()
        if n:
            x = np.concatenate([rng.integers(0, top, 500, dtype=np.uint64), v[:300]])
            assert (e.successor(x) == np.searchsorted(v, x)).all()


def lower(t) -> list[bytes]:
    return bytes(b + 32 if 65 <= b <= 90 else b for b in (t or "").encode()).split()


def test_scores_equal_brute_force(spark):
    rng = random.Random(3)
    word = lambda: rng.choice(["a", "b", "Cé", "dd", "e", "f", "g"]) + rng.choice(["", "", "x"])
    texts = {d: " ".join(word() for _ in range(rng.randint(0, 40))) for d in range(60)} | {100: None, 101: "", 102: "a " * 4000, 103: "new words only"}
    out = {d: zlib.crc32(str(d).encode()) % 10 == 0 for d in texts}
    one, two, kids = Counter(), Counter(), Counter()
    for d, t in texts.items():
        if not out[d]:
            s = [None, *lower(t), None]
            one.update(s[1:])
            two.update(zip(s, s[1:], strict=False))
    for a, _ in two:
        kids[a] += 1
    n, v = sum(one.values()), len(one)
    p = lambda w: (one[w] + 0.1) / (n + 0.1 * (v + 1))
    df = spark.createDataFrame([(d, t, "x") for d, t in texts.items()], "doc_id long, text string, score string")
    rows = score_texts(df, LanguageModel(chunk_bytes=500)).collect()
    assert len(rows) == len(texts)
    for r in rows:
        s = [None, *lower(texts[r.doc_id]), None]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (out[r.doc_id], len(s) - 1, sum(one[w] > 0 for w in s[1:]), n)
        assert math.isclose(r.base_score, sum(math.log10(p(w)) for w in s[1:]), rel_tol=1e-9)
        want = sum(math.log10((max(0, two[a, b] - 0.75) + 0.75 * kids[a] * p(b)) / one[a] if one[a] else p(b)) for a, b in zip(s, s[1:], strict=False))
        assert abs(r.score - want) <= 0.02 * (len(s) - 1)
    assert train(df).where("length(trie) > 0").count() > 0
    assert score_texts(df.limit(0)).collect() == []


def test_pieces_equal_the_library(spark):
    lib = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    rng = random.Random(9)
    texts = ["Hello world", "  two  spaces \n x\ty", "", " ", "日本語テキスト😀", "ﬁ①", "a\x00b", "\r\n end ", "     ", "x" * 1000, "aaaa bbbb abababab       .....   ", "ééé😀😀 " * 5]
    texts += ["".join(rng.choice("abcdeilnorstu  \n.,éñ") for _ in range(400)) for _ in range(40)]
    coder = Encoder(Model.read())
    raw = [t.encode() for t in texts]
    got = coder.encode(raw)
    assert [x.tolist() for x in got] == lib.encode(texts)
    long = ["".join(rng.choice("abcdeilnorstué0f") for _ in range(n)) for n in (399, 401, 3000, 25000)]
    code = "\n".join(" " * (i % 37) + rng.choice(["if x:", "return", "y = 1"]) + " " * (i % 5) for i in range(2000))
    assert [x.tolist() for x in coder.encode([t.encode() for t in [*long, code]])] == lib.encode([*long, code])
    assert coder.decode(got) == raw
    df = spark.createDataFrame([(1, None, 1), (2, "", 2), (3, "a ▁b", 3), (4, "so it goes " * 3000, 4), (4, "so it goes " * 3000, 4)], "doc_id long, text string, ids int")
    rows = {r.doc_id: (r.n_tokens, r.exact) for r in round_trip(df).collect()}
    assert rows[1] == rows[2] == (0, True) and not rows[3][1] and rows[4][1]
    back = {r.doc_id: r.text for r in decode(encode(df)).collect()}
    assert back[4] == "so it goes " * 3000 and back[1] == back[2] == "" and back[3] == "a  b"
    assert encode(df.limit(0)).collect() == []


def test_archives_come_back(spark, tmp_path):
    rng = random.Random(4)
    fake = "WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:999>\r\nContent-Length: 4\r\n\r\nevil\r\n\r\n"
    pages = [(i, f"http://a/{i}", "".join(rng.choice("<p>ab \r\n é") for _ in range(rng.randint(0, 400)))) for i in range(60)]
    pages += [(100, None, None), (101, "u v", ""), (102, "u", fake * 3 + "x" * 50), (103, "u", "s" * 99), (104, "u", "s" * 99), (107, "u", "t" * 100), (105, "u", "t" * 100), (106, "u", "t" * 100), (None, "u", "t" * 100), (110, "u", "WARC/1.1\r\n" * 300)]
    df = spark.createDataFrame([(*p, "z") for p in pages], "page_id long, url string, html string, digest string").repartition(3)
    least = {}
    for i, _, h in pages:
        if i is not None:
            least[h or ""] = min(least.get(h or "", i), i)
    want = []
    for i, _, h in pages:
        raw = (h or "").encode()
        again = len(raw) >= 100 and least[h or ""] != i
        want.append((i, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if again else "response", least[h or ""] if again else None))
    for k, small in enumerate((200_000, 0)):
        path = f"{tmp_path}/w{k}"
        write_warc(df, path, records_per_file=20, small_rows=small)
        got = [tuple(r) for r in digest_of_archives(read_warc(spark, path, payload=False)).collect()]
        assert sorted(got, key=str) == sorted(want, key=str)
    full = {r.page_id: r.payload for r in read_warc(spark, f"{tmp_path}/w0").collect()}
    assert full["102"] == (fake * 3 + "x" * 50).encode() and "999" not in full
    # larger payloads lie in files of fewer records
    write_warc(df, f"{tmp_path}/bound", records_per_file=20, file_bytes=4_000)
    assert sorted((tuple(r) for r in digest_of_archives(read_warc(spark, f"{tmp_path}/bound", payload=False)).collect()), key=str) == sorted(want, key=str)
    held = read_warc(spark, f"{tmp_path}/bound").groupBy("path").agg(F.sum("size").alias("size"), F.count("size").alias("n")).collect()
    assert all((r["size"] or 0) <= 4_000 or r["n"] == 1 for r in held) and len(held) > 5
    write_warc(df.limit(0), f"{tmp_path}/none")
    assert read_warc(spark, f"{tmp_path}/none").collect() == []


def test_encoding_in_lots_equals_all_at_once(spark):
    """More text than one lot holds, null and empty texts and repeated rows among it, a clashing column."""
    import numpy as np

    from terrane.llm.piece_matching import _LOT, MODEL, Encoder, Model, encode

    rng = random.Random(8)
    vocabulary = ["".join(rng.choice("aeioubcdfg") for _ in range(rng.randint(1, 9))) for _ in range(2000)]
    texts = [" ".join(rng.choices(vocabulary, k=30_000)) for _ in range(45)] + [None, "", "same", "same"]
    assert sum(len(t or "") for t in texts) > _LOT
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, ids string").coalesce(1)
    want = Encoder(Model.read(MODEL)).encode([None if t is None else t.encode() for t in texts])
    got = {r.doc_id: (r.n_tokens, r.ids) for r in encode(df).collect()}
    assert got == {i: (len(w), np.asarray(w).tolist()) for i, w in enumerate(want)}


def test_many_distinct_words_are_encoded_in_little_memory():
    rng = random.Random(4)
    coder = Encoder(Model.read())
    texts = [" ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(9)) for _ in range(100)).encode() for _ in range(1200)]
    tracemalloc.start()
    coder.encode(texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 130 << 20
