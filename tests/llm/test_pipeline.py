import random

import corpus_pipeline
from terrane.llm._spark import lean
from terrane.llm.piece_matching import Encoder, Model

_SYLLABLES = [a + b for a in "bdfgklmnprstv" for b in ("a", "e", "i", "on", "er")]


def prose(rng, n):
    out = []
    while len(out) < n:
        out += ["".join(rng.choice(_SYLLABLES) for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(5, 14))]
        out[-1] += "."
    return out[:n]


def test_each_stage_does_what_it_is_for(spark, tmp_path):
    rng = random.Random(11)
    clean = {i: " ".join(prose(rng, 220)) for i in range(10)}
    passage = " ".join(prose(rng, 120))
    item = " ".join(prose(rng, 30))
    near = clean[0].split()
    near[100] = "zzz"
    docs = dict(clean)
    docs |= {20: "too short", 21: "spam and eggs " * 80, 22: clean[1], 23: " ".join(near), 24: " ".join(prose(rng, 100)) + " " + item + " " + " ".join(prose(rng, 100))}
    docs |= {25: " ".join(prose(rng, 150)) + " " + passage, 26: passage + " " + " ".join(prose(rng, 150)), 27: None, 28: ""}
    df = spark.createDataFrame([(i, t, "en", "s", len(t or ""), "x") for i, t in docs.items()], "doc_id long, text string, lang string, source string, n_chars long, ids string")
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    kept, at = {}, df
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, at, str(tmp_path))
        out.write.parquet(f"{tmp_path}/{name}")
        at = spark.read.parquet(f"{tmp_path}/{name}")
        kept[name] = {r.doc_id: r for r in at.collect()}
        if name != corpus_pipeline.STAGES[-1][0]:
            assert at.columns == df.columns
    quality, single, cut, safe, tokens = (kept[n] for n, _ in corpus_pipeline.STAGES)
    assert set(quality) == set(docs) - {20, 21, 27, 28}
    assert set(single) == set(quality) - {22, 23}
    assert set(cut) == set(single) and passage[30:-30] not in cut[25].text and passage[30:-30] not in cut[26].text
    assert all(cut[i].text == clean[i] and cut[i].n_chars == len(clean[i]) for i in clean)
    assert set(safe) == set(cut) - {24}
    coder = Encoder(Model.read())
    assert {i: list(r.ids) for i, r in tokens.items()} == {i: coder.encode([r.text.encode()])[0].tolist() for i, r in safe.items()}
    whole = {r.doc_id: list(r.ids) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert whole == {i: list(r.ids) for i, r in tokens.items()}


def test_repeated_and_null_ids(spark):
    rng = random.Random(5)
    a, b, c, d, e = (" ".join(prose(rng, 120)) for _ in range(5))
    passage = " ".join(prose(rng, 120))
    kind = "doc_id long, text string, n_chars long"
    df = spark.createDataFrame([(1, a, 0), (3, b, 0), (3, b, 0), (5, c, 0), (5, a, 0), (None, d, 0), (None, e, 0)], kind)
    got = corpus_pipeline.near_duplicates(spark, df, "")
    assert sorted((r.doc_id or 0, r.text) for r in got.collect()) == sorted([(1, a), (3, b), (5, c), (0, d), (0, e)])
    df = spark.createDataFrame([(1, a, 0), (1, a, 0), (2, b + " " + passage, 0), (3, passage + " " + c, 0), (None, d, 0)], kind)
    got = corpus_pipeline.repeated_passages(spark, df, "").collect()
    assert sorted(r.doc_id or 0 for r in got) == [0, 1, 1, 2, 3]
    assert all(r.text == {None: d, 1: a}.get(r.doc_id, r.text) and r.n_chars == len(r.text) for r in got)
    assert not any(passage[30:-30] in r.text for r in got)


def test_empty_documents(spark, tmp_path):
    df = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_a_worker_gives_free_memory_back_when_a_task_ends():
    resident = lambda: int(open("/proc/self/statm").read().split()[1]) * 4096 >> 20  # noqa: E731, SIM115

    def run(batches):
        texts = [b"%d" % i * 400 for i in range(100_000)]
        last.append(texts[-1])  # holds the end of the heap
        yield from batches

    last, before = [], resident()
    assert list(lean(run)(iter([1, 2]))) == [1, 2]
    assert resident() < before + 100
