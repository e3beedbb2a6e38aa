import random
import time

import zstandard

from terrane.llm.compression_bands import Bands, compression_bands, keep_good, measure
from terrane.llm.main_text import Costs, extract, main_text, min_cut, read_blocks, ties

ODD = "doc_id long, text string, n_words string, kept int"


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdefghijklmnoprstuvw") for _ in range(rng.randint(2, 9))) for _ in range(n))


def plain(text: bytes) -> tuple:
    """The base columns, one text at a time."""
    words = [w for w in text.replace(b"\t", b" ").replace(b"\n", b" ").replace(b"\x0b", b" ").replace(b"\x0c", b" ").replace(b"\r", b" ").split(b" ") if w]
    lines = [x for x in text.split(b"\n") if x.strip(b" \t\r\x0b\x0c")]
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    hit = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(5)}
    chars = sum(len(w.decode()) for w in words)
    symbols = sum(c in "#*$%&|<>" for c in text.decode())
    return len(words), chars, symbols, len(lines) - len(set(lines)), len(hit)


def test_base_counts_equal_brute_force():
    rng = random.Random(3)
    texts = ["", " \n\t ", "é ñ 日本 # * <b>", "a\nb\na\n\n \nb\r\n", "one two three four five six one two three four five", "x " * 30]
    texts += [prose(rng, 60) + "\n" + prose(random.Random(i % 3), 12) + "\x0b|\x0c" + prose(random.Random(i % 3), 12) for i in range(8)]
    got = measure([t.encode() for t in texts], Bands())
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    assert [tuple(int(got[n][i]) for n in names) for i in range(len(texts))] == [plain(t.encode()) for t in texts]


def test_bands_reject_repetitive_and_random_text():
    rng = random.Random(4)
    noise = "".join(chr(rng.randint(0x21, 0x2FFF)) for _ in range(3000))
    mixed = " ".join(noise[i : i + 9] for i in range(0, 3000, 9))
    near = " ".join(f"item {i} of the list of items" for i in range(300))
    got = measure([prose(rng, 800).encode(), mixed.encode("utf-8", "ignore"), near.encode()], Bands(whole=((float("inf"), 0.30, 0.66),), chunk_least=0.3, chunk_most=0.7))
    assert got["kept"].tolist() == [True, False, False]
    text = prose(rng, 100).encode()
    assert measure([text], Bands())["ratio"][0] == len(zstandard.ZstdCompressor(level=3).compress(text)) / len(text)


def test_odd_rows(spark):
    df = spark.createDataFrame([(1, None, "a", 1), (2, "", "a", 2), (3, "w " * 40000, None, None), (3, "w " * 40000, None, None), (None, "b", "x", 0)], ODD)
    rows = compression_bands(df).collect()
    assert len(rows) == 5 and {(r.doc_id, r.n_words) for r in rows} == {(1, 0), (2, 0), (3, 40000), (None, 1)}
    assert all(r.base_failed and not r.kept for r in rows)
    assert compression_bands(df.limit(0)).collect() == [] and keep_good(df).schema == df.schema and keep_good(df).count() == 0


PAGE = """<!DOCTYPE html><html><head><title>T &amp; U</title><script>var a="<p>no</p>";</script></head><body>
<header class="site"><a href="/">Home</a></header><nav><ul><li><a href=x>One</a></li><li><a>Two</a></ul></nav>
<div class="cookie-notice">We use cookies on this site to make it better for everyone who comes by</div>
<article><h1>A  headline</h1><p>First&nbsp;paragraph &lt;with&gt; <b>bold</b>
 text that is long enough to be read as prose by anyone.<p>Short.</p><!-- <p>hidden</p> --><form><p>Your name please</p><input></form></article>
<section id="comments"><p>I liked this very much and want to say so at some length here.</p></section>
<aside><p>Related stories that nobody asked for but that are here all the same.</p></aside>
<footer>&copy; 2020 all rights</footer></body></html>"""


def test_article_without_the_rest():
    assert extract(PAGE, Costs()) == "A headline\nFirst paragraph <with> bold text that is long enough to be read as prose by anyone.\nShort."
    for odd in (None, "", "<", "<p", "plain words only", "<p>" * 5000, "<a <a <a " * 3000, "&#x110000; &bogus; <!-- no end"):
        assert isinstance(extract(odd, Costs()), str)


def test_cut_is_the_cheapest_labelling():
    rng = random.Random(6)
    for _ in range(200):
        n = rng.randint(1, 8)
        odds = [rng.uniform(-3, 3) for _ in range(n)]
        edges = [(i, j, rng.uniform(0, 2)) for i in range(n) for j in range(i + 1, n) if rng.random() < 0.5]

        def cost(side, odds=odds, edges=edges):
            own = sum(max(o, 0) if not s else max(-o, 0) for o, s in zip(odds, side, strict=True))
            return own + sum(c for i, j, c in edges if side[i] != side[j])

        best = min(cost([bool(m >> i & 1) for i in range(n)]) for m in range(1 << n))
        assert abs(cost(min_cut(odds, edges)) - best) < 1e-6


def test_cut_decides_where_no_element_or_name_tells():
    """Pages of plain divisions: short lines between long ones are text, long links between short ones are menu."""
    rng = random.Random(3)
    costs, wrong = Costs(), {"cut": 0, "sign": 0}

    def words(n):
        return " ".join(rng.choice(["alpha", "beta", "gamma", "delta"]) for _ in range(n))

    for _ in range(100):
        menus = [[f"<div><a href=x>m {words(rng.randint(1, 3))}</a></div>" if rng.random() < 0.8 else f"<div>m {words(rng.randint(5, 9))}</div>" for _ in range(8)] for _ in range(2)]
        body = [f"<div>t {words(1 if rng.random() < 0.25 else rng.randint(15, 60))}</div>" for _ in range(10)]
        blocks = read_blocks("<body>" + "".join(f"<div>{''.join(x)}</div>" for x in (menus[0], body, menus[1])), costs)
        for name, content in (("cut", min_cut([b.odds for b in blocks], ties(blocks, costs))), ("sign", [b.odds > 0 for b in blocks])):
            wrong[name] += sum(yes != b.text.startswith("t") for b, yes in zip(blocks, content, strict=True))
    assert wrong["sign"] > 200 and wrong["cut"] < wrong["sign"] / 3, wrong


def test_deep_and_long_pages_take_linear_time():
    start = time.process_time()
    assert extract("<div>" * 16_000 + "x" + "</div>" * 16_000, Costs()) in ("", "x")
    assert extract("<article>" + "<div><p>word</p>" * 8_000, Costs()) == "\n".join(["word"] * 8_000)
    assert extract("<b><div>" + "<i>" * 8_000 + "</b></section>" * 8_000, Costs()) == ""
    assert time.process_time() - start < 10


def test_distances_follow_the_tree():
    blocks = read_blocks("<div>a<p>b<p>c</div><ul><li>d<li>e", Costs())
    assert [(b.text, b.depth, b.apart) for b in blocks[1:]] == [("b", 2, 1), ("c", 2, 2), ("d", 2, 4), ("e", 2, 2)]


def test_odd_pages(spark):
    df = spark.createDataFrame([(1, "u", None, "x"), (2, None, "", "x"), (2, None, PAGE, "x")], "page_id long, url string, html string, text string")
    rows = main_text(df).collect()
    assert [(r.page_id, r.url, r.n_chars == len(r.text)) for r in rows] == [(1, "u", True), (2, None, True), (2, None, True)]
    assert main_text(df.limit(0)).collect() == []
