"""Operators 11 and 13: page layouts, runs against brute force, awkward tables."""

import hashlib
import random
import re
import time
import zlib
from html import unescape

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cardinal.llm import main_text, queries, runs
from cardinal.llm.main_text import main_text as text_of
from tests.llm.cases import awkward, docs, empty

SMALL = "/root/testdata/sf0.001"
T = "Rain fell on the hills, and the river rose slowly, past the mill, until the road was gone. "
S = T.strip()


# -- pages ------------------------------------------------------------------

def test_articles_of_the_pages_table(spark):
    """The test pages mark their article: its headings and paragraphs are the text."""
    got = {r.page_id: r for r in queries.op11_tree_scoring(spark, SMALL).collect()}
    pages = spark.read.parquet(f"{SMALL}/pages.parquet").collect()
    assert len(got) == len(pages)
    for p in pages:
        inside = re.search("<article>(.*?)</article>", p.html, re.DOTALL)[1]
        parts = [" ".join(unescape(re.sub("<[^>]*>", " ", x)).split()) for x in re.split("</?(?:p|h1)>", inside)]
        want = "\n".join(x for x in parts if x)
        assert (got[p.page_id].url, got[p.page_id].text, got[p.page_id].n_chars) == (p.url, want, len(want))


LAYOUTS = {
    "boxes without an article": (
        f'<div id="header"><h1>Site</h1></div><div class="menu"><a href=1>Home</a><a href=2>About</a></div><div id="wrap">'
        f'<div id="content"><h2>Title</h2><p>{T}<p>{T * 2}<ul><li>one<li>two <b>bold</ul></div><div class="sidebar"><p>{T}</p></div>'
        f'</div><div id="comments"><p>{T * 9}</p></div><div id=footer>&copy; x</div>', f"Title\n{S}\n{(T * 2).strip()}\none\ntwo bold"),
    "rows of columns": ("<div>" + "".join(f"<div class=row><div class=col><p>{k} {T}</p></div></div>" for k in "ABC")
                        + "</div><div><a href=x>l1</a> <a href=y>l2</a></div>", "\n".join(f"{k} {S}" for k in "ABC")),
    "a short article beside a long advert": (f'<nav>a</nav><div class="ad">{T * 4}</div><article><p>Hi.</p></article>', "Hi."),
    "text only": ("just text &amp; more", "just text & more"),
    "menu only": ("<nav><a href=1>x</a></nav>", ""),
    "unclosed tags and references": (
        '<article><p>one <b>two<p>three <a href="x>y">four</a> 1 < 2 &lt;b&gt; it&#39;s &nbsp; ok<br>five<script>bad<p>',
        "one two\nthree four 1 < 2 <b> it's ok five"),
    "inline advert, shares and a form": (
        '<article><p>A <span class="ad">AD</span>B <span>C</span></p><div class="share"><a>f</a></div><form><p>x<input></form>'
        "<p>D</p></article>", "A B C\nD"),
    "quote in a bare attribute": ("<article><p title=it's>don't</p><p>x</p></article>", "don't\nx"),
    "notice, sections, comments under a heading": (
        f'<div class="cookie-consent">{T * 10}</div><main><section><h2>H</h2>{T}</section><section><h2>3 Comments</h2><p>{T * 9}</p>'
        "</section></main>", f"H\n{S}"),
    "article inside a box named for its sidebar": (f'<div class="content-sidebar"><article><p>{T}</p></article></div>', S),
    "link list in an article": (f"<article><p>{T}</p><ul><li><a href=a>one</a><li><a href=b>two</a></ul><p>{T}</p></article>", f"{S}\n{S}"),
    "hidden parts": (f'<article><p>{T}</p><p style="display: none">no</p><div hidden>no</div><p aria-hidden="true">no</p></article>', S),
    "table rows without ends": ("<article><table><tr><td>a<td>b<tr><td>c</table><p>d</article>", "a\nb\nc\nd"),
    "comment marks": ("<article><!--> <p>a<!-- b --><p>c<? d ?><! e></article>", "a\nc"),
    "misnested inline tags": ("<article><b><p>a</b> b</p></article>", "a b"),
}


@pytest.mark.parametrize("name", sorted(LAYOUTS))
def test_layouts(name):
    html, want = LAYOUTS[name]
    assert text_of(html) == want


@pytest.mark.parametrize("html", [
    "<div>" * 30_000 + "x", "<p><b>" * 30_000, "<" * 100_000, '<a ="' * 30_000 + ">", "<li>" * 30_000, "<table>" * 20_000,
    "<div><a>x</a>" * 20_000, "<ul><li>a" * 20_000, "&" * 100_000, "<b><i>" * 20_000 + "</b>" * 20_000, "<!--" * 30_000,
    "<script>" * 30_000, "<td>" * 20_000, "<h1>a" * 20_000])
def test_hostile_pages_take_linear_time(html):
    began = time.time()
    text_of(html)
    assert time.time() - began < 10


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["<p>", "</p>", "<div>", "</div>", "<a href=x>", "</a>", "<li>", "<ul>", "</ul>", "<td>", "<tr>", "<table>",
                                 "</table>", "<span class=ad>", "</span>", "<button>", "</button>", "x, y", " ", "<h2>", "</h3>", "<br>",
                                 "<nav>", "</nav>", "<article>", "</article>", "<!-- c -->", "<", ">", "&lt;", "</td>", "<svg/>"])))
def test_any_tag_soup_is_read(parts):
    html = "".join(parts)
    got = text_of(html)
    assert got == "\n".join(" ".join(line.split()) for line in got.split("\n"))
    assert got == "" or all(got.split("\n"))


def test_pages_with_nulls_repeats_and_clashing_columns(spark):
    rows = [(1, "u", "<p>a</p>", 3, "t"), (1, "u", "<p>a</p>", 3, "t"), (2, None, None, None, None), (None, "u", "", 1, "x"),
            (3, "u", "<article>" + f"<p>{T}" * 3000, 1, "x")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string, n_chars int, text string")
    got = sorted((r.page_id or 0, r.url, r.text, r.n_chars) for r in main_text.extract(pages).collect() if r.page_id != 2)
    assert got == [(0, "u", "", 0), (1, "u", "a", 1), (1, "u", "a", 1), (3, "u", "\n".join([S] * 3000), 3000 * len(S) + 2999)]
    assert [tuple(r) for r in main_text.extract(pages.where("page_id = 2")).collect()] == [(2, None, "", 0)]
    assert main_text.extract(pages.limit(0)).count() == 0
    assert main_text.extract(pages).columns == ["page_id", "url", "text", "n_chars"]


# -- runs -------------------------------------------------------------------

def plain_runs(w):
    n, out = len(w), set()
    for q in range(1, n // 3 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            if j > i and j + q - i >= max(24, 3 * q):
                if not any(q % d == 0 and all(w[k] == w[k + d] for k in range(i, j + q - d)) for d in range(1, q)):
                    out.add((i, j + q, q))
            i = max(j, i + 1)
    return [list(x) for x in sorted(out, key=lambda r: (r[0], r[2]))]


@pytest.mark.parametrize("seed", range(6))
def test_runs_of_random_texts(seed):
    rng = random.Random(seed)
    for _ in range(40):
        texts = []
        for _ in range(rng.randint(1, 6)):
            k, n = rng.choice([1, 2, 3, 5, 50]), rng.choice([0, 1, 5, 23, 24, 30, 100, 300])
            w = [b"%d" % rng.randrange(k) for _ in range(n)]
            for _ in range(rng.randint(0, 3)):
                if n:
                    a = rng.randrange(n)
                    p, size = rng.randint(1, max(1, (n - a) // 2)), rng.randint(0, n - a)
                    for i in range(a, a + size):
                        w[i] = w[a + (i - a) % p]
            texts.append(w)
        texts.append(list(texts[0]))
        assert list(runs.text_runs(texts)) == [plain_runs(w) for w in texts]


def test_runs_of_special_words():
    fib, nxt = [b"a"], [b"a", b"b"]
    while len(nxt) < 400:
        fib, nxt = nxt, nxt + fib
    thue = [b"%d" % (bin(i).count("1") % 2) for i in range(4096)]
    assert list(runs.text_runs([nxt])) == [plain_runs(nxt)]
    # Prefix hashes modulo 2 ** 64 would fail on this sequence.
    assert list(runs.text_runs([thue, thue[:2048] * 4])) == [[], [[0, 8192, 2048]]]
    assert list(runs.text_runs([[b"x"] * 100_000, [], [b"a", b"b"] * 12])) == [[[0, 100_000, 1]], [], [[0, 24, 2]]]


def test_grammar_places_spell_their_stretch():
    rng = np.random.default_rng(3)
    ids = np.concatenate([np.tile(rng.integers(0, 9, 60), 5), rng.integers(0, 9, 200)])
    texts = np.repeat([0, 1, 2], [200, 150, 150])
    g = runs.Grammar(ids, texts)
    at = 0
    places, times = np.concatenate(g.places), np.concatenate(g.times)
    for left, cut, right, k in zip(*(np.concatenate(x) for x in (g.left, g.cut, g.right)), times, strict=True):
        assert left < cut < right
        for p in places[at:at + k]:
            assert np.array_equal(ids[p:p + right - left], ids[left:right])
            assert texts[p] == texts[p + right - left - 1]
        at += k
    assert at == len(places)


def plain_row(doc_id, text, plant):
    w = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())
    n = len(w)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if plant and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    found = plain_runs(w)
    top = min(found, key=lambda r: (-(r[1] - r[0]) / r[2], r[0], r[2]), default=None)
    kept = [w[k] for k in range(n) if not any(i + q <= k < j for i, j, q in found)]
    sha = lambda b: hashlib.sha256(b).hexdigest()
    return (doc_id, len(found), *((top[0], top[1] - top[0], top[2], 1000 * (top[1] - top[0]) // top[2]) if top else (None,) * 4),
            sha("".join(f"{i},{j - i},{q}\n" for i, j, q in found).encode()), sha(b" ".join(kept)))


def test_query_against_brute_force(spark):
    rows = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()
    short = [r for r in rows if len((r.text or "").split()) <= 1500]  # the brute force is quadratic
    got = {r.doc_id: tuple(r) for r in queries.op13_repair_runs(spark, SMALL).collect()}
    assert len(got) == len(rows)
    assert len(short) > 100
    for r in short:
        assert got[r.doc_id] == plain_row(r.doc_id, r.text, True)
    assert sum(1 for r in got.values() if r[1]) > 10


def test_runs_of_awkward_rows(spark):
    line = "the same short line of the page "
    df = awkward(spark).union(docs(spark, [(20, line * 30, None, None), (20, line * 30, None, None), (21, "a" + "\x0b\x1c a" * 40, "en", "a")]))
    got = sorted(map(repr, (tuple(r) for r in runs.periodic_runs(df).collect())))
    assert got == sorted(repr(plain_row(r.doc_id, r.text, False)) for r in df.select("doc_id", "text").collect())
    assert runs.periodic_runs(empty(spark)).count() == 0
    many = docs(spark, [(i, line * 20, "en", "a") for i in range(300)])
    assert runs.periodic_runs(many.withColumn("text", F.col("text"))).select("runs_sha256").distinct().count() == 1
