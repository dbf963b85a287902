"""Operators 2, 3 and 9: plain re-computations, held-out quality, awkward tables."""

import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from cardinal.llm import elias_fano, language, ngram_lm, quality
from cardinal.llm.common import fold
from cardinal.llm.queries import op2_byte_convolution, op3_subword_softmax, op9_elias_fano_lm
from tests.llm.cases import awkward, docs, empty

SF, SMALL = "/root/testdata/sf0.01", "/root/testdata/sf0.001"


def remainder(i):
    return zlib.crc32(str(i).encode()) % 5


# -- quality ----------------------------------------------------------------

def plain_score(m, text):
    """The network by its definition: loops over halves, windows and filters."""
    raw = (text or "").encode()
    raw += bytes(-len(raw) % quality.HALF if raw else quality.HALF)
    n = len(raw)
    raw += bytes(quality.WIDTH)
    halves = []
    for at in range(0, n, quality.HALF):
        seen = [m.emb[list(raw[w:w + quality.WIDTH])].ravel() @ m.conv for w in range(at, at + quality.HALF, quality.STEP)]
        halves.append(np.maximum(np.max(seen, axis=0) + m.bias, 0))
    chunks = [np.maximum(a, b) for a, b in zip(halves, halves[1:], strict=False)] or halves
    z = np.concatenate((np.mean(chunks, axis=0), np.max(chunks, axis=0))) @ m.out + m.out_bias
    return 1 / (1 + math.exp(-z))


@pytest.fixture(scope="module")
def toy_quality():
    return quality.learn([(i % 2, ("good words here " if i % 2 else "#!#! junk ") * (3 + i % 9)) for i in range(60)])


def test_quality_matches_its_definition(toy_quality, monkeypatch):
    monkeypatch.setattr(quality, "SLICE_HALVES", 3)
    for text in (None, "", "a", "good words here " * 5, "#!#! junk " * 90, "é" * 700, "x" * 128, "y" * 129, "z" * 1000):
        assert toy_quality.score(text) == pytest.approx(plain_score(toy_quality, text), abs=1e-5)
    assert toy_quality.score("good words here " * 7) > 0.8 > 0.2 > toy_quality.score("#!#! junk " * 7)


def test_gradient_is_the_slope():
    rng = np.random.default_rng(1)
    p = {"emb": rng.normal(size=(256, quality.DIM)), "conv": rng.normal(size=(quality.WIDTH * quality.DIM, quality.FILTERS)),
         "bias": rng.normal(size=quality.FILTERS), "out": rng.normal(size=2 * quality.FILTERS) * 0.01, "out_bias": np.zeros(1)}
    grid = quality.byte_grid("some text to look at, " * 17)
    grad = {k: np.zeros(v.shape, np.float32) for k, v in p.items()}
    quality.backward(p, grad, grid, 1.0, 1)

    def loss():
        m = quality.QualityModel(p["emb"], p["conv"], p["bias"], p["out"], float(p["out_bias"][0]))
        return -math.log(m.score("some text to look at, " * 17))

    for k in p:
        at = np.unravel_index(np.abs(grad[k]).argmax(), grad[k].shape)
        keep, eps = p[k][at], 1e-5
        p[k][at] = keep + eps
        up = loss()
        p[k][at] = keep - eps
        down = loss()
        p[k][at] = keep
        assert (up - down) / (2 * eps) == pytest.approx(grad[k][at], rel=2e-2)


def test_quality_query(spark):
    rows = op2_byte_convolution(spark, SF).collect()
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert len(rows) == 1000
    assert all(r.held_out == (remainder(r.doc_id) == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    held = [(r.score, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    good, bad = [s for s, y in held if y == 1], [s for s, y in held if y == 0]
    assert np.mean([g > b for g in good for b in bad]) > 0.9
    assert np.mean([s >= 0.3 for s in good]) > 0.97


def test_quality_awkward(spark, toy_quality):
    df = awkward(spark)
    got = quality.score_texts(df, toy_quality)
    assert Counter((r.doc_id, round(r.score, 6)) for r in got.collect()) == Counter(
        (r.doc_id, round(toy_quality.score(r.text), 6)) for r in df.collect())
    kept = quality.keep_good(df, toy_quality, threshold=0.0)
    assert kept.columns == df.columns and kept.count() == df.count()
    assert quality.score_texts(empty(spark), toy_quality).count() == 0
    ones = df.select("doc_id", F.lit(1).alias("quality"))
    assert quality.fit(df, ones, F.lit(True)).score("anything") == 1.0
    assert quality.fit(df, ones.limit(0), F.lit(True)).score("anything") == 0.5
    assert quality.fit(empty(spark), ones, F.lit(True)).score("anything") == 0.5


def test_samples_stay_bounded_when_one_id_or_text_is_hot(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(quality, "learn", lambda sample, seed: seen.append(len(sample)))
    monkeypatch.setattr(language, "learn", lambda sample, *_: seen.append(len(sample)))
    df = docs(spark, [(7, "the same text", "en", "a")] * 400 + [(i, f"text number {i}", "en", "a") for i in range(100, 120)])
    quality.fit(df, df.select("doc_id", F.lit(1).alias("quality")), F.lit(True))
    language.fit(df, F.lit(True))
    assert seen == [21, 21]


# -- language ---------------------------------------------------------------

def plain_windows(text):
    raw = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 97 <= c <= 122 else 32 for c in f" {text.lower()} ".encode())
    while b"  " in raw:
        raw = raw.replace(b"  ", b" ")
    rows = Counter()
    for n in (2, 3, 4):
        for i in range(len(raw) - n + 1):
            code = (int.from_bytes(raw[i:i + n], "big") + n) * 0x9E3779B1 & 0xFFFFFFFF
            rows[code >> (32 - language.BITS)] += 1
    return rows


@pytest.mark.parametrize("slice_size", [5, 7, 1 << 20])
def test_windows_cover_the_text(monkeypatch, slice_size):
    monkeypatch.setattr(language, "SLICE", slice_size)
    for text in ("a", "The Ünder-ground  42 x", "abcdefghij" * 3, "  ", "é"):
        rows, counts = language.hashed_counts(text)
        assert dict(zip(rows.tolist(), counts.tolist(), strict=True)) == dict(plain_windows(text))


def test_language_query(spark):
    rows = {r.doc_id: r for r in op3_subword_softmax(spark, SF).collect()}
    source = spark.read.parquet(f"{SF}/documents.parquet").collect()
    assert len(rows) == len(source)
    held = [r for r in source if remainder(r.doc_id) == 0]
    assert all(rows[r.doc_id].held_out for r in held)
    assert np.mean([rows[r.doc_id].lang_pred == r.lang for r in held]) > 0.97
    assert np.mean([rows[r.doc_id].rejected for r in held]) < 0.02


def test_language_predicts_as_defined(spark):
    model = language.fit(spark.read.parquet(f"{SMALL}/documents.parquet"), fold() != 0)
    for text in ("The and of", "é" * 30, "und der die das " * 400):
        rows = plain_windows(text)
        z = sum(n * model.table[k].astype(float) for k, n in rows.items()) / sum(rows.values()) + model.bias
        p = np.exp(z / model.temperature) / np.exp(z / model.temperature).sum()
        name, score, _ = model.predict(text)
        assert name == model.names[int(p.argmax())] and score == pytest.approx(p.max(), abs=1e-5)
    got = {(r.doc_id, r.lang_pred, r.rejected) for r in language.identify(awkward(spark), model).collect()}
    assert {(4, "und", True), (5, "und", True), (6, "und", True), (13, "und", True)} <= got
    df = awkward(spark)
    kept = language.keep_identified(df, model)
    assert kept.columns == df.columns and not {4, 5, 6, 13} & {r.doc_id for r in kept.collect()}
    assert language.identify(empty(spark), model).count() == 0


def test_language_without_training_rows(spark):
    model = language.fit(empty(spark), F.lit(True))
    assert {(r.lang_pred, r.score) for r in language.identify(awkward(spark), model).collect()} == {("und", 0.0)}


# -- language model ---------------------------------------------------------

def test_elias_fano_round_trip():
    rng = np.random.default_rng(0)
    for n, top in ((0, 1), (1, 0), (1, 10**9), (1000, 50), (5000, 10**6), (70_000, 10**10)):
        v = np.sort(rng.integers(0, top + 1, n))
        assert (elias_fano.Sequence(elias_fano.encode(v)).access(np.arange(n)) == v).all()
        u = np.unique(v)
        x = np.concatenate((u, rng.integers(0, top + 2, 500)))
        at = elias_fano.Sequence(elias_fano.encode(u)).find(x, np.zeros(len(x), np.int64), np.full(len(x), len(u)))
        place = {int(y): i for i, y in enumerate(u)}
        assert at.tolist() == [place.get(int(y), -1) for y in x]


@pytest.mark.parametrize("spread", [1, 3, 90, 5000])
def test_elias_fano_neighbours_and_long_searches(spread):
    rng = np.random.default_rng(spread)
    v = np.cumsum(rng.integers(0, spread + 1, 50_001) * (rng.random(50_001) < 0.3))
    seq = elias_fano.Sequence(elias_fano.encode(v))
    at = rng.integers(0, 50_000, 70_000)
    one, two = seq.access_two(at)
    assert (one == v[at]).all() and (two == v[at + 1]).all()
    lists = np.unique(rng.integers(0, 2000 * 400, 60_000))
    node, value = lists // 400, lists % 400
    level = elias_fano.Level(elias_fano.encode_level(node, value, 2001))
    ask = rng.integers(0, 2000 * 400, 2 * elias_fano.RUN + 5)
    place, own = level.search(ask // 400, ask % 400)
    k = np.searchsorted(lists, ask)
    hit = (k < len(lists)) & (lists[np.minimum(k, len(lists) - 1)] == ask)
    assert (place == np.where(hit, k, -1)).all()
    assert (own[hit] == (k - np.searchsorted(node, ask // 400))[hit]).all()


def test_level_search():
    rng = np.random.default_rng(2)
    key = np.unique(rng.integers(0, 500, 3000) * 1000 + rng.integers(0, 300, 3000))
    node, value = key // 1000, key % 1000
    level = elias_fano.Level(elias_fano.encode_level(node, value, 510))
    assert (level.search(node, value)[0] == np.arange(len(key))).all()
    q, w = rng.integers(0, 510, 4000), rng.integers(0, 400, 4000)
    assert ((level.search(q, w)[0] >= 0) == np.isin(q * 1000 + w, key)).all()


def plain_model(rows, trained):
    tok = lambda s: [*(s or "").encode().lower().split(), None]
    u, b, t = Counter(), Counter(), Counter()
    for r in rows:
        if trained(r):
            w = tok(r.text)
            u.update(w)
            b.update(zip(w, w[1:], strict=False))
            t.update(zip(w, w[1:], w[2:], strict=False))
    n, v = sum(u.values()), len(u)
    p1 = lambda w: (u[w] + 0.5) / (n + 0.5 * (v + 1))
    p2 = lambda h, w: (b[h, w] + ngram_lm.K2 * p1(w)) / (u[h] + ngram_lm.K2)
    p3 = lambda g, h, w: (t[g, h, w] + ngram_lm.K3 * p2(h, w)) / (b[g, h] + ngram_lm.K3)
    for r in rows:
        w = tok(r.text)
        base = sum(math.log10(p1(x)) for x in w)
        full = sum(math.log10(p1(x) if i == 0 else p2(w[0], x) if i == 1 else p3(w[i - 2], w[i - 1], x)) for i, x in enumerate(w))
        yield r.doc_id, len(w), sum(u[x] > 0 for x in w), n, base, full


@pytest.mark.parametrize("shard_tokens,stretch", [(2_000_000, 1 << 21), (3000, 4000)])
def test_lm_query_matches_plain_model(spark, monkeypatch, shard_tokens, stretch):
    monkeypatch.setattr(ngram_lm, "SHARD_TOKENS", shard_tokens)
    monkeypatch.setattr(ngram_lm, "STRETCH", stretch)
    monkeypatch.setattr(ngram_lm, "SCORE_STRETCH", stretch)
    rows = spark.read.parquet(f"{SMALL}/documents.parquet").collect()
    got = {r.doc_id: r for r in op9_elias_fano_lm(spark, SMALL).collect()}
    base = full = 0.0
    for doc_id, n, known, total, b, s in plain_model(rows, lambda r: remainder(r.doc_id) != 1):
        g = got[doc_id]
        assert (g.n_tokens, g.n_known, g.train_tokens, g.held_out) == (n, known, total, remainder(doc_id) == 1)
        assert g.base_score == pytest.approx(b, rel=1e-9) and abs(g.score - s) < 0.02 * n
        if g.held_out:
            base, full = base + g.base_score, full + g.score
    assert full > 0.9 * base  # log10 probabilities: the trie beats the unigram base on held-out texts


def test_lm_awkward(spark):
    df = awkward(spark)
    got = Counter((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in
                  ngram_lm.train_and_score(df, F.col("doc_id") != 2).collect())
    assert got == Counter((i, n, k, t, round(b, 6)) for i, n, k, t, b, _ in plain_model(df.collect(), lambda r: r.doc_id != 2))
    none = ngram_lm.train_and_score(df, F.lit(False)).collect()
    assert {(r.n_known, r.train_tokens, r.base_score, r.score) for r in none} == {(0, 0, 0.0, 0.0)}
    assert ngram_lm.train_and_score(empty(spark), F.lit(True)).count() == 0


def test_lm_hot_pair_and_one_giant_text(spark, monkeypatch):
    monkeypatch.setattr(ngram_lm, "SHARD_TOKENS", 500)
    monkeypatch.setattr(ngram_lm, "STRETCH", 700)
    monkeypatch.setattr(ngram_lm, "SCORE_STRETCH", 300)
    df = docs(spark, [(i, "of the w%d " % (i % 50) * 9, None, None) for i in range(200)] + [(900, "of the end " * 1500, None, None)])
    for (doc_id, n, k, _, b, s), r in zip(sorted(plain_model(df.collect(), lambda r: True)),
                                          sorted(ngram_lm.train_and_score(df, F.lit(True)).collect()), strict=True):
        assert (doc_id, n, k) == (r.doc_id, r.n_tokens, r.n_known)
        assert r.base_score == pytest.approx(b) and abs(r.score - s) < 0.02 * n


def test_many_languages_are_learned(spark):
    rows = [(i, " ".join(f"w{i % 300}x{k}" for k in range(12)), f"l{i % 300}", "a") for i in range(900)]
    df = docs(spark, rows)
    assert len(language.fit(df, F.lit(True)).names) == 300
