"""Operators 1, 4 and 8 against brute force; awkward tables; hot groups."""

import math
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from cardinal.llm import grid_join, hard_negatives, impact_search, near_dup, queries, shingles
from cardinal.llm.common import components
from tests.llm.cases import WORDS, awkward, docs, empty, prose
from tests.oracle import compare, duck

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_queries_match_their_sql(spark, name):
    assert compare(spark, duck(SMALL), name, queries.QUERIES[name], queries.ORACLES[name], SMALL)["exact"]


def reach(nodes, edges):
    """Smallest node reachable from each."""
    near = defaultdict(set)
    for a, b in edges:
        near[a].add(b)
        near[b].add(a)
    out = {}
    for n in sorted(nodes):
        if n not in out:
            todo = [n]
            while todo:
                x = todo.pop()
                if x not in out:
                    out[x] = n
                    todo += near[x]
    return out


@pytest.mark.parametrize("seed", range(4))
def test_components(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randint(0, 60), rng.randint(0, 60)) for _ in range(45)] + [(i, i + 1) for i in range(100, 140)] + [(200, i) for i in range(201, 230)]
    df = spark.createDataFrame([(b, a) if rng.random() < 0.5 else (a, b) for a, b in edges], "a bigint, b bigint")
    want = reach({x for e in edges if e[0] != e[1] for x in e}, edges)
    assert {r.node: r.component for r in components(df).collect()} == want
    assert components(df.limit(0)).count() == 0


# -- texts ------------------------------------------------------------------

def word_set(text, words):
    w = (text or "").encode().lower().split()
    return {tuple(w[i:i + words]) for i in range(max(1, len(w) - words + 1))} if w else set()


def plain_dups(rows, words, percent):
    """(id, n_shingles, component) of rows with ids, by comparing all of them."""
    sets = [(r.doc_id, word_set(r.text, words)) for r in rows if r.doc_id is not None]
    edges = [(i, j) for k, (i, s) in enumerate(sets) for j, t in sets[k + 1:] if s & t and 100 * len(s & t) >= percent * len(s | t)]
    comp = reach({i for i, _ in sets}, edges)
    return sorted((i, len(s), comp[i]) for i, s in sets)


def found(df, words=4, percent=80):
    rows = near_dup.near_duplicates(df, words, percent).collect()
    assert all(r.kept == (r.doc_id is not None and r.doc_id == r.component_id) for r in rows)
    return sorted((r.doc_id, r.n_shingles, r.component_id) for r in rows if r.doc_id is not None)


def test_shingles_are_the_distinct_word_runs():
    texts = ["", " ", "a", "A b c", "a B  c\nd", "a b c d e", "a\x0bb\x0cc\rd", "é É ß x", prose(5000), "a b " * 50]
    for words in (1, 4, 5):
        assert [len(s) for s in shingles.shingle_sets([t.encode() for t in texts], words)] == [len(word_set(t, words)) for t in texts]
    x, y, z = shingles.shingle_sets([b"X a B c q r", b"y", b"x A b  c Q r"], 4)
    assert (x == z).all() and len(y) == 1


def test_signature_keeps_minimum_and_maximum():
    rng = np.random.default_rng(0)
    h = rng.integers(0, 1 << 63, 50, dtype=np.uint64)
    sig = near_dup.signatures(h, np.array([20, 0, 30]))
    for row, part in zip(sig, (h[:20], h[20:]), strict=True):
        for k in range(near_dup.PERMUTATIONS):
            v = part * near_dup._MULT[k] + near_dup._ADD[k]
            assert row[2 * k] == v.min() and row[2 * k + 1] == v.max()


def test_awkward_texts(spark):
    df = awkward(spark)
    assert found(df) == plain_dups(df.collect(), 4, 80)
    kept = near_dup.keep_one(df, words=4)
    assert kept.columns == df.columns
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == sorted({c for _, _, c in plain_dups(df.collect(), 4, 80)})
    assert ids.count(None) == 2
    assert near_dup.near_duplicates(empty(spark)).count() == 0 and near_dup.keep_one(empty(spark)).count() == 0


def test_repeated_ids_go_by_their_own_text(spark):
    a, b = prose(120), prose(120, 3, 7)
    assert not word_set(a, 5) & word_set(b, 5)

    def stay(*rows):
        return sorted((r.doc_id, r.text) for r in near_dup.keep_one(docs(spark, [(i, t, "en", "s") for i, t in rows])).collect())

    assert stay((1, a), (5, a), (5, b)) == [(1, a), (5, b)]
    assert stay((5, a), (5, b)) == sorted([(5, a), (5, b)])
    assert stay((5, a), (5, a), (5, a.upper()), (6, b)) in ([(5, a), (6, b)], [(5, a.upper()), (6, b)])
    assert len(stay((5, a), (5, a + " one more"))) == 1


def edited(rng, words, changes):
    words = list(words)
    for _ in range(changes):
        words[rng.randrange(len(words))] = rng.choice(WORDS) + str(rng.randint(100, 999))
    return " ".join(words)


def test_families_around_a_middle_text(spark):
    """Variants that are like their original, yet unlike each other, in any order of ids."""
    rng = random.Random(7)
    rows, n = [], 0
    for _ in range(6):
        base = [rng.choice(WORDS) + str(rng.randint(0, 99)) for _ in range(160)]
        ids = list(range(n, n + 15))
        rng.shuffle(ids)
        n += 15
        rows += [(i, " ".join(base) if k == 0 else edited(rng, base, 3), "en", "s") for k, i in enumerate(ids)]
    df = docs(spark, rows)
    assert found(df) == plain_dups(df.collect(), 4, 80)


def test_chains_and_hot_copies(spark):
    rng = random.Random(9)
    rows, text = [], [rng.choice(WORDS) + str(rng.randint(0, 99)) for _ in range(150)]
    for i in range(25):  # each like the next, the ends unlike
        rows.append((1000 + i, " ".join(text), "en", "s"))
        text = edited(rng, text, 3).split()
    hot = prose(90)
    rows += [(i, hot, "en", "s") for i in range(400)]
    rows += [(400 + i, f"{hot} {i}", "en", "s") for i in range(60)]
    df = docs(spark, rows)
    assert found(df) == plain_dups(df.collect(), 4, 80)


@pytest.mark.parametrize("texts,columns", [(3, 50), (128, 50_000)])
def test_blocks_lose_nothing(spark, monkeypatch, texts, columns):
    monkeypatch.setattr(near_dup, "BLOCK_TEXTS", texts)
    monkeypatch.setattr(near_dup, "COLUMNS", columns)
    rng = random.Random(3)
    base = [rng.choice(WORDS) + str(rng.randint(0, 99)) for _ in range(160)]
    df = docs(spark, [(i, edited(rng, base, 1 + i % 5), "en", "s") for i in range(40)])
    assert found(df) == plain_dups(df.collect(), 4, 80)


def test_block_links_connect_what_is_near():
    rng = np.random.default_rng(1)
    pool = np.unique(rng.integers(0, 1 << 60, 400, dtype=np.uint64))
    sets = [np.sort(rng.choice(pool, int(rng.integers(60, 90)), replace=False)) if i % 3 else np.sort(pool[i:i + 80]) for i in range(40)]
    near = [(i, j) for i in range(40) for j in range(40) if i < j
            and 100 * (n := len(np.intersect1d(sets[i], sets[j]))) >= 80 * (len(sets[i]) + len(sets[j]) - n) and n]
    ids = list(range(40))
    got = [*near_dup.block_links(ids[:25], ids[:25], sets[:25], ids[25:], ids[25:], sets[25:], 80)]
    for part in (slice(0, 25), slice(25, 40)):
        got += near_dup.block_links(ids[part], ids[part], sets[part], ids[part], ids[part], sets[part], 80)
    assert near and reach(ids, got) == reach(ids, near)


# -- vectors ----------------------------------------------------------------

VECTORS = "vec_id bigint, embedding array<float>, label int, id int, v string, score double, block int"


def vectors(spark, rows):
    return spark.createDataFrame([(i, e, lab, 1, "x", 0.1, 2) for i, e, lab in rows], VECTORS)


def awkward_vectors(spark, n=60, width=6):
    rng = np.random.default_rng(4)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(size=width)], i % 2) for i in range(n)]
    one = rows[5][1]
    rows += [(100 + i, one, 1) for i in range(5)] + [(120, [2 * x for x in one], 1), (121, one, None), (122, None, 1), (123, [], 1)]
    rows += [(124, [0.0] * width, 1), (125, [math.nan, *one[1:]], 1), (126, [None, *one[1:]], 1), (127, [math.inf, *one[1:]], 1)]
    rows += [(128, one[:3], 1), (129, one[:3], 1), (None, one, 1), (140, one, 1), (140, one, 1), (160, rows[8][1], 0), (-20, rows[9][1], 1)]
    return vectors(spark, rows)


def usable(e):
    return bool(e) and all(x is not None and math.isfinite(x) for x in e)


def plain_top(rows, k, scale):
    own = {r.vec_id: [math.floor(scale * x) for x in r.embedding] for r in rows if r.vec_id is not None and usable(r.embedding)}
    all_rows = [(r.vec_id, own[r.vec_id]) for r in rows if r.vec_id in own and usable(r.embedding)]
    out = []
    for q in sorted(i for i in own if i % 20 == 0):
        got = [(-sum(a * b for a, b in zip(own[q], e, strict=True)), i) for i, e in all_rows if i != q and len(e) == len(own[q])]
        out += [(q, rank, i, -s) for rank, (s, i) in enumerate(sorted(got)[:k], 1)]
    return out


@pytest.mark.parametrize("block,k,scale", [(4096, 20, 64.0), (7, 3, 64.0), (16, 20, 1.0), (16, 200, 1e4)])
def test_top_k_awkward(spark, monkeypatch, block, k, scale):
    monkeypatch.setattr(impact_search, "BLOCK_ROWS", block)
    df = awkward_vectors(spark)
    got = impact_search.top_k(df, F.col("vec_id") % 20 == 0, k, scale).collect()
    assert sorted((r.query_id, r.rank, r.vec_id, r.score) for r in got) == plain_top(df.collect(), k, scale)
    assert impact_search.top_k(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_top_k_carries_bars_between_strips(spark, monkeypatch):
    monkeypatch.setattr(impact_search, "BLOCK_ROWS", 32)
    monkeypatch.setattr(impact_search, "STRIP_BLOCKS", 2)
    rng = np.random.default_rng(21)
    rows = rng.normal(size=(900, 12)).round(2)
    rows[::3] = rows[0]  # a third are copies
    df = vectors(spark, [(i, [float(x) for x in r], 1) for i, r in enumerate(rows)])
    got = impact_search.top_k(df, F.col("vec_id") % 20 == 0, 20, 64.0).collect()
    stored = np.array([r.embedding for r in df.orderBy("vec_id").collect()])  # as the column holds them
    ints = np.floor(64 * stored).astype(np.int64)
    want = set()
    for q in range(0, 900, 20):
        scores = ints @ ints[q]
        order = [i for i in np.lexsort((np.arange(900), -scores)) if i != q][:20]
        want |= {(q, rank, i, int(scores[i])) for rank, i in enumerate(order, 1)}
    assert {tuple(r) for r in got} == want and len(got) == len(want)


def test_impact_index_rescores_possible_members_only():
    rng = np.random.default_rng(5)
    rows = np.floor(64 * rng.normal(size=(4096, 64)) / 8).astype(np.int64)
    index = impact_search.ImpactIndex(np.arange(4096), rows)
    for i in range(0, 400, 20):
        free = index.top(rows[i], i, 20)
        bar = int(free[1][9])
        held = index.top(rows[i], i, 20, bar)
        assert [list(x) for x in held] == [list(x[: len(held[0])]) for x in free] and len(held[0]) >= 10
        assert len(index.top(rows[i], i, 20, int(free[1][0]) + 1)[0]) == 0
    assert index.rescored < 0.05 * 60 * 4096


def test_impact_lists_are_passed_over_once_for_a_group():
    rng = np.random.default_rng(13)
    rows = np.floor(64 * rng.normal(size=(2 * 2048, 64)) / 8).astype(np.int64)
    rows[7], ids = rows[40], np.arange(len(rows))
    queries, own = rows[:300:3], ids[:300:3]
    floors, levels = np.full(len(own), impact_search.NO_BAR), np.zeros(len(own), np.int64)
    passed = []
    for part in (slice(0, 2048), slice(2048, None)):
        index = impact_search.ImpactIndex(ids[part], rows[part])
        got = index.top_many(queries, own, 20, floors, levels)
        passed.append(index.passed)
        assert index.postings <= rows[part].size * len(own) and index.rescored < 0.05 * 2048 * len(own)
        for q, i, (found, score) in zip(queries, own, got, strict=True):
            s = rows[part] @ q
            order = [j for j in np.lexsort((ids[part], -s)) if ids[part][j] != i][:20]
            assert found.tolist() == ids[part][order].tolist() and score.tolist() == s[order].tolist()
        high = np.array([g[1][4] for g in got])
        held = index.top_many(queries, own, 20, high, levels.copy())
        assert all(len(h[0]) >= 5 and h[0].tolist() == g[0][: len(h[0])].tolist() for h, g in zip(held, got, strict=True))
    # A hundred queries pass over the lists a few times, not once each; the second block knows where to begin.
    assert passed[0] < 4 * 2048 * 64 and passed[1] < 3 * 2048 * 64


@pytest.mark.parametrize("start", [0, 1, 50, 1 << 40])
def test_impact_groups_of_unlike_queries(start):
    rng = np.random.default_rng(14)
    for top in (3, 5_000, 1 << 20, 1 << 28):  # accumulators in float32, doubles, and integers
        rows = rng.integers(-9, 10, (400, 12))
        rows[5, 2], rows[6, 2], rows[50:90] = top, -top, rows[50]
        rows[100], ids = 0, rng.permutation(400) * 3
        ids[10] = ids[11]
        asked = np.array([5, 6, 10, 50, 100, *range(150, 310)])
        index = impact_search.ImpactIndex(ids, rows)
        got = index.top_many(rows[asked], ids[asked], 7, np.full(len(asked), impact_search.NO_BAR), np.full(len(asked), start))
        for i, (found, score) in zip(asked, got, strict=True):
            s = rows @ rows[i]
            order = [j for j in np.lexsort((ids, -s)) if ids[j] != ids[i]][:7]
            assert found.tolist() == ids[order].tolist() and score.tolist() == s[order].tolist()


def test_impact_index_takes_large_scores():
    rng = np.random.default_rng(8)
    for top in (6_400_000, 1 << 28):  # scores of 4e13 and more, beyond one accumulator in doubles
        rows = rng.integers(-40, 41, (300, 64))
        rows[7, 3], rows[8, 3], rows[9, 3] = top, top - 1, -top
        index = impact_search.ImpactIndex(np.arange(300), rows)
        for own in (7, 9, 20):
            score = [sum(a * b for a, b in zip(rows[own].tolist(), r, strict=True)) for r in rows.tolist()]
            best = sorted((-s, i) for i, s in enumerate(score) if i != own)[:5]
            ids, got = index.top(rows[own], own, 5)
            assert list(zip(ids.tolist(), got.tolist(), strict=True)) == [(i, -s) for s, i in best]


def test_impact_index_is_exact_for_any_data():
    rng = np.random.default_rng(6)
    for n, width, spread in ((1, 3, 5), (50, 1, 3), (700, 16, 40), (900, 64, 8), (300, 8, 0)):
        rows = rng.integers(-spread, spread + 1, (n, width))
        ids = rng.permutation(n) * 3
        index = impact_search.ImpactIndex(ids, rows)
        for i in range(0, n, max(1, n // 9)):
            s = rows @ rows[i]
            order = [j for j in np.lexsort((ids, -s)) if j != i][:20]
            got_ids, got = index.top(rows[i], ids[i], 20)
            assert got_ids.tolist() == ids[order].tolist() and got.tolist() == s[order].tolist()


def plain_links(rows, threshold):
    ok = [(k, r) for k, r in enumerate(rows) if r.label is not None and usable(r.embedding) and any(r.embedding)]
    links, edges = defaultdict(int), []
    for x, (j, p) in enumerate(ok):
        for k, q in ok[x + 1:]:
            if p.label == q.label and len(p.embedding) == len(q.embedding):
                a, b = np.array(p.embedding, float), np.array(q.embedding, float)
                if a @ b / (np.linalg.norm(a) * np.linalg.norm(b)) >= threshold:
                    links[j] += 1
                    links[k] += 1
                    edges.append((j, k))
    group = reach(range(len(rows)), edges)
    low = defaultdict(list)
    for j, g in group.items():
        if rows[j].vec_id is not None:
            low[g].append(rows[j].vec_id)
    return sorted((r.vec_id, links[j], min(low[group[j]], default=None)) for j, r in enumerate(rows) if r.vec_id is not None)


@pytest.mark.parametrize("block,leaf,threshold", [(1024, 256, 0.93), (8, 3, 0.6), (5, 2, 0.93), (16, 4, 0.2)])
def test_vector_links_awkward(spark, monkeypatch, block, leaf, threshold):
    monkeypatch.setattr(grid_join, "BLOCK_ROWS", block)
    monkeypatch.setattr(grid_join, "LEAF_ROWS", leaf)
    df = awkward_vectors(spark)
    got = grid_join.link_vectors(df, threshold).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in got if r.vec_id is not None) == plain_links(df.collect(), threshold)
    assert len(got) == df.count()
    assert grid_join.link_vectors(df.limit(0), threshold).count() == 0


def test_one_hot_vector_and_one_label(spark):
    one = [1.0, 0.5, 0.25]
    df = vectors(spark, [(i, one, 3) for i in range(500)] + [(500 + i, [1.0, 0.5, 0.25 + i / 1000], 3) for i in range(100)])
    rows = grid_join.link_vectors(df, 0.93).collect()
    assert {(r.n_links, r.component_id) for r in rows} == {(599, 0)}


def test_search_queries_many_copies(spark):
    df = vectors(spark, [(i, [0.5, -0.25, 1.0], 1) for i in range(300)])
    rows = impact_search.top_k(df, F.col("vec_id") % 20 == 0).collect()
    assert len(rows) == 15 * 20
    assert all(r.vec_id == (r.rank - 1 if r.rank <= r.query_id else r.rank) for r in rows)


# -- hard negatives ---------------------------------------------------------

def plain_negatives(rows, is_anchor, k=5, m=10, scale=256.0, window=(30, 90)):
    ok = [(i, y, [math.floor(scale * x) for x in v]) for i, y, v in rows
          if i is not None and y is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    score = lambda u, v: sum(a * b for a, b in zip(u, v, strict=True))
    out = []
    for a in sorted({i for i, _, _ in ok if is_anchor(i)}):
        _, y, v = max((r for r in ok if r[0] == a), key=lambda r: (r[1], [*r[2]]))
        others = sorted((-score(v, w), j, z) for j, z, w in ok if j != a and len(w) == len(v))
        for s, p, _ in [r for r in others if r[2] == y][:k]:
            inside = [r for r in others if r[2] != y and window[0] * -s <= 100 * -r[0] <= window[1] * -s][:m]
            out += [(a, p, rank, j, -s, -t) for rank, (t, j, _) in enumerate(inside, 1)]
    return sorted(out)


def mined(df, **kw):
    return sorted(tuple(r) for r in hard_negatives.mine(df, F.col("vec_id") % 10 == 0, **kw).collect())


MINED_VECTORS = "vec_id bigint, embedding array<double>, label int, score string, width int, n int"


def test_hard_negatives_of_awkward_rows(spark):
    rng = random.Random(2)
    rows = [(i, [rng.choice([-1.0, 0.0, 0.25, 0.5, 1.0]) for _ in range(6)], rng.randrange(3)) for i in range(120)]
    rows += [(i, [1.0] * 6, 1) for i in range(120, 150)]  # ties
    rows += [(200, None, 1), (210, [], 1), (220, [None] * 6, 1), (230, [float("nan")] * 6, 1), (240, [math.inf] * 6, 0), (250, [1.0] * 6, None),
             (None, [1.0] * 6, 1), (260, [0.5] * 3, 1), (261, [0.5] * 3, 1), (262, [0.25] * 3, 2), (270, [0.0] * 6, 2), (10, [0.5] * 6, 2), (11, [0.5] * 6, 2)]
    df = spark.createDataFrame([(*r, "s", 1, 2) for r in rows], MINED_VECTORS)
    want = plain_negatives([(i, y, v) for i, v, y in rows], lambda i: i % 10 == 0)
    assert want
    assert mined(df) == want
    assert mined(df.limit(0)) == []
    assert mined(df.where("vec_id % 10 <> 0")) == []


def test_hard_negatives_over_many_partitions(spark, monkeypatch):
    """The cells of the grid meet also where Spark does not merge all shuffle partitions into one."""
    for name, value in (("PACK_ROWS", 8), ("GROUP_ANCHORS", 4), ("STRIP_ROWS", 30)):
        monkeypatch.setattr(hard_negatives, name, value)
    rng = random.Random(3)
    rows = [(i, [rng.uniform(-1, 1) for _ in range(8)], rng.randrange(3)) for i in range(200)]
    df = spark.createDataFrame([(*r, "s", 1, 2) for r in rows], MINED_VECTORS)
    want = plain_negatives([(i, y, v) for i, v, y in rows], lambda i: i % 10 == 0)
    assert len({r[0] for r in want}) == 20
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        assert mined(df) == want
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_hard_negatives_with_large_scores(spark, monkeypatch):
    """Scores up to the end of the longs are exact; beyond, the query raises; many packs, strips and groups."""
    rng = random.Random(4)
    rows = [(i, [rng.uniform(-1, 1) * 2.0 ** rng.choice([3, 10, 20]) for _ in range(70)], i % 4) for i in range(300)]
    df = spark.createDataFrame([(*r, "s", 1, 2) for r in rows], MINED_VECTORS).repartition(7)
    for name, value in (("PACK_ROWS", 16), ("GROUP_ANCHORS", 8), ("STRIP_ROWS", 40)):
        monkeypatch.setattr(hard_negatives, name, value)
    want = plain_negatives([(i, y, v) for i, v, y in rows], lambda i: i % 10 == 0, window=(-50, 95), k=3)
    assert max(r[4] for r in want) > 1 << 53
    assert mined(df, window=(-50, 95), k_positive=3) == want
    huge = spark.createDataFrame([(10, [1e18] * 4, 1, "s", 1, 2), (11, [1e18] * 4, 1, "s", 1, 2)], MINED_VECTORS)
    with pytest.raises(Exception, match="do not fit"):
        mined(huge)


def test_residues_give_exact_products():
    rng = np.random.default_rng(6)
    for width in (1, 64, 65, 300):
        for size in (3, 1 << 10, 1 << 24):
            a, b = (rng.integers(-size, size + 1, (9, width)) for _ in range(2))
            bound = float(width * size * size)
            got = hard_negatives.exact_scores(hard_negatives.Residues(a.astype(float)), hard_negatives.Residues(b.astype(float)), bound)
            assert np.array_equal(got, a @ b.T)
    top = (1 << 31) - 1
    for sign in (1, -1):
        a, b = np.array([[top, 3.0]]), np.array([[sign * 4294967296.0, sign * 1.0]])
        got = hard_negatives.exact_scores(hard_negatives.Residues(a), hard_negatives.Residues(b), 2.0**63 - 1024)
        assert got[0, 0] == sign * (top * 4294967296 + 3)


def test_search_refuses_components_that_would_wrap(spark):
    df = spark.createDataFrame([(20, [1.0, 0.5]), (21, [1e18, 0.5])], "vec_id bigint, embedding array<float>")
    with pytest.raises(Exception, match="do not fit"):
        impact_search.top_k(df, F.col("vec_id") == 20).collect()


def test_links_of_tiny_and_huge_vectors(spark):
    rows = [(1, [1e-200, 1e-200], 0), (2, [3e-200, 3e-200], 0), (3, [2.0, 2.0], 0), (4, [1e200, 1e200], 0), (5, [1e-200, -1e-200], 0)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int")
    got = {r.vec_id: (r.n_links, r.component_id) for r in grid_join.link_vectors(df, threshold=0.93).collect()}
    assert got == {1: (3, 1), 2: (3, 1), 3: (3, 1), 4: (3, 1), 5: (0, 5)}
