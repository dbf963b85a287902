"""Operators 5 and 6 against plain simulations; native plans."""

import hashlib
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import pytest

from pyspark.sql import functions as F

from cardinal.llm import mixing, sharding
from cardinal.llm.queries import op5_pfair_mixing, op6_stratified_shards
from tests.llm.cases import awkward, docs, empty

SF = "/root/testdata/sf0.001"


def key(doc_id, text, seed=0):
    said = f"{seed}:{'' if doc_id is None else doc_id}:{text or ''}"
    return int(hashlib.md5(said.encode()).hexdigest()[:15], 16) << 3


def plain_shards(rows, shards):
    """doc_id, text -> multiset of (shard, slot) by two sorts."""
    by = defaultdict(list)
    for r in rows:
        by["" if r.source is None else "=" + r.source].append((key(r.doc_id, r.text), r.doc_id is None, r.doc_id or 0, r.text or ""))
    order = []
    for g, own in by.items():
        for k, (_, null, doc_id, text) in enumerate(sorted(own), 1):
            order.append((Fraction(2 * k - 1, 2 * len(own)), g, k, None if null else doc_id, text))
    order.sort(key=lambda x: x[:3])
    n, out = len(order), Counter()
    for p, (*_, doc_id, text) in enumerate(order):
        shard = ((p + 1) * shards - 1) // n
        out[doc_id, zlib.crc32(text.encode()), len(text.encode()) + 1, shard, p - -(-shard * n // shards)] += 1
    return out


@pytest.mark.parametrize("shards", [1, 3, 8, 40])
def test_shards_match_two_sorts(spark, shards):
    df = awkward(spark)
    got = Counter((r.doc_id, r.text_crc32, r.size, r.shard, r.slot) for r in sharding.stratified_shards(df, shards, bits=3).collect())
    assert got == plain_shards(df.collect(), shards)


def test_shards_of_many_small_sources(spark):
    # all fractions of one-row sources are equal: they are cut by source, not numbered in one window
    rows = [(i, f"t{i}", f"domain{i}" if i < 3000 else "hot") for i in range(4500)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    setting = "spark.sql.adaptive.coalescePartitions.enabled"  # small partitions stay as they are cut
    before = spark.conf.get(setting)
    spark.conf.set(setting, "false")
    try:
        out = sharding.stratified_shards(df, 8)
        held = out.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
    finally:
        spark.conf.set(setting, before)
    got = Counter((r.doc_id, r.text_crc32, r.size, r.shard, r.slot) for r in out.collect())
    assert got == plain_shards(df.collect(), 8)
    assert held < 3000  # the equal fractions are not one task's


def test_shards_query(spark):
    rows = op6_stratified_shards(spark, SF).collect()
    assert Counter((r.doc_id, r.text_crc32, r.size, r.shard, r.slot) for r in rows) == plain_shards(
        spark.read.parquet(f"{SF}/documents.parquet").collect(), 8)
    sizes = Counter(r.shard for r in rows)
    assert max(sizes.values()) - min(sizes.values()) <= 1 and {r.law for r in rows} == {"rows"}
    for s in {r.source for r in rows}:
        each = [sum(r.shard == k and r.source == s for r in rows) for k in range(8)]
        assert max(each) - min(each) <= 2
    assert sharding.stratified_shards(empty(spark)).count() == 0


def test_native_plans(spark):
    df = awkward(spark)
    for out in (sharding.stratified_shards(df), mixing.schedule(df), mixing.mix(df)):
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def simulate(counts, units, block_rows):
    """Slot of each (source, block) by earliest deadline first, over one long run."""
    total = sum(units.values())
    blocks = {g: -(-n // block_rows) for g, n in counts.items()}
    done, slots, t = dict.fromkeys(units, 0), {}, 0
    while any(done[g] < blocks[g] for g in units if units[g]):
        ready = [(-(-(done[g] + 1) * total // u), g) for g, u in sorted(units.items()) if u and done[g] * total // u <= t]
        if ready:
            g = min(ready)[1]
            done[g] += 1
            slots[g, done[g]] = t
        t += 1
    return slots


@pytest.mark.parametrize("weights,block_rows", [(None, 1), (None, 4), ({"a": 3, "b": 1, None: 1}, 2), ({"a": 1.0}, 2), ({"zz": 1}, 2)])
def test_schedule_matches_simulation(spark, weights, block_rows):
    df = docs(spark, [(i, f"t{i}", None, "a" if i % 3 else "b" if i % 2 else None) for i in range(90)])
    rows = mixing.schedule(df, weights=weights, units=20, block_rows=block_rows, bits=2).collect()
    assert len(rows) == 90
    sources = df.groupBy("source").count().collect()
    goal = mixing.target_units(df.selectExpr("coalesce(concat('=', source), '') as g").groupBy("g").count().withColumnRenamed(
        "count", "rows"), weights, mixing.TEMPERATURE, 20).collect()
    units = {r.g: r.u for r in goal}
    assert not any(units.values()) or sum(units.values()) == 20
    counts = {"" if r.source is None else "=" + r.source: r["count"] for r in sources}
    slots = simulate(counts, units, block_rows)
    by = defaultdict(list)
    for r in rows:
        g = "" if r.source is None else "=" + r.source
        assert r.slot == slots.get((g, r.block))
        by[g].append((key(r.doc_id, f"t{r.doc_id}"), r.block))
        if r.slot is not None:
            assert r.release <= r.slot < r.deadline
    for own in by.values():
        assert [b for _, b in sorted(own)] == [i // block_rows + 1 for i in range(len(own))]
    inside = sorted({r.slot for r in rows if r.in_mixture})
    assert inside == list(range(len(inside)))
    # After every number of slots each source is less than a block from its exact share.
    had = Counter()
    who = {s: g for (g, _), s in slots.items()}
    for t in inside:
        had[who[t]] += 1
        assert all(abs(had[g] - Fraction((t + 1) * u, 20)) < 1 for g, u in units.items())


def test_mixture_query_and_mix(spark):
    rows = op5_pfair_mixing(spark, SF).collect()
    df = spark.read.parquet(f"{SF}/documents.parquet")
    assert len(rows) == df.count()
    kept = mixing.mix(df)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.select("doc_id").collect()) == sorted(r.doc_id for r in rows)


def test_mixing_awkward(spark):
    df = awkward(spark)
    assert mixing.schedule(df).count() == df.count()
    assert mixing.mix(df).columns == df.columns
    assert mixing.schedule(empty(spark)).count() == 0 and mixing.mix(empty(spark)).count() == 0


def test_small_source_does_not_end_the_mixture(spark):
    big = [(i, f"t{i}", None, "hot" if i % 3 == 0 else f"s{i % 5}") for i in range(12_000)]
    tiny = [(12_000, "alone", None, None)]
    without, both = (mixing.mix(docs(spark, rows)).select("doc_id", "source").collect() for rows in (big, big + tiny))
    assert sorted(r.doc_id for r in without) == list(range(12_000))
    assert sorted(r.doc_id for r in both) == list(range(12_001))
    # In slot order, and in the target proportions for as long as every large source lasts.
    timed = {r.doc_id: r for r in mixing.schedule(docs(spark, big)).collect()}
    slots = [timed[r.doc_id].slot for r in without]
    assert slots == sorted(slots)
    goal = {s: len([1 for r in big if r[3] == s]) ** 0.7 for s in {r[3] for r in big}}
    head = Counter(r.source for r in both[:6_000])
    for s, w in goal.items():
        assert abs(head[s] / 6_000 - w / sum(goal.values())) < 0.01
    # A source of weight zero is left out; repeated rows keep their number.
    twice = docs(spark, [(1, "x", None, "a"), (1, "x", None, "a"), (2, "y", None, "b")])
    assert [r.doc_id for r in mixing.mix(twice, weights={"a": 1.0}).collect()] == [1, 1]
