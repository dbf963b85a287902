"""The pipeline's stages and its result, step by step against the operators' own outputs."""

from collections import Counter

import corpus_pipeline
from cardinal.llm import language, near_dup, packing, quality, queries
from cardinal.llm.common import fold
from tests.llm.cases import awkward

SMALL = "/root/testdata/sf0.001"


def test_stages_keep_columns_and_take_effect(spark, tmp_path):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    before = docs
    sizes = [docs.count()]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, before, SMALL)
        out.write.parquet(str(tmp_path / str(k)))
        out = spark.read.parquet(str(tmp_path / str(k)))
        if name != "pack":
            assert out.dtypes == docs.dtypes
            assert out.exceptAll(before).count() == 0
            sizes.append(out.count())
        if name == "near_dedup":
            firsts = {r.component_id for r in near_dup.near_duplicates(before, 5, 80).collect()}
            assert {r.doc_id for r in out.collect()} == firsts
        if name == "language_id":
            found = language.identify(before, language.fit(before, fold() != 0)).where("not rejected")
            assert Counter(r.doc_id for r in out.collect()) == Counter(r.doc_id for r in found.collect())
        if name == "quality":
            model = queries.quality_model(before, spark.read.parquet(f"{SMALL}/labels.parquet"))
            good = quality.score_texts(before, model).where("predicted = 1")
            assert Counter(r.doc_id for r in out.collect()) == Counter(r.doc_id for r in good.collect())
        if name == "mix_sources":
            assert Counter(r.doc_id for r in out.collect()) == Counter(r.doc_id for r in before.collect())
        last, before = before, out
    assert sizes[0] >= sizes[1] >= sizes[2] > sizes[3] == sizes[4]
    assert {r.doc_id for r in before.collect()} == {r.doc_id for r in last.collect()}
    whole = corpus_pipeline.run(spark, SMALL)
    key = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert whole.select(key).exceptAll(before.select(key)).count() == 0 and whole.count() == before.count()


def test_stages_take_awkward_rows(spark):
    docs = awkward(spark).select("doc_id", "text", "lang", "source", "n_chars")
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SMALL)
        assert out.count() <= docs.count() + 50
        assert stage(spark, docs.limit(0), SMALL).count() == 0


def test_packing_follows_the_order_of_the_rows(spark, tmp_path):
    rows = [(k, "word " * (900 + 7 * (k % 5))) for k in range(40)]
    key = ["doc_id", "piece", "start", "length", "ids_crc32"]
    for ids in (list(range(40)), list(range(39, -1, -1)), [k * 7 % 40 for k in range(40)]):
        docs = spark.createDataFrame([(*rows[k], "en", "web", len(rows[k][1])) for k in ids],
                                     "doc_id long, text string, lang string, source string, n_chars long").repartitionByRange(1, "lang")
        docs.write.parquet(str(tmp_path / f"{ids[0]}-{ids[1]}"))
        place = {d: k for k, d in enumerate(ids)}
        for given in (docs, spark.read.parquet(str(tmp_path / f"{ids[0]}-{ids[1]}"))):
            got = corpus_pipeline.pack_sequences(spark, given, SMALL)
            plain = packing.pack(given, queries.word_bpe())
            assert sorted(got.select(key).collect()) == sorted(plain.select(key).collect())
            found = got.collect()
            sequences = {}
            for r in found:
                sequences.setdefault(r.sequence_id, []).append(r)
            assert sorted(sequences) == list(range(plain.select("sequence_id").distinct().count()))
            firsts = [min(place[r.doc_id] for r in sequences[s]) for s in sorted(sequences)]
            assert firsts == sorted(firsts) and firsts[0] == 0
            for held in sequences.values():
                at = 0
                for r in sorted(held, key=lambda r: r.offset):
                    assert r.offset == at
                    at += r.length
                assert at <= 4096
            by_length = {}
            for r in sorted(found, key=lambda r: place[r.doc_id]):
                by_length.setdefault(r.length, []).append(r.sequence_id)
            assert all(len(set(s)) > 1 for s in by_length.values())
