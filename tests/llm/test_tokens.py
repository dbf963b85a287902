"""Operators 7 and 10 against the tokenizer library."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from cardinal.llm import bpe_counts, packing
from cardinal.llm.queries import op7_best_fit_packing, op10_token_counts, word_bpe
from tests.llm.cases import awkward, docs, empty

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(word_bpe())


def ids(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


def test_words_match_the_library(library):
    rng = random.Random(3)
    cache, enc = bpe_counts.counter(word_bpe()), packing.encoder(word_bpe())
    pool = [*" 'sStTrRabcxyzΣσéÉß<|>,.!0123\n\t\x85　H̱", "<|endoftext|>", "<|ENDOFTEXT|>", "'ll", "中文", "İ"]
    for _ in range(3000):
        text = "".join(rng.choice(pool) for _ in range(rng.randint(0, 16)))
        want = ids(library, text)
        assert bpe_counts.count_text(text, cache)[1] == len(want), repr(text)
        assert packing.token_bytes(text, enc) == np.array(want, "<u4").tobytes(), repr(text)
        enc.clear()
        enc.old = {}  # nothing known: the words of a text are learned together
        assert list(packing.texts_bytes([text, None, text], word_bpe())) == [np.array(want, "<u4").tobytes(), b"", np.array(want, "<u4").tobytes()], repr(text)


def test_cache_generations_stay_bounded():
    cache = bpe_counts.Generations(len, 10, 5)
    for i in range(1000):
        assert cache[b"%d" % i] == len(str(i))
    assert len(cache) <= 10 and len(cache.old) <= 10
    assert cache[b"longer than five"] == 16 and b"longer than five" not in cache


def test_many_words_stay_known():
    enc = packing.encoder(word_bpe())
    enc.clear()
    enc.old = {}
    calls, compute = [], enc.compute
    enc.compute = lambda chunk: calls.append(chunk) or compute(chunk)
    try:
        for k in range(750_000):
            enc.put(b"w%d" % k, b"")
        assert packing.token_bytes("w0 W1 w749999", enc) == b"" and not calls
    finally:
        enc.compute = compute
        enc.clear()
        enc.old = {}


def test_counts_query_matches_the_library(spark, library):
    for df, got in ((spark.read.parquet(f"{SF}/documents.parquet"), op10_token_counts(spark, SF)),
                    (awkward(spark), bpe_counts.token_counts(awkward(spark), word_bpe()))):
        want = Counter((r.doc_id, len((r.text or "").encode()), len(ids(library, r.text))) for r in df.collect())
        rows = got.collect()
        assert Counter((r.doc_id, r.n_bytes, r.n_tokens) for r in rows) == want
        assert all(r.over_limit == (r.n_tokens > 2048) for r in rows)
    assert bpe_counts.token_counts(empty(spark), word_bpe()).count() == 0


def check_packing(rows, source, library, capacity):
    want = Counter()
    for r in source:
        all_ids = np.array([*ids(library, r.text), 1], "<u4")
        for k, at in enumerate(range(0, len(all_ids), capacity)):
            part = all_ids[at:at + capacity]
            want[r.doc_id, k, at, len(part), zlib.crc32(part.tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    by = defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by), -(-sum(r.length for r in rows) // capacity)


def test_packing_query(spark, library):
    source = spark.read.parquet(f"{SF}/documents.parquet").collect()
    used, bound = check_packing(op7_best_fit_packing(spark, SF).collect(), source, library, 4096)
    assert used <= bound + 1


def test_packing_awkward(spark, library):
    used, bound = check_packing(packing.pack(awkward(spark), word_bpe(), capacity=512).collect(), awkward(spark).collect(), library, 512)
    assert used <= bound + 1
    assert packing.pack(empty(spark), word_bpe()).count() == 0


def test_one_hot_length(spark, library):
    df = docs(spark, [(i, "same words again", None, None) for i in range(300)])
    used, bound = check_packing(packing.pack(df, word_bpe(), capacity=9).collect(), df.collect(), library, 9)
    assert used == 150  # two pieces of four tokens each


def exhaustive(lengths, capacity):
    """Fewest bins by trying every placement."""
    best = len(lengths)

    def go(i, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if i == len(lengths):
            best = len(bins)
            return
        for k in range(len(bins)):
            if bins[k] + lengths[i] <= capacity:
                go(i + 1, [*bins[:k], bins[k] + lengths[i], *bins[k + 1:]])
        go(i + 1, [*bins, lengths[i]])

    go(0, [])
    return best


def test_bin_completion_finds_fewest_bins():
    rng = random.Random(5)
    for _ in range(60):
        lengths = sorted((rng.randint(1, 20) for _ in range(rng.randint(0, 9))), reverse=True)
        plan = packing.complete_bins(dict(Counter(lengths)), 20)
        assert Counter({x: n for x, n in Counter(lengths).items()}) == sum(
            (Counter({x: k * many for x, k in f}) for many, f in plan), Counter())
        assert all(sum(x * k for x, k in f) <= 20 for _, f in plan)
        assert sum(many for many, _ in plan) == exhaustive(lengths, 20)


def test_search_improves_on_best_fit():
    counts = {6: 2, 5: 2, 4: 2, 3: 2, 2: 4, 7: 1, 8: 1}
    assert sum(m for m, _ in packing.complete_bins(counts, 15)) == -(-sum(x * n for x, n in counts.items()) // 15)
