"""Operator 3: language identification by averaged hashed subword embeddings.

A text's subwords are the 2-, 3- and 4-byte windows of its lower-cased letters
(other characters become single spaces), hashed to 2**16 rows.  The rows'
embeddings are averaged over the whole text and a linear softmax gives the
language.  Embeddings and softmax are learned by stochastic gradient descent
in numpy, on a bounded sample: each language's rows are sampled by a hash at a
rate that aims at ``sample_rows / languages``, so more data changes the rate
only.  The driver gets hashed counts, never texts.

Calibration: a fifth of the sample is kept from the descent.  A temperature
makes its probabilities honest, and ``score`` is the calibrated probability
of the predicted language.  A text is rejected when it has no letter, or when
its score is below the level that only ``reject_rate`` of the calibration
texts fall under, 0.5 at most.

As embedding and softmax are linear, a text's logits are a mean over its
windows of one (2**16 x languages) table; each task gathers from that table.

Cases: a null text, or one without a letter, gives `und`, score 0.0, rejected;
null languages are never learned from; with no rows to learn from every text
is `und`; very long texts are read whole, in slices; repeated rows give one
row each; extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cardinal.llm.common import arrow_map

BITS = 16
DIM = 8
EPOCHS = 12
RATE = 8.0
SAMPLE_ROWS = 2_000
REJECT_RATE = 0.001
UNKNOWN = "und"
LETTER = regex.compile(r"\p{L}")
SLICE = 1 << 20

#: Lower-case ASCII letters and bytes of longer UTF-8 characters stand for themselves, all others for a space.
CLEAN = np.array([b if b >= 128 or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32 for b in range(256)], np.uint8)


def windows(text: str):
    """Hashed rows of all 2-, 3- and 4-byte windows, slice by slice (slices overlap by three bytes)."""
    raw = CLEAN[np.frombuffer(f" {text.lower()} ".encode("utf-8", "replace"), np.uint8)]
    space = raw == 32
    raw = raw[~(space & np.concatenate(([False], space[:-1])))].astype(np.uint32)
    for at in range(0, max(1, len(raw) - 3), SLICE):
        part = raw[at:at + SLICE + 3]
        code = part[:-1] << np.uint32(8) | part[1:]
        last = at + SLICE + 3 >= len(raw)
        for n in (2, 3, 4):
            if n > 2:
                code = code[:-1] << np.uint32(8) | part[n - 1:]
            own = code if last else code[:SLICE]
            yield (own + np.uint32(n)) * np.uint32(0x9E3779B1) >> np.uint32(32 - BITS)


def has_letter(text: str | None) -> bool:
    return bool(text) and LETTER.search(text) is not None


def hashed_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The text's rows and how often each occurs."""
    total = np.zeros(1 << BITS, np.int64)
    for w in windows(text):
        total += np.bincount(w, minlength=1 << BITS)
    rows = np.flatnonzero(total)
    return rows.astype(np.int32), total[rows].astype(np.float32)


@dataclass
class LanguageModel:
    """Logits of a text: the mean of ``table`` over its windows, plus ``bias``, over ``temperature``."""

    names: list[str]
    table: np.ndarray
    bias: np.ndarray
    temperature: float
    floor: float  # texts with a lower score are rejected

    def logits(self, text: str) -> np.ndarray:
        total, n = np.zeros(len(self.names)), 0
        for w in windows(text):
            total += np.bincount(w, minlength=1 << BITS) @ self.table if len(w) > 1 << BITS else \
                self.table.take(w, axis=0).sum(axis=0, dtype=np.float64)
            n += len(w)
        return (total / max(n, 1) + self.bias) / self.temperature

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """(language, score, rejected)."""
        if not self.names or not has_letter(text):
            return UNKNOWN, 0.0, True
        p = softmax(self.logits(text))
        k = int(p.argmax())
        return self.names[k], float(p[k]), bool(p[k] < self.floor)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def learn(sample: list[tuple[str, np.ndarray, np.ndarray]], reject_rate: float = REJECT_RATE,
          seed: int = 0) -> LanguageModel:
    """Train on (language, rows, counts) triples."""
    names = sorted({lang for lang, _, _ in sample})
    if not names:
        return LanguageModel([], np.zeros((1 << BITS, 0), np.float32), np.zeros(0), 1.0, 0.0)
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(sample))
    kept, held = order[len(sample) // 5:], order[:len(sample) // 5]
    of = {n: i for i, n in enumerate(names)}
    emb = rng.normal(0, 0.1, (1 << BITS, DIM)).astype(np.float32)
    out = rng.normal(0, 0.1, (DIM, len(names))).astype(np.float32)
    bias = np.zeros(len(names), np.float32)
    shares = [(of[lang], rows, counts / counts.sum()) for lang, rows, counts in sample]
    steps, step = EPOCHS * len(kept), 0
    for _ in range(EPOCHS):
        for i in rng.permutation(kept):
            rate = RATE * (1 - step / steps)
            step += 1
            k, rows, share = shares[i]
            hidden = share @ emb[rows]
            err = softmax(hidden @ out + bias)
            err[k] -= 1
            back = out @ err
            out -= 0.02 * rate * np.outer(hidden, err)
            bias -= 0.002 * rate * err
            emb[rows] -= rate * share[:, None] * back
    table = emb @ out
    if not len(held):
        return LanguageModel(names, table, bias, 1.0, 0.0)
    z = np.array([shares[i][2] @ table[shares[i][1]] + bias for i in held])
    truth = np.array([shares[i][0] for i in held])
    grid = np.geomspace(0.05, 20, 121)
    loss = [-np.log(softmax(z / t)[np.arange(len(z)), truth] + 1e-12).mean() for t in grid]
    temperature = float(grid[int(np.argmin(loss))])
    score = softmax(z / temperature).max(axis=1)
    return LanguageModel(names, table, bias, temperature, min(0.5, float(np.quantile(score, reject_rate))))


def fit(docs: DataFrame, usable: Column, sample_rows: int = SAMPLE_ROWS, reject_rate: float = REJECT_RATE,
        text_col: str = "text", lang_col: str = "lang", seed: int = 0) -> LanguageModel:
    """Learn from the rows where ``usable`` is true; about ``sample_rows`` of them, evenly by language."""
    rows = docs.where(usable).select(F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    rows = rows.where("text is not null and lang is not null")
    per = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(sample_rows).collect()
    if not per:
        return learn([], reject_rate)
    rates = docs.sparkSession.createDataFrame([(r["lang"], sample_rows / len(per) / r["n"]) for r in per], "lang string, rate double")
    draw = (F.xxhash64(F.lit(seed), "text") % 1_000_003 + 1_000_003) % 1_000_003 / 1_000_003.0
    drawn = rows.join(F.broadcast(rates), "lang").where(draw < F.col("rate"))  # at most sample_rows rates
    picked = drawn.select("text", "lang").dropDuplicates(["lang", "text"])  # copies of a drawn text count once

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        got = [(lang.as_py(), *hashed_counts(text.as_py())) for text, lang in zip(*batch.columns, strict=True)
               if has_letter(text.as_py())]
        return pa.RecordBatch.from_arrays(
            [pa.array([g[0] for g in got], pa.string()), pa.array([g[1].tobytes() for g in got], pa.binary()),
             pa.array([g[2].tobytes() for g in got], pa.binary())], names=["lang", "rows", "counts"])

    sample = arrow_map(picked, run, "lang string, rows binary, counts binary").collect()
    sample = sorted((r["lang"], bytes(r["rows"]), bytes(r["counts"])) for r in sample)
    return learn([(lang, np.frombuffer(a, np.int32), np.frombuffer(b, np.float32)) for lang, a, b in sample], reject_rate, seed)


def identify(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, lang_pred, score, rejected."""
    kind = docs.schema[id_col].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2**16 x languages numbers

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        m = shared.value
        got = [m.predict(t.as_py()) for t in batch.column(1)]
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64()),
             pa.array([g[2] for g in got], pa.bool_())], names=[id_col, "lang_pred", "score", "rejected"])

    return arrow_map(docs.select(id_col, F.col(text_col).cast("string")), run,
                     f"`{id_col}` {kind}, lang_pred string, score double, rejected boolean")


def keep_identified(docs: DataFrame, model: LanguageModel, text_col: str = "text") -> DataFrame:
    """The rows that are not rejected, all columns kept."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        m = shared.value
        return batch.filter(pa.array([not m.predict(t.as_py())[2] for t in batch.column(at)], pa.bool_()))

    return arrow_map(docs, run, docs.schema)
