"""Operator 2: a byte-level convolutional quality classifier in numpy.

A text's UTF-8 bytes get small learned vectors.  Learned filters, ``WIDTH``
bytes wide, slide over them every ``STEP`` bytes; their responses are
max-pooled in chunks of two ``HALF``-byte halves that overlap by one, so the
chunks cover the whole text.  The mean and the maximum over chunks of the
pooled responses are combined into one probability by a logistic layer.
Everything is learned by gradient descent (Adam) in numpy on the driver, from a
bounded sample: rows are drawn by a hash at a rate that aims at ``sample_rows``
rows and ``sample_bytes`` bytes in all.

Cases: a null text counts as empty; an empty text is scored as one chunk of
padding; with no labelled rows, or labels of one kind only, the score is the
share of label 1 (0.5 without labels); very long texts are read whole, in
slices; repeated rows give one row each; extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cardinal.llm.common import arrow_map, reliable_checkpoint
from cardinal.operators.joins import broadcast_if_bounded

DIM, WIDTH, STEP, HALF, FILTERS = 6, 16, 4, 128, 24
EPOCHS, BATCH, RATE = 10, 32, 4e-3
SAMPLE_ROWS, SAMPLE_BYTES = 2_500, 10_000_000
SLICE_HALVES = 4096
PAD = 0


@dataclass
class QualityModel:
    """bytes -> vectors -> filters -> chunks -> probability; ``constant`` replaces it where there was nothing to learn."""

    emb: np.ndarray | None = None
    conv: np.ndarray | None = None  # (WIDTH * DIM, FILTERS)
    bias: np.ndarray | None = None
    out: np.ndarray | None = None  # (2 * FILTERS,)
    out_bias: float = 0.0
    constant: float = 0.5

    def halves(self, text: str | None):
        """Pooled responses (halves, FILTERS), slice by slice."""
        for grid, tail in slices(text):
            yield pooled(self.emb, self.conv, self.bias, grid, tail)[0]

    def score(self, text: str | None) -> float:
        if self.emb is None:
            return self.constant
        total, top, n, before = np.zeros(FILTERS), np.full(FILTERS, -np.inf), 0, None
        for half in self.halves(text):
            if before is not None:
                half = np.concatenate((before, half))
            before = half[-1:]
            chunk = np.maximum(half[:-1], half[1:])
            if len(chunk):
                total += chunk.sum(axis=0)
                top = np.maximum(top, chunk.max(axis=0))
                n += len(chunk)
        if not n:
            total, top, n = before[0], before[0], 1
        z = np.concatenate((total / n, top)) @ self.out + self.out_bias
        return float(1 / (1 + np.exp(-z)))


def byte_grid(text: str | None) -> np.ndarray:
    """The text's bytes, padded to whole halves (one at least)."""
    raw = np.frombuffer((text or "").encode("utf-8", "replace"), np.uint8)
    return np.pad(raw, (0, -len(raw) % HALF if len(raw) else HALF))


def slices(text: str | None):
    """(bytes of whole halves, the next WIDTH - STEP bytes) for stretches of the text."""
    raw = byte_grid(text)
    for at in range(0, len(raw), SLICE_HALVES * HALF):
        end = min(len(raw), at + SLICE_HALVES * HALF)
        tail = raw[end:end + WIDTH - STEP]
        yield raw[at:end], np.pad(tail, (0, WIDTH - STEP - len(tail)))


def pooled(emb, conv, bias, grid, tail) -> tuple[np.ndarray, np.ndarray]:
    """Max-pooled filter responses per half, before: and the windows that gave them.

    A window is WIDTH / STEP blocks of STEP bytes, so one product of all
    blocks with all parts of the filters, shifted and added, is the convolution.
    """
    blocks = np.concatenate((grid, tail)).reshape(-1, STEP)
    parts = WIDTH // STEP
    flat = emb.take(blocks, axis=0).reshape(len(blocks), STEP * DIM)
    n = len(grid) // STEP
    got = flat[:n] @ conv[:STEP * DIM]
    for k in range(1, parts):
        got += flat[k:n + k] @ conv[k * STEP * DIM:(k + 1) * STEP * DIM]
    shaped = got.reshape(-1, HALF // STEP, FILTERS)
    return np.maximum(shaped.max(axis=1) + bias, 0), shaped


def learn(sample: list[tuple[int, str]], seed: int = 0) -> QualityModel:
    """Train on (label, text) pairs."""
    share = float(np.mean([y for y, _ in sample])) if sample else 0.5
    if share in (0.0, 1.0) or not sample:
        return QualityModel(constant=share)
    rng = np.random.default_rng(seed)
    p = {
        "emb": rng.normal(0, 0.5, (256, DIM)).astype(np.float32),
        "conv": rng.normal(0, 1 / np.sqrt(WIDTH * DIM * 0.25), (WIDTH * DIM, FILTERS)).astype(np.float32),
        "bias": np.zeros(FILTERS, np.float32),
        "out": rng.normal(0, 0.1, 2 * FILTERS).astype(np.float32),
        "out_bias": np.array([np.log(share / (1 - share))], np.float32),
    }
    first, second = ({k: np.zeros_like(v) for k, v in p.items()} for _ in range(2))
    grids = [byte_grid(t) for _, t in sample]
    labels = np.array([y for y, _ in sample], np.float32)
    step, steps = 0, EPOCHS * -(-len(sample) // BATCH)
    for _ in range(EPOCHS):
        order = rng.permutation(len(sample))
        for at in range(0, len(order), BATCH):
            grad = {k: np.zeros_like(v) for k, v in p.items()}
            picked = order[at:at + BATCH]
            for i in picked:
                backward(p, grad, grids[i], labels[i], len(picked))
            step += 1
            rate = RATE * (1 - step / (steps + 1))
            for k in p:
                first[k] += 0.1 * (grad[k] - first[k])
                second[k] += 0.01 * (grad[k] ** 2 - second[k])
                p[k] -= rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)
    return QualityModel(p["emb"], p["conv"], p["bias"], p["out"], float(p["out_bias"][0]), share)


def backward(p: dict, grad: dict, grid: np.ndarray, label: float, batch: int) -> None:
    """Add one text's gradient of the cross-entropy; only the windows that won a maximum take part."""
    tail = np.zeros(WIDTH - STEP, np.uint8)
    half, shaped = pooled(p["emb"], p["conv"], p["bias"], grid, tail)
    m = len(half)
    chunk = np.maximum(half[:-1], half[1:]) if m > 1 else half
    cols = np.arange(FILTERS)
    best = chunk.argmax(axis=0)
    feats = np.concatenate((chunk.mean(axis=0), chunk[best, cols]))
    z = float(feats @ p["out"] + p["out_bias"][0])
    err = (1 / (1 + np.exp(-z)) - label) / batch
    grad["out"] += err * feats
    grad["out_bias"] += err
    d_chunk = np.broadcast_to(err * p["out"][:FILTERS] / len(chunk), chunk.shape).copy()
    d_chunk[best, cols] += err * p["out"][FILTERS:]
    d_half = np.zeros_like(half)
    if m > 1:
        left = half[:-1] >= half[1:]
        d_half[:-1] += d_chunk * left
        d_half[1:] += d_chunk * ~left
    else:
        d_half += d_chunk
    d_half *= half > 0
    grad["bias"] += d_half.sum(axis=0)
    where = shaped.argmax(axis=1) + np.arange(m)[:, None] * (HALF // STEP)  # winning window of each half and filter
    rows, fs = np.nonzero(d_half)
    if not len(rows):
        return
    g = d_half[rows, fs]
    raw = np.concatenate((grid, tail))
    seen = raw[where[rows, fs][:, None] * STEP + np.arange(WIDTH)]  # (winners, WIDTH) bytes
    vec = p["emb"].take(seen, axis=0).reshape(len(g), WIDTH * DIM)
    # Winners by filter: a one-hot product sums them.
    hot = np.zeros((len(g), FILTERS), np.float32)
    hot[np.arange(len(g)), fs] = g
    grad["conv"] += vec.T @ hot
    d_vec = (hot @ p["conv"].T).reshape(-1, DIM)
    flat = seen.ravel()
    for d in range(DIM):
        grad["emb"][:, d] += np.bincount(flat, weights=d_vec[:, d], minlength=256)


def fit(docs: DataFrame, labels: DataFrame, usable: Column, sample_rows: int = SAMPLE_ROWS,
        sample_bytes: int = SAMPLE_BYTES, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
        seed: int = 0) -> QualityModel:
    """Learn from the rows of ``docs`` where ``usable`` is true and whose id has a label of 0 or 1 in ``labels``.

    Ids and sizes alone meet the labels and are drawn (an id counts once);
    only the texts of the drawn ids, a bounded number, are read out.
    """
    own = docs.where(usable & F.col(text_col).isNotNull()).select(
        F.col(id_col).alias("id"), F.octet_length(F.col(text_col).cast("string")).cast("long").alias("size"))
    marks = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).where("label in (0, 1)")
    drawn = own.groupBy("id").agg(F.max("size").alias("size")).join(marks.groupBy("id").agg(F.max("label").alias("label")), "id")
    drawn = reliable_checkpoint(drawn)
    n, size = drawn.agg(F.count(F.lit(1)), F.sum("size")).first()
    rate = min(1.0, sample_rows / max(n, 1), sample_bytes / max(size or 0, 1))
    draw = (F.xxhash64(F.lit(seed), "id") % 1_000_003 + 1_000_003) % 1_000_003 / 1_000_003.0
    picked, _ = broadcast_if_bounded(drawn.where(draw < F.lit(rate)).select(F.col("id").alias("_id"), "label"), 10 * sample_rows)
    texts = docs.where(usable & F.col(text_col).isNotNull()).select(id_col, F.col(text_col).cast("string").alias("_text"))
    texts = texts.join(picked, F.col(id_col) == F.col("_id")).groupBy("_id").agg(F.max("label").alias("label"), F.max("_text").alias("text"))
    return learn(sorted((r["label"], r["text"]) for r in texts.select("label", "text").collect()), seed)


def score_texts(docs: DataFrame, model: QualityModel, id_col: str = "doc_id", text_col: str = "text",
                threshold: float = 0.3) -> DataFrame:
    """Per row: id, score, predicted."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        got = np.array([model.score(t.as_py()) for t in batch.column(1)])
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(got), pa.array((got >= threshold).astype(np.int32))],
                                          names=[id_col, "score", "predicted"])

    return arrow_map(docs.select(id_col, F.col(text_col).cast("string")), run,
                     f"`{id_col}` {kind}, score double, predicted int")


def keep_good(docs: DataFrame, model: QualityModel, text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """The rows scored at ``threshold`` or more, all columns kept."""
    at = docs.columns.index(text_col)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        return batch.filter(pa.array([model.score(t.as_py()) >= threshold for t in batch.column(at)], pa.bool_()))

    return arrow_map(docs, run, docs.schema)
