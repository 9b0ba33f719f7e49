"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

A text's features are the distinct n-grams of 3 to 6 characters (code points) within its words
(A-Z lower-cased, a space at either end of a word), hashed into ``2**BITS`` places. Let p and q be the smoothed
shares of toxic and of other training texts that hold a feature; each feature is scaled by
``log(p / q)``, and a logistic regression is fitted on the scaled features that depend on the
label at all: those with a chi-square above ``MIN_CHI_SQUARE`` (the others would be most of the
work), and in any case the ``LEAST_FEATURES`` of the largest, so that a small sample keeps its best ones.

The model is fitted on a bounded sample of labelled rows (``train_rows`` rows and
``train_features`` features, both parameters; the rows with the smallest hash of doc_id), in one
task. Scoring covers every whole text, slice by slice.

Defined results: null, empty and wordless texts score the model's prior for a text without
features; a null label or one besides 0 and 1 trains nothing; repeated doc_ids of the sample
train once; without labelled rows of both classes, or without a feature that differs between
them, every score is near 0 and no text is predicted toxic; an empty table gives no row.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from callgauge.llm import common
from callgauge.llm.textbytes import _IS_WORD, _LOWER, flat

BITS = 18
SIZES = (3, 4, 5, 6)
TRAIN_ROWS = 8_000
TRAIN_FEATURES = 24_000_000
MIN_CHI_SQUARE, LEAST_FEATURES = 15.0, 2_000
FOLDS, HELD_OUT = 5, 0
RESULTS = ("score", "predicted")

_TO_GRAM = np.where(_IS_WORD, _LOWER, 32).astype(np.uint32)
_FACTOR = np.uint32(0x9E3779B1)


def gram_features(data: np.ndarray) -> np.ndarray:
    """Distinct hashed n-grams of one text's code points (sorted, uint32)."""
    seen = np.zeros(1 << BITS, dtype=bool)
    step = 1 << 20
    for at in range(0, len(data), step):  # a long text slice by slice, with an overlap
        b = np.full(min(step + max(SIZES), len(data) - at) + 2, 32, dtype=np.uint32)
        part = data[at: at + len(b) - 2].astype(np.uint32)
        plain = part < 128
        part[plain] = _TO_GRAM[part[plain]]
        b[1: 1 + len(part)] = part
        gap = b == 32
        h = np.zeros(len(b), dtype=np.uint32)
        word = np.ones(len(b), dtype=bool)  # no space strictly inside the n-gram
        with np.errstate(over="ignore"):
            for n in range(1, max(SIZES) + 1):
                m = len(b) - n + 1
                if m <= 0:
                    break
                h = (h[:m] + b[n - 1:]) * _FACTOR
                h ^= h >> np.uint32(15)
                if n > 2:
                    word = word[:m] & ~gap[n - 2: n - 2 + m]
                if n in SIZES:
                    seen[(h[word[:m]] + np.uint32(n * 0x85EBCA6B & 0xFFFFFFFF)) * _FACTOR >> np.uint32(32 - BITS)] = True
    return np.flatnonzero(seen).astype(np.uint32)


def fit(rows: list[tuple[np.ndarray, int]], rounds: int = 400, rate: float = 0.3, decay: float = 2e-4) -> tuple[np.ndarray, float]:
    """Weights (ratio times coefficient) and bias from (features, label) rows."""
    dims = 1 << BITS
    y = np.array([label for _, label in rows], dtype=np.float64)
    if not rows or y.min() == y.max():
        return np.zeros(dims, np.float32), -20.0
    counts = [np.zeros(dims), np.zeros(dims)]
    for f, label in rows:
        counts[label][f] += 1
    toxic, n = y.sum(), len(y)
    ratio = np.log((counts[1] + 1) / (toxic + 2)) - np.log((counts[0] + 1) / (n - toxic + 2))
    both = counts[0] + counts[1]
    expected = both * toxic / n
    spread = expected * (1 - both / n) * (n - toxic)
    chi_square = np.divide((counts[1] - expected) ** 2 * n, spread, out=np.zeros(dims), where=spread > 0)
    kept = chi_square > MIN_CHI_SQUARE
    if kept.sum() < LEAST_FEATURES:
        best = np.argsort(-chi_square, kind="stable")[:LEAST_FEATURES]
        kept[best[chi_square[best] > 1e-9]] = True
    if not kept.any():
        return np.zeros(dims, np.float32), -20.0
    place = (np.cumsum(kept) - 1).astype(np.int32)
    index = [place[f[kept[f]]] for f, _ in rows]
    # rows go through each step in blocks, which bounds what a step takes beside the indices
    blocks = [(lo, np.concatenate(index[lo: lo + 256]), np.array([len(i) for i in index[lo: lo + 256]])) for lo in range(0, n, 256)]
    del index
    r = ratio[kept] / 4
    w, bias = np.zeros(len(r)), 0.0
    weight = np.where(y == 1, 0.5 / y.sum(), 0.5 / (1 - y).sum())  # classes count alike
    square, square_b = np.full(len(r), 1e-8), 1e-8
    for _ in range(rounds):  # full-batch gradient steps, scaled by each feature's past gradients
        grad, sum_g = decay * w, 0.0
        scaled = w * r
        for lo, i, lengths in blocks:
            row = np.repeat(np.arange(len(lengths)), lengths)
            margin = np.bincount(row, weights=scaled[i], minlength=len(lengths)) + bias
            g = weight[lo: lo + 256] * (1 / (1 + np.exp(-np.clip(margin, -40, 40))) - y[lo: lo + 256])
            grad += np.bincount(i, weights=g[row], minlength=len(r)) * r
            sum_g += g.sum()
        square, square_b = square + grad**2, square_b + sum_g**2
        w -= rate * grad / np.sqrt(square)
        bias -= rate * sum_g / np.sqrt(square_b)
    out = np.zeros(dims, np.float32)
    out[kept] = w * r
    return out, float(bias)


def features(col) -> list[np.ndarray]:
    """The n-gram features of each text of an Arrow column."""
    data, offsets = flat(col)
    points = (data[a:b].tobytes().decode("utf-8", "replace").encode("utf-32-le") for a, b in zip(offsets[:-1], offsets[1:]))
    return [gram_features(np.frombuffer(p, dtype="<u4")) for p in points]


def train(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS, train_features: int = TRAIN_FEATURES,
          folds: int = FOLDS, held_out: int = HELD_OUT) -> tuple[np.ndarray, float]:
    """Fit on a bounded sample of the labelled rows outside the held-out fold; one row, the model, comes back."""
    sample = common.labelled_sample(docs, labels, "toxic", train_rows, folds, held_out)

    def run(batches):
        rows, total = [], 0
        for batch in batches:
            for f, label in zip(features(batch.column("text")), batch.column("label").to_pylist()):
                total += len(f)
                if total <= train_features:
                    rows.append((f, label))
        w, bias = fit(rows)
        yield pa.RecordBatch.from_arrays([pa.array([w.tobytes()], pa.binary()), pa.array([bias])], names=["w", "bias"])

    model = sample.mapInArrow(run, "w binary, bias double").collect()
    if not model:  # an empty sample has no task
        return fit([])
    return np.frombuffer(bytes(model[0]["w"]), np.float32), model[0]["bias"]


def score(docs: DataFrame, model: tuple[np.ndarray, float]) -> DataFrame:
    """``docs`` with score (0 to 1) and predicted (1 from 0.5 on); other columns stay as they are."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        w, bias = shared.value
        for batch in batches:
            margin = [float(w[f].sum(dtype=np.float64)) + bias for f in features(batch.column("__text"))]
            s = 1 / (1 + np.exp(-np.clip(margin, -40, 40)))
            yield pa.RecordBatch.from_arrays(batch.columns[:-1] + [pa.array(s, pa.float64()), pa.array((s >= 0.5).astype(np.int32))],
                                             names=[*batch.schema.names[:-1], "score", "predicted"])

    own = [c for c in docs.columns if c not in ("score", "predicted")]
    given = docs.select(*own, F.col("text").cast("string").alias("__text"))
    schema = docs.select(*own).schema.add("score", "double").add("predicted", "integer")
    return given.mapInArrow(run, schema)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    common.prepare(spark)
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, common.table(spark, sf_dir, "labels"))
    return score(docs, model).select("doc_id", common.held_out("doc_id", FOLDS, HELD_OUT).alias("held_out"), "score", "predicted")
