"""Quality: a classifier learnt from trusted positives and unlabelled web text.

The features of a text are the shares of its byte classes and of adjacent pairs of classes
(upper and lower letters, digits, each kind of punctuation, space, line end, other bytes) and the
share of words that repeat the word before: dense, bounded, over the whole text. A linear model g
minimises the non-negative unbiased risk of positive-unlabelled learning::

    R(g) = pi E_p[l(g)] + max(0, E_u[l(-g)] - pi E_p[l(-g)])

with the logistic loss l, the positives (quality = 1) as E_p, unlabelled text as E_u, and the
class prior pi. When the second part falls below zero, a step climbs it instead, as the method
has it. The prior is estimated from a first fit of positives against unlabelled text: over the
share of positives above a threshold, the least ratio of unlabelled to positive tail mass.
Rows with quality = 0 are not used at all.

Fitted on bounded samples (``train_rows`` positives and ``train_rows`` unlabelled rows, the
smallest hashes of doc_id, held-out ids left out of both), in one task.

Defined results: null, empty and wordless texts have zero features and score as the bias says;
null or other labels train nothing; without positives or unlabelled rows every score is 0; an
empty table gives no row; repeated doc_ids of a sample count once.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from callgauge.llm import common
from callgauge.llm.textbytes import Words, flat

TRAIN_ROWS = 6_000
FOLDS, HELD_OUT = 3, 1
SLICE = 1 << 20

_CLASS = np.zeros(256, dtype=np.uint16)
_CLASS[0x80:] = 1
_CLASS[0x30:0x3A] = 2
_CLASS[0x41:0x5B] = 3
_CLASS[0x61:0x7B] = 4
_CLASS[0x20] = 5
_CLASS[0x0A] = 6
_SIGNS = [b for b in range(0x21, 0x7F) if not chr(b).isalnum()]
_CLASS[_SIGNS] = np.arange(7, 7 + len(_SIGNS))
N_CLASSES = 7 + len(_SIGNS)
DIMS = N_CLASSES + N_CLASSES**2 + 3


def text_features(data: np.ndarray) -> np.ndarray:
    """The dense features of one text's bytes, each between 0 and 1."""
    single, pair = np.zeros(N_CLASSES), np.zeros(N_CLASSES**2)
    words = again = 0
    for at in range(0, len(data), SLICE):
        part = data[at: at + SLICE]
        c = _CLASS[part]
        single += np.bincount(c, minlength=N_CLASSES)
        pair += np.bincount(c[:-1] * np.uint16(N_CLASSES) + c[1:], minlength=N_CLASSES**2)
        w = Words(part, np.array([0, len(part)]))
        words += len(w.hashes)
        again += int((w.hashes[1:] == w.hashes[:-1]).sum())
    n = max(len(data), 1)
    return np.concatenate([np.sqrt(single / n), np.sqrt(pair / n), [again / max(words, 1), min(1.0, 8 * words / n), min(1.0, np.log1p(words) / 12)]])


def features(col) -> np.ndarray:
    data, offsets = flat(col)
    return np.array([text_features(data[a:b]) for a, b in zip(offsets[:-1], offsets[1:])]).reshape(-1, DIMS).astype(np.float32)


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def fit_nnpu(xp: np.ndarray, xu: np.ndarray, prior: float, rounds: int = 400, rate: float = 0.02, decay: float = 1e-5,
             batch: int = 500, seed: int = 7) -> tuple[np.ndarray, float]:
    """Weights and bias that minimise the non-negative risk (Adam over mini-batches)."""
    rng = np.random.default_rng(seed)
    w = np.zeros(xp.shape[1] + 1)
    m, v = np.zeros_like(w), np.zeros_like(w)
    xp, xu = (np.hstack([x, np.ones((len(x), 1), np.float32)]).astype(np.float32, copy=False) for x in (xp, xu))
    for t in range(1, rounds + 1):
        p, u = xp[rng.integers(0, len(xp), batch)], xu[rng.integers(0, len(xu), batch)]
        w32 = w.astype(np.float32)
        gp, gu = p @ w32, u @ w32
        # gradients of l(g) = log(1 + exp(-g)) and of l(-g)
        sp, su = _sigmoid(gp), _sigmoid(gu)
        positive = prior * (sp - 1) @ p / batch
        negative = su @ u / batch - prior * sp @ p / batch
        risk = np.logaddexp(0, gu).mean() - prior * np.logaddexp(0, gp).mean()
        grad = (positive + negative if risk >= 0 else -negative) + decay * w
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w[:-1], float(w[-1])


def estimate_prior(xp: np.ndarray, xu: np.ndarray) -> float:
    """The share of positives in unlabelled text. A linear classifier of positives against
    unlabelled rows is fitted on the even rows; on the odd rows, the tail of the unlabelled
    scores over that of the positives' bounds the prior at every threshold."""
    w, b = fit_nnpu(xp[::2], xu[::2], 0.5, rounds=300)
    sp, su = np.sort(xp[1::2] @ w + b), np.sort(xu[1::2] @ w + b)
    if not len(sp) or not len(su):
        return 0.5
    ratios = []
    for share in np.linspace(0.3, 1.0, 141):  # tails with enough positives for a steady ratio
        k = max(1, int(share * len(sp)))
        above = len(su) - np.searchsorted(su, sp[len(sp) - k], "left")
        ratios.append((above / len(su)) / (k / len(sp)))
    return float(np.clip(min(ratios), 0.05, 0.99))


def fit(xp: np.ndarray, xu: np.ndarray) -> tuple[np.ndarray, float, float]:
    """Weights, bias and estimated prior."""
    if not len(xp) or not len(xu):
        return np.zeros(DIMS), -40.0, 0.0
    scale = (xu.std(axis=0) + 1e-3).astype(np.float32)
    xp, xu = xp / scale, xu / scale
    prior = estimate_prior(xp, xu)
    w, b = fit_nnpu(xp, xu, prior)
    return w / scale, b, prior


def train(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS, folds: int = FOLDS,
          held_out: int = HELD_OUT) -> tuple[np.ndarray, float, float]:
    """Fit on bounded samples of positives and of unlabelled text; one row, the model, comes back."""
    trusted = labels.where(F.col("quality") == 1).select("doc_id", "quality")
    unlabelled = docs.select("doc_id", F.lit(0).alias("quality"))
    sample = (common.labelled_sample(docs, trusted, "quality", train_rows, folds, held_out)
              .unionByName(common.labelled_sample(docs, unlabelled, "quality", train_rows, folds, held_out))
              .repartition(1).sortWithinPartitions("label", F.xxhash64("doc_id"), "doc_id"))

    def run(batches):
        parts: tuple[list, list] = ([], [])
        for batch in batches:
            x, label = features(batch.column("text")), np.array(batch.column("label"))
            parts[0].append(x[label == 0])
            parts[1].append(x[label == 1])
        none = [np.zeros((0, DIMS), np.float32)]
        w, bias, prior = fit(np.vstack(parts[1] or none), np.vstack(parts[0] or none))
        yield pa.RecordBatch.from_arrays([pa.array([w.astype(np.float64).tobytes()], pa.binary()), pa.array([bias]), pa.array([prior])], names=["w", "bias", "prior"])

    model = sample.mapInArrow(run, "w binary, bias double, prior double").collect()
    if not model:  # empty samples have no task
        return fit(np.zeros((0, DIMS)), np.zeros((0, DIMS)))
    return np.frombuffer(bytes(model[0]["w"]), np.float64), model[0]["bias"], model[0]["prior"]


def score(docs: DataFrame, model: tuple[np.ndarray, float, float]) -> DataFrame:
    """``docs`` with score (0 to 1) and predicted (1 from 0.5 on); other columns stay as they are."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        w, bias, _ = shared.value
        for batch in batches:
            s = _sigmoid(features(batch.column("__text")) @ w + bias)
            yield pa.RecordBatch.from_arrays(batch.columns[:-1] + [pa.array(s, pa.float64()), pa.array((s >= 0.5).astype(np.int32))],
                                             names=[*batch.schema.names[:-1], "score", "predicted"])

    own = [c for c in docs.columns if c not in ("score", "predicted")]
    given = docs.select(*own, F.col("text").cast("string").alias("__text"))
    schema = docs.select(*own).schema.add("score", "double").add("predicted", "integer")
    return given.mapInArrow(run, schema)


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    common.prepare(spark)
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, common.table(spark, sf_dir, "labels"))
    return score(docs, model).select("doc_id", common.held_out("doc_id", FOLDS, HELD_OUT).alias("held_out"), "score", "predicted")
