"""Toxicity: bags of subwords averaged into a linear softmax, embeddings and softmax trained jointly in numpy.

A word is the mean of the embeddings of its character n-grams (and of itself), so unseen misspellings share vectors with known
words. A text is read in all windows of WINDOW consecutive words, overlapping, each the average of its words; the text's score is
that of its highest window, so that a few words count in a long text, wherever they stand. Training takes WHOLE_STEPS steps on
averages of whole texts, then STEPS steps in which the window that now scores highest (of equal ones the first) stands for its
text; embeddings and softmax move together. Words' logits are multiples of 2 ** -24, so sums over windows are exact and a text's
score is the same whatever stands beside it in a batch.

Training rows are a bounded sample: PER_CLASS rows of each label at most, drawn by hash order of their ids; of texts beyond
MAX_CHARS a window of so many characters. Scoring reads every whole text. The model is BUCKETS * DIM numbers, whatever the corpus.

Cases: null or empty text, or one without words, scores as an empty bag (the softmax's bias); without labels of both kinds
every score is the share of label 1 (0.5 without any).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, extended, labelled_sample, slices, tidy, unused
from .ngrams import MARKED, Words, lower, means, word_slices

WINDOW, SIZES, BUCKETS, DIM = 2, (3, 4, 5), 1 << 17, 4
PER_CLASS, MAX_CHARS = 1200, 8_000
WHOLE_STEPS, STEPS, RATE, SOFT_RATE, BIAS_RATE, DAMP, DECAY = 10, 150, 2.0, 0.01, 1.0, 0.3, 1e-3
UNIT = float(1 << 24)
THRESHOLD = 0.7


def windows(first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word and word after the last of all windows, and where each row's windows begin; a row of at most WINDOW words has one."""
    n = np.maximum(1, np.diff(first) - WINDOW + 1)
    own = np.concatenate([[0], np.cumsum(n)])
    row = np.repeat(np.arange(len(n)), n)
    begin = np.arange(own[-1]) - own[row] + first[row]
    return begin, np.minimum(begin + WINDOW, first[row + 1]), own


def _running(word: np.ndarray, which: np.ndarray) -> np.ndarray:
    """Sums of the words' logits up to each place, exact in units of 1 / UNIT."""
    out = np.zeros(len(which) + 1, np.int64)
    np.cumsum(np.rint(word * UNIT).astype(np.int64)[which], out=out[1:])
    return out


def _averages(upto: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    return (upto[end] - upto[begin]) / (UNIT * np.maximum(end - begin, 1))


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


class SubwordModel:
    def __init__(self, u: np.ndarray, bias: float):
        #: what each bucket adds to the logit of label 1 against 0: its embedding times the softmax
        self.u, self.bias = u, bias

    def scores(self, column: pa.Array) -> np.ndarray:
        out = np.zeros(len(column))
        for a, b, w in word_slices(column, MARKED):
            bucket, first = w.ngrams(SIZES, BUCKETS, True)
            begin, end, own = windows(w.first)
            logit = self.bias + WINDOW * _averages(_running(means(self.u[bucket], first), w.which), begin, end)
            out[a:b] = _sigmoid(np.maximum.reduceat(logit, own[:-1]))
        return out


def train(texts: list[str | None], y: np.ndarray, seed: int = 7) -> SubwordModel:
    if len(texts) == 0 or y.min() == y.max():
        share = float(np.clip(y.mean(), 0.02, 0.98)) if len(texts) else 0.5
        return SubwordModel(np.zeros(BUCKETS, np.float32), float(np.log(share / (1 - share))))
    _, _, data, off = next(slices(lower(pa.array(texts, pa.large_string())), 1 << 62))
    w = Words(data, off, MARKED)
    bucket, first = w.ngrams(SIZES, BUCKETS, True)
    grams, (begin, end, own) = np.diff(first), windows(w.first)
    of = np.repeat(np.arange(len(grams)), grams)
    # embeddings begin at 0: n-grams that no training text holds add nothing to any score
    soft = np.random.default_rng(seed).normal(0, 1, DIM)
    e, soft, bias = np.zeros((BUCKETS, DIM), np.float32), soft / np.linalg.norm(soft), 0.0
    me, ve, ms, mb = np.zeros_like(e), np.zeros_like(e), np.zeros_like(soft), 0.0
    share = np.where(y == 1, 0.5 / (y == 1).sum(), 0.5 / (y == 0).sum())
    for t in range(WHOLE_STEPS + STEPS):
        upto = _running(means((e @ soft).astype(np.float32)[bucket], first), w.which)
        lo, hi = w.first[:-1], w.first[1:]  # whole texts first, then each text's highest window
        if t >= WHOLE_STEPS:
            mean = _averages(upto, begin, end)
            at = np.flatnonzero(mean == np.repeat(np.maximum.reduceat(mean, own[:-1]), np.diff(own)))
            top = at[np.searchsorted(at, own[:-1])]
            lo, hi = begin[top], end[top]
        g = (_sigmoid(bias + WINDOW * _averages(upto, lo, hi)) - y) * share
        step, n = g * WINDOW / np.maximum(hi - lo, 1), len(w.which) + 1
        by = np.cumsum(np.bincount(lo, step, n) - np.bincount(hi, step, n))[:-1]
        word = np.bincount(w.which, by, len(grams)) / np.maximum(grams, 1)
        gu = np.bincount(bucket, word[of], BUCKETS)
        ge = np.outer(gu, soft).astype(np.float32)
        me, ve = 0.8 * me + 0.2 * ge, 0.9 * ve + 0.1 * ge**2
        ms, mb = 0.8 * ms + 0.2 * (e.T @ gu), 0.8 * mb + 0.2 * g.sum()
        # what many texts agree on takes a full step, what few say hardly any
        root = np.sqrt(ve)
        e = e * (1 - DECAY) - RATE * me / (root + DAMP * root.max() + 1e-12)
        soft, bias = soft - SOFT_RATE * ms, bias - BIAS_RATE * mb
    return SubwordModel((e @ soft).astype(np.float32), bias)


def fit(docs: DataFrame, labels: DataFrame, allowed) -> SubwordModel:
    """Learns from the labelled rows for which the Column ``allowed`` (over labels' columns) is true."""
    rows = labelled_sample(docs, labels, "toxic", allowed, PER_CLASS, MAX_CHARS).collect()  # 2 * PER_CLASS rows at most
    rows.sort(key=lambda r: r["doc_id"])
    return train([r["x"] for r in rows], np.array([int(r["_label"]) for r in rows], np.int64))


def score(docs: DataFrame, model: SubwordModel, keep: list[str]) -> DataFrame:
    """Columns ``keep`` of docs with score, the probability of label 1."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        model = sent.value
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(1, batch.num_columns)), pa.array(model.scores(batch.column(0)))], [*keep, "score"])

    passed = docs.select(F.col("text").alias(unused("_text", keep)), *keep)
    return passed.mapInArrow(tidy(run), extended(docs.select(*keep), "score double"))


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out (no label of such a row is learnt), score and predicted for every row."""
    held = crc_mod(F.col("doc_id"), 3) == 1
    model = fit(docs, labels, ~held)
    out = score(docs, model, ["doc_id"])
    return out.select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
