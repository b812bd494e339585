"""Quality: a generalised additive model with pairwise interactions, by cyclic boosting of shallow trees on binned features.

Each feature is a statistic of the whole text, cut into at most BINS bins at quantiles of the training rows. Rounds go over the
features in turn; each adds to the feature's lookup table a tree of two splits fitted to the residuals. Then the PAIRS pairs of
features whose coarse grids explain most of what is left get tables of their own, boosted the same way. A score is the logistic of the
bias plus one table entry a feature and pair.

Training rows are a bounded sample: PER_CLASS rows of each label, by hash order of ids, with their whole texts; only their
features come to the driver. Scoring reads every whole text.

Cases: null or empty text has the features of an empty text and is scored; without labels of both kinds every score is the
share of label 1 (0.5 without any).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, crc_mod, extended, labelled_sample, lut, slices, span_hash, tidy, unused, word_spans

BINS, COARSE, PAIRS = 32, 8, 10
ROUNDS, PAIR_ROUNDS, RATE = 120, 60, 0.15
PER_CLASS = 4000
THRESHOLD = 0.3

FEATURES = (
    "chars words word_length upper digits signs stops nonascii blanks lines line_length distinct_words commonest_word distinct_lines again sentence_length long_words word_signs"
).split()
#: Kinds of bytes: 0 lower, 1 upper, 2 digit, 3 rarer sign, 4 stop or comma, 5 beyond ASCII, 6 blank, 7 line end, 8 other.
_KIND = np.full(256, 8, np.int64)
_KIND[0x61:0x7B] = 0
_KIND[0x41:0x5B] = 1
_KIND[0x30:0x3A] = 2
for _c in "!\"#$%&'()*+-/:;<=>?@[\\]^_`{|}~":
    _KIND[ord(_c)] = 3
_KIND[[ord("."), ord(",")]] = 4
_KIND[0x80:] = 5
_KIND[[0x20, 9]] = 6
_KIND[10] = 7


def _repeats(h: np.ndarray, row: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes a row, and how often the commonest stands."""
    distinct, most = np.zeros(n), np.zeros(n)
    for lo in range(0, n, 1 << 16):  # 16 bits for the row, 48 of the hash
        own = (row >= lo) & (row < lo + (1 << 16)) if n > 1 << 16 else slice(None)
        key = np.sort((row[own] - lo).astype(np.uint64) << np.uint64(48) | h[own] >> np.uint64(16))
        if len(key):
            edge = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            r = (key[edge] >> np.uint64(48)).astype(np.int64) + lo
            distinct += np.bincount(r, minlength=n)
            np.maximum.at(most, r, np.diff(np.append(edge, len(key))))
    return distinct, most


def features(column: pa.Array) -> np.ndarray:
    """A row of FEATURES for each text."""
    out = np.zeros((len(column), len(FEATURES)))
    for a, b, data, off in slices(column):
        n = b - a
        size = np.diff(off).astype(np.float64)
        row = np.repeat(np.arange(n), np.diff(off))
        kind = np.bincount(row * 9 + _KIND[data], minlength=9 * n).reshape(n, 9).astype(np.float64)
        low = LOWER[data]
        ws, we, first = word_spans(low, off, lut("nonspace"))
        words = np.diff(first).astype(np.float64)
        wrow = np.repeat(np.arange(n), np.diff(first))
        h = span_hash(low, ws, we)
        distinct, most = _repeats(h, wrow, n)
        same = np.zeros(len(h), bool)
        same[1:] = (h[1:] == h[:-1]) & (wrow[1:] == wrow[:-1])
        line = np.zeros(256, bool)
        line[:] = True
        line[10] = False
        ls, le, lfirst = word_spans(low, off, line)
        lines = np.diff(lfirst).astype(np.float64)
        ldistinct, _ = _repeats(span_hash(low, ls, le), np.repeat(np.arange(n), np.diff(lfirst)), n)
        signed = _KIND[data[np.maximum(we - 1, 0)]] == 3
        chars, w1, l1 = np.maximum(size, 1), np.maximum(words, 1), np.maximum(lines, 1)
        letters = np.maximum(kind[:, 0] + kind[:, 1] + kind[:, 5], 1)
        share = kind / chars[:, None]
        out[a:b] = np.stack(
            [
                np.log1p(size), np.log1p(words), np.bincount(wrow, we - ws, n) / w1, kind[:, 1] / letters, share[:, 2], share[:, 3], share[:, 4], share[:, 5], share[:, 6],
                np.log1p(lines), np.log1p(size / l1), distinct / w1, most / w1, ldistinct / l1, np.bincount(wrow, same, n) / w1, np.log1p(words / np.maximum(kind[:, 4], 1)),
                np.bincount(wrow, we - ws > 20, n) / w1, np.bincount(wrow, signed, n) / w1,
            ],
            1,
        )
    return out


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def _leaf(g, h):
    return g / (h + 1.0)


def _gain(g, h):
    return g * g / (h + 1.0)


def _tree(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Values by bin of the best tree of two splits along one feature, from sums of gradients and curvatures by bin."""
    n = len(g)
    bounds = [0, n]
    for _ in range(2):
        best = (1e-9, None)
        cg, ch = np.concatenate([[0], np.cumsum(g)]), np.concatenate([[0], np.cumsum(h)])
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            if b - a > 1:
                k = np.arange(a + 1, b)
                gain = _gain(cg[k] - cg[a], ch[k] - ch[a]) + _gain(cg[b] - cg[k], ch[b] - ch[k]) - _gain(cg[b] - cg[a], ch[b] - ch[a])
                i = int(gain.argmax())
                if gain[i] > best[0]:
                    best = (gain[i], int(k[i]))
        if best[1] is None:
            break
        bounds = sorted([*bounds, best[1]])
    out = np.zeros(n)
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        out[a:b] = _leaf(g[a:b].sum(), h[a:b].sum())
    return out


def _grid_tree(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """The best split along one axis, then along the other on either side."""
    best, out = -1.0, np.zeros_like(g)
    for flip in (False, True):
        gg, hh = (g.T, h.T) if flip else (g, h)
        for k in range(1, gg.shape[0]):
            value, total = np.zeros_like(gg), 0.0
            for a, b in ((0, k), (k, gg.shape[0])):
                pg, ph = np.cumsum(gg[a:b].sum(0)), np.cumsum(hh[a:b].sum(0))
                gain = _gain(pg[:-1], ph[:-1]) + _gain(pg[-1] - pg[:-1], ph[-1] - ph[:-1])
                i = int(gain.argmax())
                total += gain[i]
                value[a:b, : i + 1] = _leaf(pg[i], ph[i])
                value[a:b, i + 1 :] = _leaf(pg[-1] - pg[i], ph[-1] - ph[i])
            if total > best:
                best, out = total, value.T if flip else value
    return out


class AdditiveModel:
    """bias, edges of each feature's bins, a table a feature, and tables over coarse bins of pairs."""

    def __init__(self, bias: float, edges: list[np.ndarray], tables: list[np.ndarray], pairs: list[tuple[int, int, np.ndarray]]):
        self.bias, self.edges, self.tables, self.pairs = bias, edges, tables, pairs

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], "right") for j, e in enumerate(self.edges)], 1) if self.edges else np.zeros((len(x), 0), np.int64)

    def coarse(self, bins: np.ndarray, j: int) -> np.ndarray:
        return bins[:, j] * COARSE // (len(self.edges[j]) + 1)

    def logits(self, x: np.ndarray) -> np.ndarray:
        b = self.bins(x)
        out = np.full(len(x), self.bias)
        for j, t in enumerate(self.tables):
            out += t[b[:, j]]
        for i, j, t in self.pairs:
            out += t[self.coarse(b, i), self.coarse(b, j)]
        return out

    def scores(self, x: np.ndarray) -> np.ndarray:
        return _sigmoid(self.logits(x))


def train(x: np.ndarray, y: np.ndarray) -> AdditiveModel:
    n = len(y)
    share = float(np.clip(y.mean(), 0.02, 0.98)) if n else 0.5
    bias = float(np.log(share / (1 - share)))
    if not n or y.min() == y.max():
        return AdditiveModel(bias, [], [], [])
    edges = [np.unique(np.quantile(x[:, j], np.arange(1, BINS) / BINS)) for j in range(x.shape[1])]
    model = AdditiveModel(bias, edges, [np.zeros(len(e) + 1) for e in edges], [])
    bins, f = model.bins(x), np.full(n, bias)
    for _ in range(ROUNDS):
        for j, t in enumerate(model.tables):
            p = _sigmoid(f)
            step = RATE * _tree(np.bincount(bins[:, j], y - p, len(t)), np.bincount(bins[:, j], p * (1 - p), len(t)))
            t += step
            f += step[bins[:, j]]
    p = _sigmoid(f)
    found = []
    cells = {}
    for i in range(x.shape[1]):
        for j in range(i):
            cells[i, j] = model.coarse(bins, i) * COARSE + model.coarse(bins, j)
            g, h = np.bincount(cells[i, j], y - p, COARSE**2), np.bincount(cells[i, j], p * (1 - p), COARSE**2)
            found.append((float(_gain(g, h).sum()), i, j))
    best = [(i, j) for _, i, j in sorted(found, reverse=True)[:PAIRS]]
    model.pairs = [(i, j, np.zeros((COARSE, COARSE))) for i, j in best]
    for _ in range(PAIR_ROUNDS):
        for i, j, t in model.pairs:
            p, cell = _sigmoid(f), cells[i, j]
            g, h = np.bincount(cell, y - p, COARSE**2), np.bincount(cell, p * (1 - p), COARSE**2)
            step = RATE * _grid_tree(g.reshape(COARSE, COARSE), h.reshape(COARSE, COARSE))
            t += step
            f += step.ravel()[cell]
    return model


def _feature_lists(column: pa.Array) -> pa.Array:
    return pa.array(list(features(column)), pa.list_(pa.float64()))


def fit(docs: DataFrame, labels: DataFrame, allowed) -> AdditiveModel:
    """Learns from the labelled rows for which the Column ``allowed`` (over labels' columns) is true."""
    rows = labelled_sample(docs, labels, "quality", allowed, PER_CLASS, None, _feature_lists, "array<double>").collect()  # 2 * PER_CLASS rows of features
    rows.sort(key=lambda r: r["doc_id"])
    return train(np.array([r["x"] for r in rows]).reshape(len(rows), len(FEATURES)), np.array([int(r["_label"]) for r in rows], np.float64))


def score(docs: DataFrame, model: AdditiveModel, keep: list[str], name: str = "score") -> DataFrame:
    """Columns ``keep`` of docs, of other names than ``name``, with the probability of label 1."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        model = sent.value
        for batch in batches:
            s = model.scores(features(batch.column(0)))
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(1, batch.num_columns)), pa.array(s)], [*keep, name])

    passed = docs.select(F.col("text").alias(unused("_text", keep)), *keep)
    return passed.mapInArrow(tidy(run), extended(docs.select(*keep), f"{name} double"))


def held_out():
    """Rows whose labels are never learnt."""
    return crc_mod(F.col("doc_id"), 5) == 0


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted for every row."""
    model = fit(docs, labels, ~held_out())
    out = score(docs, model, ["doc_id"])
    return out.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs without those that score under THRESHOLD; the model learns from the same documents' labels."""
    model = fit(docs, labels, ~held_out())
    name = unused("_quality", docs.columns)
    return score(docs, model, docs.columns, name).where(F.col(name) >= THRESHOLD).select(*docs.columns)
