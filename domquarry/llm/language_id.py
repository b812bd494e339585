"""Language identification by error-correcting output codes.

Each language has a codeword of BITS signs, chosen to differ in many places. For each bit a linear classifier over character
n-grams (of 1 to 4 bytes of words, hashed) predicts the sign; decoding weighs each bit's logistic loss and takes the codeword of
least total. ``ambiguous`` marks texts whose best two codewords are near.

Training rows are a bounded sample of every language: PER_LANGUAGE rows of a language at most, by hash order of ids; beyond 64
languages, 64 * PER_LANGUAGE rows are shared out evenly. Of texts beyond MAX_CHARS a window of so many characters is learnt. The
tasks make their n-gram shares; only these come to the driver, sparse, and training expands BATCH rows at a time, in STEPS steps
whatever the number of languages. Prediction reads every whole text.

Cases: null text or text without a letter is ``und`` with score 0; without training rows all are ``und``; with one language
all texts with a letter are of it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_binary, crc_mod, extended, labelled_sample, tidy, unused
from .ngrams import LETTERS, sums, word_slices

BITS, SIZES, BUCKETS = 15, (1, 2, 3, 4), 1 << 13
PER_LANGUAGE, MAX_CHARS = 400, 4_000
STEPS, BATCH, RATE, SCALE = 400, 256, 0.03, 20.0
MARGIN = 0.2


def codewords(n: int, bits: int = BITS, tries: int = 300, seed: int = 11) -> np.ndarray:
    """n rows of signs: of many random draws, the one whose nearest rows are farthest; no bit is alike for all."""
    rng = np.random.default_rng(seed)
    bits = max(bits, int(np.ceil(np.log2(max(n, 2)))) * 3)
    best, least = None, (-1, -1.0)
    for _ in range(tries):
        c = rng.choice([-1, 1], (n, bits))
        if n > 1:
            flat = np.abs(c.sum(0)) == n
            c[0, flat] *= -1
            d = (bits - c @ c.T) / 2
            off = d[~np.eye(n, dtype=bool)]
            if (off.min(), off.mean()) > least:
                best, least = c, (off.min(), off.mean())
        else:
            best = c
    return best


class CodeModel:
    def __init__(self, languages: list[str], code: np.ndarray, table: np.ndarray, bias: np.ndarray):
        self.languages, self.code, self.table, self.bias = languages, code, table, bias

    def decode(self, f: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """f: rows of the bits' outputs. Best language, its share of exp(-loss), and its lead on the next."""
        loss = np.logaddexp(0, -f[:, None, :] * self.code[None]).sum(2)
        p = np.exp(loss.min(1, keepdims=True) - loss)
        p /= p.sum(1, keepdims=True)
        top = np.sort(p, 1)
        return p.argmax(1), top[:, -1], top[:, -1] - (top[:, -2] if p.shape[1] > 1 else 0)

    def predict(self, column: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
        n = len(column)
        lang, score, lead = ["und"] * n, np.zeros(n), np.zeros(n)
        if not self.languages:
            return lang, score, lead
        raw = as_binary(column)
        for a, b, w in word_slices(column, LETTERS):
            bucket, first = w.ngrams(SIZES, BUCKETS, False)
            total = sums(self.table[bucket], first)
            size = np.diff(first).astype(np.float64)
            by_row = sums(total[w.which], w.first)
            count = sums(size[w.which], w.first)
            best, p, gap = self.decode(self.bias + SCALE * by_row / np.maximum(count, 1)[:, None])
            for i in range(b - a):
                if count[i] and has_letter(raw[a + i].as_py()):
                    lang[a + i], score[a + i], lead[a + i] = self.languages[best[i]], p[i], gap[i]
        return lang, score, lead


_ASCII_LETTERS = bytes(range(0x41, 0x5B)) + bytes(range(0x61, 0x7B))
_NOT_LETTERS = bytes(b for b in range(256) if b not in set(_ASCII_LETTERS))


def has_letter(text: bytes) -> bool:
    head = text[:256]
    if len(head.translate(None, _NOT_LETTERS)) or len(text.translate(None, _NOT_LETTERS)):
        return True
    return not text.isascii() and any(map(str.isalpha, text.decode("utf-8", "replace")))


def _shares(column: pa.Array) -> pa.Array:
    """Of each text its buckets (16 bits each) and their shares among its n-grams (32 bits each), as bytes."""
    out = []
    for a, b, w in word_slices(column, LETTERS):
        bucket, first = w.ngrams(SIZES, BUCKETS, False)
        for i in range(b - a):
            places = w.which[w.first[i] : w.first[i + 1]]
            n = first[places + 1] - first[places]
            src = np.repeat(first[places] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            count = np.bincount(bucket[src], minlength=BUCKETS)
            at = np.flatnonzero(count)
            out.append(at.astype(np.uint16).tobytes() + (count[at] / max(1, len(src))).astype(np.float32).tobytes())
    return pa.array(out, pa.binary())


def _dense(shares: list[bytes]) -> np.ndarray:
    x = np.zeros((len(shares), BUCKETS), np.float32)
    for row, raw in zip(x, shares, strict=True):
        n = len(raw) // 6
        row[np.frombuffer(raw, np.uint16, n)] = np.frombuffer(raw[2 * n :], np.float32)
    return x


def train(shares: list[bytes], languages: list[str]) -> CodeModel:
    """shares: of texts, as _shares gives them."""
    names = sorted(set(languages))
    if not names:
        return CodeModel([], np.zeros((0, BITS)), np.zeros((BUCKETS, BITS), np.float32), np.zeros(BITS))
    code = codewords(len(names))
    number = {v: i for i, v in enumerate(names)}
    label = np.array([number[v] for v in languages])
    y = code[label].astype(np.float32)
    weight = (len(label) / (len(names) * np.bincount(label)[label])).astype(np.float32)  # languages weigh alike
    w = np.zeros((BUCKETS, code.shape[1]), np.float32)
    b = np.zeros(code.shape[1], np.float32)
    mw, vw, mb, vb = np.zeros_like(w), np.zeros_like(w), np.zeros_like(b), np.zeros_like(b)
    mean_w, mean_b, tail = np.zeros_like(w), np.zeros_like(b), STEPS // 2
    rng, order = np.random.default_rng(5), np.zeros(0, np.int64)
    for t in range(1, STEPS + 1):
        if len(order) < min(BATCH, len(label)):
            order = np.append(order, rng.permutation(len(label)))
        own, order = order[:BATCH], order[BATCH:]
        x = _dense([shares[i] for i in own]) * SCALE
        g = -y[own] / (1 + np.exp(np.clip(y[own] * (x @ w + b), -30, 30))) * (weight[own] / len(own))[:, None]
        gw, gb = x.T @ g + 1e-5 * w, g.sum(0)
        mw, mb = 0.9 * mw + 0.1 * gw, 0.9 * mb + 0.1 * gb
        vw, vb = 0.99 * vw + 0.01 * gw**2, 0.99 * vb + 0.01 * gb**2
        k, q = 1 - 0.9**t, 1 - 0.99**t
        w -= RATE * (mw / k) / (np.sqrt(vw / q) + 1e-8)
        b -= RATE * (mb / k) / (np.sqrt(vb / q) + 1e-8)
        if t > tail:  # the mean of the last half of the steps is steadier than the last
            mean_w += w / (STEPS - tail)
            mean_b += b / (STEPS - tail)
    return CodeModel(names, code, mean_w, mean_b.astype(np.float64))


def fit(docs: DataFrame, allowed, lang: str = "lang") -> CodeModel:
    """Learns from rows with text and a language for which the Column ``allowed`` is true."""
    known = docs.where(F.col("text").isNotNull()).select("doc_id", lang)
    # 64 * PER_LANGUAGE rows, or one a language, of 6 bytes an n-gram: some 8 kB each
    rows = labelled_sample(docs, known, lang, allowed, PER_LANGUAGE, MAX_CHARS, _shares, "binary").collect()
    rows.sort(key=lambda r: r["doc_id"])
    return train([bytes(r["x"]) for r in rows], [r["_label"] for r in rows])


def predict(docs: DataFrame, model: CodeModel, keep: list[str]) -> DataFrame:
    """Columns ``keep`` with lang_pred, score and ambiguous."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        model = sent.value
        for batch in batches:
            lang, score, lead = model.predict(batch.column(0))
            columns = [batch.column(i) for i in range(1, batch.num_columns)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(lang, pa.string()), pa.array(score), pa.array(lead < MARGIN)], [*keep, "lang_pred", "score", "ambiguous"])

    passed = docs.select(F.col("text").alias(unused("_text", keep)), *keep)
    return passed.mapInArrow(tidy(run), extended(docs.select(*keep), "lang_pred string, score double, ambiguous boolean"))


def languages(docs: DataFrame) -> DataFrame:
    """doc_id, held_out (no language of such a row is learnt), lang_pred, score and ambiguous for every row."""
    held = crc_mod(F.col("doc_id"), 3) == 1
    model = fit(docs, ~held)
    out = predict(docs, model, ["doc_id"])
    return out.select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "lang_pred", "score", "ambiguous")
