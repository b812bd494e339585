"""Substring dedup: runs of RUN consecutive sentences, and every passage of PASSAGE words wherever it begins and ends.

A sentence ends after ``.``, ``!`` or ``?`` before white space, and at each line end; it is compared by its words
(``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``, A-Z lower-cased) and is none without words. A run that stands elsewhere too loses all its
places but the first (least doc_id, then least place), however short it is. The same holds for a run that one document repeats.
A document of fewer sentences than a run is one run.

A passage is PASSAGE consecutive words of a document, whatever stands between them. Of each PASSAGE - GRAM + 1 consecutive
GRAM-word runs those of least hash are its anchors, so equal passages have equal anchors. Around anchors that stand twice all
passages are hashed and joined; their words go from all places but the first. Places wholly in removed runs of sentences don't
count. A cut that begins or ends with a sentence takes the signs around its words too. n_removed and spans count sentences that
go whole or in part.

Runs and passages are told apart by 96 bits: two polynomials of different bases over the hashes of their words.

Cases: null or empty text has no sentences and stays as it is; a row without doc_id comes after all others; rows that repeat a
doc_id count as one document whose row with the same text comes first, so equal rows are all kept; an empty table gives none.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, drop_shuffles, extended, lut, materialize, mix, powers, release, slices, span_hash, tidy, unused, word_spans

RUN = 4
PASSAGE, GRAM = 51, 20
#: Bases of the two polynomials.
_P = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_STEP = np.random.default_rng(20240301).integers(0, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_STOP = np.zeros(256, bool)
_STOP[[ord(c) for c in ".!?"]] = True


class _Words:
    """The words of a slice's rows: start and end bytes, where each row's begin, and hashes of word runs."""

    def __init__(self, data: np.ndarray, off: np.ndarray):
        low = LOWER[data]
        self.start, self.end, self.first = word_spans(low, off, lut("alnum"))
        # words weighted by place: powers of an odd number, taken from the running sum over the slice
        self.n = len(self.start)
        self._words = span_hash(low, self.start, self.end)
        self._sums: dict[int, np.ndarray] = {}

    def hashes(self, a: np.ndarray, b: np.ndarray, which: int = 0) -> np.ndarray:
        """64-bit hashes of the words a to b, b exclusive; which: of two that have nothing to do with each other."""
        if which not in self._sums:
            self._sums[which] = out = np.zeros(self.n + 1, np.uint64)
            np.cumsum((mix(self._words ^ np.uint64(_P[1])) if which else self._words) * powers(_P[which], self.n + 1)[: self.n], out=out[1:])
        upto = self._sums[which]
        return mix((upto[b] - upto[a]) * powers(pow(_P[which], -1, 1 << 64), self.n + 1)[a] ^ (b - a).astype(np.uint64))

    def keys(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """64 and 32 bits of the words a to b."""
        return self.hashes(a, b).view(np.int64), (self.hashes(a, b, 1) >> np.uint64(32)).astype(np.uint32).view(np.int32)


def sentences(data: np.ndarray, off: np.ndarray, words: _Words):
    """Of a slice's rows: start and end bytes, first words and words of sentences with words, and where each row's begin."""
    n = len(data)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, z, z, np.zeros(len(off), np.int64)
    ws = words.start
    brk = np.zeros(n + 1, bool)  # a sentence begins here
    brk[0] = brk[off[off < n]] = True
    brk[1:] |= data == 10
    brk[1:-1] |= _STOP[data[:-1]] & _SPACE[data[1:]]
    begin = np.flatnonzero(brk[:n])
    end = np.append(begin[1:], n)
    a, b = np.searchsorted(ws, begin), np.searchsorted(ws, end)
    has = b > a
    begin, end, a, b = begin[has], end[has], a[has], b[has]
    return begin, end, a, b - a, np.searchsorted(begin, off)


def _bounds(hit: np.ndarray) -> list[tuple[int, int]]:
    """Begins and ends of runs of true values, the first and last being false and not counted."""
    return list(zip(np.flatnonzero(hit[1:] & ~hit[:-1]).tolist(), np.flatnonzero(~hit[1:] & hit[:-1]).tolist(), strict=True))


def _slide(x: np.ndarray, size: int, of) -> np.ndarray:
    """of (minimum or maximum) over each size consecutive values."""
    have = 1
    while have < size:
        step = min(have, size - have)
        x = of(x[:-step], x[step:])
        have += step
    return x


def _open(gone: np.ndarray) -> np.ndarray:
    """By a passage's first word: whether any of its words stays."""
    stay = np.append(0, np.cumsum(~gone))
    return stay[PASSAGE:] > stay[:-PASSAGE]


def anchors(words: _Words, gone: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, number of the first word in it and hash of each anchor of a passage that isn't wholly ``gone``."""
    none = np.zeros(0, np.int64)
    if words.n < PASSAGE:
        return none, none, np.zeros(0, np.int64)
    at = np.arange(words.n - GRAM + 1)
    h = words.hashes(at, at + GRAM)
    width = PASSAGE - GRAM + 1
    least = _slide(h, width, np.minimum)  # by a passage's first word
    row = np.repeat(np.arange(len(words.first) - 1), np.diff(words.first))
    least[row[: len(least)] != row[PASSAGE - 1 :]] = 0  # no passage crosses rows
    if gone is not None:
        least[~_open(gone)] = 0
    edge = np.zeros(width - 1, np.uint64)
    most = _slide(np.concatenate([edge, least, edge]), width, np.maximum)  # over the passages that hold the run
    at = np.flatnonzero((most == h) & (h > 0))
    return row[at], at - words.first[row[at]], h[at].view(np.int64)


def runs(h: np.ndarray, second: np.ndarray, first: np.ndarray, run: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row, number of the first sentence and 64 and 32 bits of each run; h and second: of sentences, two hashes each."""
    count = np.diff(first)
    m = np.where(count >= run, count - run + 1, np.minimum(count, 1))
    row = np.repeat(np.arange(len(count)), m)
    at = np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
    size = np.minimum(run, count)[row]
    x, y = np.zeros(len(row), np.uint64), np.zeros(len(row), np.uint64)
    for j in range(run):
        ok = j < size
        own = (first[row] + at)[ok] + j
        x[ok] += h[own] * _STEP[2 * j % 64]
        y[ok] += second[own] * _STEP[(2 * j + 1) % 64]
    x, y = mix(x ^ size.astype(np.uint64)), mix(y ^ size.astype(np.uint64))
    return row, at, x.view(np.int64), (y >> np.uint64(32)).astype(np.uint32).view(np.int32)


def _gone_spans(listed: list[int] | None, n: int, run: int) -> list[tuple[int, int]]:
    """A row's spans of its n sentences to remove; listed: where runs begin."""
    if not listed:
        return []
    hit = np.zeros(n + 2, bool)
    for i in listed:
        hit[i + 1 : min(i + run, n) + 1] = True
    return _bounds(hit)


def _gone_words(data: np.ndarray, off: np.ndarray, w: _Words, listed: list, run: int) -> np.ndarray:
    """Whether each word of a slice is in a removed span."""
    gone = np.zeros(w.n, bool)
    if any(listed):
        _, _, head, words, first = sentences(data, off, w)
        for r, at in enumerate(listed):
            lo, hi = first[r], first[r + 1]
            for s, t in _gone_spans(at, hi - lo, run):
                gone[head[lo + s] : head[lo + t - 1] + words[lo + t - 1]] = True
    return gone


def _anchors_of(run: int):
    def go(batches):
        for batch in batches:
            ids, listed = batch.column(1), batch.column(2).to_pylist()
            for a, b, data, off in slices(batch.column(0)):
                w = _Words(data, off)
                row, at, h = anchors(w, _gone_words(data, off, w, listed[a:b], run))
                yield pa.RecordBatch.from_arrays([pa.array(h), ids.slice(a, b - a).take(pa.array(row)), pa.array(at.astype(np.int32))], ["x", "doc_id", "at"])

    return go


def _passages_of(run: int):
    """All passages that hold one of the listed anchors and aren't wholly removed."""

    def go(batches):
        for batch in batches:
            ids, listed, grams = batch.column(1), batch.column(2).to_pylist(), batch.column(3)
            for a, b, data, off in slices(batch.column(0)):
                w = _Words(data, off)
                lists = grams.slice(a, b - a)
                row = np.repeat(np.arange(b - a), lists.value_lengths().to_numpy())
                gram = lists.flatten().to_numpy() + w.first[row]
                near = np.zeros(w.n + 1, np.int64)
                np.add.at(near, np.maximum(gram + GRAM - PASSAGE, w.first[row]), 1)
                np.add.at(near, gram + 1, -1)
                at = np.flatnonzero(np.cumsum(near)[: w.n])
                row = np.searchsorted(w.first, at, "right") - 1
                ok = at + PASSAGE <= w.first[row + 1]
                at, row = at[ok], row[ok]
                if len(at):
                    ok = _open(_gone_words(data, off, w, listed[a:b], run))[at]
                    at, row = at[ok], row[ok]
                x, y = w.keys(at, at + PASSAGE)
                yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(y), ids.slice(a, b - a).take(pa.array(row)), pa.array((at - w.first[row]).astype(np.int32))], ["x", "y", "doc_id", "at"])

    return go


def _runs_of(run: int):
    def go(batches):
        for batch in batches:
            ids = batch.column(1)
            for a, b, data, off in slices(batch.column(0)):
                w = _Words(data, off)
                _, _, head, words, first = sentences(data, off, w)
                row, at, x, y = runs(w.hashes(head, head + words), w.hashes(head, head + words, 1), first, run)
                yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(y), ids.slice(a, b - a).take(pa.array(row)), pa.array(at.astype(np.int32))], ["x", "y", "doc_id", "at"])

    return go


def _remover(own: list[str], run: int):
    text_at = own.index("text")

    def go(batches):
        for batch in batches:
            column = batch.column(text_at)
            listed, repeated = batch.column(len(own)).to_pylist(), batch.column(len(own) + 1).to_pylist()
            texts, n_sentences, n_removed, spans = [], [], [], []
            for a, b, data, off in slices(column):
                w = _Words(data, off)
                begin, end, head, words, first = sentences(data, off, w)
                raw = data.tobytes()
                for r in range(b - a):
                    lo, hi, text = first[r], first[r + 1], raw[off[r] : off[r + 1]]
                    own_spans = []
                    if listed[a + r] or repeated[a + r]:
                        touched, cuts = np.zeros(hi - lo + 2, bool), []
                        left = np.zeros(w.first[r + 1] - w.first[r] + 2, bool)  # words of repeated passages
                        for i in repeated[a + r] or ():
                            left[i + 1 : i + PASSAGE + 1] = True
                        for s, t in _gone_spans(listed[a + r], hi - lo, run):
                            touched[s + 1 : t + 1] = True
                            cuts.append((begin[lo + s], end[lo + t - 1]))
                            left[head[lo + s] - w.first[r] + 1 : head[lo + t - 1] + words[lo + t - 1] - w.first[r] + 1] = False
                        for s, t in _bounds(left):
                            s, t = s + w.first[r], t + w.first[r]
                            i, j = np.searchsorted(head[lo:hi], [s, t - 1], "right") - 1
                            touched[i + 1 : j + 2] = True
                            cuts.append((begin[lo + i] if head[lo + i] == s else w.start[s], end[lo + j] if head[lo + j] + words[lo + j] == t else w.end[t - 1]))
                        if cuts:
                            own_spans = [{"start": s, "end": t} for s, t in _bounds(touched)]
                            out, done = [], 0
                            for s, t in sorted(cuts):
                                out.append(text[done : s - off[r]])
                                done = t - off[r]
                            text = b"".join([*out, text[done:]])
                    texts.append(text)
                    n_sentences.append(hi - lo)
                    n_removed.append(sum(s["end"] - s["start"] for s in own_spans))
                    spans.append(own_spans)
            clean = pa.array(texts, pa.binary(), mask=np.asarray(column.is_null())).cast(pa.string())
            made = [clean, pa.array(n_sentences, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(own))), *made], [*own, "kept_text", "n_sentences", "n_removed", "spans"])

    return go


def _not_first(spans: DataFrame, name: str) -> DataFrame:
    """doc_id, at of a written table's rows that aren't the first of their kind (x, y)."""
    # nulls last; minima are combined map-side, so a run that most documents share is no burden
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "at")
    firsts = spans.groupBy("x", "y").agg(F.min(place).alias("f"), F.count("*").alias("n")).where("n > 1").select("x", "y", "f")
    firsts = materialize(firsts, name)
    return spans.join(firsts, ["x", "y"]).where(~(F.col("doc_id").eqNullSafe(F.col("f.doc_id")) & (F.col("at") == F.col("f.at")))).select("doc_id", "at")


def _lists(places: DataFrame, name: str) -> DataFrame:
    return places.groupBy(F.col("doc_id").alias("_doc")).agg(F.array_sort(F.collect_set("at")).alias(name))


def _with_lists(docs: DataFrame, lists: DataFrame, how: str = "left") -> DataFrame:
    doc = unused("_doc", docs.columns)
    return docs.join(lists.withColumnRenamed("_doc", doc), docs["doc_id"].eqNullSafe(F.col(doc)), how).drop(doc)


def repeated_runs(docs: DataFrame, run: int = RUN) -> DataFrame:
    """doc_id, at: first sentences of all runs that aren't the first of their kind."""
    spans = materialize(docs.select("text", F.col("doc_id").cast("long")).mapInArrow(tidy(_runs_of(run)), "x long, y int, doc_id long, at int"), "sentence-runs")
    out = materialize(_not_first(spans, "sentence-firsts"), "sentence-gone")
    release(docs.sparkSession, spans)
    return out


def repeated_passages(docs: DataFrame, run: int) -> DataFrame:
    """doc_id, at: first words of all passages that aren't the first of their kind. docs: a written table with _at, a row's repeated runs."""
    spark, docs = docs.sparkSession, docs.select("text", F.col("doc_id").cast("long"), "_at")
    found = materialize(docs.mapInArrow(tidy(_anchors_of(run)), "x long, doc_id long, at int"), "passage-anchors")
    twice = found.groupBy("x").agg(F.count("*").alias("n")).where("n > 1").select("x")
    near = materialize(_lists(found.join(twice, "x"), "_grams"), "passage-near")
    release(spark, found)
    drop_shuffles(spark)
    near = _with_lists(docs, near, "inner").select("text", "doc_id", "_at", "_grams")
    spans = materialize(near.mapInArrow(tidy(_passages_of(run)), "x long, y int, doc_id long, at int"), "passages")
    del near
    drop_shuffles(spark)
    out = materialize(_lists(_not_first(spans, "passage-firsts"), "_words"), "passage-gone")
    release(spark, spans)
    drop_shuffles(spark)
    return out


def dedup_substrings(docs: DataFrame, run: int = RUN) -> DataFrame:
    """docs with kept_text, n_sentences, n_removed and spans (of sentences, end exclusive); own columns of these names go."""
    own = [c for c in docs.columns if c not in ("kept_text", "n_sentences", "n_removed", "spans")]
    schema = extended(docs.select(*own), "kept_text string, n_sentences long, n_removed long, spans array<struct<start:long,end:long>>")
    at, words = unused("_at", own), unused("_words", own)
    docs = materialize(_with_lists(docs.select(*own), _lists(repeated_runs(docs.select(*own), run), at)), "substring-docs")
    drop_shuffles(docs.sparkSession)
    passages = repeated_passages(docs.select("text", "doc_id", F.col(at).alias("_at")), run).withColumnRenamed("_words", words)
    return _with_lists(docs, passages).select(*own, at, words).mapInArrow(tidy(_remover(own, run)), schema)
