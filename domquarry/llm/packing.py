"""Lexical retrieval packing: a sharded BM25 inverted index returns unused neighbours, which fill a seed's window.

A document is its token ids and an end id 0. Documents are routed to shards by content: each has two minwise tokens, drawn with
weights that grow with the token's number, as rare tokens have high ones; rows are range-partitioned and sorted by them, so
documents that share rare tokens stand together, at every size of the corpus. A third key splits groups that share both, however
many rows they hold. A shard is a run of documents of that order, SHARD_DOCS or SHARD_TOKENS at most (one document at least). Document
frequencies, the number of documents and their mean length come from all documents.

In a shard, the document that begins a window is its seed; all its terms are looked up in the shard's inverted index, and the
unused document of highest BM25 score (ties: the earliest) comes next, until the window is full. Weights are multiples of
2 ** -30, so that sums are exact in any order and ties are ties. What overflows begins the next window. So sequences are full but
for a shard's last; that is cut into powers of two, which need no padding: no padding at all. Documents without a neighbour are
followed by the first unused one.

Cases: null text is empty and is one piece of the end id; rows that repeat a doc_id are each packed; an empty table gives none.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokens
from .common import materialize, mix, tidy

WINDOW, SHARD_DOCS, SHARD_TOKENS = 1024, 1024, 1 << 21
K1, B = 1.2, 0.75
#: Postings whose weights are summed at once.
POSTINGS = 1 << 17
END = 0


def _unique(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct ids in order, and how often each stands."""
    s = np.sort(ids)
    edge = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]])) if len(s) else np.zeros(0, np.int64)
    return s[edge], np.diff(np.append(edge, len(s))).astype(np.int32)


_DRAWS: list[np.ndarray] = [np.zeros((2, 0), np.float32)]


def routes(terms: np.ndarray) -> tuple[int, int]:
    """Two minwise tokens of a set of tokens, -1 if there is none: sets share one with the probability of their weighted similarity."""
    if not len(terms):
        return -1, -1
    if terms[-1] >= _DRAWS[0].shape[1]:
        n = max(1 << 16, 1 << int(terms[-1] + 1).bit_length())
        h = mix(np.arange(2 * n, dtype=np.uint64).reshape(2, n) + np.uint64(0x9E3779B97F4A7C15))
        _DRAWS[0] = (-np.log((h >> np.uint64(40)) / float(1 << 24) + 1e-9) / np.arange(1, n + 1)).astype(np.float32)
    at = _DRAWS[0][:, terms].argmin(1)
    return int(terms[at[0]]), int(terms[at[1]])


def _tokenize(path: str):
    def run(batches):
        e = tokens.encoder(path)
        row = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 33
        df = np.zeros(1 << 16, np.int64)
        for batch in batches:
            n, ids, keys = [], [], []
            for x in tokens.encode_rows(batch.column(0), e):
                n.append(len(x) + 1)
                terms = _unique(x)[0]
                if len(terms) and terms[-1] >= len(df):
                    df = np.concatenate([df, np.zeros(int(terms[-1]) + 1, np.int64)])
                df[terms] += 1
                keys.append(routes(terms))
                ids.append(x.astype(np.uint32).tobytes() if e.fast is None else x.tobytes())
            k = np.array(keys, np.int32).reshape(-1, 2)
            split = mix(np.arange(row, row + len(n)).astype(np.uint64)).view(np.int64)
            row += len(n)
            columns = [batch.column(1), pa.array(n, pa.int64()), pa.array(ids, pa.binary()), pa.nulls(len(n), pa.binary()), pa.array(k[:, 0]), pa.array(k[:, 1]), pa.array(split)]
            yield pa.RecordBatch.from_arrays(columns, _ENCODED)
        if df.any():
            terms = np.flatnonzero(df)
            packed = np.stack([terms, df[terms]], 1).astype(np.int64).tobytes()
            none = [pa.nulls(1, t) for t in (pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.int32(), pa.int64())]
            yield pa.RecordBatch.from_arrays([*none[:3], pa.array([packed], pa.binary()), *none[3:]], _ENCODED)

    return run


def _frequencies(batches):
    for batch in batches:
        for packed in batch.column(0):
            x = np.frombuffer(packed.as_buffer(), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(x[:, 0]), pa.array(x[:, 1])], ["term", "df"])


class Shard:
    """The inverted index of a shard's documents."""

    def __init__(self, docs: list[np.ndarray], idf: np.ndarray, mean: float):
        sets = [_unique(x) for x in docs]
        self.terms = [s for s, _ in sets]
        doc = np.repeat(np.arange(len(docs), dtype=np.int32), [len(s) for s in self.terms])
        term = np.concatenate(self.terms)
        tf = np.concatenate([t for _, t in sets]).astype(np.float64)
        del sets
        norm = K1 * (1 - B + B * np.array([len(x) for x in docs], np.float64) / max(mean, 1.0))
        weight = idf[term]  # in place, as a shard may have two million postings: idf * tf * (K1 + 1) / (tf + norm)
        weight *= tf
        weight *= K1 + 1
        tf += norm[doc]
        weight /= tf
        del tf
        order = np.argsort(term, kind="stable")
        self.doc = doc[order]
        del doc
        self.weight = weight[order]
        del weight, order
        self.weight *= 1 << 30
        np.rint(self.weight, out=self.weight)
        self.first = np.append(0, np.cumsum(np.bincount(term, minlength=len(idf))))
        self.n = len(docs)
        self._scored, self._scores = -1, np.zeros(self.n)

    def scores(self, seed: int) -> np.ndarray:
        """BM25 of all documents for the seed's terms, in units of 2 ** -30; the last seed's are kept."""
        if seed != self._scored:
            terms = self.terms[seed].astype(np.int64)
            a, size = self.first[terms], self.first[terms + 1] - self.first[terms]
            upto = np.cumsum(size)
            self._scored, self._scores = seed, np.zeros(self.n)
            lo = 0
            while lo < len(terms):  # POSTINGS at a time (one term at least), as a long seed has most of the index
                hi = max(lo + 1, int(np.searchsorted(upto, upto[lo] - size[lo] + POSTINGS, "right")))
                n = size[lo:hi]
                at = np.repeat(a[lo:hi] - (np.cumsum(n) - n), n) + np.arange(n.sum())
                self._scores += np.bincount(self.doc[at], self.weight[at], self.n)
                lo = hi
        return self._scores

    def neighbour(self, seed: int, unused: np.ndarray) -> int:
        """The unused document of highest score, -1 if none shares a term."""
        score = self.scores(seed) * unused
        best = int(score.argmax())
        return best if score[best] > 0 else -1

    def _compact(self, unused: np.ndarray) -> None:
        """Takes used documents out of the index."""
        keep = unused[self.doc]
        self.first = np.append(0, np.cumsum(keep))[self.first]
        self.doc, self.weight = self.doc[keep], self.weight[keep]

    def order(self, lengths: list[int], window: int) -> list[int]:
        """Documents in the order in which they fill windows. The index shrinks with the documents that are left."""
        unused = np.ones(self.n, bool)
        out: list[int] = []
        at = seed = 0
        held = self.n
        for i in range(self.n):
            if 4 * (self.n - i) < 3 * held:
                held = self.n - i
                self._compact(unused)
            if at % window == 0 or i == 0:
                nxt = int(unused.argmax())
                seed = nxt
            else:
                nxt = self.neighbour(seed, unused)
                if nxt < 0:
                    nxt = int(unused.argmax())
            unused[nxt] = False
            out.append(nxt)
            if at // window != (at + lengths[nxt] - 1) // window:
                seed = nxt  # its rest begins the next window
            at += lengths[nxt]
        return out


def cut_points(total: int, window: int) -> np.ndarray:
    """Where sequences begin, and the end: full windows, then powers of two."""
    points = [*range(0, total - total % window + 1, window)]
    for bit in range(window.bit_length() - 1, -1, -1):
        if total % window >> bit & 1:
            points.append(points[-1] + (1 << bit))
    return np.array(points, np.int64)


_ENCODED = ["doc_id", "n", "ids", "df", "k1", "k2", "split"]
_PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def _packer(sent, wide: bool, window: int, with_ids: bool):
    names = [x.split()[0] for x in _PIECES.split(", ")] + ["ids"] * with_ids

    def run(batches):
        idf, mean = sent.value
        sequence = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 40
        held_ids: list = []
        held: list[np.ndarray] = []
        size = 0

        def flush():
            nonlocal sequence
            lengths = [len(x) + 1 for x in held]
            order = Shard(held, idf, mean).order(lengths, window)
            end = np.full(1, END, held[0].dtype)
            stream = np.concatenate([y for d in order for y in (held[d], end)]).astype("<u4")
            ends = np.cumsum([lengths[d] for d in order])
            begins = ends - np.array([lengths[d] for d in order])
            points = cut_points(int(ends[-1]), window)
            at = np.union1d(begins, points[:-1])
            stop = np.append(at[1:], ends[-1])
            which = np.searchsorted(ends, at, "right")
            seq = np.searchsorted(points, at, "right") - 1
            raw = stream.tobytes()
            crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(at.tolist(), stop.tolist(), strict=True)]
            doc = np.array(order)[which]
            columns = [pa.array([held_ids[d] for d in doc], pa.int64()), pa.array(at - begins[which]), pa.array(stop - at), pa.array(crc, pa.int64()), pa.array(np.array(lengths, np.int64)[doc]), pa.array(sequence + seq), pa.array(at - points[seq])]
            if with_ids:
                offs = pa.array(np.append(at, ends[-1]).astype(np.int32))
                columns.append(pa.ListArray.from_arrays(offs, pa.array(stream.astype(np.int32))))
            sequence += len(points) - 1
            held.clear()
            held_ids.clear()
            return pa.RecordBatch.from_arrays(columns, names)

        for batch in batches:
            for doc, ids in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                x = np.frombuffer(ids.as_buffer(), np.uint32 if wide else np.uint16)
                if held and (len(held) == SHARD_DOCS or size + len(x) > SHARD_TOKENS):
                    yield flush()
                    size = 0
                held.append(x)
                held_ids.append(doc)
                size += len(x) + 1
        if held:
            yield flush()

    return run


def pack(docs: DataFrame, tokenizer: str | None = None, window: int = WINDOW, with_ids: bool = False) -> DataFrame:
    """Per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset; with_ids adds the ids themselves."""
    path = tokenizer or tokens.default_path()
    encoded = materialize(docs.select("text", F.col("doc_id").cast("long")).mapInArrow(tidy(_tokenize(path)), "doc_id long, n long, ids binary, df binary, k1 int, k2 int, split long"), "packing-ids")
    # one row a term: the vocabulary bounds what comes to the driver
    terms = encoded.where("df IS NOT NULL").select("df").mapInArrow(tidy(_frequencies), "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).collect()
    n_docs, total = encoded.where("n IS NOT NULL").agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = np.zeros(max([1 << 16, *(r["term"] + 1 for r in terms)]), np.float64)
    df[[r["term"] for r in terms]] = [r["df"] for r in terms]
    idf = np.log1p((n_docs - df + 0.5) / (df + 0.5))
    sent = docs.sparkSession.sparkContext.broadcast((idf, total / max(1, n_docs)))
    wide = tokens.PieceEncoder._ranks(path) is None
    # the sample for the ranges reads the keys only, not the ids
    routed = encoded.where("n IS NOT NULL").select("doc_id", "ids", "k1", "k2", "split").repartitionByRange("k1", "k2", "split").sortWithinPartitions("k1", "k2", "split")
    return routed.select("doc_id", "ids").mapInArrow(tidy(_packer(sent, wide, window, with_ids)), _PIECES + ", ids array<int>" * with_ids)
