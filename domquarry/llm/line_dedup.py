"""Reversible line deduplication: sharded cuckoo filters over exact reference-count tables.

A line's key is the line without blanks (``[\\x20\\x09-\\x0D]``) at its ends, A-Z lower-cased. A key of at least
``min_chars`` code points found in at least ``min_docs`` documents is *hot*: it loses all its lines except those of the
largest doc_id that holds it. State is three tables: postings (key, doc_id, lines: the exact reference counts), hot keys
with their keepers, and one cuckoo filter a shard of the hot keys. Documents can be inserted and deleted: only keys that
the batch touches are counted again, and fingerprints are added to or taken out of the filters.

Cases: null or empty text is one empty line; a row without doc_id counts as no document and keeps no hot line; rows that
repeat a doc_id are one document for the counts and are each cleaned; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, as_binary, extended, materialize, tidy, unused

BLANKS = b" \t\n\x0b\x0c\r"
_LOWER = LOWER.tobytes()
KEY = ["hi", "lo"]


class CuckooFilter:
    """A set of 64-bit hashes with deletion: 16-bit fingerprints, four to a bucket, two buckets for each hash."""

    SLOTS, KICKS = 4, 500

    def __init__(self, capacity: int, table: np.ndarray | None = None):
        m = 1 << max(2, math.ceil(math.log2(max(1, capacity) / (self.SLOTS * 0.9) + 1)))
        self.table = np.zeros((m, self.SLOTS), np.uint16) if table is None else table
        self.mask = np.uint64(len(self.table) - 1)

    def places(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        h = np.asarray(h, np.uint64)
        fp = (h & np.uint64(0xFFFF)).astype(np.uint16)
        fp[fp == 0] = 1
        a = (h >> np.uint64(16)) & self.mask
        return fp, a.astype(np.int64), (a ^ self.other(fp)).astype(np.int64)

    def other(self, fp) -> np.ndarray:
        return ((np.asarray(fp, np.uint64) * np.uint64(0x5BD1E995C6A4A793)) >> np.uint64(20)) & self.mask

    def contains(self, h: np.ndarray) -> np.ndarray:
        fp, a, b = self.places(h)
        return ((self.table[a] == fp[:, None]) | (self.table[b] == fp[:, None])).any(1)

    def insert(self, h: np.ndarray) -> bool:
        """False if the filter is too full; it then lacks a fingerprint and must be built anew, larger."""
        rng = np.random.default_rng(0)
        for fp, a, b in zip(*self.places(h), strict=True):
            at, f = (a, b), fp
            for place in at:
                free = np.flatnonzero(self.table[place] == 0)
                if len(free):
                    self.table[place, free[0]] = f
                    break
            else:
                place = at[int(rng.integers(2))]
                for _ in range(self.KICKS):
                    slot = int(rng.integers(self.SLOTS))
                    f, self.table[place, slot] = self.table[place, slot], f
                    place = int(place ^ int(self.other(f)))
                    free = np.flatnonzero(self.table[place] == 0)
                    if len(free):
                        self.table[place, free[0]] = f
                        break
                else:
                    return False
        return True

    def delete(self, h: np.ndarray) -> None:
        """Takes out hashes that were inserted."""
        for fp, a, b in zip(*self.places(h), strict=True):
            for place in (a, b):
                slot = np.flatnonzero(self.table[place] == fp)
                if len(slot):
                    self.table[place, slot[0]] = 0
                    break

    def blob(self) -> bytes:
        return self.table.tobytes()

    @classmethod
    def of(cls, blob: bytes) -> CuckooFilter:
        return cls(0, np.frombuffer(blob, np.uint16).reshape(-1, cls.SLOTS).copy())


def line_keys(text: bytes, min_chars: int) -> list[tuple[int, bytes]]:
    """(number of the line, 16 bytes of hash of its key) of the lines with keys long enough."""
    found = []
    for i, line in enumerate(text.split(b"\n")):
        if len(line) >= min_chars:
            key = line.strip(BLANKS).translate(_LOWER)
            if len(key) >= min_chars and (key.isascii() or len(key.decode("utf-8", "replace")) >= min_chars):
                found.append((i, hashlib.blake2b(key, digest_size=16).digest()))
    return found


def _postings(docs: DataFrame, min_chars: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            texts, ids = as_binary(batch.column(0)), batch.column(1).to_pylist()
            keys, owners, lines = [], [], []
            for text, doc in zip(texts, ids, strict=True):
                own: dict[bytes, int] = {}
                if doc is not None:
                    for _, key in line_keys(text.as_py(), min_chars):
                        own[key] = own.get(key, 0) + 1
                keys += own
                lines += own.values()
                owners += [doc] * len(own)
            k = np.frombuffer(b"".join(keys), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(k[:, 0]), pa.array(k[:, 1]), pa.array(owners, pa.int64()), pa.array(lines, pa.int64())], ["hi", "lo", "doc_id", "n_lines"])

    rows = docs.select(F.col("text"), F.col("doc_id").cast("long")).mapInArrow(tidy(run), "hi long, lo long, doc_id long, n_lines long")
    # by key and document first: a key that most documents share is spread over all tasks
    return rows.groupBy(*KEY, "doc_id").agg(F.sum("n_lines").alias("n_lines"))


def _hot(postings: DataFrame, min_docs: int) -> DataFrame:
    return postings.groupBy(*KEY).agg(F.count("*").alias("n_docs"), F.max("doc_id").alias("keeper")).where(F.col("n_docs") >= min_docs)


def _shard(n: int):
    return F.pmod(F.col("hi"), F.lit(n)).cast("int")


def _filters(changes: DataFrame, old: DataFrame | None) -> DataFrame:
    """changes: shard, hi, lo, sign. Filters of the shards that change, with ``old`` ones carried on."""
    schema = "shard int, blob binary"

    def fresh(key, shard):
        h = shard.column("lo").to_numpy().view(np.uint64)
        size = len(h)
        while not (f := CuckooFilter(size)).insert(h):
            size *= 2
        return pa.table({"shard": pa.array([key[0].as_py()], pa.int32()), "blob": pa.array([f.blob()], pa.binary())})

    if old is None:
        return changes.groupBy("shard").applyInArrow(fresh, schema)

    def change(key, filters, rows):
        h, sign = rows.column("lo").to_numpy().view(np.uint64), rows.column("sign").to_numpy()
        f = CuckooFilter.of(filters.column("blob")[0].as_py()) if filters.num_rows else CuckooFilter(len(h))
        f.delete(h[sign < 0])
        whole = f.insert(h[sign > 0])
        blob = f.blob() if whole else None
        return pa.table({"shard": pa.array([key[0].as_py()], pa.int32()), "blob": pa.array([blob], pa.binary())})

    return old.groupBy("shard").cogroup(changes.groupBy("shard")).applyInArrow(change, schema)


class LineIndex:
    """The state of incremental line deduplication; each change gives a new index and leaves the old one as it is."""

    #: Hot keys up to this number (24 bytes each) are broadcast; beyond it the lines that pass the filters are joined by shuffle.
    BROADCAST_KEYS = 1 << 18
    KEYS_A_SHARD = 1 << 15
    #: Bytes of filters broadcast at once (some 14 million keys); with more, documents are read once for each such block of shards.
    FILTER_BYTES = 1 << 25

    def __init__(self, postings: DataFrame, hot: DataFrame, filters: DataFrame, shards: int, n_hot: int, min_chars: int, min_docs: int):
        self.postings, self.hot, self.filters = postings, hot, filters
        self.shards, self.n_hot, self.min_chars, self.min_docs = shards, n_hot, min_chars, min_docs

    @classmethod
    def build(cls, docs: DataFrame, min_chars: int = 40, min_docs: int = 5) -> LineIndex:
        return cls._of(materialize(_postings(docs, min_chars), "line-postings"), min_chars, min_docs)

    @classmethod
    def _of(cls, postings: DataFrame, min_chars: int, min_docs: int) -> LineIndex:
        hot = materialize(_hot(postings, min_docs), "line-hot")
        n_hot = hot.count()
        shards = max(1, -(-n_hot // cls.KEYS_A_SHARD))
        filters = materialize(_filters(hot.select(_shard(shards).alias("shard"), *KEY), None), "line-filters")
        return cls(postings, hot, filters, shards, n_hot, min_chars, min_docs)

    def _updated(self, postings: DataFrame, touched: DataFrame) -> LineIndex:
        """touched: the keys of the batch. Only they are counted again; only their fingerprints change."""
        now = materialize(_hot(postings.join(touched, KEY, "left_semi"), self.min_docs), "line-hot-now")
        was = self.hot.join(touched, KEY, "left_semi")
        came = now.join(was, KEY, "left_anti").select(*KEY, F.lit(1).alias("sign"))
        gone = was.join(now, KEY, "left_anti").select(*KEY, F.lit(-1).alias("sign"))
        hot = materialize(self.hot.join(touched, KEY, "left_anti").unionByName(now), "line-hot")
        filters = materialize(_filters(came.unionByName(gone).withColumn("shard", _shard(self.shards)), self.filters), "line-filters")
        if filters.where("blob IS NULL").limit(1).count():  # a filter ran full: build them all, over more shards
            return self._of(postings, self.min_chars, self.min_docs)
        return LineIndex(postings, hot, filters, self.shards, hot.count(), self.min_chars, self.min_docs)

    def insert(self, docs: DataFrame) -> LineIndex:
        """docs: documents that the index doesn't hold yet."""
        new = materialize(_postings(docs, self.min_chars), "line-new")
        both = self.postings.unionByName(new).groupBy(*KEY, "doc_id").agg(F.sum("n_lines").alias("n_lines"))
        return self._updated(materialize(both, "line-postings"), new.select(*KEY).distinct())

    def delete(self, ids: DataFrame) -> LineIndex:
        """ids: a column doc_id. Lines whose keys cease to be hot come back; keepers move on to the largest left."""
        gone = ids.select("doc_id").distinct()
        touched = materialize(self.postings.join(gone, "doc_id", "left_semi").select(*KEY).distinct(), "line-touched")
        return self._updated(materialize(self.postings.join(gone, "doc_id", "left_anti"), "line-postings"), touched)

    def apply(self, docs: DataFrame) -> DataFrame:
        """docs with columns kept_text, n_lines and n_dropped in place of any of those names."""
        own = [c for c in docs.columns if c not in ("kept_text", "n_lines", "n_dropped")]
        docs = docs.select(*own)
        schema = extended(docs, "kept_text string, n_lines long, n_dropped long")
        if self.n_hot <= self.BROADCAST_KEYS:
            return docs.mapInArrow(tidy(_applier(self, own)), schema)
        doc, keys = unused("_doc", own), unused("_keys", own)
        drops = self._drops(docs).withColumnsRenamed({"_doc": doc, "_keys": keys})
        return docs.join(drops, docs["doc_id"].eqNullSafe(F.col(doc)), "left").select(*own, keys).mapInArrow(tidy(_listed_applier(own, self.min_chars)), schema)

    def _filter_blocks(self):
        """The filters by shard, FILTER_BYTES at a time (one filter at least)."""
        sizes = [(r[0], r[1]) for r in self.filters.select("shard", F.length("blob")).orderBy("shard").collect()]  # a row for KEYS_A_SHARD keys
        held, total = [], 0
        for shard, size in [*sizes, (None, 0)]:
            if held and (shard is None or total + size > self.FILTER_BYTES):
                yield {r["shard"]: bytes(r["blob"]) for r in self.filters.where(F.col("shard").between(held[0], held[-1])).collect()}
                held, total = [], 0
            held.append(shard)
            total += size

    def _drops(self, docs: DataFrame) -> DataFrame:
        """_doc, _keys: the keys whose lines each document loses. Only lines that pass the filters are exchanged."""
        min_chars, shards = self.min_chars, self.shards
        schema = "hi long, lo long, _doc long"
        rows = docs.sparkSession.createDataFrame([], schema)

        def passing(sent):
            def run(batches):
                filters = {s: CuckooFilter.of(b) for s, b in sent.value.items()}
                for batch in batches:
                    keys, owners = [], []
                    for text, doc in zip(as_binary(batch.column(0)), batch.column(1).to_pylist(), strict=True):
                        own = {k for _, k in line_keys(text.as_py(), min_chars)}
                        keys += own
                        owners += [doc] * len(own)
                    k = np.frombuffer(b"".join(keys), np.int64).reshape(-1, 2)
                    at = np.flatnonzero(_maybe(filters, shards, k))
                    yield pa.RecordBatch.from_arrays([pa.array(k[at, 0]), pa.array(k[at, 1]), pa.array(owners, pa.int64()).take(pa.array(at))], ["hi", "lo", "_doc"])

            return run

        for blobs in self._filter_blocks():
            sent = docs.sparkSession.sparkContext.broadcast(blobs)
            rows = rows.unionByName(docs.select("text", F.col("doc_id").cast("long")).mapInArrow(tidy(passing(sent)), schema))
        lost = rows.join(self.hot, KEY).where(~F.col("_doc").eqNullSafe(F.col("keeper"))).select("_doc", F.struct(*KEY).alias("k"))
        return lost.groupBy("_doc").agg(F.collect_set("k").alias("_keys"))


def _maybe(filters: dict[int, CuckooFilter], shards: int, k: np.ndarray) -> np.ndarray:
    """Which of the keys (rows of hi, lo) may be hot, by the filters of their shards."""
    out = np.zeros(len(k), bool)
    shard = k[:, 0] % shards
    order = np.argsort(shard, kind="stable")
    bounds = np.flatnonzero(np.diff(shard[order], prepend=-1))
    for at in np.split(order, bounds[1:]) if len(k) else ():
        f = filters.get(int(shard[at[0]]))
        if f is not None:
            out[at] = f.contains(k[at, 1].view(np.uint64))
    return out


def _clean(batch: pa.RecordBatch, own: list[str], lost: dict[int, set[int]]) -> pa.RecordBatch:
    """lost: numbers of the lines that go, by row."""
    kept, n_lines = [], []
    for r, text in enumerate(as_binary(batch.column(own.index("text")))):
        text = text.as_py()
        n_lines.append(text.count(b"\n") + 1)
        if r in lost:
            text = b"\n".join(x for i, x in enumerate(text.split(b"\n")) if i not in lost[r])
        kept.append(text)
    columns = [batch.column(i) for i in range(len(own))]
    columns += [pa.array(kept, pa.binary()).cast(pa.string()), pa.array(n_lines, pa.int64()), pa.array([len(lost.get(r, ())) for r in range(len(kept))], pa.int64())]
    return pa.RecordBatch.from_arrays(columns, [*own, "kept_text", "n_lines", "n_dropped"])


def _applier(index: LineIndex, own: list[str]):
    hot = index.hot.select("hi", "lo", "keeper").toPandas()  # BROADCAST_KEYS rows at most
    order = np.lexsort((hot["lo"], hot["hi"]))
    hi, lo, keeper = (hot[c].to_numpy(np.int64)[order] for c in ("hi", "lo", "keeper"))
    blobs = {r["shard"]: r["blob"] for r in index.filters.collect()}
    sent = index.hot.sparkSession.sparkContext.broadcast((hi, lo, keeper, blobs))
    shards, min_chars = index.shards, index.min_chars

    def run(batches):
        hi, lo, keeper, blobs = sent.value
        filters = {s: CuckooFilter.of(bytes(b)) for s, b in blobs.items()}
        for batch in batches:
            ids = batch.column(own.index("doc_id")).to_pylist()
            rows, lines, keys = [], [], []
            for r, text in enumerate(as_binary(batch.column(own.index("text")))):
                for i, key in line_keys(text.as_py(), min_chars):
                    rows.append(r)
                    lines.append(i)
                    keys.append(key)
            k = np.frombuffer(b"".join(keys), np.int64).reshape(-1, 2)
            lost: dict[int, set[int]] = {}
            passed = np.flatnonzero(_maybe(filters, shards, k))  # the filter says maybe; the exact table decides
            for i, at in zip(passed.tolist(), np.searchsorted(hi, k[passed, 0]).tolist(), strict=True):
                while at < len(hi) and hi[at] == k[i, 0] and lo[at] != k[i, 1]:
                    at += 1
                if at < len(hi) and hi[at] == k[i, 0] and keeper[at] != ids[rows[i]]:
                    lost.setdefault(rows[i], set()).add(lines[i])
            yield _clean(batch, own, lost)

    return run


def _listed_applier(own: list[str], min_chars: int):
    def run(batches):
        for batch in batches:
            listed = batch.column(len(own)).to_pylist()
            lost: dict[int, set[int]] = {}
            for r, text in enumerate(as_binary(batch.column(own.index("text")))):
                if listed[r]:
                    gone = {np.array([x["hi"], x["lo"]], np.int64).tobytes() for x in listed[r]}
                    at = {i for i, key in line_keys(text.as_py(), min_chars) if key in gone}
                    if at:
                        lost[r] = at
            yield _clean(batch, own, lost)

    return run


def dedup_lines(docs: DataFrame, min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """docs with kept_text, n_lines (before dropping) and n_dropped: the index of all documents, applied to them."""
    return LineIndex.build(docs, min_chars, min_docs).apply(docs)
