"""Exact top-k search of binary codes by incremental multi-index hashing.

A code is the signs of an embedding (bit 1 where a component is greater than 0), 64 bits a word. It is cut into segments of 8
bits in shards of up to SMALL distinct codes and of 16 in others (near the logarithm of their number), each with an index of its own. A query looks up segment values within radius 0, 1, 2 ... of its own, a segment at a time,
and verifies full distances. After segment j (from 0) of m at radius r every code within m * r + j is known; the query ends when
that covers its kth verified distance. Ties go to the lesser id. When the next radius has more values than the shard has codes
(never with segments of 8 bits), the rest of the shard is verified whole. Equal codes are one entry with its k least ids, so copies are no burden.

Codes are sharded by hash of id (SHARD_CODES each); queries are streamed against each shard in blocks, from a sorted partition:
memory is a shard's. Where shards are fewer than cores, up to COPIES groups of queries share them out, each with a copy of the codes. Each shard gives k rows a query, of which the best k are kept.

Cases: a null embedding is neither searched nor found, NaN and missing components are bit 0; rows that repeat an id are found as
often as they stand; with fewer than k codes all are returned; an empty table gives none.
"""

from __future__ import annotations

from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import limit_batches, tidy

SHARD_CODES, BLOCK, SMALL, COPIES = 1 << 20, 64, 1 << 12, 8


def encode(column: pa.Array, words: int) -> np.ndarray:
    """Rows of ``words`` 64-bit words."""
    out = np.zeros((len(column), words * 64), np.uint8)
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = np.array(column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), np.int64)
    flat = np.array(column.flatten().to_numpy(zero_copy_only=False), np.float64)
    row = np.repeat(np.arange(len(column)), sizes)
    at = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    ok = at < words * 64
    out[row[ok], at[ok]] = flat[ok] > 0
    return np.packbits(out, axis=1, bitorder="little").view(np.uint64)


@cache
def _masks(bits: int, r: int) -> np.ndarray:
    return np.array([sum(1 << b for b in c) for c in combinations(range(bits), r)], np.int64)


class MultiIndex:
    """codes: rows of 64-bit words; ids: their ids. At most k entries of equal codes are kept."""

    def __init__(self, codes: np.ndarray, ids: np.ndarray, k: int):
        order = np.lexsort((ids, *codes.T))
        codes, ids = codes[order], ids[order]
        new = np.ones(len(codes), bool)
        new[1:] = (codes[1:] != codes[:-1]).any(1)
        start = np.flatnonzero(new)
        self.codes, self.k = codes[start], k
        self.ids, self.first = ids, start
        self.size = np.minimum(np.diff(np.append(start, len(codes))), k)
        self.bits = 8 if len(self.codes) <= SMALL else 16
        self.kind = np.uint8 if self.bits == 8 else np.uint16
        self.m = codes.shape[1] * 64 // self.bits
        segments = self.codes.view(self.kind).astype(np.int64) if len(codes) else np.zeros((0, self.m), np.int64)
        self.scans = 0  # queries that the index didn't end
        self.order = [np.argsort(segments[:, j], kind="stable") for j in range(self.m)]
        self.starts = [np.searchsorted(segments[self.order[j], j], np.arange((1 << self.bits) + 1)) for j in range(self.m)]
        self.segments = segments

    def search(self, queries: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """(distances, ids) of the k nearest of each query, by distance and id."""
        n, m = len(queries), self.m
        qs = queries.view(self.kind).astype(np.int64).reshape(n, m)
        found: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in range(n)]
        count = np.zeros((n, 64 * queries.shape[1] + 1), np.int64)
        live = np.arange(n)
        for r in range(self.bits + 1):
            masks = _masks(self.bits, r)
            if len(masks) * m > max(SMALL, len(self.codes)):
                self.scans += len(live)
                for q in live:
                    d = np.bitwise_count(self.codes ^ queries[q]).sum(1).astype(np.int64)
                    found[q] = [(d, np.arange(len(d)))]
                return [self._best(f) for f in found]
            for j in range(m):
                keys = qs[live, j, None] ^ masks[None]
                lo, hi = self.starts[j][keys], self.starts[j][keys + 1]
                size = (hi - lo).ravel()
                q = np.repeat(np.repeat(live, len(masks)), size)
                entry = self.order[j][np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(lo.ravel(), size)]
                apart = np.bitwise_count(self.segments[entry] ^ qs[q]).astype(np.int64)
                # known before if an earlier segment is within r, or a later one within r - 1
                new = (apart[:, :j] > r).all(1) & (apart[:, j + 1 :] >= r).all(1)
                q, entry, d = q[new], entry[new], apart[new].sum(1)
                np.add.at(count, (q, d), self.size[entry])
                bounds = np.searchsorted(q, np.append(live, n))
                for i, a in enumerate(live):
                    if bounds[i + 1] > bounds[i]:
                        found[a].append((d[bounds[i] : bounds[i + 1]], entry[bounds[i] : bounds[i + 1]]))
                covered = np.cumsum(count[live, : m * r + j + 1], axis=1)[:, -1]
                live = live[covered < self.k]
                if not len(live):
                    return [self._best(f) for f in found]
        return [self._best(f) for f in found]

    def _best(self, parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        if not parts:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        d, e = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
        if len(d) > self.k:  # entries beyond the kth distance can't count
            keep = d <= np.partition(d, self.k - 1)[self.k - 1]
            d, e = d[keep], e[keep]
        size = self.size[e]
        at = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(self.first[e], size)
        d, ids = np.repeat(d, size), self.ids[at]
        order = np.lexsort((ids, d))[: self.k]
        return d[order], ids[order]


def _answers(k: int, words: int):
    """Over rows (cell, asks, id, code) sorted by cell and asks: a cell's codes first, then its queries."""

    def run(batches):
        cell, codes, ids, index = None, [], [], None
        for batch in batches:
            cells, asks = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            own = batch.column(2).to_numpy()
            rows = np.frombuffer(b"".join(batch.column(3).to_pylist()), np.uint64).reshape(-1, words)
            edges = np.flatnonzero((np.diff(cells, prepend=cells[0]) != 0) | (np.diff(asks, prepend=asks[0]) != 0))
            for a, b in zip([0, *edges], [*edges, len(own)], strict=True):
                if cells[a] != cell:
                    cell, codes, ids, index = cells[a], [], [], None
                if asks[a] == 0:
                    codes.append(rows[a:b])
                    ids.append(own[a:b])
                    continue
                if index is None:
                    index = MultiIndex(np.concatenate(codes) if codes else np.zeros((0, words), np.uint64), np.concatenate(ids) if ids else np.zeros(0, np.int64), k)
                    codes, ids = [], []
                distinct, back = np.unique(rows[a:b], axis=0, return_inverse=True)
                best = [x for i in range(0, len(distinct), BLOCK) for x in index.search(distinct[i : i + BLOCK])]
                back = back.ravel()
                sizes = [len(best[i][0]) for i in back]
                out = [np.repeat(own[a:b], sizes), np.concatenate([best[i][1] for i in back]), np.concatenate([best[i][0] for i in back])]
                yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in out], ["query_id", "neighbor_id", "distance"])

    return run


def top_k(rows: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), neighbor_id, distance: the k rows nearest to each row of ``queries``, itself included if it is a row."""
    spark = rows.sparkSession
    limit_batches(spark)
    n, width = rows.where(F.col(vector).isNotNull()).agg(F.count("*"), F.coalesce(F.max(F.size(vector)), F.lit(1))).first()
    n_queries = queries.count()
    words = max(1, -(-width // 64))
    shards = max(1, -(-n // SHARD_CODES))
    # with few shards, groups of queries make more work to share out; each takes the shards' codes once more
    groups = max(1, min(-(-n_queries // BLOCK), 2 * spark.sparkContext.defaultParallelism // shards, COPIES))

    def coded(batches):
        for batch in batches:
            codes = encode(batch.column(1), words)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([c.tobytes() for c in codes], pa.binary())], ["id", "code"])

    def codes_of(df: DataFrame) -> DataFrame:
        return df.where(F.col(vector).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long"), vector).mapInArrow(tidy(coded), "id long, code binary")

    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    data = codes_of(rows).withColumn("s", F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int")).withColumn("g", every(groups)).withColumn("asks", F.lit(0))
    asks = codes_of(queries).withColumn("g", F.pmod(F.xxhash64(F.lit(1), "id"), F.lit(groups)).cast("int")).withColumn("s", every(shards)).withColumn("asks", F.lit(1))
    both = data.select("s", "g", "asks", "id", "code").unionByName(asks.select("s", "g", "asks", "id", "code"))
    both = both.select((F.col("s") * groups + F.col("g")).alias("cell"), "asks", "id", "code")
    found = both.repartition(shards * groups * 2, "cell").sortWithinPartitions("cell", "asks").mapInArrow(tidy(_answers(k, words)), "query_id long, neighbor_id long, distance long")
    best = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "neighbor_id"))
    return found.withColumn("rank", best).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("long").alias("rank"), "neighbor_id", "distance")
