import random
import zlib

import numpy as np
import pytest
from texts import EDGE_TEXTS, prose

from domquarry.llm import packing, tokens
from domquarry.llm.packing import Shard, cut_points, pack

ROWS = [*enumerate(EDGE_TEXTS), *((100 + i, prose(i, 30 + 37 * (i % 23))) for i in range(120)), (100, "again"), (None, "no id"), (900, prose(9, 6000))]


@pytest.fixture(scope="module")
def reference():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokens.default_path())
    t.encode_special_tokens = True
    return lambda s: [*t.encode(s or "", add_special_tokens=False).ids, 0]


@pytest.mark.parametrize("shard", [1024, 7])
def test_round_trip(docs_of, monkeypatch, reference, shard):
    monkeypatch.setattr(packing, "SHARD_DOCS", shard)
    got = pack(docs_of(ROWS), with_ids=True).collect()
    sequences, texts = {}, {}
    for r in got:
        assert 0 < r["length"] == len(r["ids"]) <= 1024
        assert r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
        sequences.setdefault(r["sequence_id"], []).append(r)
        texts.setdefault((r["doc_id"], r["doc_tokens"]), []).append(r)
    for pieces in sequences.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at & (at - 1) == 0 and at <= 1024  # full or a power of two: no padding
    found = []
    for (doc, n), pieces in texts.items():
        pieces.sort(key=lambda r: r["start"])
        ids = [x for r in pieces for x in r["ids"]]
        assert [r["start"] for r in pieces] == np.concatenate([[0], np.cumsum([r["length"] for r in pieces])[:-1]]).tolist() and len(ids) == n
        found.append((doc is None, doc or 0, ids))
    assert sorted(found) == sorted((d is None, d or 0, reference(t)) for d, t in ROWS)


def test_empty_table(docs_of):
    assert pack(docs_of([])).count() == 0


def test_pieces_of_any_text(reference):
    import pyarrow as pa

    rng = random.Random(0)
    signs = [" ", " ", "\n", "a", "b", "é", "中", "'s", "1", ".", "  ", "\t", chr(0xA0), chr(0x3000), "<|endoftext|>", "\x1c", "😀"]
    texts = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 30))) for _ in range(2000)]
    e = tokens.PieceEncoder(tokens.default_path())
    assert e.fast is not None
    assert [x.tolist() for x in tokens.encode_rows(pa.array(texts), e)] == [reference(t)[:-1] for t in texts]


def test_a_full_table_still_encodes(reference, monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(tokens, "TABLE_SLOTS", 64)
    e = tokens.PieceEncoder(tokens.default_path())
    texts = [prose(i, 60) for i in range(30)]
    for _ in range(2):
        assert [x.tolist() for x in tokens.encode_rows(pa.array(texts), e)] == [reference(t)[:-1] for t in texts]
    assert e.n == 32


def test_other_vocabularies():
    import public_tokenizers

    e = tokens.PieceEncoder(public_tokenizers.path("word_bpe_49k.json"))
    assert e.fast is None
    assert e.encode("Hello there").tolist() == e.whole.encode("Hello there", add_special_tokens=False).ids


def test_neighbours_are_by_bm25():
    rng = np.random.default_rng(0)
    docs = [rng.integers(1, 50, rng.integers(5, 40)).astype(np.uint16) for _ in range(30)] + [np.zeros(0, np.uint16)]
    n, mean = len(docs), 20.0
    df = np.zeros(1 << 16)
    for d in docs:
        df[np.unique(d)] += 1
    idf = np.log1p((n - df + 0.5) / (df + 0.5))
    shard = Shard(docs, idf, mean)
    for seed in range(n):
        terms = sorted(set(docs[seed].tolist()), key=lambda t: -idf[t])
        scores = []
        for d in docs:
            tf = {t: int((d == t).sum()) for t in terms}
            scores.append(sum(idf[t] * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * len(d) / mean)) for t, f in tf.items() if f))
        scores[seed] = 0
        unused = np.ones(n, bool)
        unused[seed] = False
        best = shard.neighbour(seed, unused)
        assert best == -1 if max(scores) == 0 else scores[best] == pytest.approx(max(scores))


@pytest.mark.parametrize("total", [1, 2, 3, 1023, 1024, 1025, 5000])
def test_cuts(total):
    points = cut_points(total, 1024)
    sizes = np.diff(points)
    assert points[0] == 0 and points[-1] == total and all(s & (s - 1) == 0 and 0 < s <= 1024 for s in sizes.tolist())


def test_all_terms_of_a_seed_count():
    seed = np.arange(1, 201, dtype=np.uint16)
    # the seed's 16 rarest terms stand nowhere else; the second document shares most of the others, the third is its equal
    docs = [seed, np.arange(17, 40, dtype=np.uint16), np.arange(17, 200, dtype=np.uint16), np.arange(17, 200, dtype=np.uint16)[::-1].copy()]
    idf = np.full(1 << 16, 1.1)
    idf[1:17] = 9.0
    assert Shard(docs, idf, 100.0).neighbour(0, np.array([False, True, True, True])) == 2


def test_routes_by_brute_force():
    """The token of least draw; sets that share most of their rare tokens mostly share a route."""
    rng = np.random.default_rng(1)
    same = 0
    for _ in range(300):
        terms = np.unique(rng.integers(1, 40_000, 60))
        draws = packing.routes(terms) and packing._DRAWS[0]
        assert packing.routes(terms) == tuple(int(min(terms, key=lambda t, k=k: draws[k, t])) for k in (0, 1))
        near = np.unique(np.concatenate([terms[3:], rng.integers(1, 40_000, 3)]))
        same += packing.routes(terms)[0] == packing.routes(near)[0]
    assert same > 230
    assert packing.routes(np.zeros(0, np.int64)) == (-1, -1)
    assert packing.routes(np.array([5, 200_000]))[0] in (5, 200_000)


def test_documents_of_a_topic_share_sequences(docs_of, monkeypatch):
    """Rows of topics stand mixed; packed, most of a sequence is of one topic. With shards in order of rows none would be."""
    monkeypatch.setattr(packing, "SHARD_DOCS", 16)
    topics = [prose(70 + i, 30).split() for i in range(8)]
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choices(topics[i % 8], k=120))) for i in range(256)]
    sequences = {}
    for r in pack(docs_of(rows)).collect():
        sequences.setdefault(r["sequence_id"], {}).setdefault(r["doc_id"] % 8, []).append(r["length"])
    most = [max(map(sum, s.values())) / sum(map(sum, s.values())) for s in sequences.values()]
    assert np.mean(most) > 0.5


def test_a_group_of_copies_is_split(docs_of, spark):
    """A third of all rows are copies: they have one route, and the third key still spreads them over tasks."""
    rows = [(i, "the same text in all of these rows" if i % 3 == 0 else prose(i, 40)) for i in range(900)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        tasks = {}
        for r in pack(docs_of(rows)).collect():
            tasks.setdefault(r["sequence_id"] >> 40, set()).add(r["doc_id"])
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(tasks) > 1 and max(map(len, tasks.values())) < 600
    assert set().union(*tasks.values()) == set(range(900))


def test_greedy_order_by_brute_force():
    """Each next document is the unused one of highest score for the seed, and what overflows a window is the next seed."""
    rng = np.random.default_rng(4)
    docs = [rng.integers(1, 60, rng.integers(3, 40)).astype(np.uint16) for _ in range(40)]
    idf = np.log1p(np.arange(1 << 16) % 7 + 1.0)
    shard, lengths, window = Shard(docs, idf, 20.0), [len(d) + 1 for d in docs], 64

    def score(seed, d):
        total = 0
        for t in set(docs[seed].tolist()):
            f = int((docs[d] == t).sum())
            total += round(float(idf[t]) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * len(docs[d]) / 20.0)) * 2**30) if f else 0
        return total

    unused, expected, at, seed = list(range(40)), [], 0, 0
    while unused:
        if at % window == 0:
            d = seed = unused[0]
        else:
            best = max(score(seed, d) for d in unused)
            d = next(d for d in unused if score(seed, d) == best) if best else unused[0]
        unused.remove(d)
        expected.append(d)
        if at // window != (at + lengths[d] - 1) // window:
            seed = d
        at += lengths[d]
    assert shard.order(lengths, window) == expected
