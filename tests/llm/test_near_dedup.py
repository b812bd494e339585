import random
import re

import pytest
from texts import EDGE_TEXTS, prose

from domquarry.llm import components as linked
from domquarry.llm import near_dedup
from domquarry.llm.components import components
from domquarry.llm.near_dedup import dedup_near, near_duplicates, pack_set, unpack_set

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(t):
    w = re.findall("[^\x20\x09-\x0d]+", (t or "").translate(LOWER))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute(rows, percent=85):
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and rows[i][0] is not None and rows[j][0] is not None and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[find(i)] = min(least.get(find(i), doc), doc)
    return [(doc, len(s), least[find(i)] if s and doc is not None else doc, doc is None or not s or doc == least[find(i)]) for i, ((doc, _), s) in enumerate(zip(rows, sets, strict=True))]


def edited(text, seed, share):
    rng = random.Random(seed)
    w = text.split(" ")
    for i in range(len(w)):
        if rng.random() < share:
            w[i] = f"new{rng.randint(0, 10**6)}"
    return " ".join(w)


def fixture():
    rows = list(enumerate(EDGE_TEXTS))
    rows += [(20 + i, t) for i, t in enumerate(EDGE_TEXTS)]
    for g in range(6):
        base = prose(g, 150 + 60 * g)
        for k in range(12):
            rows.append((1000 + 50 * g + k, base if k % 4 == 0 else edited(base, 10 * g + k, 0.004 * k)))
    chain = prose(77, 300)
    for k in range(12):  # neighbours alike, ends not
        chain = edited(chain, 700 + k, 0.012)
        rows.append((3000 + k, chain))
    rows += [(4000 + i, prose(4000 + i, 80)) for i in range(60)]
    rows += [(5000 + i, "same few words here") for i in range(40)]
    return [*rows, (1000, rows[24][1]), (None, rows[24][1])]


def order(rows):
    return sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, *r[1:]))


@pytest.mark.parametrize("leaf", [32, 2])
def test_against_brute_force(docs_of, monkeypatch, leaf):
    monkeypatch.setattr(near_dedup, "LEAF", leaf)
    monkeypatch.setattr(near_dedup, "DEPTH", 4 if leaf > 2 else 1)
    rows = fixture()
    got = near_duplicates(docs_of(rows)).collect()
    assert order(map(tuple, got)) == order(brute(rows))


def test_shuffled_texts(docs_of, monkeypatch):
    monkeypatch.setattr(near_dedup, "BROADCAST_IDS", -1)
    base = prose(5, 200)
    rows = [(1, base), (2, edited(base, 1, 0.004)), (3, None), (4, prose(6, 50)), (5, base)]
    kept = dedup_near(docs_of(rows))
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 3, 4]
    assert kept.columns == docs_of([]).columns


@pytest.mark.parametrize("bound", [1 << 20, -1])
def test_rows_that_share_an_id(docs_of, monkeypatch, bound):
    """Only the row whose own text is a copy goes, not all rows of its id."""
    monkeypatch.setattr(near_dedup, "BROADCAST_IDS", bound)
    base, other = prose(5, 200), prose(9, 200)
    rows = [(1, base), (7, other), (7, edited(base, 1, 0.004)), (8, other), (8, prose(10, 90))]
    docs = docs_of(rows).selectExpr("*", "1 AS _doc", "2 AS _t", "3 AS c", "4 AS hi")
    kept = dedup_near(docs)
    assert sorted((r["doc_id"], r["text"]) for r in kept.collect()) == sorted([(1, base), (7, other), (8, prose(10, 90))])
    assert kept.columns == docs.columns


def test_long_text(docs_of):
    """Over 20,000 words and 1 MB."""
    long = prose(3, 80_000)
    rows = [(1, long), (2, long + " one more"), (3, "\u00e9" * 600_000), (4, "\u00e9" * 600_000 + " b")]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_duplicates(docs_of(rows)).collect()}
    assert got[1][1] == got[2][1] == 1 and got[1][0] > 75_000 and got[3] == (1, 3) and got[4] == (1, 4)


def test_empty_table(docs_of):
    assert near_duplicates(docs_of([])).count() == 0


@pytest.mark.parametrize("local", [1 << 20, 50])
def test_components(spark, monkeypatch, local):
    monkeypatch.setattr(linked, "LOCAL_LINKS", local)
    rng = random.Random(0)
    pairs = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(200)] + [(1000 + i, 1001 + i) for i in range(150)] + [(5000, 6000 + i) for i in range(200)] + [(7, 7), (None, 3), (3, None)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        if a is not None and b is not None and a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    links = spark.createDataFrame(pairs, "u long, v long").repartition(7)
    got = {r["node"]: r["root"] for r in components(links).collect()}
    expected = {x: find(x) for x in list(root)}
    assert {k: v for k, v in expected.items() if k != v} == {k: v for k, v in got.items() if k != v}


def test_sets_survive_packing():
    import numpy as np

    s = np.unique(np.random.default_rng(0).integers(0, 1 << 63, 1000, dtype=np.uint64))
    back = unpack_set(pack_set(s))
    assert len(back) == len(s) and (back >> np.uint64(16) == s >> np.uint64(16)).all()
    assert len(unpack_set(b"")) == 0


def test_limits_follow_percent():
    import math

    from domquarry.llm.near_dedup import SKETCH, limits

    assert limits(85) == (18, 42, 10)
    for percent in (60, 70, 75, 80, 90):
        p = (100 - percent) / 200
        *bits, trees = limits(percent)
        for n, k in zip((64, SKETCH), bits, strict=True):
            assert sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1, n + 1)) <= 1e-6
        assert (1 - percent / 100) ** trees <= 1e-6
    with pytest.raises(ValueError):
        limits(10)
