import hashlib
import re

import pytest
from texts import EDGE_TEXTS, prose

from domquarry.llm import decontaminate
from domquarry.llm.decontaminate import contamination_report, remove_contamination

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(t):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (t or "").translate(LOWER))


def brute(docs, items, size=13):
    windows = {}
    for item, t in items:
        w = words(t)
        for i in range(len(w) - min(size, len(w)) + 1 if w else 0):
            windows.setdefault(tuple(w[i : i + size]), set()).add(item)
    out = []
    for doc, t in docs:
        w, hit, found = words(t), set(), set()
        for n in {len(k) for k in windows}:
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in windows:
                    hit |= set(range(i, i + n))
                    found |= windows[tuple(w[i : i + n])]
        ids = ",".join(sorted(map(str, found)))
        out.append((doc, len(w), len(hit), len(found), hashlib.sha256(ids.encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return out


ITEMS = [(1, prose(1, 30)), (2, prose(2, 13)), (3, prose(3, 5)), (4, None), (5, "..."), (6, prose(2, 13)), (7, "One TWO three"), (10, prose(10, 40))]


def fixture():
    rows = list(enumerate(EDGE_TEXTS))
    for i in range(40):
        own = prose(100 + i, 60 + 40 * (i % 5))
        item = ITEMS[i % len(ITEMS)][1] or ""
        cut = " ".join(item.split()[i % 3 :])
        rows.append((100 + i, f"{own} {cut.upper() if i % 2 else cut} {prose(500 + i, 20)}"))
    return [*rows, (100, rows[-1][1]), (None, ITEMS[0][1])]


@pytest.mark.parametrize(("block", "shard"), [(1 << 19, 1 << 20), (20, 1 << 20), (1 << 19, 300)])
def test_against_brute_force(spark, docs_of, monkeypatch, block, shard):
    monkeypatch.setattr(decontaminate, "BLOCK_WORDS", block)
    monkeypatch.setattr(decontaminate, "SHARD_WORDS", shard)
    rows = fixture()
    items = spark.createDataFrame([*ITEMS, ITEMS[0], (None, "x y z")], "item_id long, text string")
    got = contamination_report(docs_of(rows), items).collect()
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    assert sorted((tuple(r) for r in got), key=key) == sorted(brute(rows, ITEMS), key=key)


@pytest.mark.parametrize("block", [1 << 19, 20])
def test_removal(spark, docs_of, monkeypatch, block):
    monkeypatch.setattr(decontaminate, "BLOCK_WORDS", block)
    long = prose(7, 900)
    rows = [(1, long), (2, f"{long}\n{ITEMS[0][1]} tail."), (3, ITEMS[0][1]), (4, None), (5, "")]
    docs = docs_of(rows)
    items = spark.createDataFrame([ITEMS[0]], "item_id long, text string")
    out = {r["doc_id"]: r for r in remove_contamination(docs, items).collect()}
    assert set(out) == {1, 2, 4, 5}
    assert out[1]["text"] == long and out[4]["text"] is None and out[5]["text"] == ""
    assert out[2]["text"].startswith(long) and out[2]["text"].endswith("tail.") and len(out[2]["text"]) < len(long) + 10
    assert out[2]["n_chars"] == len(out[2]["text"]) and out[2]["spans"] == "x"


def test_empty_tables(spark, docs_of):
    items = spark.createDataFrame([], "item_id long, text string")
    assert contamination_report(docs_of([]), items).count() == 0
    assert contamination_report(docs_of([(1, "a b")]), items).first()["n_hit"] == 0
