import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from texts import EDGE_TEXTS, prose

from domquarry.llm.line_dedup import BLANKS, CuckooFilter, LineIndex, dedup_lines

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def key(line):
    return line.strip(BLANKS.decode()).translate(LOWER)


def brute(rows, known=None):
    held = {}
    for doc, t in known or rows:
        for line in (t or "").split("\n"):
            if doc is not None and len(key(line)) >= 40:
                held.setdefault(key(line), set()).add(doc)
    hot = {k: max(v) for k, v in held.items() if len(v) >= 5}
    out = []
    for doc, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if key(x) not in hot or hot[key(x)] == doc]
        out.append((doc, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def fixture(seed=0):
    rng = random.Random(seed)
    shared = [prose(900 + i, 9).replace("\n", " ") + " é" for i in range(6)] + ["short line", "é" * 40, "x" * 39]
    rows = [(i, t) for i, t in enumerate(EDGE_TEXTS)]
    for i in range(60):
        lines = prose(i, 40).split("\n")
        for s in shared:
            if rng.random() < 0.3:
                lines.insert(rng.randint(0, len(lines)), rng.choice([s, s.upper() if s.isascii() else s, f" \t{s} "]))
        rows.append((100 + i, "\n".join(lines)))
    return [*rows, (100, rows[-1][1]), (None, "\n".join(shared))]


def order(rows):
    return sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, *r[1:]))


def collected(df):
    return order([(r["doc_id"], r["n_lines"], r["n_dropped"], r["kept_text"]) for r in df.collect()])


@pytest.mark.parametrize("broadcast", [True, False])
def test_against_brute_force(spark, docs_of, monkeypatch, broadcast):
    asked = []
    if not broadcast:  # beyond the bound the filters are asked too, a block of shards at a time
        monkeypatch.setattr(LineIndex, "BROADCAST_KEYS", -1)
        monkeypatch.setattr(LineIndex, "KEYS_A_SHARD", 2)
        monkeypatch.setattr(LineIndex, "FILTER_BYTES", 40)
        blocks = LineIndex._filter_blocks
        monkeypatch.setattr(LineIndex, "_filter_blocks", lambda self: [asked.append(b) or b for b in blocks(self)])
    rows = fixture()
    docs = docs_of(rows).selectExpr("*", "'a' AS _doc", "'b' AS _keys")
    out = dedup_lines(docs)
    assert collected(out) == order(brute(rows)) and {"_doc", "_keys"} <= set(out.columns)
    assert broadcast or len(asked) > 1
    assert "n_chars" in out.columns and out.columns.count("kept_text") == 1


def test_insertion_and_deletion(spark, docs_of):
    rows = [r for r in fixture() if r[0] is not None][:-1]
    first, second = rows[:40], rows[40:]
    a = LineIndex.build(docs_of(first))
    both = a.insert(docs_of(second))
    assert collected(both.apply(docs_of(rows))) == order(brute(rows))
    gone = [r[0] for r in rows[50:]]
    fewer = both.delete(spark.createDataFrame([(g,) for g in gone], "doc_id long"))
    assert collected(fewer.apply(docs_of(rows[:50]))) == order(brute(rows[:50]))
    back = both.delete(spark.createDataFrame([(r[0],) for r in second], "doc_id long"))
    assert order(map(tuple, back.hot.collect())) == order(map(tuple, a.hot.collect()))
    assert collected(a.apply(docs_of(first))) == order(brute(first))  # the old index still is what it was


def test_empty_table(docs_of):
    assert dedup_lines(docs_of([])).count() == 0


@pytest.mark.parametrize("broadcast", [True, False])
def test_only_lines_that_pass_are_looked_up(docs_of, monkeypatch, broadcast):
    """With filters that hold nothing, no line reaches the exact table: the filters decide first, whatever the number of keys."""
    if not broadcast:
        monkeypatch.setattr(LineIndex, "BROADCAST_KEYS", -1)
    docs = docs_of(fixture())
    index = LineIndex.build(docs)
    index.filters = index.filters.withColumn("blob", F.lit(bytes(32)))
    assert all(r["n_dropped"] == 0 for r in index.apply(docs).collect())


def test_long_text(docs_of):
    """Over 20,000 words and 1 MB in one text."""
    shared = "this line of over forty characters is in five documents"
    long = "\n".join(f"{i} {prose(i, 12)}" for i in range(8000)).replace("\n", f"\n{shared}\n", 3)
    rows = [(i, f"own {i}\n{shared}") for i in range(5)] + [(0 - i, "\u00e9" * 500_000) for i in range(1, 3)] + [(-9, long)]
    assert len(long.split()) > 20_000
    assert collected(dedup_lines(docs_of(rows))) == order(brute(rows))


def test_cuckoo_filter():
    rng = np.random.default_rng(0)
    h = rng.integers(0, 1 << 63, 5000).astype(np.uint64)
    f = CuckooFilter(5000)
    assert f.insert(h) and f.contains(h).all()
    other = rng.integers(0, 1 << 63, 20000).astype(np.uint64)
    assert f.contains(other).mean() < 0.01
    f.delete(h[:2500])
    assert f.contains(h[2500:]).all() and f.contains(h[:2500]).mean() < 0.01
    again = CuckooFilter.of(f.blob())
    assert again.contains(h[2500:]).all()
    assert not CuckooFilter(4).insert(h)
