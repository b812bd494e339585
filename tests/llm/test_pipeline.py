import zlib

import corpus_pipeline
import numpy as np
import pyarrow as pa
import pytest
import test_decontaminate
import test_line_dedup
import test_near_dedup
from texts import EDGE_TEXTS, prose

import __spark_entry__
from domquarry.llm import decontaminate, quality, tokens
from domquarry.llm.queries import ORACLE_SQL, QUERIES


def test_registered():
    names = list(__spark_entry__.queries())
    assert [sum(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)] == [1] * 10 and "pipeline" in names
    assert set(ORACLE_SQL) <= set(QUERIES)


def test_stages(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    sizes = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf).cache()
        assert out.columns == docs.columns and out.dtypes == docs.dtypes, name
        sizes.append(out.count())
        docs = out
    assert sizes == sorted(sizes, reverse=True) and sizes[-1] > sizes[0] // 2
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    assert packed.select("doc_id").distinct().count() == sizes[-1]
    run = corpus_pipeline.run(spark, sf)
    key = ["doc_id", "start", "length", "ids_crc32"]
    assert sorted(map(tuple, run.select("doc_id", "doc_tokens").distinct().collect())) == sorted(map(tuple, packed.select("doc_id", "doc_tokens").distinct().collect()))
    assert run.columns == packed.columns and set(key) <= set(run.columns)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_sql(spark, name):
    import duckdb

    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "benchmark", "labels", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    got = QUERIES[name](spark, sf)
    columns = sorted(got.columns)
    expected = con.execute(f"SELECT {', '.join(columns)} FROM ({ORACLE_SQL[name]})").fetchall()
    assert sorted(map(tuple, got.select(*columns).collect())) == sorted(expected)


def test_near_copies_from_eighty_percent_go(spark):
    words = [f"w{i}" for i in range(94)]
    rows = [(i, " ".join([*words, *(f"d{i}x{j}" for j in range(10))])) for i in (1, 2)]  # 90 of 110 shingles: 0.818
    rows += [(3, " ".join(f"o{i}" for i in range(104)))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r["doc_id"] for r in corpus_pipeline.minhash_near_dedup(spark, docs, "").collect()) == [1, 3]


CLASHES = "_quality _text _doc _keys _own _row _spans _t c hi lo kept kept_text n_lines n_dropped n_words spans items score predicted component_id n_shingles ids df k1".split()
ITEM = prose(4000, 30)


def corpus():
    """Documents for all stages: junk, shared lines, near copies, benchmark passages, nulls, empty and very long texts, repeated rows."""
    shared = "A licence line of more than forty characters, in many documents"
    rows = [(i, t) for i, t in enumerate(EDGE_TEXTS)]
    for i in range(100, 160):
        text = prose(i, 120)
        rows.append((i, f"{text}\n{shared}" if i % 3 == 0 else text))
    rows += [(200 + i, test_near_dedup.edited(prose(100 + i, 120), i, 0.01)) for i in range(6)]
    rows += [(300, prose(1, 40) + " " + ITEM), (301, prose(2, 2000) + " " + ITEM + " " + prose(3, 2000)), (302, ITEM)]
    rows += [(400 + i, " ".join(["Spam,"] * (60 + i))) for i in range(30)]
    rows += [(500, prose(5, 25_000)), (501, "\u00e9" * 600_000), (None, prose(6, 80)), (None, None), (103, rows[len(EDGE_TEXTS) + 3][1])]
    labels = [(i, int(i < 400), 0) for i, _ in rows if i is not None and 100 <= i < 500] + [(None, 1, 0), (101, None, None), (9999, 0, 1)]
    return rows, labels


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    def write(rows, labels, items):
        path = str(tmp_path_factory.mktemp("tables"))
        full = [(i, t, None if k % 4 == 0 else "en", None, None if t is None else len(t), *["x"] * len(CLASHES)) for k, (i, t) in enumerate(rows)]
        spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in CLASHES)).write.parquet(f"{path}/documents.parquet")
        spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
        spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
        return path

    return write


def test_against_brute_force(spark, tables):
    """The whole pipeline again, each stage by its plain version."""
    rows, labels = corpus()
    path = tables(rows, labels, [(1, ITEM), (2, None), (None, "x y z")])
    # quality
    known = {i: y for i, y, _ in labels if i is not None and y is not None and zlib.crc32(str(i).encode()) % 5}
    texts = {}
    for i, t in rows:
        if i in known and t is not None:
            texts.setdefault(i, t)
    learnt = sorted(texts)
    model = quality.train(quality.features(pa.array([texts[i] for i in learnt])), np.array([known[i] for i in learnt], np.float64))
    scores = model.scores(quality.features(pa.array([t for _, t in rows], pa.string())))
    docs = [r for r, s in zip(rows, scores, strict=True) if s >= quality.THRESHOLD]
    assert 50 < len(docs) < len(rows) - 20
    # lines, near copies
    docs = [(i, None if t is None else kept) for (i, t), (_, _, _, kept) in zip(docs, test_line_dedup.brute(docs), strict=True)]
    docs = [r for r, (_, _, _, kept) in zip(docs, test_near_dedup.brute(docs, 80), strict=True) if kept]
    # benchmark: documents go, or lose what they share
    left = []
    for i, t in docs:
        w = test_decontaminate.words(t)
        item = test_decontaminate.words(ITEM)
        windows = {tuple(item[k : k + 13]) for k in range(len(item) - 12)}
        hit = np.zeros(len(w) + 2, bool)
        for k in range(len(w) - 12):
            if tuple(w[k : k + 13]) in windows:
                hit[k + 1 : k + 14] = True
        if 20 * hit.sum() >= max(1, len(w)) and hit.any():
            continue
        spans = np.stack([np.flatnonzero(hit[1:] & ~hit[:-1]), np.flatnonzero(~hit[1:] & hit[:-1])], 1)
        left.append((i, decontaminate.cut_spans(t.encode(), spans).decode() if len(spans) else t))
    assert any(i == 301 for i, _ in left) and not any(i in (300, 302) for i, _ in left) and ITEM not in dict(left)[301]
    # packing: all ids of all texts, in pieces
    encode = tokens.PieceEncoder(tokens.default_path()).whole
    expected = sorted((i is None, i or 0, len(encode.encode(t or "", add_special_tokens=False).ids) + 1) for i, t in left)
    got = corpus_pipeline.run(spark, path).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["doc_tokens"]) for r in got if r["start"] == 0) == expected
    assert sum(r["length"] for r in got) == sum(n for *_, n in expected)


def test_stages_keep_columns_and_rows(spark, tables):
    """Each stage on clashing columns and nulls gives the columns it got; clean rows without an id or text stay."""
    rows, labels = corpus()
    path = tables(rows[:80], labels, [(1, ITEM)])
    docs = spark.read.parquet(f"{path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, path)
        assert out.dtypes == docs.dtypes, name
        found = out.collect()
        assert len(found) <= 80 and any(r["text"] is None for r in found), name
    assert corpus_pipeline.STAGES[-1][1](spark, docs, path).where("start = 0").count() == 80


def test_empty_tables(spark, tables):
    path = tables([], [], [])
    docs = spark.read.parquet(f"{path}/documents.parquet")
    assert all(stage(spark, docs, path).count() == 0 for _, stage in corpus_pipeline.STAGES)
    assert corpus_pipeline.run(spark, path).count() == 0
    # no labels, no benchmark: nothing is rejected
    path = tables([(1, prose(1, 50)), (2, None)], [], [])
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, path).collect()} == {1, 2}
