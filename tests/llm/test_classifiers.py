import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from texts import EDGE_TEXTS, prose

from domquarry.llm import language_id, quality, toxicity
from domquarry.llm.common import span_hash
from domquarry.llm.ngrams import LETTERS, MARKED

BAD = ["grobblenak", "snarfulous", "wicketrude"]


def toxic_rows(n, start=0):
    rng = random.Random(start)
    rows = []
    for i in range(start, start + n):
        words = prose(i, 60 if i % 5 else 400).split(" ")
        toxic = i % 2
        for _ in range(2 + len(words) // 80 if toxic else 0):
            words.insert(rng.randint(0, len(words)), rng.choice(BAD))
        rows.append((i, " ".join(words), toxic))
    return rows


def held(i, n=3, r=1):
    return zlib.crc32(str(i).encode()) % n == r


def test_toxicity(spark, docs_of):
    rows = toxic_rows(400)
    edge = [(10_000 + i, t) for i, t in enumerate(EDGE_TEXTS)]
    docs = docs_of([(i, t) for i, t, _ in rows] + edge + [(0, rows[0][1]), (None, "x")])
    labels = spark.createDataFrame([(i, 1, y) for i, _, y in rows] + [(None, 1, 1), (5, 1, None), (0, 1, 0)], "doc_id long, quality int, toxic int")
    out = toxicity.toxicity(docs, labels).collect()
    assert len(out) == len(rows) + len(edge) + 2 and all(0 <= r["score"] <= 1 for r in out)
    assert all(r["predicted"] == int(r["score"] >= 0.7) for r in out)
    by = {r["doc_id"]: r for r in out}
    test = [i for i, _, _ in rows if held(i)]
    assert all(by[i]["held_out"] == held(i) for i, _, _ in rows)
    assert np.mean([by[i]["predicted"] == dict((a, c) for a, _, c in rows)[i] for i in test]) > 0.97


def test_misspellings_share_ngrams():
    rows = toxic_rows(300)
    m = toxicity.train([t for _, t, _ in rows], np.array([y for *_, y in rows]))
    clean = prose(9999, 60)
    s = m.scores(pa.array([clean, f"{clean} grobblenack", f"{clean} xgrobblenak", f"{clean} snarfuloous"]))
    assert (s[1:] > s[0] + 0.1).all()


def test_toxicity_wherever_words_stand():
    """Words put in front move no prediction, and what else is in a batch moves no score."""
    rows = toxic_rows(400)
    m = toxicity.train([t for _, t, _ in rows], np.array([y for *_, y in rows]))
    texts = [t for _, t, _ in toxic_rows(200, 1000)]
    base = m.scores(pa.array(texts))
    assert (base == np.concatenate([m.scores(pa.array([t])) for t in texts])).all()
    for k in range(1, 8):
        moved = m.scores(pa.array([f"{prose(7, k)} {t}" for t in texts]))
        assert ((moved >= toxicity.THRESHOLD) != (base >= toxicity.THRESHOLD)).mean() < 0.02


def plain_ngrams(word, sizes):
    """A word's n-grams in bytes, plainly."""
    raw = b"<" + word + b">"
    return [raw[i : i + k] for k in sizes for i in range(len(raw) - k + 1)]


def bucket_of(gram, buckets, seed=0):
    data = np.frombuffer(gram, np.uint8)
    return int(span_hash(data, np.array([0]), np.array([len(data)]), seed)[0] & np.uint64(buckets - 1))


def words_by(text, marked):
    out, word = [], b""
    for byte in (text or "").lower().encode() + b" ":
        if byte != 0x20 and marked[byte]:
            word += bytes([byte])
        elif word:
            out.append(word)
            word = b""
    return out


def test_toxicity_by_brute_force():
    """Every score again, word by word and window by window."""
    rows = toxic_rows(120)
    m = toxicity.train([t for _, t, _ in rows], np.array([y for *_, y in rows]))
    texts = [*EDGE_TEXTS, *(t for _, t, _ in toxic_rows(30, 500))]
    for text, got in zip(texts, m.scores(pa.array(texts)), strict=True):
        logits = []
        for w in words_by(text, MARKED):
            of = [bucket_of(g, toxicity.BUCKETS) for g in plain_ngrams(w, toxicity.SIZES)] + [bucket_of(b"<" + w + b">", toxicity.BUCKETS, 1)]
            logits.append(sum(float(m.u[i]) for i in of) / len(of))
        size = min(toxicity.WINDOW, max(1, len(logits)))
        best = max(sum(logits[i : i + size]) / size for i in range(max(1, len(logits) - size + 1)))
        assert abs(got - 1 / (1 + np.exp(-(m.bias + toxicity.WINDOW * best)))) < 1e-5


def test_languages_by_brute_force():
    texts = [sample(x, i) for i, x in enumerate(list(LANGUAGES) * 20)]
    m = language_id.train(language_id._shares(pa.array(texts)).to_pylist(), list(LANGUAGES) * 20)
    asked = [*EDGE_TEXTS, *(sample(x, i + 999, 5) for i, x in enumerate(list(LANGUAGES) * 5))]
    lang, score, _ = m.predict(pa.array(asked))
    for text, got, s in zip(asked, lang, score, strict=True):
        grams = [bucket_of(g, language_id.BUCKETS) for w in words_by(text, LETTERS) for g in plain_ngrams(w, language_id.SIZES)]
        if not any(c.isalpha() for c in text or ""):
            assert (got, s) == ("und", 0)
            continue
        f = m.bias + language_id.SCALE * sum(m.table[g].astype(float) for g in grams) / len(grams)
        like = np.exp([-sum(np.logaddexp(0, -a * c) for a, c in zip(f, code, strict=True)) for code in m.code])
        assert got == m.languages[int(like.argmax())] and abs(s - like.max() / like.sum()) < 1e-4


def test_toxicity_without_labels(spark, docs_of):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert [r["score"] for r in toxicity.toxicity(docs_of([(1, "a"), (2, None)]), none).collect()] == [0.5, 0.5]
    one = spark.createDataFrame([(i, 1, 1) for i in range(9)], "doc_id long, quality int, toxic int")
    assert all(r["score"] > 0.5 for r in toxicity.toxicity(docs_of([(i, "a") for i in range(9)]), one).collect())
    assert toxicity.toxicity(docs_of([]), none).count() == 0


LANGUAGES = {"aa": "shka troz plim vrenk", "bb": "oolia maiuu eaoo iluua", "cc": "ninge tand dwerf huil", "dd": "çéa ùrê êlo àvi"}


def sample(lang, seed, n=40):
    rng = random.Random(f"{lang}{seed}")
    parts = [w[i : i + 3] for w in LANGUAGES[lang].split() for i in range(len(w) - 2)]
    return " ".join("".join(rng.choice(parts) for _ in range(rng.randint(1, 3))) for _ in range(n))


def test_languages(spark):
    rows = [(i, sample(x, i, 3 if i % 7 == 0 else 40), x) for i, x in enumerate(list(LANGUAGES) * 60)]
    edge = [(10_000 + i, t, None) for i, t in enumerate([*EDGE_TEXTS, "123 ½² !!", "中文"])]
    docs = spark.createDataFrame([*rows, *edge, (None, "x", "aa"), rows[0]], "doc_id long, text string, lang string").selectExpr("*", "'z' AS lang_pred", "1 AS score")
    out = language_id.languages(docs).collect()
    assert len(out) == len(rows) + len(edge) + 2 and all(0 <= r["score"] <= 1 for r in out)
    by = {r["doc_id"]: r for r in out}
    test = [(i, x) for i, _, x in rows if held(i)]
    assert np.mean([by[i]["lang_pred"] == x for i, x in test]) > 0.95
    for i, t, _ in edge:
        letter = any(c.isalpha() for c in t or "")
        assert (by[i]["lang_pred"] == "und") == (not letter) and (letter or by[i]["score"] == 0)


def test_no_language(spark):
    docs = spark.createDataFrame([(1, "abc", None), (2, None, "en")], "doc_id long, text string, lang string")
    assert {r["lang_pred"] for r in language_id.languages(docs).collect()} == {"und"}
    assert language_id.languages(docs.limit(0)).count() == 0
    only = spark.createDataFrame([(i, "abc", "en") for i in range(9)], "doc_id long, text string, lang string")
    assert {r["lang_pred"] for r in language_id.languages(only).collect()} == {"en"}


@pytest.mark.parametrize("n", [2, 4, 30])
def test_codewords_differ(n):
    c = language_id.codewords(n)
    d = (c.shape[1] - c @ c.T) // 2 + np.eye(n, dtype=int) * 99
    assert d.min() >= c.shape[1] // 5 and set(np.unique(c)) == {-1, 1} and (np.abs(c.sum(0)) < n).all()


def junk(i):
    rng = random.Random(i)
    return [" ".join(["Spam,"] * 80), prose(i, 60).upper().replace(" ", "!! "), " | ".join(prose(i, 50).split()), "".join(w + rng.choice(["$$$ ", "%%% ", "### "]) for w in prose(i, 50).split())][i % 4]


def test_quality(spark, docs_of):
    rows = [(i, junk(i) if i % 3 == 0 else prose(i, 30 + i % 90), int(i % 3 != 0)) for i in range(360)]
    edge = [(10_000 + i, t) for i, t in enumerate(EDGE_TEXTS)]
    docs = docs_of([(i, t) for i, t, _ in rows] + edge + [(0, rows[0][1]), (None, "x")])
    labels = spark.createDataFrame([(i, y, 0) for i, _, y in rows] + [(None, 1, 1), (5, None, 1)], "doc_id long, quality int, toxic int")
    out = quality.quality(docs, labels).collect()
    assert len(out) == len(rows) + len(edge) + 2 and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in out)
    by = {r["doc_id"]: r for r in out}
    test = [(i, y) for i, _, y in rows if held(i, 5, 0)]
    assert all(by[i]["held_out"] for i, _ in test)
    assert np.mean([by[i]["predicted"] == y for i, y in test]) > 0.97
    docs = docs.withColumn("_quality", F.lit(2)).withColumn("_text", F.lit("q"))
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == {r["doc_id"] for r in out if r["predicted"]}


def test_quality_without_labels(spark, docs_of):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert [r["score"] for r in quality.quality(docs_of([(1, "a")]), none).collect()] == [0.5]
    assert quality.quality(docs_of([]), none).count() == 0


def test_tables_are_additive():
    rng = np.random.default_rng(0)
    x = rng.random((500, len(quality.FEATURES)))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)  # only a pair explains it
    m = quality.train(x, y)
    assert ((m.scores(x) > 0.5) == (y == 1)).mean() > 0.9
    b = m.bins(x)
    by_hand = m.bias + sum(t[b[:, j]] for j, t in enumerate(m.tables)) + sum(t[m.coarse(b, i), m.coarse(b, j)] for i, j, t in m.pairs)
    assert np.allclose(by_hand, m.logits(x))


def test_drawn_rows_are_bounded_and_ties_are_settled(spark):
    from domquarry.llm.common import labelled_sample

    # one id on many rows gives one row; of its labels the least counts; long texts give a window, none is left out
    docs = spark.createDataFrame([(1, f"copy {i}") for i in range(200)] + [(2, "abc " * 500), (3, None), (4, "short")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 1), (3, 1), (4, None)], "doc_id long, toxic int")
    got = {(r["doc_id"], r["_label"]): r["x"] for r in labelled_sample(docs, labels, "toxic", F.lit(True), 10, 100).collect()}
    assert set(got) == {(1, "0"), (2, "1")} and got[1, "0"].startswith("copy ") and len(got[2, "1"]) == 100 and got[2, "1"] in "abc " * 500


def test_every_label_value_is_drawn_from(spark):
    from domquarry.llm.common import labelled_sample

    rows = [(i, f"text {i}", f"l{i % 70:02d}") for i in range(700)] + [(700 + i, f"text {700 + i}", "l00") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = labelled_sample(docs, docs.select("doc_id", "lang"), "lang", F.lit(True), 5, 100).groupBy("_label").count().collect()
    assert len(got) == 70 and sum(r["count"] for r in got) <= 64 * 5 and min(r["count"] for r in got) >= 1
