from collections import Counter

from texts import EDGE_TEXTS, prose

from domquarry.llm import tokens
from domquarry.llm.token_counts import length_histogram, quantiles, token_lengths, totals_at

ROWS = [*enumerate(EDGE_TEXTS), *((100 + i, prose(i, 5 + 13 * (i % 9))) for i in range(60)), (100, "again"), (None, "no id"), (900, prose(9, 4000))]


def lengths():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokens.default_path())
    t.encode_special_tokens = True
    return [len(t.encode(x or "", add_special_tokens=False).ids) for _, x in ROWS]


def test_histogram(spark, docs_of):
    n = lengths()
    h = length_histogram(docs_of(ROWS)).cache()
    rows = {r["length"]: r for r in h.collect()}
    assert {k: r["n_docs"] for k, r in rows.items()} == Counter(n)
    for k, r in rows.items():
        assert r["docs_le"] == sum(x <= k for x in n) and r["tokens_le"] == sum(x for x in n if x <= k)
        assert r["docs_gt"] == sum(x > k for x in n) and r["tokens_gt"] == sum(x for x in n if x > k)
        assert r["truncated_total"] == sum(min(x, k) for x in n) and r["n_cut"] == sum(max(x - k, 0) for x in n)
    limits = [0, 1, 7, 100, 101, 5000, 10**7]
    for r in totals_at(h, spark.createDataFrame([(x,) for x in limits], "context long")).collect():
        k = r["context"]
        assert (r["docs_over"], r["truncated_total"], r["n_cut"]) == (sum(x > k for x in n), sum(min(x, k) for x in n), sum(max(x - k, 0) for x in n))
    ordered = sorted(n)
    for r in quantiles(h, [0.01, 0.5, 0.9, 1.0]).collect():
        share = r["fraction"]
        assert r["length"] == next(x for i, x in enumerate(ordered) if sum(y <= x for y in n) / len(n) >= share)


def test_rows_and_empty_tables(docs_of):
    out = token_lengths(docs_of(ROWS), keep=("doc_id",))
    assert sorted(r["n_tokens"] for r in out.collect()) == sorted(lengths()) and out.columns == ["doc_id", "n_tokens"]
    assert length_histogram(docs_of([])).count() == 0
