"""Exact length histogram: documents by encoded length; sums along it answer totals, quantiles and truncated totals.

Row for length L: n_docs of that length, docs_le and tokens_le (documents of at most L tokens, and their tokens), docs_gt and
tokens_gt (suffix sums), truncated_total (tokens left if each document is cut at L) and n_cut (tokens lost). Between two
lengths the truncated total is linear, so ``totals_at`` is exact for every context limit.

Cases: null or empty text has length 0; rows that repeat count each; an empty table gives an empty histogram.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import tokens
from .common import extended, limit_batches, materialize, tidy, unused

#: Lengths that one task sums in order; buckets themselves are summed over max length / BUCKET rows.
BUCKET = 4096


def token_lengths(docs: DataFrame, tokenizer: str | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """Columns ``keep`` and n_tokens, a row for each row."""
    path = tokenizer or tokens.default_path()

    def run(batches):
        e = tokens.encoder(path)
        for batch in batches:
            columns = [batch.column(i) for i in range(1, batch.num_columns)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(tokens.count_rows(batch.column(0), e), pa.int64())], [*keep, "n_tokens"])

    limit_batches(docs.sparkSession)
    passed = docs.select(F.col("text").alias(unused("_text", keep)), *keep)
    return passed.mapInArrow(tidy(run), extended(docs.select(*keep), "n_tokens long"))


def histogram(lengths: DataFrame) -> DataFrame:
    """lengths: n_tokens. Rows as described above."""
    # written, as it is read twice: otherwise every text would be encoded twice
    h = materialize(lengths.groupBy(F.col("n_tokens").alias("length")).agg(F.count("*").alias("n_docs")), "length-histogram")
    h = h.withColumn("b", F.expr(f"length div {BUCKET}")).withColumn("t", F.col("length") * F.col("n_docs"))
    buckets = h.groupBy("b").agg(F.sum("n_docs").alias("bd"), F.sum("t").alias("bt"))
    upto = Window.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.orderBy("b").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    buckets = buckets.select(
        "b", F.coalesce(F.sum("bd").over(upto), F.lit(0)).alias("d0"), F.coalesce(F.sum("bt").over(upto), F.lit(0)).alias("t0"), F.sum("bd").over(whole).alias("docs"), F.sum("bt").over(whole).alias("tokens")
    )
    inside = Window.partitionBy("b").orderBy("length").rowsBetween(Window.unboundedPreceding, 0)
    h = h.join(buckets, "b").select("length", "n_docs", (F.col("d0") + F.sum("n_docs").over(inside)).alias("docs_le"), (F.col("t0") + F.sum("t").over(inside)).alias("tokens_le"), "docs", "tokens")
    h = h.select("length", "n_docs", "docs_le", "tokens_le", (F.col("docs") - F.col("docs_le")).alias("docs_gt"), (F.col("tokens") - F.col("tokens_le")).alias("tokens_gt"))
    return h.withColumn("truncated_total", F.expr("tokens_le + docs_gt * length")).withColumn("n_cut", F.expr("tokens_gt - docs_gt * length"))


def length_histogram(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    return histogram(token_lengths(docs, tokenizer))


def totals_at(h: DataFrame, limits: DataFrame) -> DataFrame:
    """limits: a column ``context`` (a stated, small set). Documents over it, and tokens left and lost when cut at it."""
    limits = limits.select("context").distinct()
    at = h.join(F.broadcast(limits), F.col("length") <= F.col("context")).groupBy("context").agg(F.max(F.struct("length", "docs_gt", "tokens_le", "tokens_gt")).alias("r"))
    total = h.agg(F.coalesce(F.sum("n_docs"), F.lit(0)).alias("_d"), F.coalesce(F.sum(F.expr("n_docs * length")), F.lit(0)).alias("_t"))
    row = limits.join(at, "context", "left").join(F.broadcast(total))
    return row.select(
        "context",
        F.coalesce("r.docs_gt", "_d").alias("docs_over"),
        F.expr("coalesce(r.tokens_le + r.docs_gt * context, _d * context)").alias("truncated_total"),
        F.expr("coalesce(r.tokens_gt - r.docs_gt * context, _t - _d * context)").alias("n_cut"),
    )


def quantiles(h: DataFrame, fractions: list[float]) -> DataFrame:
    """fraction, length: the least length that at least that fraction of the documents doesn't exceed."""
    spark = h.sparkSession
    qs = spark.createDataFrame([(float(f),) for f in fractions], "fraction double")
    share = F.col("docs_le") / (F.col("docs_le") + F.col("docs_gt"))
    return h.withColumn("share", share).join(F.broadcast(qs), F.col("share") >= F.col("fraction")).groupBy("fraction").agg(F.min("length").alias("length"))
