"""A corpus pipeline of five of the subpackage's operators; each stage works on all that its predecessor kept.

Cases: a null or empty text is scored as an empty one by the first stage and passes the three after it as it is; a row without
doc_id counts in no group of lines or copies and stays, but loses hot lines; rows that repeat a doc_id are each judged by their own
text; empty tables give an empty result, and without labels of both kinds or without benchmark items nothing is rejected by these
stages (unless all labels are 0). Columns of any other name go along as they are. All but the last stage return the columns of docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from domquarry.llm import decontaminate, line_dedup, near_dedup, packing, quality
from domquarry.llm.common import materialize, table, unused


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def line_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that many documents share stay in one of them; n_chars follows the text."""
    aside = {c: unused(f"_{c}", docs.columns) for c in ("kept_text", "n_lines", "n_dropped") if c in docs.columns}
    out = line_dedup.dedup_lines(docs.withColumnsRenamed(aside))
    text = F.when(F.col("text").isNull(), F.lit(None)).otherwise(F.col("kept_text"))
    made = {"text": text} | ({"n_chars": F.when(F.col("n_dropped") > 0, F.length("kept_text")).otherwise(F.col("n_chars"))} if "n_chars" in docs.columns else {})
    return out.select(*(made[c].cast(docs.schema[c].dataType).alias(c) if c in made else F.col(aside.get(c, c)).alias(c) for c in docs.columns))


def minhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays; copies have a similarity of 0.8 or more."""
    return near_dedup.dedup_near(docs, percent=80)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated documents go; others lose the spans that benchmark items share with them."""
    return decontaminate.remove_contamination(docs, table(spark, sf_dir, "benchmark"))


def bm25_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 1024 tokens."""
    return packing.pack(docs)


STAGES = [
    ("quality", quality_classifier),
    ("line_dedup", line_deduplication),
    ("near_dedup", minhash_near_dedup),
    ("decontaminate", benchmark_decontamination),
    ("packing", bm25_packing),
]

#: A boosted classifier and a tokenizer have no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
