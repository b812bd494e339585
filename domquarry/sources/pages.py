"""Where pages come from and where results go: tables, files of bytes, temporary views and SQL functions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import entities
from ..operators.parse import Parsed, parse_html, parse_html_bytes, parse_string, select_html
from ..operators.serializer import FIELDS, flatten


def read_pages(spark: SparkSession, path: str, id_col: str = "page_id", html: str = "html") -> DataFrame:
    """doc_id, url if there is one, and html of a Parquet table of pages."""
    df = spark.read.parquet(path)
    return df.select(F.col(id_col).alias("doc_id"), *(c for c in ("url",) if c in df.columns), F.col(html).alias("html"))


def read_html_files(spark: SparkSession, path: str, content_type: str | None = None) -> Parsed:
    """Parses files of undecoded bytes; doc_id is a hash of the path."""
    files = spark.read.format("binaryFile").load(path)
    files = files.select(F.xxhash64("path").alias("doc_id"), "path", "content", F.lit(content_type).alias("content_type"))
    return parse_html_bytes(files, "content", "content_type" if content_type else None)


def register_views(parsed: Parsed, prefix: str = "") -> Parsed:
    """Temporary views docs, nodes and errors over one kept parse."""
    kept = parsed.cached()
    kept.docs.createOrReplaceTempView(prefix + "docs")
    kept.nodes.createOrReplaceTempView(prefix + "nodes")
    kept.errors.createOrReplaceTempView(prefix + "errors")
    return kept


def register_functions(spark: SparkSession) -> None:
    """SQL functions html_escape, html_unescape, html_text and the table functions html_nodes(html), html_select(html, selector)."""
    from pyspark.sql.functions import pandas_udf, udtf

    @pandas_udf("string")
    def html_text(column: pd.Series) -> pd.Series:
        return column.map(lambda s: None if s is None else flatten(parse_string(s)[0].document)[1])

    @udtf(returnType="node_id int, tag string, text string, html string")
    class HtmlSelect:
        def eval(self, html: str, selector: str):
            from ..operators.parse import _detached, preorder
            from ..plans.matcher import Matcher

            if html is None:
                return
            match = Matcher(selector)
            for i, node in enumerate(preorder(parse_string(html)[0].document)):
                if node.kind == "element" and match.matches(node):
                    _, text, outer = flatten(_detached(node))
                    yield i, node.tag, text, outer

    @udtf(returnType="node_id int, parent_id int, depth int, node_type string, tag string, data string, text string")
    class HtmlNodes:
        def eval(self, html: str):
            if html is None:
                return
            rows, text, _ = flatten(parse_string(html)[0].document)
            for r in rows:
                row = dict(zip(FIELDS, r, strict=True))
                yield row["node_id"], row["parent_id"], row["depth"], row["node_type"], row["tag"], row["data"], text[row["text_start"] : row["text_end"]]

    entities.register(spark)
    spark.udtf.register("html_nodes", HtmlNodes)
    spark.udf.register("html_text", html_text)
    spark.udtf.register("html_select", HtmlSelect)


def write_nodes(parsed: Parsed, path: str, mode: str = "error") -> None:
    """nodes as Parquet in tree order within files."""
    parsed.nodes.sortWithinPartitions("doc_id", "node_id").write.mode(mode).parquet(path)


__all__ = ["parse_html", "read_html_files", "read_pages", "register_functions", "register_views", "select_html", "write_nodes"]
