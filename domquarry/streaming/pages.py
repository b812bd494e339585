"""The same operators over streams: a page is one row and parsing keeps no state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..operators.parse import Parsed, parse_html, select_html


def read_page_stream(spark: SparkSession, path: str, schema: StructType, files_per_trigger: int = 16) -> DataFrame:
    """New Parquet files of pages as they arrive."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def parse_stream(pages: DataFrame, html: str = "html", id_col: str = "doc_id") -> Parsed:
    """Stateless, so the result of each batch depends on its own pages only."""
    return parse_html(pages, html, id_col, partitions=None)


def select_stream(pages: DataFrame, selector: str, html: str = "html", id_col: str = "doc_id") -> DataFrame:
    return select_html(pages, selector, html, id_col, partitions=None)


def write_selected(pages: DataFrame, selector: str, out: str, checkpoint: str, html: str = "html", id_col: str = "doc_id") -> StreamingQuery:
    """Matches appended to a Parquet table, each page once."""
    return select_stream(pages, selector, html, id_col).writeStream.format("parquet").option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start(out)


def arrivals(pages: DataFrame, ts: str = "ts", window: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Pages by window of arrival; later ones than the watermark are left out."""
    return pages.withWatermark(ts, late).groupBy(F.window(ts, window)).agg(F.count("*").alias("n_pages"))
