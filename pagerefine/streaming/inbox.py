"""Pages that arrive as files, refined as a stream; an extension, as the store itself is batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from pagerefine.functions.quality import score
from pagerefine.operators.extract import extract_pages

PAGES = "url string, html string, arrived timestamp"


def read_inbox(spark: SparkSession, folder: str) -> DataFrame:
    """Parquet files of url, html, arrived, as they come."""
    return spark.readStream.schema(PAGES).parquet(folder)


def refine(pages: DataFrame, late: str = "1 day") -> DataFrame:
    """Extracted and scored pages, each url once within the watermark's reach, so that state stays bounded."""
    once = pages.withWatermark("arrived", late).dropDuplicatesWithinWatermark(["url"])
    return score(extract_pages(once), "markdown", "quality")


def run_available(pages: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Refine what is there, append it to `out`, and end."""
    return refine(pages).writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(out)
