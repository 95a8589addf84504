"""Where pages and stored files come from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from pagerefine.operators.route import http_error

RAW_PAGES = "url string, html string, http_status int, status_text string, error string"


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, url, html and the columns of a fetch that went well."""
    ok = {"http_status": F.lit(200), "status_text": F.lit("OK"), "error": F.lit(None).cast("string")}
    return spark.read.parquet(f"{sf_dir}/pages.parquet").withColumns(ok)


def with_http_errors(raw: DataFrame) -> DataFrame:
    """raw(html, http_status, status_text, error) where a status other than 2xx is an error without html."""
    error = F.coalesce(F.col("error"), http_error(F.col("http_status"), F.col("status_text")))
    return raw.withColumn("error", error).withColumn("html", F.when(F.col("error").isNull(), F.col("html")).otherwise(F.lit("")))


def stored_files(spark: SparkSession, folder: str, status: str = "temporary") -> DataFrame:
    """status, filepath, value of the Markdown files in a folder, each read whole; a missing folder has none.

    Names that start with a dot or an underscore are invisible to Spark's readers.
    """
    try:
        files = spark.read.text(folder, wholetext=True, pathGlobFilter="*.md")
    except AnalysisException:
        return spark.createDataFrame([], "status string, filepath string, value string")
    return files.select(F.lit(status).alias("status"), F.col("_metadata.file_path").alias("filepath"), "value")


def render_stub(html: Column, page_id: Column) -> Column:
    """A deterministic stand-in for a rendered page: the article's inner HTML, or the page with the article unmarked."""
    inner = F.regexp_extract(html, r"(?s)<article>(.*?)</article>", 1)
    return F.when(page_id % 6 == 0, F.regexp_replace(html, "</?article>", "")).otherwise(inner)
