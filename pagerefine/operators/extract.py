"""Pages to Markdown: the extraction step in Python, everything around it in expressions."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from pagerefine.functions.article import extract
from pagerefine.functions.clean import clean_markdown
from pagerefine.functions.shipping import ship, small_batches

FIELDS = ("body", "title", "byline", "excerpt", "site_name", "error")
#: Pages handled at a time; bounds a worker's memory.
STEP = 64


def header(title: Column, byline: Column, site_name: Column, excerpt: Column, url: Column) -> Column:
    """The lines put before the cleaned body, never cleaned themselves; a missing title reads `null`."""
    line = lambda label, c: F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(f"**{label}:** "), c, F.lit("\n\n"))).otherwise(F.lit(""))
    return F.concat(
        F.lit("# "), F.coalesce(title, F.lit("null")), F.lit("\n\n"), line("By", byline), line("Source", site_name), line("Summary", excerpt),
        F.lit("**URL:** "), url, F.lit("\n\n---\n\n"),
    )


def remove_comments(html: Column) -> Column:
    return F.regexp_replace(html, r"(?s)<!--.*?-->", "")


def with_extraction(df: DataFrame, url_col: str = "url", html_col: str = "html", prefix: str = "") -> DataFrame:
    """df without html_col, with prefix + markdown, title, byline, excerpt, site_name, error of each row's page.

    All other columns ride along, so that nothing has to be joined back. A page without an article has only an error.
    """
    ship(df.sparkSession)
    small_batches(df.sparkSession)
    rest = [c for c in df.columns if c != html_col]
    names = [prefix + f for f in FIELDS]
    schema = StructType([df.schema[c] for c in rest] + [StructField(n, StringType()) for n in names])
    source = df.select(*(F.col(f"`{c}`") for c in rest), F.col(f"`{html_col}`").cast("string").alias(html_col))
    url_at = rest.index(url_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, STEP):
                b = batch.slice(i, STEP)
                rows = [extract(h, u) for u, h in zip(b.column(url_at).to_pylist(), b.column(len(rest)).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([*b.columns[: len(rest)], *(pa.array([r[f] for r in rows], pa.string()) for f in FIELDS)], [*rest, *names])

    found = source.mapInArrow(run, schema)
    body, title, byline, excerpt, site_name, error = (F.col(n) for n in names)
    url = F.coalesce(F.col(f"`{url_col}`"), F.lit(""))
    markdown = F.when(error.isNull(), F.concat(header(title, byline, site_name, excerpt, url), clean_markdown(body)))
    return found.select(*(F.col(f"`{c}`") for c in rest), markdown.alias(f"{prefix}markdown"), *names[1:])


def extract_pages(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """url, markdown, title, byline, excerpt, site_name, error: one row per page. A page without an article has only an error."""
    source = pages.select(F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    return with_extraction(source)
