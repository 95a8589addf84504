"""The header block of a stored reference: encode, decode, strip."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import WHITE, trimmed

# The block, its keys, and how a value is found.
BLOCK = r"\A---\n((?s:.*?))\n---"
BLOCK_AND_LINES = r"\A---\n(?s:.*?)\n---\n*"
KEYS = {"title": "title", "url": "source_url", "fetched_date": "fetched_date", "query": "query"}


def value_pattern(key: str) -> str:
    """After the key any white space, line ends included, so that an empty value takes the next line."""
    return rf"(?m)^{key}:[{WHITE}]*([^\n\r\x{{2028}}\x{{2029}}]+)"


def value(block: Column, key: str) -> Column:
    """A key's value without white space and one quote at each end; empty if the key is missing. Quotes inside stay escaped."""
    found = trimmed(F.regexp_extract(block, value_pattern(key).replace("(?m)", "(?dm)"), 1))
    return trimmed(F.regexp_replace(found, r"""\A["']|["']\z""", ""))


def has_block(text: Column) -> Column:
    return text.rlike(BLOCK)


def strip(text: Column) -> Column:
    """text without its header block and the line ends after it."""
    return F.regexp_replace(text, BLOCK_AND_LINES, "")


def quoted(text: Column) -> Column:
    return F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('\\"')), F.lit('"'))


def encode(title: Column, url: Column, day: Column, query: Column, content: Column, status: Column | None = None) -> Column:
    """A stored reference's text; the query's line only if there is one."""
    status = F.lit("temporary") if status is None else status
    asked = F.when(F.coalesce(query, F.lit("")) != "", F.concat(F.lit("query: "), quoted(query), F.lit("\n"))).otherwise(F.lit(""))
    return F.concat(
        F.lit("---\ntitle: "), quoted(title), F.lit("\nsource_url: "), url, F.lit("\nfetched_date: "), day,
        F.lit("\ntype: web\nstatus: "), status, F.lit("\n"), asked, F.lit("---\n\n"), content,
    )


def decode(files: DataFrame, file_name: str = "file_name", text: str = "value", keep: tuple[str, ...] = ()) -> DataFrame:
    """References of files, with the columns named in keep: ref_id, title, url, fetched_date, size, query, status, value; files without a block are left out."""
    block = F.regexp_extract(text, BLOCK, 1)
    rows = files.where(has_block(F.col(text))).withColumn("__block", block)
    found = {n: value(F.col("__block"), k) for n, k in KEYS.items()}
    return rows.select(
        F.regexp_replace(file_name, r"\.md\z", "").alias("ref_id"), found["title"].alias("title"), found["url"].alias("url"), found["fetched_date"].alias("fetched_date"),
        F.length(text).cast("long").alias("size"), F.nullif(found["query"], F.lit("")).alias("query"), value(F.col("__block"), "status").alias("status"), F.col(text).alias("value"),
        *keep,
    )


def permanent(text: Column) -> Column:
    """text with its first temporary status made permanent."""
    at = rf"(?dm)\A((?s:.*?))^status:[{WHITE}]*temporary$"
    return F.regexp_replace(text, at, "$1status: permanent")
