"""Links of Markdown texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import once

# Fixed value: a link; images match too, and a title stays in the address.
LINK = r"\[([^\]]+)\]\(([^)]+)\)"


def links(text: Column) -> Column:
    """All links in order: array of struct(text, href)."""
    part = lambda i: F.regexp_extract_all(text, F.lit(LINK), F.lit(i))
    return F.zip_with(part(1), part(2), lambda t, h: F.struct(t.alias("text"), h.alias("href")))


def is_web(href: Column) -> Column:
    return href.startswith("http://") | href.startswith("https://")


def web_links(text: Column) -> Column:
    """Links with http or https addresses, the first of each address, in order.

    Kept within the row: no shuffle, however many links all rows have together. A row's links are sorted by address
    and place, which brings the first of each to the front, and back by place.
    """
    found = F.filter(links(text), lambda x: is_web(x["href"]))
    keyed = F.sort_array(F.transform(found, lambda x, i: F.struct(x["href"].alias("href"), i.alias("i"), x["text"].alias("text"))))

    def firsts(by_href: Column) -> Column:
        fresh = lambda x, k: (k == 0) | (F.get(by_href, k - 1)["href"] != x["href"])
        placed = F.transform(F.filter(by_href, fresh), lambda x: F.struct(x["i"].alias("i"), x["text"].alias("text"), x["href"].alias("href")))
        return F.transform(F.sort_array(placed), lambda x: F.struct(x["text"].alias("text"), x["href"].alias("href")))

    return once(keyed, firsts)


def exploded(df: DataFrame, source: str, text: str) -> DataFrame:
    """source_ref, pos, text, href: one row for each web link."""
    rows = df.select(F.col(source).alias("source_ref"), web_links(F.col(text)).alias("__links"))
    return rows.select("source_ref", F.posexplode("__links").alias("pos", "x")).select("source_ref", "pos", "x.text", "x.href")
