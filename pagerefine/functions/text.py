"""Text helpers with the meaning they have in web pages' own language, on Spark columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: what the web's \s and trim take as white space, as a class body that Java and RE2 read alike.
WHITE = r"\x20\t\n\x0B\f\r\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"
TRIM = rf"\A[{WHITE}]+|[{WHITE}]+\z"


def trimmed(text: Column) -> Column:
    """text without white space at its ends; Spark's trim takes the blank alone."""
    return F.regexp_replace(text, TRIM, "")


def is_blank(text: Column) -> Column:
    return ~text.rlike(f"[^{WHITE}]")


def utf16_length(text: Column) -> Column:
    """Length in UTF-16 code units; length() counts code points."""
    return (F.octet_length(F.encode(text, "UTF-16LE")) / 2).cast("long")


def clipped(text: Column, most: int) -> Column:
    """The first `most` characters, with three dots if there were more."""
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit("..."))).otherwise(text)


def rounded(value: Column) -> Column:
    """Nearest whole number, halves up."""
    return F.floor(value + 0.5).cast("long")


def tokens(text: Column) -> Column:
    """Estimated tokens: a quarter of the characters."""
    return rounded(F.length(text) / 4)


def size_kb(size: Column) -> Column:
    return rounded(size / 1024)


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def join_path(folder: Column, name: Column) -> Column:
    return F.concat_ws("/", folder, name)


def utc_day() -> Column:
    """Today in UTC as yyyy-MM-dd."""
    return F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd")


def slug(title: Column) -> Column:
    """Lower case, runs of other than a-z and 0-9 as one dash, none at the ends, at most 60 characters."""
    dashed = F.regexp_replace(F.lower(title), "[^a-z0-9]+", "-")
    return F.substring(F.regexp_replace(dashed, r"\A-|-\z", ""), 1, 60)


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))
