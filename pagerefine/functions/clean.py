"""Markdown clean-up: three ordered stages of rewrites, each a Catalyst expression."""

from __future__ import annotations

from dataclasses import dataclass
from itertools import groupby

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import TRIM, WHITE, is_blank, once

_FENCE = "```"


@dataclass(frozen=True)
class Rewrite:
    """One step. pattern and to are Java's; re2 and re2_to say the same for engines without look-around, `times` over.

    literal: what the pattern says, as plain text, which is found without a pattern.
    letters: characters that become those of `to`, place by place, or go; instead of a pattern, or as one says for SQL.
    same: leaves every text as it is.
    collapse: only lines that don't start with a fence are rewritten.
    """

    name: str
    pattern: str = ""
    to: str = ""
    re2: str | None = None
    re2_to: str | None = None
    times: int = 1
    literal: str = ""
    letters: str = ""
    same: bool = False
    collapse: bool = False

    def column(self, text: Column) -> Column:
        if self.same:
            return text
        if self.letters:
            return F.translate(text, self.letters, self.to)
        if self.literal:
            return F.replace(text, F.lit(self.literal), F.lit(self.to))
        if self.collapse:
            lines = F.transform(F.split(text, "\n"), lambda x: F.when(x.startswith(_FENCE), x).otherwise(F.regexp_replace(x, self.pattern, self.to)))
            return F.array_join(lines, "\n")
        return F.regexp_replace(text, self.pattern, self.to)

    def sql(self, text: str) -> str:
        """The same for DuckDB."""
        quote = lambda s: "'" + s.replace("'", "''") + "'"
        if self.letters and not self.pattern:
            return f"translate({text}, {quote(self.letters)}, {quote(self.to)})"
        pattern = self.re2 if self.re2 is not None else self.pattern.replace("(?dm)", "(?m)")
        to = self.re2_to if self.re2_to is not None else self.to.replace("$1", "\\1").replace("$2", "\\2")
        if self.collapse:
            line = f"CASE WHEN starts_with(l, '{_FENCE}') THEN l ELSE regexp_replace(l, {quote(pattern)}, {quote(to)}, 'g') END"
            return f"array_to_string(list_transform(string_split({text}, chr(10)), lambda l: {line}), chr(10))"
        for _ in range(self.times):
            text = f"regexp_replace({text}, {quote(pattern)}, {quote(to)}, 'g')"
        return text


# The rewrites, in order.
STRUCTURE = (
    Rewrite("crlf", r"\r\n", "\n", literal="\r\n"),
    Rewrite("blank_lines", r"\n{3,}", "\n\n"),
    Rewrite("line_ends", r"[ \t]+([\n\r\x{2028}\x{2029}]|\z)", "$1"),
    Rewrite("trim", TRIM, ""),
    Rewrite("before_header", r"([^\n])\n(#{1,6} )", "$1\n\n$2"),
    Rewrite("after_header", r"(#{1,6} [^\n\r\x{2028}\x{2029}]+)\n([^#\n])", "$1\n\n$2"),
    Rewrite("before_list", r"([^\n])\n([-*+] |[0-9]+\. )", "$1\n\n$2"),
    Rewrite("after_mark", r"([*_]) +", "$1"),
    Rewrite("before_mark", r" +([*_])", "$1"),
    Rewrite("before_fence", rf"([^\n])\n{_FENCE}", f"$1\n\n{_FENCE}"),
    Rewrite("after_fence", rf"{_FENCE}\n([^`])", f"{_FENCE}\n\n$1"),
    Rewrite("comments", r"(?s)<!--.*?-->", " "),
    Rewrite("spaces", r" {2,}", " "),
)
CONTENT = (
    Rewrite("empty_links", r"\[([^\]]+)\]\(\)", "$1"),
    Rewrite("tags", r"<[^>]+>", ""),
    Rewrite("empty_bold", r"\*{4}", "", literal="****"),
    Rewrite("bold", r"(?<!\*)\*\*(?!\*)", "", r"(^|[^*])\*\*([^*]|$)", r"\1\2", 2),
    Rewrite("underlines", r"__", "", literal="__"),
    Rewrite("bare_images", r"!\[\]\(([^)]+)\)", "![]($1)", same=True),
    Rewrite("zero_width", r"[\x{200B}-\x{200D}\x{FEFF}]", "", letters="\u200b\u200c\u200d\ufeff"),
    Rewrite("double_quotes", letters="“”", to='""'),
    Rewrite("single_quotes", letters="‘’", to="''"),
    Rewrite("dashes", letters="–—", to="--"),
    Rewrite("line_spaces", r" {2,}", " ", collapse=True),
)
FINISH = (
    Rewrite("bullets", rf"(?dm)^([{WHITE}]*)[*+] ", "$1- "),
    Rewrite("emphasis", r"_([^_]+)_", "*$1*"),
    Rewrite("tilde_open", r"(?dm)^~~~([A-Za-z0-9_]*)\n", f"{_FENCE}$1\n"),
    Rewrite("tilde_close", r"(?dm)^~~~$", _FENCE),
    Rewrite("blank_lines", r"\n{3,}", "\n\n"),
    Rewrite("trim", TRIM, ""),
)


def _apply(text: Column, steps: tuple[Rewrite, ...]) -> Column:
    """The steps in order; those that map single letters, in a row and none of another one's making, as one."""
    for letters, group in groupby(steps, lambda s: bool(s.letters)):
        own = list(group)
        if letters:
            own.sort(key=lambda s: len(s.letters) != len(s.to))  # letters that go stand last
            own = [Rewrite("letters", letters="".join(s.letters for s in own), to="".join(s.to for s in own))]
        for step in own:
            text = step.column(text)
    return text


def clean_structure(text: Column) -> Column:
    """Line ends, blank lines around headers, lists and fences, marks, comments; blank text stays as it is."""
    return F.when(is_blank(text), text).otherwise(_apply(text, STRUCTURE))


def clean_content(text: Column) -> Column:
    """Empty links, tags, bold, invisible characters, quotes and dashes."""
    return _apply(text, CONTENT)


def clean_finish(text: Column) -> Column:
    """Bullets, emphasis, fences, and one line end at the end; blank text stays as it is."""
    return F.when(is_blank(text), text).otherwise(F.concat(_apply(text, FINISH), F.lit("\n")))


def clean_markdown(text: Column) -> Column:
    """All three stages; blank text stays as it is."""
    return F.when(is_blank(text), text).otherwise(once(_apply(_apply(text, STRUCTURE), CONTENT), clean_finish))


def stage_sql(stage: str, text: str) -> str:
    """The SQL of a stage over an SQL expression of a text that isn't blank."""
    steps = {"structure": STRUCTURE, "content": CONTENT, "finish": FINISH}[stage]
    for step in steps:
        text = step.sql(text)
    return f"({text}) || chr(10)" if stage == "finish" else text
