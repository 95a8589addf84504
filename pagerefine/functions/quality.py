"""Quality score of Markdown from 0 to 100, with issues and warnings, as Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import WHITE, trimmed

# What is counted, read alike by Java and RE2.
TAG = r"<[^>]+>"
TAG_OR_EMPTY = r"<[^>]*>"
TABLE_TAG = rf"<[Tt][RrDd][{WHITE}>]"
SCRIPT = r"<[Ss][Cc][Rr][Ii][Pp][Tt]"
STYLE = r"<[Ss][Tt][Yy][Ll][Ee]"
MARKS = r"[#*\-_`\[\]()]"
NEWLINES = r"\n{5,}"
VALID = 60


def measures(md: Column) -> dict[str, Column]:
    """Counts that the rules use."""
    text = F.regexp_replace(md, TAG_OR_EMPTY, "")
    return {
        "n_tags": F.regexp_count(md, F.lit(TAG)),
        "n_table": F.regexp_count(md, F.lit(TABLE_TAG)),
        "n_script": F.regexp_count(md, F.lit(SCRIPT)),
        "n_style": F.regexp_count(md, F.lit(STYLE)),
        "n_newlines": F.regexp_count(md, F.lit(NEWLINES)),
        "n_chars": F.length(md),
        "html_chars": F.length(md) - F.length(text),
        "content": F.length(trimmed(F.regexp_replace(text, MARKS, ""))),
    }


def percent(part: Column, whole: Column) -> Column:
    """part of whole in tenths of a percent, halves up, in whole numbers; null where whole is 0."""
    return F.floor((part * 2000 + whole) / F.nullif(2 * whole, F.lit(0))).cast("long")


def tenths(p: Column) -> Column:
    """12.3 of 123."""
    return F.concat(F.floor(p / 10).cast("long").cast("string"), F.lit("."), (p % 10).cast("string"))


def score(df: DataFrame, markdown: str = "markdown", out: str = "quality") -> DataFrame:
    """df with column `out`: struct of is_valid, score, issues, warnings, raw.

    Measures become columns of their own first, so that each pattern runs once. A null text scores like an empty one.
    """
    names = [f"__{n}" for n in measures(F.lit(""))]
    found = measures(F.coalesce(F.col(markdown), F.lit("")))
    df = df.withColumns({f"__{n}": c.cast("long") for n, c in found.items()})
    q = {n: F.col(f"__{n}") for n in found}
    share = F.coalesce(F.try_divide(q["html_chars"], q["n_chars"]), F.lit(0.0))
    p = tenths(F.coalesce(percent(q["html_chars"], q["n_chars"]), F.lit(0)))
    text = lambda c: c.cast("string")
    thin = (q["content"] < 200) & ((q["n_tags"] > 50) | (q["n_table"] > 20))
    before = (
        F.lit(100)
        - F.when(q["n_tags"] > 100, 40).when(q["n_tags"] > 50, 20).when(q["n_tags"] > 10, 5).otherwise(0)
        - F.when(q["n_table"] > 50, 30).otherwise(0)
        - F.when(share > 0.3, 25).when(share > 0.15, 10).otherwise(0)
        - F.when(q["n_script"] > 0, 15).otherwise(0)
        - F.when(q["n_style"] > 0, 10).otherwise(0)
    )
    length = F.when(q["content"] == 0, 0).when(q["content"] < 50, before - 50).when(thin, before - 30).when(q["content"] < 300, before - 15).otherwise(before)
    raw = length - F.when(q["n_newlines"] > 10, 5).otherwise(0)
    say = lambda *parts: F.concat(*(x if isinstance(x, Column) else F.lit(x) for x in parts))
    issues = F.array(
        F.when(q["n_tags"] > 100, say(text(q["n_tags"]), " leftover HTML tags found (likely forum/discussion thread)")),
        F.when(q["n_table"] > 50, say(text(q["n_table"]), " unconverted table tags (complex layout not suitable)")),
        F.when(share > 0.3, say(p, "% of content is HTML tags")),
        F.when(q["content"] == 0, F.lit("Blank content - no text extracted"))
        .when(q["content"] < 50, say("Extremely short content (", text(q["content"]), " chars) - likely extraction failure"))
        .when(thin, say("Only ", text(q["content"]), " chars of actual content with excessive HTML (extraction likely failed)")),
    )
    warnings = F.array(
        F.when((q["n_tags"] > 50) & (q["n_tags"] <= 100), say(text(q["n_tags"]), " HTML tags present")).when(
            (q["n_tags"] > 10) & (q["n_tags"] <= 50), say(text(q["n_tags"]), " minor HTML tags present")
        ),
        F.when((share > 0.15) & (share <= 0.3), say(p, "% HTML tag ratio")),
        F.when(q["n_script"] > 0, say(text(q["n_script"]), " script tags present")),
        F.when(q["n_style"] > 0, say(text(q["n_style"]), " style tags present")),
        F.when((q["content"] >= 50) & ~thin & (q["content"] < 300), say("Short content (", text(q["content"]), " chars) - may not be a full article")),
        F.when(q["n_newlines"] > 10, say(text(q["n_newlines"]), " sections with excessive newlines")),
    )
    result = F.struct(
        (raw >= VALID).alias("is_valid"), F.greatest(F.lit(0), raw).cast("int").alias("score"), F.array_compact(issues).alias("issues"),
        F.array_compact(warnings).alias("warnings"), raw.cast("int").alias("raw"),
    )
    return df.withColumn(out, result).drop(*names)


def report(score_: Column, issues: Column, warnings: Column) -> Column:
    """A text that names the score's grade and lists issues and warnings."""
    grade = F.when(score_ >= 90, "✅ Excellent").when(score_ >= 75, "✅ Good").when(score_ >= 60, "⚠️ Acceptable").otherwise("❌ Poor")
    listed = lambda items: F.array_join(F.transform(items, lambda x: F.concat(F.lit("- "), x, F.lit("\n"))), "")
    part = lambda title, items: F.when(F.size(items) > 0, F.concat(F.lit(title), listed(items))).otherwise(F.lit(""))
    return F.concat(
        F.lit("**Quality Score**: "), score_.cast("string"), F.lit("/100 "), grade, part("\n\n**Issues**:\n", issues), part("\n**Warnings**:\n", warnings)
    )
