"""Choice between a page as fetched plainly and as rendered, by errors and quality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagerefine.functions.quality import score
from pagerefine.operators.extract import with_extraction

SUGGESTION = "This page may be a login wall, forum, or complex web app not suitable for article extraction"


def reason(fetch_error: Column, extract_error: Column, score_: Column, min_score: Column | int, retry: Column | int, forced: Column | bool = False) -> Column:
    """Why the rendered page is asked for; null where the plain one is accepted."""
    forced = forced if isinstance(forced, Column) else F.lit(forced)
    return (
        F.when(forced, "forced").when(fetch_error.isNotNull(), "network_error").when(extract_error.isNotNull(), "extraction_failed")
        .when(score_ >= retry, F.lit(None).cast("string")).when(score_ >= min_score, "quality_marginal").otherwise("quality_too_low")
    )


def rendered_outcome(fetch_error: Column, extract_error: Column, score_: Column, min_score: Column | int) -> dict[str, Column]:
    """success, error, suggestion and used_rendered of the rendered page on its own."""
    low = score_ < min_score
    broken = fetch_error.isNotNull() | extract_error.isNotNull()
    return {
        "success": ~broken & ~F.coalesce(low, F.lit(True)),
        "error": F.when(fetch_error.isNotNull(), F.concat(F.lit("Playwright fetch failed: "), fetch_error))
        .when(extract_error.isNotNull(), extract_error)
        .when(low, F.concat(F.lit("Content quality too low ("), score_.cast("string"), F.lit("/100) even with JavaScript rendering"))),
        "suggestion": F.when(~broken & low, F.lit(SUGGESTION)),
        "used_rendered": F.when(~broken, F.lit(True)),
    }


def pick(why: Column, score_: Column, rendered_success: Column, rendered_score: Column) -> Column:
    """`simple` or `rendered`: a marginal page is replaced only by a strictly better rendered one."""
    better = rendered_success & (rendered_score > score_)
    return F.when(why.isNull() | ((why == "quality_marginal") & ~F.coalesce(better, F.lit(False))), "simple").otherwise("rendered")


def http_error(status: Column, text: Column) -> Column:
    return F.when(~status.between(200, 299), F.concat(F.lit("HTTP "), status.cast("string"), F.lit(": "), text))


def fetch(pages: DataFrame, rendered: DataFrame, min_score: int = 60, retry: int = 85, force: bool = False) -> DataFrame:
    """Fetch results of pages(url, html, error), with rendered(url, html, error) at hand: one row per page.

    url, success, markdown, title, byline, excerpt, site_name, score, issues, warnings, error, suggestion,
    used_rendered, rendered_reason. Each page is extracted once, and its rendered one only where the plain one isn't
    accepted; one join by url. A page without a rendered row fails there; of several, those without
    an error come first, then the first by html counts.
    """
    columns = ("markdown", "title", "byline", "excerpt", "site_name")
    plain = pages.select("url", F.when(F.col("error").isNull(), F.col("html")).alias("html"), F.col("error").alias("fetch_error"))
    simple = score(with_extraction(plain), "markdown", "quality")
    simple = simple.withColumn("why", reason(F.col("fetch_error"), F.col("error"), F.col("quality.score"), min_score, retry, force))
    page = F.struct(F.col("error").isNotNull().alias("failed"), "html", "error")
    shown = rendered.groupBy("url").agg(F.min(page).alias("p")).select("url", F.col("p.html").alias("r_html"), F.col("p.error").alias("r_fetch_error"), F.lit(True).alias("r_there"))
    both = simple.join(shown, "url", "left").withColumn("r_html", F.when(F.col("why").isNotNull() & F.col("r_fetch_error").isNull(), F.col("r_html")))
    both = score(with_extraction(both, "url", "r_html", "r_"), "r_markdown", "r_quality")
    r_fetch = F.coalesce("r_fetch_error", F.when(F.col("r_there").isNull(), F.lit("no rendered page")))
    outcome = rendered_outcome(r_fetch, F.col("r_error"), F.col("r_quality.score"), min_score)
    both = both.withColumns({f"o_{k}": v for k, v in outcome.items()})
    both = both.withColumn("picked", pick(F.col("why"), F.col("quality.score"), F.col("o_success"), F.col("r_quality.score")))
    rendered_ = F.col("picked") == "rendered"
    shows = F.when(rendered_, F.col("o_success")).otherwise(F.lit(True))
    quality = F.when(rendered_, F.when(F.col("o_used_rendered"), F.col("r_quality"))).otherwise(F.col("quality"))
    return both.withColumn("q", quality).select(
        "url", shows.alias("success"), *(F.when(shows, F.when(rendered_, F.col(f"r_{c}")).otherwise(F.col(c))).alias(c) for c in columns),
        F.col("q.score").alias("score"), F.col("q.issues").alias("issues"), F.col("q.warnings").alias("warnings"),
        F.when(rendered_, F.col("o_error")).alias("error"), F.when(rendered_, F.col("o_suggestion")).alias("suggestion"),
        F.when(rendered_, F.col("o_used_rendered")).alias("used_rendered"), F.when(rendered_ & F.col("o_used_rendered"), F.col("why")).alias("rendered_reason"),
    )
