"""One hop from a reference: its links, fetched and saved."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagerefine.operators.store import save


def status(fetched: Column, save_error: Column, already: Column) -> Column:
    """failed if the fetch or the save failed, whether or not the url is cached; then cached, or new."""
    return F.when(~F.coalesce(fetched, F.lit(False)) | save_error.isNotNull(), "failed").when(already, "cached").otherwise("new")


def fetch_links(state: DataFrame, links: DataFrame, fetched: DataFrame, day: Column, refetch: bool = False, temp_dir: str = ".tmp") -> tuple[DataFrame, DataFrame]:
    """Results pos, url, status, ref_id, error for links(pos, href), and the new state.

    fetched: url, success, title, markdown, error of pages at hand; a link without one failed. Of pages of one url, those that succeeded come first, then
    the first by title and text counts. One join for all links. fetched is read
    several times, so pages that are costly to get are best stored before.
    """
    page = F.struct((~F.coalesce("success", F.lit(False))).alias("failed"), "title", "markdown", F.col("error").alias("fetch_error"), "success")
    pages = fetched.groupBy(F.col("url").alias("href")).agg(F.min(page).alias("p")).select("href", "p.success", "p.title", "p.markdown", "p.fetch_error")
    rows = links.select("pos", "href").join(pages, "href", "left")
    ok = F.coalesce("success", F.lit(False))
    batch = rows.where(ok).select(
        F.col("pos").alias("seq"), "title", F.col("href").alias("url"), F.col("markdown").alias("content"), F.lit(None).cast("string").alias("query"), F.lit(refetch).alias("refetch")
    )
    saved, after = save(state, batch, day, temp_dir)
    saved = saved.select(F.col("seq").alias("pos"), "ref_id", "already_exists", F.col("error").alias("save_error"))
    out = rows.join(saved, "pos", "left").withColumn("status", status(ok, F.col("save_error"), F.col("already_exists")))
    error = F.when(~ok, F.coalesce("fetch_error", F.lit("page not found"))).otherwise(F.col("save_error"))
    results = out.select("pos", F.col("href").alias("url"), "status", F.when(F.col("status") != "failed", F.col("ref_id")).alias("ref_id"), error.alias("error"))
    return results, after


def summary(results: DataFrame) -> DataFrame:
    """One row: new, cached, failed."""
    return results.agg(*(F.count_if(F.col("status") == s).alias(s) for s in ("new", "cached", "failed")))
