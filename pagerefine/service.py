"""The reference store of one folder as a service: fetch, list, promote, delete, links, one-hop crawl.

Every operation is the DataFrame operator of the same name over the folder's files; only the changed files are
written by the driver, as a personal store has few.
"""

from __future__ import annotations

import json
import logging
import os
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagerefine.config import Config
from pagerefine.functions.text import utc_day
from pagerefine.operators import crawl, render, route, store
from pagerefine.sources.tables import RAW_PAGES, stored_files

log = logging.getLogger("pagerefine")
RENDERED = "url string, html string, error string"


class Service:
    """get: urls to a DataFrame of url, html, http_status, status_text, error; render: urls to one of url, html, error.

    Without `render` the settings' renderer is used; without that no page counts as rendered, so a page that isn't
    accepted as fetched plainly fails.
    """

    def __init__(self, spark: SparkSession, config: Config, get: Callable[[list[str]], DataFrame], render: Callable[[list[str]], DataFrame] | None = None):
        self.spark, self.config, self.get = spark, config, get
        self.render = render or (rendered(spark, config) if config.rendering.renderer else lambda urls: spark.createDataFrame([], RENDERED))

    # --- state ---
    def state(self) -> DataFrame:
        folder = self.config.paths.temp_dir
        files = stored_files(self.spark, str(Path(folder).resolve())) if Path(folder).is_dir() else store.empty(self.spark)
        name = F.element_at(F.split("filepath", "/"), -1)
        return files.withColumn("filepath", F.concat_ws("/", F.lit(folder), F.url_decode(name)))

    @staticmethod
    def _write(path: str, text: str) -> None:
        Path(path).parent.mkdir(parents=True, exist_ok=True)
        Path(path).write_text(text, encoding="utf-8", newline="")

    def _fetched(self, urls: list[str], force: bool = False) -> DataFrame:
        q = self.config.quality
        log.debug("fetching %d pages, accepted from %d on, rendered below %d%s", len(urls), q.min_score, q.js_retry_threshold, ", all rendered" if force else "")
        return route.fetch(self.get(urls), self.render(urls), q.min_score, q.js_retry_threshold, force)

    # --- operations ---
    def fetch_url(self, url: str, query: str | None = None, refetch: bool = False, force: bool = False) -> dict:
        """Fetch, score and save one page. The text form of the result is under `text`."""
        found = self._fetched([url], force).withColumn("size", F.length("markdown")).first().asDict(recursive=True)
        if not found["success"]:
            quality = None if found["score"] is None else {"isValid": False, "score": found["score"], "issues": found["issues"], "warnings": found["warnings"]}
            log.debug("not kept: %s", found["error"])
            return {k: v for k, v in {**{c: found[c] for c in ("success", "error", "suggestion")}, "quality": quality}.items() if v is not None}
        row = [(0, found["title"], url, found["markdown"], query, refetch)]
        batch = self.spark.createDataFrame(row, "seq long, title string, url string, content string, query string, refetch boolean")
        results, after = store.save(self.state(), batch, utc_day(), self.config.paths.temp_dir)
        saved = results.first()
        if saved.error:
            return {"success": False, "error": saved.error, "text": f"Error: Save failed: {saved.error}"}
        out = {"success": True, "refId": saved.ref_id, "filepath": saved.filepath}
        if saved.already_exists:
            ref, path = F.lit(saved.ref_id), F.lit(saved.filepath)
            texts = self.spark.range(1).select(render.already_text(ref, path), render.already_text(ref, path, pretty=True), render.tool_already_text(ref, path)).first()
            out = {"success": True, "alreadyExists": True, "refId": saved.ref_id, "filepath": saved.filepath, "message": render.ALREADY_MESSAGE}
            return out | dict(zip(("text", "pretty", "tool"), texts, strict=True))
        self._write(saved.filepath, after.where(F.col("filepath") == saved.filepath).first().value)
        r = {**found, "ref_id": saved.ref_id, "filepath": saved.filepath}
        shown = self.spark.createDataFrame(
            [tuple(r[k] for k in ("ref_id", "title", "byline", "site_name", "excerpt", "filepath", "markdown", "score", "used_rendered", "rendered_reason"))],
            "ref_id string, title string, byline string, site_name string, excerpt string, filepath string, markdown string, score int, used_rendered boolean, rendered_reason string",
        )
        columns = {c: F.col(c) for c in shown.columns}
        plain, pretty, tool = shown.select(render.saved_text(columns), render.saved_text(columns, pretty=True), render.tool_text(columns)).first()
        extra = {
            "title": r["title"], "byline": r["byline"], "siteName": r["site_name"], "excerpt": r["excerpt"], "url": url, "size": found["size"],
            "tokens": (found["size"] + 2) // 4, "quality": r["score"], "usedPlaywright": r["used_rendered"], "playwrightReason": r["rendered_reason"], "query": query,
        }
        return out | {k: v for k, v in extra.items() if v is not None} | {"text": plain, "pretty": pretty, "tool": tool}

    def list_cached(self) -> list[dict]:
        names = {"ref_id": "refId", "fetched_date": "fetchedDate"}
        return [{names.get(k, k): v for k, v in r.asDict().items() if v is not None} for r in store.list_references(self.state()).collect()]

    def _ids(self, ref_id: str) -> DataFrame:
        return self.spark.createDataFrame([(ref_id,)], "ref_id string")

    def promote_reference(self, ref_id: str) -> dict:
        paths = self.config.paths
        results, after = store.promote(self.state(), self._ids(ref_id), paths.temp_dir, paths.docs_dir)
        r = results.first()
        if r.success:
            self._write(r.to_path, after.where(F.col("filepath") == r.to_path).first().value)
            os.unlink(r.from_path)
        return {k: v for k, v in {"success": r.success, "fromPath": r.from_path, "toPath": r.to_path, "error": r.error}.items() if v is not None}

    def delete_cached(self, ref_id: str) -> dict:
        r = store.delete(self.state(), self._ids(ref_id), self.config.paths.temp_dir)[0].first()
        if r.success:
            os.unlink(r.filepath)
        return {k: v for k, v in {"success": r.success, "filepath": r.filepath, "error": r.error}.items() if v is not None}

    def extract_links(self, ref_id: str) -> dict:
        head, rows = store.reference_links(self.state(), self._ids(ref_id), self.config.paths.temp_dir)
        h = head.first()
        if h.error:
            return {"success": False, "error": h.error, "count": 0, "links": []}
        links = [{"text": r.text, "href": r.href} for r in rows.orderBy("pos").collect()]
        return {"success": True, "sourceRef": ref_id, "count": h["count"], "links": links}

    def fetch_links(self, ref_id: str, refetch: bool = False) -> dict:
        found = self.extract_links(ref_id)
        if not found["success"]:
            return found
        urls = [x["href"] for x in found["links"]]
        if not urls:
            return {"success": True, "message": "No links to fetch", "sourceRef": ref_id, "results": []}
        links = self.spark.createDataFrame(list(enumerate(urls)), "pos long, href string")
        state = self.state()
        fetched = self._fetched(urls).select("url", "success", "title", "markdown", "error").cache()  # each page is asked for once
        results, after = crawl.fetch_links(state, links, fetched, utc_day(), refetch, self.config.paths.temp_dir)
        rows = results.orderBy("pos").collect()
        for r in after.join(state.select("filepath", F.col("value").alias("old")), "filepath", "left").where("old is null or old <> value").collect():
            self._write(r.filepath, r.value)
        fetched.unpersist()
        counts = {s: sum(r.status == s for r in rows) for s in ("new", "cached", "failed")}
        items = [{k: v for k, v in {"url": r.url, "status": r.status, "refId": r.ref_id, "error": r.error}.items() if v is not None} for r in rows]
        return {"success": True, "sourceRef": ref_id, "summary": counts, "results": items}


def live(spark: SparkSession) -> Callable[[list[str]], DataFrame]:
    """Fetch over HTTP through the live data source."""
    from pagerefine.sources.live import LivePages

    spark.dataSource.register(LivePages)
    return lambda urls: spark.read.format("live_pages").option("urls", json.dumps(urls)).load()


def rendered(spark: SparkSession, config: Config) -> Callable[[list[str]], DataFrame]:
    """Render through the settings' renderer, with their wait strategy and timeout."""
    from pagerefine.sources.live import RenderedPages

    r = config.rendering
    spark.dataSource.register(RenderedPages)
    options = {"renderer": r.renderer, "wait_strategy": r.wait_strategy, "timeout": str(int(r.timeout))}
    return lambda urls: spark.read.format("rendered_pages").options(urls=json.dumps(urls), **options).load()


def from_table(spark: SparkSession, pages: DataFrame) -> Callable[[list[str]], DataFrame]:
    """Fetch from a table of pages at hand; a url it lacks is a 404."""
    from pagerefine.sources.tables import with_http_errors

    def get(urls: list[str]) -> DataFrame:
        asked = spark.createDataFrame([(u,) for u in urls], "url string")
        found = asked.join(pages.select("url", "html").dropDuplicates(["url"]), "url", "left")
        status = F.when(F.col("html").isNull(), 404).otherwise(200)
        raw = found.select("url", "html", status.alias("http_status"), F.when(F.col("html").isNull(), "Not Found").otherwise("OK").alias("status_text"), F.lit(None).cast("string").alias("error"))
        return with_http_errors(raw)

    return get


__all__ = ["RAW_PAGES", "Service", "from_table", "live", "rendered"]
