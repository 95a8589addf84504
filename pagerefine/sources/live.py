"""Pages fetched over HTTP, or rendered, as Spark data sources, for clusters that have a network.

    spark.dataSource.register(LivePages)
    spark.read.format("live_pages").option("urls", json.dumps(urls)).load()

    spark.dataSource.register(RenderedPages)
    spark.read.format("rendered_pages").option("urls", json.dumps(urls)).option("renderer", "my_browser:html_of").load()
"""

from __future__ import annotations

import importlib
import json
import urllib.error
import urllib.request
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

# What a desktop browser sends.
HEADERS = {
    "User-Agent": "Mozilla/5.0 (X11; Linux x86_64) AppleWebKit/537.36 (KHTML, like Gecko) Chrome/120.0.0.0 Safari/537.36",
    "Accept": "text/html,application/xhtml+xml,application/xml;q=0.9,*/*;q=0.8",
    "Accept-Language": "en-US,en;q=0.5",
}


def get(url: str, timeout: float | None = None) -> tuple[str, str, int | None, str | None, str | None]:
    """url, html, status, status text and error of one page; redirects are followed, nothing raises."""
    try:
        with urllib.request.urlopen(urllib.request.Request(url, headers=HEADERS), timeout=timeout) as r:
            return url, r.read().decode(r.headers.get_content_charset() or "utf-8", "replace"), r.status, r.reason, None
    except urllib.error.HTTPError as e:
        return url, "", e.code, e.reason, f"HTTP {e.code}: {e.reason}"
    except Exception as e:  # noqa: BLE001  any failure is the row's error
        return url, "", None, None, str(e) or type(e).__name__


class _Urls(InputPartition):
    def __init__(self, urls: list[str]):
        self.urls = urls


class _Reader(DataSourceReader):
    """At most `concurrency` partitions, hence as many requests at a time (5 by default)."""

    def __init__(self, options):
        self.urls = json.loads(options.get("urls", "[]"))
        self.parts = max(1, int(options.get("concurrency", "5")))
        self.timeout = float(options["timeout"]) if "timeout" in options else None

    def partitions(self):
        return [_Urls(self.urls[i :: self.parts]) for i in range(min(self.parts, max(1, len(self.urls))))]

    def read(self, partition: _Urls) -> Iterator[tuple]:
        for url in partition.urls:
            yield get(url, self.timeout)


class LivePages(DataSource):
    @classmethod
    def name(cls) -> str:
        return "live_pages"

    def schema(self) -> str:
        return "url string, html string, http_status int, status_text string, error string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


class _Rendering(_Reader):
    """A renderer that can't be loaded fails the read; one that raises for a page gives that page's error."""

    def __init__(self, options):
        super().__init__({k: v for k, v in options.items() if k != "timeout"})
        self.module, _, self.function = options["renderer"].partition(":")
        self.wait, self.milliseconds = options.get("wait_strategy", "networkidle"), int(options.get("timeout", "30000"))

    def read(self, partition: _Urls) -> Iterator[tuple]:
        render = getattr(importlib.import_module(self.module), self.function)
        for url in partition.urls:
            try:
                yield url, render(url, self.wait, self.milliseconds), None
            except Exception as e:  # noqa: BLE001  any failure is the row's error
                yield url, "", str(e) or type(e).__name__


class RenderedPages(DataSource):
    """Pages as a function `module:function(url, wait_strategy, timeout)`, at hand on the executors, renders them."""

    @classmethod
    def name(cls) -> str:
        return "rendered_pages"

    def schema(self) -> str:
        return "url string, html string, error string"

    def reader(self, schema) -> DataSourceReader:
        return _Rendering(self.options)
