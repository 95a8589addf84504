"""Extraction, routing, store, crawl, service, command line, tools, settings and stream."""

import html
import json
import re

import pytest
from pagerefine import cli, server
from pagerefine.config import Config, ConfigError, find_file, from_env, from_file, load, merge, parse
from pagerefine.functions.article import NO_ARTICLE, extract
from pagerefine.operators import route, store
from pagerefine.operators.extract import extract_pages
from pagerefine.service import Service, from_table
from pagerefine.sources.tables import stored_files
from pagerefine.streaming import inbox
from pyspark.sql import functions as F

from tests.conftest import DATA

PAGE = "<html><head><title>{t}</title><meta property='og:site_name' content='Site'><meta name='author' content='Ann'></head><body><nav><a href='/n'>nav</a></nav><article><h1>{t}</h1><p>{p}</p><h2>Section Header</h2><ul><li>One</li><li>Two</li></ul><ol><li>First</ol><pre><code class='language-js'>let  x = 1;</code></pre><p>See <a href='{l}'>more</a> &amp; “quotes” ünï.</p><table><tr><th>A</th></tr><tr><td>1</td></tr></table><p><del>old</del></p></article></body></html>"


def page(title="Test Article", text="A fairly long paragraph of text for the article. " * 12, link="https://e.com/other"):
    return PAGE.format(t=title, p=text, l=link)


def test_extraction_contract():
    r = extract(page(), "https://e.com/a")
    assert r["error"] is None and r["title"] == "Test Article" and r["byline"] == "Ann" and r["site_name"] == "Site"
    for part in ("## Section Header", "- One", "1. First", "```js\nlet  x = 1;\n```", "[more](https://e.com/other)", "| A |", "~~old~~", "& “quotes” ünï"):
        assert part in r["body"]
    assert "nav" not in r["body"]


def test_empty_fields_stay_empty():
    long = "<article><p>Words enough for an article to be found here.</p></article>"
    assert extract(f"<meta name=author content=''>{long}", "u")["byline"] == "" and extract(long, "u")["byline"] is None
    assert extract(long, "u")["title"] == "" and extract(long, "u")["site_name"] is None


@pytest.mark.parametrize("html", ["", None, "<html><body></body></html>", "<body><form><input name=u><button>Log in</button></form></body>"])
def test_no_article(html):
    assert extract(html, "u")["error"] == NO_ARTICLE


def test_hostile_html():
    assert extract("<div>" * 5000 + "deep text that is long enough to count", "u")["error"] is None
    assert extract("<p>unclosed <b>bold text that goes on and on for a while", "u")["body"].startswith("unclosed **bold")


def test_markdown_has_header(spark):
    rows = spark.createDataFrame([("https://e.com/a", page()), ("https://e.com/b", None)], "url string, html string")
    found = {r.url: r for r in extract_pages(rows).collect()}
    a = found["https://e.com/a"].markdown
    assert a.startswith("# Test Article\n\n**By:** Ann\n\n**Source:** Site\n\n") and "**URL:** https://e.com/a\n\n---\n\n" in a
    assert found["https://e.com/b"].markdown is None and found["https://e.com/b"].error == NO_ARTICLE


def test_routes(spark):
    why = lambda s, f=None, e=None, force=False: spark.range(1).select(route.reason(F.lit(f), F.lit(e), F.lit(s), 60, 85, force)).first()[0]
    assert [why(s) for s in (90, 85, 70, 60, 59)] == [None, None, "quality_marginal", "quality_marginal", "quality_too_low"]
    assert (why(90, force=True), why(90, "x"), why(90, None, "x")) == ("forced", "network_error", "extraction_failed")
    chosen = lambda s, ok, r: spark.range(1).select(route.pick(F.lit("quality_marginal"), F.lit(s), F.lit(ok), F.lit(r))).first()[0]
    assert [chosen(70, True, 85), chosen(75, True, 70), chosen(75, True, 75), chosen(70, False, 99)] == ["rendered", "simple", "simple", "simple"]


def test_fetch_prefers_rendered(spark):
    thin = "<article><p>Short but there, with words.</p></article>"
    pages = spark.createDataFrame([("a", page(), None), ("b", thin, None), ("c", "", "HTTP 404: Not Found"), ("d", thin, None)], "url string, html string, error string")
    rendered = spark.createDataFrame([("b", page(), None), ("c", page(), None)], "url string, html string, error string")
    found = {r.url: r for r in route.fetch(pages, rendered, min_score=90, retry=95).collect()}
    assert found["a"].success and found["a"].used_rendered is None
    assert found["b"].success and found["b"].used_rendered and found["b"].rendered_reason == "quality_too_low"
    assert found["c"].success and found["c"].rendered_reason == "network_error"
    assert not found["d"].success and "no rendered page" in found["d"].error and found["d"].used_rendered is None


BATCH = "seq long, title string, url string, content string, query string, refetch boolean"


def test_store(spark):
    batch = spark.createDataFrame([(1, "One", "u1", "b1", None, False), (2, "Two", "u2", "b2", 'q"', False), (3, "Other", "u1", "b3", None, False), (4, "One!", "u4", "b4", None, False), (5, None, "u5", "b", None, False)], BATCH)
    results, state = store.save(store.empty(spark), batch, F.lit("2024-01-01"))
    got = {r.seq: r for r in results.collect()}
    assert (got[1].ref_id, got[1].already_exists, got[3].already_exists, got[3].filepath, got[5].error) == ("one", False, True, ".tmp/one.md", "title is missing")
    state = state.cache()
    assert {r.filepath: r.value.split("\n\n")[-1] for r in state.collect()} == {".tmp/one.md": "b4", ".tmp/two.md": "b2"}  # the last writer of a path stays
    again = spark.createDataFrame([(1, "New Title", "u2", "new", None, True)], BATCH)
    results, after = store.save(state, again, F.lit("2024-02-01"))
    assert results.first().filepath == ".tmp/two.md" and results.first().ref_id == "new-title"
    listed = [r.ref_id for r in store.list_references(after).collect()]
    assert listed == ["two", "one"]
    one = spark.createDataFrame([("one",), ("none",)], "ref_id string")
    results, moved = store.promote(after, one)
    assert {r.ref_id: (r.success, r.error) for r in results.collect()} == {"one": (True, None), "none": (False, "Reference none not found in .tmp")}
    assert [r.ref_id for r in store.list_references(moved).collect()] == ["two"]
    assert moved.where("status = 'permanent'").first().value.count("status: permanent") == 1
    assert store.delete(after, one)[1].count() == 1


def test_state_versions(spark, tmp_path):
    state = spark.createDataFrame([("temporary", "a.md", "x"), ("permanent", "b.md", "y")], store.STATE)
    path = store.write_state(state, f"file://{tmp_path}")
    assert sorted(r.filepath for r in store.read_state(spark, path).collect()) == ["a.md", "b.md"]
    assert store.read_state(spark, f"file://{tmp_path}/none").count() == 0
    assert stored_files(spark, f"{tmp_path}/none").count() == 0


@pytest.fixture
def service(spark, tmp_path, monkeypatch):
    monkeypatch.chdir(tmp_path)
    pages = spark.createDataFrame(
        [("https://e.com/a", page()), ("https://e.com/other", page("Other Page", link="https://e.com/a")), ("https://e.com/login", "<form></form>")], "url string, html string"
    )
    return lambda config: Service(spark, config, from_table(spark, pages))


def test_service_flow(service, capsys, caplog):
    s = service(Config())
    first = s.fetch_url("https://e.com/a", query="why")
    assert first["success"] and first["refId"] == "test-article" and first["quality"] == 100 and "Cached: test-article" in first["text"]
    again = s.fetch_url("https://e.com/a")
    assert again["alreadyExists"] and again["message"] == "URL already fetched. Use --refetch to update."
    assert again["pretty"] == f"📦 Already cached: test-article\n   File: {again['filepath']}\n\n💡 Use --refetch to update"
    assert not s.fetch_url("https://e.com/login")["success"]
    assert s.extract_links("test-article")["links"] == [{"text": "more", "href": "https://e.com/other"}]
    assert s.fetch_links("test-article")["summary"] == {"new": 1, "cached": 0, "failed": 0}
    assert [r["refId"] for r in s.list_cached()] == ["other-page", "test-article"]
    assert cli.run(["list"], service) == 0 and "Cached references (2)" in capsys.readouterr().out
    assert cli.run(["list", "--pretty"], service) == 0 and capsys.readouterr().out.startswith("📚 Cached references (2):\n\nother-page | ")
    assert cli.run(["links", "none"], service) == 1
    capsys.readouterr()
    assert cli.run(["links", "none", "-o", "json"], service) == 1 and set(json.loads(capsys.readouterr().out)) == {"success", "error"}
    assert cli.run(["links", "test-article", "--pretty"], service) == 0 and capsys.readouterr().out.startswith("🔗 Found 1 links in test-article:\n\n  more\n    → ")
    assert cli.run(["fetch-links", "test-article", "-v"], service) == 0
    assert capsys.readouterr().out == "Fetching 1 links from test-article...\n\ncached: other-page\n\nSummary: 0 new, 1 cached, 0 failed\n"
    assert "fetching 1 pages" in caplog.text
    assert cli.run(["fetch", "https://e.com/other", "-o", "path"], service) == 0 and capsys.readouterr().out.strip() == ".tmp/other-page.md"
    assert cli.run(["promote", "none", "--pretty"], service) == 1 and "not found in .tmp" in capsys.readouterr().err
    promoted = s.promote_reference("test-article")
    assert promoted["toPath"] == "docs/ai/references/test-article.md" and "status: permanent" in open(promoted["toPath"]).read()
    assert s.delete_cached("other-page")["success"] and s.list_cached() == []
    assert s.delete_cached("other-page")["error"] == "Reference other-page not found in .tmp"


def test_tools(service):
    ask = lambda name, **args: server.answer({"id": 1, "method": "tools/call", "params": {"name": name, "arguments": args}}, service)
    assert ask("list_cached")["result"]["content"][0]["text"] == "No cached references in .tmp/"
    assert json.loads(ask("fetch_url", url="https://e.com/a", outputFormat="json")["result"]["content"][0]["text"])["refId"] == "test-article"
    assert "more | https://e.com/other" in ask("extract_links", refId="test-article")["result"]["content"][0]["text"]
    assert ask("fetch_url", url="https://e.com/a")["result"]["content"][0]["text"].endswith("\n\nUse refetch: true to update.")
    assert ask("fetch_links", refId="test-article")["result"]["content"][0]["text"] == "Fetched links from test-article:\n\nnew: other-page\n\nSummary: 1 new, 0 cached, 0 failed"
    assert ask("nothing")["error"]["message"] == "Unknown tool: nothing"
    assert len(server.answer({"id": 2, "method": "tools/list"}, service)["result"]["tools"]) == 6
    assert server.answer({"method": "notifications/initialized"}, service) is None


def test_arguments():
    o = cli.parse_args(["fetch", "u", "-q", "x", "-o", "odd", "--min-quality", "70", "--unknown", "--pretty"])
    assert (o.argument, o.values, o.flags) == ("u", {"query": "x", "min_quality": 70}, {"pretty"})
    assert [cli.parse_args(a).command for a in ([], ["odd"], ["list", "-h"])] == ["help"] * 3


def test_settings(tmp_path):
    assert load(tmp_path, {}) == Config()
    (tmp_path / "pagerefine.config.json").write_text('{"quality": {"min_score": 50}}')
    assert find_file(tmp_path).name == "pagerefine.config.json"
    env = {"PAGEREFINE_MIN_SCORE": "55x", "PAGEREFINE_TEMP_DIR": ""}
    assert (load(tmp_path, {}).quality.min_score, load(tmp_path, env).quality.min_score, load(tmp_path, env, min_quality=70).quality.min_score) == (50, 55, 70)
    assert from_env(env) == {"quality": {"min_score": 55}}
    assert from_file(tmp_path / "none.json") == {}
    assert merge({"a": {"b": 1, "c": 2}}, {"a": {"b": None}}) == {"a": {"b": None, "c": 2}}
    for bad in ({"quality": {"min_score": 150}}, {"quality": {"min_score": None}}, {"rendering": {"wait_strategy": "x"}}):
        with pytest.raises(ConfigError):
            parse(bad)


def test_inbox(spark, tmp_path):
    rows = [("u1", page(), "2024-01-01 00:00:00"), ("u1", page(), "2024-01-01 00:00:01"), ("u2", page("B"), "2024-01-01 00:00:02")]
    spark.createDataFrame(rows, "url string, html string, arrived string").withColumn("arrived", F.to_timestamp("arrived")).write.parquet(f"{tmp_path}/in")
    inbox.run_available(inbox.read_inbox(spark, f"{tmp_path}/in"), f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination()
    assert sorted(r.url for r in spark.read.parquet(f"{tmp_path}/out").collect()) == ["u1", "u2"]


def test_extraction_of_the_table(spark):
    """Every page of the table: its article's paragraphs, read with patterns, under the header, cleaned like any text."""
    pages = spark.read.parquet(f"{DATA}/pages.parquet")
    rows = {r.url: r.html for r in pages.select("url", "html").collect()}
    plain = lambda s: " ".join(html.unescape(re.sub(r"<[^>]*>", "", s)).split())
    for url, text in rows.items():
        inner = re.search(r"(?s)<article><h1>(.*?)</h1>(.*?)</article>", text)
        parts = [p for p in map(plain, re.split(r"<br>|</?p>", inner[2])) if p]
        found = extract(text, url)
        if len(" ".join([inner[1], *parts])) < 25:
            assert found["error"] == NO_ARTICLE
            continue
        assert found["title"] == plain(re.search(r"<title>(.*?)</title>", text)[1]) and found["error"] is None
        assert found["body"].replace("*", "") == "\n\n".join(parts).replace("*", "")
        assert found["excerpt"] in (None, "") or plain(inner[2]).startswith(found["excerpt"][:50])
    out = {r.url: r for r in extract_pages(pages).collect()}
    assert set(out) == set(rows)
    for url, r in out.items():
        assert r.error or r.markdown.startswith(f"# {r.title}\n\n") and f"**URL:** {url}\n\n---\n\n" in r.markdown and r.markdown.endswith("\n")


def test_renderer(spark, tmp_path, monkeypatch):
    """A page that has no article as fetched is rendered by the settings' function, which gets its wait strategy and timeout."""
    monkeypatch.chdir(tmp_path)
    (tmp_path / "pagerefine.config.json").write_text('{"playwright": {"waitStrategy": "load", "timeout": 1234}, "quality": {"minScore": 55}}')
    config = load(renderer="tests.test_pages:render_for_test")
    assert (config.rendering.wait_strategy, config.rendering.timeout, config.quality.min_score) == ("load", 1234, 55)
    pages = spark.createDataFrame([("https://e.com/app", "<div></div>"), ("https://e.com/broken", "<div></div>")], "url string, html string")
    s = Service(spark, config, from_table(spark, pages))
    found = s.fetch_url("https://e.com/app")
    assert found["success"] and found["title"] == "load 1234" and found["usedPlaywright"] and found["playwrightReason"] == "extraction_failed"
    failed = s.fetch_url("https://e.com/broken")
    assert not failed["success"] and failed["error"] == "Playwright fetch failed: no such host"
    with pytest.raises(ConfigError):
        load(renderer="a:b:c")


def render_for_test(url, wait, timeout):
    if "broken" in url:
        raise OSError("no such host")
    return page(f"{wait} {timeout}")
