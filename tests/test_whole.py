"""Queries over whole texts and pages: what stands anywhere in them reaches the operator."""

import pytest
from pagerefine.plans import catalog

WORDS = [f"word{i:04d}" for i in range(900)]


@pytest.fixture(scope="module")
def long_text(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("whole"))
    spark.createDataFrame([(1, " ".join(WORDS)), (2, "short"), (3, "\n".join(WORDS))], "doc_id long, text string").write.parquet(f"{at}/documents.parquet")
    return at


@pytest.mark.parametrize("name", sorted(n for n in catalog.QUERIES if n.startswith("clean_")))
def test_clean_up_of_whole_texts(name, spark, long_text):
    factor = 3 if name == "clean_blank_guard" else 1
    found = {r.doc_id: r.y for r in catalog.QUERIES[name](spark, long_text).collect()}
    for doc in (1, 3):
        assert not [w for w in WORDS if w not in found[doc * factor]]


@pytest.mark.parametrize("page", range(5))
def test_scores_of_whole_pages(spark, tmp_path, page):
    html = "<p>text</p>" * 400 + "<script></script>"
    spark.createDataFrame([(page, "u", html)], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    one = lambda name: catalog.QUERIES[name](spark, str(tmp_path)).where(f"id = {2 * page}").collect()[0]
    assert one("q_tag_count").n_tags == 802 and one("q_script").n_script == 1 and one("q_content_len").content == 1600
    assert "802 leftover HTML tags" in one("q_messages").issues and "802 leftover HTML tags" in one("q_report").report


def test_links_late_in_a_text(spark, tmp_path):
    text = "x" * 5000 + "[late](https://late.example/a)"
    spark.createDataFrame([(1, text)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    rows = lambda name: catalog.QUERIES[name](spark, str(tmp_path)).collect()
    for name in ("links_all", "links_http", "links_dedup"):
        assert ("late", "https://late.example/a") in {(r.text, r.href) for r in rows(name)}
    assert any("https://late.example/a" in r.line for r in rows("render_links"))
    assert {r.source_ref: r["count"] for r in rows("links_count")}["doc-1"] == len(rows("links_dedup"))
