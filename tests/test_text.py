"""Golden vectors of clean-up, scoring, slugs, header blocks and links."""

import pytest
from pagerefine.functions import clean, frontmatter, links, quality
from pagerefine.functions.text import clipped, rounded, slug, tokens, trimmed, utf16_length
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def apply(spark):
    def run(function, *texts):
        rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, x string")
        out = [r.y for r in rows.select("i", function(F.col("x")).alias("y")).orderBy("i").collect()]
        return out[0] if len(out) == 1 else out

    return run


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("Line 1\n\n\n\nLine 2\n\n\n\n\nLine 3", "Line 1\n\nLine 2\n\nLine 3"),
        ("Line 1   \nLine 2\t\t\nLine 3  ", "Line 1\nLine 2\nLine 3"),
        ("Text before<!-- comment -->text after", "Text before text after"),
        ("Line 1\r\nLine 2\r\nLine 3", "Line 1\nLine 2\nLine 3"),
        ("a\n# H\nb", "a\n\n# H\n\nb"),
        ("a\n- b", "a\n\n- b"),
        ("see *this* now", "see*this*now"),
        (" \n\t ", " \n\t "),
    ],
)
def test_structure(apply, text, expected):
    assert apply(clean.clean_structure, text) == expected


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("This is a [link]() to nowhere", "This is a link to nowhere"),
        ("Text with **** empty bold", "Text with empty bold"),
        ("Text​with‌zero‍width﻿chars", "Textwithzerowidthchars"),
        ("“a” ‘b’", "\"a\" 'b'"),
        ("en–dash and em—dash", "en-dash and em-dash"),
        ("Text  with   multiple    spaces", "Text with multiple spaces"),
        ("**a** ***b*** ** **", "a ***b*** "),
    ],
)
def test_content(apply, text, expected):
    assert apply(clean.clean_content, text) == expected


def test_finish_and_whole(apply):
    assert apply(clean.clean_finish, "+ b\n~~~py\nx\n~~~\n_e_") == "- b\n```py\nx\n```\n*e*\n"
    assert apply(clean.clean_markdown, "") == ""
    out = apply(clean.clean_markdown, "<!-- c --># T\n\n\n\ntext <div>x</div>\n```js\na  b\n```\n- i ")
    assert "<" not in out and "\n\n\n" not in out and out.endswith("\n") and "```js" in out and "- i" in out


def test_null_and_unicode(apply, spark):
    nulls = spark.createDataFrame([(None,)], "x string")
    assert nulls.select(clean.clean_markdown(F.col("x"))).first()[0] is None
    assert apply(trimmed, " 　 a b  ﻿") == "a b"
    assert apply(utf16_length, "a😀b") == 4
    assert apply(tokens, "abcde") == 1 and apply(lambda c: rounded(F.length(c) / 2), "abc") == 2
    assert apply(lambda c: clipped(c, 3), "abc", "abcd") == ["abc", "abc..."]


@pytest.mark.parametrize(("title", "expected"), [("Test Article", "test-article"), ("--A  b!--", "a-b"), ("日本", ""), ("x" * 70, "x" * 60)])
def test_slug(apply, title, expected):
    assert apply(slug, title) == expected


SENTENCE = "text " * 50
VECTORS = [
    (SENTENCE + "<div>test</div>" * 101, 35, "leftover HTML tags"),
    ("text " * 100 + "<br/>" * 55, 55, "HTML tags present"),
    ("text " * 100 + "<em>x</em>" * 15, 85, "minor HTML tags"),
    ("text " * 100 + "<tr><td>cell</td></tr>" * 30, 5, "unconverted table tags"),
    ('<div class="very-long-class-name">x</div>' * 50, 25, "% of content is HTML tags"),
    ("", 0, "Blank content - no text extracted"),
    ("Hello world", 50, "Extremely short content"),
    ("text " * 100 + ("\n" * 6 + "more text ") * 15, 95, "excessive newlines"),
    ("<div>x</div>" * 110, 5, "leftover HTML tags"),
    ("<script></script>" * 10 + "<style></style>" * 10 + "<div>x</div>" * 200, 0, "script tags present"),
]


def test_scores(spark):
    rows = spark.createDataFrame([(i, t) for i, (t, _, _) in enumerate(VECTORS)], "i int, markdown string")
    found = quality.score(rows).orderBy("i").collect()
    for (_, score, said), r in zip(VECTORS, found, strict=True):
        q = r.quality
        assert q.score == score
        assert any(said in x for x in [*q.issues, *q.warnings])
        assert q.is_valid == (q.raw >= 60)
    report = quality.report(F.lit(65), F.array(F.lit("a")), F.array().cast("array<string>"))
    assert spark.range(1).select(report).first()[0] == "**Quality Score**: 65/100 ⚠️ Acceptable\n\n**Issues**:\n- a\n"


def test_header_block(spark):
    row = spark.createDataFrame([('say "hi"', "u", "d", None, "body", "x.md")], "t string, u string, d string, q string, c string, f string")
    text = row.select("f", frontmatter.encode(*(F.col(c) for c in "tudqc")).alias("value"))
    assert text.first().value == '---\ntitle: "say \\"hi\\""\nsource_url: u\nfetched_date: d\ntype: web\nstatus: temporary\n---\n\nbody'
    r = frontmatter.decode(text, "f").first()
    assert (r.ref_id, r.title, r.url, r.query) == ("x", 'say \\"hi\\"', "u", None)
    empty = spark.createDataFrame([("e.md", "---\ntitle:\nsource_url: u\n---\nx"), ("n.md", "no block"), ("w.md", "---\r\ntitle: a\r\n---\r\n")], "f string, value string")
    found = frontmatter.decode(empty, "f").collect()
    assert [(r.ref_id, r.title) for r in found] == [("e", "source_url: u")]
    promoted = text.select(frontmatter.permanent(F.concat("value", F.lit("\nstatus: temporary"))).alias("v")).first().v
    assert promoted.count("status: permanent") == 1 and promoted.endswith("status: temporary")


def test_links(spark):
    md = "[a](https://x) [b](#y) [c](mailto:z) ![i](http://p.png) [again](https://x) [t](https://w \"title\") [r](/rel)"
    rows = spark.createDataFrame([(1, md), (2, "none"), (3, None)], "i int, x string")
    found = links.exploded(rows, "i", "x").orderBy("source_ref", "pos").collect()
    assert [(r.source_ref, r.pos, r.text, r.href) for r in found] == [(1, 0, "a", "https://x"), (1, 1, "i", "http://p.png"), (1, 2, "t", 'https://w "title"')]
