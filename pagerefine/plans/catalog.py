"""Named queries over the driver's tables, with equivalent SQL where there is one.

Texts of the tables hardly exercise the rewrites, so most queries first build noisy texts with one SQL expression that
both engines read alike.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagerefine.functions import clean, frontmatter, links, quality
from pagerefine.functions.text import clipped, is_blank, rounded, size_kb, slug, tokens, trimmed
from pagerefine.operators import crawl, extract, render, route, store
from pagerefine.sources import tables

DAY = "2024-05-01"
NEWLINE = "chr(10)"

#: A text with every feature that the rewrites look for.
NOISY = (
    "concat('# H', doc_id, chr(10), text, chr(13), chr(10), '* item one', chr(10), '+ item two', chr(10), "
    "'see *this* now  and **bold** or ***x***', chr(10), chr(10), chr(10), chr(10), '[a](https://e.com/', doc_id, ') [b]() ![](img.png) "
    '<div class="x">z</div> <!-- c\', chr(10), \'c --> d\', chr(10), \'```js\', chr(10), \'code  here\', chr(10), \'```\', chr(10), '
    "'snake_case_word __dunder__ “q” ‘s’ en–dash em—dash zero\u200bwidth\ufeff', chr(9), ' ', chr(10), '~~~py', chr(10), 'x', chr(10), '~~~', chr(10), "
    "text, '   ', chr(10), '1. one', chr(10), '    nested  list   ****', chr(10), '## Two', chr(10), 'after', chr(10), '- last ')"
)
#: A text with links of all kinds, some twice.
LINKED = (
    "concat('---', chr(10), 'title: \"T', doc_id, '\"', chr(10), '---', chr(10), chr(10), '[one](https://a.example/', doc_id % 7, ') and [two](http://b.example/', doc_id, ') ', "
    "'[again](https://a.example/', doc_id % 7, ') ![pic](https://img.example/p.png) [mail](mailto:x@y.z) [rel](/x) [anchor](#a) [ftp](ftp://f) ', text, "
    "' [last](https://c.example/', doc_id % 3, ' \"t\")')"
)
#: Whole stored files; some without a header, some with an empty title, some with Windows line ends.
FILES = (
    "concat(case when doc_id % 11 = 0 then '' else concat('---', case when doc_id % 13 = 0 then chr(13) else '' end, chr(10), 'title: ', "
    "case when doc_id % 5 = 0 then '' else concat('\"Title ', doc_id, '\"') end, chr(10), 'source_url: https://e.com/', doc_id, chr(10), 'fetched_date: 2024-05-', "
    "lpad(concat(1 + doc_id % 28), 2, '0'), chr(10), 'type: web', chr(10), 'status: temporary', chr(10), "
    "case when doc_id % 3 = 0 then concat('query: \"q ', doc_id, '\"', chr(10)) else '' end, '---', chr(10), chr(10)) end, text)"
)


def documents(spark: SparkSession, sf_dir: str, expression: str = NOISY, name: str = "x") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").withColumn(name, F.expr(expression)).select("doc_id", "text", name)


def _noisy_sql(expression: str = NOISY) -> str:
    return f"(SELECT doc_id, text, {expression} AS x FROM documents)"


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query, with SQL for the same rows."""

    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = sql
        return f

    return add


def per_document(name: str, column: Callable[[Column], Column], sql: Callable[[str], str], expression: str = NOISY) -> None:
    """A query of one column over texts built by an expression."""
    QUERIES[name] = lambda spark, sf_dir: documents(spark, sf_dir, expression).select("doc_id", column(F.col("x")).alias("y"))
    ORACLE_SQL[name] = f"SELECT doc_id, {sql('x')} AS y FROM {_noisy_sql(expression)}"


# --- clean-up -------------------------------------------------------------------------------------------------------
for _stage, _steps in (("structure", clean.STRUCTURE), ("content", clean.CONTENT), ("finish", clean.FINISH)):
    for _step in _steps:
        per_document(f"clean_{_stage}_{_step.name}", _step.column, _step.sql)
per_document("clean_structure", clean.clean_structure, lambda x: clean.stage_sql("structure", x))
per_document("clean_content", clean.clean_content, lambda x: clean.stage_sql("content", x))
per_document("clean_finish", clean.clean_finish, lambda x: clean.stage_sql("finish", x))


@query(
    "clean_full",
    f"""WITH a AS (SELECT doc_id, {clean.stage_sql("structure", "x")} AS x FROM {_noisy_sql()}), b AS (SELECT doc_id, {clean.stage_sql("content", "x")} AS x FROM a)
        SELECT doc_id, {clean.stage_sql("finish", "x")} AS y FROM b""",
)
def clean_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", clean.clean_markdown(F.col("x")).alias("y"))


#: Every text whole, and two blank ones beside it.
_BESIDE_BLANKS = {"doc_id * 3": NOISY, "doc_id * 3 + 1": "''", "doc_id * 3 + 2": "concat(' ', chr(10), chr(9), chr(10), ' ')"}


_BLANKED = f"({' UNION ALL '.join(f'SELECT {i} AS doc_id, {x} AS x FROM documents' for i, x in _BESIDE_BLANKS.items())})"


@query(
    "clean_blank_guard",
    f"""WITH s AS (SELECT doc_id, x AS o, regexp_matches(x, '[^{clean.WHITE}]') AS ok, x FROM {_BLANKED}),
        a AS (SELECT doc_id, o, ok, {clean.stage_sql("structure", "x")} AS x FROM s), b AS (SELECT doc_id, o, ok, {clean.stage_sql("content", "x")} AS x FROM a)
        SELECT doc_id, CASE WHEN ok THEN {clean.stage_sql("finish", "x")} ELSE o END AS y FROM b""",
)
def clean_blank_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = F.explode(F.array(*(F.struct(F.expr(i).alias("doc_id"), F.expr(x).alias("x")) for i, x in _BESIDE_BLANKS.items())))
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select(rows.alias("r")).select("r.doc_id", clean.clean_markdown(F.col("r.x")).alias("y"))


# --- quality --------------------------------------------------------------------------------------------------------
_COUNT = lambda x, p: f"CAST(len(regexp_extract_all({x}, '{p}')) AS BIGINT)"
_STRIPPED = f"regexp_replace(x, '{quality.TAG_OR_EMPTY}', '', 'g')"
_MEASURED = f"""
    SELECT id, {_COUNT("x", quality.TAG)} AS n_tags, {_COUNT("x", quality.TABLE_TAG)} AS n_table, {_COUNT("x", quality.SCRIPT)} AS n_script,
           {_COUNT("x", quality.STYLE)} AS n_style, {_COUNT("x", quality.NEWLINES)} AS n_newlines, length(x) AS n_chars, length(x) - length({_STRIPPED}) AS html_chars,
           length(regexp_replace(regexp_replace({_STRIPPED}, '{quality.MARKS}', '', 'g'), '{clean.TRIM}', '', 'g')) AS content
    FROM SCORED"""
_TITLE = "regexp_extract(html, '<title>([^<]*)</title>', 1)"
_ARTICLE = "regexp_extract(html, '(?s)<article>(.*?)</article>', 1)"
#: Beside every page whole, titles and pages with long blank stretches, script and table tags: all rules come up.
_VARIANTS = (
    f"case page_id % 5 when 0 then {_TITLE} when 1 then concat(html, repeat(concat(repeat(chr(10), 6), 'more '), 15)) "
    f"when 2 then concat(repeat('<tr><td>c</td></tr>', 30), {_TITLE}) when 3 then concat({_ARTICLE}, repeat('<b>', CAST(page_id % 70 AS INT))) "
    "else repeat('<div>x</div>', CAST(page_id % 12 AS INT)) end"
)
_SCORED = f"(SELECT page_id * 2 AS id, html AS x FROM pages UNION ALL SELECT page_id * 2 + 1 AS id, {_VARIANTS} AS x FROM pages)"
_SHARE = "CASE WHEN n_chars > 0 THEN html_chars / n_chars ELSE 0 END"
_TENTHS = "coalesce((html_chars * 2000 + n_chars) // nullif(2 * n_chars, 0), 0)"
_SCORES = f"""
    m AS ({_MEASURED.replace("SCORED", _SCORED)}), s AS (SELECT *, {_SHARE} AS share, {_TENTHS} AS p, content < 200 AND (n_tags > 50 OR n_table > 20) AS thin FROM m),
    b AS (SELECT *, 100 - (CASE WHEN n_tags > 100 THEN 40 WHEN n_tags > 50 THEN 20 WHEN n_tags > 10 THEN 5 ELSE 0 END) - (CASE WHEN n_table > 50 THEN 30 ELSE 0 END)
          - (CASE WHEN share > 0.3 THEN 25 WHEN share > 0.15 THEN 10 ELSE 0 END) - (CASE WHEN n_script > 0 THEN 15 ELSE 0 END) - (CASE WHEN n_style > 0 THEN 10 ELSE 0 END) AS before FROM s),
    r AS (SELECT *, (CASE WHEN content = 0 THEN 0 WHEN content < 50 THEN before - 50 WHEN thin THEN before - 30 WHEN content < 300 THEN before - 15 ELSE before END)
          - (CASE WHEN n_newlines > 10 THEN 5 ELSE 0 END) AS raw FROM b),
    q AS (SELECT *, CAST(greatest(0, raw) AS BIGINT) AS score, raw >= 60 AS is_valid, (p // 10) || '.' || (p % 10) AS pct FROM r),
    t AS (SELECT id, score, is_valid, list_filter([
            CASE WHEN n_tags > 100 THEN n_tags || ' leftover HTML tags found (likely forum/discussion thread)' END,
            CASE WHEN n_table > 50 THEN n_table || ' unconverted table tags (complex layout not suitable)' END,
            CASE WHEN share > 0.3 THEN pct || '% of content is HTML tags' END,
            CASE WHEN content = 0 THEN 'Blank content - no text extracted' WHEN content < 50 THEN 'Extremely short content (' || content || ' chars) - likely extraction failure'
                 WHEN thin THEN 'Only ' || content || ' chars of actual content with excessive HTML (extraction likely failed)' END], lambda v: v IS NOT NULL) AS issues,
          list_filter([
            CASE WHEN n_tags > 50 AND n_tags <= 100 THEN n_tags || ' HTML tags present' WHEN n_tags > 10 AND n_tags <= 50 THEN n_tags || ' minor HTML tags present' END,
            CASE WHEN share > 0.15 AND share <= 0.3 THEN pct || '% HTML tag ratio' END,
            CASE WHEN n_script > 0 THEN n_script || ' script tags present' END, CASE WHEN n_style > 0 THEN n_style || ' style tags present' END,
            CASE WHEN content >= 50 AND NOT thin AND content < 300 THEN 'Short content (' || content || ' chars) - may not be a full article' END,
            CASE WHEN n_newlines > 10 THEN n_newlines || ' sections with excessive newlines' END], lambda v: v IS NOT NULL) AS warnings FROM q)"""


def _variants(spark: SparkSession, sf_dir: str, odd: str = _VARIANTS, even: str = "html") -> DataFrame:
    """id, x: two texts of each page, at twice its id and next to it."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    both = F.explode(F.array(*(F.struct((F.col("page_id") * 2 + i).alias("id"), F.expr(e).alias("x")) for i, e in enumerate((even, odd)))))
    return pages.select(both.alias("r")).select("r.*")


def _measure_query(name: str, keys: tuple[str, ...]) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = quality.measures(F.col("x"))
        return _variants(spark, sf_dir).select("id", *(found[k].cast("long").alias(k) for k in keys))

    QUERIES[name] = run
    ORACLE_SQL[name] = f"SELECT id, {', '.join(keys)} FROM ({_MEASURED.replace('SCORED', _SCORED)})"


for _name, _keys in (
    ("q_tag_count", ("n_tags",)), ("q_table_tags", ("n_table",)), ("q_script", ("n_script",)), ("q_style", ("n_style",)), ("q_newlines", ("n_newlines",)), ("q_content_len", ("content",)),
):
    _measure_query(_name, _keys)


@query("q_html_ratio", f"SELECT id, CAST({_TENTHS} AS BIGINT) AS tenths FROM ({_MEASURED.replace('SCORED', _SCORED)})")
def q_html_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = quality.measures(F.col("x"))
    return _variants(spark, sf_dir).select("id", F.coalesce(quality.percent(m["html_chars"], m["n_chars"]), F.lit(0).cast("long")).alias("tenths"))


@query("q_score", f"WITH {_SCORES} SELECT id, score, is_valid FROM t")
def q_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score(_variants(spark, sf_dir), "x").select("id", F.col("quality.score").cast("long").alias("score"), "quality.is_valid")


@query("q_messages", f"WITH {_SCORES} SELECT id, array_to_string(issues, '|') AS issues, array_to_string(warnings, '|') AS warnings FROM t")
def q_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = lambda c: F.array_join(f"quality.{c}", "|").alias(c)
    return quality.score(_variants(spark, sf_dir), "x").select("id", joined("issues"), joined("warnings"))


@query(
    "q_report",
    f"""WITH {_SCORES} SELECT id, '**Quality Score**: ' || score || '/100 ' || (CASE WHEN score >= 90 THEN '✅ Excellent' WHEN score >= 75 THEN '✅ Good' WHEN score >= 60 THEN '⚠️ Acceptable'
        ELSE '❌ Poor' END) || (CASE WHEN len(issues) > 0 THEN chr(10) || chr(10) || '**Issues**:' || chr(10) || array_to_string(list_transform(issues, lambda v: '- ' || v || chr(10)), '') ELSE '' END)
        || (CASE WHEN len(warnings) > 0 THEN chr(10) || '**Warnings**:' || chr(10) || array_to_string(list_transform(warnings, lambda v: '- ' || v || chr(10)), '') ELSE '' END) AS report FROM t""",
)
def q_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    report = quality.report(F.col("quality.score"), F.col("quality.issues"), F.col("quality.warnings"))
    return quality.score(_variants(spark, sf_dir), "x").select("id", report.alias("report"))


# --- pages ----------------------------------------------------------------------------------------------------------
@query("pages_scan", "SELECT page_id, url, length(html) AS n_chars, CAST(200 AS BIGINT) AS http_status FROM pages")
def pages_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.pages(spark, sf_dir).select("page_id", "url", F.length("html").cast("long").alias("n_chars"), F.col("http_status").cast("long").alias("http_status"))


_STATUS = "CASE page_id % 4 WHEN 0 THEN 200 WHEN 1 THEN 404 WHEN 2 THEN 503 ELSE 299 END"


@query(
    "http_error_text",
    f"""SELECT page_id, CASE WHEN s NOT BETWEEN 200 AND 299 THEN 'HTTP ' || s || ': Text' END AS error, length(CASE WHEN s BETWEEN 200 AND 299 THEN html ELSE '' END) AS n_chars
        FROM (SELECT *, {_STATUS} AS s FROM pages)""",
)
def http_error_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = tables.pages(spark, sf_dir).withColumns({"http_status": F.expr(_STATUS), "status_text": F.lit("Text")})
    return tables.with_http_errors(raw).select("page_id", "error", F.length("html").cast("long").alias("n_chars"))


def _page_title() -> Column:
    return F.regexp_extract("html", "<title>([^<]*)</title>", 1)


@query("title_extract", f"SELECT page_id, {_TITLE} AS title FROM pages")
def title_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.pages(spark, sf_dir).select("page_id", _page_title().alias("title"))


@query("article_slice", f"SELECT page_id, {_ARTICLE} AS article FROM pages")
def article_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.pages(spark, sf_dir).select("page_id", F.regexp_extract("html", "(?s)<article>(.*?)</article>", 1).alias("article"))


@query("comment_strip", "SELECT page_id, regexp_replace(html, '(?s)<!--.*?-->', '', 'g') AS html FROM pages")
def comment_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.pages(spark, sf_dir).select("page_id", extract.remove_comments(F.col("html")).alias("html"))


_META = {"byline": "CASE WHEN page_id % 2 = 0 THEN concat('By ', page_id) END", "site": "CASE WHEN page_id % 3 = 0 THEN '' WHEN page_id % 3 = 1 THEN 'Site' END", "summary": "CASE WHEN page_id % 5 = 0 THEN 'Sum' END"}


@query(
    "md_header",
    f"""SELECT page_id, '# ' || {_TITLE} || chr(10) || chr(10) || coalesce('**By:** ' || nullif(byline, '') || chr(10) || chr(10), '') || coalesce('**Source:** ' || nullif(site, '') || chr(10) || chr(10), '')
        || coalesce('**Summary:** ' || nullif(summary, '') || chr(10) || chr(10), '') || '**URL:** ' || url || chr(10) || chr(10) || '---' || chr(10) || chr(10) AS header
        FROM (SELECT *, {", ".join(f"{e} AS {n}" for n, e in _META.items())} FROM pages)""",
)
def md_header(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tables.pages(spark, sf_dir).withColumns({n: F.expr(e) for n, e in _META.items()})
    return rows.select("page_id", extract.header(_page_title(), F.col("byline"), F.col("site"), F.col("summary"), F.col("url")).alias("header"))


# --- routes ---------------------------------------------------------------------------------------------------------
#: Texts of each page as fetched and as rendered, of which the scores are low, marginal and high, and at times equal.
_MARKED = f"concat({_ARTICLE}, '<script></script><style></style>')"
_PLAIN = f"case page_id % 4 when 0 then html when 1 then {_ARTICLE} when 2 then {_MARKED} else {_TITLE} end"
_SHOWN = f"case page_id % 5 when 0 then html when 1 then concat({_ARTICLE}, {_ARTICLE}) when 2 then {_MARKED} when 3 then {_TITLE} else {_ARTICLE} end"
#: Errors of both: pages that weren't fetched or had no article.
_ERRORS = {
    "fetch_error": "CASE WHEN page_id % 13 = 0 THEN 'HTTP 500: x' END", "extract_error": "CASE WHEN page_id % 17 = 0 THEN 'no article' END",
    "r_fetch_error": "CASE WHEN page_id % 7 = 0 THEN 'gone' END", "r_extract_error": "CASE WHEN page_id % 11 = 0 THEN 'no article' END",
}
_CASES = f"""
    WITH {_SCORES.replace(_SCORED, f"(SELECT page_id * 2 AS id, {_PLAIN} AS x FROM pages UNION ALL SELECT page_id * 2 + 1 AS id, {_SHOWN} AS x FROM pages)")}
    SELECT page_id, {", ".join(f"{e} AS {n}" for n, e in _ERRORS.items())}, a.score, b.score AS r_score
    FROM pages JOIN t a ON a.id = page_id * 2 JOIN t b ON b.id = page_id * 2 + 1"""


def _reason_sql(forced: str) -> str:
    return (
        f"CASE WHEN {forced} THEN 'forced' WHEN fetch_error IS NOT NULL THEN 'network_error' WHEN extract_error IS NOT NULL THEN 'extraction_failed' WHEN score >= 85 THEN NULL "
        "WHEN score >= 60 THEN 'quality_marginal' ELSE 'quality_too_low' END"
    )


_ROUTED = f"""
    SELECT *, CASE WHEN why IS NULL OR (why = 'quality_marginal' AND NOT coalesce(r_success AND r_score > score, false)) THEN 'simple' ELSE 'rendered' END AS picked FROM (
    SELECT *, r_fetch_error IS NULL AND r_extract_error IS NULL AND r_score >= 60 AS r_success FROM (SELECT *, {_reason_sql("false")} AS why FROM ({_CASES})))"""


def _cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", F.expr(_PLAIN).alias("plain"), F.expr(_SHOWN).alias("shown"))
    rows = quality.score(quality.score(rows, "plain", "q"), "shown", "r")
    rows = rows.select("page_id", *(F.expr(e).alias(n) for n, e in _ERRORS.items()), F.col("q.score").alias("score"), F.col("r.score").alias("r_score"))
    why = route.reason(F.col("fetch_error"), F.col("extract_error"), F.col("score"), 60, 85)
    outcome = route.rendered_outcome(F.col("r_fetch_error"), F.col("r_extract_error"), F.col("r_score"), 60)
    rows = rows.withColumn("why", why).withColumns({f"r_{k}": v for k, v in outcome.items()})
    return rows.withColumn("picked", route.pick(F.col("why"), F.col("score"), F.col("r_success"), F.col("r_score")))


@query("route_simple", f"SELECT page_id, why IS NULL AS accepted FROM ({_ROUTED})")
def route_simple(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cases(spark, sf_dir).select("page_id", F.col("why").isNull().alias("accepted"))


@query("route_reason", f"SELECT page_id, why FROM ({_ROUTED})")
def route_reason(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cases(spark, sf_dir).select("page_id", "why")


@query("route_forced", f"SELECT page_id, {_reason_sql('page_id % 2 = 0')} AS why FROM ({_CASES})")
def route_forced(spark: SparkSession, sf_dir: str) -> DataFrame:
    why = route.reason(F.col("fetch_error"), F.col("extract_error"), F.col("score"), 60, 85, F.col("page_id") % 2 == 0)
    return _cases(spark, sf_dir).select("page_id", why.alias("why"))


@query("route_marginal_pick", f"SELECT page_id, picked FROM ({_ROUTED}) WHERE why = 'quality_marginal'")
def route_marginal_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cases(spark, sf_dir).where("why = 'quality_marginal'").select("page_id", "picked")


@query(
    "route_final",
    f"""SELECT page_id, picked, CASE WHEN picked = 'simple' THEN true ELSE r_success END AS success,
        CASE WHEN picked = 'rendered' THEN CASE WHEN r_fetch_error IS NOT NULL THEN 'Playwright fetch failed: ' || r_fetch_error WHEN r_extract_error IS NOT NULL THEN r_extract_error
             WHEN r_score < 60 THEN 'Content quality too low (' || r_score || '/100) even with JavaScript rendering' END END AS error,
        CASE WHEN picked = 'rendered' AND r_fetch_error IS NULL AND r_extract_error IS NULL AND r_score < 60 THEN '{route.SUGGESTION}' END AS suggestion,
        CASE WHEN picked = 'rendered' AND r_fetch_error IS NULL AND r_extract_error IS NULL THEN true END AS used_rendered FROM ({_ROUTED})""",
)
def route_final(spark: SparkSession, sf_dir: str) -> DataFrame:
    rendered = F.col("picked") == "rendered"
    own = lambda c: F.when(rendered, F.col(f"r_{c}")).alias(c)
    success = F.when(rendered, F.col("r_success")).otherwise(F.lit(True)).alias("success")
    return _cases(spark, sf_dir).select("page_id", "picked", success, own("error"), own("suggestion"), own("used_rendered"))


# --- slugs and header blocks ----------------------------------------------------------------------------------------
_SLUG = lambda t: f"substr(regexp_replace(regexp_replace(lower({t}), '[^a-z0-9]+', '-', 'g'), '\\A-|-\\z', '', 'g'), 1, 60)"


@query("slugify", f"SELECT page_id, {_SLUG(_TITLE)} AS slug FROM pages")
def slugify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.pages(spark, sf_dir).select("page_id", slug(_page_title()).alias("slug"))


#: Pages to be saved, under addresses that several of them share; titles repeat too.
_BATCH_COLUMNS = (
    "page_id AS seq", f"{_TITLE} AS title", "concat('https://e.com/', page_id % 97) AS url", "html AS content",
    "CASE WHEN page_id % 4 = 0 THEN concat('q \"', page_id, '\"') END AS query", "page_id % 6 = 0 AS refetch",
)
_BATCH = f"SELECT {', '.join(_BATCH_COLUMNS)} FROM pages"


def _batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/pages.parquet").selectExpr(*_BATCH_COLUMNS)


_QUOTE = lambda x: f"""'"' || replace({x}, '"', '\\"') || '"'"""
_ENCODED = lambda status="temporary": (
    f"'---' || chr(10) || 'title: ' || {_QUOTE('title')} || chr(10) || 'source_url: ' || url || chr(10) || 'fetched_date: {DAY}' || chr(10) || 'type: web' || chr(10) || 'status: {status}' || chr(10) || "
    f"(CASE WHEN coalesce(query, '') <> '' THEN 'query: ' || {_QUOTE('query')} || chr(10) ELSE '' END) || '---' || chr(10) || chr(10) || content"
)


@query("fm_encode", f"SELECT seq, {_ENCODED()} AS value FROM ({_BATCH})")
def fm_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = frontmatter.encode(F.col("title"), F.col("url"), F.lit(DAY), F.col("query"), F.col("content"))
    return _batch(spark, sf_dir).select("seq", text.alias("value"))


_BLOCK = r"\A---\n((?s:.*?))\n---"
_TRIM_SQL = lambda x: f"regexp_replace({x}, '{clean.TRIM}', '', 'g')"


def _value_sql(block: str, key: str) -> str:
    found = _TRIM_SQL(f"regexp_extract({block}, '{frontmatter.value_pattern(key)}', 1)")
    return _TRIM_SQL(f"regexp_replace({found}, '\\A[\"'']|[\"'']\\z', '', 'g')")


_DECODED = f"""
    SELECT doc_id, 'doc-' || doc_id AS ref_id, {_value_sql("b", "title")} AS title, {_value_sql("b", "source_url")} AS url, {_value_sql("b", "fetched_date")} AS fetched_date,
           length(x) AS size, nullif({_value_sql("b", "query")}, '') AS query, x
    FROM (SELECT *, regexp_extract(x, '{_BLOCK}', 1) AS b FROM {_noisy_sql(FILES)} WHERE regexp_matches(x, '{_BLOCK}'))"""


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir, FILES).select("doc_id", F.concat(F.lit("doc-"), F.col("doc_id"), F.lit(".md")).alias("file_name"), F.col("x").alias("value"))


def _state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _files(spark, sf_dir).select(F.lit("temporary").alias("status"), F.concat(F.lit(".tmp/"), "file_name").alias("filepath"), "value")


_REF = ["ref_id", "title", "url", "fetched_date", "size", "query"]


@query("fm_decode", f"SELECT {', '.join(_REF)} FROM ({_DECODED})")
def fm_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frontmatter.decode(_files(spark, sf_dir)).select(*_REF)


@query("fm_strip", f"SELECT doc_id, regexp_replace(x, '{frontmatter.BLOCK_AND_LINES}', '') AS body FROM {_noisy_sql(FILES)}")
def fm_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _files(spark, sf_dir).select("doc_id", frontmatter.strip(F.col("value")).alias("body"))


@query("fm_missing_skipped", f"SELECT count(*) AS n, count(*) FILTER (NOT regexp_matches(x, '{_BLOCK}')) AS skipped FROM {_noisy_sql(FILES)}")
def fm_missing_skipped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _files(spark, sf_dir).agg(F.count(F.lit(1)).alias("n"), F.count_if(~frontmatter.has_block(F.col("value"))).alias("skipped"))


# --- store ----------------------------------------------------------------------------------------------------------
@query("cache_list_sorted", f"SELECT {', '.join(_REF)}, '.tmp/' || ref_id || '.md' AS filepath FROM ({_DECODED}) ORDER BY fetched_date DESC, ref_id")
def cache_list_sorted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.list_references(_state(spark, sf_dir))


_URLS = "SELECT DISTINCT 'https://e.com/' || (doc_id * 3) AS url FROM documents"


@query("find_by_url", f"SELECT u.url, ref_id, '.tmp/' || ref_id || '.md' AS filepath FROM ({_URLS}) u LEFT JOIN ({_DECODED}) d ON u.url = d.url")
def find_by_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    urls = documents(spark, sf_dir).select(F.concat(F.lit("https://e.com/"), F.col("doc_id") * 3).alias("url")).distinct()
    return store.find_by_url(_state(spark, sf_dir), urls)


#: Every document's reference, and as many that aren't there.
_IDS = "SELECT unnest(['doc-' || doc_id, 'none-' || doc_id]) AS ref_id FROM documents"


def _ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = (F.concat(F.lit(kind), F.col("doc_id")) for kind in ("doc-", "none-"))
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.explode(F.array(*own)).alias("ref_id"))


@query("find_by_ref", f"SELECT i.ref_id, url, CASE WHEN d.ref_id IS NOT NULL THEN '.tmp/' || d.ref_id || '.md' END AS filepath FROM ({_IDS}) i LEFT JOIN ({_DECODED}) d ON i.ref_id = d.ref_id")
def find_by_ref(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.find_by_ref(_state(spark, sf_dir), _ids(spark, sf_dir))


_SAVED = f"""
    WITH d AS ({_DECODED}), k AS (SELECT url, min_by(ref_id, row(ref_id)) AS ref FROM d GROUP BY url),
    b AS (SELECT *, {_SLUG("title")} AS slug FROM ({_BATCH})),
    r AS (SELECT b.*, coalesce(k.ref, first(b.slug) OVER (PARTITION BY b.url ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) AS known FROM b LEFT JOIN k USING (url)),
    s AS (SELECT *, known IS NOT NULL AND NOT refetch AS already_exists FROM r),
    saved AS (SELECT *, CASE WHEN already_exists THEN known ELSE slug END AS ref_id, '.tmp/' || coalesce(known, slug) || '.md' AS filepath FROM s)"""


def _save(spark: SparkSession, sf_dir: str, refetch: bool | None = None) -> tuple[DataFrame, DataFrame]:
    batch = _batch(spark, sf_dir)
    batch = batch if refetch is None else batch.withColumn("refetch", F.lit(refetch))
    return store.save(_state(spark, sf_dir), batch, F.lit(DAY))


@query("save_results", f"{_SAVED} SELECT seq, url, ref_id, filepath, already_exists, CAST(NULL AS VARCHAR) AS error FROM saved")
def save_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _save(spark, sf_dir)[0]


def _after_sql(saved: str) -> str:
    return f"""{saved}, w AS (SELECT *, row_number() OVER (PARTITION BY filepath ORDER BY seq DESC) AS rn FROM saved WHERE NOT already_exists),
        fresh AS (SELECT 'temporary' AS status, filepath, {_ENCODED()} AS value FROM w WHERE rn = 1),
        old AS (SELECT 'temporary' AS status, '.tmp/doc-' || doc_id || '.md' AS filepath, x AS value FROM {_noisy_sql(FILES)})
        SELECT * FROM fresh UNION ALL SELECT * FROM old WHERE filepath NOT IN (SELECT filepath FROM fresh)"""


@query("save_upsert", _after_sql(_SAVED))
def save_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _save(spark, sf_dir)[1]


@query("save_refetch", _after_sql(_SAVED.replace(f"FROM ({_BATCH})", f"FROM (SELECT * REPLACE (true AS refetch) FROM ({_BATCH}))")))
def save_refetch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _save(spark, sf_dir, True)[1]


_NONE = _SAVED.replace(f"({_DECODED})", f"(SELECT * FROM ({_DECODED}) WHERE false)").replace(f"FROM ({_BATCH})", f"FROM (SELECT * REPLACE (true AS refetch, concat(url, '/', seq) AS url) FROM ({_BATCH}))")


@query(
    "slug_last_write",
    f"{_NONE}, w AS (SELECT *, row_number() OVER (PARTITION BY filepath ORDER BY seq DESC) AS rn FROM saved) SELECT 'temporary' AS status, filepath, {_ENCODED()} AS value FROM w WHERE rn = 1",
)
def slug_last_write(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of all addresses saved to an empty store: of those whose titles have one slug, the last stays."""
    batch = _batch(spark, sf_dir).withColumns({"refetch": F.lit(True), "url": F.concat("url", F.lit("/"), "seq")})
    return store.save(store.empty(spark), batch, F.lit(DAY))[1]


@query(
    "promote",
    f"""SELECT i.ref_id, d.ref_id IS NOT NULL AS success, coalesce('.tmp/' || d.ref_id || '.md', '') AS from_path, coalesce('docs/ai/references/' || d.ref_id || '.md', '') AS to_path,
        CASE WHEN d.ref_id IS NULL THEN 'Reference ' || i.ref_id || ' not found in .tmp' END AS error FROM (SELECT DISTINCT ref_id FROM ({_IDS})) i LEFT JOIN ({_DECODED}) d ON i.ref_id = d.ref_id""",
)
def promote(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.promote(_state(spark, sf_dir), _ids(spark, sf_dir))[0]


_FOUND = f"(SELECT d.ref_id FROM ({_DECODED}) d WHERE d.ref_id IN ({_IDS}))"


@query(
    "promote_state",
    f"""SELECT CASE WHEN p THEN 'permanent' ELSE 'temporary' END AS status, CASE WHEN p THEN 'docs/ai/references/' ELSE '.tmp/' END || 'doc-' || doc_id || '.md' AS filepath,
        CASE WHEN p THEN regexp_replace(x, '(?m)^status:[{clean.WHITE}]*temporary$', 'status: permanent') ELSE x END AS value
        FROM (SELECT *, 'doc-' || doc_id IN (SELECT ref_id FROM {_FOUND}) AS p FROM {_noisy_sql(FILES)})""",
)
def promote_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.promote(_state(spark, sf_dir), _ids(spark, sf_dir))[1]


@query("promote_missing", "SELECT 'no-such' AS ref_id, false AS success, '' AS from_path, '' AS to_path, 'Reference no-such not found in .tmp' AS error")
def promote_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.promote(_state(spark, sf_dir), spark.createDataFrame([("no-such",)], "ref_id string"))[0]


@query("delete", f"SELECT 'temporary' AS status, '.tmp/doc-' || doc_id || '.md' AS filepath, x AS value FROM {_noisy_sql(FILES)} WHERE 'doc-' || doc_id NOT IN (SELECT ref_id FROM {_FOUND})")
def delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.delete(_state(spark, sf_dir), _ids(spark, sf_dir))[1]


@query("delete_missing", "SELECT 'no-such' AS ref_id, false AS success, '' AS filepath, 'Reference no-such not found in .tmp' AS error")
def delete_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.delete(_state(spark, sf_dir), spark.createDataFrame([("no-such",)], "ref_id string"))[0]


# --- links and crawl ------------------------------------------------------------------------------------------------
_BODY = f"SELECT doc_id, regexp_replace(x, '{frontmatter.BLOCK_AND_LINES}', '') AS b FROM {_noisy_sql(LINKED)}"
_ALL = f"""SELECT doc_id, i AS pos, t[i] AS text, h[i] AS href FROM (SELECT *, unnest(range(1, len(t) + 1)) AS i FROM (
    SELECT doc_id, regexp_extract_all(b, '{links.LINK}', 1) AS t, regexp_extract_all(b, '{links.LINK}', 2) AS h FROM ({_BODY})))"""
_WEB = f"SELECT * FROM ({_ALL}) WHERE href LIKE 'http://%' OR href LIKE 'https://%'"
_UNIQUE = f"SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS pos, text, href FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, href ORDER BY pos) AS rn FROM ({_WEB})) WHERE rn = 1"


def _bodies(spark: SparkSession, sf_dir: str, expression: str = LINKED) -> DataFrame:
    return documents(spark, sf_dir, expression).select("doc_id", frontmatter.strip(F.col("x")).alias("b"))


def _exploded(spark: SparkSession, sf_dir: str, keep: Callable[[Column], Column] | None = None, expression: str = LINKED) -> DataFrame:
    rows = _bodies(spark, sf_dir, expression).select("doc_id", F.posexplode(links.links(F.col("b"))).alias("pos", "x"))
    rows = rows.select("doc_id", (F.col("pos") + 1).cast("long").alias("pos"), "x.text", "x.href")
    return rows if keep is None else rows.where(keep(F.col("href")))


@query("links_all", f"SELECT doc_id, pos, text, href FROM ({_ALL})")
def links_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _exploded(spark, sf_dir)


@query("links_http", f"SELECT doc_id, pos, text, href FROM ({_WEB})")
def links_http(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _exploded(spark, sf_dir, links.is_web)


@query("links_dedup", f"SELECT doc_id AS source_ref, CAST(pos AS BIGINT) AS pos, text, href FROM ({_UNIQUE})")
def links_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return links.exploded(_bodies(spark, sf_dir), "doc_id", "b").withColumn("pos", F.col("pos").cast("long"))


@query("links_count", f"SELECT 'doc-' || doc_id AS source_ref, count(*) AS count, CAST(NULL AS VARCHAR) AS error FROM ({_UNIQUE}) GROUP BY doc_id UNION ALL SELECT 'none', 0, 'Reference none not found in .tmp'")
def links_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = documents(spark, sf_dir, LINKED)
    state = rows.select(F.lit("temporary").alias("status"), F.concat(F.lit(".tmp/doc-"), "doc_id", F.lit(".md")).alias("filepath"), F.col("x").alias("value"))
    asked = rows.select(F.concat(F.lit("doc-"), "doc_id").alias("ref_id")).union(spark.createDataFrame([("none",)], "ref_id string"))
    return store.reference_links(state, asked)[0]


_HOP_COLUMNS = ("page_id AS pos", "concat('https://e.com/', (page_id * 5) % 311) AS href")
_FETCHED_COLUMNS = (
    "concat('https://e.com/', page_id) AS url", "page_id % 8 <> 0 AS success", f"{_TITLE} AS title", f"{_ARTICLE} AS markdown",
    "CASE WHEN page_id % 8 = 0 THEN 'HTTP 404: Not Found' END AS error",
)
_HOPS, _FETCHED = (f"SELECT {', '.join(c)} FROM pages" for c in (_HOP_COLUMNS, _FETCHED_COLUMNS))
_CRAWLED = f"""
    WITH d AS ({_DECODED}), k AS (SELECT url, min(ref_id) AS ref FROM d GROUP BY url),
    f AS ({_FETCHED}), rows AS (SELECT l.pos, l.href, coalesce(f.success, false) AS ok, f.title, f.error, {_SLUG("f.title")} AS slug FROM ({_HOPS}) l LEFT JOIN f ON f.url = l.href),
    r AS (SELECT rows.*, coalesce(k.ref, first(rows.slug) OVER (PARTITION BY ok, href ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) AS known FROM rows LEFT JOIN k ON k.url = href),
    out AS (SELECT pos, href AS url, CASE WHEN NOT ok THEN 'failed' WHEN known IS NOT NULL THEN 'cached' ELSE 'new' END AS status,
            CASE WHEN ok THEN coalesce(known, slug) END AS ref_id, CASE WHEN NOT ok THEN coalesce(error, 'page not found') END AS error FROM r)"""


def _crawl(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return crawl.fetch_links(_state(spark, sf_dir), pages.selectExpr(*_HOP_COLUMNS), pages.selectExpr(*_FETCHED_COLUMNS), F.lit(DAY))[0]


@query("crawl_status", f"{_CRAWLED} SELECT * FROM out")
def crawl_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _crawl(spark, sf_dir)


@query("crawl_summary", f"{_CRAWLED} SELECT count(*) FILTER (status = 'new') AS new, count(*) FILTER (status = 'cached') AS cached, count(*) FILTER (status = 'failed') AS failed FROM out")
def crawl_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crawl.summary(_crawl(spark, sf_dir))


@query(
    "render_crawl",
    f"""{_CRAWLED} SELECT pos, CASE status WHEN 'new' THEN 'new: ' || ref_id WHEN 'cached' THEN 'cached: ' || ref_id ELSE 'failed: ' || url || ' - ' || error END AS line,
        CASE status WHEN 'new' THEN '✓ ' || ref_id || ' (new)' WHEN 'cached' THEN '○ ' || ref_id || ' (already cached)' ELSE '✗ ' || substr(url, 1, 50) || '... (' || error || ')' END AS pretty FROM out""",
)
def render_crawl(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [F.col(c) for c in ("status", "ref_id", "url", "error")]
    return _crawl(spark, sf_dir).select("pos", render.crawled(*parts).alias("line"), render.crawled(*parts, pretty=True).alias("pretty"))


# --- rendering ------------------------------------------------------------------------------------------------------
_CLIP = lambda x, n: f"CASE WHEN length({x}) > {n} THEN substr({x}, 1, {n}) || '...' ELSE {x} END"
_LONG = "concat('https://e.com/', repeat('p', CAST(doc_id % 90 AS INT)))"


@query("truncations", f"SELECT doc_id, {_CLIP('text', 50)} AS t50, {_CLIP('u', 60)} AS t60, {_CLIP('text', 150)} AS t150 FROM (SELECT *, {_LONG} AS u FROM documents)")
def truncations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = documents(spark, sf_dir, _LONG, "u")
    return rows.select("doc_id", clipped(F.col("text"), 50).alias("t50"), clipped(F.col("u"), 60).alias("t60"), clipped(F.col("text"), 150).alias("t150"))


@query("token_estimate", "SELECT doc_id, CAST(floor(length(text) / 4 + 0.5) AS BIGINT) AS tokens FROM documents")
def token_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", tokens(F.col("text")).alias("tokens"))


@query("size_kb", "SELECT doc_id, CAST(floor(length(text) / 1024 + 0.5) AS BIGINT) AS kb FROM documents")
def size_kb_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", size_kb(F.length("text")).alias("kb"))


@query(
    "size_reduction",
    f"SELECT page_id, CAST(floor(length(html) / 4 + 0.5) AS BIGINT) AS html_tokens, CAST(floor(length({_ARTICLE}) / 4 + 0.5) AS BIGINT) AS article_tokens FROM pages",
)
def size_reduction(spark: SparkSession, sf_dir: str) -> DataFrame:
    article = F.regexp_extract("html", "(?s)<article>(.*?)</article>", 1)
    return tables.pages(spark, sf_dir).select("page_id", tokens(F.col("html")).alias("html_tokens"), tokens(article).alias("article_tokens"))


@query("render_list", f"""SELECT ref_id, ref_id || ' | ' || {_CLIP("title", 50)} || chr(10) || '  Date: ' || fetched_date || ' | Size: ' || CAST(floor(size / 1024 + 0.5) AS BIGINT) || 'KB' || chr(10) || '  URL: ' || {_CLIP("url", 60)} AS line FROM ({_DECODED})""")
def render_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = store.list_references(_state(spark, sf_dir))
    return found.select("ref_id", render.listed(*(F.col(c) for c in ("ref_id", "title", "fetched_date", "size", "url"))).alias("line"))


@query("render_links", f"SELECT doc_id AS source_ref, CAST(pos AS BIGINT) AS pos, text || ' | ' || href AS line FROM ({_UNIQUE})")
def render_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = links.exploded(_bodies(spark, sf_dir), "doc_id", "b")
    return found.select("source_ref", F.col("pos").cast("long").alias("pos"), render.link(F.col("text"), F.col("href")).alias("line"))


@query("render_summary", f"{_SAVED} SELECT seq, ref_id || '|' || filepath AS summary, '📦 Already cached: ' || ref_id || chr(10) || '   File: ' || filepath || chr(10) || chr(10) || '💡 Use --refetch to update' AS pretty, 'Already cached: ' || ref_id || chr(10) || 'Filepath: ' || filepath || chr(10) || 'Use --refetch to update' AS already FROM saved")
def render_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, ref, path = _save(spark, sf_dir)[0], F.col("ref_id"), F.col("filepath")
    return found.select("seq", render.saved_summary(ref, path).alias("summary"), render.already_text(ref, path).alias("already"), render.already_text(ref, path, pretty=True).alias("pretty"))


def _saved_sql(head: str, title: str, author: str, source: str, summary: str, filepath: str, size: str, quality_: str, rendered: str, tail: str = "''") -> str:
    return f"""SELECT page_id, '{head}' || page_id || {title} || {_TITLE} || coalesce({author} || nullif(byline, ''), '') || coalesce({source} || nullif(site, ''), '')
        || coalesce({summary} || nullif(summary, ''), '') || {filepath} || page_id || {size} || length(html) || ' chars (~' || CAST(floor(length(html) / 4 + 0.5) AS BIGINT)
        || ' tokens)' || {quality_} || (CASE WHEN page_id % 2 = 0 THEN {rendered} ELSE '' END) || {tail} AS text FROM (SELECT *, {", ".join(f"{e} AS {n}" for n, e in _META.items())} FROM pages)"""


def _saved_rows(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, dict[str, Column]]:
    rows = tables.pages(spark, sf_dir).withColumns({n: F.expr(e) for n, e in _META.items()})
    used = F.when(F.col("page_id") % 2 == 0, F.lit(True))
    return rows, {
        "ref_id": F.concat(F.lit("s"), "page_id"), "title": _page_title(), "byline": F.col("byline"), "site_name": F.col("site"), "excerpt": F.col("summary"),
        "filepath": F.concat(F.lit("f"), "page_id"), "markdown": F.col("html"), "score": F.lit(85), "used_rendered": used, "rendered_reason": F.when(used, "forced"),
    }


_NL = "chr(10)"


@query(
    "render_pretty",
    _saved_sql(
        "✅ Cached: s", f"{_NL} || {_NL} || '**Title**: '", f"{_NL} || '**Author**: '", f"{_NL} || '**Source**: '", f"{_NL} || '**Summary**: '", f"{_NL} || {_NL} || '**Saved to**: f'",
        f"{_NL} || '**Size**: '", f"{_NL} || '**Quality**: 85/100'", f"{_NL} || '**Playwright**: Yes (forced)'", f"{_NL} || {_NL} || '💡 To promote to docs: pagerefine promote s' || page_id",
    ),
)
def render_pretty(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, r = _saved_rows(spark, sf_dir)
    return rows.select("page_id", render.saved_text(r, pretty=True).alias("text"))


@query(
    "render_mcp",
    _saved_sql(
        "Cached: s", f"{_NL} || {_NL} || 'Title: '", f"{_NL} || 'Author: '", f"{_NL} || 'Source: '", f"{_NL} || 'Summary: '", f"{_NL} || {_NL} || 'Filepath: f'",
        f"{_NL} || 'Size: '", f"{_NL} || 'Quality: 85/100'", f"{_NL} || 'Playwright: Yes (forced)'",
    ),
)
def render_mcp(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, r = _saved_rows(spark, sf_dir)
    return rows.select("page_id", render.tool_text(r).alias("text"))


@query(
    "render_fetch_json",
    f"""SELECT page_id, '{{"success":true,"refId":"s' || page_id || '","title":' || CAST(to_json({_TITLE}) AS VARCHAR) || coalesce(',"byline":' || CAST(to_json(byline) AS VARCHAR), '')
        || coalesce(',"siteName":' || CAST(to_json(site) AS VARCHAR), '') || coalesce(',"excerpt":' || CAST(to_json(summary) AS VARCHAR), '') || ',"url":' || CAST(to_json(url) AS VARCHAR)
        || ',"filepath":"f' || page_id || '","size":' || length(html) || ',"tokens":' || CAST(floor(length(html) / 4 + 0.5) AS BIGINT) || ',"quality":85'
        || (CASE WHEN page_id % 2 = 0 THEN ',"usedPlaywright":true,"playwrightReason":"forced"' ELSE ',"query":"q"' END) || '}}' AS json
        FROM (SELECT *, {", ".join(f"{e} AS {n}" for n, e in _META.items())} FROM pages)""",
)
def render_fetch_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, r = _saved_rows(spark, sf_dir)
    asked = F.when(F.col("page_id") % 2 == 1, "q")
    return rows.select("page_id", render.saved_json(r, F.col("url"), asked).alias("json"))


@query(
    "render_list_page",
    f"SELECT 'Cached references (' || count(*) || '):' AS plain, '📚 Cached references (' || count(*) || '):' AS pretty, 'No cached references in .tmp/' AS none FROM ({_DECODED})",
)
def render_list_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = store.list_references(_state(spark, sf_dir)).agg(F.count(F.lit(1)).alias("n"))
    shown = [render.list_header(F.col("n"), ".tmp").alias("plain"), render.list_header(F.col("n"), ".tmp", pretty=True).alias("pretty")]
    return n.select(*shown, render.list_header(F.lit(0), ".tmp").alias("none"))


@query(
    "render_links_page",
    f"""SELECT doc_id AS source_ref, 'Found ' || n || ' links in ' || doc_id || ':' AS plain, '🔗 Found ' || n || ' links in ' || doc_id || ':' AS pretty, 'Fetching ' || n || ' links from ' || doc_id || '...' AS fetching
        FROM (SELECT doc_id, count(*) AS n FROM ({_UNIQUE}) GROUP BY doc_id)""",
)
def render_links_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _bodies(spark, sf_dir).select(F.col("doc_id").alias("source_ref"), F.size(links.web_links(F.col("b"))).alias("n"))
    n, ref = F.col("n"), F.col("source_ref").cast("string")
    return found.select(
        "source_ref", render.links_header(n, ref).alias("plain"), render.links_header(n, ref, pretty=True).alias("pretty"), render.links_header(n, ref, fetching=True).alias("fetching")
    )


@query(
    "render_saved",
    f"""SELECT page_id, 'Cached: s' || page_id || chr(10) || 'Title: ' || {_TITLE} || coalesce(chr(10) || 'Author: ' || nullif(byline, ''), '') || coalesce(chr(10) || 'Source: ' || nullif(site, ''), '')
        || coalesce(chr(10) || 'Summary: ' || nullif(summary, ''), '') || chr(10) || 'Filepath: f' || page_id || chr(10) || 'Size: ' || length(html) || ' chars (~' || CAST(floor(length(html) / 4 + 0.5) AS BIGINT)
        || ' tokens)' || chr(10) || 'Quality: 85/100' || (CASE WHEN page_id % 2 = 0 THEN chr(10) || 'Playwright: Yes (forced)' ELSE '' END) AS text
        FROM (SELECT *, {", ".join(f"{e} AS {n}" for n, e in _META.items())} FROM pages)""",
)
def render_saved(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, r = _saved_rows(spark, sf_dir)
    return rows.select("page_id", render.saved_text(r).alias("text"))


@query(
    "render_json",
    f"""{_SAVED} SELECT seq, CASE WHEN already_exists THEN '{{"success":true,"alreadyExists":true,"refId":"' ELSE '{{"success":true,"refId":"' END || ref_id || '","filepath":"' || filepath
        || (CASE WHEN already_exists THEN '","message":"{render.ALREADY_MESSAGE}"}}' ELSE '"}}' END) AS json FROM saved""",
)
def render_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _save(spark, sf_dir)[0]
    fields = {"success": F.lit(True), "alreadyExists": F.when(F.col("already_exists"), F.lit(True)), "refId": F.col("ref_id"), "filepath": F.col("filepath")}
    fields["message"] = F.when(F.col("already_exists"), render.ALREADY_MESSAGE)
    return found.select("seq", render.as_json(**fields).alias("json"))


_PROMOTED = f"(SELECT i.ref_id, d.ref_id AS f FROM (SELECT DISTINCT ref_id FROM ({_IDS})) i LEFT JOIN ({_DECODED}) d ON i.ref_id = d.ref_id)"


@query(
    "render_promote_delete",
    f"""SELECT ref_id, CASE WHEN f IS NOT NULL THEN 'Promoted: ' || ref_id || chr(10) || 'From: .tmp/' || f || '.md' || chr(10) || 'To: docs/ai/references/' || f || '.md'
        ELSE 'Error: Reference ' || ref_id || ' not found in .tmp' END AS promoted,
        CASE WHEN f IS NOT NULL THEN '✅ Promoted ' || ref_id || chr(10) || '   From: .tmp/' || f || '.md' || chr(10) || '   To:   docs/ai/references/' || f || '.md'
        ELSE 'Error: Reference ' || ref_id || ' not found in .tmp' END AS pretty_promoted,
        CASE WHEN f IS NOT NULL THEN '✅ Deleted ' || ref_id || chr(10) || '   File: .tmp/' || f || '.md' ELSE 'Error: Reference ' || ref_id || ' not found in .tmp' END AS pretty_deleted,
        CASE WHEN f IS NOT NULL THEN 'Deleted: ' || ref_id || chr(10) || 'File: .tmp/' || f || '.md' ELSE 'Error: Reference ' || ref_id || ' not found in .tmp' END AS deleted FROM {_PROMOTED}""",
)
def render_promote_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, d = (f(_state(spark, sf_dir), _ids(spark, sf_dir))[0] for f in (store.promote, store.delete))
    own = lambda f, *names: [f(*(F.col(c) for c in names), pretty=x).alias(("pretty_" if x else "") + f.__name__) for x in (False, True)]
    p = p.select("ref_id", *own(render.promoted, "ref_id", "success", "from_path", "to_path", "error"))
    d = d.select("ref_id", *own(render.deleted, "ref_id", "success", "filepath", "error"))
    return p.join(d, "ref_id")


# --- whole pages ----------------------------------------------------------------------------------------------------
@query("extract_markdown")
def extract_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.extract_pages(tables.pages(spark, sf_dir))


@query("pipeline_e2e")
def pipeline_e2e(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages through extraction, clean-up, scoring and routing, with a stand-in for each rendered one."""
    pages = tables.pages(spark, sf_dir)
    rendered = pages.withColumn("html", tables.render_stub(F.col("html"), F.col("page_id")))
    found = route.fetch(pages, rendered)
    joined = lambda c: F.array_join(c, "|").alias(c)
    return found.select("url", "success", "markdown", "title", "score", joined("issues"), joined("warnings"), "error", "used_rendered", "rendered_reason")
