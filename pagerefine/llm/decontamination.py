"""Benchmark decontamination with a distributed positional inverted index, in DataFrame operations alone.

Postings say where a term stands in a document. A term at place q of an item and at position p of a document votes
for the offset p - q; lists adjusted so are intersected, first those of each window's rarest terms, then, in the
few documents that are left, those of all terms. Runs of places at one offset are exact phrases; many places of an
item at nearly one offset are a proximity match.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import ascii_lower, bounded, discard, stored

# What separates words, once A-Z are lower-cased, and before that.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
SEPARATORS_OF_ANY_CASE = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: A table of at most so many rows with several columns is broadcast.
BROADCAST_WIDE = 100_000
#: How many of a window's words, the rarest, are looked for first.
ANCHORS = 2


def words_of(text: Column) -> Column:
    return F.filter(F.split(ascii_lower(F.coalesce(text.cast("string"), F.lit(""))), SEPARATORS), lambda w: w != "")


def count_words(text: Column) -> Column:
    """How many words_of() gives, without lower-casing them."""
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), SEPARATORS_OF_ANY_CASE), lambda w: w != "")).cast("long")


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc, h, t: h tells apart texts under a repeated id."""
    text = F.col(text_col).cast("string")
    return docs.select(F.col(id_col).alias("doc"), F.coalesce(F.xxhash64(text), F.lit(0)).alias("h"), text.alias("t"))


def postings(rows: DataFrame, terms: DataFrame | None = None) -> DataFrame:
    """The positional index of rows(doc, h, t): doc, h, term, pos; only of terms(term), if given."""
    found = rows.select("doc", "h", F.posexplode(words_of(F.col("t"))).alias("pos", "term"))
    return found if terms is None else found.join(bounded(terms, BROADCAST_WIDE), "term", "left_semi")


def item_terms(items: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    """item, q, term, length, span: every word of every item; span is the length of its windows.

    item is the id with the text's hash, which tells apart texts under a repeated id.
    """
    item = F.struct(F.col(id_col).alias("id"), F.coalesce(F.xxhash64(F.col(text_col).cast("string")), F.lit(0)).alias("hash"))
    rows = items.select(item.alias("item"), words_of(F.col(text_col)).alias("w")).where("size(w) > 0").distinct()
    rows = rows.select("item", F.size("w").alias("length"), F.least(F.lit(size), F.size("w")).alias("span"), F.posexplode("w").alias("q", "term"))
    return rows


def rarest_terms(terms: DataFrame, counts: DataFrame) -> DataFrame:
    """item, s, q, term: of each window the ANCHORS rarest words by the corpus's counts; windows with a word that the
    corpus lacks can't occur and have none."""
    counted = terms.join(counts, "term", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    first = F.greatest(F.lit(0), F.col("q") - F.col("span") + 1)
    last = F.least(F.col("q"), F.col("length") - F.col("span"))
    windows = counted.withColumn("s", F.explode(F.sequence(first, last)))
    whole = Window.partitionBy("item", "length", "s")
    windows = windows.withColumn("least", F.min("n").over(whole)).where("least > 0")
    windows = windows.withColumn("rn", F.row_number().over(whole.orderBy("n", "term", "q"))).where(F.col("rn") <= ANCHORS)
    return windows.select("item", "s", "q", "term")


def grids(offset: Column, slop: int) -> Column:
    """Cells of two shifted grids: offsets that differ by at most slop share one."""
    if slop == 0:
        return F.array(F.struct(F.lit(0).alias("grid"), offset.alias("cell")))
    width = 2 * slop
    cell = lambda shift: F.floor((offset + shift) / F.lit(width)).cast("int")
    return F.array(*(F.struct(F.lit(i).alias("grid"), cell(s).alias("cell")) for i, s in enumerate((0, slop))))


def find_matches(
    docs: DataFrame, items: DataFrame, window: int = 10, slop: int = 2, near: float = 0.8, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text"
) -> DataFrame:
    """Spans and proximity matches: doc, h, item, kind, start, end (positions of words, end exclusive).

    kind `phrase`: a maximal run of places, holding whole windows of the item. kind `near`: a share of at least
    `near` of the item's places lies at offsets within slop of each other. Items without words match nothing.
    """
    rows = keyed(docs, id_col, text_col)
    terms = stored(item_terms(items, item_col, item_text_col, window), "item-terms")
    vocabulary = stored(terms.select("term").distinct(), "item-vocabulary")
    counts = postings(rows, vocabulary).groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    anchors = stored(rarest_terms(terms, counts), "anchors")
    windows = anchors.groupBy("item", "s").agg(F.sort_array(F.collect_set("q")).alias("w"))
    windows = stored(windows.groupBy("item").agg(F.collect_set("w").alias("windows")), "anchored-windows").withColumnRenamed("item", "i")
    anchors = stored(anchors.select("item", "q", "term").distinct(), "anchor-terms")

    index = stored(postings(rows, stored(anchors.select("term").distinct(), "anchor-vocabulary")), "postings")
    votes = index.join(bounded(anchors, BROADCAST_WIDE), "term").withColumn("at", F.explode(grids(F.col("pos") - F.col("q"), slop)))
    votes = votes.groupBy("doc", "h", "item", "at").agg(F.collect_set("q").alias("qs"))
    whole = F.exists("windows", lambda w: F.size(F.array_except(w, F.col("qs"))) == 0)
    likely = votes.join(bounded(windows, BROADCAST_WIDE), F.col("item").eqNullSafe(F.col("i"))).where(whole)
    likely = stored(likely.select("doc", "h", "item", "at"), "likely")
    discard(index)

    # All lists, in the documents that are left.
    left = stored(likely.select(F.col("doc").alias("d"), F.col("h").alias("x")).distinct(), "likely-documents")
    same = F.col("doc").eqNullSafe(F.col("d")) & (F.col("h") == F.col("x"))
    lists = postings(rows.join(bounded(left), same, "left_semi"), vocabulary)
    asked = likely.select(F.col("doc").alias("d"), F.col("h").alias("x"), F.col("item").alias("i"), "at")
    asked = asked.join(bounded(terms, BROADCAST_WIDE), F.col("i").eqNullSafe(F.col("item"))).drop("i").withColumnRenamed("term", "asked")
    asked = stored(asked, "asked-terms")
    places = lists.join(bounded(asked, BROADCAST_WIDE), same & (F.col("term") == F.col("asked"))).withColumn("offset", F.col("pos") - F.col("q"))
    places = places.where(F.array_contains(grids(F.col("offset"), slop), F.col("at")))
    # A posting counts once at an offset, also where an id and its text are repeated.
    found = places.select("doc", "h", "item", "length", "span", "at", "offset", "q").distinct()
    found = stored(found, "places")

    run = Window.partitionBy("doc", "h", "item", "offset").orderBy("q")
    exact = found.select("doc", "h", "item", "span", "offset", "q").distinct().withColumn("island", F.col("q") - F.row_number().over(run))
    exact = exact.groupBy("doc", "h", "item", "span", "offset", "island").agg(F.min("q").alias("first"), F.count(F.lit(1)).alias("n")).where("n >= span")
    start = F.col("offset") + F.col("first")
    phrases = exact.select("doc", "h", "item", F.lit("phrase").alias("kind"), start.alias("start"), (start + F.col("n")).cast("int").alias("end"))
    close = found.groupBy("doc", "h", "item", "length", "at").agg(
        F.count_distinct("q").alias("n"), F.min(F.col("offset") + F.col("q")).alias("start"), (F.max(F.col("offset") + F.col("q")) + 1).alias("end")
    )
    close = close.where(F.col("n") >= F.lit(near) * F.col("length")).select("doc", "h", "item", F.lit("near").alias("kind"), "start", "end")
    return phrases.unionByName(close).withColumn("item", F.col("item.id"))


def decontaminate(docs: DataFrame, items: DataFrame, window: int = 10) -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_hit, n_items, items_sha256, contaminated.

    A word is hit if it lies inside an occurrence of a window. Null and empty texts have no words and no hits.
    """
    phrases = stored(find_matches(docs, items, window).where("kind = 'phrase'"), "matches")
    hit = phrases.select("doc", "h", F.explode(F.sequence(F.col("start"), F.col("end") - 1)).alias("pos")).distinct().groupBy("doc", "h").agg(F.count(F.lit(1)).alias("n_hit"))
    by_doc = phrases.groupBy("doc", "h").agg(F.collect_set(F.col("item").cast("string")).alias("items"))
    verdicts = by_doc.join(hit.withColumnsRenamed({"doc": "d", "h": "x"}), F.col("doc").eqNullSafe(F.col("d")) & (F.col("h") == F.col("x")), "left").select(
        F.col("doc").alias("d"), F.col("h").alias("x"), "n_hit", "items"
    )
    rows = keyed(docs, "doc_id", "text").select("doc", "h", count_words(F.col("t")).alias("n_words"))
    out = rows.join(verdicts, F.col("doc").eqNullSafe(F.col("d")) & (F.col("h") == F.col("x")), "left")
    items_ = F.coalesce("items", F.array().cast("array<string>"))
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    return out.select(
        F.col("doc").alias("doc_id"), "n_words", n_hit.alias("n_hit"), F.size(items_).cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort(items_), ",").cast("binary"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )


def clean_documents(docs: DataFrame, items: DataFrame, window: int = 10) -> DataFrame:
    """The rows of docs without a hit, all columns as they were."""
    found = find_matches(docs, items, window).where("kind = 'phrase'").select(F.col("doc").alias("d"), F.col("h").alias("x")).distinct()
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    key = F.coalesce(F.xxhash64(F.col("row.text").cast("string")), F.lit(0))
    left = rows.join(bounded(stored(found, "contaminated")), F.col("row.doc_id").eqNullSafe(F.col("d")) & (key == F.col("x")), "left_anti")
    return left.select("row.*")


_WORDS = "regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
ORACLE = f"""
    WITH iw AS (SELECT item_id, w, least(10, len(w)) AS l FROM (SELECT item_id, {_WORDS} AS w FROM benchmark) WHERE len(w) > 0),
    win AS (SELECT DISTINCT item_id, l, array_to_string(w[s:s + l - 1], ' ') AS g FROM (SELECT *, unnest(range(1, len(w) - l + 2)) AS s FROM iw)),
    dw AS (SELECT doc_id, coalesce({_WORDS}, []) AS w FROM documents),
    spots AS (SELECT doc_id, l, s, array_to_string(w[s:s + l - 1], ' ') AS g FROM (
           SELECT doc_id, w, l, unnest(range(1, len(w) - l + 2)) AS s FROM dw, (SELECT DISTINCT l FROM iw) WHERE len(w) >= l)),
    found AS (SELECT doc_id, item_id, s, l FROM spots JOIN win USING (l, g)),
    hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + l)) AS p FROM found) GROUP BY doc_id),
    ids AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM found) GROUP BY doc_id)
    SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
           sha256(coalesce(items, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
    FROM dw LEFT JOIN hit USING (doc_id) LEFT JOIN ids USING (doc_id)"""
