"""Secret scans over versions of files with an incremental blob ledger, in DataFrame operations alone.

A version is a path and its text. Texts are addressed by content (SHA-256), so a blob is scanned once however many
paths and versions hold it. The ledger remembers which pairs of blob and rule version were scanned; a scan takes only
unseen pairs, and findings, kept per blob, are joined back to all paths.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import bounded, new_path, stored


def either_case(word: str) -> str:
    """A pattern of the word's ASCII letters in either case, which no engine's folding rules change."""
    return "".join(f"[{c.upper()}{c.lower()}]" if c.isascii() and c.isalpha() else c for c in word)


@dataclass(frozen=True)
class Rule:
    """Matches of pattern, from the left without overlap, whose group has at least least characters."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    version: int = 1
    base: bool = False


_NAMES = "|".join(either_case(w) for w in ("password", "passwd", "secret", "token")) + "|" + either_case("api") + "_?" + either_case("key")

# The rules. Where a run's length decides, the pattern asks for it; runs are matched whole either way.
RULES = (
    Rule("assign", rf"""({_NAMES})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, base=True),
    Rule("access", r"AKIA[A-Z0-9]{16,}", base=True),
    Rule("hex", r"[0-9a-f]{24,}", base=True),
    Rule("pem", r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
)


def content_address(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)


def unseen_pairs(blobs: DataFrame, rules: tuple[Rule, ...], ledger: DataFrame | None) -> DataFrame:
    """blobs with `kinds`: the rules whose current versions haven't seen the blob; blobs without any are left out."""
    if ledger is None:
        return blobs.withColumn("kinds", F.array(*(F.lit(r.kind) for r in rules)))
    pairs = F.array(*(F.struct(F.lit(r.kind).alias("kind"), F.lit(r.version).alias("version")) for r in rules))
    asked = blobs.select("blob", F.explode(pairs).alias("pair")).select("blob", "pair.kind", "pair.version")
    fresh = asked.join(ledger.select("blob", "kind", "version"), ["blob", "kind", "version"], "left_anti")
    return blobs.join(fresh.groupBy("blob").agg(F.collect_set("kind").alias("kinds")), "blob")


def scan_blobs(texts: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """Findings of texts(blob, text, kinds): blob, kind, version, start, end in code points, end exclusive.

    Offsets are running sums over a blob's own matches and the stretches between them.
    """
    found = []
    for r in rules:
        p, text = F.lit(r.pattern), F.col("text")
        pieces = F.split(text, r.pattern, -1)
        sizes = F.zip_with(
            F.regexp_extract_all(text, p, F.lit(0)), F.regexp_extract_all(text, p, F.lit(r.group)), lambda m, v: F.struct(F.length(m).alias("size"), F.length(v).alias("value"))
        )
        joined = F.zip_with(
            sizes, pieces, lambda s, gap: F.struct(F.lit(r.kind).alias("kind"), s["size"].alias("size"), s["value"].alias("value"), F.length(gap).alias("gap"))
        )
        numbered = F.transform(joined, lambda x, i: F.struct(x["kind"].alias("kind"), i.alias("i"), x["size"].alias("size"), x["value"].alias("value"), x["gap"].alias("gap")))
        found.append(F.when(F.array_contains("kinds", r.kind) & text.rlike(r.pattern), numbered))
    # A column of arrays that are null where a rule has no match; only texts with a match go on.
    hits = texts.select("blob", F.array(*found).alias("by_rule")).select("blob", F.explode("by_rule").alias("own")).where("own is not null")
    rows = hits.select("blob", F.explode("own").alias("x")).select("blob", "x.*").where("size is not null").dropDuplicates(["blob", "kind", "i"])
    so_far = Window.partitionBy("blob", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("end", F.sum(F.col("gap") + F.col("size")).over(so_far))
    least = F.coalesce(*(F.when(F.col("kind") == r.kind, r.least) for r in rules))
    version = F.coalesce(*(F.when(F.col("kind") == r.kind, r.version) for r in rules))
    return rows.where(F.col("value") >= least).select("blob", "kind", version.alias("version"), (F.col("end") - F.col("size")).alias("start"), "end")


LEDGER = {"pairs": "blob string, kind string, version int", "findings": "blob string, kind string, version int, start long, end long"}


class BlobLedger:
    """Scanned pairs and findings below a folder in a store that driver and executors share."""

    def __init__(self, spark: SparkSession, folder: str | None = None):
        self.spark, self.folder = spark, folder or new_path(spark, "ledger")

    def _read(self, name: str) -> DataFrame | None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        there = path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)
        return self.spark.read.schema(LEDGER[name]).parquet(f"{self.folder}/{name}") if there else None

    def pairs(self) -> DataFrame | None:
        """blob, kind, version of all scanned pairs; None before the first scan."""
        return self._read("pairs")

    def findings(self, rules: tuple[Rule, ...] = RULES) -> DataFrame:
        """Findings of the rules' current versions."""
        found = self._read("findings")
        if found is None:
            return self.spark.createDataFrame([], LEDGER["findings"])
        current = F.coalesce(*(F.when(F.col("kind") == r.kind, F.col("version") == r.version) for r in rules), F.lit(False))
        return found.where(current).dropDuplicates(["blob", "kind", "version", "start"])

    def scan(self, versions: DataFrame, rules: tuple[Rule, ...] = RULES, path_col: str = "path", text_col: str = "text") -> None:
        """Scan the unseen pairs of versions. A null text is an empty blob.

        Texts are moved once, by path, and only those that stand for a blob; a blob that many paths share is first
        cut down to its smallest path. Findings are written before pairs: a scan that breaks off is repeated, and
        what it had written shows once.
        """
        all_ = versions.select(F.col(path_col).alias("path"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
        all_ = all_.withColumn("blob", F.sha2(F.col("text").cast("binary"), 256))
        blobs = all_.groupBy("blob").agg(F.min("path").alias("first"))
        todo = unseen_pairs(blobs, rules, self.pairs()).select(F.col("blob").alias("b"), "first", "kinds")
        texts = all_.join(todo, F.col("path").eqNullSafe(F.col("first")) & (F.col("blob") == F.col("b"))).select("blob", "text", "kinds")
        scan_blobs(texts, rules).write.mode("append").parquet(f"{self.folder}/findings")
        version = F.coalesce(*(F.when(F.col("kind") == r.kind, r.version) for r in rules))
        done = todo.select(F.col("b").alias("blob"), F.explode("kinds").alias("kind")).withColumn("version", version)
        done.write.mode("append").parquet(f"{self.folder}/pairs")


def secret_report(versions: DataFrame, ledger: BlobLedger, rules: tuple[Rule, ...] = RULES, path_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per version: path_col, n_assign, n_access, n_hex, base_sha256, spans.

    spans lists kind:start:end of all findings by start, then by the rule's place, comma-joined; base_sha256 is the
    digest of the base rules' spans joined likewise. A text without findings has zeros and the digest of nothing.
    """
    place = F.coalesce(*(F.when(F.col("kind") == r.kind, i) for i, r in enumerate(rules)))
    base = F.col("kind").isin([r.kind for r in rules if r.base])
    item = F.struct("start", place.alias("place"), F.concat_ws(":", "kind", F.col("start").cast("string"), F.col("end").cast("string")).alias("said"), base.alias("base"))
    counts = [F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in ("assign", "access", "hex")]
    by_blob = ledger.findings(rules).groupBy("blob").agg(*counts, F.sort_array(F.collect_list(item)).alias("items"))
    joined = lambda items: F.array_join(F.transform(items, lambda x: x["said"]), ",")
    by_blob = by_blob.select(
        "blob", "n_assign", "n_access", "n_hex", F.sha2(joined(F.filter("items", lambda x: x["base"])), 256).alias("base_sha256"), joined(F.col("items")).alias("spans")
    )
    paths = versions.select(F.col(path_col).alias("path"), content_address(F.col(text_col).cast("string")).alias("blob"))
    zero = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("n_assign", "n_access", "n_hex")]
    return paths.join(by_blob, "blob", "left").select(
        F.col("path").alias(path_col), *zero, F.coalesce("base_sha256", F.sha2(F.lit(""), 256)).alias("base_sha256"), F.coalesce("spans", F.lit("")).alias("spans")
    )


def scan_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Scan all documents into a ledger of their own and report per document."""
    ledger = BlobLedger(docs.sparkSession)
    ledger.scan(docs, rules, "doc_id", "text")
    return secret_report(docs, ledger, rules)


def redact_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES, mask: str = "[SECRET]") -> DataFrame:
    """docs with every finding in `text` replaced by mask, overlapping ones by one mask; n_chars follows if present.

    Texts without findings, null ones among them, and all other columns stay as they are.
    """
    ledger = BlobLedger(docs.sparkSession)
    names = docs.columns
    inner = docs.select(F.struct(*(F.col(f"`{c}`") for c in names)).alias("row"))
    ledger.scan(inner.select(F.col("row.doc_id").alias("path"), F.col("row.text").alias("text")), rules)
    found = ledger.findings(rules)
    spans = found.groupBy("blob").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("spans"))
    spans = bounded(stored(spans, "spans"))
    rows = inner.withColumn("blob", content_address(F.col("row.text"))).join(spans, "blob", "left")
    text = F.col("row.text")

    def step(acc, x):
        gap = F.substring(text, (acc["at"] + 1).cast("int"), F.greatest(x["start"] - acc["at"], F.lit(0)).cast("int"))
        fresh = x["start"] >= acc["at"]
        return F.struct(
            F.when(fresh, F.concat(acc["out"], gap, F.lit(mask))).otherwise(acc["out"]).alias("out"), F.greatest(acc["at"], x["end"]).alias("at")
        )

    start = F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at"))
    masked = F.aggregate("spans", start, step, lambda acc: F.concat(acc["out"], F.substring(text, (acc["at"] + 1).cast("int"), F.length(text))))
    rows = rows.withColumn("masked", F.when(F.col("spans").isNotNull(), masked).otherwise(text))
    kinds = dict(docs.dtypes)
    own = {"text": F.col("masked"), "n_chars": F.length("masked").cast(kinds.get("n_chars", "long"))}
    return rows.select(*(own.get(c, F.col(f"row.`{c}`")).alias(c) for c in names))


def _oracle() -> str:
    parts = []
    for place, r in enumerate(r for r in RULES):
        p = r.pattern.replace("'", "''")
        parts.append(
            f"SELECT doc_id, {place} AS place, '{r.kind}' AS kind, {r.least} AS least, {str(r.base).lower()} AS base, string_split_regex(t, '{p}') AS pieces, "
            f"regexp_extract_all(t, '{p}') AS m, regexp_extract_all(t, '{p}', {r.group}) AS v FROM d"
        )
    return f"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
        found AS ({" UNION ALL ".join(parts)}),
        numbered AS (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM found WHERE len(m) > 0),
        spans AS (SELECT doc_id, place, kind, base, length(m[i]) AS size,
                  list_sum(list_transform(pieces[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i-1], lambda x: length(x))), 0) AS s
                  FROM numbered WHERE length(v[i]) >= least),
        said AS (SELECT *, kind || ':' || CAST(s AS BIGINT) || ':' || CAST(s + size AS BIGINT) AS x FROM spans),
        by_doc AS (SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
                   coalesce(string_agg(x, ',' ORDER BY s, place) FILTER (base), '') AS own, string_agg(x, ',' ORDER BY s, place) AS spans FROM said GROUP BY doc_id)
        SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
               sha256(coalesce(own, '')) AS base_sha256, coalesce(spans, '') AS spans
        FROM d LEFT JOIN by_doc USING (doc_id)"""


ORACLE = _oracle()
