"""Quality rules per document and per host, in DataFrame operations alone.

Documents are measured and judged by rules; a host's rate of failing documents is shrunk towards the rate of all
hosts by a beta prior fitted to the hosts' rates. Documents that fail a base rule go. A host whose rate
is very likely above the prior's mean is suspect, and its documents that fail a style rule go as well, which other
hosts' may keep; all documents of a host that mostly fails go with it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import stored

# What separates words, and the symbols that are counted.
SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
#: A host's verdict is bad above this shrunk rate of failing documents.
HOST_RATE = 0.7
#: A host's verdict is suspect if its shrunk rate, the mean of its posterior, lies so many of the posterior's deviations
#: above the prior's mean: its rate is then higher than that with a probability of about 0.84.
DEVIATIONS = 1.0
#: Rates nearer than this count as equal.
NEAR = 1e-9
#: The least and the most characters of a usual text's mean word.
MEAN_WORD = (3, 10)
#: Weight of the prior, in documents, where the hosts' rates don't vary and so give none.
FLAT_WEIGHT = 1.0
#: Parts over which a host's documents are spread when verdicts are joined back.
SALTS = 16


@dataclass(frozen=True)
class BetaPrior:
    a: float
    b: float

    @property
    def mean(self) -> float:
        return self.a / (self.a + self.b)


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """doc_id, host, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of whole texts; null is empty.

    Repeated windows are found by sorting a text's own windows by hash, in time n log n, without a shuffle.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(host_col).cast("string").alias("host"), text.alias("t"))
    lines = F.filter(F.split("t", "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != "")
    rows = rows.select(
        "doc_id",
        "host",
        F.filter(F.split("t", r"[\x20\x09-\x0D]+"), lambda w: w != "").alias("words"),
        (F.length("t") - F.length(F.translate("t", SYMBOLS, ""))).alias("n_symbols"),
        lines.alias("lines"),
    )
    n = F.size("words")
    word_chars = F.length(F.array_join("words", ""))
    at = lambda i: F.get("words", i)
    windows = F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.struct(F.xxhash64(at(i), at(i + 1), at(i + 2)).alias("h"), i.alias("i")))
    rows = rows.select(
        "doc_id", "host", n.alias("n_words"), word_chars.alias("word_chars"), "n_symbols", (F.size("lines") - F.size(F.array_distinct("lines"))).alias("n_dup_lines"),
        F.when(n >= 3, F.sort_array(windows)).alias("windows"),
    )
    hash_at = lambda k: F.get("windows", k)["h"]
    again = F.transform("windows", lambda x, k: F.when((x["h"] == hash_at(k + 1)) | (x["h"] == hash_at(k - 1)), x["i"]))
    rows = rows.withColumn("again", F.sort_array(F.filter(again, lambda i: i.isNotNull())))
    covered = F.transform("again", lambda i, k: F.coalesce(F.least(F.lit(3), F.get("again", k + 1) - i), F.lit(3)))
    repeated = F.coalesce(F.aggregate(covered, F.lit(0), lambda s, x: s + x), F.lit(0))
    counts = [F.col(c).cast("long").alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines")]
    return rows.select("doc_id", "host", *counts, repeated.cast("long").alias("n_repeat_words"))


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def style_failed() -> Column:
    """More than a symbol for every second word, or words that are very short or very long on average."""
    low, high = MEAN_WORD
    n, chars = F.col("n_words"), F.col("word_chars")
    return (2 * F.col("n_symbols") > n) | (chars < low * n) | (chars > high * n)


def host_rates(measured: DataFrame) -> DataFrame:
    """host, n, k: documents and failing ones. Partial sums keep a frequent host from gathering in one task."""
    failed = F.count_if(base_failed() | style_failed())
    return measured.where("host is not null").groupBy("host").agg(F.count(F.lit(1)).alias("n"), failed.alias("k"))


def fit_prior(rates: DataFrame) -> BetaPrior:
    """Beta prior by the moments of the hosts' rates: two numbers come to the driver.

    The weight a + b is at least FLAT_WEIGHT, and FLAT_WEIGHT where rates don't vary; without hosts the mean is 0.
    """
    rate = F.col("k") / F.col("n")
    m, v = rates.agg(F.avg(rate), F.var_pop(rate)).first()
    m, v = m or 0.0, v or 0.0
    weight = max(FLAT_WEIGHT, m * (1 - m) / v - 1) if v > 0 else FLAT_WEIGHT
    return BetaPrior(m * weight, (1 - m) * weight)


def host_verdicts(rates: DataFrame, host_rate: float = HOST_RATE, deviations: float = DEVIATIONS) -> DataFrame:
    """host, host_rate, host_verdict: the shrunk rate, and `bad`, `suspect` or `good`."""
    prior = fit_prior(rates)
    weight, rate = F.col("n") + F.lit(prior.a + prior.b), F.col("host_rate")
    deviation = F.sqrt(rate * (1 - rate) / (weight + 1))
    suspect = rate > F.lit(prior.mean + NEAR) + deviations * deviation
    verdict = F.when(rate > host_rate, "bad").when(suspect, "suspect").otherwise("good")
    rates = rates.withColumn("host_rate", (F.col("k") + F.lit(prior.a)) / weight)
    return rates.select("host", "host_rate", verdict.alias("host_verdict"))


def judge(measured: DataFrame, host_rate: float = HOST_RATE, deviations: float = DEVIATIONS) -> DataFrame:
    """measured with base_failed, style_failed, kept, host_rate, host_verdict.

    kept is false where a base rule fails, where the host is bad, and where a style rule fails and the host is
    suspect. A document without a host has no rate and no verdict against it. Verdicts are replicated over salts and
    joined by host and salt, so that a host with a third of all documents is spread over tasks.
    """
    verdicts = host_verdicts(host_rates(measured), host_rate, deviations)
    verdicts = verdicts.select("*", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    salted = measured.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
    verdict = F.coalesce("host_verdict", F.lit("good"))
    kept = ~(F.col("base_failed") | (verdict == "bad") | ((verdict == "suspect") & F.col("style_failed")))
    judged = salted.join(verdicts, ["host", "salt"], "left").withColumns({"base_failed": base_failed(), "style_failed": style_failed()})
    return judged.withColumn("kept", kept).drop("salt")


def quality_rules(docs: DataFrame, host_rate: float = HOST_RATE, deviations: float = DEVIATIONS) -> DataFrame:
    """One row per row of docs: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept,
    style_failed, host_verdict, host_rate (to four places).

    Measures are stored once, without texts, as both the hosts' rates and the verdicts need them. Null, empty and
    blank texts have zeros and fail. host_verdict and host_rate are null where the host is.
    """
    out = judge(stored(measure(docs), "quality"), host_rate, deviations)
    return out.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        "style_failed", "host_verdict", F.round("host_rate", 4).alias("host_rate"),
    )


ORACLE = f"""
    WITH d AS (SELECT doc_id, source AS host, coalesce(text, '') AS t FROM documents),
    w AS (SELECT *, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS words FROM d),
    win AS (SELECT doc_id, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS g
            FROM (SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS i FROM w WHERE len(words) >= 3)),
    dup AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM win) WHERE c > 1),
    rep AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM dup) GROUP BY doc_id),
    m AS (SELECT w.doc_id, host, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(words, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
                 CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
                 CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words
          FROM (SELECT *, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls FROM w) w LEFT JOIN rep USING (doc_id)),
    f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
                 2 * n_symbols > n_words OR word_chars < {MEAN_WORD[0]} * n_words OR word_chars > {MEAN_WORD[1]} * n_words AS style_failed FROM m),
    rates AS (SELECT host, count(*) AS n, count(*) FILTER (base_failed OR style_failed) AS k FROM f WHERE host IS NOT NULL GROUP BY host),
    mom AS (SELECT coalesce(avg(k / n), 0) AS mu, coalesce(var_pop(k / n), 0) AS v FROM rates),
    prior AS (SELECT mu, CASE WHEN v > 0 THEN greatest({FLAT_WEIGHT}, mu * (1 - mu) / v - 1) ELSE {FLAT_WEIGHT} END AS weight FROM mom),
    shrunk AS (SELECT host, mu, n + weight AS w, (k + mu * weight) / (n + weight) AS r FROM rates, prior),
    verdicts AS (SELECT host, r, CASE WHEN r > {HOST_RATE} THEN 'bad' WHEN r > mu + {NEAR} + {DEVIATIONS} * sqrt(r * (1 - r) / (w + 1)) THEN 'suspect' ELSE 'good' END AS host_verdict FROM shrunk)
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
           NOT (base_failed OR coalesce(host_verdict, 'good') = 'bad' OR (coalesce(host_verdict, 'good') = 'suspect' AND style_failed)) AS kept,
           style_failed, host_verdict, round(r, 4) AS host_rate
    FROM f LEFT JOIN verdicts USING (host)"""
