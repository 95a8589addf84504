"""Language identification by rank-order profiles of letter n-grams.

A language's profile is the list of its most frequent n-grams of one to three letters, words padded with a blank.
A document's own list is compared with each profile by out-of-place distance: the sum, over the document's n-grams,
of how far the ranks differ, and of the list's length where the profile lacks the n-gram.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import bounded, map_arrow, steps, stored

UNKNOWN = "und"
#: Stands for all that isn't a letter; no letter has this code point.
BLANK = 1


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Code point to itself for letters, else to BLANK."""
    codes = np.arange(0x110000)
    return np.where([chr(c).isalpha() for c in range(0x110000)], codes, BLANK)


def ngrams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams of one to three characters as integers (21 bits a character), and their counts.

    An n-gram has a letter and no blank between others; lower case by Unicode's rules.
    """
    codes = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
    a = np.r_[BLANK, _letters()[codes], BLANK]
    letter = a != BLANK
    two = a[:-1] << 21 | a[1:]
    grams = np.concatenate([
        a[letter],
        two[letter[:-1] | letter[1:]],
        (two[:-1] << 21 | a[2:])[letter[1:-1]],
    ])
    grams.sort()
    starts = np.flatnonzero(np.r_[True, grams[1:] != grams[:-1]]) if len(grams) else np.zeros(0, np.int64)
    return grams[starts], np.diff(np.r_[starts, len(grams)])


def ranked(grams: np.ndarray, counts: np.ndarray, size: int) -> np.ndarray:
    """The `size` most frequent n-grams, ties by the n-gram's value."""
    if len(grams) > size:
        least = np.partition(counts, len(counts) - size)[len(counts) - size]
        keep = counts >= least
        grams, counts = grams[keep], counts[keep]
    return grams[np.argsort(-counts, kind="stable")][:size]


@dataclass(frozen=True)
class Profiles:
    """languages in order of their names; ranks[i, j]: the rank of grams[j] in language i, or size where it lacks it."""

    languages: tuple[str, ...]
    grams: np.ndarray
    ranks: np.ndarray
    size: int

    def predict(self, text: str | None) -> tuple[str, float]:
        """Nearest language, the first by name on a tie, and 1 less the distance over the largest possible one."""
        own = ranked(*ngrams(text), self.size) if text else ()
        if len(own) == 0 or not self.languages:
            return UNKNOWN, 0.0
        at = np.minimum(np.searchsorted(self.grams, own), len(self.grams) - 1)
        ranks = np.where(self.grams[at] == own, self.ranks[:, at], self.size)
        gap = np.where(ranks == self.size, self.size, np.abs(ranks - np.arange(len(own))))
        distance = gap.sum(axis=1)
        best = int(distance.argmin())
        return self.languages[best], float(1 - distance[best] / (len(own) * self.size))


def sample_by_label(labelled: DataFrame, per_label: int) -> DataFrame:
    """About per_label rows of labelled(key, label) for each label: those whose key's hash is small enough for that.

    All rows of a label that has no more. Labels are counted first, in partial sums, so no task sees all rows of one.
    """
    counts = stored(labelled.groupBy("label").agg(F.count(F.lit(1)).alias("n")), "label-counts")
    share = F.pmod(F.xxhash64("key"), F.lit(1 << 40)) / F.lit(float(1 << 40))
    return labelled.join(bounded(counts), "label").where(share * F.col("n") < per_label).select("key", "label")


def fit_profiles(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", size: int = 300, per_language: int = 1000
) -> Profiles:
    """Profiles of all languages named in lang_col, from whole texts of about per_language documents each.

    The documents of a language are those with the smallest hashes of their ids. Rows with a null id, text or
    language are left out; without any row there are no profiles, and predict() says `und`.
    """
    rows = docs.select(F.col(id_col).alias("key"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("label"))
    rows = rows.where("key is not null and text is not null and label is not null")
    chosen = stored(sample_by_label(rows.select("key", "label"), per_language), "language-sample")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in steps(batches, 64):
            by: dict[str, list] = {}
            for label, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                by.setdefault(label, []).append(ngrams(text))
            for label, found in by.items():
                grams, inverse = np.unique(np.concatenate([g for g, _ in found]), return_inverse=True)
                counts = np.bincount(inverse, np.concatenate([n for _, n in found]), len(grams)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([label] * len(grams), pa.string()), pa.array(grams), pa.array(counts)], ["label", "gram", "n"])

    counted = map_arrow(rows.join(bounded(chosen), ["key", "label"], "left_semi").select("label", "text"), count, "label string, gram long, n long")
    totals = counted.groupBy("label", "gram").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("label").orderBy(F.desc("n"), "gram")
    top = totals.withColumn("place", F.row_number().over(order)).where(F.col("place") <= size).select("label", "gram", "place").collect()
    languages = tuple(sorted({r.label for r in top}))
    grams = np.array(sorted({r.gram for r in top}), np.int64)
    ranks = np.full((len(languages), len(grams)), size, np.int64)
    row, column = {x: i for i, x in enumerate(languages)}, {int(x): i for i, x in enumerate(grams)}
    for r in top:
        ranks[row[r.label], column[r.gram]] = r.place - 1
    return Profiles(languages, grams, ranks, size)


def predict_language(docs: DataFrame, profiles: Profiles, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """lang_pred and score of every whole text: id_col, lang_pred, score; one row per row of docs.

    Null texts and texts without a letter get `und` and 0. Neither ids nor other columns take part.
    """
    kind = docs.select(id_col).schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in steps(batches):
            found = [profiles.predict(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([x for x, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())], ["id", "lang_pred", "score"]
            )

    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return map_arrow(source, run, f"id {kind}, lang_pred string, score double").withColumnRenamed("id", id_col)


def held_out(id_column):
    """Whether a document is kept from learning: crc32 of its id as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(id_column.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def identify_languages(docs: DataFrame, size: int = 300, per_language: int = 1000) -> DataFrame:
    """Learn from the documents that aren't held out, and predict all: doc_id, held_out, lang_pred, score."""
    profiles = fit_profiles(docs.where(~held_out(F.col("doc_id"))), size=size, per_language=per_language)
    return predict_language(docs, profiles).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


#: Texts whose score is lower are in none of the learned languages: hardly one of their n-grams is in a profile near its rank.
LEAST_SCORE = 0.1


def keep_identified(
    docs: DataFrame, profiles: Profiles, text_col: str = "text", least_score: float = LEAST_SCORE, languages: tuple[str, ...] | None = None
) -> DataFrame:
    """The rows of docs whose text is in a learned language, all columns as they were.

    Null texts, those without a letter and those that score below least_score go, and those in other languages than
    `languages`, if given. Where no language was learned there is nothing to compare with, and all rows with a letter
    stay.
    """
    at = docs.columns.index(text_col)

    def stays(text: str | None) -> bool:
        if not profiles.languages:
            return bool(text) and len(ngrams(text)[0]) > 0
        found, score = profiles.predict(text)
        return found != UNKNOWN and score >= least_score and (languages is None or found in languages)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in steps(batches):
            yield b.filter(pa.array([stays(t) for t in b.column(at).to_pylist()], pa.bool_()))

    return map_arrow(docs, run, docs.schema)
