"""Passages that repeat across documents, exactly or with edits, by collinear chaining of shared k-mer seeds.

Word k-mers are thinned to the minimizers of windows, so that any shared run of k + window - 1 words has a common
seed. Occurrences of a seed are matched with its first one (of the smallest document), not with each other: a passage
that many documents share costs one match for each. As neighbouring seeds may have different first documents, runs of
a passage's length that no row tells of are then matched with the first document that has the run itself. Edited
passages may be like a later document's alone, so places that those rows don't join are at last matched with each other,
by pairs of neighbouring seeds. Matches of two documents are chained in order, with gap costs, through a Fenwick tree of
best chain ends; chains are then aligned on the words themselves, within gaps and outwards.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import bounded, discard, map_arrow, steps, stored
from .graph import connected_components
from .jaccard_join import windows
from .words import hashed_words, mix


@dataclass(frozen=True)
class Passages:
    """What counts as a repeated passage.

    k, window: words of a seed, and k-mers of which one is a seed at least. least: words of a passage. identity: the
    share of its words that the alignment matches. gap: what a skipped word costs a chain, in matched words. span: words
    from the first to the last seed of a chain that is aligned; exact passages have more.
    """

    k: int = 6
    window: int = 8
    least: int = 50
    identity: float = 0.8
    gap: float = 0.1
    span: int = 12

    @property
    def margin(self) -> int:
        """How far from its outer seeds a passage may reach beyond, edits included."""
        return 2 * (self.k + self.window)

    @property
    def least_spread(self) -> int:
        """From the first to the last seed that lie in any run of `least` words, at least, whatever stands around it."""
        return max(0, self.least - self.k + 2 - 2 * self.window)

    @property
    def pair_span(self) -> tuple[int, int]:
        """Words, at least and at most, between the starts of two seeds of any chain that is aligned: its first seed and
        the first that makes it `span` words long, as fewer words pay for no wider gap."""
        return max(1, self.span - self.k), int(self.span / self.gap) + self.span


def minimizers(h: np.ndarray, window: int) -> np.ndarray:
    """Places of values that are the least in some window; fewer values than a window are one window."""
    n = len(h)
    if n == 0:
        return np.zeros(0, np.int64)
    w = min(window, n)

    def sliding(a: np.ndarray, best) -> np.ndarray:
        """best over w neighbours, by doubling."""
        size = 1
        while 2 * size <= w:
            a = best(a[:-size], a[size:])
            size *= 2
        rest = w - size
        return best(a[: len(a) - rest], a[rest:]) if rest else a

    least = sliding(h, np.minimum)
    edge = np.zeros(w - 1, h.dtype)
    return np.flatnonzero(sliding(np.concatenate([edge, least, edge]), np.maximum) == h)


class BestBelow:
    """Fenwick tree of the best value, with whose it is, over places up to a given one."""

    def __init__(self, n: int):
        self.best = [(-1e18, -1)] * (n + 1)

    def put(self, place: int, value: tuple[float, int]) -> None:
        i = place + 1
        while i < len(self.best):
            if value > self.best[i]:
                self.best[i] = value
            i += i & -i

    def up_to(self, place: int) -> tuple[float, int]:
        found, i = (-1e18, -1), place + 1
        while i > 0:
            if self.best[i] > found:
                found = self.best[i]
            i -= i & -i
        return found


def anchors_of(x: np.ndarray, y: np.ndarray, k: int, window: int) -> np.ndarray:
    """Matches (x[i], y[i]) of k-mers as rows x0, x1, y0, y1: neighbours on one diagonal, at most a window apart, joined."""
    order = np.lexsort((x, x - y))
    x, y = x[order], y[order]
    fresh = np.r_[True, (np.diff(x - y) != 0) | (np.diff(x) > window)]
    first, last = np.flatnonzero(fresh), np.r_[np.flatnonzero(fresh)[1:], len(x)] - 1
    return np.stack([x[first], x[last] + k, y[first], y[last] + k], axis=1)


def chains(anchors: np.ndarray, gap: float) -> list[list[tuple[int, int, int, int]]]:
    """Disjoint chains of anchors, the best first: each in order in both texts, by words matched less gap costs."""
    a = [tuple(map(int, r)) for r in anchors[np.lexsort((anchors[:, 2], anchors[:, 0]))]]
    if len(a) == 1:
        return [a]
    ends = sorted({r[3] for r in a})
    tree = BestBelow(len(ends))
    score, before = [0.0] * len(a), [-1] * len(a)
    by_end, done = sorted(range(len(a)), key=lambda i: a[i][1]), 0
    for i, (x0, x1, y0, _) in enumerate(a):
        while done < len(a) and a[by_end[done]][1] <= x0:
            j = by_end[done]
            tree.put(bisect_right(ends, a[j][3]) - 1, (score[j] + gap * (a[j][1] + a[j][3]), j))
            done += 1
        best, j = tree.up_to(bisect_right(ends, y0) - 1)
        gain = best - gap * (x0 + y0)
        score[i] = x1 - x0 + max(0.0, gain)
        before[i] = j if gain > 0 else -1
    out, used = [], [False] * len(a)
    for i in sorted(range(len(a)), key=lambda i: (-score[i], i)):
        own = []
        while i >= 0 and not used[i]:
            used[i] = True
            own.append(a[i])
            i = before[i]
        if own:
            out.append(own[::-1])
    return out


def common(a: list, b: list) -> int:
    """Length of the longest common subsequence, a row of its table in one integer: the bits of b's places that gain none."""
    if not a or not b:
        return 0
    places: dict[int, int] = {}
    for j, y in enumerate(b):
        places[y] = places.get(y, 0) | 1 << j
    full = row = (1 << len(b)) - 1
    for x in a:
        gained = row & places.get(x, 0)
        row = ((row + gained) | (row - gained)) & full
    return len(b) - row.bit_count()


def reach(a: list, b: list, drop: int = 8) -> tuple[int, int, int]:
    """How far two sequences go together from their start: words of a, of b, and matches.

    A match earns one, a substitution or a skipped word costs two; it ends where the best score isn't reached again
    within `drop`. Of a skip, the side is taken on which the next two words agree.
    """
    i = j = score = best = matched = 0
    out = (0, 0, 0)
    while i < len(a) and j < len(b) and score > best - drop:
        if a[i] == b[j]:
            i, j, score, matched = i + 1, j + 1, score + 1, matched + 1
        elif a[i + 1 : i + 3] == b[j : j + 2] and len(b) - j > 1:
            i, score = i + 1, score - 2
        elif a[i : i + 2] == b[j + 1 : j + 3] and len(a) - i > 1:
            j, score = j + 1, score - 2
        else:
            i, j, score = i + 1, j + 1, score - 2
        if score > best:
            best, out = score, (i, j, matched)
    return out


def reaches(words: np.ndarray, a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, step: int, drop: int = 8) -> np.ndarray:
    """reach() of many pairs: of the n_a and n_b words from the places a and b on, backwards if step is -1.

    Rows: words of a, of b, matches, and how far it looked.
    """
    low, high, first = 0, len(words) - 1, np.arange(12)
    take = lambda at, i: words[np.clip(at + step * i, low, high)]
    equal = (take(a[:, None], first) == take(b[:, None], first)) & (first < np.minimum(n_a, n_b)[:, None])
    run = np.where(equal.all(axis=1), len(first), np.argmin(equal, axis=1))
    out = np.stack([run, run, run, run])
    live = np.flatnonzero((run < n_a) & (run < n_b))
    i, j, score, matched, best = (run[live] for _ in range(5))
    a, b, n_a, n_b = a[live], b[live], n_a[live], n_b[live]
    while len(live):
        a0, b0 = take(a, i), take(b, j)
        same = a0 == b0
        i, j, score, matched = i + same, j + same, score + same, matched + same
        odd = np.flatnonzero(~same)
        if len(odd):
            x, y, left_a, left_b = i[odd], j[odd], n_a[odd] - i[odd], n_b[odd] - j[odd]
            a1, b1 = take(a[odd], x + 1), take(b[odd], y + 1)
            skip_a = (a1 == b0[odd]) & (take(a[odd], x + 2) == b1) & (left_b > 1) & (left_a > 2)
            skip_b = ~skip_a & (a0[odd] == b1) & (a1 == take(b[odd], y + 2)) & (left_a > 1) & (left_b > 2)
            i[odd], j[odd] = x + ~skip_b, y + ~skip_a
            score[odd] -= 2
        better = score > best
        best = np.maximum(score, best)
        at = live[better]
        out[0, at], out[1, at], out[2, at] = i[better], j[better], matched[better]
        on = (i < n_a) & (j < n_b) & (score > best - drop)
        if not on.all():
            out[3, live[~on]] = np.maximum(i, j)[~on]
            a, b, n_a, n_b, i, j, score, matched, best, live = (c[on] for c in (a, b, n_a, n_b, i, j, score, matched, best, live))
    return out


def align(chain: list[tuple[int, int, int, int]], a: list, b: list, at_a: int, at_b: int) -> tuple[int, int, int, int, int]:
    """x0, x1, y0, y1 and matched words of a chain, on words a and b that start at at_a and at_b."""
    x0, y0, x1, y1 = chain[0][0], chain[0][2], chain[0][0], chain[0][2]
    matched = 0
    for ax0, ax1, ay0, ay1 in chain:
        matched += common(a[x1 - at_a : ax0 - at_a], b[y1 - at_b : ay0 - at_b]) + ax1 - ax0
        x1, y1 = ax1, ay1
    back = reach(a[: x0 - at_a][::-1], b[: y0 - at_b][::-1])
    on = reach(a[x1 - at_a :], b[y1 - at_b :])
    return x0 - back[0], x1 + on[0], y0 - back[1], y1 + on[1], matched + back[2] + on[2]


def passages_of(chain: list[tuple[int, int, int, int]], a: list, b: list, at_a: int, at_b: int, p: Passages) -> list[tuple[int, int, int, int, int]]:
    """Alignments of a chain that are long and like enough; a chain that is too unlike is parted at its widest gap."""
    x0, x1, y0, y1, m = found = align(chain, a, b, at_a, at_b)
    if x1 - x0 >= p.least and m >= p.identity * max(x1 - x0, y1 - y0):
        return [found]
    if len(chain) > 1:
        i = max(range(1, len(chain)), key=lambda i: chain[i][0] - chain[i - 1][1] + chain[i][2] - chain[i - 1][3])
        return passages_of(chain[:i], a, b, at_a, at_b, p) + passages_of(chain[i:], a, b, at_a, at_b, p)
    x0, x1, y0, y1 = chain[0]
    return [(x0, x1, y0, y1, x1 - x0)] if x1 - x0 >= p.least else []


def seeds(rows: DataFrame, p: Passages) -> DataFrame:
    """seed, doc, at = [h, pos] of rows(doc, h, text); texts of fewer words than a passage have none."""
    kind = rows.schema["doc"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in steps(batches, 256):
            h, found, places = b.column(1).to_pylist(), [], []
            for words in hashed_words(b.column(2)):
                mers = windows(words, p.k) if len(words) >= p.least else np.zeros(0, np.uint64)
                at = minimizers(mers, p.window)
                found.append(mers[at])
                places.append(at)
            counts = [len(x) for x in found]
            total = sum(counts)
            if not total:
                continue
            docs = b.column(0).take(pa.array(np.repeat(np.arange(b.num_rows), counts)))
            pairs = np.empty(2 * total, np.int64)
            pairs[::2], pairs[1::2] = np.repeat(np.array(h, np.int64), counts), np.concatenate(places)
            at = pa.ListArray.from_arrays(pa.array(np.arange(0, 2 * total + 1, 2, dtype=np.int32)), pa.array(pairs))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found).view(np.int64)), docs, at], ["seed", "doc", "at"])

    return map_arrow(rows, run, f"seed long, doc {kind}, at array<long>")


#: Texts, about, in which frequent seeds are looked for; one that so many of them have is spread over tasks. The two
#: steer where rows go, never which.
HOT_TEXTS, HOT_SEEN = 5_000, 4


def frequent_seeds(rows: DataFrame, p: Passages) -> DataFrame:
    """seed: seeds of HOT_SEEN or more of about HOT_TEXTS texts, taken by their hashes."""
    share = F.pmod(F.xxhash64("doc", "h"), F.lit(1 << 40)) / F.lit(float(1 << 40))
    sample = seeds(rows.where(share * F.lit(rows.count()) < HOT_TEXTS), p).where("seed is not null")
    texts = sample.select("seed", F.xxhash64("doc", F.get("at", F.lit(0))).alias("text")).distinct()
    return texts.groupBy("seed").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= HOT_SEEN).select("seed")


def parts_of(rows: DataFrame) -> int:
    """Over how many tasks a frequent seed is spread."""
    return max(16, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def matches(rows: DataFrame, frequent: DataFrame, p: Passages) -> tuple[DataFrame, DataFrame]:
    """doc, h, other, oh, x, y, seed: places of seeds in a document and in the first one that has them; and all places of shared seeds.

    Rows of a frequent seed are spread over as many tasks as a shuffle has; their firsts, one for each such part, are
    combined afterwards. The rows of any other seed meet in one task.
    """
    index = seeds(rows, p).where("seed is not null")
    index = index.join(bounded(frequent.withColumn("frequent", F.lit(True))), "seed", "left")
    text = F.xxhash64("doc", F.get("at", F.lit(0)))
    index = index.withColumn("part", F.when(F.col("frequent"), F.pmod(text, F.lit(parts_of(rows))).cast("int")).otherwise(0))
    # One long as the key, which sorts by its digits; rows of a seed need no order, only their least one.
    key = F.when(F.col("frequent"), F.xxhash64("seed", "part")).otherwise(F.col("seed"))
    whole = Window.partitionBy("key")
    found = index.repartition(key).withColumns({"key": key, "text": text}).withColumns({
        "f": F.min(F.struct(F.col("doc").isNull().alias("last"), "doc", "at")).over(whole), "least": F.min("text").over(whole), "most": F.max("text").over(whole),
    })
    several = F.col("least") != F.col("most")
    found = found.where(several | F.col("frequent")).select(
        "seed", F.coalesce("frequent", F.lit(False)).alias("frequent"), "doc", F.get("at", F.lit(0)).alias("h"), F.get("at", F.lit(1)).cast("int").alias("x"),
        F.col("f.doc").alias("other"), F.get("f.at", F.lit(0)).alias("oh"), F.get("f.at", F.lit(1)).cast("int").alias("y"),
    )
    found = stored(found, "shared-seeds")
    firsts = found.where("frequent").groupBy("seed").agg(F.min(F.struct(F.col("other").isNull().alias("last"), "other", "oh", "y")).alias("f"))
    both = found.join(bounded(stored(firsts, "first-of-frequent")), "seed", "left")
    one = lambda c: F.when(F.col("frequent"), F.col(f"f.{c}")).otherwise(F.col(c)).alias(c)
    matched = both.select("doc", "h", one("other"), one("oh"), "x", one("y"), "seed")
    away = ~(F.col("doc").eqNullSafe(F.col("other")) & (F.col("h") == F.col("oh")))
    return matched.where(away), found


def grouped_rows(b: pa.RecordBatch, keys: int) -> Iterator[tuple[tuple, int, int]]:
    """Runs of rows that agree in the first `keys` columns: those values, and the run's start and end."""
    n = b.num_rows
    if not n:
        return
    fresh = np.zeros(n, bool)
    fresh[0] = True
    for c in b.columns[:keys]:
        differ = pc.fill_null(pc.not_equal(c[1:], c[:-1]), False).to_numpy(zero_copy_only=False)
        null = c.is_null().to_numpy(zero_copy_only=False)
        fresh[1:] |= differ | (null[1:] != null[:-1])
    starts = np.flatnonzero(fresh)
    at = pa.array(starts)
    values = zip(*(c.take(at).to_pylist() for c in b.columns[:keys]), strict=True)
    yield from zip(values, starts.tolist(), [*starts[1:].tolist(), n], strict=True)


def spans(found: DataFrame, rows: DataFrame | None, p: Passages) -> DataFrame:
    """doc, h, lo, hi, seeds: stretches of words that may hold runs of `least` words, by found(doc, h, x, seed).

    Runs within one of rows(doc, h, start, end) are left out.
    """
    kind = found.schema["doc"].dataType.simpleString()
    places = found.select("doc", "h", F.col("x").alias("a"), F.lit(-1).alias("b"), "seed")
    if rows is not None:
        places = places.union(rows.select("doc", "h", F.col("start").alias("a"), F.col("end").alias("b"), F.lit(0).cast("long").alias("seed")))
    dealt = places.repartition("doc", "h").sortWithinPartitions("doc", "h", "a")

    def of_text(a: np.ndarray, b: np.ndarray, seed: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
        own = b < 0
        x, seed, covers = a[own], seed[own], list(zip(a[~own].tolist(), (b[~own] - p.least).tolist(), strict=True))
        if not len(x):
            return
        cuts = np.flatnonzero(np.diff(x) > p.window) + 1
        for i, j in zip(np.r_[0, cuts].tolist(), np.r_[cuts, len(x)].tolist(), strict=True):
            if x[j - 1] - x[i] < p.least_spread:
                continue
            at, end = max(0, int(x[i]) - p.window + 1), int(x[j - 1]) + p.k + p.window - 1 - p.least  # where a run may start
            for lo, hi in [*covers, (end + 1, end + 1)]:  # by lo
                if min(lo - 1, end) >= at:
                    stop = min(lo - 1, end) + p.least
                    inner = seed[np.searchsorted(x, at) : np.searchsorted(x, stop - p.k, "right")]
                    if len(inner):
                        yield at, stop, inner
                at = max(at, hi + 1) if hi >= lo else at

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, parts = None, []

        def flushed(out: list) -> None:
            if parts:
                out += [(*last, *r) for r in of_text(*(np.concatenate(c) for c in zip(*parts, strict=True)))]

        def batch(out: list, schema: pa.Schema) -> pa.RecordBatch:
            columns = [pa.array([r[i] for r in out], t) for i, t in enumerate((schema.field(0).type, pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.int64())))]
            return pa.RecordBatch.from_arrays(columns, ["doc", "h", "lo", "hi", "seeds"])

        schema = None
        for b in batches:
            schema, out = b.schema, []
            columns = [b.column(i).to_numpy() for i in (2, 3, 4)]
            for key, start, end in grouped_rows(b, 2):
                if key != last:
                    flushed(out)
                    last, parts = key, []
                parts.append([c[start:end] for c in columns])
            if out:
                yield batch(out, schema)
        out = []
        flushed(out)
        if out:
            yield batch(out, schema)

    return map_arrow(dealt, run, f"doc {kind}, h long, lo int, hi int, seeds array<long>")


def whole_runs(rows: DataFrame, matched: DataFrame, shared: DataFrame, frequent: DataFrame, told: DataFrame, p: Passages) -> DataFrame:
    """As matches(), of all runs of `least` words that no row of told(doc, h, start, end) holds, by the runs' own first places.

    Runs that hold a frequent seed are spread over tasks as such seeds are. Places of a run that a text repeats, as of
    one word over and over, are matched with the first text's in order.
    """
    kind = rows.schema["doc"].dataType.simpleString()
    untold = stored(spans(matched, told, p), "untold")
    wanted = stored(untold.select(F.explode("seeds").alias("seed")).distinct(), "wanted-seeds")
    held = spans(shared.join(bounded(wanted), "seed").select("doc", "h", "x", "seed"), None, p)
    cut = lambda df, tag: df.select(F.col("doc").alias("d"), F.col("h").alias("x"), F.lit(tag).alias("tag"), "lo", "hi")
    asked = stored(cut(untold, 1).union(cut(held, 0)), "asked-runs")
    # Not more than HOT_TEXTS texts have, hence a bounded array.
    hot = rows.sparkSession.sparkContext.broadcast(np.sort(frequent.toArrow()["seed"].to_numpy().astype(np.int64)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in steps(batches, 256):
            mers, places, often = [np.zeros(0, np.int64)], [np.zeros(0, np.int32)], [np.zeros(0, bool)]
            for words, lo in zip(b.column(4), b.column(3).to_pylist(), strict=True):
                words = words.values.to_numpy().view(np.uint64)
                found = windows(words, p.least) if len(words) >= p.least else np.zeros(0, np.uint64)
                mers.append(found.view(np.int64))
                places.append(np.arange(lo, lo + len(found), dtype=np.int32))
                if len(found) and len(hot.value):
                    short = windows(words, p.k).view(np.int64)
                    so_far = np.r_[0, np.cumsum(hot.value[np.searchsorted(hot.value, short) % len(hot.value)] == short)]
                    often.append(so_far[p.least - p.k + 1 :] > so_far[: len(found)])
                else:
                    often.append(np.zeros(len(found), bool))
            at = pa.array(np.repeat(np.arange(b.num_rows), [len(m) for m in mers[1:]]))
            columns = [pa.array(np.concatenate(c)) for c in (mers, often, places)]
            yield pa.RecordBatch.from_arrays([*columns[:2], b.column(0).take(at), b.column(1).take(at), b.column(2).take(at), columns[2]], ["seed", "frequent", "doc", "h", "tag", "x"])

    long = map_arrow(stretches(rows, asked), run, f"seed long, frequent boolean, doc {kind}, h long, tag int, x int")
    text = F.xxhash64("doc", "h")
    long = long.withColumn("part", F.when(F.col("frequent"), F.pmod(text, F.lit(parts_of(rows))).cast("int")).otherwise(0)).repartition("seed", "part")
    own = Window.partitionBy("seed", "part").orderBy(F.col("doc").isNull(), "doc", "h", "x")
    whole = own.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    in_text = Window.partitionBy("seed", "part", F.col("doc").isNull(), "doc", "h").orderBy("x")
    found = long.withColumns({
        "f": F.first(F.struct("doc", "h")).over(whole), "last": F.last(text).over(whole), "top": F.max("tag").over(whole),
        "rn": F.row_number().over(own), "i": F.dense_rank().over(in_text) - 1,
    })
    same = F.col("doc").eqNullSafe(F.col("f.doc")) & (F.col("h") == F.col("f.h"))
    several = F.col("last") != F.xxhash64("f.doc", "f.h")
    found = found.where(F.col("frequent") | ((F.col("top") == 1) & several)).withColumn("ys", F.sort_array(F.collect_set(F.when(same, F.col("x"))).over(whole)))
    found = found.where(F.when(F.col("frequent"), (F.col("tag") == 1) | (F.col("rn") == 1)).otherwise((F.col("tag") == 1) & ~same))
    found = stored(found.select("seed", "frequent", "doc", "h", "tag", "x", "i", F.col("f.doc").alias("other"), F.col("f.h").alias("oh"), "ys"), "shared-runs")
    firsts = found.where("frequent").groupBy("seed").agg(F.min(F.struct(F.col("other").isNull().alias("last"), "other", "oh", "ys")).alias("f"))
    both = found.where("tag = 1").join(bounded(stored(firsts, "first-of-runs")), "seed", "left")
    one = lambda c: F.when(F.col("frequent"), F.col(f"f.{c}")).otherwise(F.col(c)).alias(c)
    both = both.select("doc", "h", one("other"), one("oh"), "x", "i", one("ys"))
    away = ~(F.col("doc").eqNullSafe(F.col("other")) & (F.col("h") == F.col("oh")))
    return both.where(away).select("doc", "h", "other", "oh", "x", F.get("ys", F.col("i") % F.size("ys")).alias("y")).distinct()


def flat_chains(x: np.ndarray, y: np.ndarray, p: Passages) -> list[list[int]]:
    """x0, x1, y0, y1 of each anchor, of the chains of two texts' matches (x[i], y[i]) that are long enough to be aligned."""
    if int(x.max()) + p.k - int(x.min()) < p.span:
        return []
    own = chains(anchors_of(x.astype(np.int64), y.astype(np.int64), p.k, p.window), p.gap)
    return [[v for anchor in c for v in anchor] for c in own if c[-1][1] - c[0][0] >= p.span]


def chained(found: DataFrame, p: Passages) -> DataFrame:
    """doc, h, other, oh, chain: flat x0, x1, y0, y1 of a chain's anchors. Documents' matches stream by, pair by pair."""
    kind = found.schema["doc"].dataType.simpleString()
    key = ["doc", "h", "other", "oh"]
    dealt = found.select(*key, "x", "y").repartition(*(F.col(c) for c in key)).sortWithinPartitions(*key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, xs, ys = None, [], []
        for b in batches:
            x, y = b.column(4).to_numpy(), b.column(5).to_numpy()
            heads, out = [], []
            for pair, start, end in grouped_rows(b, 4):
                if pair != last:
                    if xs:
                        own = flat_chains(np.concatenate(xs), np.concatenate(ys), p)
                        heads += [last] * len(own)
                        out += own
                    last, xs, ys = pair, [], []
                xs.append(x[start:end])
                ys.append(y[start:end])
            if out:
                yield batch(heads, out, b.schema)
        if xs:
            own = flat_chains(np.concatenate(xs), np.concatenate(ys), p)
            if own:
                yield batch([last] * len(own), own, b.schema)

    def batch(heads, out, schema) -> pa.RecordBatch:
        columns = [pa.array([h[i] for h in heads], schema.field(i).type) for i in range(4)]
        return pa.RecordBatch.from_arrays([*columns, pa.array(out, pa.list_(pa.int32()))], [*key, "chain"])

    return map_arrow(dealt, run, f"doc {kind}, h long, other {kind}, oh long, chain array<int>")


def joined(told: DataFrame) -> DataFrame:
    """doc, h, a, b, label: stretches of texts that rows of told tell of; those that rows join have the same label.

    Rows of one text that overlap are one stretch.
    """
    sides = told.select("doc", "h", F.col("start").alias("a"), F.col("end").alias("b"))
    sides = sides.union(told.select("other", "oh", "other_start", "other_end")).distinct()
    own = Window.partitionBy(F.col("doc").isNull(), "doc", "h").orderBy("a", "b")
    fresh = F.col("a") >= F.coalesce(F.max("b").over(own.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sides = sides.withColumn("lo", F.when(fresh, F.col("a"))).withColumn("lo", F.last("lo", True).over(own))
    sides = stored(sides.withColumn("node", F.xxhash64("doc", "h", "lo")), "told-sides")
    side = lambda d, h, a, b, node: bounded(sides.select(*(F.col(c).alias(n) for c, n in zip(("doc", "h", "a", "b", "node"), (d, h, a, b, node), strict=True))))
    edges = told.join(side("d1", "h1", "a1", "b1", "a"), F.col("doc").eqNullSafe(F.col("d1")) & (F.col("h") == F.col("h1")) & (F.col("start") == F.col("a1")) & (F.col("end") == F.col("b1")))
    edges = edges.select("other", "oh", "other_start", "other_end", "a").distinct().join(
        side("d2", "h2", "a2", "b2", "b"), F.col("other").eqNullSafe(F.col("d2")) & (F.col("oh") == F.col("h2")) & (F.col("other_start") == F.col("a2")) & (F.col("other_end") == F.col("b2"))
    )
    labels = stored(connected_components(edges.select("a", "b")), "labels")
    whole = sides.groupBy("doc", "h", "node").agg(F.min("a").alias("a"), F.max("b").alias("b"))
    # A stretch that rows of one text join with itself alone is in no edge.
    return whole.join(bounded(labels), "node", "left").select("doc", "h", "a", "b", F.coalesce("component", "node").alias("label"))


def labelled(shared: DataFrame, stretches: DataFrame, p: Passages) -> DataFrame:
    """doc, h, x, seed, label of each text, as arrays by place: places of shared(seed, doc, h, x), with the label of the
    stretch that holds the seed, else one that the text alone has.

    Of a stretch that repeats a seed at every few words only its ends are kept: what lies within is a run that rows tell of.
    """
    kind = shared.schema["doc"].dataType.simpleString()
    places = shared.select("doc", "h", F.col("x").alias("a"), F.lit(-1).alias("b"), "seed", F.xxhash64("doc", "h").alias("label"))
    places = places.union(stretches.select("doc", "h", "a", "b", F.lit(0).cast("long"), "label"))
    dealt = places.repartition("doc", "h").sortWithinPartitions("doc", "h", "a")
    lists = (pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int64()))

    def of_text(a: np.ndarray, b: np.ndarray, seed: np.ndarray, label: np.ndarray) -> tuple | None:
        own = b < 0
        x, s, at = a[own], seed[own], label[own]
        if len(x) < 2 or x[-1] - x[0] < p.pair_span[0]:
            return None
        if (~own).any():
            lo, hi, theirs = a[~own], b[~own], label[~own]
            i = np.searchsorted(lo, x, "right") - 1
            at = np.where((i >= 0) & (x + p.k <= hi[i]), theirs[i], at)
        order = np.lexsort((x, s))
        near = np.zeros(len(x) + 1, bool)  # to the place before in that order
        near[1:-1] = (s[order][1:] == s[order][:-1]) & (np.diff(x[order]) <= p.window) & (at[order][1:] == at[order][:-1])
        keep = np.empty(len(x), bool)
        keep[order] = ~(near[:-1] & near[1:])
        return x[keep], s[keep], at[keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, parts = None, []

        def flushed(out: list) -> None:
            found = of_text(*(np.concatenate(c) for c in zip(*parts, strict=True))) if parts else None
            if found:
                out.append((*last, *found))

        def batch(out: list, schema: pa.Schema) -> pa.RecordBatch:
            types = (schema.field(0).type, pa.int64(), *lists)
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(types)], ["doc", "h", "x", "seed", "label"])

        schema = None
        for b in batches:
            schema, out = b.schema, []
            columns = [b.column(i).to_numpy() for i in (2, 3, 4, 5)]
            for key, start, end in grouped_rows(b, 2):
                if key != last:
                    flushed(out)
                    last, parts = key, []
                parts.append([c[start:end] for c in columns])
            if out:
                yield batch(out, schema)
        out = []
        flushed(out)
        if out:
            yield batch(out, schema)

    return map_arrow(dealt, run, f"doc {kind}, h long, x array<int>, seed array<long>, label array<long>")


#: Seeds, about, of which pairs are made at once.
SEEDS_AT_ONCE = 20_000


def seed_pairs(texts: DataFrame, p: Passages) -> DataFrame:
    """pair, doc, h, x, x2, label, label2, fresh: pairs of neighbouring seeds of labelled texts, both of `open`.

    Of a pair that a text repeats amid the same seeds, one in each stretch of a passage's length; it is fresh where the
    seeds around are not those of an earlier place in the text.
    """
    kind = texts.schema["doc"].dataType.simpleString()
    least, most = p.pair_span

    def of_texts(owner: np.ndarray, x: np.ndarray, seed: np.ndarray, label: np.ndarray) -> tuple:
        """Of texts one after the other: which text, pair, x, x2, label, label2, fresh."""
        n, away = len(x), most + 1
        place = x + np.cumsum(np.r_[0, np.where(np.diff(owner) != 0, x[:-1] + away, 0)]) if n else x  # texts apart
        beside = np.searchsorted(place, place + most, "right") - np.arange(n) - 1
        one = np.repeat(np.arange(n), beside)
        two = one + 1 + np.arange(len(one)) - np.repeat(np.r_[0, np.cumsum(beside)[:-1]], beside) if n else one
        apart, around = x[two] - x[one], np.zeros(n, np.uint64)
        far = mix(apart.astype(np.uint64))
        np.add.at(around, one, mix(seed[two].view(np.uint64) + far))
        np.add.at(around, two, mix(seed[one].view(np.uint64) - far))
        kept = apart >= least
        one, two = one[kept], two[kept]
        pair = mix(mix(seed[one].view(np.uint64)) + seed[two].view(np.uint64)).view(np.int64)
        place = mix(mix(pair.view(np.uint64) + around[one]) + around[two])
        order = np.lexsort((x[two], x[one], place, owner[one]))
        pair, one, two, place = pair[order], one[order], two[order], place[order]
        text, block = owner[one], x[one] // p.least
        first = np.r_[True, (place[1:] != place[:-1]) | (text[1:] != text[:-1])][: len(one)]
        kept = first | np.r_[True, block[1:] != block[:-1]][: len(one)]
        return tuple(c[kept] for c in (text, pair, x[one], x[two], label[one], label[two], first))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in steps(batches, 256):
            x, seed, label, wanted = (b.column(c).flatten().to_numpy() for c in range(2, 6))
            sizes, open_ = (pc.list_value_length(b.column(c)).to_numpy() for c in (2, 5))
            owner, open_ = np.repeat(np.arange(b.num_rows), sizes), np.r_[0, np.cumsum(open_)]
            cuts, lo = np.r_[0, np.cumsum(sizes)], 0
            while lo < b.num_rows:
                hi = max(lo + 1, int(np.searchsorted(cuts, cuts[lo] + SEEDS_AT_ONCE, "right")) - 1)
                own = slice(cuts[lo], cuts[hi])
                keep = own.start + np.flatnonzero(np.concatenate([np.isin(seed[cuts[i] : cuts[i + 1]], wanted[open_[i] : open_[i + 1]]) for i in range(lo, hi)]))
                text, *columns = of_texts(owner[keep], x[keep].astype(np.int64), seed[keep], label[keep])
                lo = hi
                if not len(text):
                    continue
                at = pa.array(text)
                pair, x1, x2, *others = columns
                columns = [pa.array(c) for c in (pair, x1.astype(np.int32), x2.astype(np.int32), *others)]
                yield pa.RecordBatch.from_arrays([columns[0], b.column(0).take(at), b.column(1).take(at), *columns[1:]], ["pair", "doc", "h", "x", "x2", "label", "label2", "fresh"])

    return map_arrow(texts, run, f"pair long, doc {kind}, h long, x int, x2 int, label long, label2 long, fresh boolean")


#: Places of a pair of seeds that one task compares with all others of it, and comparisons held at once.
GROUP_PLACES, COMPARED = 1_000, 100_000
#: Bits, a power of two, that tell of a stretch's words; fewer let more stretches seem alike.
WORD_BITS = 1_024


def word_bits(words: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """WORD_BITS bits for each stretch of words: set if a word of the stretch has that bit."""
    out, bits = np.empty((len(starts), WORD_BITS // 8), np.uint8), (words & np.uint32(WORD_BITS - 1)).astype(np.int64)
    for i in range(0, len(starts), 4_096):
        lo, n = starts[i : i + 4_096], (ends - starts)[i : i + 4_096]
        row, seen = np.repeat(np.arange(len(n)), n), np.zeros((len(n), WORD_BITS), bool)
        seen[row, bits[np.arange(len(row)) + np.repeat(lo - np.r_[0, np.cumsum(n)[:-1]], n)]] = True
        out[i : i + 4_096] = np.packbits(seen, axis=1)
    return out.view(np.uint64)


def in_common(held: np.ndarray, dx: np.ndarray, dy: np.ndarray, a: np.ndarray, b: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Words, at most, that stretches a and b have in common: each bit that the other one lacks is of a word of its own."""
    one, two = held[a[of]], held[b[of]]
    alone = lambda x, y: np.bitwise_count(x & ~y).sum(axis=1, dtype=np.int64)
    return np.minimum(dx[of] - alone(one, two), dy[of] - alone(two, one))


def distinct(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The distinct columns of a and b."""
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    fresh = np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])][: len(a)]
    return np.stack([a[fresh], b[fresh]])


def long_enough(pairs: DataFrame, rows: DataFrame, p: Passages) -> DataFrame:
    """t, other: texts (the later one first) of which two places of pairs(pair, doc, h, x, x2, label, label2, fresh, n) may
    be in an aligned passage that is long and like enough; n: places of the pair.

    What align() would make of a chain is found on the words around: of one from the first to the second seed, between
    which as many words count as matched as both texts may have by bits of their words, and of a part of one, which has
    more words beside it, as of either seed alone. Of chains too long for that, two seeds far apart have such words to a
    share that a half of a passage has at least. Most texts that share a short line alone, or two with other words
    between, are told here, before anything is made of their pairs.
    """
    m, far, wide = p.margin, p.pair_span[1] // 2, p.least + 3  # beyond 3 words reach() doesn't look
    place = F.struct("pair", "n", "x", "x2", "label", "label2", "fresh")
    asked = pairs.select(F.col("doc").alias("d"), F.col("h").alias("x"), place.alias("tag"), (F.col("x") - wide).alias("lo"), (F.col("x2") + p.k + wide).alias("hi"))
    ends = stretches(rows, asked, narrow=True)
    pieces = F.ceil(F.col("tag.n") / GROUP_PLACES).cast("int")
    ends = ends.select("doc", "h", "tag.*", "words", F.xxhash64("doc", "h").alias("t"), pieces.alias("pieces"), F.explode(F.sequence(F.lit(0), pieces - 1)).alias("piece"))
    ends = ends.withColumn("mine", F.pmod(F.xxhash64("t", "x"), F.col("pieces")) == F.col("piece"))
    dealt = ends.repartition("pair", "piece").sortWithinPartitions("pair", "piece", F.col("doc").isNull(), "doc", "h", "x")
    dealt = dealt.select("pair", "piece", "t", "x", "x2", "label", "label2", "fresh", "mine", "words")

    def compared(pair, piece, t, x, x2, label, label2, fresh, mine, at, size, words) -> np.ndarray:
        """Pairs of texts of whole groups of rows."""
        rows = np.arange(len(t))
        own = np.r_[True, (pair[1:] != pair[:-1]) | (piece[1:] != piece[:-1])]
        group = np.maximum.accumulate(np.where(own, rows, 0))
        text = np.maximum.accumulate(np.where(own | np.r_[True, t[1:] != t[:-1]], rows, 0))
        one = at + np.minimum(wide, x)  # the first seed's place among all words, and the second's
        two, end = one + x2 - x, at + size
        held = word_bits(words, one, two + p.k)

        def like(dx: np.ndarray, dy: np.ndarray, matched: np.ndarray, back: np.ndarray, on: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """Whether an alignment is long, and like, enough."""
            dx, dy, matched = dx + back[0] + on[0], dy + back[1] + on[1], matched + back[2] + on[2]
            return dx >= p.least, matched >= p.identity * np.maximum(dx, dy)

        def before_(at_a, at_b, from_a, from_b, most):
            return reaches(words, at_a - 1, at_b - 1, np.minimum(at_a - from_a, most), np.minimum(at_b - from_b, most), -1)

        def after(at_a, at_b, to_a, to_b, most):
            return reaches(words, at_a + p.k, at_b + p.k, np.minimum(to_a - at_a - p.k, most), np.minimum(to_b - at_b - p.k, most), 1)

        def possible(a: np.ndarray, b: np.ndarray) -> np.ndarray:
            dx, dy = x2[a] - x[a] + p.k, x2[b] - x[b] + p.k
            least, most = np.minimum(dx, dy), np.maximum(dx, dy)

            def bound(of: np.ndarray) -> None:
                # Anchors count all their words, of which as many as window - k may differ after each k that agree.
                least[of] = np.minimum(least[of], in_common(held, dx, dy, a, b, of) * max(p.k, p.window) // p.k)

            bound(np.flatnonzero(dx >= far))
            good = (dx >= far) & (least >= (2 * p.identity - 1) * most)
            left = np.flatnonzero(~good)
            a, b, dx, dy, least = (c[left] for c in (a, b, dx, dy, least))
            back, on = before_(one[a], one[b], at[a], at[b], wide), after(two[a], two[b], end[a], end[b], wide)
            long, alike = like(dx, dy, least, back, on)
            bound(np.flatnonzero(long & alike))
            long, alike = like(dx, dy, least, back, on)
            good[left] = long & alike
            edge = np.flatnonzero(~(long & alike) & (np.maximum(back[3], on[3]) >= m - 3))  # where fewer words may end otherwise
            c, d = a[edge], b[edge]
            long_, alike_ = like(dx[edge], dy[edge], least[edge], before_(one[c], one[d], at[c], at[d], m), after(two[c], two[d], end[c], end[d], m))
            good[left[edge]] |= long_ & alike_
            apart = np.flatnonzero(~alike)
            a, b, back, on, left = a[apart], b[apart], back[:, apart], on[:, apart], left[apart]
            for before_it, after_it in ((back, after(one[a], one[b], end[a], end[b], wide)), (before_(two[a], two[b], at[a], at[b], wide), on)):
                long, alike = like(p.k, p.k, p.k, before_it, after_it)
                good[left] |= long & alike
            return good

        earlier, before = np.flatnonzero(fresh), np.r_[0, np.cumsum(fresh)]
        counts = np.where(mine, before[text] - before[group], 0)
        ends, found = np.cumsum(counts), []
        for lo in range(0, int(ends[-1]), COMPARED):
            k = np.arange(lo, min(lo + COMPARED, int(ends[-1])))
            a = np.searchsorted(ends, k, "right")
            b = earlier[before[group[a]] + k - (ends[a] - counts[a])]
            open_ = (label[a] != label[b]) & (label2[a] != label2[b])
            a, b = a[open_], b[open_]
            good = possible(a, b)
            found.append(distinct(t[a[good]], t[b[good]]))
        return distinct(*np.concatenate(found, axis=1)) if found else np.zeros((2, 0), np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def out(last: bool) -> Iterator[pa.RecordBatch]:
            """What the whole groups of held rows give; the last group waits for more."""
            nonlocal held, size
            table = pa.Table.from_batches(held).combine_chunks()
            keys = [table[c].to_numpy() for c in ("pair", "piece")]
            cut = len(table) if last else int(np.argmax((keys[0] == keys[0][-1]) & (keys[1] == keys[1][-1])))
            if cut:
                own = table.slice(0, cut)
                words = own["words"].combine_chunks().cast(pa.binary())
                at = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + cut + 1].astype(np.int64)
                flat = np.frombuffer(words.buffers()[2], np.uint32) if words.buffers()[2] else np.zeros(0, np.uint32)
                columns = [own[c].to_numpy() for c in ("pair", "piece", "t", "x", "x2", "label", "label2", "fresh", "mine")]
                found = compared(*columns, at[:-1] // 4, np.diff(at) // 4, flat)
                if found.shape[1]:
                    yield pa.RecordBatch.from_arrays([pa.array(found[0]), pa.array(found[1])], ["t", "other"])
            held = table.slice(cut).to_batches()
            size = len(table) - cut

        due = 5_000
        for b in batches:
            if b.num_rows:
                held.append(b)
                size += b.num_rows
            if size >= due:
                yield from out(False)
                due = 5_000 + 2 * size
        if held:
            yield from out(True)

    return map_arrow(dealt, run, "t long, other long").distinct()


def unjoined(rows: DataFrame, shared: DataFrame, told: DataFrame, p: Passages) -> DataFrame:
    """As chained(), of places that rows of told(doc, h, start, end, other, oh, other_start, other_end) don't join: all
    pairs of texts that have two seeds in common, as far apart as an aligned chain has them, neither of them joined,
    if the words around make a passage possible.

    A passage that many texts share is in stretches of one label, and no pairs are made of it. A chain that has a joined
    place is of texts that rows join there.
    """
    texts = stored(labelled(shared, joined(told), p), "labelled-texts")
    places = texts.select(F.explode(F.arrays_zip("seed", "label")).alias("p")).select("p.*")
    several = places.groupBy("seed").agg(F.min("label").alias("l"), F.max("label").alias("m")).where("l <> m").select("seed")
    several = stored(several, "open-seeds")
    opened = texts.select("doc", "h", F.explode(F.array_distinct("seed")).alias("seed")).join(bounded(several), "seed")
    opened = stored(opened.groupBy("doc", "h").agg(F.collect_list("seed").alias("open")), "open-texts")
    mine = F.col("doc").eqNullSafe(F.col("d")) & (F.col("h") == F.col("dh"))
    texts = texts.join(bounded(opened.withColumnsRenamed({"doc": "d", "h": "dh"})), mine).select("doc", "h", "x", "seed", "label", "open")
    pairs = stored(seed_pairs(texts, p), "seed-pairs")
    ends = [f(c).alias(f"{n}{i}") for i, c in enumerate((F.xxhash64("doc", "h"), F.col("label"), F.col("label2"))) for n, f in (("l", F.min), ("m", F.max))]
    wanted = pairs.groupBy("pair").agg(*ends, F.count(F.lit(1)).alias("n")).where("l0 <> m0 and l1 <> m1 and l2 <> m2").select("pair", "n")
    pairs = stored(pairs.join(bounded(stored(wanted, "open-pairs")), "pair"), "wanted-pairs")
    alike = stored(long_enough(pairs, rows, p), "alike-texts")
    # A row for each text, and so one for each two: places of two texts meet in arrays, not as rows.
    place, t = F.struct("pair", "x", "x2", "label", "label2"), F.xxhash64("doc", "h")
    own = pairs.groupBy("doc", "h").agg(F.collect_list(place).alias("places"), F.collect_list(F.when(F.col("fresh"), place)).alias("fresh")).withColumn("t", t)
    own = stored(own, "places-of-texts")
    theirs = own.select(F.col("t").alias("other"), F.col("doc").alias("o"), F.col("h").alias("oh"), "fresh")
    both = alike.join(own.select("t", "doc", "h", "places"), "t").join(theirs, "other")
    return met(both.select("doc", "h", F.col("o").alias("other"), "oh", "places", "fresh"), p)


def met(both: DataFrame, p: Passages) -> DataFrame:
    """As chained(), of rows that have the places [pair, x, x2, label, label2] of two texts; places of one label don't match."""
    kind = both.schema["doc"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in steps(batches, 64):
            owner, out = [], []
            (pair, x, x2, l1, l2), (their, y, y2, m1, m2) = ([f.to_numpy() for f in b.column(c).flatten().flatten()] for c in (4, 5))
            mine, theirs = (np.r_[0, np.cumsum(pc.list_value_length(b.column(c)).to_numpy())] for c in (4, 5))
            for i in range(b.num_rows):
                at, lo = np.arange(mine[i], mine[i + 1]), theirs[i]
                order = np.argsort(their[lo : theirs[i + 1]], kind="stable") + lo
                first, last = (np.searchsorted(their[order], pair[at], side) for side in ("left", "right"))
                n = last - first
                one, two = np.repeat(at, n), order[np.repeat(first - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())]
                kept = (l1[one] != m1[two]) & (l2[one] != m2[two])
                one, two = one[kept], two[kept]
                if len(one):
                    places = distinct(np.r_[x[one], x2[one]], np.r_[y[two], y2[two]])
                    own = flat_chains(*places, p)
                    owner += [i] * len(own)
                    out += own
            if out:
                at = pa.array(owner)
                yield pa.RecordBatch.from_arrays([*(b.column(c).take(at) for c in range(4)), pa.array(out, pa.list_(pa.int32()))], ["doc", "h", "other", "oh", "chain"])

    return map_arrow(both, run, f"doc {kind}, h long, other {kind}, oh long, chain array<int>")


#: Stretches cut from one copy of a text at most; more are spread over copies.
CUTS = 256


def stretches(rows: DataFrame, wanted: DataFrame, narrow: bool = False) -> DataFrame:
    """wanted(d, x, tag, lo, hi) with `words`, hashes of the words lo to hi (clipped) of the text (d, x), and `lo`.

    If narrow, `words` is one binary value of 32-bit hashes. A text that many chains want is cut by several tasks, each for some of them.
    """
    kind, tag = rows.schema["doc"].dataType.simpleString(), wanted.schema["tag"].dataType.simpleString()
    counts = wanted.groupBy("d", "x").agg(F.count(F.lit(1)).alias("n"))
    copies = counts.select("d", "x", F.ceil(F.col("n") / CUTS).cast("int").alias("copies"))
    copies = stored(copies, "cut-texts")
    c = copies.select(F.col("d").alias("cd"), F.col("x").alias("cx"), "copies")
    same = lambda a, b, q, r: F.col(a).eqNullSafe(F.col(b)) & (F.col(q) == F.col(r))
    texts = rows.join(bounded(c), same("doc", "cd", "h", "cx")).dropDuplicates(["doc", "h"])
    texts = texts.select("doc", "h", "text", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("copy"))
    dealt = wanted.join(c, same("d", "cd", "x", "cx")).withColumn("copy", F.pmod(F.xxhash64("tag", "lo"), F.col("copies")).cast("int"))
    grouped = dealt.groupBy("d", "x", "copy").agg(F.collect_list(F.struct("tag", "lo", "hi")).alias("asked"))
    both = texts.join(grouped.withColumnRenamed("copy", "c2"), same("doc", "d", "h", "x") & (F.col("copy") == F.col("c2"))).select("doc", "h", "text", "asked")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in steps(batches, 16):
            owner, los, out = [], [], []
            asked = b.column(3)
            flat = asked.flatten()
            lo, hi = flat.field(1).to_pylist(), flat.field(2).to_pylist()
            sizes = [len(a) if a is not None else 0 for a in asked]
            k = 0
            for i, words in enumerate(hashed_words(b.column(2))):
                words = words.view(np.int64)
                for _ in range(sizes[i]):
                    start = max(0, lo[k])
                    owner.append(i)
                    los.append(start)
                    out.append(words[start : hi[k]].astype(np.uint32).tobytes() if narrow else words[start : hi[k]])
                    k += 1
            if not out:
                continue
            if narrow:
                words = pa.array(out, pa.binary())
            else:
                offsets = np.r_[0, np.cumsum([len(x) for x in out])].astype(np.int32)
                words = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(out)))
            at = pa.array(owner)
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), flat.field(0), pa.array(los, pa.int32()), words], ["doc", "h", "tag", "lo", "words"])

    return map_arrow(both, run, f"doc {kind}, h long, tag {tag}, lo int, words {'binary' if narrow else 'array<long>'}")


def repeated_passages(docs: DataFrame, p: Passages = Passages(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Passages that a document shares with an earlier one: one row per aligned chain.

    doc_id, start, end, other_id, other_start, other_end (places of words, end exclusive), n_words, n_matched,
    identity. The other document is the first that has the chain's seeds, by id; so of a passage in n documents n - 1
    rows tell, each naming the document it was first seen in. Where two documents' passages are alike and rows don't
    join them so, a row of its own tells. Null, empty and short texts have none; identical rows count once; columns other
    than the id and the text are ignored.
    """
    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).alias("doc"), F.coalesce(F.xxhash64(text), F.lit(0)).alias("h"), text.alias("text"))
    kind = rows.schema["doc"].dataType.simpleString()
    frequent = stored(frequent_seeds(rows, p), "frequent-seeds")
    matched, shared = matches(rows, frequent, p)
    told = stored(aligned(rows, stored(chained(matched, p), "chains"), p), "passages")
    rest = chained(whole_runs(rows, matched, shared, frequent, told, p), replace(p, k=p.least))
    firsts = stored(told.union(aligned(rows, stored(rest, "run-chains"), p)).dropDuplicates(), "first-passages")
    late = aligned(rows, stored(unjoined(rows, shared, firsts, p), "late-chains"), p)
    out = stored(firsts.union(late).drop("oh").dropDuplicates(), "all-passages")
    discard(shared, told, firsts)
    words = F.col("end") - F.col("start")
    return out.select(
        F.col("doc").alias(id_col), "start", "end", F.col("other").alias("other_id"), "other_start", "other_end", words.alias("n_words"), "n_matched",
        (F.col("n_matched") / F.greatest(words, F.col("other_end") - F.col("other_start"))).alias("identity"),
    )


def aligned(rows: DataFrame, found: DataFrame, p: Passages) -> DataFrame:
    """doc, h, other, oh, start, end, other_start, other_end, n_matched: what chains make of long and like enough passages."""
    kind = rows.schema["doc"].dataType.simpleString()
    n, chain, m = F.size("chain"), lambda i: F.get("chain", i), F.lit(p.margin)
    found = found.select(
        "doc", "h", "other", "oh", "chain", (chain(0) - m).alias("xlo"), (chain(n - 3) + m).alias("xhi"), (chain(2) - m).alias("ylo"), (chain(n - 1) + m).alias("yhi")
    )
    mine = F.struct("other", "oh", "ylo", "chain")
    wanted_x = found.select(F.col("doc").alias("d"), F.col("h").alias("x"), mine.alias("tag"), F.col("xlo").alias("lo"), F.col("xhi").alias("hi"))
    theirs = F.struct("doc", "h", "xlo", "chain")
    wanted_y = found.select(F.col("other").alias("d"), F.col("oh").alias("x"), theirs.alias("tag"), F.col("ylo").alias("lo"), F.col("yhi").alias("hi"))
    a = stretches(rows, wanted_x).select("doc", "h", F.col("tag.other").alias("other"), F.col("tag.oh").alias("oh"), F.col("tag.chain").alias("chain"), F.col("lo").alias("alo"), F.col("words").alias("a"))
    b = stretches(rows, wanted_y).select(
        F.col("tag.doc").alias("bdoc"), F.col("tag.h").alias("bh"), F.col("doc").alias("bother"), F.col("h").alias("boh"), F.col("tag.chain").alias("bchain"), F.col("lo").alias("blo"), F.col("words").alias("b")
    )
    key = lambda c: F.xxhash64(c)
    on = (
        F.col("doc").eqNullSafe(F.col("bdoc")) & (F.col("h") == F.col("bh")) & F.col("other").eqNullSafe(F.col("bother")) & (F.col("oh") == F.col("boh"))
        & (key("chain") == key("bchain"))
    )
    both = a.join(b, on).select("doc", "h", "other", "oh", "chain", "alo", "a", "blo", "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, 64):
            owner, out = [], []
            for i, (flat, alo, a, blo, b) in enumerate(zip(*(batch.column(i).to_pylist() for i in range(4, 9)), strict=True)):
                own = passages_of(list(zip(*[iter(flat)] * 4, strict=True)), a, b, alo, blo, p)
                owner += [i] * len(own)
                out += own
            if out:
                at = pa.array(owner)
                columns = [pa.array(c, pa.int32()) for c in zip(*out, strict=True)]
                yield pa.RecordBatch.from_arrays([*(batch.column(i).take(at) for i in range(4)), *columns], ["doc", "h", "other", "oh", "start", "end", "other_start", "other_end", "n_matched"])

    return map_arrow(both, run, f"doc {kind}, h long, other {kind}, oh long, start int, end int, other_start int, other_end int, n_matched int")
