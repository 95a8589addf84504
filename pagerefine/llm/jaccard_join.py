"""Exact similarity join of word-shingle sets with token-combination prefixes, and its connected groups.

Tokens (shingles) are ordered from rare to frequent: first by how rare their words make them, and after all others
those that copies or common passages make frequent. Two sets that are similar enough share, within prefixes long
enough, a rare token or k tokens of the frequent class; so prefixes are extended, and single rare tokens and
combinations of k = 2 frequent ones are indexed. A pair that shares a signature and could still overlap enough, by
sizes and by the places of the shared token, is verified on the whole sets.

What counts as frequent only steers cost: any order and any class that all sets agree on gives the same pairs.

Groups, not pairs, are wanted: of each signature's sets, one hub is verified with the others first; then only pairs
that lie in different groups yet are. So a group of near copies costs about its size, and no link is lost.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import bounded, discard, map_arrow, steps, stored
from .graph import connected_components
from .words import hashed_words, mix

# Odd multipliers of the hashes of a shingle's words.
_MULTIPLIERS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3)

#: Texts are counted in blocks of about so many words, which bounds a worker's memory.
BLOCK_WORDS = 2 << 20
#: A token is in the frequent class if one block holds it in so many sets, and the blocks' sum is high enough; a
#: word counts if one block holds it so often.
BLOCK_TOKENS, BLOCK_WORD, FREQUENT = 2, 3, 12
#: At most so many frequent tokens and words, those with the highest counts, are told apart; the rest rank as rare.
FREQUENT_TOKENS, COMMON_WORDS = 400_000, 200_000
#: Bits of a set's parity sketch.
SKETCH_BITS = 1024
#: A prefix with more frequent tokens indexes them singly instead of in combinations.
COMBINED = 48


def windows(words: np.ndarray, width: int) -> np.ndarray:
    """Hashes of the windows of `width` words in order; of all words as one where there are fewer, of none if none."""
    n, used = max(1, len(words) - width + 1), min(width, len(words))
    if not used:
        return words
    h = np.full(n, used, np.uint64)
    for i in range(used):
        h += words[i : i + n] * np.uint64(_MULTIPLIERS[i % len(_MULTIPLIERS)] + 2 * (i // len(_MULTIPLIERS)))
    return mix(h)


def distinct(h: np.ndarray) -> np.ndarray:
    h = np.sort(h)
    return h[np.r_[True, h[1:] != h[:-1]]] if len(h) else h


def set_id(tokens: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(tokens.tobytes())


def parity_sketch(tokens: np.ndarray) -> np.ndarray:
    """Bit b tells whether an odd number of tokens falls on b; two sketches differ in as many bits as sets do at most."""
    odd = np.bincount((tokens & np.uint64(SKETCH_BITS - 1)).astype(np.int64), minlength=SKETCH_BITS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


@dataclass(frozen=True)
class Threshold:
    """Similarity of percent / 100, in whole numbers."""

    percent: int

    def overlap(self, a, b):
        """The least overlap of similar sets of a and b tokens: ceil(percent * (a + b) / (100 + percent))."""
        return -((-self.percent * (a + b)) // (100 + self.percent))

    def missing(self, n: int, smaller: bool) -> int:
        """How many of n tokens a similar set may lack: any, or one that isn't smaller."""
        return n - (self.overlap(n, n) if smaller else -((-self.percent * n) // 100))


@dataclass(frozen=True)
class TokenOrder:
    """tokens: the frequent class, sorted, and their ranks from less to more frequent; words: common words, sorted,
    and their weights, which grow with the logarithm of their counts."""

    tokens: np.ndarray
    ranks: np.ndarray
    words: np.ndarray
    weights: np.ndarray

    def set_of(self, words: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Distinct tokens, sorted by value, and the sums of their words' weights."""
        tokens, first = np.unique(windows(words, width), return_index=True)
        weight = np.zeros(len(words), np.int64)
        if len(self.words):
            at = np.minimum(np.searchsorted(self.words, words), len(self.words) - 1)
            weight = np.where(self.words[at] == words, self.weights[at], 0)
        sums = np.r_[0, np.cumsum(weight)]
        used = min(width, len(words))
        return tokens, sums[first + used] - sums[first]

    def sort(self, tokens: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, int]:
        """Tokens in the order, and how many of them are rare."""
        frequent = np.zeros(len(tokens), bool)
        if len(self.tokens):
            at = np.minimum(np.searchsorted(self.tokens, tokens), len(self.tokens) - 1)
            frequent = self.tokens[at] == tokens
        rare = np.flatnonzero(~frequent)
        rare = tokens[rare[np.argsort(weight[rare], kind="stable")]]
        if len(rare) == len(tokens):
            return rare, len(rare)
        ordered = tokens[frequent][np.argsort(self.ranks[at[frequent]], kind="stable")]
        return np.concatenate([rare, ordered]), len(rare)


def prefix_length(rare: int, missing: int) -> int:
    """Tokens of a prefix that shares a signature with every set that lacks at most `missing` of its tokens.

    r rare tokens and f frequent ones need r + max(0, f - 1) > missing.
    """
    return missing + 1 if missing < rare else missing + 2


def signatures(tokens: np.ndarray, weight: np.ndarray, order: TokenOrder, threshold: Threshold) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of one set: signature, place of its first token in the order, role, whether the set may be the smaller one.

    Roles: 0 for singles of the rare class and combinations; for a frequent token on its own, 1 in a set that indexes
    combinations too, and 2 in a set that has more than COMBINED of them, or too few for combinations to suffice, and
    so indexes singles alone. Roles 1 and 1 don't meet, as combinations take their place.
    """
    n = len(tokens)
    ordered, rare = order.sort(tokens, weight)
    probe = prefix_length(rare, threshold.missing(n, False))
    index = prefix_length(rare, threshold.missing(n, True))
    short = probe > n
    probe = min(n, probe)
    singles = min(rare, probe)
    sig, place = [ordered[:singles]], [np.arange(singles)]
    role, small = [np.zeros(singles, np.int8)], [np.arange(singles) < index]
    frequent = ordered[singles:probe]
    if len(frequent):
        at = np.arange(singles, probe)
        own = 2 if short or len(frequent) > COMBINED else 1
        sig.append(mix(frequent))
        place.append(at)
        role.append(np.full(len(frequent), own, np.int8))
        small.append(at < index)
        if own == 1:
            i, j = np.triu_indices(len(frequent), 1)
            sig.append(mix(frequent[i] * np.uint64(_MULTIPLIERS[0]) + frequent[j] * np.uint64(_MULTIPLIERS[1])))
            place.append(at[i])
            role.append(np.zeros(len(i), np.int8))
            small.append(at[j] < index)
    return np.concatenate(sig), np.concatenate(place), np.concatenate(role), np.concatenate(small)


def frequent(parts: list[np.ndarray], least: int) -> tuple[bytes, bytes]:
    """Values that the parts hold at least `least` times together, and their counts, as bytes of 64-bit integers."""
    values = np.sort(np.concatenate(parts)) if parts else np.zeros(0, np.uint64)
    starts = np.flatnonzero(np.r_[True, values[1:] != values[:-1]]) if len(values) else np.zeros(0, np.int64)
    counts = np.diff(np.r_[starts, len(values)])
    keep = counts >= least
    return values[starts[keep]].tobytes(), counts[keep].astype(np.int64).tobytes()


def set_sizes(docs: DataFrame, width: int) -> DataFrame:
    """doc, sid (null for an empty set), n, sketch; on a block's last row also its frequent tokens and words with counts."""
    kind = docs.schema["doc"].dataType.simpleString()
    names = ["doc", "sid", "n", "sketch", "tokens", "token_counts", "words", "word_counts"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        tokens: list[np.ndarray] = []
        words: list[np.ndarray] = []

        def out(ids, sids, sizes, sketches, found=None):
            at_end = [pa.array([found[k] if found and i == len(sids) - 1 else None for i in range(len(sids))], pa.binary()) for k in range(4)]
            width = SKETCH_BITS // 64
            drawn = pa.ListArray.from_arrays(pa.array(np.arange(0, width * len(sids) + 1, width, dtype=np.int32)), pa.array(np.concatenate(sketches)))
            return pa.RecordBatch.from_arrays([ids, pa.array(sids, pa.binary()), pa.array(sizes, pa.int64()), drawn, *at_end], names)

        def counts():
            found = (*frequent(tokens, BLOCK_TOKENS), *frequent(words, BLOCK_WORD))
            for x in (seen, tokens, words):
                x.clear()
            return found

        held, last = 0, None
        for b in steps(batches):
            if last is not None:
                yield out(*last)
            sids, sizes, sketches = [], [], []
            for w in hashed_words(b.column(1)):
                t = distinct(windows(w, width))
                sizes.append(len(t))
                sids.append(set_id(t) if len(t) else None)
                sketches.append(parity_sketch(t))
                if len(t) and sids[-1] not in seen:
                    seen.add(sids[-1])
                    tokens.append(t)
                    words.append(w)
                    held += len(w)
            last = (b.column(0), sids, sizes, sketches)
            if held > BLOCK_WORDS:
                yield out(*last, counts())
                held, last = 0, None
        if last is not None:
            yield out(*last, counts())

    schema = f"doc {kind}, sid binary, n long, sketch array<long>, tokens binary, token_counts binary, words binary, word_counts binary"
    return map_arrow(docs.select("doc", "text"), run, schema)


def most_frequent(blocks: DataFrame, values: str, counts: str, least: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The values of the blocks with the highest sums of counts, sorted by value, and the sums: at most `most`.

    A histogram of sixteenths of powers of two tells from which sum on there are few enough; only those are fetched.
    """

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for v, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                v, c = np.frombuffer(v, np.int64), np.frombuffer(c, np.int64)
                for i in range(0, len(v), 1 << 16):
                    yield pa.RecordBatch.from_arrays([pa.array(v[i : i + (1 << 16)]), pa.array(c[i : i + (1 << 16)])], ["value", "n"])

    rows = map_arrow(blocks.select(values, counts).where(F.col(values).isNotNull()), spread, "value long, n long")
    totals = stored(rows.groupBy("value").agg(F.sum("n").alias("n")).where(F.col("n") >= least), "totals")
    step = F.floor(F.log2("n") * 16)
    so_far, cut = 0, None
    for r in totals.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("step")).collect():
        so_far += r.n
        if so_far > most:
            break
        cut = r.step
    top = totals.where(step >= F.lit(cut)).toArrow() if cut is not None else totals.limit(0).toArrow()
    found = top["value"].to_numpy().astype(np.int64).view(np.uint64)
    order = np.argsort(found)
    return found[order], top["n"].to_numpy()[order]


def token_order(sizes: DataFrame) -> TokenOrder:
    """The order from the blocks' counts; FREQUENT_TOKENS and COMMON_WORDS bound what comes to the driver."""
    tokens, counts = most_frequent(sizes, "tokens", "token_counts", FREQUENT, FREQUENT_TOKENS)
    words, weights = most_frequent(sizes, "words", "word_counts", 1, COMMON_WORDS)
    ranks = np.empty(len(tokens), np.int32)
    ranks[np.lexsort((tokens, counts))] = np.arange(len(tokens), dtype=np.int32)
    return TokenOrder(tokens, ranks, words, np.rint(4 * np.log2(np.maximum(weights, 1))).astype(np.int64))


def id_bytes(sizes: DataFrame) -> int:
    """How many leading bytes of set ids tell all sets apart: 8 or 16."""
    short = sizes.where("sid is not null").groupBy(F.substring("sid", 1, 8).alias("s")).agg(F.min("sid").alias("low"), F.max("sid").alias("high"))
    return 8 if short.where("low <> high").isEmpty() else 16


def signature_rows(docs: DataFrame, width: int, threshold: Threshold, order: TokenOrder, id_size: int) -> DataFrame:
    """sig, space, set of every set; a set that a task meets again is left out there.

    space tells frequent singles from the rest. set is the set's id and four bytes each of n, place and flags (role
    and whether small), packed so that all who read the rows can share one exchange.
    """
    spread = docs.sparkSession.sparkContext.broadcast(order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        row = np.dtype([("sid", f"V{id_size}"), ("n", ">i4"), ("place", ">i4"), ("flags", ">i4")])
        for b in steps(batches, 128):
            own: list[tuple] = []
            for words in hashed_words(b.column(1)):
                tokens, weight = spread.value.set_of(words, width)
                sid = set_id(tokens)[:id_size]
                if not len(tokens) or sid in seen:
                    continue
                seen.add(sid)
                own.append((sid, len(tokens), *signatures(tokens, weight, spread.value, threshold)))
            if not own:
                continue
            counts = [len(x[2]) for x in own]
            sig, place, role, small = (np.concatenate([x[k] for x in own]) for k in range(2, 6))
            packed = np.empty(len(sig), row)
            packed["sid"] = np.repeat(np.array([x[0] for x in own], row["sid"]), counts)
            packed["n"], packed["place"], packed["flags"] = np.repeat([x[1] for x in own], counts), place, role * 2 + small
            sets = pa.Array.from_buffers(pa.binary(packed.itemsize), len(packed), [None, pa.py_buffer(packed)])
            yield pa.RecordBatch.from_arrays([pa.array(sig.view(np.int64)), pa.array(role > 0), sets.cast(pa.binary())], ["sig", "space", "set"])

    return map_arrow(docs.select("doc", "text"), run, "sig long, space boolean, set binary")


def unpacked(rows: DataFrame, id_size: int) -> DataFrame:
    """sig, space, sid, n, place, small, role of packed rows."""
    part = lambda at, size=4: F.substring("set", at, size)
    number = lambda i: F.conv(F.hex(part(id_size + 1 + 4 * i)), 16, 10).cast("int")
    flags = number(2)
    return rows.select("sig", "space", part(1, id_size).alias("sid"), number(0).alias("n"), number(1).alias("place"), (flags % 2 == 1).alias("small"), F.floor(flags / 2).cast("int").alias("role"))


def token_sets(docs: DataFrame, first: DataFrame, pairs: DataFrame, width: int, id_size: int) -> DataFrame:
    """sid, tokens of the sets in pairs(a, b), made from the first document of each: only their texts are moved."""
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("sid")).distinct().join(first, "sid")
    wanted = stored(wanted.select("sid", F.col("doc").alias("first")), "wanted-sets")
    texts = docs.join(bounded(wanted.select("first")), F.col("doc").eqNullSafe(F.col("first")), "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in steps(batches, 128):
            sets = [distinct(windows(w, width)) for w in hashed_words(b.column(0))]
            sets = [s for s in sets if len(s)]
            offsets = np.r_[0, np.cumsum([len(s) for s in sets])].astype(np.int32)
            values = np.concatenate(sets).view(np.int64) if sets else np.zeros(0, np.int64)
            tokens = pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))
            yield pa.RecordBatch.from_arrays([pa.array([set_id(s)[:id_size] for s in sets], pa.binary()), tokens], ["sid", "tokens"])

    sets = map_arrow(texts.select("text"), run, "sid binary, tokens array<long>")
    return stored(sets.join(wanted.select("sid"), "sid", "left_semi").dropDuplicates(["sid"]), "token-sets")


def unlike_left_out(pairs: DataFrame, sketches: DataFrame, threshold: Threshold) -> DataFrame:
    """The pairs (a, b) whose sketches don't differ in more bits than similar sets of their sizes may."""
    left = sketches.select(F.col("sid").alias("a"), F.col("n").alias("n"), F.col("sketch").alias("x"))
    right = sketches.select(F.col("sid").alias("b"), F.col("n").alias("n2"), F.col("sketch").alias("y"))
    both = pairs.join(left, "a").join(right, "b")
    differ = F.aggregate(F.zip_with("x", "y", lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda s, v: s + v)
    return both.where(differ <= F.col("n") + F.col("n2") - 2 * _overlap(threshold)).select("a", "b")


def verified(pairs: DataFrame, sets: DataFrame, threshold: Threshold) -> DataFrame:
    """The pairs (a, b) whose sets are similar enough, by counting their common tokens."""
    left = sets.select(F.col("sid").alias("a"), F.col("tokens").alias("x"))
    right = sets.select(F.col("sid").alias("b"), F.col("tokens").alias("y"))
    both = pairs.join(left, "a").join(right, "b")
    both = both.select("a", "b", (F.size("x") + F.size("y")).alias("total"), F.size(F.array_intersect("x", "y")).alias("common"))
    return both.where(F.lit(100) * F.col("common") >= F.lit(threshold.percent) * (F.col("total") - F.col("common"))).select("a", "b")


def _overlap(threshold: Threshold):
    """The least overlap of similar sets of n and n2 tokens."""
    return F.ceil(F.lit(threshold.percent) * (F.col("n") + F.col("n2")) / F.lit(100 + threshold.percent) - F.lit(1e-9))


def _possible(threshold: Threshold):
    """Whether two rows (n, place, small) and (n2, place2, small2) that share a signature could be similar."""
    t = threshold.percent
    fits = (F.lit(100) * F.least("n", "n2") >= F.lit(t) * F.greatest("n", "n2")) & (F.least(F.col("n") - F.col("place"), F.col("n2") - F.col("place2")) >= _overlap(threshold))
    indexed = ((F.col("n") <= F.col("n2")) & F.col("small")) | ((F.col("n2") <= F.col("n")) & F.col("small2"))
    return fits & indexed & ((F.col("role") != 1) | (F.col("role2") != 1))


def similar_groups(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Groups of documents linked by similar shingle sets: doc_id, n_shingles, component_id, n_links.

    Two documents link when 100 * common >= percent * united tokens. component_id is the smallest id that links lead
    to, the document's own included; n_links counts the verified links between different sets that joined the group
    (links within an established group are not looked for). Rows with null, empty or blank text have an empty set and
    link with nothing, not even with each other: their component is their own id. Rows with a null id take part in
    groups but can't name them, unless a group has no other id. One row per row of docs; other columns are ignored.
    """
    threshold = Threshold(percent)
    rows = docs.select(F.col(id_col).alias("doc"), F.col(text_col).cast("string").alias("text"))
    sizes = stored(set_sizes(rows, width), "set-sizes")
    order = token_order(sizes)
    size = id_bytes(sizes)
    sizes = sizes.withColumn("sid", F.substring("sid", 1, size))
    first = sizes.where("sid is not null").groupBy("sid").agg(F.min("doc").alias("doc"))
    sketches = sizes.where("sid is not null").select("sid", "n", "sketch").dropDuplicates(["sid"])

    # Signatures that several sets share. Frequent singles meet in a space of their own, and only if one has role 2.
    index = signature_rows(rows, width, threshold, order, size)
    index = index.where("sig is not null and space is not null").repartition(F.col("sig"), F.col("space"))
    mark = F.xxhash64(F.substring("set", 1, size))
    double = (F.substring("set", size + 12, 1) >= F.lit(b"\x04")).cast("int")
    shared = index.groupBy("sig", "space").agg(F.min(mark).alias("low"), F.max(mark).alias("high"), F.max(double).alias("top"))
    shared = shared.where("low <> high and (not space or top = 1)").select("sig", "space")
    members = unpacked(index.join(shared, ["sig", "space"]), size)  # a semi join would move below the exchange
    kept = stored(members, "members")
    members = kept.dropDuplicates(["sig", "space", "sid"])

    # Of each, the set whose shared token comes first, hence the least edited one, is the hub.
    columns = ("sid", "n", "place", "small", "role")
    hub = members.groupBy("sig", "space").agg(F.min(F.struct("place", "n", "sid", "small", "role")).alias("hub"))
    hub = hub.select("sig", "space", *(F.col(f"hub.{c}").alias(f"{c}2") for c in columns))
    stars = members.join(hub, ["sig", "space"]).where("sid <> sid2").where(_possible(threshold))
    pairs = stars.select(F.least("sid", "sid2").alias("a"), F.greatest("sid", "sid2").alias("b")).distinct()
    pairs = stored(unlike_left_out(pairs, sketches, threshold), "star-pairs")
    sets = token_sets(rows, first, pairs, width, size)
    links = stored(verified(pairs, sets, threshold), "star-links")
    discard(sets)
    groups = connected_components(links)

    # What is left: pairs that share a signature and lie in different groups.
    label = groups.select(F.col("node").alias("sid"), "component")
    labelled = members.select("sig", "space", *columns).join(label, "sid", "left").withColumn("component", F.coalesce("component", "sid"))
    mark = F.xxhash64("component")
    mixed = labelled.groupBy("sig", "space").agg(F.min(mark).alias("low"), F.max(mark).alias("high")).where("low <> high").select("sig", "space")
    left = stored(labelled.join(mixed, ["sig", "space"], "left_semi"), "open-members")
    # Similar sets differ in size by a factor at most, so they are in one class of sizes or in neighbouring ones.
    classed = left.withColumn("class", F.floor(F.log("n") / F.lit(math.log(100 / percent * 1.001 if percent < 100 else 1.001))))
    other = classed.select("sig", "space", F.explode(F.array(*(F.col("class") + d for d in (-1, 0, 1)))).alias("class"), *(F.col(c).alias(f"{c}2") for c in (*columns, "component")))
    rest = classed.join(other, ["sig", "space", "class"]).where("sid < sid2 and component <> component2").where(_possible(threshold))
    rest = rest.select(F.col("sid").alias("a"), F.col("sid2").alias("b")).distinct().join(pairs, ["a", "b"], "left_anti")
    rest = stored(unlike_left_out(rest, sketches, threshold), "open-pairs")
    sets = token_sets(rows, first, rest, width, size)
    more = stored(verified(rest, sets, threshold), "more-links")
    discard(sets, rest, left, pairs, kept)
    final = groups if more.isEmpty() else connected_components(links.unionByName(more))

    degree = links.unionByName(more).select(F.explode(F.array("a", "b")).alias("sid")).groupBy("sid").agg(F.count(F.lit(1)).alias("n_links"))
    named = first.join(final.select(F.col("node").alias("sid"), "component"), "sid", "left").withColumn("component", F.coalesce("component", "sid"))
    smallest = named.groupBy("component").agg(F.min("doc").alias("component_id"))
    by_set = named.join(smallest, "component").join(degree, "sid", "left").select("sid", "component_id", "n_links")
    out = sizes.select("doc", "sid", "n").join(by_set, "sid", "left")
    return out.select(
        F.col("doc").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("sid").isNull(), F.col("doc")).otherwise(F.col("component_id")).alias("component_id"),
        F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"),
    )


def keep_one_of_each(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs that name their group, all columns as they were: one document of each group stays.

    Rows that repeat an id stay or go together.
    """
    groups = similar_groups(docs, width, percent)
    other = groups.where(~F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("gone"))
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    return rows.join(bounded(stored(other, "copies")), F.col("row.doc_id").eqNullSafe(F.col("gone")), "left_anti").select("row.*")


_WORDS = "regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+')"
#: doc_id, n_shingles, component_id for three-word shingles and a similarity of 0.9, by counting the shingles of all pairs.
ORACLE = f"""
    WITH RECURSIVE d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
    s AS (SELECT DISTINCT doc_id, CASE WHEN len(w) < 3 THEN array_to_string(w, ' ') ELSE w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] END AS g
          FROM (SELECT doc_id, w, unnest(range(1, greatest(1, len(w) - 2) + 1)) AS i FROM d WHERE len(w) > 0)),
    n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
    c AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
    e AS (SELECT x, y FROM c JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * c >= 90 * (p.n + q.n - c)),
    b AS (SELECT x, y FROM e UNION ALL SELECT y, x FROM e),
    r AS (SELECT doc_id, doc_id AS root FROM documents UNION SELECT b.y, r.root FROM r JOIN b ON b.x = r.doc_id WHERE r.root < b.y)
    SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id FROM (SELECT doc_id, min(root) AS component_id FROM r GROUP BY doc_id) LEFT JOIN n USING (doc_id)"""
