"""Token counts by rank-synchronous merging over ragged numpy arrays.

Unseen pre-tokens of a batch lie one after another in one array of symbols. Each round looks up the ranks of all
adjacent pairs at once, takes each sequence's lowest rank, and merges all its occurrences in that sequence; a
sequence without a mergeable pair is done, and its surviving symbols are counted. All occurrences may merge at
once as a pair with a new symbol always has a higher rank than the merge that made the symbol, which is checked.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import map_arrow, steps
from .bpe import CACHE_BYTES, CACHE_ENTRIES, PRE_TOKEN, Vocabulary

#: Symbols that one ragged array holds at most.
RAGGED_SYMBOLS = 1 << 20
#: Longer pre-tokens, of which a round would look at all symbols to merge a few, are linked instead.
LONG_PIECE = 512


def merged_counts(pieces: list[bytes], byte_ids: np.ndarray, keys: np.ndarray, ranks: np.ndarray, merged: np.ndarray) -> np.ndarray:
    """Symbols left of each piece. keys: sorted pair keys (left << 32 | right) with their ranks and merged symbols."""
    counts = np.fromiter(map(len, pieces), np.int64, len(pieces))
    out, none = counts.copy(), np.int64(1 << 40)
    symbols = byte_ids[np.frombuffer(b"".join(pieces), np.uint8)]
    owner = np.repeat(np.arange(len(pieces)), counts)
    while len(symbols) > 1:
        key = symbols[:-1] << 32 | symbols[1:]
        at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
        rank = np.where((keys[at] == key) & (owner[:-1] == owner[1:]), ranks[at], none)
        starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
        lowest = np.minimum.reduceat(np.r_[rank, none], starts)
        sizes = np.diff(np.r_[starts, len(symbols)])
        alive = lowest < none
        if not alive.any():
            break
        hit = np.r_[(rank < none) & (rank == np.repeat(lowest, sizes)[:-1]), False]
        # Of overlapping occurrences (a a a), every second one merges, from the left.
        run = np.flatnonzero(hit)
        if len(run):
            first = np.r_[True, np.diff(run) > 1]
            offset = run - np.maximum.accumulate(np.where(first, run, 0))
            run = run[offset % 2 == 0]
        symbols = symbols.copy()
        symbols[run] = merged[at[run]]
        keep = np.repeat(alive, sizes)
        keep[run + 1] = False
        gone = np.bincount(owner[run], minlength=len(pieces))
        out -= gone
        symbols, owner = symbols[keep], owner[keep]
    return out


def merged_count(symbols: list[int], merges: dict[int, tuple[int, int]]) -> int:
    """Symbols left of one long pre-token. The same rounds, each over the places of the lowest rank alone.

    Symbols are linked to their neighbours, and places are listed by the rank of the pair that starts there, so a
    round costs as much as it merges, however long the rest is.
    """
    n = left = len(symbols)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    by_rank: dict[int, list[int]] = {}

    def listed(i: int) -> None:
        if i >= 0 and after[i] < n and (found := merges.get(symbols[i] << 32 | symbols[after[i]])):
            if found[0] not in by_rank:
                heapq.heappush(ranks, found[0])
            by_rank.setdefault(found[0], []).append(i)

    ranks: list[int] = []
    for i in range(n):
        listed(i)
    while ranks:
        rank = heapq.heappop(ranks)
        for i in sorted(by_rank.pop(rank)):
            j = after[i]
            if symbols[i] < 0 or j >= n:
                continue
            found = merges.get(symbols[i] << 32 | symbols[j])
            if found is None or found[0] != rank:  # merged since, or the second of two that overlapped
                continue
            symbols[i], symbols[j] = found[1], -1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            left -= 1
            listed(i)
            listed(before[i])
    return left


class Counter:
    """Counts tokens of texts as a byte-level vocabulary file gives them.

    A file where a pair with a merged symbol ranks before the merge that makes it is an error: rounds need that order.
    """

    def __init__(self, path: str):
        v = self.vocabulary = Vocabulary(path)
        made = {symbol: rank for rank, symbol in v.merges.values()}
        if any(rank <= max(made.get(key >> 32, -1), made.get(key & 0xFFFFFFFF, -1)) for key, (rank, _) in v.merges.items()):
            raise ValueError(f"{path} has a pair that ranks before one of its symbols")
        self.byte_ids = np.array(v.byte_ids, np.int64)
        keys = np.fromiter(v.merges, np.int64, len(v.merges))
        values = np.array(list(v.merges.values()), np.int64).reshape(-1, 2)
        order = np.argsort(keys)
        self.keys, self.ranks, self.merged = keys[order], values[order, 0], values[order, 1]
        self.known: dict[str, int] = {}

    def _learn(self, unseen: list[str]) -> dict[str, int]:
        found, batch, size = {}, [], 0
        for piece in [*unseen, None]:
            raw = b"" if piece is None else piece.encode("utf-8")
            if len(raw) > LONG_PIECE:
                found[piece] = merged_count([self.vocabulary.byte_ids[b] for b in raw], self.vocabulary.merges)
                continue
            if batch and (piece is None or size + len(raw) > RAGGED_SYMBOLS):
                counts = merged_counts([r for _, r in batch], self.byte_ids, self.keys, self.ranks, self.merged).tolist()
                found.update(zip((p for p, _ in batch), counts, strict=True))
                batch, size = [], 0
            batch.append((piece, raw))
            size += len(raw)
        return found

    def count(self, texts: list[str]) -> list[int]:
        """Tokens of each text."""
        pieces: list[list[str]] = []
        specials: list[int] = []
        for text in texts:
            own: list[str] = []
            special = 0
            for part, i in self.vocabulary.parts(text):
                if i is None:
                    own += PRE_TOKEN.findall(part)
                else:
                    special += 1
            pieces.append(own)
            specials.append(special)
        if len(self.known) > CACHE_ENTRIES:
            self.known.clear()
        fresh = self._learn(list(set().union(*pieces) - self.known.keys()))
        self.known.update((p, n) for p, n in fresh.items() if len(p) <= CACHE_BYTES)
        known = self.known if len(fresh) == 0 or all(len(p) <= CACHE_BYTES for p in fresh) else {**self.known, **fresh}
        return [n + sum(map(known.__getitem__, own)) for own, n in zip(pieces, specials, strict=True)]


@lru_cache(maxsize=4)
def counter(path: str) -> Counter:
    return Counter(path)


def token_counts(docs: DataFrame, vocabulary: str, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Count tokens of every text: id_col, n_bytes, n_tokens, over_limit, one row per row of docs.

    Special strings inside texts count as one token each. Null and empty texts have 0 bytes and tokens; repeated
    and null ids of rows stay as they are; other columns are ignored.
    """
    kind = docs.select(id_col).schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(vocabulary)
        for b in steps(batches):
            texts = [t or "" for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(c.count(texts), pa.int64())], ["id", "n_bytes", "n_tokens"])

    text = F.col(text_col).cast("string")
    source = docs.select(F.col(id_col).alias("id"), text.alias("text"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"))
    out = map_arrow(source, run, f"id {kind}, n_bytes long, n_tokens long")
    return out.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
