"""Byte-pair encoding and decoding with a segment tree over adjacent pair ranks.

A pre-token's bytes are the leaves' symbols; leaf i holds the rank of the pair that starts at symbol i. The root
knows the lowest rank, and going down, left first, finds its leftmost place. A merge changes three leaves, each in
logarithmic time, until the root holds no mergeable pair.
"""

from __future__ import annotations

import hashlib
import json
import struct
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import map_arrow, steps

# The byte-level pre-token pattern, with white space as Unicode defines it.
_SPACE = r"\t-\r \x85\xa0  -     　"
PRE_TOKEN = regex.compile(
    rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_SPACE}\p{{L}}\p{{N}}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+"
)
#: Pre-tokens whose ids a worker remembers; beyond it the memory starts anew. Results don't depend on it.
CACHE_ENTRIES = 1 << 20
#: Longer pre-tokens aren't remembered.
CACHE_BYTES = 64
NO_RANK = 1 << 60


def byte_letters() -> dict[str, int]:
    """The printable character that stands for each byte in a byte-level vocabulary, to the byte."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


def unsupported(spec: dict) -> list[str]:
    """What a tokenizer file asks for that isn't done here; truncation, padding and post-processing aren't applied."""
    model, before, after = spec["model"], spec.get("pre_tokenizer") or {}, spec.get("decoder") or {}
    plain = {
        "a model other than BPE": model.get("type", "BPE") != "BPE", "a normalizer": spec.get("normalizer"),
        "pre-tokens that aren't byte-level": before.get("type") != "ByteLevel" or not before.get("use_regex", True),
        "a space put before texts": before.get("add_prefix_space"), "a decoder that isn't byte-level": after.get("type") != "ByteLevel",
    }
    plain |= {k: model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges", "fuse_unk")}
    tokens = spec.get("added_tokens", [])
    plain |= {f"added tokens with {k}": any(t.get(k) for t in tokens) for k in ("single_word", "lstrip", "rstrip")}
    return [k for k, asked in plain.items() if asked]


class Vocabulary:
    """Symbols, pair ranks and special strings of a byte-level tokenizer file; a file that asks for more is an error."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        if found := unsupported(spec):
            raise ValueError(f"{path} asks for {', '.join(found)}")
        letters, ids = byte_letters(), spec["model"]["vocab"]
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        self.byte_ids = [0] * 256
        for letter, byte in letters.items():
            self.byte_ids[byte] = ids[letter]
        #: (left id << 32 | right id) to (rank, id of the merged symbol)
        self.merges = {ids[a] << 32 | ids[b]: (rank, ids[a + b]) for rank, (a, b) in enumerate(pairs)}
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.bytes_of = {i: bytes(letters[c] for c in s) for s, i in ids.items()}
        self.bytes_of |= {i: s.encode() for s, i in self.special.items()}
        longest_first = sorted(self.special, key=len, reverse=True)
        self.special_at = regex.compile("|".join(map(regex.escape, longest_first))) if longest_first else None

    def parts(self, text: str) -> Iterator[tuple[str, int | None]]:
        """Stretches of ordinary text, each with None, and special strings with their ids."""
        start = 0
        for m in self.special_at.finditer(text) if self.special_at else ():
            if m.start() > start:
                yield text[start : m.start()], None
            yield m[0], self.special[m[0]]
            start = m.end()
        if start < len(text):
            yield text[start:], None


class MergeTree:
    """Segment tree whose leaves are ranks of adjacent pairs; each node holds the least rank below it."""

    def __init__(self, ranks: list[int]):
        self.width = 1 << max(0, len(ranks) - 1).bit_length()
        self.least = [NO_RANK] * self.width + ranks + [NO_RANK] * (self.width - len(ranks))
        for i in range(self.width - 1, 0, -1):
            a, b = self.least[2 * i], self.least[2 * i + 1]
            self.least[i] = a if a < b else b

    def leftmost(self) -> int:
        """The leaf of the least rank, the first one on a tie; -1 if no pair can merge."""
        least, i = self.least, 1
        best = least[1]
        if best == NO_RANK:
            return -1
        while i < self.width:
            i *= 2
            if least[i] != best:
                i += 1
        return i - self.width

    def put(self, leaf: int, rank: int) -> None:
        least, i = self.least, leaf + self.width
        least[i] = rank
        while i > 1:
            other = least[i ^ 1]
            if other < rank:
                rank = other
            i >>= 1
            if least[i] == rank:
                return
            least[i] = rank


def merge(symbols: list[int], merges: dict[int, tuple[int, int]]) -> list[int]:
    """The symbols after all merges, always the leftmost pair of the lowest rank next."""
    n = len(symbols)
    if n < 2:
        return symbols
    symbols, none = list(symbols), (NO_RANK, -1)
    tree = MergeTree([merges.get(symbols[i] << 32 | symbols[i + 1], none)[0] for i in range(n - 1)])
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    while (i := tree.leftmost()) >= 0:
        j = after[i]
        symbols[i] = merges[symbols[i] << 32 | symbols[j]][1]
        symbols[j] = -1
        k = after[i] = after[j]
        if j < n - 1:
            tree.put(j, NO_RANK)
        if k < n:
            before[k] = i
            tree.put(i, merges.get(symbols[i] << 32 | symbols[k], none)[0])
        else:
            tree.put(i, NO_RANK)
        if (h := before[i]) >= 0:
            tree.put(h, merges.get(symbols[h] << 32 | symbols[i], none)[0])
    return [s for s in symbols if s >= 0]


class Codec:
    """Text to ids and back."""

    def __init__(self, path: str):
        self.vocabulary = Vocabulary(path)
        self.known: dict[str, bytes] = {}

    def _packed(self, piece: str) -> bytes:
        raw, v = piece.encode("utf-8"), self.vocabulary
        ids = merge([v.byte_ids[b] for b in raw], v.merges)
        packed = struct.pack(f"<{len(ids)}I", *ids)
        if len(raw) <= CACHE_BYTES:
            if len(self.known) >= CACHE_ENTRIES:
                self.known.clear()
            self.known[piece] = packed
        return packed

    def encode_packed(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        out, known = [], self.known.get
        for part, special in self.vocabulary.parts(text):
            if special is not None:
                out.append(struct.pack("<I", special))
                continue
            for piece in PRE_TOKEN.findall(part):
                out.append(known(piece) or self._packed(piece))
        return b"".join(out)

    def encode(self, text: str) -> list[int]:
        packed = self.encode_packed(text)
        return list(struct.unpack(f"<{len(packed) // 4}I", packed))

    def decode_bytes(self, ids) -> bytes:
        return b"".join(map(self.vocabulary.bytes_of.__getitem__, ids))

    def decode(self, ids) -> str:
        """The text of ids; bytes that aren't UTF-8 become U+FFFD."""
        return self.decode_bytes(ids).decode("utf-8", "replace")


@lru_cache(maxsize=4)
def codec(path: str) -> Codec:
    """One codec per worker and vocabulary file."""
    return Codec(path)


def bpe_encode(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode texts: id_col and `ids`, the array of token ids, one row per row of docs.

    Null and empty texts have no ids; null and repeated ids of rows stay as they are; other columns are ignored.
    """
    kind = docs.select(id_col).schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(vocabulary)
        for b in steps(batches):
            ids = [c.encode(t or "") for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.list_(pa.int32()))], ["id", "ids"])

    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return map_arrow(source, run, f"id {kind}, ids array<int>").withColumnRenamed("id", id_col)


def bpe_decode(encoded: DataFrame, vocabulary: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """Decode ids to texts: id_col and `text`. A null array decodes to an empty text, an unknown id fails the job."""
    kind = encoded.select(id_col).schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(vocabulary)
        for b in steps(batches):
            texts = [c.decode(x or ()) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], ["id", "text"])

    source = encoded.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids"))
    return map_arrow(source, run, f"id {kind}, text string").withColumnRenamed("id", id_col)


def bpe_round_trip(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode every text, decode its ids, and return digests of both: id_col, n_tokens, ids_sha256, decoded_sha256.

    Both happen in one pass, so that ids, several times as large as digests, needn't leave the worker.
    Null and empty texts: no tokens and digests of nothing. One row per row of docs, repeated rows included.
    """
    kind = docs.select(id_col).schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(vocabulary)
        names = ["id", "n_tokens", "ids_sha256", "decoded_sha256"]
        for b in steps(batches):
            counts, of_ids, of_texts = [], [], []
            for text in b.column(1).to_pylist():
                packed = c.encode_packed(text or "")
                raw = c.decode_bytes(memoryview(packed).cast("I") if packed else ())
                try:
                    raw.decode("utf-8")
                except UnicodeDecodeError:
                    raw = raw.decode("utf-8", "replace").encode()
                counts.append(len(packed) // 4)
                of_ids.append(hashlib.sha256(packed).hexdigest())
                of_texts.append(hashlib.sha256(raw).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(counts, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_texts, pa.string())], names
            )

    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    schema = f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return map_arrow(source, run, schema).withColumnRenamed("id", id_col)
