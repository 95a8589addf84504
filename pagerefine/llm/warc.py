"""WARC archives of Zstandard frames with a shared dictionary: writer and validating reader.

An archive starts with a skippable frame that holds the dictionary; then comes one frame per record. A payload seen
before is stored once, as the response of the smallest page id; the others are revisits that refer to it.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import map_arrow, new_path, steps, stored

# Fixed values of the formats.
DICTIONARY_MAGIC = 0x184D2A5D
FRAME_MAGIC = 0xFD2FB528
VERSION = b"WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
END = b"\r\n\r\n"
NEEDED = ("warc-type", "warc-record-id", "warc-date", "content-length", "warc-payload-digest")

#: An archive is closed once it has this many bytes.
ARCHIVE_BYTES = 128 << 20
CHUNK = 1 << 20
#: Bounds of what the dictionary is trained on, and of its size.
SAMPLE_PAGES, SAMPLE_BYTES, DICTIONARY_BYTES = 200, 64 << 10, 48 << 10


class WarcError(ValueError):
    """An archive or record that breaks the format."""


def payload_digest(payload: bytes) -> str:
    """Bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id) -> str:
    """A page's name in records: its id as text, percent-encoded; a null id has another name than an empty one."""
    return "<urn:no-page>" if page_id is None else f"<urn:page:{quote(str(page_id), safe='')}>"


def page_of(name: str) -> str | None:
    """The id in a name that record_id() made, as text."""
    return unquote(name.removeprefix("<urn:page:").removesuffix(">")) if name.startswith("<urn:page:") else None


def record_bytes(page_id, url: str | None, payload: bytes, refers_to=None, revisit: bool = False, date: str = "1970-01-01T00:00:00Z") -> bytes:
    """A response record, or a revisit: the payload's HTTP header without the payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    fields = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", record_id(page_id)),
        ("WARC-Date", date),
        ("WARC-Payload-Digest", f"sha1:{payload_digest(payload)}"),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    if url:
        fields.append(("WARC-Target-URI", url.translate({10: "%0A", 13: "%0D"})))
    if revisit:
        fields += [("WARC-Refers-To", record_id(refers_to)), ("WARC-Profile", PROFILE)]
    head = VERSION + b"\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + b"\r\n"
    return head + block + END


def parse_record(raw: bytes) -> dict:
    """Headers, lengths and digest of one record, checked; raises WarcError."""
    head, found, rest = raw.partition(END)
    lines = head.split(b"\r\n")
    if not found or lines[0] != VERSION:
        raise WarcError("no WARC/1.1 header")
    fields: dict[str, str] = {}
    for line in lines[1:]:
        name, colon, value = line.decode("utf-8").partition(":")
        if not colon or not name.strip():
            raise WarcError(f"bad header line {line[:60]!r}")
        fields[name.strip().lower()] = value.strip()
    if lacking := [n for n in NEEDED if n not in fields]:
        raise WarcError(f"lacks {', '.join(lacking)}")
    if not fields["content-length"].isdigit() or not rest.endswith(END) or int(fields["content-length"]) != len(rest) - len(END):
        raise WarcError(f"Content-Length {fields['content-length']} doesn't fit the block")
    kind, block = fields["warc-type"], rest[: -len(END)]
    http, found, payload = block.partition(END)
    length = next((x.partition(b":")[2].strip() for x in http.split(b"\r\n")[1:] if x.lower().startswith(b"content-length:")), b"")
    if not found or not http.startswith(b"HTTP/") or not length.isdigit():
        raise WarcError("no HTTP header with a length")
    digest = fields["warc-payload-digest"].removeprefix("sha1:")
    if kind == "response":
        if len(payload) != int(length):
            raise WarcError("the payload's length differs from its HTTP header")
        if payload_digest(payload) != digest:
            raise WarcError("the payload's digest differs from its header")
    elif kind == "revisit":
        if payload or "warc-refers-to" not in fields:
            raise WarcError("a revisit has a payload or refers to nothing")
    else:
        raise WarcError(f"unknown type {kind}")
    return {
        "page_id": page_of(fields["warc-record-id"]),
        "url": fields.get("warc-target-uri"),
        "record_type": kind,
        "refers_to": page_of(fields["warc-refers-to"]) if kind == "revisit" else None,
        "payload_bytes": int(length),
        "payload_digest": digest,
        "payload": payload if kind == "response" else None,
    }


def dictionary_frame(dictionary: bytes) -> bytes:
    return struct.pack("<II", DICTIONARY_MAGIC, len(dictionary)) + dictionary


def read_archive(stream) -> Iterator[bytes]:
    """The records of an archive: the dictionary from the leading skippable frame, then one per frame."""
    head = stream.read(8)
    if len(head) < 8:
        raise WarcError("the archive is cut off in its first frame")
    magic, size = struct.unpack("<II", head)
    dictionary = None
    rest = head
    if magic == DICTIONARY_MAGIC:
        raw, rest = stream.read(size), b""
        if len(raw) < size:
            raise WarcError("the archive is cut off in its dictionary")
        if raw[:4] == struct.pack("<I", FRAME_MAGIC):
            raw = zstandard.ZstdDecompressor().decompressobj().decompress(raw)
        dictionary = zstandard.ZstdCompressionDict(raw) if raw else None
    decoder = zstandard.ZstdDecompressor(dict_data=dictionary) if dictionary else zstandard.ZstdDecompressor()
    while rest or (rest := stream.read(CHUNK)):
        frame, out = decoder.decompressobj(), []
        while True:
            try:
                out.append(frame.decompress(rest))
            except zstandard.ZstdError as e:
                raise WarcError(f"bad frame: {e}") from e
            if frame.eof:
                rest = frame.unused_data
                break
            if not (rest := stream.read(CHUNK)):
                raise WarcError("the archive is cut off in a record")
        yield b"".join(out)


def train_dictionary(pages: DataFrame, id_col: str, html_col: str) -> bytes:
    """A dictionary from about SAMPLE_PAGES pages, those with the smallest hashes of their ids, of bounded bytes each.

    It only helps compression; too few or too small samples give none.
    """
    share = SAMPLE_PAGES / max(1, pages.count())
    sample = pages.where(F.pmod(F.xxhash64(id_col), F.lit(1 << 40)) < F.lit(int(share * (1 << 40))))
    sample = sample.select(F.substring(F.col(html_col).cast("string"), 1, SAMPLE_BYTES).alias("html")).where("length(html) > 8")
    rows = [r.html.encode() for r in sample.limit(4 * SAMPLE_PAGES).collect()]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, rows).as_bytes() if len(rows) >= 8 else b""
    except zstandard.ZstdError:
        return b""


def mark_revisits(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_bytes: int = 0) -> DataFrame:
    """page_id, url, payload, revisit, refers_to. Null html is an empty payload.

    Of rows with equal payloads of at least min_bytes bytes, the one with the smallest id is the response, on a
    repeated id the first by url; a null id comes last. Only groups of several rows are joined back, by id, so a
    payload shared by many pages doesn't gather in one task.
    """
    payload = F.coalesce(F.col(html_col).cast("string").cast("binary"), F.lit(b""))
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"))
    # Never null, so that the window and the join share one exchange of payloads.
    key = F.coalesce(F.concat(F.lit("i"), F.col("page_id").cast("string")), F.lit("n"))
    rows = rows.withColumns({"digest": F.sha1("payload"), "key": key})
    keys = rows.select("page_id", "key", "digest", F.octet_length("payload").alias("size"))
    groups = keys.groupBy("digest", "size").agg(F.min("page_id").alias("refers_to"), F.count(F.lit(1)).alias("n"))
    shared = groups.where((F.col("n") > 1) & (F.col("size") >= min_bytes)).select("digest", "refers_to")
    members = keys.join(shared, "digest").select("key", "digest", "refers_to", F.lit(True).alias("shared")).distinct()
    order = Window.partitionBy("key", "digest").orderBy("url")
    joined = rows.withColumn("rn", F.row_number().over(order)).join(members, ["key", "digest"], "left")
    first = F.col("page_id").eqNullSafe(F.col("refers_to")) & (F.col("rn") == 1)
    revisit = F.col("shared").isNotNull() & ~first
    return joined.select("page_id", "url", "payload", revisit.alias("revisit"), F.when(revisit, F.col("refers_to")).alias("refers_to"))


def write_archives(marked: DataFrame, folder: str, dictionary: bytes = b"", date: str = "1970-01-01T00:00:00Z", archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write marked rows as archives below folder; return the stored manifest: path, n_records, n_bytes.

    Each task attempt writes files of its own, and only those in the manifest count, so a repeated or lost attempt
    leaves at most a file that nobody reads.
    """
    frame = dictionary_frame(dictionary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        trained = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        encoder = zstandard.ZstdCompressor(level=3, dict_data=trained) if trained else zstandard.ZstdCompressor(level=3)
        mine = f"part-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}"
        done: list[tuple[str, int, int]] = []
        out, name, records, size = None, "", 0, 0
        for b in steps(batches, 128):
            for page_id, url, payload, revisit, refers_to in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if out is None:
                    name, records, size = f"{mine}-{len(done)}.warc.zst", 0, len(frame)
                    out = store.open_output_stream(f"{root}/{name}", compression=None)
                    out.write(frame)
                packed = encoder.compress(record_bytes(page_id, url, payload, refers_to, revisit, date))
                out.write(packed)
                records, size = records + 1, size + len(packed)
                if size >= archive_bytes:
                    out.close()
                    done.append((f"{folder}/{name}", records, size))
                    out = None
        if out is not None:
            out.close()
            done.append((f"{folder}/{name}", records, size))
        if done:
            paths, counts, sizes = zip(*done, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(paths), pa.array(counts, pa.int64()), pa.array(sizes, pa.int64())], ["path", "n_records", "n_bytes"])

    rows = marked.select("page_id", "url", "payload", "revisit", "refers_to")
    return stored(map_arrow(rows, run, "path string, n_records long, n_bytes long"), "warc-manifest")


def read_archives(manifest: DataFrame, strict: bool = True) -> DataFrame:
    """The records of the archives named in manifest.path, each checked.

    Returns archive, page_id (as text), url, record_type, refers_to, payload_bytes, payload_digest, payload (null for
    revisits) and error. A record that breaks the format fails the job; if strict is off it becomes a row with an
    error, and an archive whose frames can't be read further ends with such a row.
    """
    names = ["page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest", "payload", "error"]
    kinds = [pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary(), pa.string()]

    def records(path: str) -> Iterator[dict]:
        store, at = fs.FileSystem.from_uri(path)
        with store.open_input_stream(at, compression=None) as stream:
            frames = read_archive(stream)
            while True:
                try:
                    raw = next(frames, None)
                    if raw is None:
                        return
                except WarcError as e:
                    if strict:
                        raise
                    yield {"error": str(e)}
                    return
                try:
                    yield parse_record(raw)
                except (WarcError, UnicodeDecodeError) as e:
                    if strict:
                        raise
                    yield {"error": str(e)}

    def batch(path: str, rows: list[dict]) -> pa.RecordBatch:
        columns = [pa.array([r.get(n) for r in rows], k) for n, k in zip(names, kinds, strict=True)]
        return pa.RecordBatch.from_arrays([pa.array([path] * len(rows), pa.string()), *columns], ["archive", *names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path in b.column(0).to_pylist():
                rows: list[dict] = []
                held = 0
                for r in records(path):
                    rows.append(r)
                    held += len(r.get("payload") or b"")
                    if len(rows) >= 512 or held >= 8 << 20:
                        yield batch(path, rows)
                        rows, held = [], 0
                if rows:
                    yield batch(path, rows)

    schema = "archive string, page_id string, url string, record_type string, refers_to string, payload_bytes long, payload_digest string, payload binary, error string"
    files = max(1, manifest.count())
    return map_arrow(manifest.select("path").repartition(min(files, 10_000)), run, schema)


def archive_round_trip(spark: SparkSession, pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Write all pages to archives in the shared folder and read them back: one row per row of pages.

    page_id, payload_bytes, payload_digest, record_type, refers_to. An empty table gives no archive and no rows.
    Ids may be numbers or texts of any characters; rows that repeat an id have records of one name.
    """
    kind = pages.schema["page_id"].dataType
    manifest = write_archives(mark_revisits(pages, min_bytes=min_bytes), new_path(spark, "warc"), train_dictionary(pages, "page_id", "html"))
    read = read_archives(manifest)
    page = lambda c: F.col(c).cast(kind).alias(c)
    return read.select(page("page_id"), "payload_bytes", "payload_digest", "record_type", page("refers_to"))
