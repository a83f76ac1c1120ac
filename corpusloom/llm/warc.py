"""WARC archives in Zstandard: one frame per record, the dictionary in a leading skippable frame.

Writing: payloads are named by SHA-1 before anything is written. Of the records with equal payloads that
with the smallest page_id is a response, the others are revisits that refer to it and hold no payload, so
the table of digests, not the payloads, is grouped; a payload that a third of all pages share is combined
in the map tasks. Each task writes archives of bounded size to the shared store under names of its own
and returns their paths; the manifest of a finished write names only files of successful attempts, so
retries and lost executors leave nothing but files that are never read.

Reading: a task takes whole archives from the manifest, loads the dictionary from the skippable frame
(plain or itself compressed), decodes frame by frame with bounded buffers, and checks that each frame
holds exactly one record, its version line, mandatory headers, Content-Length against the bytes found,
HTTP length against the payload and SHA-1 against the payload. What does not hold raises.

Cases: null html is the empty payload; a null page_id is kept (its record has no page header, it never
is the smallest); rows that repeat a page_id and payload are alike (all response or all revisit); empty
tables give no archive and an empty result; other columns are ignored; null url leaves its header out.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.common import broadcast_if_small, materialise, scratch_path
from corpusloom.session import table

# Fixed values of the formats.
SKIPPABLE = 0x184D2A5D
ZSTD_MAGIC = b"\x28\xb5\x2f\xfd"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: An archive is closed when it holds so many bytes.
ARCHIVE_BYTES = 64 << 20
#: The dictionary is trained on at most so many pages, of which so many characters are used.
DICTIONARY_PAGES, DICTIONARY_CHARS, DICTIONARY_BYTES = 256, 8192, 65_536
_URN = "urn:corpusloom:page:"
MANIFEST_SCHEMA = "path string, records long, bytes long"
RECORD_SCHEMA = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def train_dictionary(pages: DataFrame) -> bytes:
    """A dictionary from a bounded sample of pages, the same at each run; empty if the sample is too small for one."""
    some = pages.where("page_id IS NOT NULL AND length(html) > 0")
    # The ids come first, so that no task sends texts which the sample does not take.
    ids = [r["page_id"] for r in some.select(F.xxhash64("page_id").alias("o"), "page_id").orderBy("o", "page_id").limit(DICTIONARY_PAGES).collect()]
    rows = some.where(F.col("page_id").isin(ids)).groupBy("page_id").agg(F.min(F.substring("html", 1, DICTIONARY_CHARS)).alias("h")).collect()
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, [r["h"].encode() for r in sorted(rows, key=lambda r: r["page_id"])]).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b""


def _line(value: str) -> str:
    return "".join(c if c >= " " and c != "\x7f" else f"%{ord(c):02X}" for c in value)


def encode_record(page_id: int | None, url: str | None, html: bytes, digest: str, n_bytes: int, refers_to: int | None, revisit: bool, date: str) -> bytes:
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % n_bytes
    block = head if revisit else head + html
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <{_URN + str(page_id) if page_id is not None else uuid.uuid4().urn}>", f"WARC-Date: {date}"]
    lines += [f"WARC-Target-URI: {_line(url)}"] if url is not None else []
    lines += [f"WARC-Payload-Digest: sha1:{digest}"]
    lines += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: <{_URN}{refers_to}>"] if revisit else []
    lines += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def file_system(path: str) -> tuple[fs.FileSystem, str]:
    """The store of a qualified path and the path in it; Hadoop's name of S3 is s3a."""
    return fs.FileSystem.from_uri(re.sub(r"^s3[an]://", "s3://", path))


class ArchiveWriter:
    """One archive: the dictionary's frame, then a frame for each record."""

    def __init__(self, path: str, dictionary: bytes, level: int = 3) -> None:
        store, at = file_system(path)
        store.create_dir(at.rpartition("/")[0], recursive=True)
        self.path, self.out, self.records, self.bytes = path, store.open_output_stream(at), 0, 0
        self.packer = zstandard.ZstdCompressor(level=level, dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None, write_checksum=True)
        if dictionary:
            self._put(struct.pack("<II", SKIPPABLE, len(dictionary)) + dictionary)

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.bytes += len(data)

    def add(self, record: bytes) -> None:
        self._put(self.packer.compress(record))
        self.records += 1

    def close(self) -> tuple[str, int, int]:
        self.out.close()
        return self.path, self.records, self.bytes


def frames(path: str, chunk: int = 1 << 16) -> Iterator[bytes]:
    """The decoded frames of an archive, after its dictionary."""
    store, at = file_system(path)
    with store.open_input_stream(at) as f:
        data = f.read(8)
        unpacker = zstandard.ZstdDecompressor()
        if len(data) == 8 and struct.unpack("<I", data[:4])[0] == SKIPPABLE:
            size = struct.unpack("<I", data[4:])[0]
            words = f.read(size)
            if len(words) != size:
                raise ValueError(f"{path}: the dictionary's frame ends early")
            if words[:4] == ZSTD_MAGIC:
                words = unpacker.decompressobj().decompress(words)
            unpacker, data = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(words)), b""
        while data or (data := f.read(chunk)):
            one, parts = unpacker.decompressobj(), []
            while True:
                parts.append(one.decompress(data))
                if one.eof:
                    data = one.unused_data
                    break
                if not (data := f.read(chunk)):
                    raise ValueError(f"{path}: the last frame ends early")
            yield b"".join(parts)


def decode_record(raw: bytes) -> tuple:
    """(page_id, url, payload_bytes, digest, type, refers_to, payload) of a frame; ValueError if it is not one whole record."""
    head, gap, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not gap or lines[0] not in ("WARC/1.0", "WARC/1.1"):
        raise ValueError(f"no record header: {raw[:40]!r}")
    fields = {}
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        if not colon or name.strip().lower() in fields:
            raise ValueError(f"bad or repeated header: {line!r}")
        fields[name.strip().lower()] = value.strip()
    if lacking := {"warc-type", "warc-record-id", "warc-date", "content-length"} - fields.keys():
        raise ValueError(f"missing headers: {sorted(lacking)}")
    length = int(fields["content-length"])
    if len(rest) != length + 4 or rest[length:] != b"\r\n\r\n":
        raise ValueError(f"Content-Length {length}, but {len(rest) - 4} bytes in {fields['warc-record-id']}")
    kind = fields["warc-type"]
    http, gap, payload = rest[:length].partition(b"\r\n\r\n")
    http_fields = dict(x.lower().split(b": ", 1) for x in http.split(b"\r\n")[1:])
    size, digest = int(http_fields[b"content-length"]), fields["warc-payload-digest"].removeprefix("sha1:")
    if not gap or not http.startswith(b"HTTP/"):
        raise ValueError(f"no HTTP header in {fields['warc-record-id']}")
    if kind == "response":
        if size != len(payload) or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
            raise ValueError(f"length or digest of the payload differs in {fields['warc-record-id']}")
    elif kind != "revisit" or payload:
        raise ValueError(f"unexpected {kind} record {fields['warc-record-id']}")
    number = lambda urn: int(urn.strip("<>").removeprefix(_URN)) if urn.startswith(f"<{_URN}") else None
    return number(fields["warc-record-id"]), fields.get("warc-target-uri"), size, digest, kind, number(fields.get("warc-refers-to", "")), payload if kind == "response" else None


def mark_revisits(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """pages with payload digest (hex), n_bytes and refers_to (null for responses)."""
    html = F.encode(F.coalesce(F.col("html"), F.lit("")), "UTF-8")
    named = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", html.alias("payload")).withColumn("sha1", F.sha1("payload")).withColumn("n_bytes", F.octet_length("payload").cast("long"))
    light = named.where(F.col("n_bytes") >= least_bytes).select("page_id", "sha1")
    shared = light.groupBy("sha1").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1 AND first IS NOT NULL").select("sha1", "first")
    shared = materialise(shared, "shared-payloads")
    return named.join(broadcast_if_small(shared), "sha1", "left").withColumn("refers_to", F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first"))).drop("first")


def write_archives(pages: DataFrame, directory: str, least_bytes: int = 0, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Writes all pages as archives in a directory of a shared store; returns the manifest (path, records, bytes)."""
    dictionary = train_dictionary(pages)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done, out = [], None
        for batch in batches:
            for page_id, url, html, sha1, n, refers in zip(*(batch.column(c) for c in ("page_id", "url", "payload", "sha1", "n_bytes", "refers_to")), strict=True):
                out = out or ArchiveWriter(f"{directory}/{uuid.uuid4().hex}.warc.zst", dictionary)
                digest, refers = base64.b32encode(bytes.fromhex(sha1.as_py())).decode(), refers.as_py()
                out.add(encode_record(page_id.as_py(), url.as_py(), html.as_py(), digest, n.as_py(), refers, refers is not None, date))
                if out.bytes >= ARCHIVE_BYTES:
                    done.append(out.close())
                    out = None
        done += [out.close()] if out else []
        cols = list(zip(*done, strict=True)) or [(), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int64(), pa.int64()), strict=True)], ["path", "records", "bytes"])

    return materialise(mark_revisits(pages, least_bytes).mapInArrow(write, MANIFEST_SCHEMA), "manifest")


def read_archives(manifest: DataFrame, payloads: bool = True) -> DataFrame:
    """All records of the archives in a manifest, validated."""
    names = [f.split(" ")[0] for f in RECORD_SCHEMA.split(", ")]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, records in zip(batch.column("path").to_pylist(), batch.column("records").to_pylist(), strict=True):
                rows, held, n = [], 0, 0
                for raw in frames(path):
                    row = decode_record(raw)
                    rows.append(row if payloads else (*row[:-1], None))
                    held, n = held + (len(raw) if payloads else 200), n + 1
                    if held > 8 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)
                        rows, held = [], 0
                if n != records:
                    raise ValueError(f"{path}: {n} records, the manifest says {records}")
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    tasks = manifest.sparkSession.sparkContext.defaultParallelism * 4
    return manifest.repartition(tasks).mapInArrow(read, RECORD_SCHEMA)


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written as archives and read back."""
    manifest = write_archives(table(spark, sf_dir, "pages"), scratch_path(spark, "warc"))
    return read_archives(manifest, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


WARC_SQL = """
WITH h AS (SELECT page_id, coalesce(html, '') AS p FROM pages),
s AS (SELECT page_id, strlen(p)::BIGINT AS payload_bytes, sha1(p) AS x, min(page_id) OVER (PARTITION BY sha1(p)) AS first FROM h)
SELECT page_id, payload_bytes,
  array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(x, (i // 8) * 10 + 1, 10))::BIGINT >> (35 - 5 * (i % 8))) & 31)::INT, 1) FOR i IN range(32)], '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to
FROM s"""
