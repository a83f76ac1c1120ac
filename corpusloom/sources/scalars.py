"""Scalar event files of training runs as a data source (`scalars`): one partition a file, read and written by Spark.

A file is a row of records: length (8 bytes), masked CRC-32C of the length, data, masked CRC-32C of the data. Data is a
message in wire format: time (field 1), step (2), and summaries (5) with values (1) of tag (1) and number (2). Other
fields, and values without a number, are skipped. A checksum that fails or a record that ends early raises an error.

    spark.dataSource.register(ScalarEvents)
    spark.read.format("scalars").load(path)                             # tag, step, value, wall_time, file
    spark.read.format("scalars").schema("step long, value float")...    # only these are decoded
    df.write.format("scalars").mode("append").save(path)                # a file for each partition
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

SCHEMA = "tag string, step long, value float, wall_time double, file string"
#: The polynomial of CRC-32C (reflected) and the constant of masked checksums.
POLYNOMIAL, MASK = 0x82F63B78, 0xA282EAD8


def _crc_table() -> np.ndarray:
    out = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        out = np.where(out & 1, (out >> 1) ^ np.uint32(POLYNOMIAL), out >> 1).astype(np.uint32)
    return out


_CRC = _crc_table()


def masked_crcs(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Masked CRC-32C of slices of bytes, a byte of all slices at a time."""
    order = np.argsort(-sizes, kind="stable")
    state, at = np.full(len(starts), 0xFFFFFFFF, np.uint32), starts[order]
    longer = len(order) - np.cumsum(np.bincount(sizes, minlength=1)) if len(order) else []
    for j, n in enumerate(longer[:-1] if len(order) else []):
        state[:n] = _CRC[(state[:n] ^ data[at[:n] + j]) & 255] ^ (state[:n] >> np.uint32(8))
    out = np.empty(len(order), np.uint32)
    out[order] = ~state
    return ((out >> np.uint32(15)) | (out << np.uint32(17))) + np.uint32(MASK)


def records(data: bytes, where: str = "") -> list[tuple[int, int]]:
    """(start, size) of the records of a file, with their checksums verified."""
    heads, spans, at = [], [], 0
    while at < len(data):
        if at + 12 > len(data):
            raise ValueError(f"{where}: a record ends early at byte {at}")
        size = int.from_bytes(data[at : at + 8], "little")
        heads.append(at)
        if at + 16 + size > len(data):
            break  # wrong, or the length is: its checksum tells
        spans.append((at + 12, size))
        at += 16 + size
    raw = np.frombuffer(data, np.uint8)
    read = lambda places: np.array([struct.unpack_from("<I", data, p)[0] for p in places], np.uint32)
    bad = np.flatnonzero(masked_crcs(raw, np.array(heads, np.int64), np.full(len(heads), 8)) != read([h + 8 for h in heads]))
    if len(bad):
        raise ValueError(f"{where}: the length at byte {heads[bad[0]]} does not meet its checksum")
    if len(spans) < len(heads):
        raise ValueError(f"{where}: a record ends early at byte {heads[-1]}")
    if spans:
        starts, sizes = (np.array(x, np.int64) for x in zip(*spans, strict=True))
        bad = np.flatnonzero(masked_crcs(raw, starts, sizes) != read((starts + sizes).tolist()))
        if len(bad):
            raise ValueError(f"{where}: the record at byte {starts[bad[0]]} does not meet its checksum")
    return spans


def _varint(data: bytes, at: int) -> tuple[int, int]:
    out = shift = 0
    while True:
        byte = data[at]
        out |= (byte & 127) << shift
        at, shift = at + 1, shift + 7
        if byte < 128:
            return out, at


def fields(data: bytes, at: int, end: int) -> Iterator[tuple[int, int, object, int]]:
    """(field, kind, value, end) of a message; a value of kind 2 is given by its start."""
    while at < end:
        head, at = _varint(data, at)
        field, kind = head >> 3, head & 7
        if kind == 0:
            value, at = _varint(data, at)
        elif kind == 1:
            value, at = struct.unpack_from("<d", data, at)[0], at + 8
        elif kind == 2:
            size, value = _varint(data, at)
            at = value + size
        elif kind == 5:
            value, at = struct.unpack_from("<f", data, at)[0], at + 4
        else:
            raise ValueError(f"wire type {kind}")
        yield field, kind, value, at


def scalars(data: bytes, start: int, size: int, want: frozenset[str]) -> Iterator[dict]:
    """The scalars of one record; only what is wanted is decoded."""
    time, step, found = 0.0, 0, []
    for field, kind, value, end in fields(data, start, start + size):
        if (field, kind) == (1, 1):
            time = value
        elif (field, kind) == (2, 0):
            step = value - (1 << 64) if value >> 63 else value
        elif (field, kind) == (5, 2):
            for f, k, v, e in fields(data, value, end):
                if (f, k) == (1, 2):
                    one: dict = {}
                    for a, b, c, d in fields(data, v, e):
                        if (a, b) == (1, 2) and "tag" in want:
                            one["tag"] = data[c:d].decode()
                        elif (a, b) == (2, 5):
                            one["value"] = c
                    if "value" in one:
                        found.append(one)
    for one in found:
        yield one | {"step": step, "wall_time": time}


def _put(value: int) -> bytes:
    value &= (1 << 64) - 1
    out = bytearray()
    while value > 127:
        out.append(value & 127 | 128)
        value >>= 7
    return bytes(out + bytes([value]))


def event(tag: str, step: int, value: float, time: float) -> bytes:
    name = tag.encode()
    one = b"\x0a" + _put(len(name)) + name + b"\x15" + struct.pack("<f", value)
    summary = b"\x0a" + _put(len(one)) + one
    return b"\x09" + struct.pack("<d", time) + b"\x10" + _put(step) + b"\x2a" + _put(len(summary)) + summary


def framed(messages: list[bytes]) -> bytes:
    """Messages as records with their checksums."""
    if not messages:
        return b""
    heads = [struct.pack("<Q", len(m)) for m in messages]
    sums = []
    for group in (heads, messages):
        sizes = np.array([len(x) for x in group], np.int64)
        sums.append(masked_crcs(np.frombuffer(b"".join(group), np.uint8), np.cumsum(sizes) - sizes, sizes))
    return b"".join(h + struct.pack("<I", int(a)) + m + struct.pack("<I", int(b)) for h, m, a, b in zip(heads, messages, *sums, strict=True))


def _store(path: str):  # noqa: ANN202
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path else "file://" + path)


@dataclass
class File(InputPartition):
    path: str


class ScalarReader(DataSourceReader):
    def __init__(self, schema: StructType, path: str) -> None:
        self.names, self.path = schema.names, path

    def partitions(self) -> list[File]:
        from pyarrow import fs

        store, at = _store(self.path)
        if store.get_file_info(at).type == fs.FileType.File:
            return [File(at)]
        return [File(f.path) for f in store.get_file_info(fs.FileSelector(at, recursive=True)) if f.type == fs.FileType.File and f.base_name[0] not in "._"]

    def read(self, partition: File) -> Iterator[tuple]:
        store, _ = _store(self.path)
        with store.open_input_stream(partition.path) as f:
            data = f.read()
        want = frozenset(self.names)
        for start, size in records(data, partition.path):
            for row in scalars(data, start, size, want):
                row["file"] = partition.path
                yield tuple(row.get(x) for x in self.names)


class ScalarWriter(DataSourceWriter):
    """Each task writes one file under a name of its own, so a task that runs again leaves no half file behind: it is
    moved to its place when it is whole; files of tasks that did not count are removed."""

    def __init__(self, schema: StructType, path: str, overwrite: bool) -> None:
        self.names, self.path = schema.names, path
        if overwrite:
            store, at = _store(path)
            store.create_dir(at, recursive=True)
            store.delete_dir_contents(at)

    def write(self, rows: Iterator) -> WriterCommitMessage:
        store, at = _store(self.path)
        store.create_dir(at, recursive=True)
        name = f"{at}/events.{uuid.uuid4().hex}"
        with store.open_output_stream(f"{at}/_{name.rpartition('/')[2]}") as out:
            held = []
            for row in rows:
                held.append(event(row["tag"] or "", row["step"] or 0, row["value"] if row["value"] is not None else float("nan"), row["wall_time"] or 0.0 if "wall_time" in self.names else 0.0))
                if len(held) == 10_000:
                    out.write(framed(held))
                    held = []
            out.write(framed(held))
        message = WriterCommitMessage()
        message.name = name
        return message

    def commit(self, messages: list) -> None:
        store, at = _store(self.path)
        for m in messages:
            if m is not None:
                store.move(f"{at}/_{m.name.rpartition('/')[2]}", m.name)

    def abort(self, messages: list) -> None:
        store, at = _store(self.path)
        for m in messages:
            if m is not None:
                store.delete_file(f"{at}/_{m.name.rpartition('/')[2]}")


class ScalarEvents(DataSource):
    @classmethod
    def name(cls) -> str:
        return "scalars"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> ScalarReader:
        return ScalarReader(schema, self.options["path"])

    def writer(self, schema: StructType, overwrite: bool) -> ScalarWriter:
        return ScalarWriter(schema, self.options["path"], overwrite)
