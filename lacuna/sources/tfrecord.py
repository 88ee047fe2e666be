"""TFRecord files of examples as a Spark data source, ``format("tfrecord")``.

A record is the length of its data, a checksum of the length, the data, and a checksum of the data. A
large file is read in ranges of ``splitBytes``: a range finds its first record by the checksum of a
length, and reads the records that begin in it. It also makes sure that the record after its last one
begins as a record does, and that nothing between looks like one, so a range that follows can neither
skip a broken record nor take data for one. Every checksum is tested; what fails raises.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

SPLIT_BYTES = 64 << 20
#: Rows of a batch, and bytes of data after which a batch is full.
BATCH_ROWS, BATCH_BYTES = 1_000, 16 << 20
#: Bytes looked through at once for the first record of a range.
WINDOW = 1 << 16
HEAD = 12
# The polynomial of CRC-32C (bits reversed), and the mask of stored checksums.
POLYNOMIAL = 0x82F63B78
MASK = 0xA282EAD8
#: Bytes that a lane of the checksum takes one after the other.
LANE = 64


@cache
def _tables() -> tuple[np.ndarray, list[np.ndarray]]:
    """The checksum of each byte; and, for 1, 2, 4, ... lanes of zeros behind it, what becomes of each of
    the four bytes of a checksum."""
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> np.uint32(1)) ^ np.uint32(POLYNOMIAL), table >> np.uint32(1))
    one = np.stack([np.arange(256, dtype=np.uint32) << np.uint32(8 * k) for k in range(4)])
    for _ in range(LANE):
        one = table[one & np.uint32(0xFF)] ^ (one >> np.uint32(8))
    shifts = [one]
    while len(shifts) < 40:
        shifts.append(_shifted(shifts[-1], shifts[-1]))
    return table, shifts


def _shifted(crc: np.ndarray, shift: np.ndarray) -> np.ndarray:
    out = np.zeros_like(crc)
    for k in range(4):
        out ^= shift[k][crc >> np.uint32(8 * k) & np.uint32(0xFF)]
    return out


def crc32c(data: bytes) -> int:
    """CRC-32C, in lanes that are worked on side by side and then joined two by two."""
    table, shifts = _tables()
    if len(data) < 4:
        short = 0xFFFFFFFF
        for byte in data:
            short = int(table[(short ^ byte) & 0xFF]) ^ short >> 8
        return short ^ 0xFFFFFFFF
    lanes = 1 << max(0, -(-len(data) // LANE) - 1).bit_length()
    raw = np.zeros(lanes * LANE, np.uint8)  # zeros in front change nothing
    raw[-len(data) :] = np.frombuffer(data, np.uint8)
    raw[len(raw) - len(data) :][:4] ^= 0xFF
    columns = np.ascontiguousarray(raw.reshape(lanes, LANE).T)
    crc = np.zeros(lanes, np.uint32)
    for column in columns:
        crc = table[(crc ^ column) & np.uint32(0xFF)] ^ (crc >> np.uint32(8))
    for shift in shifts:
        if len(crc) == 1:
            break
        crc = _shifted(crc[::2], shift) ^ crc[1::2]
    return int(crc[0]) ^ 0xFFFFFFFF


def masked(crc: int) -> int:
    return ((crc >> 15 | crc << 17) + MASK) & 0xFFFFFFFF


def _heads(data: bytes) -> np.ndarray:
    """Places in some bytes where a length and its checksum stand."""
    n = len(data) - HEAD + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    table = _tables()[0]
    raw = np.frombuffer(data, np.uint8)
    crc = np.full(n, 0xFFFFFFFF, np.uint32)
    for k in range(8):
        crc = table[(crc ^ raw[k : k + n]) & np.uint32(0xFF)] ^ (crc >> np.uint32(8))
    crc = ~crc
    stored = np.ndarray((n,), "<u4", data, offset=8, strides=(1,))
    found = (crc >> np.uint32(15) | crc << np.uint32(17)) + np.uint32(MASK)
    return np.flatnonzero(found == stored)


def frame(data: bytes) -> bytes:
    """A record with its checksums."""
    size = struct.pack("<Q", len(data))
    return size + struct.pack("<I", masked(crc32c(size))) + data + struct.pack("<I", masked(crc32c(data)))


# Examples: messages of tagged fields; a number is written seven bits a byte.


def _number(n: int) -> bytes:
    n &= (1 << 64) - 1
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


def _field(tag: int, data: bytes) -> bytes:
    return _number(tag << 3 | 2) + _number(len(data)) + data


def _read_number(data: bytes, at: int) -> tuple[int, int]:
    out = shift = 0
    while True:
        byte = data[at]
        out |= (byte & 0x7F) << shift
        at, shift = at + 1, shift + 7
        if byte < 0x80:
            return out, at


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    at = 0
    while at < len(data):
        key, at = _read_number(data, at)
        kind = key & 7
        if kind == 0:
            value, at = _read_number(data, at)
        else:
            size, at = _read_number(data, at) if kind == 2 else ({1: 8, 5: 4}[kind], at)
            if at + size > len(data):
                raise ValueError("a field is longer than its message")
            value, at = data[at : at + size], at + size
        yield key >> 3, value


def _feature(kind: pa.DataType, value) -> bytes:
    """One feature: a list of byte strings (tag 1), floats (2) or whole numbers (3)."""
    values = value if pa.types.is_list(kind) else [value]
    one = kind.value_type if pa.types.is_list(kind) else kind
    if pa.types.is_floating(one):
        return _field(2, _field(1, struct.pack(f"<{len(values)}f", *values)))
    if pa.types.is_integer(one) or pa.types.is_boolean(one):
        return _field(3, _field(1, b"".join(_number(int(v)) for v in values)))
    return _field(1, b"".join(_field(1, v.encode() if isinstance(v, str) else v) for v in values))


def encode(schema: pa.Schema, row: dict) -> bytes:
    """A row as an example; nulls have no feature."""
    features = b""
    for column in schema:
        value = row[column.name]
        if value is not None:
            features += _field(1, _field(1, column.name.encode()) + _field(2, _feature(column.type, value)))
    return _field(1, features)


def _values(feature: bytes) -> list:
    out: list = []
    for kind, body in _fields(feature):
        for _, value in _fields(body):
            if kind == 1:
                out.append(value)
            elif kind == 2:
                out += struct.unpack(f"<{len(value) // 4}f", value)
            elif isinstance(value, int):
                out.append(value - (1 << 64) if value >> 63 else value)
            else:
                at = 0
                while at < len(value):
                    n, at = _read_number(value, at)
                    out.append(n - (1 << 64) if n >> 63 else n)
    return out


def decode(example: bytes) -> dict[str, list]:
    """The features of an example, each as a list."""
    out = {}
    for tag, features in _fields(example):
        for _, entry in _fields(features) if tag == 1 else ():
            parts = dict(_fields(entry))
            out[parts.get(1, b"").decode()] = _values(parts.get(2, b""))
    return out


def _batch(schema: pa.Schema, rows: list[dict[str, list]]) -> pa.RecordBatch:
    columns = []
    for column in schema:
        text = pa.types.is_string(column.type)
        found = [r.get(column.name) for r in rows]
        if pa.types.is_list(column.type):
            if pa.types.is_string(column.type.value_type):
                found = [None if v is None else [x.decode() for x in v] for v in found]
        else:
            found = [v[0] if v else None for v in found]
            found = [None if v is None else v.decode() if text else v for v in found]
        columns.append(pa.array(found, column.type))
    return pa.RecordBatch.from_arrays(columns, schema=schema)


def _filesystem(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


@dataclass
class Range(InputPartition):
    """The records of a file that begin at ``start`` or later and before ``stop``."""

    path: str
    start: int
    stop: int
    size: int


class RecordReader(DataSourceReader):
    def __init__(self, path: str, schema: StructType, split_bytes: int):
        self.path, self.schema, self.split_bytes = path, schema, split_bytes

    def partitions(self) -> list[Range]:
        files, path = _filesystem(self.path)
        info = files.get_file_info(path)
        found = [info] if info.is_file else files.get_file_info(fs.FileSelector(path, recursive=True))
        shown = [f for f in found if f.is_file and not any(x[:1] in "._" for x in f.path[len(path) :].split("/") if x)]
        return [
            Range(f.path, k, min(k + self.split_bytes, f.size), f.size)
            for f in sorted(shown, key=lambda f: f.path)
            for k in range(0, f.size, self.split_bytes)
        ]

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        schema = to_arrow_schema(self.schema)
        files, _ = _filesystem(self.path)
        rows, size = [], 0
        with files.open_input_file(part.path) as file:
            found = records(file, part.start, part.stop, part.size)
            while True:
                try:
                    data = next(found, None)
                    row = None if data is None else decode(data)
                except Exception as e:
                    if not part.start:
                        raise
                    # Where this range begins was found by a checksum, which data may also have.
                    raise ValueError(f"{e}; if the file's data look like records, read it with a larger splitBytes") from e
                if data is None:
                    break
                rows.append(row)
                size += len(data)
                if len(rows) >= BATCH_ROWS or size >= BATCH_BYTES:
                    yield _batch(schema, rows)
                    rows, size = [], 0
        if rows:
            yield _batch(schema, rows)


def _head(file, at: int, size: int) -> int:
    """The length of the record at a place; raises if none stands there."""
    head = file.read_at(HEAD, at)
    if not len(_heads(head)):
        raise ValueError(f"no record begins at byte {at}")
    length = struct.unpack("<Q", head[:8])[0]
    if at + HEAD + length + 4 > size:
        raise ValueError(f"the record at byte {at} is cut off")
    return length


def _begin(file, start: int, stop: int, size: int) -> int:
    """The first place from ``start`` on, before ``stop``, where a record begins; ``stop`` if none does."""
    for at in range(start, stop, WINDOW):
        upto = min(at + WINDOW, stop)
        for k in _heads(file.read_at(min(upto + HEAD - 1, size) - at, at)).tolist():
            length = struct.unpack("<Q", file.read_at(8, at + k))[0]
            if at + k + HEAD + length + 4 <= size:
                return at + k
    return stop


def records(file, start: int, stop: int, size: int) -> Iterator[bytes]:
    """The data of the records that begin in a range of a file of ``size`` bytes."""
    at = 0 if not start else _begin(file, start, stop, size)
    if at >= stop:
        return
    while at < stop:
        length = _head(file, at, size)
        body = file.read_at(length + 4, at + HEAD)
        if masked(crc32c(body[:length])) != struct.unpack("<I", body[length:])[0]:
            raise ValueError(f"the record at byte {at} is broken")
        yield body[:length]
        at += HEAD + length + 4
    if at < size:
        _head(file, at, size)
        if _begin(file, stop, at, size) != at:
            raise ValueError(f"data before byte {at} looks like a record: read the file with a larger splitBytes")


@dataclass
class Written(WriterCommitMessage):
    path: str | None


class RecordWriter(DataSourceArrowWriter):
    """Each task writes one file under a hidden name; the names are made plain when all are done."""

    def __init__(self, path: str, schema: StructType, overwrite: bool):
        self.path, self.schema, self.overwrite = path, schema, overwrite
        files, folder = _filesystem(path)
        if overwrite:
            files.create_dir(folder)
            files.delete_dir_contents(folder)
        elif files.get_file_info(folder).type != fs.FileType.NotFound and files.get_file_info(fs.FileSelector(folder)):
            raise ValueError(f"{path} is not empty")
        files.create_dir(folder)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        files, folder = _filesystem(self.path)
        name = f"{folder.rstrip('/')}/_part-{uuid.uuid4()}.tfrecord"
        out = None
        for batch in iterator:
            for row in batch.to_pylist():
                out = out or files.open_output_stream(name)
                out.write(frame(encode(batch.schema, row)))
        if out is None:
            return Written(None)
        out.close()
        return Written(name)

    def commit(self, messages: list[Written | None]) -> None:
        files, _ = _filesystem(self.path)
        for message in messages:
            if message and message.path:
                folder, _, name = message.path.rpartition("/")
                files.move(message.path, f"{folder}/{name[1:]}")

    def abort(self, messages: list[Written | None]) -> None:
        files, _ = _filesystem(self.path)
        for message in messages:
            if message and message.path:
                files.delete_file(message.path)


class RecordSource(DataSource):
    """``format("tfrecord")``: columns of texts, bytes, whole numbers, floats, and arrays of these."""

    @classmethod
    def name(cls) -> str:
        return "tfrecord"

    def schema(self) -> str:
        raise ValueError("TFRecord files carry no schema: read them with one")

    def reader(self, schema: StructType) -> RecordReader:
        return RecordReader(self.options["path"], schema, int(self.options.get("splitbytes", SPLIT_BYTES)))

    def writer(self, schema: StructType, overwrite: bool) -> RecordWriter:
        return RecordWriter(self.options["path"], schema, overwrite)


def register(spark: SparkSession) -> None:
    """Make ``format("tfrecord")`` known to a session."""
    spark.dataSource.register(RecordSource)
