"""TFRecord files as a Spark data source: ``df.write.format("tfrecords")`` and ``spark.read.format("tfrecords")``.

A record holds one row: strings and binaries as bytes, whole numbers and booleans as int64, fractions as floats, arrays of
these as lists. A task writes one file for each value of the split column it meets, under a name of its own attempt, and
hands the names to the driver, which lists them in ``_records.json``; only listed files are read. A failed attempt deletes
its files, an aborted job those of all its tasks, and a write that replaces a folder those it no longer lists, so a write
that runs again leaves the same rows. Lengths and contents are secured by masked CRC-32C, which is computed for all
records of a batch side by side.
"""

from __future__ import annotations

import json
import re
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs as files
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import ArrayType, BinaryType, BooleanType, DataType, DoubleType, FloatType, StringType, StructType

#: Bytes that one lane takes in at a time, and bytes of records whose sums are computed side by side.
LANE, AT_ONCE = 256, 1 << 22
_POLYNOMIAL = 0x82F63B78  # fixed value: CRC-32C, bits reversed


def _table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(_POLYNOMIAL), t >> 1)
    return t


_STEP = _table()


def _skips() -> np.ndarray:
    """What a register becomes after LANE zero bytes, for each of its four bytes."""
    held = (np.arange(256, dtype=np.uint32)[None, :] << (8 * np.arange(4, dtype=np.uint32))[:, None]).astype(np.uint32)
    for _ in range(LANE):
        held = _STEP[held & 0xFF] ^ (held >> 8)
    return held


_SKIP = _skips()


def _plain_crc(data: bytes) -> int:
    register = 0xFFFFFFFF
    for b in data:
        register = int(_STEP[(register ^ b) & 0xFF]) ^ (register >> 8)
    return register ^ 0xFFFFFFFF


def crc32c(records: list[bytes]) -> list[int]:
    """Of each record. Records are cut into lanes, which go side by side; a record's lanes are then joined in turn."""
    out = [_plain_crc(r) if len(r) < 4 else 0 for r in records]
    long = [i for i, r in enumerate(records) if len(r) >= 4]
    if not long:
        return out
    lanes = np.array([-(-len(records[i]) // LANE) for i in long])
    first = np.cumsum(lanes) - lanes
    data = np.zeros((int(lanes.sum()), LANE), np.uint8)
    flat = data.reshape(-1)
    for i, n, at in zip(long, lanes, first):  # zeros in front change nothing while the register is 0
        end = (at + n) * LANE
        start = end - len(records[i])
        flat[start:end] = np.frombuffer(records[i], np.uint8)
        flat[start : start + 4] ^= 0xFF  # what a register of ones does
    register = np.zeros(len(data), np.uint32)
    for k in range(LANE):
        register = _STEP[(register ^ data[:, k]) & 0xFF] ^ (register >> 8)
    total, live = np.zeros(len(long), np.uint32), np.arange(len(long))
    for k in range(int(lanes.max())):
        live = live[lanes[live] > k]
        r = total[live]
        total[live] = _SKIP[0][r & 0xFF] ^ _SKIP[1][r >> 8 & 0xFF] ^ _SKIP[2][r >> 16 & 0xFF] ^ _SKIP[3][r >> 24] ^ register[first[live] + k]
    for i, t in zip(long, total.tolist()):
        out[i] = t ^ 0xFFFFFFFF
    return out


def _masked(crc: int) -> int:
    return ((crc >> 15 | crc << 17) + 0xA282EAD8) & 0xFFFFFFFF


def _varint(n: int) -> bytes:
    n, out = n % 2**64, bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def _field(number: int, body: bytes) -> bytes:
    return bytes([number << 3 | 2]) + _varint(len(body)) + body


def _encoded(names: list[str], kinds: list[int], values: tuple) -> bytes:
    """A row as an Example message; nulls are left out."""
    features = b""
    for name, kind, value in zip(names, kinds, values):
        if value is None:
            continue
        held = value if isinstance(value, list) else [value]
        held = [v for v in held if v is not None]
        if kind == 1:
            body = b"".join(_field(1, v.encode() if isinstance(v, str) else v) for v in held)
        else:
            body = _field(1, struct.pack(f"<{len(held)}f", *held) if kind == 2 else b"".join(_varint(int(v)) for v in held)) if held else b""
        features += _field(1, _field(1, name.encode()) + _field(2, _field(kind, body)))
    return _field(1, features)


def _read_varint(data: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = data[at]
        n, at, shift = n | (b & 127) << shift, at + 1, shift + 7
        if b < 128:
            return n, at


def _fields(data: bytes) -> Iterator[tuple[int, bytes]]:
    at = 0
    while at < len(data):
        tag, at = _read_varint(data, at)
        size, at = _read_varint(data, at)
        yield tag >> 3, data[at : at + size]
        at += size


def _decoded(record: bytes) -> dict[str, list]:
    out = {}
    for _, features in _fields(record):
        for _, entry in _fields(features):
            (_, name), (_, feature) = _fields(entry)
            for kind, body in _fields(feature):
                values: list = [v for _, v in _fields(body)]
                if kind == 2:
                    values = [x for v in values for x in struct.unpack(f"<{len(v) // 4}f", v)]
                elif kind == 3:
                    packed, values = b"".join(values), []
                    at = 0
                    while at < len(packed):
                        n, at = _read_varint(packed, at)
                        values.append(n - 2**64 if n >= 2**63 else n)
                out[name.decode()] = values
    return out


def _kind(t: DataType) -> int:
    t = t.elementType if isinstance(t, ArrayType) else t
    return 1 if isinstance(t, (StringType, BinaryType)) else 2 if isinstance(t, (FloatType, DoubleType)) else 3


def opened(folder: str) -> tuple[files.FileSystem, str]:
    return files.FileSystem.from_uri(re.sub(r"^s3[an]:", "s3:", re.sub(r"^file:/(?!/)", "file:///", folder)))


@dataclass
class Written(WriterCommitMessage):
    files: list


class RecordWriter(DataSourceArrowWriter):
    def __init__(self, folder: str, schema: StructType, split: str | None):
        self.folder, self.split = folder, split
        own = [f for f in schema.fields if f.name != split]
        self.names, self.kinds = [f.name for f in own], [_kind(f.dataType) for f in own]

    def _framed(self, rows: list[bytes]) -> bytes:
        sizes = [struct.pack("<Q", len(r)) for r in rows]
        sums = crc32c([*sizes, *rows])
        return b"".join(n + struct.pack("<I", _masked(a)) + r + struct.pack("<I", _masked(b)) for n, r, a, b in zip(sizes, rows, sums, sums[len(rows) :]))

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        place, root = opened(self.folder)
        partition, attempt, open_, made = TaskContext.get().partitionId(), uuid.uuid4().hex, {}, []

        def put(split: str, rows: list[bytes]) -> None:
            if split not in open_:
                made.append(f"{split}/part-{partition:06d}-{attempt}.tfrecord" if self.split else f"part-{partition:06d}-{attempt}.tfrecord")
                place.create_dir(f"{root}/{split}" if self.split else root, recursive=True)
                open_[split] = place.open_output_stream(f"{root}/{made[-1]}")
            open_[split].write(self._framed(rows))

        try:
            for batch in iterator:
                columns = [batch.column(n).to_pylist() for n in self.names]
                splits = batch.column(self.split).to_pylist() if self.split else [""] * batch.num_rows
                waiting: dict[str, list[bytes]] = {}
                held = 0
                for split, *values in zip(splits, *columns):
                    if self.split and not re.fullmatch(r"[\w.-]+", split or ""):
                        raise ValueError(f"{split!r} cannot name a folder of records")
                    row = _encoded(self.names, self.kinds, tuple(values))
                    waiting.setdefault(split, []).append(row)
                    held += len(row)
                    if held >= AT_ONCE:
                        for s, rows in waiting.items():
                            put(s, rows)
                        waiting, held = {}, 0
                for s, rows in waiting.items():
                    put(s, rows)
            for out in open_.values():
                out.close()
        except BaseException:
            for out in open_.values():
                out.close()
            for name in made:
                place.delete_file(f"{root}/{name}")
            raise
        return Written(made)

    def commit(self, messages: list) -> None:
        place, root = opened(self.folder)
        place.create_dir(root, recursive=True)
        names = sorted(n for m in messages if m for n in m.files)
        for f in place.get_file_info(files.FileSelector(root, recursive=True)):
            if f.base_name.endswith(".tfrecord") and f.path[len(root) :].lstrip("/") not in names:
                place.delete_file(f.path)
        with place.open_output_stream(f"{root}/_records.json") as out:
            out.write(json.dumps(names).encode())

    def abort(self, messages: list) -> None:
        place, root = opened(self.folder)
        for name in [n for m in messages if m for n in m.files]:
            place.delete_file(f"{root}/{name}")


class RecordReader(DataSourceReader):
    def __init__(self, folder: str, schema: StructType, split: str | None):
        self.folder, self.schema, self.split = folder, schema, split

    def partitions(self) -> list[InputPartition]:
        place, root = opened(self.folder)
        with place.open_input_stream(f"{root}/_records.json") as held:
            return [InputPartition(n) for n in json.loads(held.read())] or [InputPartition(None)]

    def _value(self, t: DataType, values: list | None):
        if values is None:
            return None
        item = t.elementType if isinstance(t, ArrayType) else t
        made = [v.decode() if isinstance(item, StringType) else bool(v) if isinstance(item, BooleanType) else v for v in values]
        return made if isinstance(t, ArrayType) else made[0]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        if not partition.value:
            return
        place, root = opened(self.folder)
        split = partition.value.rpartition("/")[0] or None
        with place.open_input_stream(f"{root}/{partition.value}") as held:
            while head := held.read(12):
                size, crc = struct.unpack("<QI", head)
                record, (own,) = held.read(size), struct.unpack("<I", held.read(4))
                if [_masked(c) for c in crc32c([head[:8], record])] != [crc, own]:
                    raise ValueError(f"{partition.value} is damaged")
                values = _decoded(record)
                yield tuple(split if f.name == self.split else self._value(f.dataType, values.get(f.name)) for f in self.schema.fields)


class Records(DataSource):
    """Options: path, and split, the column whose values name folders instead of being in the records. Reading needs a schema."""

    @classmethod
    def name(cls) -> str:
        return "tfrecords"

    def schema(self) -> str:
        raise ValueError("give the schema of the records: spark.read.schema(...).format('tfrecords')")

    def reader(self, schema: StructType) -> RecordReader:
        return RecordReader(self.options["path"], schema, self.options.get("split"))

    def writer(self, schema: StructType, overwrite: bool) -> RecordWriter:
        if not overwrite:
            raise ValueError("a folder of records is written as a whole: use mode('overwrite')")
        return RecordWriter(self.options["path"], schema, self.options.get("split"))


def write_records(rows: DataFrame, folder: str, split: str | None = None) -> None:
    """Every row as a record, in the order of each partition. Nulls and null items are left out; a null or odd split fails the write."""
    rows.sparkSession.dataSource.register(Records)
    held = rows.write.format("tfrecords").mode("overwrite")
    (held.option("split", split) if split else held).save(folder)


def read_records(spark: SparkSession, folder: str, schema: str, split: str | None = None) -> DataFrame:
    """The rows under a schema; what a record lacks is null. A record whose sums differ fails the read."""
    spark.dataSource.register(Records)
    held = spark.read.format("tfrecords").schema(schema)
    return (held.option("split", split) if split else held).load(folder)
