"""The two binary layouts: a log of framed records and a sorted run with index, bloom filter and footer.

Little-endian. Log record: u32 key size (top bit: tombstone), key, u32 value size, value. Run: records u32 key size,
key, u32 value size, value; index records u32 key size, key, u64 offset; bloom bytes; a footer of u64 index offset,
u64 bloom offset, u32 hash count, u32 bit count, u32 bloom bytes. In a run a tombstone is the value of the one byte
0xFF, so that byte cannot be stored as a value there; ``run_bytes`` refuses it.

Readers take any path that Spark reads and parse a file record by record; ``RunFile`` finds a key by bloom filter, index and one
record. Writers are a data source of their own, which writes files of bounded size for each task through ``pyarrow.fs``.
"""

from __future__ import annotations

import bisect
import itertools
import struct
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from ..functions import bloom

TOMBSTONE_BIT = 0x80000000
TOMBSTONE_VALUE = b"\xff"
FOOTER = struct.Struct("<QQIII")
FILE_BYTES = 64 << 20  # readers take a file at a time, so files are bounded however large a task's share is
LOG_SCHEMA = "path string, seq long, key binary, value binary, is_tombstone boolean"
RUN_SCHEMA = "path string, entry long, key binary, value binary, is_tombstone boolean"


def log_bytes(records: Iterable[tuple[bytes, bytes | None, bool]]) -> Iterator[bytes]:
    for key, value, dead in records:
        if len(key) >= TOMBSTONE_BIT:
            raise ValueError("key too long for the log format")
        body = b"" if dead else value or b""
        yield struct.pack("<I", len(key) | (TOMBSTONE_BIT if dead else 0)) + key + struct.pack("<I", len(body)) + body


def parse_log(data: bytes) -> Iterator[tuple[bytes, bytes | None, bool]]:
    """Records in order; an incomplete last record is left out."""
    at, end = 0, len(data)
    while at + 4 <= end:
        head = struct.unpack_from("<I", data, at)[0]
        n, dead = head & ~TOMBSTONE_BIT, bool(head & TOMBSTONE_BIT)
        if at + 8 + n > end:
            return
        m = struct.unpack_from("<I", data, at + 4 + n)[0]
        if at + 8 + n + m > end:
            return
        value = data[at + 8 + n : at + 8 + n + m]
        yield data[at + 4 : at + 4 + n], None if dead else value, dead
        at += 8 + n + m


def run_bytes(entries: list[tuple[bytes, bytes | None, bool]], fpp: float = 0.01) -> bytes:
    """A run file of sorted entries."""
    bits, hashes = bloom.parameters(len(entries), fpp)
    filter_, data, index, at = bytearray((bits + 7) // 8), [], [], 0
    for key, value, dead in entries:
        if not dead and value == TOMBSTONE_VALUE:
            raise ValueError("the run format cannot hold the one-byte value FF")
        body = TOMBSTONE_VALUE if dead else value or b""
        record = struct.pack("<I", len(key)) + key + struct.pack("<I", len(body)) + body
        data.append(record)
        index.append(struct.pack("<I", len(key)) + key + struct.pack("<Q", at))
        at += len(record)
        h1, h2 = bloom.murmur3_32(key), bloom.fnv1a_32(key)
        for i in range(hashes):
            position = (h1 + i * h2) % bits
            filter_[position >> 3] |= 1 << (position & 7)
    blob = b"".join(index)
    return b"".join(data) + blob + bytes(filter_) + FOOTER.pack(at, at + len(blob), hashes, bits, len(filter_))


def parse_run(data: bytes) -> Iterator[tuple[bytes, bytes | None, bool]]:
    if len(data) < FOOTER.size:
        raise ValueError("run file too small")
    end, at = FOOTER.unpack_from(data, len(data) - FOOTER.size)[0], 0
    while at < end:
        n = struct.unpack_from("<I", data, at)[0]
        m = struct.unpack_from("<I", data, at + 4 + n)[0]
        value = data[at + 8 + n : at + 8 + n + m]
        yield data[at + 4 : at + 4 + n], None if value == TOMBSTONE_VALUE else value, value == TOMBSTONE_VALUE
        at += 8 + n + m


class RunFile:
    """A run file's footer, index and bloom filter, and lookups by them."""

    def __init__(self, data: bytes):
        if len(data) < FOOTER.size:
            raise ValueError("run file too small")
        self.data = data
        self.index_at, self.bloom_at, self.hashes, self.bits, self.bloom_bytes = FOOTER.unpack_from(data, len(data) - FOOTER.size)
        if not self.index_at <= self.bloom_at <= self.bloom_at + self.bloom_bytes <= len(data) - FOOTER.size:
            raise ValueError("run file with a broken footer")
        self.filter = data[self.bloom_at : self.bloom_at + self.bloom_bytes]
        self._index: list[tuple[bytes, int]] | None = None

    @property
    def index(self) -> list[tuple[bytes, int]]:
        """Keys in order, with their records' offsets; read when first asked for."""
        if self._index is None:
            self._index, at = [], self.index_at
            while at < self.bloom_at:
                n = struct.unpack_from("<I", self.data, at)[0]
                self._index.append((self.data[at + 4 : at + 4 + n], struct.unpack_from("<Q", self.data, at + 4 + n)[0]))
                at += 12 + n
        return self._index

    def may_contain(self, key: bytes) -> bool:
        h1, h2 = bloom.murmur3_32(key), bloom.fnv1a_32(key)
        places = ((h1 + i * h2) % self.bits for i in range(self.hashes))
        return all(self.filter[p >> 3] >> (p & 7) & 1 for p in places)

    def record(self, at: int) -> tuple[bytes, bytes | None, bool]:
        n = struct.unpack_from("<I", self.data, at)[0]
        m = struct.unpack_from("<I", self.data, at + 4 + n)[0]
        value = self.data[at + 8 + n : at + 8 + n + m]
        return self.data[at + 4 : at + 4 + n], None if value == TOMBSTONE_VALUE else value, value == TOMBSTONE_VALUE

    def get(self, key: bytes) -> tuple[bytes, bytes | None, bool] | None:
        if not self.may_contain(key):
            return None
        k = bisect.bisect_left(self.index, (key, 0))
        return self.record(self.index[k][1]) if k < len(self.index) and self.index[k][0] == key else None


def _read(spark: SparkSession, path: str, parse, schema: str) -> DataFrame:
    """Rows that ``parse`` makes of each file's bytes, beside the file's path, in batches as they come."""
    fields = [c.split() for c in schema.split(", ")]
    kinds = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "boolean": pa.bool_()}

    def run(batches):
        for whole in batches:
            for name, data in zip(whole.column(0).to_pylist(), whole.column(1).to_pylist(), strict=True):
                records = parse(data)
                while part := list(itertools.islice(records, 10_000)):
                    columns = [[name] * len(part), *zip(*part, strict=True)]
                    yield pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields, strict=True)], names=[n for n, _ in fields])

    from ..shipping import ship

    ship(spark)
    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, schema)


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """Records of all log files under ``path``; ``seq`` is the place in the file."""
    return _read(spark, path, lambda data: ((i, *r) for i, r in enumerate(parse_log(data))), LOG_SCHEMA)


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """Entries of all run files under ``path``, in key order within a file."""
    return _read(spark, path, lambda data: ((i, *r) for i, r in enumerate(parse_run(data))), RUN_SCHEMA)


def read_run_index(spark: SparkSession, path: str) -> DataFrame:
    """``path``, ``key`` and ``offset`` of every index entry."""
    return _read(spark, path, lambda data: iter(RunFile(data).index), "path string, key binary, offset long")


def read_run_footers(spark: SparkSession, path: str) -> DataFrame:
    """``path``, offsets of index and bloom filter, its hashes, bits and bytes: one row a file."""
    def parse(data: bytes):
        f = RunFile(data)
        return iter([(f.index_at, f.bloom_at, f.hashes, f.bits, f.filter)])

    return _read(spark, path, parse, "path string, index_offset long, bloom_offset long, num_hashes long, num_bits long, bloom binary")


def lookup_runs(spark: SparkSession, path: str, keys: list[bytes]) -> DataFrame:
    """Entries of a short list of keys in every run file under ``path``, each found by bloom filter, index and one record.

    For many keys join with ``read_runs``.
    """
    def parse(data: bytes):
        f = RunFile(data)
        return iter([r for r in map(f.get, keys) if r is not None])

    return _read(spark, path, parse, "path string, key binary, value binary, is_tombstone boolean")


def stretches(records: Iterable[tuple[bytes, bytes | None, bool]], most: int) -> Iterator[list]:
    """Lists of successive records, each of about ``most`` bytes but for the last; a record counts 64 more than it holds."""
    part, size = [], 0
    for r in records:
        part.append(r)
        size += len(r[0]) + len(r[1] or b"") + 64
        if size >= most:
            yield part
            part, size = [], 0
    if part:
        yield part


class _Writer(DataSourceArrowWriter):
    """Writes a task's rows (key, value, is_tombstone) to files of about ``file_bytes``, in their order.

    Tasks write under names with a dot in front, which Spark's readers pass over; the job's commit renames those of the
    attempts that count. So files of lost or repeated attempts are never read.
    """

    def __init__(self, path: str, kind: str, file_bytes: int):
        self.path, self.kind, self.file_bytes = path, kind, file_bytes

    def write(self, batches):
        records = ((bytes(k), None if v is None else bytes(v), d) for b in batches for k, v, d in zip(*(c.to_pylist() for c in b.columns), strict=True))
        fs, where = fs_of(self.path)
        fs.create_dir(where, recursive=True)
        stem, names = f"part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}", []
        for k, part in enumerate(stretches(records, self.file_bytes)):
            names.append(f"{stem}-{k:06d}.{self.kind}")
            with fs.open_output_stream(f"{where}/.{names[-1]}") as out:
                out.write(b"".join(log_bytes(part)) if self.kind == "log" else run_bytes(part))
        return _Wrote(names)

    def commit(self, messages):
        fs, where = fs_of(self.path)
        fs.create_dir(where, recursive=True)
        for m in messages:
            for name in m.names if m is not None else ():
                fs.move(f"{where}/.{name}", f"{where}/{name}")

    def abort(self, messages):
        """Also after a commit that failed half-way: files go under either name."""
        from pyarrow.fs import FileType

        fs, where = fs_of(self.path)
        for m in messages:
            for name in m.names if m is not None else ():
                for info in fs.get_file_info([f"{where}/.{name}", f"{where}/{name}"]):
                    if info.type != FileType.NotFound:
                        fs.delete_file(info.path)


@dataclass
class _Wrote(WriterCommitMessage):
    names: list[str]


class _Source(DataSource):
    KIND = ""

    @classmethod
    def name(cls) -> str:
        return f"runstore_{cls.KIND}"

    def schema(self) -> str:
        return "key binary, value binary, is_tombstone boolean"

    def writer(self, schema, overwrite: bool) -> _Writer:
        return _Writer(self.options["path"], self.KIND, int(self.options["file_bytes"]))


class LogSource(_Source):
    KIND = "log"


class RunSource(_Source):
    KIND = "run"


def fs_of(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


def _write(rows: DataFrame, path: str, source: type[_Source], file_bytes: int) -> None:
    from ..shipping import ship

    ship(rows.sparkSession)
    rows.sparkSession.dataSource.register(source)
    rows.select(F.col("key").cast("binary"), F.col("value").cast("binary"), "is_tombstone").write.format(source.name()).mode("append").option("file_bytes", str(file_bytes)).save(path)


def write_log(ops: DataFrame, path: str, order: str = "seq", file_bytes: int = FILE_BYTES) -> None:
    """A change log (``key``, ``value``, ``is_tombstone``) as log files, each a range of ``order`` in its order."""
    _write(ops.repartitionByRange(order).sortWithinPartitions(order), path, LogSource, file_bytes)


def write_runs(entries: DataFrame, path: str, file_bytes: int = FILE_BYTES) -> None:
    """Entries with unique keys as run files, each a range of keys in their order, with index and bloom filter."""
    _write(entries.withColumn("key", F.col("key").cast("binary")).repartitionByRange("key").sortWithinPartitions("key"), path, RunSource, file_bytes)
