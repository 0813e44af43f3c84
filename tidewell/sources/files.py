"""The store's binary snapshot and log files as a Spark data source, and writers of them.

A store is at most one snapshot and one log; many stores are many files, and each file is one partition, read
record by record: a file's records can only be found from its beginning, and compaction bounds a file. Torn tails
of a log end it; any other fault raises, unless the reader only inspects.

Folders are URIs of any file system that Arrow reaches (file, hdfs, s3, gs) and all executors share; files are
written under a name of their own attempt and then renamed, so that a task may run twice.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tidewell.functions.checksums import fnv_of_strings
from tidewell.functions.keys import int_of
from tidewell.functions.numbers import old_record_checksum, record_checksum

#: Magics and layouts of the two kinds of file.
SNAPSHOT_MAGIC, ENTRY_MAGIC, RECORD_MAGIC = b"KVSNAP01", 0x4B565345, 0x4B565741
HEADER, ENTRY, RECORD = struct.Struct("<8sII"), struct.Struct("<III"), struct.Struct("<IHBBIII")
#: Records that are checked and handed on together.
TOGETHER = 4096


class FormatError(ValueError):
    pass


def located(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """The file system of a URI, or of a plain local path, and the path in it."""
    if path.startswith("file:/") and "://" not in path:
        path = path.removeprefix("file:")
    return pyarrow.fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")


def listed(path: str) -> list[str]:
    """URIs of the files in a folder, or of one file; names that begin with _ or . don't count."""
    fs, inner = located(path)
    base = path[: len(path) - len(inner)] if path.endswith(inner) else "file://"
    info = fs.get_file_info(inner)
    found = [info] if info.type == pyarrow.fs.FileType.File else fs.get_file_info(pyarrow.fs.FileSelector(inner, allow_not_found=True))
    return sorted(f"{base}{x.path}" for x in found if x.type == pyarrow.fs.FileType.File and not x.base_name.startswith(("_", ".")))


def file_size(path: str) -> int:
    """0 for a file that isn't there."""
    fs, inner = located(path)
    return fs.get_file_info(inner).size or 0


def _int_key(raw: int) -> bytes:
    return b"\x01" + struct.pack(">I", raw)


def _exact(f, n: int) -> bytes | None:
    data = f.read(n)
    return data if len(data) == n else None


def read_snapshot(f) -> Iterator[tuple[bytes, bytes]]:
    head = _exact(f, HEADER.size)
    if head is None:
        raise FormatError("a snapshot without a whole header")
    magic, version, _ = HEADER.unpack(head)
    if magic != SNAPSHOT_MAGIC or version not in (1, 2):
        raise FormatError("not a snapshot of a known version")
    while first := f.read(1):
        rest = _exact(f, ENTRY.size - 1)
        if rest is None:
            raise FormatError("a snapshot entry is cut off")
        mark, key_size, value_size = ENTRY.unpack(first + rest)
        if mark != ENTRY_MAGIC:
            raise FormatError("a snapshot entry without its mark")
        key = _int_key(key_size) if version == 1 else _exact(f, key_size)
        value = _exact(f, value_size)
        if key is None or value is None:
            raise FormatError("a snapshot entry is cut off")
        yield key, value


def read_log(f) -> Iterator[tuple[int, bytes, bytes | None]]:
    """Records in order; checksums are verified for TOGETHER of them at once."""
    held, parts, sums = [], [], []

    def checked() -> Iterator[tuple[int, bytes, bytes | None]]:
        if (fnv_of_strings(parts) != sums).any():
            raise FormatError("a log record with a wrong checksum")
        yield from held
        for x in (held, parts, sums):
            x.clear()

    while (head := _exact(f, RECORD.size)) is not None:
        mark, version, op, _, key_size, value_size, checksum = RECORD.unpack(head)
        if mark != RECORD_MAGIC or version not in (1, 2) or op not in (1, 2) or (op == 2 and value_size):
            raise FormatError("a log record that can't be")
        body = b"" if version == 1 else _exact(f, key_size)
        value = _exact(f, value_size)
        if body is None or value is None:
            break
        held.append((op, _int_key(key_size) if version == 1 else body, value if op == 1 else None))
        parts.append(struct.pack("<BII", op, key_size, value_size) + body + value)
        sums.append(checksum)
        if len(held) == TOGETHER:
            yield from checked()
    if held:
        yield from checked()


#: What an inspection tells of a snapshot and of a log, beside its counts by kind of key.
KINDS = ("int", "string", "binary", "unknown")
INSPECTED = [
    "magic_ok", "version", "entries", *(f"{k}_keys" for k in KINDS), "entry_magic_ok", "truncated", "size", "log_exists", "log_magic", "log_version", "first_type", "log_size",
    "records", "puts", "deletes", *(f"log_{k}_keys" for k in KINDS), "unknown_types", "log_truncated", "rewrite_recommended",
]


def inspect(snapshot, log, sizes: tuple[int, int] = (0, 0)) -> dict[str, int]:
    """Counts and faults of a snapshot and a log (None: no such file), without checksums and without raising."""
    out = dict.fromkeys(INSPECTED, 0) | {"magic_ok": 1, "entry_magic_ok": 1, "size": sizes[0], "log_exists": int(log is not None), "log_size": sizes[1]}
    kinds = {1: "int", 2: "string", 3: "binary"}
    head = _exact(snapshot, HEADER.size) if snapshot else None
    if head is None:
        out |= {"magic_ok": 0, "truncated": 1}
    else:
        magic, out["version"], _ = HEADER.unpack(head)
        out["magic_ok"] = int(magic == SNAPSHOT_MAGIC)
        while out["magic_ok"] and (first := snapshot.read(1)):
            rest = _exact(snapshot, ENTRY.size - 1)
            if rest is None:
                out["truncated"] = 1
                break
            mark, key_size, value_size = ENTRY.unpack(first + rest)
            if mark != ENTRY_MAGIC:
                out["entry_magic_ok"] = 0
                break
            key = b"\x01" if out["version"] == 1 else _exact(snapshot, key_size)
            if key is None or _exact(snapshot, value_size) is None:
                out["truncated"] = 1
                break
            out["entries"] += 1
            out[f"{kinds.get(key[0] if key else 0, 'unknown')}_keys"] += 1
    while log and (head := log.read(RECORD.size)):
        if len(head) < RECORD.size:
            out["log_truncated"] = 1
            break
        mark, version, op, _, key_size, value_size, _ = RECORD.unpack(head)
        if not out["records"]:
            out |= {"log_magic": mark, "log_version": version, "first_type": op}
        key = b"\x01" if version == 1 else _exact(log, key_size)
        if key is None or _exact(log, value_size) is None:
            out["log_truncated"] = 1
            break
        out["records"] += 1
        out[{1: "puts", 2: "deletes"}.get(op, "unknown_types")] += 1
        out[f"log_{kinds.get(key[0] if key else 0, 'unknown')}_keys"] += 1
    out["rewrite_recommended"] = int(out["version"] != 2 or (out["records"] > 0 and out["log_version"] != 2) or bool(out["log_truncated"]))
    return out


def snapshot_bytes(rows: Iterator[tuple[bytes, bytes]], version: int = 2) -> bytes:
    """A snapshot of rows in ascending order of key; version 1 holds int keys only."""
    return HEADER.pack(SNAPSHOT_MAGIC, version, 0) + b"".join(_entry(k, v, version) for k, v in rows)


def _entry(key: bytes, value: bytes, version: int) -> bytes:
    if version == 1:
        return ENTRY.pack(ENTRY_MAGIC, struct.unpack(">I", key[1:])[0], len(value)) + value
    return ENTRY.pack(ENTRY_MAGIC, len(key), len(value)) + key + value


def _record(op: int, key: bytes, value: bytes, checksum: int, version: int) -> bytes:
    size = struct.unpack(">I", key[1:])[0] if version == 1 else len(key)
    return RECORD.pack(RECORD_MAGIC, version, op, 0, size, len(value), checksum) + (b"" if version == 1 else key) + value


def log_bytes(rows: Iterator[tuple[int, bytes, bytes | None]], version: int = 2) -> bytes:
    """A log of rows in order; version 1 holds int keys only."""
    every = [(op, key, (value or b"") if op == 1 else b"") for op, key, value in rows]
    sizes = [struct.unpack(">I", key[1:])[0] if version == 1 else len(key) for _, key, _ in every]
    sums = fnv_of_strings([struct.pack("<BII", op, n, len(v)) + (b"" if version == 1 else k) + v for (op, k, v), n in zip(every, sizes, strict=True)])
    return b"".join(_record(*row, int(x), version) for row, x in zip(every, sums, strict=True))


@dataclass
class FilePartition(InputPartition):
    path: str
    log: str | None = None


class StoreReader(DataSourceReader):
    def __init__(self, path: str, kind: str, schema: pa.Schema) -> None:
        self.path, self.kind, self.schema = path.rstrip("/"), kind, schema

    def partitions(self) -> list[FilePartition]:
        if self.kind != "inspect":
            return [FilePartition(x) for x in listed(self.path)]
        name = lambda x: x.rsplit("/", 1)[1]
        sides = [{name(x): x for x in listed(f"{self.path}/{side}")} for side in ("snapshots", "logs")]
        return [FilePartition(sides[0].get(n, ""), sides[1].get(n)) for n in sorted({*sides[0], *sides[1]})]

    def rows(self, partition: FilePartition) -> Iterator[tuple]:
        if self.kind == "inspect":
            opened = [located(x)[0].open_input_stream(located(x)[1]) if x else None for x in (partition.path, partition.log)]
            found = inspect(*opened, (file_size(partition.path) if partition.path else 0, file_size(partition.log) if partition.log else 0))
            yield (partition.path or partition.log).rsplit("/", 1)[1], *found.values()
            return
        fs, path = located(partition.path)
        with fs.open_input_stream(path, buffer_size=1 << 20) as f:
            name = path.rsplit("/", 1)[1]
            if self.kind == "snapshot":
                for i, (k, v) in enumerate(read_snapshot(f)):
                    yield name, i, 0, 1, k, v
            else:
                for i, (op, k, v) in enumerate(read_log(f)):
                    yield name, i, 0, op, k, v

    def read(self, partition: FilePartition) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for row in self.rows(partition):
            held.append(row)
            if len(held) == TOGETHER:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), self.schema, strict=True)], schema=self.schema)
                held = []
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), self.schema, strict=True)], schema=self.schema)


CHANGES = pa.schema([("store", pa.string()), ("seq", pa.int64()), ("sub_seq", pa.int32()), ("op", pa.int32()), ("key_enc", pa.binary()), ("value", pa.binary())])
COUNTS = pa.schema([("store", pa.string()), *((n, pa.int64()) for n in INSPECTED)])


class StoreSource(DataSource):
    """spark.read.format("tidewell").option("kind", "snapshot", "log" or "inspect").load(path)

    inspect reads a folder with the folders `snapshots` and `logs` and gives a row for each store of either.
    """

    @classmethod
    def name(cls) -> str:
        return "tidewell"

    def _schema(self) -> pa.Schema:
        return COUNTS if self.options.get("kind") == "inspect" else CHANGES

    def schema(self) -> str:
        types = {pa.string(): "string", pa.int64(): "long", pa.int32(): "int", pa.binary(): "binary"}
        return ", ".join(f"{f.name} {types[f.type]}" for f in self._schema())

    def reader(self, schema) -> StoreReader:
        return StoreReader(self.options["path"], self.options.get("kind", "log"), self._schema())


def load(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """Changes in the order of each file; an entry of a snapshot is a put, and of one key the last counts. inspect: counts by store."""
    spark.dataSource.register(StoreSource)
    return spark.read.format("tidewell").option("kind", kind).load(path)


def _write_partition(batches: Iterator[pa.RecordBatch], path: str, kind: str) -> Iterator[pa.RecordBatch]:
    """Files of the stores in sorted rows; columns: store, version, tail, op, key_enc, value, checksum."""
    fs, base = located(path)
    name, out, tail, own, size = None, None, b"", uuid.uuid4().hex, 0
    done: list[tuple[str, int]] = []

    def close() -> None:
        out.write(tail)
        out.close()
        fs.move(f"{base}/_{own}-{name}", f"{base}/{name}")
        done.append((name, size + len(tail)))

    for b in batches:
        columns = [b.column(c).to_pylist() for c in ("store", "version", "tail", "op", "key_enc", "value", "checksum")]
        for store, version, own_tail, op, key, value, checksum in zip(*columns, strict=True):
            if store != name:
                if out:
                    close()
                name, tail, size = store, own_tail or b"", 0
                out = fs.open_output_stream(f"{base}/_{own}-{name}", buffer_size=1 << 20)
                if kind == "snapshot":
                    size = out.write(snapshot_bytes(iter(()), version))
            if key is not None:  # a store without rows is a file without records
                size += out.write(_entry(key, value or b"", version) if kind == "snapshot" else _record(op, key, (value or b"") if op == 1 else b"", checksum, version))
    if out:
        close()
    yield pa.RecordBatch.from_arrays([pa.array([n for n, _ in done], pa.string()), pa.array([n for _, n in done], pa.int64())], ["store", "bytes"])


def write_stores(df: DataFrame, path: str, kind: str) -> DataFrame:
    """One file of the binary format for each store; df: store, and seq, op, key_enc, value (a snapshot needs no seq and op).

    `version` (2 by default) and `tail` (bytes after the last record, as a crash may leave them) may be columns too, the
    same in all rows of a store; a row of a null key only makes the store's file. A file is written by the task that
    has its store, record by record in sorted order, and renamed when whole. The result has store and bytes.
    """
    fs, base = located(path)
    fs.create_dir(base, recursive=True)
    number = F.col("version") if "version" in df.columns else F.lit(2)
    tail = F.col("tail") if "tail" in df.columns else F.lit(None).cast("binary")
    key, value = F.col("key_enc"), F.col("value")
    if kind == "snapshot":
        rows, order = df.select("store", number.alias("version"), tail.alias("tail"), F.lit(1).alias("op"), key, value, F.lit(0).cast("long").alias("checksum")), ["store", "key_enc"]
        rows = rows.repartition("store").sortWithinPartitions(*order)
    else:
        op = F.col("op")
        current, first = record_checksum(op, key, value), old_record_checksum(op, int_of(key), value)
        sums = {"_new": current, "_old": first} if "version" in df.columns else {"checksum": current}
        rows = df.select("store", "seq", "sub_seq", number.alias("version"), tail.alias("tail"), op, key, value, *(c.alias(n) for n, c in sums.items()))
        if "_old" in sums:
            rows = rows.withColumn("checksum", F.when(F.col("version") == 1, F.col("_old")).otherwise(F.col("_new")))
        rows = rows.repartition("store").sortWithinPartitions("store", "seq", "sub_seq").select("store", "version", "tail", "op", "key_enc", "value", "checksum")
    written = rows.mapInArrow(partial(_write_partition, path=path, kind=kind), "store string, bytes long").collect()  # a row for each file
    return df.sparkSession.createDataFrame([(r.store, r.bytes) for r in written], "store string, bytes long")


def create_if_missing(path: str) -> bool:
    """A snapshot without entries where there is no file; False if there is one."""
    fs, inner = located(path)
    if fs.get_file_info(inner).type == pyarrow.fs.FileType.File:
        return False
    fs.create_dir(inner.rsplit("/", 1)[0], recursive=True)
    name = f"{inner}.{uuid.uuid4().hex}"
    with fs.open_output_stream(name) as f:
        f.write(snapshot_bytes(iter(())))
    fs.move(name, inner)
    return True


def rewritten(spark: SparkSession, folder: str, to: str) -> DataFrame:
    """The stores below `folder` (snapshots and logs of any version) as snapshots of the current version below `to`.

    Each store's log is applied to its snapshot, a torn tail is dropped, and its new log is empty. The result has
    store and the bytes of the snapshot.
    """
    snapshot = load(spark, f"{folder}/snapshots", "snapshot").withColumn("seq", F.lit(-1).cast("long"))
    every = snapshot.unionByName(load(spark, f"{folder}/logs", "log"))
    last = every.groupBy("store", "key_enc").agg(F.max_by(F.struct("op", "value"), F.struct("seq", "sub_seq")).alias("last"))
    state = last.where("last.op = 1").select("store", "key_enc", "last.value")
    names = load(spark, folder, "inspect").select("store")
    empty = names.select("store", F.lit(None).cast("binary").alias("key_enc"), F.lit(None).cast("binary").alias("value"))
    sizes = write_stores(state.unionByName(empty), f"{to}/snapshots", "snapshot")
    write_stores(empty.select("store", F.lit(0).cast("long").alias("seq"), F.lit(0).alias("sub_seq"), F.lit(1).alias("op"), "key_enc", "value"), f"{to}/logs", "log")
    return sizes
