"""Token ids in Arrow stream files of fixed-size lists.

A shard is a stream of batches; each row is a sequence of LENGTH ids with two masks of the same length: `real`
marks ids against the padding of a shard's last row, `end` the last id of each document. All rows have the same
size, so that a mapped file gives any sequence as a view of the file's own bytes. Ids take two bytes where the
vocabulary allows it. A second, small stream file beside each shard names its documents: doc_id, start, n_tokens.

Documents stand in ascending order of doc_id over the shards in order (null ids first; rows of one doc_id by a
hash of their text, equal rows in either order), each with the end id after its own. Null and empty texts are
the end id alone. An empty table gives no shards. Only doc_id and text are read.

A shard's file is written under a name of its own attempt and then renamed, so a task may run twice. The folder
must be one that executors share and Arrow's file systems reach (file, hdfs, s3, gs); it lies in
spark.checkpoint.dir unless it's given.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewell.llm.bpe import CACHE_BYTES, Cutter, Encoder, Words, byte_letters
from tidewell.llm.common import chunks, documents, once, released, sized, stored, work_dir

LENGTH, ROWS, END_ID = 1024, 256, 0
#: Bytes of text that a shard holds, about; what the end mark of a stream file takes.
SHARD_BYTES, END_BYTES = 32 << 20, 8


def library_encoder(path: str) -> Encoder:
    """Words are those of the library's pre-tokenizer and encoded by its model, each distinct one once."""

    def make() -> Encoder:
        from tokenizers import Tokenizer

        library, letters = Tokenizer.from_file(path), byte_letters()
        model = library.model

        def encode(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
            ids = [[t.id for t in model.tokenize("".join(map(letters.__getitem__, w)))] for w in words]
            return np.array([x for i in ids for x in i], np.uint32), np.array([len(i) for i in ids], np.int64)

        special = {t.content: i for i, t in library.get_added_tokens_decoder().items()}
        out = Encoder(Words(encode, Cutter(library.pre_tokenizer.pre_tokenize_str, attach_space=True), 2 * CACHE_BYTES), special, lambda t: t)
        out.vocabulary = library.get_vocab_size()
        return out

    return once(("library", path), make)


def schema(kind: pa.DataType, length: int = LENGTH) -> pa.Schema:
    return pa.schema([("ids", pa.list_(kind, length)), ("real", pa.list_(pa.bool_(), length)), ("end", pa.list_(pa.bool_(), length))])


DOCS = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])


class Writer:
    """Cuts a run of ids into rows and writes full batches."""

    def __init__(self, sink, kind: pa.DataType, length: int = LENGTH, rows: int = ROWS) -> None:
        self.schema, self.length, self.rows = schema(kind, length), length, rows
        self.kind = kind.to_pandas_dtype()
        self.out = pa.ipc.new_stream(sink, self.schema)
        self.ids, self.ends, self.held = [], [], 0

    def add(self, ids: np.ndarray, ends: np.ndarray) -> None:
        self.ids.append(ids.astype(self.kind))
        self.ends.append(ends)
        self.held += len(ids)
        if self.held >= self.rows * self.length:
            self.flush(False)

    def flush(self, last: bool) -> None:
        ids, ends = (np.concatenate([*x, x[0][:0]]) if x else np.zeros(0) for x in (self.ids, self.ends))
        step, at = self.rows * self.length, 0
        while len(ids) - at >= step or last and at < len(ids):
            part, end = ids[at : at + step], ends[at : at + step]
            pad = -len(part) % self.length
            real = np.concatenate([np.ones(len(part), bool), np.zeros(pad, bool)])
            values = (np.concatenate([part, np.zeros(pad, part.dtype)]), real, np.concatenate([end, np.zeros(pad, bool)]))
            lists = [pa.FixedSizeListArray.from_arrays(pa.array(v), self.length) for v in values]
            self.out.write_batch(pa.RecordBatch.from_arrays(lists, schema=self.schema))
            at += step
        self.ids, self.ends, self.held = [ids[at:]], [ends[at:]], max(0, len(ids) - at)

    def close(self) -> None:
        self.flush(True)
        self.out.close()


class Sequences:
    """Random access to the sequences of a shard, batch by batch; views of its bytes where the file is local and so mapped.

    All batches but the last take the same number of bytes, so any of them is found without reading those before.
    """

    def __init__(self, uri: str) -> None:
        fs, path = pyarrow.fs.FileSystem.from_uri(uri)
        self.source = pa.memory_map(path) if isinstance(fs, pyarrow.fs.LocalFileSystem) else fs.open_input_file(path)
        self.schema = pa.ipc.read_schema(pa.ipc.read_message(self.source))
        self.begin, self.kept = self.source.tell(), (-1, None)
        body = self.source.size() - self.begin - END_BYTES
        self.step, self.rows = body, 0
        if body > 0:
            self.kept = 0, pa.ipc.read_record_batch(pa.ipc.read_message(self.source), self.schema)
            self.step, self.rows = self.source.tell() - self.begin, self.kept[1].num_rows
        self.batches = -(-body // self.step) if body > 0 else 0

    def batch(self, i: int) -> pa.RecordBatch:
        if self.kept[0] != i:
            self.source.seek(self.begin + i * self.step)
            self.kept = i, pa.ipc.read_record_batch(pa.ipc.read_message(self.source), self.schema)
        return self.kept[1]

    def __len__(self) -> int:
        return (self.batches - 1) * self.rows + self.batch(self.batches - 1).num_rows if self.batches else 0

    def __getitem__(self, i: int) -> np.ndarray:
        column = self.batch(i // self.rows).column("ids")
        return column.values.to_numpy()[i % self.rows * column.type.list_size :][: column.type.list_size]

    def column(self, name: str, batch: int) -> np.ndarray:
        return self.batch(batch).column(name).values.to_numpy(zero_copy_only=name == "ids")


def write(docs: DataFrame, path: str, folder: str, end_id: int = END_ID) -> DataFrame:
    """Writes the shards; shard, docs and n_tokens of each."""
    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("_h"))
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ordered = ordered.repartitionByRange(-(-total // SHARD_BYTES) or 1, "doc_id", "_h").sortWithinPartitions("doc_id", "_h").select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, shard = library_encoder(path), TaskContext.get().partitionId()
        fs, base = pyarrow.fs.FileSystem.from_uri(folder)
        own, writer, named, start, rows = uuid.uuid4().hex, None, None, 0, 0
        for b in chunks(batches, "text"):
            ids, sizes = encoder.encode([x or "" for x in b.column("text").to_pylist()])
            place = np.cumsum(sizes)
            ids = np.insert(ids.astype(np.uint32), place, end_id)
            sizes = sizes + 1
            ends = np.zeros(len(ids), bool)
            ends[np.cumsum(sizes) - 1] = True
            if writer is None:
                sinks = [fs.open_output_stream(f"{base}/_{own}-{x}") for x in ("ids", "docs")]
                writer = Writer(sinks[0], pa.uint16() if encoder.vocabulary <= 1 << 16 else pa.uint32())
                named = pa.ipc.new_stream(sinks[1], DOCS)
            writer.add(ids, ends)
            starts = start + np.cumsum(sizes) - sizes
            named.write_batch(pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(starts), pa.array(sizes)], schema=DOCS))
            start, rows = start + len(ids), rows + b.num_rows
        if writer is not None:
            writer.close()
            named.close()
            for sink, x in zip(sinks, ("ids", "docs"), strict=True):
                sink.close()
                fs.move(f"{base}/_{own}-{x}", f"{base}/shard-{shard:06d}.{x}.arrow")
            yield pa.RecordBatch.from_arrays([pa.array([shard]), pa.array([rows]), pa.array([start])], ["shard", "docs", "n_tokens"])

    fs, base = pyarrow.fs.FileSystem.from_uri(folder)
    fs.create_dir(base, recursive=True)
    return stored(ordered.mapInArrow(released(run), "shard long, docs long, n_tokens long"), "shards")


def read(spark: SparkSession, folder: str, shards: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, from the files; shards: what write() returned."""
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    bases = shards.select("shard", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).alias("base"))
    last = (shards.agg(F.max("shard")).first()[0] or 0) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pyarrow.fs.FileSystem.from_uri(folder)
        for shard in (x for b in batches for x in b.column("shard").to_pylist()):
            name = f"shard-{shard:06d}"
            if fs.get_file_info(f"{base}/{name}.ids.arrow").type != pyarrow.fs.FileType.File:
                continue
            file = Sequences(f"{folder}/{name}.ids.arrow")
            with fs.open_input_file(f"{base}/{name}.docs.arrow") as f:
                known = pa.ipc.open_stream(f).read_all()
            crc, sizes, rest = [], [], np.zeros(0, "<u4")
            for k in range(file.batches):
                real, end = file.column("real", k), np.flatnonzero(file.column("end", k)) + 1
                ids = file.column("ids", k)[real].astype("<u4")
                at = 0
                for to in end.tolist():
                    part = np.concatenate([rest, ids[at:to]]) if len(rest) else ids[at:to]
                    crc.append(zlib.crc32(part.tobytes()))
                    sizes.append(len(part))
                    rest, at = rest[:0], to
                rest = np.concatenate([rest, ids[at:]])
            starts = np.cumsum(sizes) - sizes
            if known.num_rows != len(sizes) or (known["n_tokens"].to_numpy() != sizes).any():
                raise ValueError(f"{folder}/{name} is damaged")
            for at in range(0, len(sizes), 50_000):
                cut = slice(at, at + 50_000)
                n = len(sizes[cut])
                yield pa.RecordBatch.from_arrays([pa.array([shard] * n, pa.int64()), known["doc_id"].slice(at, n).combine_chunks(), pa.array(starts[cut].astype(np.int64)), pa.array(sizes[cut], pa.int64()), pa.array(crc[cut], pa.int64())], ["shard", "doc_id", "local", "n_tokens", "ids_crc32"])

    found = spark.range(0, last, 1, last).select(F.col("id").alias("shard")).mapInArrow(released(run), "shard long, doc_id long, local long, n_tokens long, ids_crc32 long")
    return found.join(sized(bases, 16), "shard").select("doc_id", (F.col("base") + F.col("local")).alias("start"), "n_tokens", "ids_crc32")


def op9_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    folder = work_dir(spark, "token-file")
    if "://" not in folder:
        folder = f"file://{folder}"
    return read(spark, folder, write(documents(spark, sf_dir, "doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"), folder))
