"""A store's life as data: batches, the log's bytes since the last compaction, and compactions."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.functions.numbers import SNAPSHOT_BYTES, entry_bytes
from tidewell.functions.options import Options
from tidewell.operators.accounting import last_before
from tidewell.operators.ordered import running_sum

REPLAY = "store long, batch long, total_bytes long, live_bytes long, compacted boolean"


def replay(log: DataFrame, options: Options) -> DataFrame:
    """log: store, batch, seq, key_enc, bytes. For each store and batch the log's bytes since the last compaction, and whether one follows.

    After each batch the options decide whether the log is folded into the snapshot, which empties it and its
    accounting. Whether a record is still live depends on where the last compaction was, so a store is sequential;
    its rows are summed by batch and key first and streamed through a task, with a state of the keys since the last
    compaction, which the byte threshold bounds.
    """
    o = options.sane()
    most, percent = o.auto_compact_wal_bytes_threshold, o.auto_compact_invalid_wal_ratio_percent

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, total, live, latest, rows = None, 0, 0, {}, []

        def close() -> None:
            nonlocal total, live
            obsolete = max(total - live, 0)
            full = bool(most and total >= most) or bool(percent and total and obsolete * 100 >= total * percent)
            rows.append((*at, total, live, full))
            if full:
                total, live = 0, 0
                latest.clear()

        def out() -> pa.RecordBatch:
            cols = list(zip(*rows, strict=True)) or [[]] * 5
            rows.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, [*[pa.int64()] * 4, pa.bool_()], strict=True)], ["store", "batch", "total_bytes", "live_bytes", "compacted"])

        for b in batches:
            for store, batch, key, size, last in zip(*(b.column(c).to_pylist() for c in ("store", "batch", "key_enc", "bytes", "last")), strict=True):
                if (store, batch) != at:
                    if at:
                        close()
                        if at[0] != store:
                            total, live = 0, 0
                            latest.clear()
                    at = store, batch
                total, live = total + size, live + last - latest.get(key, 0)
                latest[key] = last
            yield out()
        if at:
            close()
            yield out()

    rows = log.groupBy("store", "batch", "key_enc").agg(F.sum("bytes").alias("bytes"), F.max_by("bytes", "seq").cast("long").alias("last"))
    rows = rows.select(F.col("store").cast("long").alias("store"), F.col("batch").cast("long").alias("batch"), "key_enc", "bytes", "last")
    return rows.repartition("store").sortWithinPartitions("store", "batch").mapInArrow(run, REPLAY)


def snapshot_sizes(log: DataFrame) -> DataFrame:
    """log: store, batch, seq, op, key_enc, value. The bytes a snapshot of each store would take after each batch."""
    last = F.max_by(F.struct("op", "value"), "seq")
    rows = log.groupBy("store", "batch", "key_enc").agg(last.alias("last"))
    rows = rows.select("store", "batch", "key_enc", F.when(F.col("last.op") == 1, entry_bytes(F.col("key_enc"), F.col("last.value"))).otherwise(0).cast("long").alias("size"))
    steps = last_before(rows, ["store", "key_enc"], "batch", "size", "before").groupBy("store", "batch").agg(F.sum(F.col("size") - F.col("before")).alias("step"))
    return running_sum(steps, "batch", {"entries": "step"}, by=["store"]).select("store", "batch", (F.col("entries") + SNAPSHOT_BYTES).alias("snapshot_bytes"))


def compaction_totals(replayed: DataFrame, sizes: DataFrame) -> DataFrame:
    """For each store: compactions, snapshot bytes written and log bytes reclaimed by them."""
    every = replayed.join(sizes, ["store", "batch"]).where("compacted")
    found = every.groupBy("store").agg(F.count("*").alias("compactions"), F.sum("snapshot_bytes").alias("snapshot_bytes_written"), F.sum("total_bytes").alias("log_bytes_reclaimed"))
    none = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return replayed.select("store").distinct().join(found, "store", "left").select("store", *map(none, ("compactions", "snapshot_bytes_written", "log_bytes_reclaimed")))
