"""Forming commit batches from request queues: by count, or greedily by count and bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def by_count(number: Column, most: int) -> Column:
    """Batch number of the request that stands at place 0, 1, 2, ... of its queue."""
    return F.floor(number / most).cast("long")


def by_bytes(requests: DataFrame, most: int, most_bytes: int) -> DataFrame:
    """requests (store, seq, bytes, barrier) with `batch`, counting from 0 in each store.

    A batch takes requests in order up to `most`, and stops before its bytes go over most_bytes (0: no limit),
    but always takes its first. A barrier (a compaction) stands in a batch of its own. Each store is one queue
    and so strictly sequential; it's streamed in sorted order with a state of a few numbers, never gathered.
    """
    from pyspark.sql.types import LongType, StructField, StructType

    schema = StructType([*requests.schema.fields, StructField("batch", LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, batch, count, used = object(), 0, 0, 0
        for b in batches:
            out = np.empty(b.num_rows, np.int64)
            stores, sizes = b.column("store"), b.column("bytes").to_numpy(zero_copy_only=False).astype(np.int64)
            alone = np.flatnonzero(b.column("barrier").to_numpy(zero_copy_only=False))
            ends = np.append(np.flatnonzero(pa.compute.not_equal(stores[1:], stores[:-1]).to_numpy(zero_copy_only=False)) + 1, b.num_rows)
            run_bytes = np.concatenate([[0], np.cumsum(sizes)])
            at = 0
            for end in ends.tolist():
                if at < end and (own := stores[at].as_py()) != store:
                    store, batch, count, used = own, 0, 0, 0
                while at < end:  # a batch, or what the rows before have left of it, at a time
                    k = int(np.searchsorted(alone, at))
                    barrier = int(alone[k]) if k < len(alone) else end
                    if barrier == at:
                        batch += count > 0
                        out[at] = batch
                        at, count, used = at + 1, most, 0
                        continue
                    to = min(end, barrier, at + most - count)
                    if most_bytes:  # as many as stay within the bytes; the first of a batch always goes in
                        fits = int(np.searchsorted(run_bytes, run_bytes[at] + most_bytes - used, side="right")) - 1
                        to = min(to, max(fits, at + (count == 0)))
                    if to <= at:
                        batch, count, used = batch + 1, 0, 0
                        continue
                    out[at:to] = batch
                    count, used, at = count + to - at, used + int(run_bytes[to] - run_bytes[at]), to
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out)], schema=b.schema.append(pa.field("batch", pa.int64())))

    return requests.repartition("store").sortWithinPartitions("store", "seq").mapInArrow(run, schema)
