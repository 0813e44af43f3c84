"""Bytes of the log, latency histograms and the workload windows of recent batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.functions.numbers import BOUNDS, bucket_bound, latency_bucket, obsolete_percent, record_bytes, whole
from tidewell.operators.ordered import running_sum, sliding

BUCKETS = len(BOUNDS) + 1


def sized_log(changes: DataFrame) -> DataFrame:
    return changes.withColumn("bytes", record_bytes(F.col("op"), F.col("key_enc"), F.col("value")))


def request_bytes(changes: DataFrame) -> DataFrame:
    """Log bytes of each request, its changes in one batch."""
    return sized_log(changes).groupBy(F.col("seq").alias("request_id")).agg(F.count("*").alias("operations"), F.sum("bytes").alias("wal_bytes"))


def log_account(changes: DataFrame) -> DataFrame:
    """One row: total, live (the latest record of each key, deletes too), obsolete, percent."""
    by_key = sized_log(changes).groupBy("key_enc").agg(F.max_by("bytes", F.struct("seq", "sub_seq")).alias("live"), F.sum("bytes").alias("total"))
    total, live = F.coalesce(F.sum("total"), F.lit(0)), F.coalesce(F.sum("live"), F.lit(0))
    sums = by_key.agg(total.alias("total_bytes"), live.alias("live_bytes"))
    t, v = F.col("total_bytes"), F.col("live_bytes")
    return sums.select(t, v, F.greatest(t - v, F.lit(0)).alias("obsolete_bytes"), obsolete_percent(t, v).alias("obsolete_percent"))


def last_before(rows: DataFrame, by: list[str], at: str, value: str, name: str, chunk: int = 1 << 16) -> DataFrame:
    """rows with `name`, the value of the row of the same `by` before it in the order of `at`, 0 for the first.

    A hot `by` is ordered in chunks of `at`; the first row of each chunk gets the last value of the chunk before.
    """
    part = rows.withColumn("_chunk", F.expr(f"{at} div {chunk}"))
    ends = part.groupBy(*by, "_chunk").agg(F.max_by(value, at).alias("_end"), F.min(at).alias(at))
    carried = ends.select(*by, at, F.lag("_end", 1, 0).over(Window.partitionBy(*by).orderBy("_chunk")).alias("_carry"))
    own = part.withColumn(name, F.lag(value).over(Window.partitionBy(*by, "_chunk").orderBy(at)))
    return own.join(carried, [*by, at], "left").withColumn(name, F.coalesce(name, "_carry")).drop("_chunk", "_carry")


def running_account(changes: DataFrame, batch: Column) -> DataFrame:
    """Total, live and obsolete log bytes after each batch, had nothing been compacted.

    Within a batch a key's steps add up to its last record less the one before the batch, so that a key is one row
    for each batch before anything is ordered.
    """
    rows = sized_log(changes).withColumn("batch", batch).groupBy("key_enc", "batch").agg(F.sum("bytes").alias("bytes"), F.max_by("bytes", F.struct("seq", "sub_seq")).cast("long").alias("last"))
    steps = last_before(rows, ["key_enc"], "batch", "last", "before").groupBy("batch").agg(F.sum("bytes").alias("bytes"), F.sum(F.col("last") - F.col("before")).alias("step"))
    sums = running_sum(steps, "batch", {"total_bytes": "bytes", "live_bytes": "step"})
    t, v = F.col("total_bytes"), F.col("live_bytes")
    return sums.select("batch", t, v, F.greatest(t - v, F.lit(0)).alias("obsolete_bytes"), obsolete_percent(t, v).alias("obsolete_percent"))


def histogram(samples: DataFrame, column: str) -> DataFrame:
    """bucket 0..11 and n, also where n is 0."""
    counts = samples.groupBy(latency_bucket(F.col(column)).alias("bucket")).agg(F.count("*").alias("n"))
    every = samples.sparkSession.range(0, BUCKETS, 1, 1).select(F.col("id").cast("int").alias("bucket"))
    return every.join(counts, "bucket", "left").select("bucket", F.coalesce("n", F.lit(0)).alias("n"))


def percentile(counts: Column, numerator: int, denominator: int) -> Column:
    """The bound of the first bucket at which the running count reaches the share; 0 without samples. counts: an array."""
    running = F.transform(F.sequence(F.lit(1), F.lit(BUCKETS)), lambda k: F.aggregate(F.slice(counts, F.lit(1), k), F.lit(0).cast("long"), lambda a, b: a + b))
    return F.element_at(F.transform(F.array(running), lambda r: _reached(r, numerator, denominator)), 1)


def _reached(running: Column, numerator: int, denominator: int) -> Column:
    total = F.element_at(running, -1)
    target = whole(total * numerator + denominator - 1, F.lit(denominator))
    bucket = F.size(F.filter(running, lambda c: c < target))
    return F.when(total == 0, F.lit(0).cast("long")).otherwise(bucket_bound(bucket))


def percentiles(hist: DataFrame) -> DataFrame:
    """p50, p95 and p99 of a histogram of (bucket, n)."""
    counts = F.array(*(F.coalesce(F.sum(F.when(F.col("bucket") == k, F.col("n"))), F.lit(0)).cast("long") for k in range(BUCKETS)))
    return hist.agg(counts.alias("counts")).select(*(percentile(F.col("counts"), p, 100).alias(f"p{p}_us") for p in (50, 95, 99)))


#: Bits of a count, and counts in a long, in the running counts of recent_percentile().
COUNT_BITS, PACKED = 20, 3
#: Rows of a chunk there; with the rows before it a bucket's count stays within COUNT_BITS.
RECENT_CHUNK = 1 << 13


def recent_percentile(samples: DataFrame, at: str, column: str, rows: int = 512, share: int = 95) -> DataFrame:
    """After each sample the percentile of the last `rows` samples; at counts 0, 1, 2, ...

    Counts of the last `rows` are running counts less those `rows` before: two frames that only grow, over counts
    packed by threes into longs.
    """
    chunk = max(RECENT_CHUNK, rows)
    if 2 * chunk >= 1 << COUNT_BITS:
        raise ValueError("too many rows for the packed counts")
    bucket = latency_bucket(F.col(column))
    words = range(-(-BUCKETS // PACKED))
    unit = F.array(*(F.lit(1 << COUNT_BITS * k).cast("long") for k in range(PACKED)))
    one = lambda j: F.when(F.floor(bucket / PACKED) == j, F.element_at(unit, bucket % PACKED + 1)).otherwise(F.lit(0).cast("long"))
    marked = samples.select(at, *(one(j).alias(f"_p{j}") for j in words))
    grown = lambda w, end: w.rowsBetween(Window.unboundedPreceding, end)

    def over(j: int):
        def make(frame) -> Column:
            by = Window.partitionBy("_chunk").orderBy(at)
            return F.sum(f"_p{j}").over(grown(by, 0)) - F.coalesce(F.sum(f"_p{j}").over(grown(by, -rows)), F.lit(0))

        return make

    out = sliding(marked, at, rows, {f"_n{j}": over(j) for j in words}, chunk)
    mask = F.lit((1 << COUNT_BITS) - 1).cast("long")
    counts = F.array(*(F.shiftright(F.col(f"_n{k // PACKED}"), k % PACKED * COUNT_BITS).bitwiseAND(mask) for k in range(BUCKETS)))
    return out.select(at, percentile(counts, share, 100).alias("recent_p95_us"))


def recent_batches(batches: DataFrame, rows: int = 64, target: int = 0, max_batch_size: int = 64) -> DataFrame:
    """The workload over the last `rows` batches, after each; batches: batch (0, 1, 2, ...), batch_size, wal_bytes, queue_depth, reads."""
    sums = {
        "n": lambda w: F.count("*").over(w),
        "writes": lambda w: F.sum("batch_size").over(w),
        "bytes": lambda w: F.sum("wal_bytes").over(w),
        "recent_read_requests": lambda w: F.sum("reads").over(w),
        "recent_peak_queue_depth": lambda w: F.max("queue_depth").over(w),
    }
    r = sliding(batches, "batch", rows, sums)
    n, writes, reads = F.col("n"), F.col("writes"), F.col("recent_read_requests")
    average = whole(writes, n)
    return r.select(
        "batch", n.alias("recent_window_batch_count"), writes.alias("recent_write_requests"), reads,
        average.alias("recent_avg_batch_size"), whole(F.col("bytes"), n).alias("recent_avg_batch_wal_bytes"), F.col("recent_peak_queue_depth").cast("long").alias("recent_peak_queue_depth"),
        whole(reads * 1000, reads + writes).alias("recent_read_ratio_per_1000_ops"),
        F.least(F.lit(1000), whole(average * 1000, F.lit(max(1, target or max_batch_size)))).cast("long").alias("recent_batch_fill_per_1000"),
        whole(n * 1000 + writes - 1, writes).alias("observed_fsync_pressure_per_1000_writes"),
    )


def effective_read_ratio(reads: Column, pending: Column, writes: Column) -> Column:
    """The recent read ratio with the reads since the last batch."""
    return whole((reads + pending) * 1000, reads + pending + writes)


def read_delta(total_reads: Column, before: Column) -> Column:
    return F.greatest(total_reads - before, F.lit(0))
