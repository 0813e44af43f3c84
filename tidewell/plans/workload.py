"""Generated workloads: a mixed change log, a stress run that checks itself, and five small benchmarks."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.functions.keys import int_key, string_key
from tidewell.functions.options import STRESS, STRESS_LOADS
from tidewell.operators.accounting import recent_batches, request_bytes
from tidewell.operators.state import current_state, mismatches, mutation, range_scan
from tidewell.sources import files
from tidewell.streaming.changelog import StreamedState


def mixed(spark: SparkSession, requests: int, keys: int, width: int = 1, seed: int = 1, deletes: int = 10) -> DataFrame:
    """A change log of `requests` requests of `width` changes each on int keys; `deletes` in a hundred delete. The seed fixes it all."""
    drawn = lambda salt, n: F.pmod(F.xxhash64("seq", "sub_seq", F.lit(seed), F.lit(salt)), F.lit(n))
    each = spark.range(requests).select(F.col("id").alias("seq"), F.explode(F.sequence(F.lit(0), F.lit(width - 1))).alias("sub_seq"))
    op = F.when(drawn(1, 100) < deletes, 2).otherwise(1)
    value = F.when(op == 1, F.encode(F.concat_ws(":", F.lit("v"), "seq", "sub_seq"), "UTF-8"))
    return each.select(*mutation(F.col("seq"), op, int_key(drawn(2, keys)), value, F.col("sub_seq")))


def stress(spark: SparkSession, folder: str, name: str, requests: int = 2000, batches: int = 8, seed: int = 1) -> DataFrame:
    """Runs a profile's workload through a store, reopened in between, and raises if the state isn't that of the log. A row of totals."""
    load, options = STRESS_LOADS[name], STRESS[name].sane()
    began = time.time()
    log = mixed(spark, requests, load["writer_count"] * load["keys_per_writer"], load["batch_width"], seed)
    step, reopen = -(-requests // batches), max(1, batches // load["recovery_reopen_cycles"])
    store = StreamedState(spark, folder, options)
    for n in range(batches):
        store.apply(log.where((F.col("seq") >= n * step) & (F.col("seq") < (n + 1) * step)), n)
        if n % reopen == reopen - 1:
            store = StreamedState(spark, folder, options)
            want = log.where(F.col("seq") < (n + 1) * step).groupBy("key_enc").agg(F.max_by(F.struct("op", "value"), F.struct("seq", "sub_seq")).alias("last"))
            want = want.select("key_enc", F.when(F.col("last.op") == 1, F.col("last.value")).alias("value"))
            if not mismatches(want, store.state()).isEmpty():
                raise AssertionError(f"batch {n}: the store's state differs from the log's")
    for _ in range(load["compactor_count"]):
        store.compact()
    done = {r.kind: r.n for r in store.compactions().groupBy("kind").agg(F.count("*").alias("n")).collect()}
    puts, dels = (F.count_if(F.col("op") == k) for k in (1, 2))
    one = log.agg(F.countDistinct("seq").alias("committed_write_requests"), puts.alias("batch_put_operations"), dels.alias("batch_delete_operations"))
    sizes = request_bytes(log).groupBy(F.expr(f"request_id div {options.max_batch_size}").alias("batch")).agg(F.count("*").alias("batch_size"), F.sum("wal_bytes").alias("wal_bytes"), F.count("*").alias("queue_depth"), F.lit(0).alias("reads"))
    recent = recent_batches(sizes, options.adaptive_recent_window_batches, max_batch_size=options.max_batch_size)
    recent = recent.agg(F.max("recent_peak_queue_depth").alias("max_pending_queue_depth"), F.max_by("observed_fsync_pressure_per_1000_writes", "batch").alias("observed_fsync_pressure_per_1000_writes"))
    known = {"profile": name, "duration_seconds": int(time.time() - began), **{k: load[k] for k in ("writer_count", "reader_count", "compactor_count", "recovery_reopen_cycles")}}
    known |= {"put_operations": 0, "delete_operations": 0, "batch_requests": requests, "final_live_objects": store.state().count(), "manual_compactions_completed": done.get("manual", 0)}
    known |= {"auto_compactions_completed": done.get("auto", 0), "last_effective_batch_delay_us": options.max_batch_delay_us}
    return one.crossJoin(F.broadcast(recent)).select("*", *(F.lit(v).alias(k) for k, v in known.items()))  # one row each


def microbench(spark: SparkSession, folder: str, requests: int = 500) -> DataFrame:
    """position, name, duration_s, ops_per_s, operations and bytes of appending, scanning, recovering, compacting and rewriting."""
    rows: list[tuple] = []

    def case(name: str, operations: int, run: Callable[[], int]) -> None:
        began = time.time()
        size = run()
        spent = max(1e-6, time.time() - began)
        rows.append((len(rows), name, spent, operations / spent, operations, size))

    log, store = mixed(spark, requests, 1000), StreamedState(spark, f"{folder}/store")

    def append() -> int:
        store.apply(log, 0)
        return request_bytes(log).agg(F.sum("wal_bytes")).first()[0]

    def compact() -> int:
        store.compact()
        return store.compactions().agg(F.sum("snapshot_bytes")).first()[0]

    def rewrite() -> int:
        files.write_stores(log.withColumn("store", F.lit("one")), f"{folder}/old/logs", "log")
        files.create_if_missing(f"{folder}/old/snapshots/one")
        return files.rewritten(spark, f"{folder}/old", f"{folder}/new").agg(F.sum("bytes")).first()[0]

    names = spark.range(2000).select(string_key(F.concat(F.lit("scan:"), "id")).alias("key_enc"), F.encode(F.lit("x"), "UTF-8").alias("value"))
    case("wal_append", requests, append)
    case("scan", 1, lambda: range_scan(names, "scan:100", "scan:399").count())
    case("recovery", 1, lambda: StreamedState(spark, f"{folder}/store").state().count() * 0)
    case("compaction", 1, compact)
    case("rewrite", 1, rewrite)
    if current_state(log).count() != store.state().count():
        raise AssertionError("the store's state differs from the log's")
    return spark.createDataFrame(rows, "position int, name string, duration_s double, ops_per_s double, operations long, bytes long")
