"""Benchmark results and metrics as JSON: sources and sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MICROBENCH = "microbench-"
CASE = "name string, duration_s double, ops_per_s double, operations long, bytes long"


def result_files(spark: SparkSession, folder: str, microbench: bool = False) -> DataFrame:
    """file_name and text of the .json files, either the microbench ones or all others."""
    df = spark.read.option("pathGlobFilter", "*.json").text(folder, wholetext=True).select(F.col("_metadata.file_name").alias("file_name"), F.col("value").alias("json"))
    ours = F.col("file_name").startswith(MICROBENCH)
    return df.where(ours if microbench else ~ours)


def first_number(json: Column, key: str) -> Column:
    """The number after the first occurrence of the key, however deep; raises where there is none."""
    found = F.regexp_extract(json, rf'"{key}"\s*:\s*(-?[0-9.eE+-]+)', 1)
    return F.when(found == "", F.raise_error(F.lit(f"no {key}")).cast("double")).otherwise(found.cast("double"))


def benchmark_results(files: DataFrame, measures: list[str]) -> DataFrame:
    return files.select("file_name", *(first_number(F.col("json"), m).alias(m) for m in measures))


def microbench_cases(files: DataFrame) -> DataFrame:
    parsed = F.from_json("json", f"cases array<struct<{CASE.replace(' string', ':string').replace(' double', ':double').replace(' long', ':long')}>>")
    return files.select("file_name", F.posexplode(parsed["cases"]).alias("position", "c")).select("file_name", "position", "c.*")


def to_line(columns: dict[str, Column], label: str = "") -> Column:
    """`a=1 b=2`, booleans as 1 and 0, after the label if there is one."""
    pairs = (F.concat(F.lit(f"{k}="), v.cast("string")) for k, v in columns.items())
    return F.concat_ws(" ", *([F.lit(label)] if label else []), *pairs)


def to_json(df: DataFrame, name: str = "json", columns: dict[str, str] | None = None) -> DataFrame:
    """A row as one JSON object in the order of its columns, or of columns (JSON name to column)."""
    fields = [F.col(c).alias(n) for n, c in (columns or {c: c for c in df.columns}).items()]
    return df.select(F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}).alias(name))


#: The metrics, in the order in which they're written; a histogram of 12 counts is the last.
METRICS = [
    "read_requests", "enqueued_write_requests", "committed_write_requests", "committed_write_batches", "compact_requests", "wal_fsync_calls", "wal_bytes_written",
    "wal_bytes_since_compaction", "live_wal_bytes_since_compaction", "obsolete_wal_bytes_since_compaction", "last_committed_batch_size", "max_committed_batch_size",
    "last_committed_batch_wal_bytes", "max_committed_batch_wal_bytes", "pending_queue_depth", "max_pending_queue_depth", "manual_compactions_completed", "auto_compactions_completed",
    "adaptive_batches_completed", "adaptive_flush_batches_completed", "adaptive_latency_target_batches_completed", "adaptive_fsync_pressure_batches_completed",
    "adaptive_read_heavy_batches_completed", "adaptive_compaction_pressure_batches_completed", "adaptive_wal_growth_batches_completed",
    "adaptive_objective_short_delay_batches_completed", "adaptive_objective_long_delay_batches_completed", "adaptive_objective_throughput_batches_completed",
    "writer_wait_events", "writer_wait_time_us", "last_effective_batch_delay_us", "min_effective_batch_delay_us", "max_effective_batch_delay_us",
    "observed_fsync_pressure_per_1000_writes", "last_objective_pressure_score", "last_objective_cost_score", "last_objective_throughput_score", "last_objective_balance_score",
    "last_objective_mode", "total_snapshot_bytes_written", "total_wal_bytes_reclaimed_by_compaction", "approx_write_latency_p50_us", "approx_write_latency_p95_us",
    "approx_write_latency_p99_us", "recent_read_requests", "recent_write_requests", "recent_read_ratio_per_1000_ops", "recent_observed_write_latency_p95_us", "recent_peak_queue_depth",
    "recent_avg_batch_size", "recent_batch_fill_per_1000", "recent_avg_batch_wal_bytes", "recent_window_batch_count", "observed_obsolete_wal_ratio_percent", "write_latency_histogram",
]
#: Names of an inspection's counts in its line; the last three only of a log that isn't empty.
INSPECT_LINE = {
    "snapshot_magic_ok": "magic_ok", "snapshot_version": "version", "snapshot_entries": "entries", "snapshot_int_keys": "int_keys", "snapshot_string_keys": "string_keys",
    "snapshot_binary_keys": "binary_keys", "snapshot_unknown_key_types": "unknown_keys", "snapshot_entry_magic_ok": "entry_magic_ok", "snapshot_truncated": "truncated", "snapshot_size": "size",
}
LOG_LINE = {
    "wal_records": "records", "wal_put_records": "puts", "wal_delete_records": "deletes", "wal_int_keys": "log_int_keys", "wal_string_keys": "log_string_keys", "wal_binary_keys": "log_binary_keys",
    "wal_unknown_key_types": "log_unknown_keys", "wal_unknown_record_types": "unknown_types", "wal_truncated": "log_truncated", "rewrite_recommended": "rewrite_recommended",
}
#: The JSON names of trends by measure, and the fields of a stress run's summary.
TREND_JSON = {"write": "write_ops_per_s", "read": "read_ops_per_s", "latency": "write_latency_us"}
STRESS_JSON = [
    "profile", "duration_seconds", "writer_count", "reader_count", "compactor_count", "recovery_reopen_cycles", "committed_write_requests", "put_operations", "delete_operations",
    "batch_requests", "batch_put_operations", "batch_delete_operations", "final_live_objects", "max_pending_queue_depth", "manual_compactions_completed", "auto_compactions_completed",
    "observed_fsync_pressure_per_1000_writes", "last_effective_batch_delay_us",
]
#: The names of the seven ratios, and of their limits, in a comparison's line.
COMPARE_LINE = {
    "write_ops_per_s": ("write_ratio_pct", "min_write_ratio_pct"), "read_ops_per_s": ("read_ratio_pct", "min_read_ratio_pct"), "avg_write_latency_us": ("latency_ratio_pct", "max_latency_ratio_pct"),
    "approx_write_latency_p95_us": ("p95_latency_ratio_pct", "max_p95_latency_ratio_pct"), "approx_write_latency_p99_us": ("p99_latency_ratio_pct", "max_p99_latency_ratio_pct"),
    "observed_fsync_pressure_per_1000_writes": ("fsync_pressure_ratio_pct", "max_fsync_pressure_ratio_pct"), "recent_batch_fill_per_1000": ("batch_fill_ratio_pct", "min_batch_fill_ratio_pct"),
}


def inspect_line() -> Column:
    """The line of a row of inspection counts; magic in hexadecimal."""
    col = lambda names: {n: F.col(c) for n, c in names.items()}
    log = F.when(F.col("log_exists") == 0, to_line({"wal_exists": F.lit(0)} | {n: F.lit(0) for n in list(LOG_LINE)[:-1]}))
    log = log.when(F.col("log_size") == 0, to_line({"wal_exists": F.lit(1), "wal_empty": F.lit(1)} | {n: F.lit(0) for n in list(LOG_LINE)[:-1]}))
    head = {"wal_exists": F.lit(1), "wal_empty": F.lit(0), "wal_magic": F.concat(F.lit("0x"), F.lower(F.hex("log_magic"))), "wal_version": F.col("log_version"), "wal_first_type": F.col("first_type"), "wal_size": F.col("log_size")}
    log = log.otherwise(to_line(head | {n: F.col(c) for n, c in list(LOG_LINE.items())[:-1]}))
    return F.concat_ws(" ", F.lit("snapshot_exists=1"), to_line(col(INSPECT_LINE)), log, to_line({"rewrite_recommended": F.col("rewrite_recommended")}))


def compare_line(baseline: Column, candidate: Column, gates: dict[str, tuple[float, str]]) -> Column:
    """The line of a row of compare_baseline()."""
    ratios = {COMPARE_LINE[m][0]: F.col(f"{m}_pct") for m in gates}
    limits = {COMPARE_LINE[m][1]: F.lit(limit) for m, (limit, _) in gates.items()}
    return to_line({"baseline": baseline, "candidate": candidate} | ratios | limits | {"status": F.when(F.col("passed"), "pass").otherwise("fail")})


def _trend_fields(measures: dict[str, str]) -> dict[str, str]:
    out = {n: n for n in ("count", "oldest_file", "latest_file", "recent_window_count")}
    for m, n in measures.items():
        out |= {f"{k}_{n}": f"{k}_{m}" for k in ("avg", "min", "max", "recent_avg")}
    for m in measures:
        out |= {f"latest_vs_oldest_{m}_ratio_pct": f"latest_vs_oldest_{m}_pct", f"{m}_trend": f"{m}_trend", f"latest_vs_recent_avg_{m}_ratio_pct": f"latest_vs_recent_{m}_pct", f"recent_{m}_trend": f"recent_{m}_trend"}
    return out


def trend_line() -> Column:
    """The line of a row of baseline_trend()."""
    return to_line({n: F.col(c) for n, c in _trend_fields(TREND_JSON).items()})


def trend_json(trend: DataFrame) -> DataFrame:
    return to_json(trend, columns=_trend_fields(TREND_JSON))


def case_array(cases: DataFrame, fields: dict[str, str], order: str) -> DataFrame:
    """One row: {"cases":[...]}; a row of cases is a benchmark case, of which there are few."""
    one = F.struct(F.col(order).alias("_at"), F.struct(*(F.col(c).alias(n) for n, c in fields.items())).alias("c"))
    every = cases.agg(F.transform(F.array_sort(F.collect_list(one)), lambda x: x["c"]).alias("cases"))
    return to_json(every)


def case_trend_json(trend: DataFrame) -> DataFrame:
    fields = {"name": "name"} | {f"{k}_ops_per_s": f"{k}_ops" for k in ("avg", "min", "max", "recent_avg")}
    fields |= {"latest_vs_oldest_ratio_pct": "latest_vs_oldest_ops_pct", "latest_vs_recent_avg_ratio_pct": "latest_vs_recent_ops_pct", "trend": "ops_trend", "recent_trend": "recent_ops_trend"}
    return case_array(trend, fields, "name")


def microbench_json(cases: DataFrame) -> DataFrame:
    """cases: position, name, duration_s, ops_per_s, operations, bytes."""
    return case_array(cases, {n.split()[0]: n.split()[0] for n in CASE.split(", ")}, "position")


def benchmark_json(label: str, workload: dict[str, int], summary: dict[str, float], options: DataFrame, metrics: DataFrame) -> DataFrame:
    """The result of a benchmark as nested JSON; options and metrics are frames of one row."""
    one = options.select(F.struct(*options.columns).alias("options"), F.lit(1).alias("_one")).join(metrics.select(F.struct(*METRICS).alias("metrics"), F.lit(1).alias("_one")), "_one")
    lits = lambda d: F.struct(*(F.lit(v).alias(k) for k, v in d.items()))
    return to_json(one.select(F.lit(label).alias("label"), lits(workload).alias("workload"), lits(summary).alias("summary"), "options", "metrics"))


def stress_json(summary: DataFrame) -> DataFrame:
    return to_json(summary, columns={n: n for n in STRESS_JSON})


def stress_line() -> Column:
    return to_line({n: F.col(n) for n in STRESS_JSON if n not in ("writer_count", "reader_count", "compactor_count")}, "[STRESS]")


def microbench_line() -> Column:
    return to_line({n.split()[0]: F.col(n.split()[0]) for n in CASE.split(", ")}, "[MICROBENCH]")


def qualified(summary: DataFrame, required: int = 10_000_000) -> DataFrame:
    """summary with status: pass if put_operations reaches what is required."""
    return summary.withColumn("status", F.when(F.col("put_operations") >= required, "pass").otherwise("fail"))
