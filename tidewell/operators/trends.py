"""Regression gates and trends over benchmark results; a file is a row, ordered by its name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.functions.numbers import latency_trend, throughput_trend

#: Per measure the gate's percentage of the baseline, and whether it's a floor or a ceiling.
GATES = {
    "write_ops_per_s": (85.0, "floor"),
    "read_ops_per_s": (85.0, "floor"),
    "avg_write_latency_us": (125.0, "ceiling"),
    "approx_write_latency_p95_us": (150.0, "ceiling"),
    "approx_write_latency_p99_us": (175.0, "ceiling"),
    "observed_fsync_pressure_per_1000_writes": (150.0, "ceiling"),
    "recent_batch_fill_per_1000": (75.0, "floor"),
}
#: Per case the least percentage of the baseline's operations a second; for others the default.
CASE_FLOORS, CASE_FLOOR = {"compaction": 75.0, "rewrite": 75.0, "recovery": 80.0}, 80.0
MEASURES = {"write": "write_ops_per_s", "read": "read_ops_per_s", "latency": "avg_write_latency_us"}


def _positive(value: Column, what: str) -> Column:
    return F.when(value > 0, value).otherwise(F.raise_error(F.lit(f"baseline {what} must be positive")).cast("double"))


def compare_baseline(pairs: DataFrame, gates: dict[str, tuple[float, str]] = GATES) -> DataFrame:
    """pairs: base and cand, structs of the measures. Ratios in percent, pass, and the exit status 0 or 2."""
    ratio = {m: F.col(f"cand.{m}") / _positive(F.col(f"base.{m}"), m) * 100 for m in gates}
    out = pairs.withColumns({f"{m}_pct": r for m, r in ratio.items()})
    ok = F.lit(True)
    for m, (limit, kind) in gates.items():
        ok = ok & ((F.col(f"{m}_pct") >= limit) if kind == "floor" else (F.col(f"{m}_pct") <= limit))
    return out.withColumn("passed", ok).withColumn("status", F.when(F.col("passed"), 0).otherwise(2)).drop("base", "cand")


def compare_cases(base: DataFrame, cand: DataFrame, floors: dict[str, float] = CASE_FLOORS, default: float = CASE_FLOOR) -> DataFrame:
    """base, cand: position, name, ops_per_s. Of one name the last counts; a case that cand lacks raises, others of cand don't count."""
    last = lambda df, alias: df.groupBy("name").agg(F.max_by("ops_per_s", "position").alias(alias))
    joined = last(base, "base_ops").join(last(cand, "cand_ops"), "name", "left")
    got = F.when(F.col("cand_ops").isNull(), F.raise_error(F.lit("the candidate lacks a case of the baseline")).cast("double")).otherwise(F.col("cand_ops"))
    least = F.lit(default)
    for name, floor in floors.items():
        least = F.when(F.col("name") == name, floor).otherwise(least)
    ratio = got / _positive(F.col("base_ops"), "ops_per_s") * 100
    return joined.select("name", ratio.alias("ops_ratio_pct"), least.alias("min_ratio_pct")).withColumn("passed", F.col("ops_ratio_pct") >= F.col("min_ratio_pct")).orderBy("name")


def _percent(a: Column, b: Column) -> Column:
    return F.when(b == 0, 0.0).otherwise(a / b * 100)


def trend(files: DataFrame, recent: int, by: list[str], measures: dict[str, str]) -> DataFrame:
    """Min, max, average, average of the last `recent` files, latest against oldest and recent, for each group of `by`."""
    if recent < 1:
        raise ValueError("the recent window must hold a file at least")
    aggs = [F.count("*").alias("count"), F.min("file_name").alias("oldest_file"), F.max("file_name").alias("latest_file")]
    for name, m in measures.items():
        aggs += [F.min(m).alias(f"min_{name}"), F.max(m).alias(f"max_{name}"), F.avg(m).alias(f"avg_{name}")]
        aggs += [F.min_by(m, "file_name").alias(f"_first_{name}"), F.max_by(m, "file_name").alias(f"_last_{name}")]
    if by:  # a rank of `recent` at most is cut before the shuffle
        last = files.withColumn("_rank", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("file_name")))).where(F.col("_rank") <= recent)
    else:
        by, files = ["_all"], files.withColumn("_all", F.lit(0))
        last = files.orderBy(F.desc("file_name")).limit(recent)
    tail = last.groupBy(*by).agg(F.count("*").alias("recent_window_count"), *(F.avg(m).alias(f"recent_avg_{name}") for name, m in measures.items()))
    out = files.groupBy(*by).agg(*aggs).join(tail, by).drop("_all")
    for name in measures:
        kind = latency_trend if name == "latency" else throughput_trend
        last = F.col(f"_last_{name}")
        out = out.withColumn(f"latest_vs_oldest_{name}_pct", _percent(last, F.col(f"_first_{name}"))).withColumn(f"latest_vs_recent_{name}_pct", _percent(last, F.col(f"recent_avg_{name}")))
        out = out.withColumn(f"{name}_trend", kind(F.col(f"latest_vs_oldest_{name}_pct"))).withColumn(f"recent_{name}_trend", kind(F.col(f"latest_vs_recent_{name}_pct")))
    return out.drop(*(f"_{x}_{name}" for name in measures for x in ("first", "last")))


def baseline_trend(files: DataFrame, recent: int = 5) -> DataFrame:
    """files: file_name and the three measures."""
    return trend(files, recent, [], MEASURES)


def case_trend(cases: DataFrame, recent: int = 5) -> DataFrame:
    """cases: file_name, name, ops_per_s; the latest is the last file that has the case."""
    return trend(cases, recent, ["name"], {"ops": "ops_per_s"}).orderBy("name")
