"""The batch policy as a chain of column expressions: signals and options in, limits, delay and flags out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.functions.numbers import RECORD_BYTES, U32, deficit_score, signal_score, times, whole
from tidewell.functions.options import Options

#: The signals, all of type long.
SIGNALS = [
    "request_queue_depth", "recent_peak_queue_depth", "recent_read_ratio", "current_obsolete_ratio",
    "recent_avg_batch_size", "recent_avg_batch_wal_bytes", "observed_p95_us", "observed_fsync_pressure",
]
FLAGS = [
    "adaptive_batching", "adaptive_flush", "latency_target_adjusted", "fsync_pressure_adjusted", "read_heavy_adjusted",
    "compaction_pressure_adjusted", "wal_growth_adjusted", "objective_short_delay_adjusted", "objective_long_delay_adjusted",
]


def _boost(delay: Column, on: Column, factor: int, most: int) -> Column:
    longer = times(delay, F.lit(factor), U32)
    if most:
        longer = F.least(longer, F.lit(most).cast("long"))
    return F.when(on & (longer > 0), longer).otherwise(delay)


def with_policy(signals: DataFrame, options: Options) -> DataFrame:
    """signals with the policy's columns for one set of options."""
    o, c = options, F.col
    no = F.lit(False)
    depth, peak = c("request_queue_depth"), c("recent_peak_queue_depth")
    long = lambda x: F.lit(x).cast("long")
    least = long(o.adaptive_flush_min_batch_delay_us)
    df = signals

    busy = lambda limit: (depth >= limit) | (peak >= limit)
    batching = busy(o.adaptive_queue_depth_threshold) if o.adaptive_batching_enabled else no
    larger = max(1, min(o.max_batch_size * o.adaptive_batch_size_multiplier, 2**63 - 1))
    heavier = min(o.max_batch_wal_bytes * o.adaptive_batch_wal_bytes_multiplier, 2**63 - 1)
    df = df.withColumns({
        "adaptive_batching": batching,
        "max_batch_size": F.when(batching, long(larger)).otherwise(long(o.max_batch_size)),
        "max_batch_wal_bytes": F.when(batching, long(heavier)).otherwise(long(o.max_batch_wal_bytes)),
        "batch_delay_us": long(o.max_batch_delay_us),
        "observed_queue_depth": depth,
    })
    none = dict.fromkeys((f for f in FLAGS if f != "adaptive_batching"), no)
    if o.adaptive_objective_enabled:
        scale = o.adaptive_queue_depth_threshold if o.adaptive_batching_enabled else o.max_batch_size
        score = lambda value, s, w: signal_score(value, long(s), long(w))
        df = df.withColumns({
            "objective_pressure_score": score(F.greatest(depth, peak), scale, o.adaptive_objective_queue_weight)
            + score(c("observed_p95_us"), o.adaptive_latency_target_p95_us, o.adaptive_objective_latency_weight)
            + score(c("recent_read_ratio"), o.adaptive_read_heavy_read_per_1000_ops_threshold, o.adaptive_objective_read_weight),
            "objective_throughput_score": deficit_score(c("recent_avg_batch_size"), long(o.adaptive_objective_target_batch_size), long(o.adaptive_objective_throughput_weight)),
        })
        df = df.withColumn(
            "objective_cost_score",
            c("objective_throughput_score")
            + score(c("observed_fsync_pressure"), o.adaptive_fsync_pressure_per_1000_writes_threshold, o.adaptive_objective_fsync_weight)
            + score(c("current_obsolete_ratio"), o.adaptive_compaction_pressure_obsolete_ratio_percent_threshold, o.adaptive_objective_compaction_weight)
            + score(c("recent_avg_batch_wal_bytes"), o.adaptive_wal_growth_bytes_per_batch_threshold, o.adaptive_objective_wal_growth_weight),
        )
        pressure, cost, delay = c("objective_pressure_score"), c("objective_cost_score"), c("batch_delay_us")
        shorter = (pressure >= cost + o.adaptive_objective_short_delay_score_threshold) & (delay > least)
        longer = ~shorter & (cost >= pressure + o.adaptive_objective_long_delay_score_threshold) if o.adaptive_objective_long_delay_multiplier > 1 else no
        df = df.withColumns(none | {"objective_short_delay_adjusted": shorter, "objective_long_delay_adjusted": longer})
        shorter, longer = c("objective_short_delay_adjusted"), c("objective_long_delay_adjusted")
        cut = F.greatest(least, whole(delay, long(o.adaptive_objective_short_delay_divisor)))
        return df.withColumns({
            "objective_balance_score": pressure - cost,
            "objective_mode": F.when(shorter, 1).when(longer, -1).otherwise(0).cast("long"),
            "batch_delay_us": F.when(shorter, cut).otherwise(_boost(delay, longer, o.adaptive_objective_long_delay_multiplier, o.adaptive_objective_max_batch_delay_us)),
        })

    df = df.withColumns(none | {f"objective_{x}": long(0) for x in ("pressure_score", "cost_score", "throughput_score", "balance_score", "mode")})
    delay = c("batch_delay_us")
    if o.adaptive_flush_enabled and o.max_batch_delay_us > 0:
        on, limit = busy(o.adaptive_flush_queue_depth_threshold), long(o.adaptive_flush_queue_depth_threshold)
        steps = F.when(depth >= limit, whole(depth, limit)).otherwise(F.greatest(F.lit(1), whole(peak, limit)))
        # After 32 halvings nothing is left of 32 bits, so the power stays small enough for a decimal.
        power = F.pow(F.lit(float(o.adaptive_flush_delay_divisor)), F.least(steps, F.lit(32)))
        cut = F.greatest(least, F.floor(o.max_batch_delay_us / power))
        df = df.withColumns({"adaptive_flush": on, "batch_delay_us": F.when(on, cut).otherwise(delay)})
    if o.adaptive_read_heavy_read_per_1000_ops_threshold > 0:
        on, by = c("recent_read_ratio") >= o.adaptive_read_heavy_read_per_1000_ops_threshold, long(o.adaptive_read_heavy_batch_size_divisor)
        size, most = c("max_batch_size"), c("max_batch_wal_bytes")
        df = df.withColumns({
            "read_heavy_adjusted": on,
            "batch_delay_us": F.when(on, F.greatest(least, whole(delay, long(o.adaptive_read_heavy_delay_divisor)))).otherwise(delay),
            "max_batch_size": F.when(on, F.greatest(F.lit(1), whole(size, by))).otherwise(size),
            "max_batch_wal_bytes": F.when(on & (most > 0), F.greatest(F.lit(RECORD_BYTES), whole(most, by))).otherwise(most),
        })
    calm = ~c("read_heavy_adjusted")
    if o.adaptive_latency_target_p95_us > 0:
        on = (c("observed_p95_us") > o.adaptive_latency_target_p95_us) & (delay > least)
        cut = F.greatest(least, whole(delay, long(max(2, o.adaptive_flush_delay_divisor))))
        df = df.withColumns({"latency_target_adjusted": on, "adaptive_flush": c("adaptive_flush") | on, "batch_delay_us": F.when(on, cut).otherwise(delay)})
    if o.adaptive_fsync_pressure_per_1000_writes_threshold > 0 and o.adaptive_fsync_pressure_delay_multiplier > 1:
        on = calm & ~c("latency_target_adjusted") & (c("observed_fsync_pressure") >= o.adaptive_fsync_pressure_per_1000_writes_threshold)
        df = df.withColumns({"fsync_pressure_adjusted": on, "batch_delay_us": _boost(delay, on, o.adaptive_fsync_pressure_delay_multiplier, o.adaptive_fsync_pressure_max_batch_delay_us)})
    if o.adaptive_compaction_pressure_obsolete_ratio_percent_threshold > 0:
        on = calm & (c("current_obsolete_ratio") >= o.adaptive_compaction_pressure_obsolete_ratio_percent_threshold)
        df = df.withColumns({"compaction_pressure_adjusted": on, "batch_delay_us": _boost(delay, on, o.adaptive_compaction_pressure_delay_multiplier, 0)})
    if o.adaptive_wal_growth_bytes_per_batch_threshold > 0:
        on = calm & (c("recent_avg_batch_wal_bytes") >= o.adaptive_wal_growth_bytes_per_batch_threshold)
        df = df.withColumns({"wal_growth_adjusted": on, "batch_delay_us": _boost(delay, on, o.adaptive_wal_growth_delay_multiplier, o.adaptive_wal_growth_max_batch_delay_us)})
    return df


POLICY = ["max_batch_size", "max_batch_wal_bytes", "batch_delay_us", "observed_queue_depth", "objective_pressure_score", "objective_cost_score", "objective_throughput_score", "objective_balance_score", "objective_mode", *FLAGS]

