"""Options of a store, their sanitising, and presets by name."""

from __future__ import annotations

from dataclasses import asdict, dataclass, fields, replace

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Options:
    """Names and defaults of all options."""

    max_batch_size: int = 64
    max_batch_wal_bytes: int = 0
    max_batch_delay_us: int = 1000
    adaptive_recent_window_batches: int = 64
    adaptive_recent_write_sample_limit: int = 512
    adaptive_objective_enabled: bool = False
    adaptive_objective_queue_weight: int = 1
    adaptive_objective_latency_weight: int = 2
    adaptive_objective_read_weight: int = 1
    adaptive_objective_throughput_weight: int = 1
    adaptive_objective_target_batch_size: int = 0
    adaptive_objective_fsync_weight: int = 1
    adaptive_objective_compaction_weight: int = 1
    adaptive_objective_wal_growth_weight: int = 1
    adaptive_objective_short_delay_score_threshold: int = 1000
    adaptive_objective_long_delay_score_threshold: int = 1000
    adaptive_objective_short_delay_divisor: int = 2
    adaptive_objective_long_delay_multiplier: int = 2
    adaptive_objective_max_batch_delay_us: int = 0
    adaptive_read_heavy_read_per_1000_ops_threshold: int = 0
    adaptive_read_heavy_delay_divisor: int = 2
    adaptive_read_heavy_batch_size_divisor: int = 2
    adaptive_flush_enabled: bool = False
    adaptive_flush_queue_depth_threshold: int = 8
    adaptive_flush_delay_divisor: int = 4
    adaptive_flush_min_batch_delay_us: int = 100
    adaptive_latency_target_p95_us: int = 0
    adaptive_fsync_pressure_per_1000_writes_threshold: int = 0
    adaptive_fsync_pressure_delay_multiplier: int = 2
    adaptive_fsync_pressure_max_batch_delay_us: int = 0
    adaptive_compaction_pressure_obsolete_ratio_percent_threshold: int = 0
    adaptive_compaction_pressure_delay_multiplier: int = 2
    adaptive_wal_growth_bytes_per_batch_threshold: int = 0
    adaptive_wal_growth_delay_multiplier: int = 2
    adaptive_wal_growth_max_batch_delay_us: int = 0
    auto_compact_wal_bytes_threshold: int = 0
    auto_compact_invalid_wal_ratio_percent: int = 0
    adaptive_batching_enabled: bool = False
    adaptive_queue_depth_threshold: int = 32
    adaptive_batch_size_multiplier: int = 4
    adaptive_batch_wal_bytes_multiplier: int = 4

    def sane(self) -> Options:
        """Divisors, multipliers and sizes of at least 1, a percentage of at most 100."""
        up = {n: max(1, getattr(self, n)) for n in AT_LEAST_ONE}
        return replace(self, **up, auto_compact_invalid_wal_ratio_percent=min(100, self.auto_compact_invalid_wal_ratio_percent))


#: Options that can't be 0.
AT_LEAST_ONE = [
    "max_batch_size", "adaptive_recent_window_batches", "adaptive_recent_write_sample_limit", "adaptive_objective_short_delay_divisor",
    "adaptive_objective_long_delay_multiplier", "adaptive_read_heavy_delay_divisor", "adaptive_read_heavy_batch_size_divisor",
    "adaptive_flush_queue_depth_threshold", "adaptive_flush_delay_divisor", "adaptive_fsync_pressure_delay_multiplier",
    "adaptive_compaction_pressure_delay_multiplier", "adaptive_wal_growth_delay_multiplier", "adaptive_queue_depth_threshold",
    "adaptive_batch_size_multiplier", "adaptive_batch_wal_bytes_multiplier",
]

#: The recommended options by profile, and those of the mixed benchmark.
_TUNED = {
    "max_batch_size": 32, "max_batch_wal_bytes": 1048576, "max_batch_delay_us": 2000, "adaptive_batching_enabled": True,
    "adaptive_queue_depth_threshold": 8, "adaptive_flush_enabled": True, "adaptive_latency_target_p95_us": 12000,
    "adaptive_fsync_pressure_per_1000_writes_threshold": 350, "adaptive_fsync_pressure_max_batch_delay_us": 8000,
    "adaptive_compaction_pressure_obsolete_ratio_percent_threshold": 50, "adaptive_wal_growth_bytes_per_batch_threshold": 200,
    "adaptive_wal_growth_max_batch_delay_us": 6000, "adaptive_objective_enabled": True, "adaptive_objective_latency_weight": 3,
    "adaptive_objective_read_weight": 2, "adaptive_objective_throughput_weight": 2, "adaptive_objective_target_batch_size": 16,
    "adaptive_objective_fsync_weight": 2, "adaptive_objective_short_delay_score_threshold": 500, "adaptive_objective_long_delay_score_threshold": 500,
    "adaptive_objective_max_batch_delay_us": 8000, "adaptive_read_heavy_read_per_1000_ops_threshold": 700, "adaptive_read_heavy_delay_divisor": 4,
}
BENCHMARK = Options(**_TUNED)
_BALANCED = replace(BENCHMARK, auto_compact_wal_bytes_threshold=1048576, auto_compact_invalid_wal_ratio_percent=60)
RECOMMENDED = {
    "balanced": _BALANCED,
    "write-heavy": replace(
        _BALANCED, max_batch_size=64, max_batch_wal_bytes=2097152, max_batch_delay_us=4000, adaptive_objective_target_batch_size=32, adaptive_objective_throughput_weight=4,
        adaptive_objective_fsync_weight=3, adaptive_flush_queue_depth_threshold=16, auto_compact_wal_bytes_threshold=4194304, auto_compact_invalid_wal_ratio_percent=70,
    ),
    "read-heavy": replace(
        _BALANCED, max_batch_size=16, max_batch_delay_us=1000, adaptive_objective_read_weight=4, adaptive_objective_latency_weight=4, adaptive_objective_throughput_weight=1,
        adaptive_read_heavy_read_per_1000_ops_threshold=600, adaptive_read_heavy_delay_divisor=8, adaptive_read_heavy_batch_size_divisor=4, adaptive_flush_queue_depth_threshold=4,
    ),
    "low-latency": replace(
        _BALANCED, max_batch_size=8, max_batch_wal_bytes=65536, max_batch_delay_us=500, adaptive_objective_latency_weight=5, adaptive_objective_short_delay_divisor=4,
        adaptive_objective_long_delay_score_threshold=1500, adaptive_objective_target_batch_size=8, adaptive_objective_throughput_weight=1, adaptive_flush_queue_depth_threshold=2,
        adaptive_flush_delay_divisor=8, adaptive_flush_min_batch_delay_us=50, adaptive_latency_target_p95_us=4000,
    ),
}
#: What the soak and stress profiles set, beyond the options' defaults.
_SOAK = {"max_batch_size": 32, "max_batch_wal_bytes": 1048576, "max_batch_delay_us": 2000, "auto_compact_wal_bytes_threshold": 4096, "auto_compact_invalid_wal_ratio_percent": 60, "adaptive_flush_enabled": True}
SOAK = {
    "balanced": Options(**_SOAK),
    "write-heavy": replace(Options(**_SOAK), max_batch_size=64, max_batch_delay_us=4000, auto_compact_wal_bytes_threshold=8192, auto_compact_invalid_wal_ratio_percent=70),
    "read-heavy": replace(Options(**_SOAK), max_batch_size=16, max_batch_delay_us=1000, adaptive_flush_queue_depth_threshold=4, adaptive_flush_min_batch_delay_us=50),
}
_STRESS = _SOAK | {
    "max_batch_wal_bytes": 65536, "max_batch_delay_us": 1500, "adaptive_batching_enabled": True, "adaptive_queue_depth_threshold": 8, "adaptive_flush_queue_depth_threshold": 4,
    "adaptive_flush_min_batch_delay_us": 50, "adaptive_recent_window_batches": 32, "adaptive_recent_write_sample_limit": 256,
}
STRESS = {
    "balanced": Options(**_STRESS),
    "write-heavy": replace(Options(**_STRESS), max_batch_size=64, max_batch_delay_us=2500, auto_compact_wal_bytes_threshold=8192),
    "compaction-heavy": replace(Options(**_STRESS), max_batch_size=24, max_batch_delay_us=800, auto_compact_wal_bytes_threshold=2048, auto_compact_invalid_wal_ratio_percent=45),
    "recovery-heavy": replace(Options(**_STRESS), max_batch_size=16, max_batch_delay_us=700, auto_compact_wal_bytes_threshold=2048, auto_compact_invalid_wal_ratio_percent=40),
}
FAMILIES = {"recommended": RECOMMENDED, "soak": SOAK, "stress": STRESS}


#: The workloads of the soak and stress profiles.
SOAK_LOADS = {
    "balanced": {"writer_count": 4, "reader_count": 2, "key_space": 256, "compaction_interval_ms": 50},
    "write-heavy": {"writer_count": 6, "reader_count": 1, "key_space": 512, "compaction_interval_ms": 80},
    "read-heavy": {"writer_count": 2, "reader_count": 6, "key_space": 256, "compaction_interval_ms": 30},
}
_STRESS_LOAD = {"writer_count": 8, "reader_count": 4, "compactor_count": 1, "keys_per_writer": 96, "compaction_interval_ms": 5, "batch_width": 4, "recovery_reopen_cycles": 1}
STRESS_LOADS = {
    "balanced": _STRESS_LOAD,
    "write-heavy": _STRESS_LOAD | {"writer_count": 12, "reader_count": 2, "keys_per_writer": 128, "compaction_interval_ms": 8},
    "compaction-heavy": _STRESS_LOAD | {"writer_count": 6, "reader_count": 3, "compactor_count": 2, "keys_per_writer": 80, "compaction_interval_ms": 1},
    "recovery-heavy": _STRESS_LOAD | {"writer_count": 4, "reader_count": 1, "keys_per_writer": 64, "compaction_interval_ms": 2, "batch_width": 3, "recovery_reopen_cycles": 6},
}
#: What a summary of a profile shows of its options.
SUMMARIES = {
    "soak": (SOAK, SOAK_LOADS, ["max_batch_size", "max_batch_delay_us"]),
    "stress": (STRESS, STRESS_LOADS, ["max_batch_size", "max_batch_delay_us", "auto_compact_wal_bytes_threshold"]),
}


def profile_summaries(spark: SparkSession, family: str) -> DataFrame:
    """A row for each soak or stress profile: its workload, and the options that shape it."""
    presets, loads, shown = SUMMARIES[family]
    rows = [(name, *loads[name].values(), *(getattr(o, n) for n in shown)) for name, o in presets.items()]
    names = [*next(iter(loads.values())), *shown]
    return spark.createDataFrame(rows, "profile string, " + ", ".join(f"{n} long" for n in names))


def profile_name(options: Options, family: str = "recommended") -> str:
    """The name of a preset; `unknown` for other options."""
    return next((name for name, o in FAMILIES[family].items() if o == options), "unknown")


def profile(name: str, family: str = "recommended") -> Options | None:
    """None for an unknown name."""
    return FAMILIES[family].get(name)


def options_frame(spark: SparkSession, presets: dict[str, Options]) -> DataFrame:
    """A row for each preset: profile and all options."""
    types = ", ".join(f"{f.name} {'boolean' if f.type == 'bool' else 'long'}" for f in fields(Options))
    return spark.createDataFrame([(k, *asdict(o).values()) for k, o in presets.items()], f"profile string, {types}")
