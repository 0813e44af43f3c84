"""All queries of the engine by name, and the SQL that each must agree with."""

from __future__ import annotations

import uuid
from dataclasses import asdict, fields

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewell.functions import numbers as N
from tidewell.functions.keys import binary_key, int_key, int_of, key_kind, string_key, string_of
from tidewell.functions.options import FAMILIES, RECOMMENDED, Options, options_frame, profile_summaries
from tidewell.operators import accounting, batching, formats, policy, state, store, trends
from tidewell.operators.ordered import numbered
from tidewell.plans import views as V
from tidewell.sources import files
from tidewell.sources.results import METRICS, inspect_line, qualified, to_json, to_line
from tidewell.streaming.changelog import CHANGE, StreamedState

#: Files that a log or a snapshot is written to.
STORES = 64

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

#: Shared parts of the SQL.
LOG = """log AS (SELECT event_id AS seq, CASE WHEN event_type = 'error' THEN 2 ELSE 1 END AS op, user_id AS k, props AS v, event_type,
  20 + 5 + CASE WHEN event_type = 'error' THEN 0 ELSE strlen(props) END AS bytes FROM events)"""
BATCHES = f"""{LOG}, batches AS (SELECT seq // 64 AS batch, count(*) AS batch_size, CAST(sum(bytes) AS BIGINT) AS wal_bytes,
  count(*) FILTER (event_type = 'purchase') AS queue_depth, count(*) FILTER (event_type = 'view') AS reads FROM log GROUP BY 1)"""
HEX = "'01' || printf('%08X', {} & 4294967295)"
BOUNDS = "50, 100, 250, 500, 1000, 2500, 5000, 10000, 25000, 50000, 100000"
RECENT = f"""{BATCHES}, w AS (SELECT batch, count(*) OVER r AS n, CAST(sum(batch_size) OVER r AS BIGINT) AS writes, CAST(sum(wal_bytes) OVER r AS BIGINT) AS bytes,
  CAST(sum(reads) OVER r AS BIGINT) AS reads, max(queue_depth) OVER r AS peak FROM batches WINDOW r AS (ORDER BY batch ROWS BETWEEN 63 PRECEDING AND CURRENT ROW)),
recent AS (SELECT batch, n AS recent_window_batch_count, writes AS recent_write_requests, reads AS recent_read_requests, writes // n AS recent_avg_batch_size,
  bytes // n AS recent_avg_batch_wal_bytes, peak AS recent_peak_queue_depth, reads * 1000 // (reads + writes) AS recent_read_ratio_per_1000_ops,
  least(1000, (writes // n) * 1000 // 64) AS recent_batch_fill_per_1000, (n * 1000 + writes - 1) // writes AS observed_fsync_pressure_per_1000_writes FROM w)"""


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def shown(df: DataFrame) -> DataFrame:
    """Keys in hex and values as text."""
    return df.select(F.hex("key_enc").alias("key_hex"), F.decode("value", "UTF-8").alias("value"))


def last_sql(rows: str) -> str:
    return f"SELECT {HEX.format('k')} AS key_hex, v AS value FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY seq DESC) AS rn FROM {rows}) WHERE rn = 1 AND op = 1"


MERGED = f"WITH {LOG}, every AS (SELECT seq, op, k, v FROM log UNION ALL SELECT -1, 1, c_custkey, c_name FROM customer) " + last_sql("every")
CURRENT = f"WITH {LOG} " + last_sql("log")


@query("kv_recovery_merge", MERGED)
def recovery_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(state.merged(V.base_snapshot(spark, sf_dir), V.changelog(spark, sf_dir)))


@query("kv_current_state", CURRENT)
def current_state(spark, sf_dir):
    return shown(state.current_state(V.changelog(spark, sf_dir)))


@query("kv_point_get", f"SELECT {HEX.format('c_custkey')} AS key_hex, c_name AS value FROM customer WHERE c_custkey = 42")
def point_get(spark, sf_dir):
    return shown(state.point_get(V.base_snapshot(spark, sf_dir), int_key(F.lit(42))))


@query("kv_range_scan", "SELECT c_name AS key, c_mktsegment AS value FROM customer WHERE c_name BETWEEN 'Customer#000000100' AND 'Customer#000000399' ORDER BY 1")
def range_scan(spark, sf_dir):
    found = state.range_scan(V.string_state(spark, sf_dir), "Customer#000000100", "Customer#000000399")
    return found.select(string_of(F.col("key_enc")).alias("key"), F.decode("value", "UTF-8").alias("value"))


@query("kv_range_scan_empty", "SELECT c_name AS key FROM customer WHERE c_name BETWEEN 'b' AND 'a'")
def range_scan_empty(spark, sf_dir):
    return state.range_scan(V.string_state(spark, sf_dir), "b", "a").select(string_of(F.col("key_enc")).alias("key"))


def typed_keys(spark, sf_dir) -> DataFrame:
    c = V.table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    keys = F.array(int_key(F.col("c_custkey")), int_key(-F.col("c_custkey")), string_key(F.col("c_name")), binary_key(F.encode("c_name", "UTF-8")), F.lit(b"\x7f"))
    return c.select("c_custkey", F.posexplode(keys)).select("c_custkey", F.col("pos").alias("form"), F.col("col").alias("key_enc"))


@query(
    "kv_key_encode",
    f"""SELECT c_custkey, 0 AS form, {HEX.format("c_custkey")} AS key_hex, 'int' AS kind, CAST(c_custkey AS INTEGER) AS int_key FROM customer
UNION ALL SELECT c_custkey, 1, {HEX.format("-c_custkey")}, 'int', CAST(-c_custkey AS INTEGER) FROM customer
UNION ALL SELECT c_custkey, 2, '02' || hex(c_name), 'string', NULL FROM customer
UNION ALL SELECT c_custkey, 3, '03' || hex(c_name), 'binary', NULL FROM customer
UNION ALL SELECT c_custkey, 4, '7F', 'unknown', NULL FROM customer""",
)
def key_encode(spark, sf_dir):
    k = F.col("key_enc")
    return typed_keys(spark, sf_dir).select("c_custkey", "form", F.hex(k).alias("key_hex"), key_kind(k).alias("kind"), int_of(k).alias("int_key"))


@query("kv_namespace_counts", "SELECT 5 * count(*) AS entries, 2 * count(*) AS int_keys, count(*) AS string_keys, count(*) AS binary_keys, count(*) AS unknown_keys FROM customer")
def namespace_counts(spark, sf_dir):
    return state.kind_counts(typed_keys(spark, sf_dir))


@query("kv_key_order", f"SELECT key_hex, row_number() OVER (ORDER BY key_hex) AS place FROM (SELECT DISTINCT {HEX.format('c_custkey')} AS key_hex FROM customer UNION SELECT {HEX.format('-c_custkey')} FROM customer)")
def key_order(spark, sf_dir):
    """Places in the order of all keys: counted within each prefix of the key, and then over the prefixes.

    A prefix is a property of a key, so a recomputed task places it alike. A prefix of int keys holds 4096 of them.
    """
    keys = typed_keys(spark, sf_dir).where("form < 2").select("key_enc").distinct()
    parts = keys.withColumn("part", F.hex(F.substring("key_enc", 1, 3))).withColumn("low", F.substring(F.hex(F.substring("key_enc", 4, 1)), 1, 1))
    own = F.row_number().over(Window.partitionBy("part", "low").orderBy("key_enc"))
    sizes = parts.groupBy("part", "low").count()  # a row for each prefix
    before = sizes.select("part", "low", F.coalesce(F.sum("count").over(Window.orderBy("part", "low").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    return parts.withColumn("own", own).join(before, ["part", "low"]).select(F.hex("key_enc").alias("key_hex"), (F.col("own") + F.col("before")).alias("place"))


@query("kv_record_types", f"WITH {LOG} SELECT count(*) AS records, count(*) FILTER (op = 1) AS puts, count(*) FILTER (op = 2) AS deletes, 0::BIGINT AS unknown FROM log")
def record_types(spark, sf_dir):
    return state.type_counts(V.changelog(spark, sf_dir))


@query("kv_batch_apply", f"WITH {LOG}, b AS (SELECT seq, op, k % 20 AS k, v FROM log) " + last_sql("b"))
def batch_apply(spark, sf_dir):
    return shown(state.current_state(state.batch_changes(V.batch_requests(spark, sf_dir))))


@query("kv_record_size", f"WITH {LOG} SELECT seq // 4 AS request_id, count(*) AS operations, CAST(sum(bytes) AS BIGINT) AS wal_bytes FROM log GROUP BY 1")
def record_size(spark, sf_dir):
    return accounting.request_bytes(state.batch_changes(V.batch_requests(spark, sf_dir)))


ACCOUNT = """SELECT total_bytes, live_bytes, greatest(total_bytes - live_bytes, 0) AS obsolete_bytes,
  CASE WHEN total_bytes = 0 THEN 0 ELSE 100 * greatest(total_bytes - live_bytes, 0) // total_bytes END AS obsolete_percent"""


@query("kv_live_bytes", f"WITH {LOG}, a AS (SELECT CAST(sum(bytes) AS BIGINT) AS total_bytes, CAST(sum(bytes) FILTER (rn = 1) AS BIGINT) AS live_bytes FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY seq DESC) AS rn FROM log)) {ACCOUNT} FROM a")
def live_bytes(spark, sf_dir):
    return accounting.log_account(V.changelog(spark, sf_dir))


RUNNING = f"""WITH {LOG}, d AS (SELECT seq, bytes, bytes - coalesce(lag(bytes) OVER (PARTITION BY k ORDER BY seq), 0) AS step FROM log),
s AS (SELECT seq // 64 AS batch, sum(bytes) AS b, sum(step) AS s FROM d GROUP BY 1),
a AS (SELECT batch, CAST(sum(b) OVER (ORDER BY batch) AS BIGINT) AS total_bytes, CAST(sum(s) OVER (ORDER BY batch) AS BIGINT) AS live_bytes FROM s)"""


@query("kv_running_live_bytes", f"{RUNNING} {ACCOUNT}, batch FROM a")
def running_live_bytes(spark, sf_dir):
    return accounting.running_account(V.changelog(spark, sf_dir), F.expr(f"seq div {V.BATCH}"))


@query("kv_autocompact_flag", f"{RUNNING} SELECT batch, total_bytes >= 100000 OR (total_bytes > 0 AND 100 * greatest(total_bytes - live_bytes, 0) >= 60 * total_bytes) AS compact FROM a")
def autocompact_flag(spark, sf_dir):
    return running_live_bytes(spark, sf_dir).select("batch", N.should_compact(F.col("total_bytes"), F.col("live_bytes"), 100_000, 60).alias("compact"))


HISTOGRAM = f"""s AS (SELECT CAST(floor(value * 1000) AS BIGINT) AS us, event_id AS seq FROM events),
b AS (SELECT seq, len(list_filter([{BOUNDS}], lambda x: x < us)) AS bucket FROM s),
h AS (SELECT k.bucket, count(b.seq) AS n FROM (SELECT unnest(range(12)) AS bucket) k LEFT JOIN b ON b.bucket = k.bucket GROUP BY 1)"""


@query("kv_latency_histogram", f"WITH {HISTOGRAM} SELECT CAST(bucket AS INTEGER) AS bucket, n FROM h")
def latency_histogram(spark, sf_dir):
    return accounting.histogram(V.samples(spark, sf_dir), "elapsed_us")


def percentile_sql(p: int) -> str:
    return f"(SELECT [{BOUNDS}, 100000][min(bucket) + 1]::BIGINT FROM c WHERE seen >= (total * {p} + 99) // 100) AS p{p}_us"


@query(
    "kv_latency_percentiles",
    f"WITH {HISTOGRAM}, c AS (SELECT bucket, CAST(sum(n) OVER (ORDER BY bucket) AS BIGINT) AS seen, CAST(sum(n) OVER () AS BIGINT) AS total FROM h) SELECT {', '.join(map(percentile_sql, (50, 95, 99)))}",
)
def latency_percentiles(spark, sf_dir):
    return accounting.percentiles(latency_histogram(spark, sf_dir))


COUNTS = ", ".join(f"count(*) FILTER (bucket <= {k}) OVER w AS c{k}" for k in range(12))
P95 = "CASE " + " ".join(f"WHEN c{k} >= (c11 * 95 + 99) // 100 THEN {bound}" for k, bound in enumerate([*BOUNDS.split(", "), "100000"])) + " END"
SAMPLES = f"r AS (SELECT seq, {COUNTS} FROM b WINDOW w AS (ORDER BY seq ROWS BETWEEN 511 PRECEDING AND CURRENT ROW)), p AS (SELECT seq, CAST({P95} AS BIGINT) AS recent_p95_us FROM r)"


@query("kv_recent_p95", f"WITH {HISTOGRAM}, {SAMPLES} SELECT seq, recent_p95_us FROM p")
def recent_p95(spark, sf_dir):
    return accounting.recent_percentile(V.samples(spark, sf_dir), "seq", "elapsed_us")


@query("kv_recent_window", f"WITH {RECENT} SELECT * FROM recent")
def recent_window(spark, sf_dir):
    return accounting.recent_batches(V.batches(spark, sf_dir))


@query("kv_read_delta", f"WITH {BATCHES}, t AS (SELECT batch, CAST(sum(reads) OVER (ORDER BY batch) AS BIGINT) AS total_reads FROM batches) SELECT batch, total_reads, greatest(total_reads - lag(total_reads, 1, 0) OVER (ORDER BY batch), 0) AS read_delta FROM t")
def read_delta(spark, sf_dir):
    from tidewell.operators.ordered import running_sum, sliding

    total = running_sum(V.batches(spark, sf_dir), "batch", {"total_reads": "reads"})
    pair = sliding(total, "batch", 2, {"before": lambda w: F.when(F.count("*").over(w) > 1, F.min_by("total_reads", "batch").over(w)).otherwise(0)})
    return pair.select("batch", "total_reads", accounting.read_delta(F.col("total_reads"), F.col("before")).alias("read_delta"))


@query("kv_effective_read_ratio", f"WITH {RECENT} SELECT batch, (recent_read_requests + batch % 7) * 1000 // (recent_read_requests + batch % 7 + recent_write_requests) AS ratio FROM recent")
def effective_read_ratio(spark, sf_dir):
    r = recent_window(spark, sf_dir)
    return r.select("batch", accounting.effective_read_ratio(F.col("recent_read_requests"), F.col("batch") % 7, F.col("recent_write_requests")).alias("ratio"))


@query("kv_high_water", f"WITH {BATCHES} SELECT max(batch_size) AS max_batch_size, max(wal_bytes) AS max_wal_bytes, max(queue_depth) AS max_queue_depth, min(reads) FILTER (reads > 0) AS min_positive_reads, CAST(sum(batch_size) AS BIGINT) AS requests, count(*) AS fsyncs, CAST(sum(wal_bytes) AS BIGINT) AS wal_bytes FROM batches")
def high_water(spark, sf_dir):
    return V.batches(spark, sf_dir).agg(
        F.max("batch_size").alias("max_batch_size"), F.max("wal_bytes").alias("max_wal_bytes"), F.max("queue_depth").alias("max_queue_depth"),
        F.min(F.when(F.col("reads") > 0, F.col("reads"))).alias("min_positive_reads"), F.sum("batch_size").alias("requests"), F.count("*").alias("fsyncs"), F.sum("wal_bytes").alias("wal_bytes"),
    )


#: A deterministic grid of signals from the events, wide enough to set off every rule.
SIGNAL_RULES = {
    "request_queue_depth": "event_id % 41", "recent_peak_queue_depth": "event_id % 67", "recent_read_ratio": "event_id * 7 % 1001", "current_obsolete_ratio": "event_id * 3 % 101",
    "recent_avg_batch_size": "event_id % 37", "recent_avg_batch_wal_bytes": "event_id * 13 % 401", "observed_p95_us": "event_id * 17 % 20001", "observed_fsync_pressure": "event_id * 11 % 1001",
}
#: The tuned profiles, and one without the objective so that the later rules run too.
POLICIES = RECOMMENDED | {"rules": Options(**asdict(RECOMMENDED["balanced"]) | {"adaptive_objective_enabled": False}), "defaults": Options()}


def policies(spark, sf_dir) -> DataFrame:
    signals = V.table(spark, sf_dir, "events").select("event_id", *(F.expr(f"CAST({rule} AS BIGINT)").alias(name) for name, rule in SIGNAL_RULES.items()))
    out = None
    for name, options in POLICIES.items():
        one = policy.with_policy(signals, options.sane()).select(F.lit(name).alias("profile"), "event_id", *policy.POLICY)
        out = one if out is None else out.unionByName(one)
    return out


def policy_sql(name: str, o: Options, source: str = "", key: str = "event_id") -> str:
    """The same rules as nested SQL selects."""
    score = lambda v, s, w: f"(CASE WHEN {v} = 0 OR {s} = 0 THEN 0 ELSE least(4000, {v} * 1000 // {s or 1}) END * {w})"
    t = "true" if o.adaptive_batching_enabled else "false"
    batching = f"({t} AND (d >= {o.adaptive_queue_depth_threshold} OR p >= {o.adaptive_queue_depth_threshold}))"
    names = dict(zip(SIGNAL_RULES, ("d", "p", "rr", "ob", "ab", "aw", "lat", "fs"), strict=True))
    src = source or f"SELECT {key}, " + ", ".join(f"CAST({rule} AS BIGINT) AS {names[k]}" for k, rule in SIGNAL_RULES.items()) + " FROM events"
    one = f"SELECT *, {batching} AS f_b, CASE WHEN {batching} THEN {o.max_batch_size * o.adaptive_batch_size_multiplier} ELSE {o.max_batch_size} END AS size1, CASE WHEN {batching} THEN {o.max_batch_wal_bytes * o.adaptive_batch_wal_bytes_multiplier} ELSE {o.max_batch_wal_bytes} END AS cap1, {o.max_batch_delay_us} AS d0 FROM ({src})"
    m, boost = o.adaptive_flush_min_batch_delay_us, lambda v, k, cap: f"least({v} * {k}, {cap or 4294967295})"
    if o.adaptive_objective_enabled:
        scale = o.adaptive_queue_depth_threshold if o.adaptive_batching_enabled else o.max_batch_size
        pressure = f"{score('greatest(d, p)', scale, o.adaptive_objective_queue_weight)} + {score('lat', o.adaptive_latency_target_p95_us, o.adaptive_objective_latency_weight)} + {score('rr', o.adaptive_read_heavy_read_per_1000_ops_threshold, o.adaptive_objective_read_weight)}"
        target = o.adaptive_objective_target_batch_size
        through = f"CASE WHEN {target} = 0 OR ab >= {target} THEN 0 ELSE ({target} - ab) * 1000 // {target or 1} * {o.adaptive_objective_throughput_weight} END"
        cost = f"{score('fs', o.adaptive_fsync_pressure_per_1000_writes_threshold, o.adaptive_objective_fsync_weight)} + {score('ob', o.adaptive_compaction_pressure_obsolete_ratio_percent_threshold, o.adaptive_objective_compaction_weight)} + {score('aw', o.adaptive_wal_growth_bytes_per_batch_threshold, o.adaptive_objective_wal_growth_weight)}"
        two = f"SELECT *, {pressure} AS pr, {through} AS th, {through} + {cost} AS co FROM ({one})"
        three = f"SELECT *, pr >= co + {o.adaptive_objective_short_delay_score_threshold} AND d0 > {m} AS sh, NOT (pr >= co + {o.adaptive_objective_short_delay_score_threshold} AND d0 > {m}) AND co >= pr + {o.adaptive_objective_long_delay_score_threshold} AS lo FROM ({two})"
        delay = f"CASE WHEN sh THEN greatest({m}, d0 // {o.adaptive_objective_short_delay_divisor}) WHEN lo THEN {boost('d0', o.adaptive_objective_long_delay_multiplier, o.adaptive_objective_max_batch_delay_us)} ELSE d0 END"
        values = ["size1", "cap1", delay, "d", "pr", "co", "th", "pr - co", "CASE WHEN sh THEN 1 WHEN lo THEN -1 ELSE 0 END", "f_b", *["false"] * 6, "sh", "lo"]
        last = three
    else:
        lim, div = o.adaptive_flush_queue_depth_threshold, o.adaptive_flush_delay_divisor
        on = f"({'true' if o.adaptive_flush_enabled else 'false'} AND (d >= {lim} OR p >= {lim}))"
        steps = f"CASE WHEN d // {lim} > 0 THEN d // {lim} ELSE greatest(1, p // {lim}) END"
        two = f"SELECT *, {on} AS f_f, CASE WHEN {on} THEN greatest({m}, CAST(floor({o.max_batch_delay_us} / pow({div}, least(32, {steps}))) AS BIGINT)) ELSE d0 END AS d1 FROM ({one})"
        rt = o.adaptive_read_heavy_read_per_1000_ops_threshold
        heavy = f"({rt} > 0 AND rr >= {rt})"
        three = f"SELECT *, {heavy} AS f_r, CASE WHEN {heavy} THEN greatest({m}, d1 // {o.adaptive_read_heavy_delay_divisor}) ELSE d1 END AS d2, CASE WHEN {heavy} THEN greatest(1, size1 // {o.adaptive_read_heavy_batch_size_divisor}) ELSE size1 END AS size2, CASE WHEN {heavy} AND cap1 > 0 THEN greatest(20, cap1 // {o.adaptive_read_heavy_batch_size_divisor}) ELSE cap1 END AS cap2 FROM ({two})"
        lt = o.adaptive_latency_target_p95_us
        late = f"({lt} > 0 AND lat > {lt} AND d2 > {m})"
        four = f"SELECT *, {late} AS f_l, CASE WHEN {late} THEN greatest({m}, d2 // {max(2, div)}) ELSE d2 END AS d3 FROM ({three})"
        ft = o.adaptive_fsync_pressure_per_1000_writes_threshold
        five = f"SELECT *, NOT f_r AND NOT f_l AND {ft} > 0 AND fs >= {ft} AS f_s FROM ({four})"
        six = f"SELECT *, CASE WHEN f_s THEN {boost('d3', o.adaptive_fsync_pressure_delay_multiplier, o.adaptive_fsync_pressure_max_batch_delay_us)} ELSE d3 END AS d4, NOT f_r AND {o.adaptive_compaction_pressure_obsolete_ratio_percent_threshold} > 0 AND ob >= {o.adaptive_compaction_pressure_obsolete_ratio_percent_threshold} AS f_c FROM ({five})"
        seven = f"SELECT *, CASE WHEN f_c THEN {boost('d4', o.adaptive_compaction_pressure_delay_multiplier, 0)} ELSE d4 END AS d5, NOT f_r AND {o.adaptive_wal_growth_bytes_per_batch_threshold} > 0 AND aw >= {o.adaptive_wal_growth_bytes_per_batch_threshold} AS f_w FROM ({six})"
        last = f"SELECT *, CASE WHEN f_w THEN {boost('d5', o.adaptive_wal_growth_delay_multiplier, o.adaptive_wal_growth_max_batch_delay_us)} ELSE d5 END AS d6 FROM ({seven})"
        values = ["size2", "cap2", "d6", "d", "0", "0", "0", "0", "0", "f_b", "f_f OR f_l", "f_l", "f_s", "f_r", "f_c", "f_w", "false", "false"]
    cast = [f"CAST({v} AS {'BIGINT' if i < 9 else 'BOOLEAN'}) AS {n}" for i, (n, v) in enumerate(zip(policy.POLICY, values, strict=True))]
    return f"SELECT '{name}' AS profile, {key}, {', '.join(cast)} FROM ({last})"


POLICY_SQL = " UNION ALL ".join(policy_sql(n, o) for n, o in POLICIES.items())


@query("kv_batch_policy", POLICY_SQL)
def batch_policy(spark, sf_dir):
    return policies(spark, sf_dir)


@query("kv_objective_scores", f"SELECT profile, event_id, objective_pressure_score, objective_cost_score, objective_throughput_score, objective_balance_score, objective_mode FROM ({POLICY_SQL}) WHERE profile IN ('balanced', 'low-latency')")
def objective_scores(spark, sf_dir):
    return policies(spark, sf_dir).where(F.col("profile").isin("balanced", "low-latency")).select("profile", "event_id", *(f"objective_{x}" for x in ("pressure_score", "cost_score", "throughput_score", "balance_score", "mode")))


@query("kv_policy_counts", f"SELECT profile, {', '.join(f'count(*) FILTER ({f}) AS {f}' for f in policy.FLAGS)} FROM ({POLICY_SQL}) GROUP BY profile")
def policy_counts(spark, sf_dir):
    return policies(spark, sf_dir).groupBy("profile").agg(*(F.count_if(f).alias(f) for f in policy.FLAGS))


@query(
    "kv_policy_signals",
    f"""WITH {RECENT}, d AS (SELECT seq, bytes, bytes - coalesce(lag(bytes) OVER (PARTITION BY k ORDER BY seq), 0) AS step FROM log),
s AS (SELECT seq // 64 AS batch, sum(bytes) AS b, sum(step) AS s FROM d GROUP BY 1),
a AS (SELECT batch, CAST(sum(b) OVER (ORDER BY batch) AS BIGINT) AS t, CAST(sum(s) OVER (ORDER BY batch) AS BIGINT) AS v FROM s)
SELECT batch, queue_depth AS request_queue_depth, recent_peak_queue_depth, recent_read_ratio_per_1000_ops AS recent_read_ratio, 100 * greatest(t - v, 0) // t AS current_obsolete_ratio,
recent_avg_batch_size, recent_avg_batch_wal_bytes, observed_fsync_pressure_per_1000_writes AS observed_fsync_pressure FROM recent JOIN batches USING (batch) JOIN a USING (batch)""",
)
def policy_signals(spark, sf_dir):
    now = V.batches(spark, sf_dir).select("batch", F.col("queue_depth").alias("request_queue_depth"))
    r = recent_window(spark, sf_dir).select("batch", "recent_peak_queue_depth", F.col("recent_read_ratio_per_1000_ops").alias("recent_read_ratio"), "recent_avg_batch_size", "recent_avg_batch_wal_bytes", F.col("observed_fsync_pressure_per_1000_writes").alias("observed_fsync_pressure"))
    a = running_live_bytes(spark, sf_dir).select("batch", F.col("obsolete_percent").alias("current_obsolete_ratio"))
    return now.join(r, "batch").join(a, "batch")


@query("kv_batches_by_count", "SELECT event_id, (row_number() OVER (ORDER BY event_id) - 1) // 48 AS batch FROM events WHERE event_type <> 'view'")
def batches_by_count(spark, sf_dir):
    writes = V.table(spark, sf_dir, "events").where("event_type <> 'view'").select("event_id")
    return numbered(writes, "event_id", "place").select("event_id", batching.by_count(F.col("place"), 48).alias("batch"))


@query(
    "kv_batches_by_bytes",
    f"""WITH RECURSIVE {LOG}, q AS (SELECT k % 16 AS store, seq, bytes, event_type = 'signup' AND seq % 9 = 0 AS barrier, row_number() OVER (PARTITION BY k % 16 ORDER BY seq) AS rn FROM log),
g AS (SELECT store, seq, rn, 0::BIGINT AS batch, CASE WHEN barrier THEN 8 ELSE 1 END::BIGINT AS c, bytes::BIGINT AS used FROM q WHERE rn = 1
UNION ALL SELECT q.store, q.seq, q.rn,
  CASE WHEN q.barrier OR g.c >= 8 OR (g.c > 0 AND g.used + q.bytes > 200) THEN g.batch + 1 ELSE g.batch END,
  CASE WHEN q.barrier THEN 8 WHEN g.c >= 8 OR g.used + q.bytes > 200 THEN 1 ELSE g.c + 1 END,
  CASE WHEN q.barrier OR g.c >= 8 OR g.used + q.bytes > 200 THEN q.bytes ELSE g.used + q.bytes END
  FROM g JOIN q ON q.store = g.store AND q.rn = g.rn + 1)
SELECT store, seq, batch FROM g""",
)
def batches_by_bytes(spark, sf_dir):
    e = V.table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "props")
    log = accounting.sized_log(e.select("event_type", "user_id", *state.mutation(F.col("event_id"), V.op_of(), int_key(F.col("user_id")), F.encode("props", "UTF-8"))))
    barrier = (F.col("event_type") == "signup") & (F.col("seq") % 9 == 0)
    queue = log.select((F.col("user_id") % 16).alias("store"), "seq", F.col("bytes").cast("long").alias("bytes"), barrier.alias("barrier"))
    return batching.by_bytes(queue, 8, 200).select("store", "seq", "batch")


DAYS = """d AS (SELECT strftime(ts, '%Y-%m-%d') AS file_name, CAST(count(*) FILTER (event_type <> 'view') AS DOUBLE) AS write_ops_per_s, CAST(count(*) FILTER (event_type = 'view') AS DOUBLE) AS read_ops_per_s,
  CAST(sum(CAST(floor(value * 1000) AS BIGINT)) AS DOUBLE) / count(*) AS avg_write_latency_us, CAST(max(CAST(floor(value * 1000) AS BIGINT)) AS DOUBLE) AS approx_write_latency_p99_us,
  CAST(max(user_id) AS DOUBLE) + 1 AS approx_write_latency_p95_us, CAST(count(DISTINCT user_id) AS DOUBLE) AS observed_fsync_pressure_per_1000_writes, CAST(count(*) FILTER (event_type = 'click') AS DOUBLE) + 1 AS recent_batch_fill_per_1000
  FROM events GROUP BY 1)"""


def day_files(spark, sf_dir) -> DataFrame:
    """Each day of events as the result file of a benchmark."""
    us, kind = F.floor(F.col("value") * 1000).cast("long"), F.col("event_type")
    return V.table(spark, sf_dir, "events").groupBy(F.date_format("ts", "yyyy-MM-dd").alias("file_name")).agg(
        F.count_if(kind != "view").cast("double").alias("write_ops_per_s"), F.count_if(kind == "view").cast("double").alias("read_ops_per_s"),
        (F.sum(us).cast("double") / F.count("*")).alias("avg_write_latency_us"), F.max(us).cast("double").alias("approx_write_latency_p99_us"),
        (F.max("user_id").cast("double") + 1).alias("approx_write_latency_p95_us"), F.countDistinct("user_id").cast("double").alias("observed_fsync_pressure_per_1000_writes"),
        (F.count_if(kind == "click").cast("double") + 1).alias("recent_batch_fill_per_1000"),
    )


GATES_SQL = """write_ops_per_s_pct >= 85 AND read_ops_per_s_pct >= 85 AND avg_write_latency_us_pct <= 125 AND approx_write_latency_p95_us_pct <= 150
  AND approx_write_latency_p99_us_pct <= 175 AND observed_fsync_pressure_per_1000_writes_pct <= 150 AND recent_batch_fill_per_1000_pct >= 75"""


@query(
    "kv_compare_gate",
    f"""WITH {DAYS}, b AS (SELECT * FROM d WHERE file_name = (SELECT min(file_name) FROM d)),
r AS (SELECT d.file_name, {", ".join(f"d.{m} / b.{m} * 100 AS {m}_pct" for m in trends.GATES)} FROM d, b)
SELECT *, {GATES_SQL} AS passed, CASE WHEN {GATES_SQL} THEN 0 ELSE 2 END AS status FROM r""",
)
def compare_gate(spark, sf_dir):
    days = day_files(spark, sf_dir)
    measures = F.struct(*trends.GATES)
    first = days.agg(F.min_by(measures, "file_name").alias("base")).select("base", F.lit(1).alias("one"))
    pairs = days.select("file_name", measures.alias("cand"), F.lit(1).alias("one")).join(F.broadcast(first), "one").drop("one")  # one row
    return trends.compare_baseline(pairs)


def trend_sql(rows: str, by: str, measures: dict[str, str], recent: int) -> str:
    cols = []
    for n, m in measures.items():
        last, first, avg = f"arg_max({m}, file_name)", f"arg_min({m}, file_name)", f"avg({m}) FILTER (rn <= {recent})"
        old, new = (f"(CASE WHEN {x} = 0 THEN 0 ELSE {last} / {x} * 100 END)" for x in (first, avg))
        up, down = ("regressing", "improving") if n == "latency" else ("improving", "regressing")
        kind = lambda x: f"CASE WHEN {x} >= 105 THEN '{up}' WHEN {x} <= 95 THEN '{down}' ELSE 'stable' END"  # noqa: B023, E731
        cols += [f"min({m}) AS min_{n}, max({m}) AS max_{n}, avg({m}) AS avg_{n}, {avg} AS recent_avg_{n}, {old} AS latest_vs_oldest_{n}_pct, {new} AS latest_vs_recent_{n}_pct, {kind(old)} AS {n}_trend, {kind(new)} AS recent_{n}_trend"]
    part, name = (f"PARTITION BY {by} ", f"{by}, ") if by else ("", "")
    return f"SELECT {name}count(*) AS count, min(file_name) AS oldest_file, max(file_name) AS latest_file, count(*) FILTER (rn <= {recent}) AS recent_window_count, {', '.join(cols)} FROM (SELECT *, row_number() OVER ({part}ORDER BY file_name DESC) AS rn FROM {rows}){f' GROUP BY {by}' if by else ''}"


@query("kv_trend_summary", f"WITH {DAYS} " + trend_sql("d", "", trends.MEASURES, 5))
def trend_summary(spark, sf_dir):
    return trends.baseline_trend(day_files(spark, sf_dir))


CASES = "c AS (SELECT strftime(ts, '%Y-%m-%d') AS file_name, event_type AS name, CAST(count(*) AS DOUBLE) AS ops_per_s FROM events GROUP BY 1, 2)"


def day_cases(spark, sf_dir) -> DataFrame:
    return V.table(spark, sf_dir, "events").groupBy(F.date_format("ts", "yyyy-MM-dd").alias("file_name"), F.col("event_type").alias("name")).agg(F.count("*").cast("double").alias("ops_per_s"))


@query("kv_case_trend", f"WITH {CASES} " + trend_sql("c", "name", {"ops": "ops_per_s"}, 5))
def case_trend(spark, sf_dir):
    return trends.case_trend(day_cases(spark, sf_dir))


CASE_NAMES = {"click": "compaction", "purchase": "rewrite", "signup": "recovery"}


@query(
    "kv_microbench_compare",
    f"""WITH {CASES}, n AS (SELECT file_name, CASE name WHEN 'click' THEN 'compaction' WHEN 'purchase' THEN 'rewrite' WHEN 'signup' THEN 'recovery' ELSE name END AS name, ops_per_s FROM c),
b AS (SELECT name, arg_min(ops_per_s, file_name) AS base_ops, arg_max(ops_per_s, file_name) AS cand_ops FROM n GROUP BY 1)
SELECT name, cand_ops / base_ops * 100 AS ops_ratio_pct, CASE name WHEN 'compaction' THEN 75.0 WHEN 'rewrite' THEN 75.0 ELSE 80.0 END::DOUBLE AS min_ratio_pct, cand_ops / base_ops * 100 >= CASE name WHEN 'compaction' THEN 75.0 WHEN 'rewrite' THEN 75.0 ELSE 80.0 END AS passed FROM b ORDER BY name""",
)
def microbench_compare(spark, sf_dir):
    name = F.col("name")
    for old, new in CASE_NAMES.items():
        name = F.when(F.col("name") == old, new).otherwise(name)
    cases = day_cases(spark, sf_dir).select("file_name", name.alias("name"), "ops_per_s")
    position = F.col("file_name")
    base = cases.withColumn("position", F.datediff(F.lit("2100-01-01"), position))  # the first day is the last of these
    return trends.compare_cases(base.select("position", "name", "ops_per_s"), cases.select(position.alias("position"), "name", "ops_per_s"))


FLAG = {"magic_ok": 2, "entry_magic_ok": 3, "snapshot_truncated": 5, "log_truncated": 7}


@query(
    "kv_verify_reason",
    """WITH f AS (SELECT event_id, event_id % 2 <> 1 OR event_id % 3 = 0 AS magic_ok, event_id % 3 <> 2 AS entry_ok, event_id % 5 = 4 AS cut, event_id % 7 = 6 AS torn, 1 + event_id % 11 % 2 AS v, CASE WHEN event_id % 4 = 0 THEN NULL ELSE 1 + event_id % 13 % 2 END AS lv FROM events),
g AS (SELECT event_id, CASE WHEN NOT magic_ok THEN 'snapshot_magic' WHEN NOT entry_ok THEN 'snapshot_entry_magic' WHEN cut THEN 'snapshot_truncated' WHEN torn THEN 'wal_truncated' WHEN v <> 2 OR coalesce(lv <> 2, false) OR torn THEN 'migration_required' ELSE 'current_layout' END AS reason FROM f)
SELECT event_id, reason, CASE WHEN reason = 'current_layout' THEN 0 ELSE 2 END AS status FROM g""",
)
def verify_reason(spark, sf_dir):
    i = F.col("event_id")
    torn = i % 7 == 6
    rewrite = formats.rewrite_recommended(1 + i % 11 % 2, F.when(i % 4 != 0, 1 + i % 13 % 2), torn)
    reason = formats.verify_reason((i % 2 != 1) | (i % 3 == 0), i % 3 != 2, i % 5 == 4, torn, rewrite)
    return V.table(spark, sf_dir, "events").select("event_id", reason.alias("reason")).withColumn("status", formats.verify_status(F.col("reason")))


def le_sql(n: str) -> str:
    return f"[({n}) & 255, ({n}) >> 8 & 255, ({n}) >> 16 & 255, ({n}) >> 24 & 255]"


FNV_SQL = "list_reduce(list_prepend(2166136261, {}), lambda h, b: (xor(h, b) * 16777619) & 4294967295)"
VALUE_BYTES = "CASE WHEN op = 2 THEN []::BIGINT[] ELSE [CAST(ascii(c) AS BIGINT) FOR c IN regexp_extract_all(v, '.')] END"
KEY_BYTES = "[1, (k >> 24) & 255, (k >> 16) & 255, (k >> 8) & 255, k & 255]"


@query(
    "kv_checksum",
    f"""WITH {LOG}, x AS (SELECT seq, op, k, {VALUE_BYTES} AS vb FROM log)
SELECT seq, {FNV_SQL.format(f"list_concat(list_concat(list_concat([op::BIGINT], {le_sql('5::BIGINT')}), list_concat({le_sql('len(vb)')}, {KEY_BYTES})), vb)")} AS checksum,
{FNV_SQL.format(f"list_concat(list_concat([op::BIGINT], {le_sql('k')}), list_concat({le_sql('len(vb)')}, vb))")} AS old_checksum FROM x""",
)
def checksum(spark, sf_dir):
    log = V.changelog(spark, sf_dir)
    args = F.col("op"), F.col("value")
    return log.select("seq", N.record_checksum(args[0], F.col("key_enc"), args[1]).alias("checksum"), N.old_record_checksum(args[0], int_of(F.col("key_enc")), args[1]).alias("old_checksum"))


@query("kv_section_overlap", "WITH s AS (SELECT o_custkey AS container, o_orderkey % 4096 * 16 AS a, 16 + o_orderkey % 97 * 8 AS n FROM orders), l AS (SELECT container, a < lag(a + n) OVER (PARTITION BY container ORDER BY a, n) AS hit FROM s) SELECT container, max(coalesce(hit, false)) AS overlaps FROM l GROUP BY 1")
def section_overlap(spark, sf_dir):
    k = F.col("o_orderkey")
    sections = V.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("container"), (k % 4096 * 16).alias("offset"), (16 + k % 97 * 8).alias("length"))
    return formats.overlapping(sections, "container")


def _plan_sql() -> str:
    end, rows = "128", []
    for i, n in enumerate(("512 + p_partkey % 700", "p_size::BIGINT * 100", "p_partkey * 3", "4096")):
        start = f"(({end}) + 4095) // 4096 * 4096"
        rows.append((i + 1, start, n))
        end = f"{start} + {n}"
    return " UNION ALL ".join(f"SELECT p_partkey AS container, {i} AS type, CAST({s} AS BIGINT) AS \"offset\", CAST({n} AS BIGINT) AS length, CAST({end} AS BIGINT) AS file_bytes FROM part" for i, s, n in rows)


@query("kv_container_plan", _plan_sql())
def container_plan(spark, sf_dir):
    p = F.col("p_partkey")
    sizes = V.table(spark, sf_dir, "part").select(p.alias("container"), (512 + p % 700).alias("metadata"), (F.col("p_size").cast("long") * 100).alias("index"), (p * 3).alias("objects"), F.lit(4096).cast("long").alias("journal"))
    return formats.planned(sizes, "container", 4096)


@query("kv_container_checksum", "SELECT p_partkey, " + FNV_SQL.format(f"list_concat(list_concat([75, 86, 67, 78, 84, 82, 48, 49]::BIGINT[], list_concat({le_sql('1::BIGINT')}, {le_sql('56::BIGINT')})), list_concat(list_concat({le_sql('1::BIGINT')}, list_concat({le_sql('0::BIGINT')}, [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[])), list_concat(list_concat({le_sql('3::BIGINT')}, {le_sql('0::BIGINT')}), list_concat(list_concat({le_sql('p_partkey')}, [0, 0, 0, 0]::BIGINT[]), list_concat({le_sql('p_size::BIGINT')}, [0, 0, 0, 0]::BIGINT[])))))") + " AS checksum FROM part")
def container_checksum(spark, sf_dir):
    section = F.struct(F.lit(3).alias("type"), F.lit(0).alias("flags"), F.col("p_partkey").alias("offset"), F.col("p_size").cast("long").alias("length"))
    return V.table(spark, sf_dir, "part").select("p_partkey", formats.container_checksum(1, F.lit(1), F.lit(0), F.array(section)).alias("checksum"))


@query(
    "kv_metrics_snapshot",
    f"""WITH {BATCHES}, {HISTOGRAM}, c AS (SELECT bucket, CAST(sum(n) OVER (ORDER BY bucket) AS BIGINT) AS seen, CAST(sum(n) OVER () AS BIGINT) AS total FROM h),
t AS (SELECT CAST(sum(bytes) AS BIGINT) AS total_bytes, CAST(sum(bytes) FILTER (rn = 1) AS BIGINT) AS live_bytes FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY seq DESC) AS rn FROM log))
SELECT (SELECT CAST(sum(reads) AS BIGINT) FROM batches) AS read_requests, (SELECT CAST(sum(batch_size) AS BIGINT) FROM batches) AS committed_write_requests, (SELECT count(*) FROM batches) AS committed_write_batches,
(SELECT count(*) FROM batches) AS wal_fsync_calls, total_bytes AS wal_bytes_written, live_bytes AS live_wal_bytes_since_compaction, greatest(total_bytes - live_bytes, 0) AS obsolete_wal_bytes_since_compaction,
100 * greatest(total_bytes - live_bytes, 0) // total_bytes AS observed_obsolete_wal_ratio_percent, (SELECT max(batch_size) FROM batches) AS max_committed_batch_size, (SELECT max(wal_bytes) FROM batches) AS max_committed_batch_wal_bytes,
(SELECT arg_max(batch_size, batch) FROM batches) AS last_committed_batch_size, (SELECT max(queue_depth) FROM batches) AS max_pending_queue_depth, {", ".join(percentile_sql(p).replace(f"p{p}_us", f"approx_write_latency_p{p}_us") for p in (50, 95, 99))} FROM t""",
)
def metrics_snapshot(spark, sf_dir):
    b = V.batches(spark, sf_dir).agg(
        F.sum("reads").alias("read_requests"), F.sum("batch_size").alias("committed_write_requests"), F.count("*").alias("committed_write_batches"), F.count("*").alias("wal_fsync_calls"), F.max("batch_size").alias("max_committed_batch_size"),
        F.max("wal_bytes").alias("max_committed_batch_wal_bytes"), F.max_by("batch_size", "batch").alias("last_committed_batch_size"), F.max("queue_depth").alias("max_pending_queue_depth"), F.lit(1).alias("one"),
    )
    a = live_bytes(spark, sf_dir).select(F.col("total_bytes").alias("wal_bytes_written"), F.col("live_bytes").alias("live_wal_bytes_since_compaction"), F.col("obsolete_bytes").alias("obsolete_wal_bytes_since_compaction"), F.col("obsolete_percent").alias("observed_obsolete_wal_ratio_percent"), F.lit(1).alias("one"))
    p = latency_percentiles(spark, sf_dir).select(*(F.col(f"p{x}_us").alias(f"approx_write_latency_p{x}_us") for x in (50, 95, 99)), F.lit(1).alias("one"))
    return b.join(a, "one").join(p, "one").drop("one")  # three rows in all


@query("kv_line_parse", "SELECT event_id, event_type AS kind, CAST(user_id AS VARCHAR) AS \"user\", 'a=b' AS note FROM events")
def line_parse(spark, sf_dir):
    line = to_line({"kind": F.lit("first"), "user": F.col("user_id"), "note": F.lit("a=b"), " kind": F.col("event_type")})
    parsed = V.table(spark, sf_dir, "events").select("event_id", formats.kv_line(line).alias("m"))
    return parsed.select("event_id", F.col("m.kind").alias("kind"), F.col("m.user").alias("user"), F.col("m.note").alias("note"))


@query("kv_state_check", f"WITH {LOG}, s AS (SELECT k, v FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY seq DESC) AS rn FROM log) WHERE rn = 1 AND op = 1) SELECT {HEX.format('c_custkey')} AS key_hex FROM customer LEFT JOIN s ON k = c_custkey WHERE (CASE WHEN c_custkey % 2 = 0 THEN NULL ELSE '{{\"k\": 1}}' END) IS DISTINCT FROM v")
def state_check(spark, sf_dir):
    expected = V.table(spark, sf_dir, "customer").select(int_key(F.col("c_custkey")).alias("key_enc"), F.when(F.col("c_custkey") % 2 != 0, F.encode(F.lit('{"k": 1}'), "UTF-8")).alias("value"))
    return state.mismatches(expected, state.current_state(V.changelog(spark, sf_dir))).select(F.hex("key_enc").alias("key_hex"))


@query("kv_live_objects", f"WITH {LOG} SELECT count(*) AS live_objects FROM (SELECT op, row_number() OVER (PARTITION BY k ORDER BY seq DESC) AS rn FROM log) WHERE rn = 1 AND op = 1")
def live_objects(spark, sf_dir):
    return state.latest(V.changelog(spark, sf_dir)).agg(F.count_if(F.col("op") == 1).alias("live_objects"))


@query("kv_snapshot_bytes", f"WITH {LOG}, s AS (SELECT v FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY seq DESC) AS rn FROM log) WHERE rn = 1 AND op = 1) SELECT CAST(16 + sum(12 + 5 + strlen(v)) AS BIGINT) AS snapshot_bytes FROM s")
def snapshot_bytes(spark, sf_dir):
    size = F.sum(N.entry_bytes(F.col("key_enc"), F.col("value")))
    return state.current_state(V.changelog(spark, sf_dir)).agg((N.SNAPSHOT_BYTES + F.coalesce(size, F.lit(0))).alias("snapshot_bytes"))


#: The recommended options once more, written out: the SQL doesn't take them from the engine.
OPTION_NAMES = [f.name for f in fields(Options)]
OPTIONS_SQL = f"""SELECT * FROM (VALUES
  ('balanced', 32, 1048576, 2000, 64, 512, true, 1, 3, 2, 2, 16, 2, 1, 1, 500, 500, 2, 2, 8000, 700, 4, 2, true, 8, 4, 100, 12000, 350, 2, 8000, 50, 2, 200, 2, 6000, 1048576, 60, true, 8, 4, 4),
  ('write-heavy', 64, 2097152, 4000, 64, 512, true, 1, 3, 2, 4, 32, 3, 1, 1, 500, 500, 2, 2, 8000, 700, 4, 2, true, 16, 4, 100, 12000, 350, 2, 8000, 50, 2, 200, 2, 6000, 4194304, 70, true, 8, 4, 4),
  ('read-heavy', 16, 1048576, 1000, 64, 512, true, 1, 4, 4, 1, 16, 2, 1, 1, 500, 500, 2, 2, 8000, 600, 8, 4, true, 4, 4, 100, 12000, 350, 2, 8000, 50, 2, 200, 2, 6000, 1048576, 60, true, 8, 4, 4),
  ('low-latency', 8, 65536, 500, 64, 512, true, 1, 5, 2, 1, 8, 2, 1, 1, 500, 1500, 4, 2, 8000, 700, 4, 2, true, 2, 8, 50, 4000, 350, 2, 8000, 50, 2, 200, 2, 6000, 1048576, 60, true, 8, 4, 4)
) AS t(profile, {", ".join(OPTION_NAMES)})"""


@query("kv_profiles", f"SELECT profile, {', '.join(f'CAST({n} AS ' + ('BOOLEAN' if n.endswith('_enabled') else 'BIGINT') + f') AS {n}' for n in OPTION_NAMES)} FROM ({OPTIONS_SQL})")
def profiles(spark, sf_dir):
    return options_frame(spark, {n: o.sane() for n, o in RECOMMENDED.items()})


@query("kv_options_json", f"SELECT profile, CAST(json_object({', '.join(f"'{n}', {n}" for n in OPTION_NAMES)}) AS VARCHAR) AS json FROM ({OPTIONS_SQL})")
def options_json(spark, sf_dir):
    return profiles(spark, sf_dir).select("profile", F.to_json(F.struct(*OPTION_NAMES)).alias("json"))


@query(
    "kv_soak_profiles",
    """SELECT profile, a::BIGINT AS writer_count, b::BIGINT AS reader_count, c::BIGINT AS key_space, d::BIGINT AS compaction_interval_ms, e::BIGINT AS max_batch_size, f::BIGINT AS max_batch_delay_us
FROM (VALUES ('balanced', 4, 2, 256, 50, 32, 2000), ('write-heavy', 6, 1, 512, 80, 64, 4000), ('read-heavy', 2, 6, 256, 30, 16, 1000)) AS t(profile, a, b, c, d, e, f)""",
)
def soak_profiles(spark, sf_dir):
    return profile_summaries(spark, "soak")


@query(
    "kv_stress_profiles",
    """SELECT profile, a::BIGINT AS writer_count, b::BIGINT AS reader_count, c::BIGINT AS compactor_count, d::BIGINT AS keys_per_writer, e::BIGINT AS compaction_interval_ms, f::BIGINT AS batch_width,
  g::BIGINT AS recovery_reopen_cycles, h::BIGINT AS max_batch_size, i::BIGINT AS max_batch_delay_us, j::BIGINT AS auto_compact_wal_bytes_threshold
FROM (VALUES ('balanced', 8, 4, 1, 96, 5, 4, 1, 32, 1500, 4096), ('write-heavy', 12, 2, 1, 128, 8, 4, 1, 64, 2500, 8192), ('compaction-heavy', 6, 3, 2, 80, 1, 4, 1, 24, 800, 2048), ('recovery-heavy', 4, 1, 1, 64, 2, 3, 6, 16, 700, 2048)) AS t(profile, a, b, c, d, e, f, g, h, i, j)""",
)
def stress_profiles(spark, sf_dir):
    return profile_summaries(spark, "stress")


NAMES_SQL = "SELECT DISTINCT c_mktsegment AS name, CASE c_mktsegment WHEN 'BUILDING' THEN 'balanced' WHEN 'MACHINERY' THEN '{0}' WHEN 'FURNITURE' THEN '{1}' END AS profile, '{2}' AS family FROM customer"


@query("kv_profile_names", " UNION ALL ".join(NAMES_SQL.format(*x) for x in (("low-latency", "read-heavy", "recommended"), ("write-heavy", "read-heavy", "soak"), ("compaction-heavy", "recovery-heavy", "stress"))))
def profile_names(spark, sf_dir):
    """Names of each family that stand for a profile; of another family's names, and of others, none does."""
    named = {"MACHINERY": ["low-latency", "write-heavy", "compaction-heavy"], "FURNITURE": ["read-heavy", "read-heavy", "recovery-heavy"], "BUILDING": ["balanced"] * 3}
    out = None
    for i, (family, presets) in enumerate(FAMILIES.items()):
        text = F.col("c_mktsegment")
        for segment, names in named.items():
            text = F.when(F.col("c_mktsegment") == segment, names[i]).otherwise(text)
        one = V.table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("name"), F.when(text.isin(*presets), text).alias("profile"), F.lit(family).alias("family")).distinct()
        out = one if out is None else out.union(one)
    return out


def _folder(spark, name: str) -> str:
    """A new folder that all executors share."""
    base = spark.conf.get("spark.checkpoint.dir", None) or "file:///tmp/checkpoints"
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def kept(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read again, for plans that use it several times."""
    path = _folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@query("kv_log_files", CURRENT)
def log_files(spark, sf_dir):
    """The log written as binary files, one for each store by key, read back and merged."""
    path = _folder(spark, "logs")
    files.write_stores(V.changelog(spark, sf_dir).withColumn("store", F.concat(F.lit("log-"), F.pmod(F.xxhash64("key_enc"), F.lit(STORES)))), path, "log")
    return shown(state.current_state(files.load(spark, path, "log")))


@query("kv_snapshot_files", MERGED)
def snapshot_files(spark, sf_dir):
    """Base and log compacted to binary snapshots, and read back."""
    path = _folder(spark, "snapshots")
    merged = state.merged(V.base_snapshot(spark, sf_dir), V.changelog(spark, sf_dir))
    files.write_stores(merged.withColumn("store", F.concat(F.lit("snapshot-"), F.pmod(F.xxhash64("key_enc"), F.lit(STORES)))), path, "snapshot")
    return shown(state.current_state(files.load(spark, path, "snapshot")))


@query("kv_stream_state", CURRENT)
def stream_state(spark, sf_dir):
    """The log arriving as a stream of files, each micro-batch committed and published."""
    folder = _folder(spark, "stream")
    V.changelog(spark, sf_dir).repartitionByRange(4, "seq").write.parquet(f"{folder}/in")
    changes = spark.readStream.schema(CHANGE).option("maxFilesPerTrigger", 2).parquet(f"{folder}/in")
    streamed = StreamedState(spark, f"{folder}/out", Options(auto_compact_wal_bytes_threshold=1 << 20))
    query = streamed.start(changes, f"{folder}/checkpoint")
    try:
        query.awaitTermination()
    finally:
        query.stop()
    return shown(streamed.state())


MIXED = """s AS (SELECT unnest(range(8)) AS n), c AS (SELECT c_custkey % 8 AS n, count(*) AS entries, sum(strlen(c_name)) AS chars FROM customer GROUP BY 1),
l AS (SELECT k % 8 AS n, count(*) AS records, count(*) FILTER (op = 1) AS puts, count(*) FILTER (op = 2) AS deletes, sum(CASE WHEN op = 1 THEN strlen(v) ELSE 0 END) AS chars, arg_min(op, seq) AS first_op FROM log GROUP BY 1),
i AS (SELECT 's' || n AS store, 1::BIGINT AS magic_ok, (CASE WHEN n % 4 = 2 THEN 1 ELSE 2 END)::BIGINT AS version, entries, entries AS int_keys, 0::BIGINT AS string_keys, 0::BIGINT AS binary_keys, 0::BIGINT AS unknown_keys,
  1::BIGINT AS entry_magic_ok, 0::BIGINT AS truncated, (16 + c.chars + entries * CASE WHEN n % 4 = 2 THEN 12 ELSE 17 END)::BIGINT AS size, 1::BIGINT AS log_exists, 1263949633::BIGINT AS log_magic,
  (CASE WHEN n % 4 = 1 THEN 1 ELSE 2 END)::BIGINT AS log_version, first_op::BIGINT AS first_type, (l.chars + records * CASE WHEN n % 4 = 1 THEN 20 ELSE 25 END + CASE WHEN n % 4 = 3 THEN 3 ELSE 0 END)::BIGINT AS log_size,
  records, puts, deletes, records AS log_int_keys, 0::BIGINT AS log_string_keys, 0::BIGINT AS log_binary_keys, 0::BIGINT AS log_unknown_keys, 0::BIGINT AS unknown_types,
  (n % 4 = 3)::BIGINT AS log_truncated, (n % 4 <> 0)::BIGINT AS rewrite_recommended, ['current_layout', 'migration_required', 'migration_required', 'wal_truncated'][n % 4 + 1] AS reason
  FROM s JOIN c USING (n) JOIN l USING (n))"""


def mixed_stores(spark, sf_dir) -> str:
    """Eight stores by key, written as files: every fourth has a first-format log, a first-format snapshot, or a torn log."""
    folder = _folder(spark, "stores")
    number = F.pmod(int_of(F.col("key_enc")), F.lit(8))
    named = lambda df: df.withColumn("n", number).withColumn("store", F.concat(F.lit("s"), "n"))
    files.write_stores(named(V.base_snapshot(spark, sf_dir)).withColumn("version", F.when(F.col("n") % 4 == 2, 1).otherwise(2)), f"{folder}/snapshots", "snapshot")
    torn = F.when(F.col("n") % 4 == 3, F.lit(b"\xaa\xbb\xcc"))
    files.write_stores(named(V.changelog(spark, sf_dir)).withColumn("version", F.when(F.col("n") % 4 == 1, 1).otherwise(2)).withColumn("tail", torn), f"{folder}/logs", "log")
    return folder


def inspected(spark, folder: str) -> DataFrame:
    """The counts of all stores of a folder with the verdict on each."""
    yes = lambda c: F.col(c) == 1
    reason = formats.verify_reason(yes("magic_ok"), yes("entry_magic_ok"), yes("truncated"), yes("log_truncated"), yes("rewrite_recommended"))
    return files.load(spark, folder, "inspect").withColumn("reason", reason).withColumn("status", formats.verify_status(F.col("reason")))


@query("kv_inspect", f"WITH {LOG}, {MIXED} SELECT *, CASE WHEN reason = 'current_layout' THEN 0 ELSE 2 END AS status FROM i")
def inspect(spark, sf_dir):
    return inspected(spark, mixed_stores(spark, sf_dir))


@query(
    "kv_inspect_lines",
    f"""WITH {LOG}, {MIXED} SELECT store, 'snapshot_exists=1 snapshot_magic_ok=1 snapshot_version=' || version || ' snapshot_entries=' || entries || ' snapshot_int_keys=' || int_keys ||
  ' snapshot_string_keys=0 snapshot_binary_keys=0 snapshot_unknown_key_types=0 snapshot_entry_magic_ok=1 snapshot_truncated=0 snapshot_size=' || size || ' wal_exists=1 wal_empty=0 wal_magic=0x4b565741 wal_version=' || log_version ||
  ' wal_first_type=' || first_type || ' wal_size=' || log_size || ' wal_records=' || records || ' wal_put_records=' || puts || ' wal_delete_records=' || deletes || ' wal_int_keys=' || records ||
  ' wal_string_keys=0 wal_binary_keys=0 wal_unknown_key_types=0 wal_unknown_record_types=0 wal_truncated=' || log_truncated || ' rewrite_recommended=' || rewrite_recommended || ' verify_reason=' || reason AS line FROM i""",
)
def inspect_lines(spark, sf_dir):
    return inspect(spark, sf_dir).select("store", F.concat(inspect_line(), F.lit(" verify_reason="), "reason").alias("line"))


@query("kv_rewrite_format", MERGED)
def rewrite_format(spark, sf_dir):
    """Stores of all formats brought to the current one, and read again; all must verify then."""
    folder = mixed_stores(spark, sf_dir)
    files.rewritten(spark, folder, f"{folder}/new")
    bad = F.when(F.col("status") != 0, F.raise_error(F.concat(F.col("store"), F.lit(": "), F.col("reason"))).cast("string"))
    verified = inspected(spark, f"{folder}/new").select(F.coalesce(bad, F.col("store")).alias("store"))
    return shown(state.current_state(files.load(spark, f"{folder}/new/snapshots", "snapshot").join(F.broadcast(verified), "store")))  # a row for each store


@query("kv_log_kinds", f"WITH {LOG}, {MIXED} SELECT store, records, records AS int_keys, 0::BIGINT AS string_keys, 0::BIGINT AS binary_keys, 0::BIGINT AS unknown_keys, puts, deletes FROM i")
def log_kinds(spark, sf_dir):
    """Kinds of keys and types of records in each store's log file, the first format and torn tails included."""
    log = files.load(spark, f"{mixed_stores(spark, sf_dir)}/logs", "log")
    kind, op = key_kind(F.col("key_enc")), F.col("op")
    return log.groupBy("store").agg(F.count("*").alias("records"), *(F.count_if(kind == k).alias(f"{k}_keys") for k in ("int", "string", "binary", "unknown")), F.count_if(op == 1).alias("puts"), F.count_if(op == 2).alias("deletes"))


#: When the stores of the replay compact, and how many changes are a batch of theirs.
REPLAYED, REPLAY_BATCH = Options(auto_compact_wal_bytes_threshold=2000, auto_compact_invalid_wal_ratio_percent=60), 16
FULL = "({0}.total >= 2000 OR ({0}.total > 0 AND 100 * greatest({0}.total - {0}.live, 0) >= 60 * {0}.total))"
REPLAY_SQL = f"""{LOG}, q AS (SELECT k % 16 AS store, seq, op, k, v, bytes, (row_number() OVER (PARTITION BY k % 16 ORDER BY seq) - 1) // 16 AS batch FROM log),
y AS (SELECT store, batch, k, sum(bytes) AS b, arg_max(bytes, seq) AS last FROM q GROUP BY 1, 2, 3),
z AS (SELECT *, lag(batch) OVER (PARTITION BY store, k ORDER BY batch) AS pb, lag(last) OVER (PARTITION BY store, k ORDER BY batch) AS pl FROM y),
t AS (SELECT store, batch, CAST(sum(b) AS BIGINT) AS b, CAST(sum(last) AS BIGINT) AS l, list({{'pb': pb, 'pl': pl}}) FILTER (pb IS NOT NULL) AS prev FROM z GROUP BY 1, 2),
g AS (SELECT store, batch, b AS total, l AS live, -1::BIGINT AS since FROM t WHERE batch = 0
UNION ALL SELECT t.store, t.batch, CASE WHEN {FULL.format("g")} THEN 0 ELSE g.total END + t.b,
  CASE WHEN {FULL.format("g")} THEN t.l ELSE g.live + t.l - coalesce(CAST(list_sum([p.pl FOR p IN t.prev IF p.pb > g.since]) AS BIGINT), 0) END,
  CASE WHEN {FULL.format("g")} THEN g.batch ELSE g.since END
  FROM g JOIN t ON t.store = g.store AND t.batch = g.batch + 1)"""


def store_log(spark, sf_dir) -> DataFrame:
    """Sixteen stores by key, each with its changes in batches."""
    log = accounting.sized_log(V.changelog(spark, sf_dir)).withColumn("store", F.pmod(int_of(F.col("key_enc")), F.lit(16)).cast("long"))
    return numbered(log, "seq", "place", by=["store"]).withColumn("batch", batching.by_count(F.col("place"), REPLAY_BATCH))


@query("kv_autocompact_replay", f"WITH RECURSIVE {REPLAY_SQL} SELECT store, batch, total AS total_bytes, live AS live_bytes, {FULL.format('g')} AS compacted FROM g")
def autocompact_replay(spark, sf_dir):
    return store.replay(store_log(spark, sf_dir), REPLAYED)


@query(
    "kv_compaction_totals",
    f"""WITH RECURSIVE {REPLAY_SQL}, e AS (SELECT store, batch, k, arg_max(CASE WHEN op = 1 THEN 17 + strlen(v) ELSE 0 END, seq) AS size FROM q GROUP BY 1, 2, 3),
f AS (SELECT store, batch, sum(size - coalesce(before, 0)) AS step FROM (SELECT *, lag(size) OVER (PARTITION BY store, k ORDER BY batch) AS before FROM e) GROUP BY 1, 2),
h AS (SELECT store, batch, 16 + sum(step) OVER (PARTITION BY store ORDER BY batch) AS snapshot_bytes FROM f)
SELECT store, count(*) FILTER ({FULL.format("g")}) AS compactions, CAST(coalesce(sum(snapshot_bytes) FILTER ({FULL.format("g")}), 0) AS BIGINT) AS snapshot_bytes_written,
  CAST(coalesce(sum(total) FILTER ({FULL.format("g")}), 0) AS BIGINT) AS log_bytes_reclaimed FROM g JOIN h USING (store, batch) GROUP BY 1""",
)
def compaction_totals(spark, sf_dir):
    log = store_log(spark, sf_dir)
    return store.compaction_totals(store.replay(log, REPLAYED), store.snapshot_sizes(log))


SIGNALS_SQL = f"""{RECENT}, {HISTOGRAM}, {SAMPLES}, d1 AS (SELECT seq, bytes, bytes - coalesce(lag(bytes) OVER (PARTITION BY k ORDER BY seq), 0) AS step FROM log),
s1 AS (SELECT seq // 64 AS batch, max(seq) AS last_seq, sum(bytes) AS b, sum(step) AS s FROM d1 GROUP BY 1),
a1 AS (SELECT batch, last_seq, CAST(sum(b) OVER (ORDER BY batch) AS BIGINT) AS t, CAST(sum(s) OVER (ORDER BY batch) AS BIGINT) AS v FROM s1),
sig AS (SELECT batch, queue_depth AS d, recent_peak_queue_depth AS p, recent_read_ratio_per_1000_ops AS rr, 100 * greatest(t - v, 0) // t AS ob, recent_avg_batch_size AS ab, recent_avg_batch_wal_bytes AS aw,
  recent_p95_us AS lat, observed_fsync_pressure_per_1000_writes AS fs FROM recent JOIN batches USING (batch) JOIN a1 USING (batch) JOIN p ON p.seq = last_seq)"""


def full_signals(spark, sf_dir) -> DataFrame:
    """The eight signals as they stand after each batch."""
    last = V.samples(spark, sf_dir).groupBy(F.expr(f"seq div {V.BATCH}").alias("batch")).agg(F.max("seq").alias("seq"))
    p95 = recent_p95(spark, sf_dir).join(last, "seq").select("batch", F.col("recent_p95_us").alias("observed_p95_us"))
    return kept(policy_signals(spark, sf_dir).join(p95, "batch"), "signals")


def policies_on_signals(signals: DataFrame, names: dict[str, Options]) -> DataFrame:
    out = None
    for name, options in names.items():
        one = policy.with_policy(signals, options.sane()).select(F.lit(name).alias("profile"), "batch", *policy.POLICY)
        out = one if out is None else out.unionByName(one)
    return out


@query("kv_policy_on_signals", f"WITH {SIGNALS_SQL} " + " UNION ALL ".join(policy_sql(n, o, "SELECT * FROM sig", "batch") for n, o in POLICIES.items()))
def policy_on_signals(spark, sf_dir):
    return policies_on_signals(full_signals(spark, sf_dir), POLICIES)


#: Which flag each counter of batches counts.
COUNTERS = {
    "adaptive_batches_completed": "adaptive_batching", "adaptive_flush_batches_completed": "adaptive_flush", "adaptive_latency_target_batches_completed": "latency_target_adjusted",
    "adaptive_fsync_pressure_batches_completed": "fsync_pressure_adjusted", "adaptive_read_heavy_batches_completed": "read_heavy_adjusted", "adaptive_compaction_pressure_batches_completed": "compaction_pressure_adjusted",
    "adaptive_wal_growth_batches_completed": "wal_growth_adjusted", "adaptive_objective_short_delay_batches_completed": "objective_short_delay_adjusted", "adaptive_objective_long_delay_batches_completed": "objective_long_delay_adjusted",
    "adaptive_objective_throughput_batches_completed": "objective_throughput_score > 0",
}
LAST_SCORES = ["pressure_score", "cost_score", "throughput_score", "balance_score"]
ZERO = ["compact_requests", "pending_queue_depth", "manual_compactions_completed", "auto_compactions_completed", "writer_wait_events", "writer_wait_time_us", "total_snapshot_bytes_written", "total_wal_bytes_reclaimed_by_compaction"]


def metrics_sql() -> str:
    of = {n: f"(SELECT count(*) FILTER ({f}) FROM pol)" for n, f in COUNTERS.items()} | dict.fromkeys(ZERO, "0")
    of |= {f"last_objective_{x}": f"(SELECT arg_max(objective_{x}, batch) FROM pol)" for x in [*LAST_SCORES, "mode"]}
    of |= {f"{k}_effective_batch_delay_us": f"(SELECT {f} FROM pol)" for k, f in (("last", "arg_max(batch_delay_us, batch)"), ("min", "min(batch_delay_us) FILTER (batch_delay_us > 0)"), ("max", "max(batch_delay_us)"))}
    of |= {n: f"(SELECT {f} FROM batches)" for n, f in {
        "read_requests": "CAST(sum(reads) AS BIGINT)", "enqueued_write_requests": "CAST(sum(batch_size) AS BIGINT)", "committed_write_requests": "CAST(sum(batch_size) AS BIGINT)", "committed_write_batches": "count(*)", "wal_fsync_calls": "count(*)",
        "wal_bytes_written": "CAST(sum(wal_bytes) AS BIGINT)", "wal_bytes_since_compaction": "CAST(sum(wal_bytes) AS BIGINT)", "last_committed_batch_size": "arg_max(batch_size, batch)", "max_committed_batch_size": "max(batch_size)",
        "last_committed_batch_wal_bytes": "arg_max(wal_bytes, batch)", "max_committed_batch_wal_bytes": "max(wal_bytes)", "max_pending_queue_depth": "max(queue_depth)",
    }.items()}
    of |= {"live_wal_bytes_since_compaction": "(SELECT arg_max(v, batch) FROM a1)", "obsolete_wal_bytes_since_compaction": "(SELECT arg_max(greatest(t - v, 0), batch) FROM a1)", "observed_obsolete_wal_ratio_percent": "(SELECT arg_max(100 * greatest(t - v, 0) // t, batch) FROM a1)"}
    of |= {f"approx_write_latency_p{p}_us": percentile_sql(p).replace(f" AS p{p}_us", "") for p in (50, 95, 99)}
    of |= {n: f"(SELECT arg_max({n}, batch) FROM recent)" for n in METRICS if n.startswith(("recent_", "observed_fsync")) and n != "recent_observed_write_latency_p95_us"}
    of |= {"recent_observed_write_latency_p95_us": "(SELECT arg_max(lat, batch) FROM sig)", "write_latency_histogram": "(SELECT list(n ORDER BY bucket) FROM h)"}
    pol = policy_sql("balanced", RECOMMENDED["balanced"], "SELECT * FROM sig", "batch")
    return f"WITH {SIGNALS_SQL}, pol AS ({pol}), c AS (SELECT bucket, CAST(sum(n) OVER (ORDER BY bucket) AS BIGINT) AS seen, CAST(sum(n) OVER () AS BIGINT) AS total FROM h) SELECT CAST(json_object({', '.join(f"'{n}', {of[n]}" for n in METRICS)}) AS VARCHAR) AS json"


@query("kv_metrics_json", metrics_sql())
def metrics_json(spark, sf_dir):
    """All metrics of a store that committed the events in batches under the balanced profile, without compactions or waits."""
    one = F.lit(1).alias("one")
    signals = full_signals(spark, sf_dir)
    pol = policies_on_signals(signals, {"balanced": RECOMMENDED["balanced"]})
    delay = F.col("batch_delay_us")
    p = pol.agg(
        *(F.count_if(F.expr(f)).alias(n) for n, f in COUNTERS.items()), *(F.max_by(f"objective_{x}", "batch").alias(f"last_objective_{x}") for x in [*LAST_SCORES, "mode"]),
        F.max_by(delay, "batch").alias("last_effective_batch_delay_us"), F.min(F.when(delay > 0, delay)).alias("min_effective_batch_delay_us"), F.max(delay).alias("max_effective_batch_delay_us"), one,
    )
    b = V.batches(spark, sf_dir).agg(
        F.sum("reads").alias("read_requests"), F.sum("batch_size").alias("enqueued_write_requests"), F.sum("batch_size").alias("committed_write_requests"), F.count("*").alias("committed_write_batches"), F.count("*").alias("wal_fsync_calls"),
        F.sum("wal_bytes").alias("wal_bytes_written"), F.sum("wal_bytes").alias("wal_bytes_since_compaction"), F.max_by("batch_size", "batch").alias("last_committed_batch_size"), F.max("batch_size").alias("max_committed_batch_size"),
        F.max_by("wal_bytes", "batch").alias("last_committed_batch_wal_bytes"), F.max("wal_bytes").alias("max_committed_batch_wal_bytes"), F.max("queue_depth").alias("max_pending_queue_depth"), one,
    )
    a = live_bytes(spark, sf_dir).select(F.col("live_bytes").alias("live_wal_bytes_since_compaction"), F.col("obsolete_bytes").alias("obsolete_wal_bytes_since_compaction"), F.col("obsolete_percent").alias("observed_obsolete_wal_ratio_percent"), one)
    h = latency_histogram(spark, sf_dir).agg(F.transform(F.array_sort(F.collect_list(F.struct("bucket", "n"))), lambda x: x["n"]).alias("write_latency_histogram"), one)  # twelve buckets
    t = latency_percentiles(spark, sf_dir).select(*(F.col(f"p{x}_us").alias(f"approx_write_latency_p{x}_us") for x in (50, 95, 99)), one)
    r = recent_window(spark, sf_dir)
    r = r.agg(F.max_by(F.struct(*(c for c in r.columns if c != "batch")), "batch").alias("r"), one).select("r.*", "one")
    s = signals.agg(F.max_by("observed_p95_us", "batch").alias("recent_observed_write_latency_p95_us"), one)
    for x in (a, h, t, r, s, p):
        b = b.join(x, "one")  # each is a row
    return to_json(b.withColumns({n: F.lit(0) for n in ZERO}), columns={n: n for n in METRICS})


@query("kv_qualification", f"WITH {LOG} SELECT k % 16 AS store, count(*) FILTER (op = 1) AS put_operations, CASE WHEN count(*) FILTER (op = 1) >= 500 THEN 'pass' ELSE 'fail' END AS status FROM log GROUP BY 1")
def qualification(spark, sf_dir):
    puts = store_log(spark, sf_dir).groupBy("store").agg(F.count_if(F.col("op") == 1).alias("put_operations"))
    return qualified(puts, 500)
