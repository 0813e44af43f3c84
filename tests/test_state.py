"""Value-level cases of the store: state, keys, accounting, files, streams."""

import io

import pytest
from pyspark.sql import functions as F

from tidewell.functions import numbers as N
from tidewell.functions.keys import binary_key, int_key, int_of, key_kind, string_key, string_of
from tidewell.operators import accounting, batching, formats, policy, state, trends
from tidewell.functions.options import BENCHMARK, RECOMMENDED, Options, profile
from tidewell.operators.ordered import numbered, running_sum, sliding
from tidewell.sources import files

I = lambda k: b"\x01" + (k & 0xFFFFFFFF).to_bytes(4, "big")  # noqa: E731, E741
S = lambda k: b"\x02" + k.encode()
LOG = "seq long, sub_seq int, op int, key_enc binary, value binary"


def log(spark, *ops):
    """('put', key, value) or ('delete', key), in order."""
    rows = [(i, 0, 1 if o[0] == "put" else 2, o[1], o[2].encode() if o[0] == "put" else None) for i, o in enumerate(ops)]
    return spark.createDataFrame(rows, LOG)


def content(df):
    return {bytes(r.key_enc): bytes(r.value).decode() for r in df.collect()}


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_namespaces_and_codec(spark):
    b = b"\x00\xff42"
    df = log(spark, ("put", I(42), "int"), ("put", S("42"), "string"), ("put", b"\x03" + b"42", "binary"), ("put", b"\x03" + b, "raw"))
    assert len(content(state.current_state(df))) == 4
    got = one(spark, int_key(F.lit(-1)), int_key(F.lit(42)), string_key(F.lit("a")), binary_key(F.lit(b)), int_of(int_key(F.lit(-7))), string_of(string_key(F.lit("é"))), key_kind(F.lit(b"")), key_kind(F.lit(b"\x04")))
    assert [bytes(x) for x in got[:4]] == [I(-1), I(42), S("a"), b"\x03" + b]
    assert list(got[4:]) == [-7, "é", "unknown", "unknown"]
    with pytest.raises(Exception, match="not a string key"):
        one(spark, string_of(F.lit(I(1))))


def test_scan_is_inclusive_and_ordered(spark):
    df = state.current_state(log(spark, *(("put", S(k), k) for k in ("date", "apple", "carrot", "banana")), ("put", I(7), "n")))
    keys = lambda a, b: [bytes(r.key_enc)[1:].decode() for r in state.range_scan(df, a, b).collect()]
    assert keys("banana", "date") == ["banana", "carrot", "date"]
    assert keys("x", "a") == []
    many = state.current_state(log(spark, *(("put", S(f"scan:{i}"), "") for i in range(2000))))
    assert state.range_scan(many, "scan:100", "scan:399").count() == 1331


def test_order_of_log_and_batches(spark):
    assert content(state.current_state(log(spark, ("put", I(3), "v1"), ("delete", I(3)), ("put", I(3), "v2"), ("put", I(4), "keep"), ("delete", I(9))))) == {I(3): "v2", I(4): "keep"}
    ops = [(1, I(7), b"first"), (2, I(7), None), (1, I(7), b"second"), (1, S("g"), b"a"), (1, S("g"), b"b")]
    kind = "request_id long, ops array<struct<op:int,key_enc:binary,value:binary>>"
    assert content(state.current_state(state.batch_changes(spark.createDataFrame([(1, ops), (2, [])], kind)))) == {I(7): "second", S("g"): "b"}


def test_recovery_keeps_empty_values_and_drops_deletes(spark):
    base = spark.createDataFrame([(I(1), b"old"), (I(2), b"gone"), (I(5), b"")], "key_enc binary, value binary")
    assert content(state.merged(base, log(spark, ("put", I(1), "new"), ("delete", I(2))))) == {I(1): "new", I(5): ""}
    assert content(state.merged(base, log(spark, ("put", I(1), "x")).limit(0))) == {I(1): "old", I(2): "gone", I(5): ""}


def test_record_sizes_and_accounting(spark):
    got = one(spark, N.record_bytes(F.lit(1), F.lit(b"alpha"), F.lit(b"value")), N.record_bytes(F.lit(2), F.lit(b"gamma"), F.lit(None).cast("binary")))
    assert list(got) == [30, 25]
    a = accounting.log_account(log(spark, ("put", S("a"), "1"), ("put", S("a"), "22"), ("delete", S("b")))).first()
    assert (a.total_bytes, a.live_bytes, a.obsolete_bytes) == (23 + 24 + 22, 24 + 22, 23)
    assert accounting.log_account(log(spark, ("put", S("a"), "1")).limit(0)).first().asDict() == {"total_bytes": 0, "live_bytes": 0, "obsolete_bytes": 0, "obsolete_percent": 0}
    flags = one(spark, N.should_compact(F.lit(100), F.lit(50), 0, 40), N.should_compact(F.lit(100), F.lit(80), 0, 40), N.should_compact(F.lit(0), F.lit(0), 0, 40), N.should_compact(F.lit(10), F.lit(10), 10, 0))
    assert list(flags) == [True, False, False, True]


def test_percentiles_of_buckets(spark):
    hist = spark.createDataFrame([(0, 1), (4, 2), (7, 1)], "bucket int, n long")
    assert tuple(accounting.percentiles(hist).first()) == (1000, 10000, 10000)
    assert tuple(accounting.percentiles(hist.limit(0).union(spark.createDataFrame([(0, 0)], "bucket int, n long"))).first()) == (0, 0, 0)
    us = spark.createDataFrame([(0,), (50,), (51,), (100000,), (100001,)], "us long")
    assert [r.n for r in accounting.histogram(us, "us").orderBy("bucket").collect()] == [2, 1, 0, 0, 0, 0, 0, 0, 0, 0, 1, 1]


def test_scores(spark):
    v = lambda x: F.lit(x).cast("long")
    got = one(spark, N.ratio_milli(v(16), v(4)), N.signal_score(v(200), v(100), v(3)), N.deficit_score(v(4), v(8), v(2)), N.ratio_milli(v(5), v(0)), N.times(v(2**62), v(4)), N.align_up(v(4097), 4096), N.align_up(v(0), 8))
    assert list(got) == [4000, 6000, 1000, 0, 2**63 - 1, 8192, 0]
    with pytest.raises(ValueError):
        N.align_up(v(1), 0)


def policy_loop(o, s):
    """The rules again, one row in plain Python."""
    delay, size, cap = o.max_batch_delay_us, o.max_batch_size, o.max_batch_wal_bytes
    d, p = s["request_queue_depth"], s["recent_peak_queue_depth"]
    if o.adaptive_batching_enabled and max(d, p) >= o.adaptive_queue_depth_threshold:
        size, cap = size * o.adaptive_batch_size_multiplier, cap * o.adaptive_batch_wal_bytes_multiplier
    least = o.adaptive_flush_min_batch_delay_us
    if o.adaptive_objective_enabled:
        return None
    if o.adaptive_flush_enabled and delay > 0 and max(d, p) >= o.adaptive_flush_queue_depth_threshold:
        steps = d // o.adaptive_flush_queue_depth_threshold or max(1, p // o.adaptive_flush_queue_depth_threshold)
        for _ in range(steps):
            delay = max(least, delay // o.adaptive_flush_delay_divisor)
    heavy = 0 < o.adaptive_read_heavy_read_per_1000_ops_threshold <= s["recent_read_ratio"]
    if heavy:
        delay, size = max(least, delay // o.adaptive_read_heavy_delay_divisor), max(1, size // o.adaptive_read_heavy_batch_size_divisor)
        cap = max(20, cap // o.adaptive_read_heavy_batch_size_divisor) if cap else 0
    late = 0 < o.adaptive_latency_target_p95_us < s["observed_p95_us"] and delay > least
    if late:
        delay = max(least, delay // max(2, o.adaptive_flush_delay_divisor))
    if not heavy and not late and 0 < o.adaptive_fsync_pressure_per_1000_writes_threshold <= s["observed_fsync_pressure"]:
        delay = min(delay * o.adaptive_fsync_pressure_delay_multiplier, o.adaptive_fsync_pressure_max_batch_delay_us or 2**32 - 1) or delay
    if not heavy and 0 < o.adaptive_compaction_pressure_obsolete_ratio_percent_threshold <= s["current_obsolete_ratio"]:
        delay = delay * o.adaptive_compaction_pressure_delay_multiplier or delay
    if not heavy and 0 < o.adaptive_wal_growth_bytes_per_batch_threshold <= s["recent_avg_batch_wal_bytes"]:
        delay = min(delay * o.adaptive_wal_growth_delay_multiplier, o.adaptive_wal_growth_max_batch_delay_us or 2**32 - 1) or delay
    return size, cap, delay


def test_policy_against_a_loop(spark):
    import random
    from dataclasses import replace

    random.seed(5)
    rows = [tuple(random.choice([0, 1, 7, 8, 64, 200, 350, 701, 13000]) for _ in policy.SIGNALS) for _ in range(300)]
    df = spark.createDataFrame(rows, ", ".join(f"{s} long" for s in policy.SIGNALS))
    for o in (Options(), replace(BENCHMARK, adaptive_objective_enabled=False), replace(RECOMMENDED["low-latency"], adaptive_objective_enabled=False, adaptive_flush_delay_divisor=1, max_batch_wal_bytes=0)):
        got = policy.with_policy(df, o.sane()).collect()
        for r in got:
            assert (r.max_batch_size, r.max_batch_wal_bytes, r.batch_delay_us) == policy_loop(o, r.asDict()), r
    assert profile("low-latency").max_batch_size == 8 and profile("nope") is None and Options(max_batch_size=0, auto_compact_invalid_wal_ratio_percent=130).sane().max_batch_size == 1


def test_batches_by_bytes(spark):
    rows = [("s", 0, 24, False), ("s", 1, 26, False), ("s", 2, 0, True), ("t", 0, 500, False), ("t", 1, 1, False)]
    df = spark.createDataFrame(rows, "store string, seq long, bytes long, barrier boolean")
    got = {(r.store, r.seq): r.batch for r in batching.by_bytes(df, 4, 24).collect()}
    assert got == {("s", 0): 0, ("s", 1): 1, ("s", 2): 2, ("t", 0): 0, ("t", 1): 1}


def test_chunked_order_is_global(spark):
    df = spark.range(0, 1000, 1, 7).select((F.col("id") * 3).alias("at"), (F.col("id") % 5).alias("v"))
    got = [r.s for r in running_sum(df, "at", {"s": "v"}, chunk=64).orderBy("at").collect()]
    assert got == [sum(i % 5 for i in range(k + 1)) for k in range(1000)]
    n = numbered(df, "at", "n", chunk=64)
    assert [r.n for r in n.orderBy("at").collect()] == list(range(1000))
    w = sliding(n, "n", 10, {"s": lambda f: F.sum("v").over(f)}, chunk=16).orderBy("n").collect()
    assert [r.s for r in w] == [sum(i % 5 for i in range(max(0, k - 9), k + 1)) for k in range(1000)]


def test_trends_and_gates(spark):
    rows = [("a", 1000.0, 2000.0, 100.0), ("b", 1100.0, 1900.0, 90.0), ("c", 1200.0, 2200.0, 80.0)]
    t = trends.baseline_trend(spark.createDataFrame(rows, "file_name string, write_ops_per_s double, read_ops_per_s double, avg_write_latency_us double"), 2).first()
    assert (t.avg_write, t.recent_avg_write, t.latest_vs_oldest_write_pct, t.recent_write_trend, t.recent_latency_trend) == (1100.0, 1150.0, 120.0, "stable", "improving")
    kind = ", ".join(f"{m}: double" for m in trends.GATES)
    base, good, bad = (1000.0, 2000, 100, 1000, 1200, 200, 500), (900.0, 1800, 115, 1300, 1800, 250, 450), (700.0, 1500, 140, 1700, 2300, 400, 300)
    frame = spark.createDataFrame([(tuple(map(float, base)), tuple(map(float, x))) for x in (good, bad)], f"base struct<{kind}>, cand struct<{kind}>")
    assert [r.status for r in trends.compare_baseline(frame).orderBy("status").collect()] == [0, 2]
    cases = lambda *x: spark.createDataFrame([(i, n, float(v)) for i, (n, v) in enumerate(x)], "position int, name string, ops_per_s double")
    c = trends.compare_cases(cases(("recovery", 100), ("rewrite", 20)), cases(("rewrite", 1), ("rewrite", 15), ("recovery", 79), ("more", 1))).collect()
    assert [(r.name, r.passed) for r in c] == [("recovery", False), ("rewrite", True)]
    with pytest.raises(Exception, match="lacks a case"):
        trends.compare_cases(cases(("a", 1)), cases(("b", 1))).collect()


def test_containers(spark):
    s = spark.createDataFrame([(1, 4096, 1024), (1, 4608, 2048), (2, 0, 8), (2, 8, 8)], "c int, offset long, length long")
    assert {r.c: r.overlaps for r in formats.overlapping(s, "c").collect()} == {1: True, 2: False}
    p = formats.planned(spark.createDataFrame([(1, 1024, 2048, 4096, 8192)], "c int, metadata long, index long, objects long, journal long"), "c", 4096).collect()
    assert [r.offset for r in p] == [4096, 8192, 12288, 16384] and p[0].file_bytes == 24576
    with pytest.raises(Exception, match="without ="):
        one(spark, formats.kv_line(F.lit("a=1 b")))
    assert one(spark, formats.kv_line(F.lit(" a=1  b==2 a=3 ")))[0] == {"a": "3", "b": "=2"}


def fnv(data):
    """The published offset and prime."""
    h = 2166136261
    for b in data:
        h = (h ^ b) * 16777619 & 0xFFFFFFFF
    return h


def test_checksums_against_a_loop(spark):
    import random

    from tidewell.functions.checksums import fnv1a, fnv_of_strings

    rng = random.Random(1)
    parts = [b"", b"a", *(rng.randbytes(rng.choice([0, 1, 7, 40, 300])) for _ in range(300)), rng.randbytes(20_000), rng.randbytes(9_000)]
    assert fnv_of_strings(parts).tolist() == [fnv(p) for p in parts] and fnv_of_strings([]).tolist() == [] and fnv(b"foobar") == 0xBF9CF968
    rows = spark.createDataFrame([(i, p) for i, p in enumerate(parts)] + [(-1, None)], "i int, b binary").repartition(3)
    assert {r.i: r.c for r in rows.select("i", fnv1a(F.col("b")).alias("c")).collect()} == {i: fnv(p) for i, p in enumerate(parts)} | {-1: None}


def test_batches_against_a_loop(spark):
    import random

    rng = random.Random(3)
    rows = [(rng.randrange(4), i, rng.choice([0, 5, 30, 60, 500]), rng.random() < 0.05) for i in range(3000)]
    df = spark.createDataFrame(rows, "store long, seq long, bytes long, barrier boolean")
    for most, most_bytes in ((8, 100), (3, 0), (1, 40), (100, 1000)):
        want = {}
        for store in range(4):
            batch = count = used = 0
            first = True
            for s, seq, size, barrier in rows:
                if s != store:
                    continue
                if not first and (barrier or count >= most or most_bytes and count and used + size > most_bytes):
                    batch, count, used = batch + 1, 0, 0
                want[seq], first = batch, False
                count, used = (most if barrier else count + 1), used + size
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")
        got = {r.seq: r.batch for r in batching.by_bytes(df, most, most_bytes).collect()}
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        assert got == want


def test_running_bytes_of_a_hot_key_in_chunks(spark):
    rows = [(i, 0, 1 + (i % 5 == 4), I(0 if i % 3 else i % 7), b"x" * (i % 11)) for i in range(600)]
    df = spark.createDataFrame(rows, LOG)
    latest, total, want = {}, 0, {}
    for i, _, op, key, value in rows:
        size = 20 + 5 + (len(value) if op == 1 else 0)
        latest[key], total = size, total + size
        want[i // 4] = (total, sum(latest.values()))
    assert {r.batch: (r.total_bytes, r.live_bytes) for r in accounting.running_account(df, F.expr("seq div 4")).collect()} == want
    small = accounting.last_before(df.select("key_enc", F.col("seq").alias("at"), F.col("op").alias("v")), ["key_enc"], "at", "v", "b", chunk=8)
    before, seen = {}, {}
    for i, _, op, key, _ in rows:
        before[i], seen[key] = seen.get(key, 0), op
    assert {r["at"]: r.b for r in small.collect()} == before


def test_replay_of_compactions_against_a_loop(spark):
    import random

    from tidewell.operators import store

    rng = random.Random(4)
    rows = [(rng.randrange(3), i, rng.randrange(12), rng.choice([25, 40, 90])) for i in range(900)]
    rows = [(s, i // 30, i, bytes([k]), n) for s, i, k, n in rows]
    options = Options(auto_compact_wal_bytes_threshold=900, auto_compact_invalid_wal_ratio_percent=55)
    got = {(r.store, r.batch): (r.total_bytes, r.live_bytes, r.compacted) for r in store.replay(spark.createDataFrame(rows, "store long, batch long, seq long, key_enc binary, bytes long"), options).collect()}
    want, total, latest = {}, {}, {}
    for b in range(30):
        for s in {r[0] for r in rows if r[1] == b}:
            for _, _, _, k, n in (r for r in rows if r[:2] == (s, b)):
                total[s] = total.get(s, 0) + n
                latest.setdefault(s, {})[k] = n
            live = sum(latest[s].values())
            full = total[s] >= 900 or 100 * (total[s] - live) >= 55 * total[s]
            want[s, b] = (total[s], live, full)
            if full:
                total[s], latest[s] = 0, {}
    assert got == want and any(x[2] for x in want.values())
    none = store.replay(spark.createDataFrame(rows, "store long, batch long, seq long, key_enc binary, bytes long"), Options())
    assert none.where("compacted").count() == 0


def test_files_by_uri_and_rewriting(spark, tmp_path):
    folder = f"file://{tmp_path}/stores"
    assert files.create_if_missing(f"{folder}/snapshots/new") and not files.create_if_missing(f"{folder}/snapshots/new") and files.file_size(f"{folder}/snapshots/new") == 16
    assert files.file_size(f"{folder}/none") == 0 and files.listed(f"{folder}/snapshots") == [f"{folder}/snapshots/new"]
    one = log(spark, ("put", I(3), "z"), ("delete", I(1)), ("put", I(3), "y")).selectExpr("'old' AS store", "1 AS version", "X'AABB' AS tail", "*")
    assert {r.store: r.bytes for r in files.write_stores(one, f"{folder}/logs", "log").collect()} == {"old": 20 * 3 + 2 + 2}
    base = spark.createDataFrame([("old", 1, I(1), b"a"), ("old", 1, I(2), b"b")], "store string, version int, key_enc binary, value binary")
    files.write_stores(base, f"{folder}/snapshots", "snapshot")
    seen = {r.store: r for r in files.load(spark, folder, "inspect").collect()}
    assert (seen["old"].version, seen["old"].entries, seen["old"].records, seen["old"].log_truncated, seen["old"].first_type) == (1, 2, 3, 1, 1)
    assert (seen["new"].entries, seen["new"].log_exists, seen["new"].rewrite_recommended, seen["new"].size) == (0, 0, 0, 16)
    files.rewritten(spark, folder, f"{folder}2")
    after = {r.store: r for r in files.load(spark, f"{folder}2", "inspect").collect()}
    assert {n: (r.version, r.entries, r.log_exists, r.log_size, r.rewrite_recommended) for n, r in after.items()} == {"old": (2, 2, 1, 0, 0), "new": (2, 0, 1, 0, 0)}
    assert content(state.current_state(files.load(spark, f"{folder}2/snapshots", "snapshot"))) == {I(2): "b", I(3): "y"}


def test_binary_files(spark, tmp_path):
    rows = [(1, I(3), b"v1"), (2, I(3), None), (1, S("k"), b""), (1, b"\x03\x00\xff", b"x")]
    data = files.log_bytes(rows)
    assert list(files.read_log(io.BytesIO(data))) == rows
    assert list(files.read_log(io.BytesIO(data + b"\xaa\xbb\xcc"))) == rows
    for broken in (data[:20] + b"\x09" + data[21:], b"x" + data[1:], data[:4] + b"\x63" + data[5:]):
        with pytest.raises(files.FormatError):
            list(files.read_log(io.BytesIO(broken)))
    snapshot = files.snapshot_bytes([(I(1), b"a"), (S("b"), b"")])
    assert list(files.read_snapshot(io.BytesIO(snapshot))) == [(I(1), b"a"), (S("b"), b"")]
    for broken in (b"X" + snapshot[1:], snapshot[:8] + b"\x63" + snapshot[9:], snapshot[:-1], snapshot[:20]):
        with pytest.raises(files.FormatError):
            list(files.read_snapshot(io.BytesIO(broken)))
    # The first format: an int key in place of the key's size.
    old = files.HEADER.pack(files.SNAPSHOT_MAGIC, 1, 0) + files.ENTRY.pack(files.ENTRY_MAGIC, 2, 1) + b"z"
    assert list(files.read_snapshot(io.BytesIO(old))) == [(I(2), b"z")]
    checksum = fnv(bytes([1]) + (3).to_bytes(4, "little") + (1).to_bytes(4, "little") + b"q")
    record = files.RECORD.pack(files.RECORD_MAGIC, 1, 1, 0, 3, 1, checksum) + b"q"
    assert list(files.read_log(io.BytesIO(record))) == [(1, I(3), b"q")]
    seen = files.inspect(io.BytesIO(snapshot), io.BytesIO(data + b"\xaa"))
    assert (seen["entries"], seen["int_keys"], seen["string_keys"], seen["records"], seen["puts"], seen["deletes"], seen["log_truncated"], seen["rewrite_recommended"]) == (2, 1, 1, 4, 3, 1, 1, 1)
    assert files.inspect(io.BytesIO(old), None)["rewrite_recommended"] == 1
    (tmp_path / "one").write_bytes(data)
    got = files.load(spark, str(tmp_path), "log").orderBy("seq").collect()
    assert [(r.op, bytes(r.key_enc), None if r.value is None else bytes(r.value)) for r in got] == rows
    c = log(spark, ("put", S("a"), "xyz"), ("delete", I(9))).select(N.record_checksum(F.col("op"), F.col("key_enc"), F.col("value")).alias("c"), "op", "key_enc", "value").orderBy("op").collect()
    for r in c:
        assert files.log_bytes([(r.op, bytes(r.key_enc), r.value and bytes(r.value))])[16:20] == r.c.to_bytes(4, "little")


def test_stream_restarts_and_repeats(spark, tmp_path):
    from tidewell.streaming.changelog import CHANGE, StreamedState

    s = StreamedState(spark, f"file://{tmp_path}/out")
    assert s.state().count() == 0
    first, second = log(spark, ("put", I(1), "a"), ("put", I(2), "b")), log(spark, ("delete", I(1))).withColumn("seq", F.lit(9).cast("long"))
    first.write.parquet(f"{tmp_path}/in/x.parquet")
    stream = lambda: spark.readStream.schema(CHANGE).parquet(f"{tmp_path}/in/*")
    s.start(stream(), f"{tmp_path}/cp").awaitTermination()
    assert content(s.state()) == {I(1): "a", I(2): "b"}
    second.write.parquet(f"{tmp_path}/in/y.parquet")
    s.start(stream(), f"{tmp_path}/cp").awaitTermination()
    assert content(s.state()) == {I(2): "b"}
    s.apply(second, 1)  # the last batch once more
    assert content(s.state()) == {I(2): "b"} and s.versions() == []
    s.compact()
    s.compact()  # nothing is left to fold
    assert s.versions() == [1] and content(s.state()) == {I(2): "b"} and s.log().count() == 0
    assert [tuple(r) for r in s.compactions().collect()] == [(1, "manual", 16 + 12 + 5 + 1, 26 + 26 + 25)]
    s.apply(first, 0)  # a batch that a base holds already
    assert content(s.state()) == {I(2): "b"} and s.account().first().total_bytes == 0


def test_stream_compacts_by_its_options_and_survives_faults(spark, tmp_path):
    from tidewell.streaming.changelog import FAILPOINTS, StoreFatal, StreamedState

    batch = lambda n: log(spark, ("put", I(n % 3), f"v{n}"), ("delete", I((n + 1) % 3)), ("put", S("k"), str(n))).withColumn("seq", F.col("seq") + 10 * n)
    options, folder = Options(auto_compact_wal_bytes_threshold=150), f"file://{tmp_path}/s"
    want = lambda n: {k: v for k, v in [(I(n % 3), f"v{n}"), (S("k"), str(n))] + [(I(i), f"v{m}") for i in range(3) for m in [max((x for x in range(n) if x % 3 == i), default=-1)] if i not in (n % 3, (n + 1) % 3) and m >= 0 and not any((x + 1) % 3 == i for x in range(m + 1, n + 1))]}
    for n in range(6):
        name = FAILPOINTS[n % 3] if n in (1, 3, 5) else None

        def fail(at, name=name):
            if at == name:
                raise OSError(at)

        store = StreamedState(spark, folder, options, fail)
        try:
            store.apply(batch(n), n)
        except OSError:
            with pytest.raises(StoreFatal, match=name):
                store.apply(batch(n), n)
            with pytest.raises(StoreFatal):
                store.compact()
            store = StreamedState(spark, folder, options)  # reopened, the batch comes again
            store.apply(batch(n), n)
        assert content(store.state()) == want(n)
    assert store.versions() and store.compactions().where("kind = 'auto' and reclaimed_bytes >= 150").count() == store.compactions().count() > 0


def test_stream_folds_a_log_of_many_batches(spark, tmp_path, monkeypatch):
    from tidewell.streaming.changelog import StreamedState

    monkeypatch.setattr(StreamedState, "MOST", 2)
    s = StreamedState(spark, f"file://{tmp_path}/s")
    for n in range(5):
        s.apply(log(spark, ("put", I(n), str(n))), n)
    assert s.versions() and content(s.state()) == {I(n): str(n) for n in range(5)}


def test_stress_and_microbench(spark, tmp_path):
    import json

    from tidewell.plans import workload
    from tidewell.sources import results

    row = workload.stress(spark, f"file://{tmp_path}/stress", "recovery-heavy", requests=300, batches=4)
    got = json.loads(results.stress_json(row).first()[0])
    assert list(got) == results.STRESS_JSON and (got["profile"], got["committed_write_requests"], got["batch_put_operations"] + got["batch_delete_operations"]) == ("recovery-heavy", 300, 900)
    assert got["auto_compactions_completed"] > 0 and row.select(results.stress_line()).first()[0].startswith("[STRESS] profile=recovery-heavy duration_seconds=")
    assert [r.status for r in results.qualified(row, 0).union(results.qualified(row)).collect()] == ["pass", "fail"]
    cases = workload.microbench(spark, f"file://{tmp_path}/micro", requests=50)
    got = json.loads(results.microbench_json(cases).first()[0])["cases"]
    assert [c["name"] for c in got] == ["wal_append", "scan", "recovery", "compaction", "rewrite"] and got[1]["bytes"] == 1331 and list(got[0]) == ["name", "duration_s", "ops_per_s", "operations", "bytes"]


def test_results(spark, tmp_path):
    from tidewell.sources.results import benchmark_results, microbench_cases, result_files, to_json

    (tmp_path / "b.json").write_text('{"x": {"write_ops_per_s": 12.5}, "write_ops_per_s": 3}')
    (tmp_path / "microbench-1.json").write_text('{"cases": [{"name": "scan", "duration_s": 1, "ops_per_s": 900, "operations": 5, "bytes": 6}]}')
    (tmp_path / "c.txt").write_text("no")
    assert [tuple(r) for r in benchmark_results(result_files(spark, str(tmp_path)), ["write_ops_per_s"]).collect()] == [("b.json", 12.5)]
    assert microbench_cases(result_files(spark, str(tmp_path), True)).first().ops_per_s == 900.0
    assert to_json(spark.range(1).select(F.lit(1).alias("b"), F.lit(None).cast("int").alias("a"))).first()[0] == '{"b":1,"a":null}'


def test_commands(spark, tmp_path):
    import json

    from tidewell.__main__ import run
    from tidewell.sources import results

    assert run(spark, "nothing", [])[0] == 1 and run(spark, "profile-json", ["nope"])[0] == 1
    assert json.loads(run(spark, "profile-json", ["low-latency"])[1][0])["max_batch_size"] == 8
    assert run(spark, "soak-profiles", [])[1][0] == "profile=balanced writer_count=4 reader_count=2 key_space=256 compaction_interval_ms=50 max_batch_size=32 max_batch_delay_us=2000"
    base, good, bad = (1000.0, 2000, 100, 1000, 1200, 200, 500), (900.0, 1800, 115, 1300, 1800, 250, 450), (700.0, 1500, 140, 1700, 2300, 400, 300)
    for name, values in (("a", base), ("b", good), ("c", bad)):
        (tmp_path / f"{name}.json").write_text(json.dumps({"metrics": dict(zip(trends.GATES, values, strict=True))}))
    path = lambda n: f"{tmp_path}/{n}.json"
    status, out = run(spark, "compare-baseline", [path("a"), path("b")])
    assert status == 0 and out[0].endswith("min_batch_fill_ratio_pct=75.0 status=pass") and " write_ratio_pct=90.0 " in out[0]
    assert run(spark, "compare-baseline", [path("a"), path("c")])[0] == 2
    assert "count=3 oldest_file=a.json latest_file=c.json recent_window_count=2 avg_write_ops_per_s=" in run(spark, "trend-baselines", [str(tmp_path), "2"])[1][0]
    trend = json.loads(run(spark, "trend-baselines-json", [str(tmp_path), "2"])[1][0])
    assert trend["write_trend"] == "regressing" and trend["latency_trend"] == "regressing" and list(trend)[:4] == ["count", "oldest_file", "latest_file", "recent_window_count"]
    for name, ops in (("1", 100), ("2", 79)):
        (tmp_path / f"microbench-{name}.json").write_text(json.dumps({"cases": [{"name": "scan", "duration_s": 1.0, "ops_per_s": ops, "operations": 5, "bytes": 6}]}))
    status, out = run(spark, "compare-microbench", [path("microbench-1"), path("microbench-2")])
    assert status == 2 and out[0].endswith("scan_ops_ratio_pct=79.0 scan_min_ratio_pct=80.0 status=fail")
    assert json.loads(run(spark, "trend-microbench-json", [str(tmp_path)])[1][0])["cases"][0]["trend"] == "regressing"
    folder = f"file://{tmp_path}/stores"
    files.write_stores(log(spark, ("put", I(1), "a")).selectExpr("'s' AS store", "X'AA' AS tail", "*"), f"{folder}/logs", "log")
    files.create_if_missing(f"{folder}/snapshots/s")
    status, out = run(spark, "verify", [folder])
    assert status == 2 and out[0].endswith("wal_truncated=1 rewrite_recommended=1 verify_reason=wal_truncated")
    assert run(spark, "rewrite", [folder, f"{folder}2"]) == (0, ["store=s snapshot_bytes=34"]) and run(spark, "verify", [f"{folder}2"])[0] == 0
    options = spark.createDataFrame([(1,)], "max_batch_size long")
    metrics = spark.createDataFrame([tuple(range(54)) + ([0] * 12,)], ", ".join(f"{m} long" for m in results.METRICS[:-1]) + ", write_latency_histogram array<long>")
    nested = json.loads(results.benchmark_json("x", {"writers": 8}, {"writes": 1.5}, options, metrics).first()[0])
    assert list(nested) == ["label", "workload", "summary", "options", "metrics"] and len(nested["metrics"]) == 55


def test_objective_against_a_loop(spark):
    import random

    random.seed(6)
    rows = [tuple(random.choice([0, 1, 7, 8, 64, 200, 350, 701, 13000]) for _ in policy.SIGNALS) for _ in range(400)]
    df = spark.createDataFrame(rows, ", ".join(f"{s} long" for s in policy.SIGNALS))
    score = lambda v, scale, w: 0 if not v or not scale else min(4000, v * 1000 // scale) * w
    for o in (RECOMMENDED["balanced"], RECOMMENDED["low-latency"], Options(adaptive_objective_enabled=True, adaptive_objective_long_delay_multiplier=1, adaptive_objective_target_batch_size=9)):
        modes = set()
        for r in policy.with_policy(df, o.sane()).collect():
            scale = o.adaptive_queue_depth_threshold if o.adaptive_batching_enabled else o.max_batch_size
            pressure = score(max(r.request_queue_depth, r.recent_peak_queue_depth), scale, o.adaptive_objective_queue_weight) + score(r.observed_p95_us, o.adaptive_latency_target_p95_us, o.adaptive_objective_latency_weight)
            pressure += score(r.recent_read_ratio, o.adaptive_read_heavy_read_per_1000_ops_threshold, o.adaptive_objective_read_weight)
            target = o.adaptive_objective_target_batch_size
            lack = 0 if not target or r.recent_avg_batch_size >= target else (target - r.recent_avg_batch_size) * 1000 // target * o.adaptive_objective_throughput_weight
            cost = lack + score(r.observed_fsync_pressure, o.adaptive_fsync_pressure_per_1000_writes_threshold, o.adaptive_objective_fsync_weight)
            cost += score(r.current_obsolete_ratio, o.adaptive_compaction_pressure_obsolete_ratio_percent_threshold, o.adaptive_objective_compaction_weight)
            cost += score(r.recent_avg_batch_wal_bytes, o.adaptive_wal_growth_bytes_per_batch_threshold, o.adaptive_objective_wal_growth_weight)
            delay, mode = o.max_batch_delay_us, 0
            if pressure >= cost + o.adaptive_objective_short_delay_score_threshold and delay > o.adaptive_flush_min_batch_delay_us:
                mode, delay = 1, max(o.adaptive_flush_min_batch_delay_us, delay // o.adaptive_objective_short_delay_divisor)
            elif cost >= pressure + o.adaptive_objective_long_delay_score_threshold and o.adaptive_objective_long_delay_multiplier > 1:
                mode, delay = -1, min(delay * o.adaptive_objective_long_delay_multiplier, o.adaptive_objective_max_batch_delay_us or 2**32 - 1)
            assert (r.objective_pressure_score, r.objective_cost_score, r.objective_throughput_score, r.objective_mode, r.batch_delay_us) == (pressure, cost, lack, mode, delay)
            modes.add(mode)
        assert modes == {1, -1, 0} or o.adaptive_objective_long_delay_multiplier == 1


def test_bad_int_key_text_raises(spark):
    from tidewell.operators.state import int_text_key

    assert bytes(one(spark, int_text_key(F.lit("-7")))[0]) == I(-7)
    for text in ("", "x1", "2147483648"):
        with pytest.raises(Exception, match="CAST_INVALID_INPUT|NUMERIC_VALUE_OUT_OF_RANGE|CAST_OVERFLOW"):
            one(spark, int_text_key(F.lit(text)))


def test_factories_by_key_type(spark):
    from tidewell.operators import state as st

    made = [st.put_int(F.lit(0), F.lit(5), F.lit(b"a")), st.put_string(F.lit(1), F.lit("5"), F.lit(b"b")), st.put_binary(F.lit(2), F.lit(b"5"), F.lit(b"c")), st.delete_int(F.lit(3), F.lit(5)), st.delete_string(F.lit(4), F.lit("x")), st.delete_binary(F.lit(5), F.lit(b"x"))]
    df = None
    for columns in made:
        row = spark.range(1).select(*columns)
        df = row if df is None else df.union(row)
    assert content(state.current_state(df)) == {S("5"): "b", b"\x035": "c"}
