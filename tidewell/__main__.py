"""python -m tidewell COMMAND ...: inspection, gates, trends, profiles and small runs from a shell.

inspect FOLDER | verify FOLDER | rewrite FOLDER TO: the stores in FOLDER/snapshots and FOLDER/logs.
compare-baseline BASE CANDIDATE | compare-microbench BASE CANDIDATE: result files, with the default gates.
trend-baselines[-json] FOLDER [N] | trend-microbench-json FOLDER [N]: result folders.
profile-json NAME | soak-profiles | stress-profiles: presets.
microbench[-json] FOLDER | stress[-json] FOLDER PROFILE [REQUESTS]: runs below FOLDER.

Exit status: 0 passed, 1 wrong usage, 2 a gate or a verification failed.
"""

from __future__ import annotations

import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.functions.options import options_frame, profile, profile_summaries
from tidewell.operators import formats, trends
from tidewell.plans import workload
from tidewell.sources import files, results


def lines(df: DataFrame) -> list[str]:
    return [r[0] for r in df.collect()]


def inspected(spark: SparkSession, folder: str) -> DataFrame:
    yes = lambda c: F.col(c) == 1
    reason = formats.verify_reason(yes("magic_ok"), yes("entry_magic_ok"), yes("truncated"), yes("log_truncated"), yes("rewrite_recommended"))
    return files.load(spark, folder, "inspect").withColumn("reason", reason).withColumn("status", formats.verify_status(F.col("reason"))).orderBy("store")


def result(spark: SparkSession, path: str, microbench: bool = False) -> DataFrame:
    return spark.read.text(path, wholetext=True).select(F.lit(path).alias("file_name"), F.col("value").alias("json"))


def run(spark: SparkSession, command: str, args: list[str]) -> tuple[int, list[str]]:
    """Status and lines of a command."""
    json, command = command.endswith("-json"), command.removesuffix("-json")
    if command in ("inspect", "verify"):
        rows = inspected(spark, args[0])
        line = F.concat(F.lit("store="), "store", F.lit(" "), results.inspect_line())
        out = rows.select(line if command == "inspect" else F.concat(line, F.lit(" verify_reason="), "reason"), "status").collect()
        return (max((r.status for r in out), default=0) if command == "verify" else 0), [r[0] for r in out]
    if command == "rewrite":
        sizes = files.rewritten(spark, *args).orderBy("store")
        return 0, lines(sizes.select(results.to_line({"store": F.col("store"), "snapshot_bytes": F.col("bytes")})))
    if command == "compare-baseline":
        base, cand = (results.benchmark_results(result(spark, x), list(trends.GATES)).select(F.struct(*trends.GATES).alias(n), F.lit(1).alias("one")) for x, n in zip(args, ("base", "cand"), strict=True))
        out = trends.compare_baseline(base.join(cand, "one").drop("one")).select(results.compare_line(F.lit(args[0]), F.lit(args[1]), trends.GATES), "status").first()
        return out.status, [out[0]]
    if command == "compare-microbench":
        out = trends.compare_cases(*(results.microbench_cases(result(spark, x)).select("position", "name", "ops_per_s") for x in args)).collect()
        passed = all(r.passed for r in out)
        parts = [f"{r.name}_ops_ratio_pct={r.ops_ratio_pct} {r.name}_min_ratio_pct={r.min_ratio_pct}" for r in out]
        return (0 if passed else 2), [" ".join([f"baseline={args[0]} candidate={args[1]}", *parts, f"status={'pass' if passed else 'fail'}"])]
    if command == "trend-baselines":
        found = results.benchmark_results(results.result_files(spark, args[0]), list(trends.MEASURES.values()))
        trend = trends.baseline_trend(found, *map(int, args[1:]))
        return 0, lines(results.trend_json(trend) if json else trend.select(results.trend_line()))
    if command == "trend-microbench" and json:
        cases = results.microbench_cases(results.result_files(spark, args[0], microbench=True))
        return 0, lines(results.case_trend_json(trends.case_trend(cases, *map(int, args[1:]))))
    if command == "profile" and json:
        options = profile(args[0])
        if options is None:
            return 1, [f"unknown profile: {args[0]}"]
        return 0, lines(results.to_json(options_frame(spark, {args[0]: options}).drop("profile")))
    if command in ("soak-profiles", "stress-profiles"):
        rows = profile_summaries(spark, command.split("-")[0])
        return 0, lines(rows.select(results.to_line({c: F.col(c) for c in rows.columns})))
    if command == "microbench":
        cases = workload.microbench(spark, args[0])
        return 0, lines(results.microbench_json(cases) if json else cases.orderBy("position").select(results.microbench_line()))
    if command == "stress":
        summary = workload.stress(spark, args[0], args[1], *map(int, args[2:]))
        return 0, lines(results.stress_json(summary) if json else summary.select(results.stress_line()))
    return 1, [__doc__.strip()]


def main() -> int:
    if len(sys.argv) < 2:
        print(__doc__.strip(), file=sys.stderr)
        return 1
    spark = SparkSession.builder.appName("tidewell").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    status, out = run(spark, sys.argv[1], sys.argv[2:])
    print("\n".join(out), file=sys.stderr if status == 1 else sys.stdout)
    return status


if __name__ == "__main__":
    sys.exit(main())
