"""The engine's inputs made from the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.functions.keys import int_key, string_key
from tidewell.operators.accounting import sized_log
from tidewell.operators.state import DELETE, PUT, mutation

BATCH = 64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op_of() -> F.Column:
    return F.when(F.col("event_type") == "error", DELETE).otherwise(PUT)


def changelog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An int-keyed log: events put their props under their user, errors delete."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "props")
    return e.select(*mutation(F.col("event_id"), op_of(), int_key(F.col("user_id")), F.encode("props", "UTF-8")))


def base_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(int_key(F.col("c_custkey")).alias("key_enc"), F.encode("c_name", "UTF-8").alias("value"))


def string_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(string_key(F.col("c_name")).alias("key_enc"), F.encode("c_mktsegment", "UTF-8").alias("value"))


def batch_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four events are one request on twenty keys, so keys come several times in a batch."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "props")
    op = F.struct(F.col("event_id"), op_of().alias("op"), int_key(F.col("user_id") % 20).alias("key_enc"), F.encode("props", "UTF-8").alias("value"))
    ops = F.transform(F.array_sort(F.collect_list(op)), lambda x: F.struct(x["op"].alias("op"), x["key_enc"].alias("key_enc"), x["value"].alias("value")))
    return e.groupBy(F.expr("event_id div 4").alias("request_id")).agg(ops.alias("ops"))


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), F.floor(F.col("value") * 1000).cast("long").alias("elapsed_us"))


def batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Commit batches of 64 events: views are reads, and purchases wait in the queue."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "props")
    log = sized_log(e.select("event_type", *mutation(F.col("event_id"), op_of(), int_key(F.col("user_id")), F.encode("props", "UTF-8"))))
    kind = F.col("event_type")
    return log.groupBy(F.expr(f"seq div {BATCH}").alias("batch")).agg(
        F.count("*").alias("batch_size"), F.sum("bytes").alias("wal_bytes"), F.count_if(kind == "purchase").alias("queue_depth"), F.count_if(kind == "view").alias("reads")
    )
