"""Last-writer-wins state of an ordered change log, lookups, batches and checks.

A change log has seq, sub_seq, op (1 put, 2 delete), key_enc, value. All merging is one aggregation by key with
map-side combining: a hot key shrinks to one row per task before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.functions.keys import binary_key, int_key, key_kind, string_key

PUT, DELETE = 1, 2


def put(seq: Column, key: Column, value: Column, sub_seq: Column | None = None) -> list[Column]:
    return mutation(seq, F.lit(PUT), key, value, sub_seq)


def delete(seq: Column, key: Column, sub_seq: Column | None = None) -> list[Column]:
    return mutation(seq, F.lit(DELETE), key, F.lit(None).cast("binary"), sub_seq)


def mutation(seq: Column, op: Column, key: Column, value: Column, sub_seq: Column | None = None) -> list[Column]:
    sub_seq = F.lit(0) if sub_seq is None else sub_seq
    return [seq.cast("long").alias("seq"), sub_seq.cast("int").alias("sub_seq"), op.cast("int").alias("op"), key.alias("key_enc"), value.alias("value")]


def put_int(seq: Column, key: Column, value: Column, sub_seq: Column | None = None) -> list[Column]:
    return put(seq, int_key(key), value, sub_seq)


def put_string(seq: Column, key: Column, value: Column, sub_seq: Column | None = None) -> list[Column]:
    return put(seq, string_key(key), value, sub_seq)


def put_binary(seq: Column, key: Column, value: Column, sub_seq: Column | None = None) -> list[Column]:
    return put(seq, binary_key(key), value, sub_seq)


def delete_int(seq: Column, key: Column, sub_seq: Column | None = None) -> list[Column]:
    return delete(seq, int_key(key), sub_seq)


def delete_string(seq: Column, key: Column, sub_seq: Column | None = None) -> list[Column]:
    return delete(seq, string_key(key), sub_seq)


def delete_binary(seq: Column, key: Column, sub_seq: Column | None = None) -> list[Column]:
    return delete(seq, binary_key(key), sub_seq)


def int_text_key(text: Column) -> Column:
    """An int key from its text; text that isn't a 32-bit integer raises."""
    return int_key(F.call_function("int", text))


def batch_changes(requests: DataFrame) -> DataFrame:
    """Requests with ops, an array of (op, key_enc, value), as changes in order; an empty batch has none."""
    return requests.select("request_id", F.posexplode("ops")).select(*mutation(F.col("request_id"), F.col("col.op"), F.col("col.key_enc"), F.col("col.value"), F.col("pos")))


def latest(changes: DataFrame) -> DataFrame:
    """The last change of each key, deletes too."""
    last = F.max_by(F.struct("op", "value"), F.struct("seq", "sub_seq"))
    return changes.groupBy("key_enc").agg(last.alias("last")).select("key_enc", "last.op", "last.value")


def current_state(changes: DataFrame) -> DataFrame:
    return latest(changes).where(F.col("op") == PUT).select("key_enc", "value")


def merged(snapshot: DataFrame, changes: DataFrame) -> DataFrame:
    """The state after a base snapshot (key_enc, value) and the changes since."""
    base = snapshot.select(*put(F.lit(-1), F.col("key_enc"), F.col("value")))
    return current_state(base.unionByName(changes.select("seq", "sub_seq", "op", "key_enc", "value")))


def point_get(state: DataFrame, key: Column) -> DataFrame:
    return state.where(F.col("key_enc") == key)


def range_scan(state: DataFrame, start: str, end: str) -> DataFrame:
    """String keys from start to end, both included, in order; none if start > end."""
    low, high = string_key(F.lit(start)), string_key(F.lit(end))
    # The bounds are literals on the bare column, so that sorted files are pruned by their statistics.
    return state.where((F.col("key_enc") >= low) & (F.col("key_enc") <= high)).orderBy("key_enc")


def kind_counts(keys: DataFrame) -> DataFrame:
    kind = key_kind(F.col("key_enc"))
    return keys.agg(F.count("*").alias("entries"), *(F.count_if(kind == k).alias(f"{k}_keys") for k in ("int", "string", "binary", "unknown")))


def type_counts(changes: DataFrame) -> DataFrame:
    op = F.col("op")
    return changes.agg(F.count("*").alias("records"), F.count_if(op == PUT).alias("puts"), F.count_if(op == DELETE).alias("deletes"), F.count_if(~op.isin(PUT, DELETE) | op.isNull()).alias("unknown"))


def mismatches(expected: DataFrame, state: DataFrame) -> DataFrame:
    """Expected keys (a null value: to be absent) that the state doesn't bear out; further keys of the state are fine."""
    got = state.select("key_enc", F.col("value").alias("got"))
    return expected.join(got, "key_enc", "left").where(~F.col("value").eqNullSafe(F.col("got")))
