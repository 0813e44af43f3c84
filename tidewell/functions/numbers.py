"""Scalar rules: checksums, record sizes, latency buckets, scores, ratios and trends, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewell.functions.checksums import fnv1a

#: Bytes before key and value of a log record, of a snapshot entry, and of a snapshot.
RECORD_BYTES, ENTRY_BYTES, SNAPSHOT_BYTES = 20, 12, 16
#: Upper bounds of the latency buckets in microseconds; a twelfth bucket holds the rest.
BOUNDS = [50, 100, 250, 500, 1000, 2500, 5000, 10000, 25000, 50000, 100000]
#: A signal counts as four times its scale at most, in thousandths; from where a ratio is a trend.
RATIO_CAP, IMPROVING, REGRESSING = 4000, 105.0, 95.0
U32, I64 = 4294967295, 9223372036854775807


def size_of(b: Column) -> Column:
    return F.coalesce(F.octet_length(b), F.lit(0)).cast("long")


def record_bytes(op: Column, key: Column, value: Column) -> Column:
    """A delete carries no value."""
    return F.lit(RECORD_BYTES) + size_of(key) + F.when(op == 1, size_of(value)).otherwise(0)


def entry_bytes(key: Column, value: Column) -> Column:
    return F.lit(ENTRY_BYTES) + size_of(key) + size_of(value)


def u32_hex(n: Column) -> Column:
    """Hex digits of four bytes, lowest first."""
    h = F.lpad(F.hex(n.cast("long").bitwiseAND(F.lit(U32))), 8, "0")
    return F.concat(*(F.substring(h, k, 2) for k in (7, 5, 3, 1)))


def record_checksum(op: Column, key: Column, value: Column) -> Column:
    """Over type, both sizes, key and value."""
    kind = F.lpad(F.hex(op.cast("long")), 2, "0")
    value = F.when(op == 1, value).otherwise(F.lit(b""))
    return fnv1a(F.concat(F.unhex(F.concat(kind, u32_hex(size_of(key)), u32_hex(size_of(value)))), key, F.coalesce(value, F.lit(b""))))


def old_record_checksum(op: Column, int_key: Column, value: Column) -> Column:
    """The first format's: over type, the raw int key, the value's size and the value."""
    kind = F.lpad(F.hex(op.cast("long")), 2, "0")
    value = F.coalesce(F.when(op == 1, value), F.lit(b""))
    return fnv1a(F.concat(F.unhex(F.concat(kind, u32_hex(int_key), u32_hex(size_of(value)))), value))


def latency_bucket(us: Column) -> Column:
    """The first bucket whose bound isn't below the latency."""
    return sum(((us > b).cast("int") for b in BOUNDS), F.lit(0))


def bucket_bound(bucket: Column) -> Column:
    """The bound of a bucket; the last has that of the one before."""
    return F.element_at(F.array(*map(F.lit, BOUNDS)), F.least(bucket + 1, F.lit(len(BOUNDS))).cast("int")).cast("long")


def whole(a: Column, b: Column) -> Column:
    """a / b without its fraction; 0 where b is 0."""
    return F.when(b == 0, F.lit(0)).otherwise(F.try_divide(a - F.try_mod(a, b), b)).cast("long")


def times(a: Column, b: Column, most: int = I64) -> Column:
    """The product, or `most` where it's beyond."""
    product = a.cast("decimal(19,0)") * b.cast("decimal(19,0)")
    return F.least(product, F.lit(most).cast("decimal(38,0)")).cast("long")


def ratio_milli(value: Column, scale: Column) -> Column:
    capped = F.when((value == 0) | (scale == 0), 0).when(value >= scale * (RATIO_CAP // 1000), RATIO_CAP)
    return capped.otherwise(whole(value * 1000, scale)).cast("long")


def signal_score(value: Column, scale: Column, weight: Column) -> Column:
    return ratio_milli(value, scale) * weight


def deficit_score(seen: Column, target: Column, weight: Column) -> Column:
    return F.when((target == 0) | (seen >= target), 0).otherwise(whole((target - seen) * 1000, target) * weight).cast("long")


def obsolete_percent(total: Column, live: Column) -> Column:
    return F.when(total == 0, 0).otherwise(whole(F.greatest(total - live, F.lit(0)) * 100, total)).cast("long")


def should_compact(total: Column, live: Column, bytes_limit: int, percent: int) -> Column:
    by_bytes = (total >= bytes_limit) if bytes_limit else F.lit(False)
    by_ratio = ((total > 0) & (F.greatest(total - live, F.lit(0)) * 100 >= total * percent)) if percent else F.lit(False)
    return by_bytes | by_ratio


def throughput_trend(percent: Column) -> Column:
    return F.when(percent >= IMPROVING, "improving").when(percent <= REGRESSING, "regressing").otherwise("stable")


def latency_trend(percent: Column) -> Column:
    return F.when(percent >= IMPROVING, "regressing").when(percent <= REGRESSING, "improving").otherwise("stable")


def align_up(x: Column, to: int) -> Column:
    if to <= 0:
        raise ValueError("alignment must be positive")
    return x + F.pmod(-x, F.lit(to))
