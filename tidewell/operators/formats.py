"""Verifying files and laying out containers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.functions.checksums import fnv1a
from tidewell.functions.numbers import align_up, u32_hex

#: Magic, header and section sizes of a container, and its sections in order.
CONTAINER_MAGIC, CONTAINER_HEADER, SECTION_HEADER = b"KVCNTR01", 32, 24
SECTIONS = ["metadata", "index", "objects", "journal"]


def rewrite_recommended(snapshot_version: Column, log_version: Column, log_truncated: Column) -> Column:
    """log_version: of the first record, null for an empty log."""
    return (snapshot_version != 2) | F.coalesce(log_version != 2, F.lit(False)) | log_truncated


def verify_reason(magic_ok: Column, entry_magic_ok: Column, snapshot_truncated: Column, log_truncated: Column, rewrite: Column) -> Column:
    """The first fault that applies."""
    faults = F.when(~magic_ok, "snapshot_magic").when(~entry_magic_ok, "snapshot_entry_magic").when(snapshot_truncated, "snapshot_truncated")
    return faults.when(log_truncated, "wal_truncated").when(rewrite, "migration_required").otherwise("current_layout")


def verify_status(reason: Column) -> Column:
    return F.when(reason == "current_layout", 0).otherwise(2)


def kv_line(line: Column) -> Column:
    """A map from the tokens of `a=1 b=2`; of one key the last counts, a token without = raises."""
    tokens = F.filter(F.split(line, r"\s+"), lambda t: t != "")
    bad = F.exists(tokens, lambda t: F.instr(t, "=") == 0)
    key = lambda t: F.substring_index(t, "=", 1)
    last = F.filter(tokens, lambda t, i: ~F.exists(F.slice(tokens, i + 2, F.greatest(F.size(tokens), F.lit(1))), lambda u: key(u) == key(t)))
    pairs = F.transform(last, lambda t: F.struct(key(t), F.substr(t, F.instr(t, "=") + 1)))
    return F.when(bad, F.raise_error(F.lit("a token without =")).cast("map<string,string>")).otherwise(F.map_from_entries(pairs))


def overlapping(sections: DataFrame, by: str) -> DataFrame:
    """For each container whether, in order of offset, a section begins before the one before it ends."""
    before = F.lag(F.col("offset") + F.col("length")).over(Window.partitionBy(by).orderBy("offset", "length"))
    return sections.withColumn("_hit", F.coalesce(F.col("offset") < before, F.lit(False))).groupBy(by).agg(F.max("_hit").alias("overlaps"))


def planned(sizes: DataFrame, by: str, alignment: int) -> DataFrame:
    """A row for each section of each container: its aligned place, and the container's size; sizes: by, and one column each section."""
    header = F.lit(CONTAINER_HEADER + SECTION_HEADER * len(SECTIONS)).cast("long")
    end, rows = header, []
    for k, name in enumerate(SECTIONS):
        start = align_up(end, alignment)
        rows.append(F.struct(F.lit(k + 1).alias("type"), start.alias("offset"), F.col(name).cast("long").alias("length")))
        end = start + F.col(name)
    return sizes.select(by, F.explode(F.array(*rows)).alias("s"), end.cast("long").alias("file_bytes")).select(by, "s.*", "file_bytes")


def container_checksum(sections: int, version: Column, flags: Column, rows: Column) -> Column:
    """FNV-1a of a header whose checksum is 0 and of its sections; rows: array of (type, flags, offset, length)."""
    u64 = lambda x: F.concat(u32_hex(x), u32_hex(F.shiftright(x, 32)))
    size = F.lit(CONTAINER_HEADER + SECTION_HEADER * sections)
    head = F.concat(F.lit(CONTAINER_MAGIC.hex().upper()), u32_hex(version), u32_hex(size), u32_hex(F.lit(sections)), u32_hex(flags), F.lit("0" * 16))
    body = F.array_join(F.transform(rows, lambda s: F.concat(u32_hex(s["type"]), u32_hex(s["flags"]), u64(s["offset"].cast("long")), u64(s["length"].cast("long")))), "")
    return fnv1a(F.unhex(F.concat(head, body)))


def has_container_magic(data: Column) -> Column:
    return F.coalesce(F.substring(data, 1, 8) == F.lit(CONTAINER_MAGIC), F.lit(False))
