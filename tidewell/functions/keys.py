"""The key codec: one ordered key space of tagged bytes for int, string and binary keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The tag byte of each kind of key.
TAGS = {"int": 1, "string": 2, "binary": 3}


def _tag(kind: str) -> Column:
    return F.lit(bytes([TAGS[kind]]))


def int_key(k: Column) -> Column:
    """01 and four bytes of two's complement, highest first; negative keys so come after the others."""
    return F.concat(_tag("int"), F.unhex(F.lpad(F.hex(k.cast("long").bitwiseAND(F.lit(4294967295))), 8, "0")))


def string_key(k: Column) -> Column:
    return F.concat(_tag("string"), F.encode(k, "UTF-8"))


def binary_key(k: Column) -> Column:
    return F.concat(_tag("binary"), k)


def key_kind(k: Column) -> Column:
    """int, string, binary, or unknown for any other first byte and for an empty key."""
    first, out = F.substring(k, 1, 1), F.lit("unknown")
    for kind in TAGS:
        out = F.when(first == _tag(kind), kind).otherwise(out)
    return out


def is_string_key(k: Column) -> Column:
    return F.coalesce(F.substring(k, 1, 1) == _tag("string"), F.lit(False))


def string_of(k: Column) -> Column:
    """The string in a string key; any other key raises."""
    return F.when(is_string_key(k), F.decode(F.substring(k, 2, 2147483647), "UTF-8")).otherwise(F.raise_error(F.lit("not a string key")).cast("string"))


def int_of(k: Column) -> Column:
    """The int in an int key, with its sign; null for other keys."""
    raw = F.conv(F.hex(F.substring(k, 2, 4)), 16, 10).cast("long")
    return F.when(key_kind(k) == "int", F.when(raw > 2147483647, raw - 4294967296).otherwise(raw).cast("int"))
