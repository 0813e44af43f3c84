"""Running and sliding computations over a global order that don't fall into one partition.

Rows are numbered by an integer column `at` without gaps of meaning. running_sum() adds up within chunks of the
order and then over the chunks' totals; sliding() gives each chunk the last rows of the one before it as well.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CHUNK = 1 << 16


def running_sum(df: DataFrame, at: str, columns: dict[str, str], chunk: int = CHUNK, by: list[str] | None = None) -> DataFrame:
    """df with, for each (new, old) of columns, the sum of old up to this row; at: long, unique within `by` (all rows if none)."""
    by = by or []
    rows = df.withColumn("_chunk", F.expr(f"{at} div {chunk}"))
    totals = rows.groupBy(*by, "_chunk").agg(*(F.sum(old).alias(f"_t_{new}") for new, old in columns.items()))
    before = Window.partitionBy(*by).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)  # a row for each chunk
    bases = totals.select(*by, "_chunk", *(F.coalesce(F.sum(f"_t_{new}").over(before), F.lit(0)).alias(f"_b_{new}") for new in columns))
    within = Window.partitionBy(*by, "_chunk").orderBy(at).rowsBetween(Window.unboundedPreceding, 0)
    out = rows.withColumns({f"_w_{new}": F.sum(old).over(within) for new, old in columns.items()}).join(bases, [*by, "_chunk"])
    return out.select(*df.columns, *((F.col(f"_w_{new}") + F.col(f"_b_{new}")).alias(new) for new in columns))


def sliding(df: DataFrame, at: str, rows: int, columns: dict[str, callable], chunk: int = CHUNK) -> DataFrame:
    """df with each new column as columns[new](window), the window holding this row and the rows - 1 before it.

    `at` must count 0, 1, 2, ... so that the rows before a chunk are known by number.
    """
    chunk = max(chunk, rows)
    own = F.expr(f"{at} div {chunk}")
    late = (F.col(at) % chunk) >= chunk - (rows - 1)
    twice = df.withColumn("_chunk", F.explode(F.when(late, F.array(own, own + 1)).otherwise(F.array(own))))
    frame = Window.partitionBy("_chunk").orderBy(at).rowsBetween(-(rows - 1), 0)
    out = twice.withColumns({new: make(frame) for new, make in columns.items()})
    return out.where(F.col("_chunk") == own).select(*df.columns, *columns)


def numbered(df: DataFrame, order: str, name: str, chunk: int = CHUNK, by: list[str] | None = None) -> DataFrame:
    """df with `name` counting 0, 1, 2, ... in the order of a long column, unique within `by`."""
    ones = df.withColumn("_one", F.lit(1))
    return running_sum(ones, order, {name: "_one"}, chunk, by).drop("_one").withColumn(name, F.col(name) - 1)
