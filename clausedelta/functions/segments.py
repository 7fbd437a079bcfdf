"""Ordered window functions that stay parallel when one key is huge.

A plain window puts all rows of a key into one task. Here each key is cut into
ordered segments (a day of its time line, a range of its row numbers). The
window runs per (key, segment); what crosses a segment border is carried by a
second window over one summary row per (key, segment).

With ``segment`` at sensible width the second window is smaller than the data
by the number of rows per segment.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _segmented(df: DataFrame, keys: list[str], segment: Column) -> DataFrame:
    """Add the pair of key and segment as one struct column.

    A struct is never null itself, so rows with a null key meet in the join
    below by plain equality, and window and join share one partitioning.
    """
    return df.withColumn("_part", F.struct(*keys, segment.alias("_seg")))


def _across(keys: list[str]):
    by = [F.col(f"_part.{k}") for k in keys]
    window = Window.partitionBy(*by) if by else Window.partitionBy()
    return window.orderBy(F.col("_part._seg")).rowsBetween(Window.unboundedPreceding, -1)


def segmented_last(
    df: DataFrame, keys: list[str], order: list[str], segment: Column, value: Column, out: str,
    include_current: bool = True,
) -> DataFrame:
    """Last non-null ``value`` up to (or strictly before) each row, per key.

    With a non-null value and ``include_current=False`` this is ``lag``.
    """
    df = _segmented(df, keys, segment).withColumn("_val", value)
    end = 0 if include_current else -1
    inside = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, end)
    rows = df.withColumn("_local", F.last("_val", ignorenulls=True).over(inside))
    last = f"max_by(_val, struct({', '.join(order)})) FILTER (WHERE _val IS NOT NULL)"
    summary = df.groupBy("_part").agg(F.expr(last).alias("_end"))
    carry = summary.select("_part", F.last("_end", ignorenulls=True).over(_across(keys)).alias("_carry"))
    return (
        rows.join(carry, "_part", "left").withColumn(out, F.coalesce("_local", "_carry"))
        .drop("_part", "_val", "_local", "_carry")
    )


def segmented_row_number(
    df: DataFrame, keys: list[str], order: list[str], segment: Column, out: str
) -> DataFrame:
    """``row_number`` per key in the given order, starting at 1."""
    df = _segmented(df, keys, segment)
    rows = df.withColumn("_local", F.row_number().over(Window.partitionBy("_part").orderBy(*order)))
    summary = df.groupBy("_part").agg(F.count("*").alias("_n"))
    carry = summary.select("_part", F.coalesce(F.sum("_n").over(_across(keys)), F.lit(0)).alias("_before"))
    return (
        rows.join(carry, "_part", "left").withColumn(out, (F.col("_local") + F.col("_before")).cast("int"))
        .drop("_part", "_local", "_before")
    )
