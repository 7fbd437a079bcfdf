"""Columns that are computed once.

Spark moves filters below projections and repeats the projected expressions in
them. For long text expressions that means doing the work twice, and planning
time that grows with every further step. A generator that yields exactly one
row is a point no filter on its output passes.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def with_computed(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns whose expressions are evaluated here and nowhere else."""
    fields = F.struct(*[c.alias(name) for name, c in columns.items()])
    kept = [c for c in df.columns if c not in columns]
    return df.select(*kept, F.inline(F.array(fields)))


def exploded(df: DataFrame, array: str, pos: str, item: str, keep: list[str] | None = None) -> DataFrame:
    """``posexplode`` without an inferred filter that computes the array again."""
    kept = [c for c in (keep or df.columns) if c != array]
    return df.select(*kept, F.posexplode_outer(array).alias(pos, item)).where(F.col(pos).isNotNull())


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body names it; also inside lambdas."""
    return F.get(F.transform(F.array(value), body), F.lit(0))
