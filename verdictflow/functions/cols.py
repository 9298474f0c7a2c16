"""Small helpers shared by the column builders."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, functions as F


def as_col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def struct_of(fields: Mapping[str, Column]) -> Column:
    return F.struct(*[column.alias(name) for name, column in fields.items()])


def once(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` worked out once, also where ``body`` reads it inside a lambda."""
    return F.get(F.transform(F.array(value), lambda held: body(held)), F.lit(0))


def text_or_none(value: Column | str) -> Column:
    """Trimmed text, or null when nothing but whitespace is left."""
    return F.nullif(strip(value), F.lit(""))


def strip(value: Column | str) -> Column:
    """Trim every kind of white space, not only blanks."""
    return F.regexp_replace(as_col(value), r"^\s+|\s+$", "")


def count_if(condition: Column) -> Column:
    return F.count_if(F.coalesce(condition, F.lit(False)))


def weighted_count(condition: Column, weight: Column | None) -> Column:
    """How many rows meet the condition, each standing for ``weight`` pairs."""
    if weight is None:
        return count_if(condition)
    return F.coalesce(F.sum(F.when(condition, weight)), F.lit(0)).cast("long")


def ratio(part: Column, whole: Column) -> Column:
    """``part / whole`` as a double, 0 when there is nothing to divide by."""
    return F.when(whole == 0, F.lit(0.0)).otherwise(part.cast("double") / whole.cast("double"))


def staged_where(df: DataFrame, condition: Column) -> DataFrame:
    """``where`` on computed columns, evaluated after they have been computed.

    The optimizer moves a filter below the projections it reads from and copies
    their expressions into it; with long chains of dependent columns that copy
    grows far beyond the work it saves. A filter that also reads the partition
    number stays where it is written.
    """
    held = df.withColumn("_partition", F.spark_partition_id())
    return held.where(condition & (F.col("_partition") >= 0)).drop("_partition")
