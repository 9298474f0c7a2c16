"""Ranking inside groups that may hold a large share of all rows.

A plain window sorts a whole group in one task. These helpers deal rows out in
ranges of the order, work inside the ranges, and only then combine one summary
per group and range, so the work of a hot group spreads over the cluster.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from verdictflow.session import stored


def bucketed_lead(
    df: DataFrame, keys: Sequence[str], bucket: Column, order: Sequence[Column],
    value: Column, name: str,
) -> DataFrame:
    """The next row's ``value`` per ``keys``; ``bucket`` must rise with ``order``.

    The last row of a bucket takes the first value of the next bucket.
    """
    keys = list(keys)
    staged = df.withColumn("_bucket", bucket).withColumn("_value", value)
    renamed = {key: f"_k_{key}" for key in keys}
    firsts = (
        staged.groupBy(*keys, "_bucket")
        .agg(F.min_by("_value", F.struct(*order)).alias("_first"))
        .withColumn(
            "_next_first",
            F.lead("_first").over(Window.partitionBy(*keys).orderBy("_bucket")),
        )
        .select(
            *[F.col(key).alias(alias) for key, alias in renamed.items()],
            F.col("_bucket").alias("_k_bucket"),
            "_next_first",
        )
    )
    inner = F.lead("_value").over(Window.partitionBy(*keys, "_bucket").orderBy(*order))
    match = F.col("_bucket").eqNullSafe(F.col("_k_bucket"))
    for key, alias in renamed.items():
        match = match & F.col(key).eqNullSafe(F.col(alias))
    return (
        staged.withColumn("_inner", inner)
        .join(firsts, match, "left")
        .withColumn(name, F.coalesce("_inner", "_next_first"))
        .drop("_bucket", "_value", "_inner", "_next_first", "_k_bucket", *renamed.values())
    )


def _dealt(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """``df`` written in ranges of (keys, order), with each row's place ``_at`` and its range ``_part``.

    A group of any size, or a table without keys, is spread over all partitions and sorted there.
    Rows equal in keys and order stay in one partition, which streams them. The input is read
    twice (ranges are sampled first).
    """
    names = [F.col(key) for key in keys]
    dealt = df.repartitionByRange(*names, *order).sortWithinPartitions(*names, *order)
    # The partition in the upper bits, the row inside it in the lower 33.
    return stored(dealt.withColumn("_at", F.monotonically_increasing_id())).withColumn("_part", F.shiftright("_at", 33))


def numbered(df: DataFrame, keys: Sequence[str], order: Sequence[Column], name: str) -> DataFrame:
    """``row_number`` per ``keys`` by one range shuffle and a prefix sum of its partitions' counts.

    A row's place inside its partition is known when it is written; only one count per group and
    partition is summed up afterwards. Pass a written table, see ``_dealt``.
    """
    keys = list(keys)
    held = _dealt(df, keys, order)
    parts = held.groupBy(*keys, "_part").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_rows"))
    before = F.sum("_rows").over(Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    # Keys of the lookup get names of their own: null keys must match as well.
    renamed = {key: f"_k_{key}" for key in keys}
    shifts = parts.select(
        *[F.col(key).alias(alias) for key, alias in renamed.items()], F.col("_part").alias("_k_part"),
        (F.coalesce(before, F.lit(0)) - F.col("_first") + 1).alias("_shift"),
    )
    match = F.col("_part") == F.col("_k_part")
    for key, alias in renamed.items():
        match = match & F.col(key).eqNullSafe(F.col(alias))
    return (
        held.join(shifts, match).withColumn(name, F.col("_at") + F.col("_shift"))
        .drop("_at", "_part", "_k_part", "_shift", *renamed.values())
    )


def following(df: DataFrame, keys: Sequence[str], order: Sequence[Column], value: Column, name: str) -> DataFrame:
    """The next row's ``value`` per ``keys``, in ranges of the order instead of whole groups."""
    held = _dealt(df, keys, order)
    return bucketed_lead(held, keys, F.col("_part"), [F.col("_at")], value, name).drop("_at", "_part")


def budget_limits(rows: DataFrame, budgets: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """(key, _last): the last row, in ascending ``order``, that the group's ``budget`` covers.

    Groups whose rows all fit have no limit, and groups without a budget (null) are not looked at.
    Only key and order of the others are dealt out, so no group is ranked in one task and one row
    per group is left.
    """
    capped = rows.join(budgets.where(F.col("budget") > 0), key).select(key, "budget", *order)
    placed = numbered(capped, [key], [F.col(name).asc() for name in order], "_n")
    return placed.where(F.col("_n") == F.col("budget")).select(key, F.struct(*order).alias("_last"))


def within_budget(budget: str, order: Sequence[str]) -> Column:
    """True for rows inside the budget, given ``_last`` of ``budget_limits`` on every row."""
    inside = F.col("_last").isNull() | (F.struct(*order) <= F.col("_last"))
    return F.when(F.col(budget).isNull(), F.lit(True)).otherwise((F.col(budget) > 0) & inside)
