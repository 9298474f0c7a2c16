"""Exact quantiles of groups of any size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window as W, functions as F

SLICES = 1_024


def nearest_rank(df: DataFrame, by: Sequence[str], value: str, wanted: dict[str, str]) -> DataFrame:
    """``by``, ``entries`` (values that are not null) and one column per wanted quantile.

    ``wanted`` maps a column name to a probability written as a decimal; the result is the value
    whose rank is the probability times the entries, rounded up.

    Equal values are counted first. The counts of a group are then summed in ``SLICES`` slices
    between its least and greatest value, and only the slice that holds a wanted rank is ordered, so a
    hot group is neither collected nor sorted in one task. A null in ``by`` is a group of its own.
    """
    keys = [f"_k{i}" for i in range(len(by))]
    named = df.where(F.col(value).isNotNull()).select(*[F.struct(c).alias(k) for c, k in zip(by, keys)], F.col(value).cast("double").alias("_v"))
    counted = named.groupBy(*keys, "_v").agg(F.count("*").alias("_n"))
    ends = counted.groupBy(*keys).agg(F.min("_v").alias("_low"), F.max("_v").alias("_high"), F.sum("_n").alias("entries"))
    share = (F.col("_v") - F.col("_low")) / (F.col("_high") - F.col("_low"))
    slice_ = F.when(F.col("_high") > F.col("_low"), F.least(F.floor(share * SLICES), F.lit(SLICES - 1))).otherwise(F.lit(0)).cast("int")
    sliced = counted.join(ends, keys).withColumn("_s", slice_)
    sums = sliced.groupBy(*keys, "entries", "_s").agg(F.sum("_n").alias("_n"))
    upto = W.partitionBy(*keys).orderBy("_s").rowsBetween(W.unboundedPreceding, W.currentRow)
    ranks = F.array(*[
        F.struct(F.lit(name).alias("name"), F.expr(f"greatest(1, cast(ceil({p} * entries) AS long))").alias("rank")) for name, p in wanted.items()
    ])
    places = sums.withColumn("_to", F.sum("_n").over(upto)).withColumn("_from", F.col("_to") - F.col("_n")).select(
        *keys, "entries", "_s", "_from", F.explode(F.filter(ranks, lambda r: (r["rank"] > F.col("_from")) & (r["rank"] <= F.col("_to")))).alias("_r")
    )
    inside = W.partitionBy(*keys, "_s", "_r.name").orderBy("_v").rowsBetween(W.unboundedPreceding, W.currentRow)
    found = (
        sliced.select(*keys, "_s", "_v", "_n").join(places, [*keys, "_s"])
        .withColumn("_at", F.col("_from") + F.sum("_n").over(inside)).where(F.col("_at") >= F.col("_r.rank"))
        .groupBy(*keys, "entries").agg(*[F.min(F.when(F.col("_r.name") == name, F.col("_v"))).alias(name) for name in wanted])
    )
    return found.select(*[F.col(k)[c].alias(c) for c, k in zip(by, keys)], "entries", *wanted)
