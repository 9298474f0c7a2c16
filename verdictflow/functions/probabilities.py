"""Model outputs to probabilities."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from verdictflow.functions.cols import as_col, once


def to_probabilities(logits: Column | str) -> Column:
    """Softmax over an array of logits; one single logit goes through a sigmoid.

    The largest logit is subtracted first, so nothing overflows. That logit and the sum are worked
    out once for a row: read inside a lambda, they would be worked out for every element.
    """
    values = as_col(logits)
    powers = once(F.array_max(values), lambda peak: F.transform(values, lambda x: F.exp(x - peak)))

    def shares(p: Column) -> Column:
        total = F.aggregate(p, F.lit(0.0), lambda acc, x: acc + x)
        return once(total, lambda t: F.transform(p, lambda x: x / t))

    return F.when(
        F.size(values) == 1, F.transform(values, lambda x: 1.0 / (1.0 + F.exp(-x)))
    ).otherwise(once(powers, shares))


def argmax(values: Column | str) -> Column:
    """Position of the largest value, counted from 0; the first one on a tie."""
    column = as_col(values)
    return (F.array_position(column, F.array_max(column)) - 1).cast("int")


def support_from(probabilities: Column | str, mapped: Column | None = None) -> Column:
    """Support probability of a grounding head: the only column, the mapped
    entailment column, or the last one."""
    values = as_col(probabilities)
    last = F.size(values) - 1
    index = last if mapped is None else F.coalesce(mapped, last)
    return F.when(F.size(values) == 1, F.get(values, F.lit(0))).otherwise(F.get(values, index))
