"""Deterministic ids of a pair and of its verdict row."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from verdictflow import vocab as V
from verdictflow.functions.cols import as_col


def claim_id_low(a: Column | str, b: Column | str) -> Column:
    return F.least(as_col(a), as_col(b))


def claim_id_high(a: Column | str, b: Column | str) -> Column:
    return F.greatest(as_col(a), as_col(b))


def pair_key(run: Column | str, a: Column | str, b: Column | str) -> Column:
    """``run|low|high``: the same row whichever way round the pair is named."""
    return F.concat_ws("|", as_col(run), claim_id_low(a, b), claim_id_high(a, b))


def edge_key(a: Column | str, b: Column | str, with_context: Column | str) -> Column:
    """``low|high|variant|stamp``: one verdict row per pair variant."""
    variant = F.when(F.coalesce(as_col(with_context), F.lit(False)), "ctx").otherwise("bare")
    return F.concat_ws("|", claim_id_low(a, b), claim_id_high(a, b), variant, F.lit(V.KEY_STAMP))


def contexted(text: Column | str, context: Column | str) -> Column:
    """The claim text with its explanation after a blank line, if there is one."""
    context = as_col(context)
    return F.when(
        F.coalesce(context, F.lit("")) != "", F.concat(as_col(text), F.lit("\n\n"), context)
    ).otherwise(as_col(text))


def prior_gate(gate: Column | str) -> Column:
    return _neighbour(gate, -1)


def next_gate(gate: Column | str) -> Column:
    return _neighbour(gate, 1)


def _neighbour(gate: Column | str, step: int) -> Column:
    gates = F.array(*[F.lit(name) for name in V.GATES])
    position = F.array_position(gates, as_col(gate)).cast("int")
    wanted = position + step
    return F.when(
        (position > 0) & wanted.between(1, len(V.GATES)), F.get(gates, wanted - 1)
    )
