"""Where a pair goes after a gate has looked at it.

``decision`` is a struct column or a mapping of columns; routes are mappings of
``gate``, ``tier``, ``decided_by`` and ``contradiction_flag``.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from verdictflow import vocab as V

_NONE = "string"

Route = dict[str, Column]


def _route(gate: Column, tier: Column, decided_by: Column, flag: Column) -> Route:
    return {"gate": gate, "tier": tier, "decided_by": decided_by, "contradiction_flag": flag}


def choose(condition: Column, first: Route, second: Route) -> Route:
    return {name: F.when(condition, first[name]).otherwise(second[name]) for name in first}


def _gate_after(disposition: Column, onward: str) -> Column:
    return (
        F.when(disposition == V.ESCALATE_G4, F.lit(V.G4))
        .when(disposition == V.FORWARD, F.lit(onward))
    )


def route_g1(decision) -> Route:
    """Settled pairs leave, escalations skip to the tail, the rest see G2."""
    d = decision["disposition"]
    return _route(
        _gate_after(d, V.G2),
        F.when(d == V.ESCALATE_G4, V.TIER_LLM).otherwise(V.TIER_CASCADE),
        F.when(d == V.DECIDED, F.lit(V.METHOD_G1)),
        decision["contradiction_flag"],
    )


def route_g2(decision, flag: Column) -> Route:
    """Settled pairs leave, the rest see G3; a flag set earlier stays."""
    d = decision["disposition"]
    return _route(
        _gate_after(d, V.G3),
        F.lit(V.TIER_CASCADE),
        F.when(d == V.DECIDED, F.lit(V.METHOD_G2)),
        flag,
    )


def pass_g2(flag: Column) -> Route:
    """Flagged pairs are handed on without being judged."""
    return _route(
        F.lit(V.G3), F.lit(V.TIER_CASCADE), F.lit(None).cast(_NONE), flag
    )


def route_g3(decision, flag: Column) -> Route:
    """A contradiction goes to a human and nobody claims to have decided it."""
    d = decision["disposition"]
    return _route(
        _gate_after(d, V.G4),
        F.when(d == V.ROUTE_HUMAN, V.TIER_HUMAN)
        .when(d == V.DECIDED, V.TIER_CASCADE)
        .otherwise(V.TIER_LLM),
        F.when(d == V.DECIDED, F.lit(V.METHOD_G3)),
        F.when(d == V.ROUTE_HUMAN, F.lit(True)).otherwise(flag),
    )


def edge_relation_g3(decision) -> Column:
    """The stored row names the candidate relation even where a human decides."""
    return F.when(
        decision["disposition"] == V.ROUTE_HUMAN, F.lit(V.CONTRADICTS)
    ).otherwise(decision["verdict"])


def route_g4(outcome: Column, flag: Column) -> Route:
    """``outcome`` is DECIDED, SHADOW, CAP_EXCEEDED or LLM_ERROR."""
    to_human = outcome.isin(V.CAP_EXCEEDED, V.LLM_ERROR)
    return _route(
        F.lit(None).cast(_NONE),
        F.when(to_human, V.TIER_HUMAN).otherwise(V.TIER_LLM),
        F.when(outcome == V.DECIDED, F.lit(V.METHOD_G4)),
        flag,
    )
