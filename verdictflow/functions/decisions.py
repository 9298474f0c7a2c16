"""The gate rules as ordered ``CASE`` expressions.

The rules compare a pair's scores with thresholds and look at nothing else, so
each pair is first reduced to a handful of *features* (the largest
contradiction, the smaller neutral score, ...). The rules read features only.
That keeps the expressions small, and it is what lets a grid search aggregate
pairs before it multiplies them by threshold cells (see ``plans.replay``).

Comparisons: ``contra_escape`` is strict ``>``, every ``*_min`` is inclusive,
``neutral_consensus`` is strict ``<``.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, functions as F

from verdictflow import vocab as V
from verdictflow.functions.cols import struct_of


@dataclass(frozen=True)
class Thresholds:
    """Calibration of one run. ``columns()`` turns it into literals."""

    neutral_min: float = V.THRESHOLD_PATHS["neutral_min"][1]
    repeat_min: float = V.THRESHOLD_PATHS["repeat_min"][1]
    contra_escape: float = V.THRESHOLD_PATHS["contra_escape"][1]
    support_min: float = V.THRESHOLD_PATHS["support_min"][1]
    support_floor: float = V.THRESHOLD_PATHS["support_floor"][1]
    contra_min: float = V.THRESHOLD_PATHS["contra_min"][1]
    neutral_consensus: float = V.THRESHOLD_PATHS["neutral_consensus"][1]

    def columns(self) -> dict[str, Column]:
        return {name: F.lit(float(value)) for name, value in asdict(self).items()}


def threshold_columns(prefix: str = "") -> dict[str, Column]:
    """The thresholds as columns of the row, for runs that bring their own."""
    return {name: F.col(f"{prefix}{name}") for name in V.THRESHOLD_PATHS}


def as_threshold_columns(thresholds: Thresholds | Mapping[str, Column] | None) -> dict[str, Column]:
    if thresholds is None:
        thresholds = Thresholds()
    return thresholds.columns() if isinstance(thresholds, Thresholds) else dict(thresholds)


# --- features -------------------------------------------------------------------------


def g1_features(g1: Column) -> dict[str, Column]:
    fwd, bwd, ctx_fwd, ctx_bwd = (g1[name] for name in ("fwd", "bwd", "ctx_fwd", "ctx_bwd"))
    both = ctx_fwd.isNotNull() & ctx_bwd.isNotNull()
    return {
        "a_contra": F.greatest(fwd["contradiction"], bwd["contradiction"]),
        "a_neutral": F.least(fwd["neutral"], bwd["neutral"]),
        "a_entail": F.least(fwd["entailment"], bwd["entailment"]),
        # One contexted side alone means no comparison.
        "c_neutral": F.when(both, F.least(ctx_fwd["neutral"], ctx_bwd["neutral"])),
        "c_entail": F.when(both, F.least(ctx_fwd["entailment"], ctx_bwd["entailment"])),
        "a_leans": leans_neutral(fwd) & leans_neutral(bwd),
    }


def g2_features(g2: Column) -> dict[str, Column]:
    best = best_support(g2)
    return {"support": best["support"], "direction": best["direction"]}


def g3_features(g3: Column) -> dict[str, Column]:
    return {
        "b_contra": F.greatest(g3["fwd"]["contradiction"], g3["bwd"]["contradiction"]),
        "b_leans": leans_neutral(g3["fwd"]) & leans_neutral(g3["bwd"]),
    }


def cascade_features(g1: Column, g2: Column, g3: Column) -> dict[str, Column]:
    one, two, three = g1_features(g1), g2_features(g2), g3_features(g3)
    features = {**one, **two, **three}
    features["leans"] = features.pop("a_leans") & features.pop("b_leans")
    return features


FEATURES = (
    "a_contra", "a_neutral", "a_entail", "c_neutral", "c_entail",
    "support", "direction", "b_contra", "leans",
)


def feature_columns(prefix: str = "") -> dict[str, Column]:
    return {name: F.col(f"{prefix}{name}") for name in FEATURES}


def leans_neutral(nli: Column) -> Column:
    return (nli["neutral"] >= nli["entailment"]) & (nli["neutral"] >= nli["contradiction"])


def best_support(g2: Column) -> Column:
    """The strongest support and where it came from.

    Equal scores go to the larger direction name, i.e. GROUNDED before FORWARD
    before BACKWARD.
    """

    def candidate(score: Column, direction: str) -> Column:
        return F.when(
            score.isNotNull(),
            F.struct(score["support"].alias("support"), F.lit(direction).alias("direction")),
        )

    return F.greatest(
        candidate(g2["fwd"], "FORWARD"),
        candidate(g2["bwd"], "BACKWARD"),
        candidate(g2["grounded"], "GROUNDED"),
    )


def scores_complete(g1: Column, g2: Column, g3: Column) -> Column:
    """Every mandatory score is there and no score is NaN.

    NaN would compare as the largest value, so such rows are refused up front.
    """
    required, present = [], []
    for nli, mandatory in (
        (g1["fwd"], True), (g1["bwd"], True), (g1["ctx_fwd"], False), (g1["ctx_bwd"], False),
        (g3["fwd"], True), (g3["bwd"], True),
    ):
        for name in ("entailment", "neutral", "contradiction"):
            (required if mandatory else present).append(nli[name])
    required += [g2["fwd"]["support"], g2["bwd"]["support"]]
    present.append(g2["grounded"]["support"])
    ok = F.lit(True)
    for value in required:
        ok = ok & value.isNotNull() & ~F.isnan(value)
    for value in present:
        ok = ok & ~F.isnan(F.coalesce(value, F.lit(0.0)))
    return F.coalesce(ok, F.lit(False))


# --- truncation roll-ups --------------------------------------------------------------


def _any_truncated(*scores: Column) -> Column:
    result = F.lit(False)
    for score in scores:
        result = result | F.coalesce(score["truncated"], F.lit(False))
    return result


def g1_truncated(g1: Column) -> Column:
    """The contexted passes do not count."""
    return _any_truncated(g1["fwd"], g1["bwd"])


def g2_truncated(g2: Column) -> Column:
    return _any_truncated(g2["fwd"], g2["bwd"], g2["grounded"])


def g3_truncated(g1: Column, g3: Column) -> Column:
    return _any_truncated(g1["fwd"], g1["bwd"], g3["fwd"], g3["bwd"])


def family_b_truncated(g3: Column) -> Column:
    return _any_truncated(g3["fwd"], g3["bwd"])


# --- rules ----------------------------------------------------------------------------


def bare_outcome(neutral: Column, entail: Column, t: Mapping[str, Column]) -> Column:
    """NEUTRAL, REPEATS, or null for "would forward"."""
    return (
        F.when(neutral >= t["neutral_min"], F.lit(V.NEUTRAL))
        .when(entail >= t["repeat_min"], F.lit(V.REPEATS))
    )


def g1_signals(f: Mapping[str, Column], t: Mapping[str, Column]) -> dict[str, Column]:
    """What the first rule looks at, before it is put in order."""
    return {
        "contradiction_flag": f["a_contra"] > t["contra_escape"],
        "bare": bare_outcome(f["a_neutral"], f["a_entail"], t),
        "contexted": bare_outcome(f["c_neutral"], f["c_entail"], t),
    }


def g1_decision(s: Mapping[str, Column], f: Mapping[str, Column]) -> dict[str, Column]:
    """First gate. Any contradiction signal outranks everything else."""
    flag, bare = s["contradiction_flag"], s["bare"]
    disagrees = f["c_neutral"].isNotNull() & ~bare.eqNullSafe(s["contexted"])
    decided = ~flag & ~disagrees & bare.isNotNull()
    return {
        "disposition": F.when(flag, V.FORWARD)
        .when(disagrees, V.ESCALATE_G4)
        .when(bare.isNotNull(), V.DECIDED)
        .otherwise(V.FORWARD),
        "verdict": F.when(decided, bare),
        "method": F.when(decided, F.lit(V.METHOD_G1)),
        "escalation_reason": F.when(~flag & disagrees, F.lit(V.CONTEXT_DISAGREEMENT)),
        "contradiction_flag": flag,
    }


def g2_signals(f: Mapping[str, Column], t: Mapping[str, Column]) -> dict[str, Column]:
    return {
        "supported": f["support"] >= t["support_min"],
        "weak": f["support"] < t["support_floor"],
    }


def g2_decision(s: Mapping[str, Column], f: Mapping[str, Column]) -> dict[str, Column]:
    """Second gate: enough support from any direction settles the pair."""
    supported = s["supported"]
    return {
        "disposition": F.when(supported, V.DECIDED).otherwise(V.FORWARD),
        "verdict": F.when(supported, F.lit(V.CORROBORATES)),
        "method": F.when(supported, F.lit(V.METHOD_G2)),
        "direction": F.when(supported, f["direction"]),
        "confidence": F.when(supported, f["support"]),
        "below_floor": ~supported & s["weak"],
    }


def g3_signals(f: Mapping[str, Column], t: Mapping[str, Column]) -> dict[str, Column]:
    a, b = f["a_contra"], f["b_contra"]
    return {
        "human": (a >= t["contra_min"]) & (b >= t["contra_min"]),
        "consensus": (a < t["neutral_consensus"]) & (b < t["neutral_consensus"]) & f["leans"],
    }


def g3_decision(s: Mapping[str, Column], f: Mapping[str, Column]) -> dict[str, Column]:
    """Third gate: two model families must agree; a contradiction goes to a human."""
    human, consensus = s["human"], s["consensus"]
    return {
        "disposition": F.when(human, V.ROUTE_HUMAN)
        .when(consensus, V.DECIDED)
        .otherwise(V.ESCALATE_G4),
        "verdict": F.when(~human & consensus, F.lit(V.NEUTRAL)),
        "method": F.when(human | consensus, F.lit(V.METHOD_G3)),
        "escalation_reason": F.when(human, F.lit(V.CONTRADICTION_SIGNAL)).when(
            ~consensus, F.lit(V.STAGE_DISAGREEMENT)
        ),
        "contradiction_flag": human,
        "confidence": F.when(human, F.least(f["a_contra"], f["b_contra"])),
    }


def cascade_outcome(
    one: Mapping[str, Column], two: Mapping[str, Column], three: Mapping[str, Column]
) -> dict[str, Column]:
    """What the cascade makes of a pair: G2 only sees unflagged pairs, G3 the rest."""
    flag = one["contradiction_flag"]
    at_g1 = one["disposition"] != V.FORWARD
    at_g2 = ~flag & (two["disposition"] == V.DECIDED)

    def pick(g1: Column, g2: Column, g3: Column) -> Column:
        return F.when(at_g1, g1).when(at_g2, g2).otherwise(g3)

    no_text, no_number = F.lit(None).cast("string"), F.lit(None).cast("double")
    return {
        "gate": pick(F.lit(V.G1), F.lit(V.G2), F.lit(V.G3)),
        "disposition": pick(one["disposition"], two["disposition"], three["disposition"]),
        "verdict": pick(one["verdict"], two["verdict"], three["verdict"]),
        "method": pick(one["method"], two["method"], three["method"]),
        "escalation_reason": pick(
            one["escalation_reason"], no_text, three["escalation_reason"]
        ),
        "confidence": pick(no_number, two["confidence"], three["confidence"]),
        "direction": pick(no_text, two["direction"], no_text),
        "contradiction_flag": pick(flag, F.lit(False), three["contradiction_flag"] | flag),
    }


# --- as one column --------------------------------------------------------------------


def decide_g1(f: Mapping[str, Column], thresholds=None) -> Column:
    return struct_of(g1_decision(g1_signals(f, as_threshold_columns(thresholds)), f))


def decide_g2(f: Mapping[str, Column], thresholds=None) -> Column:
    return struct_of(g2_decision(g2_signals(f, as_threshold_columns(thresholds)), f))


def decide_g3(f: Mapping[str, Column], thresholds=None) -> Column:
    return struct_of(g3_decision(g3_signals(f, as_threshold_columns(thresholds)), f))


# --- as columns of a table ------------------------------------------------------------
#
# Whole jobs apply the rules step by step, each step as flat columns of its own.
# Written as one nested expression, or with structs in between, the optimizer
# would copy every step into each place that uses it.

STEPS = {
    "g1": (g1_signals, g1_decision),
    "g2": (g2_signals, g2_decision),
    "g3": (g3_signals, g3_decision),
}
_DECISION_FIELDS = {
    "g1": ("disposition", "verdict", "method", "escalation_reason", "contradiction_flag"),
    "g2": ("disposition", "verdict", "method", "direction", "confidence", "below_floor"),
    "g3": (
        "disposition", "verdict", "method", "escalation_reason", "contradiction_flag",
        "confidence",
    ),
}


def decision_columns(gate: str) -> dict[str, Column]:
    """The columns ``with_decision`` has added."""
    return {name: F.col(f"_{gate}_{name}") for name in _DECISION_FIELDS[gate]}


def with_columns(df: DataFrame, prefix: str, columns: Mapping[str, Column]) -> DataFrame:
    return df.withColumns({f"{prefix}{name}": column for name, column in columns.items()})


def prefixed(prefix: str, names) -> dict[str, Column]:
    return {name: F.col(f"{prefix}{name}") for name in names}


def with_decision(
    df: DataFrame, gate: str, f: Mapping[str, Column], thresholds=None
) -> DataFrame:
    """``df`` with one gate's decision as ``_<gate>_...`` columns.

    ``f`` must name plain columns of ``df``.
    """
    signals, decision = STEPS[gate]
    found = signals(f, as_threshold_columns(thresholds))
    staged = with_columns(df, f"_{gate}_s_", found)
    return with_columns(
        staged, f"_{gate}_", decision(prefixed(f"_{gate}_s_", found), f)
    ).drop(*[f"_{gate}_s_{name}" for name in found])


def with_cascade(df: DataFrame, f: Mapping[str, Column], thresholds=None) -> DataFrame:
    """``df`` with the outcome of the whole cascade as plain columns."""
    staged = df
    for gate in STEPS:
        staged = with_decision(staged, gate, f, thresholds)
    outcome = cascade_outcome(*[decision_columns(gate) for gate in STEPS])
    return staged.withColumns(outcome).drop(
        *[f"_{gate}_{name}" for gate in STEPS for name in _DECISION_FIELDS[gate]]
    )
