"""The gates as jobs over all pairs at once.

Each gate takes the pair table and returns the next pair table, the updates of
the verdict rows, and its counters. ``judge_pairs`` does the first three gates
in a single projection and emits one finished verdict row per pair.

Per-run settings are a table (``run_table``), so pairs of many runs, each with
its own calibration, are judged together.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from verdictflow import vocab as V
from verdictflow.functions import decisions as D, routing as R, settings, stage_scores as S
from verdictflow.functions.prompts import judge_prompt
from verdictflow.functions.cols import count_if, staged_where, struct_of
from verdictflow.operators import edges as E, hydrate as H, tail as T
from verdictflow.operators.ordered import budget_limits, within_budget


@dataclass
class GateResult:
    """Lazy results of one gate. ``rejects`` are pairs that could not be judged;
    they stay at their gate."""

    state: DataFrame
    edges: DataFrame
    counters: DataFrame
    rejects: DataFrame | None = None
    counted: DataFrame | None = None  # fused job: counters of all gates, see ``long_counters``


def run_table(runs: DataFrame) -> DataFrame:
    """(stage3_run_id, run): settings of each run, read once from its snapshot.

    ``runs(stage3_run_id, run_request_id, subject_id, judge_mode, attempt,
    snapshot)``. JSON is parsed here, once per run, and never per pair.
    """
    thresholds = struct_of(settings.thresholds_from_snapshot("snapshot"))
    subject = F.when(
        F.coalesce("subject_id", F.lit("")) == "",
        F.raise_error(F.concat(F.lit("run names no subject: "), F.col("stage3_run_id"))).cast("string"),
    ).otherwise(F.col("subject_id"))
    run = struct_of({
        "run_request_id": F.col("run_request_id"),
        "subject_id": subject,
        "judge_mode": F.col("judge_mode"),
        "attempt": F.coalesce("attempt", F.lit(1)),
        "thresholds": thresholds,
        "g1_model": settings.binding_from_snapshot("snapshot", "g1")["model"],
        "g2_model": settings.binding_from_snapshot("snapshot", "g2")["model"],
        "g3_model": settings.binding_from_snapshot("snapshot", "g3")["model"],
        "grounding_mode": settings.grounding_mode(
            F.get_json_object("snapshot", "$.g2.groundingMode")
        ),
        "tail": settings.tail_settings("snapshot"),
    })
    return runs.select("stage3_run_id", run.alias("run"))


def _thresholds() -> dict[str, Column]:
    return D.threshold_columns("run.thresholds.")


def _frame(state: DataFrame, gate: str, runs: DataFrame) -> DataFrame:
    """Every pair, read once, with its run's settings; ``_here`` marks those this gate has."""
    here = (F.col("gate") == gate) & F.col("run").isNotNull()
    return state.join(runs, "stage3_run_id", "left").withColumn("_here", F.coalesce(here, F.lit(False)))


def _settle(
    decided: DataFrame, state: DataFrame, usable: Column, route: R.Route, problem: str, on_missing: str
) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """(judged pairs, next pair table, rejects) out of one frame.

    The next table is a projection of the frame, so gates that are chained read the first
    table once each. An unusable pair stops the job or stays where it is.
    """
    moves = usable
    if on_missing != "reject":
        error = F.raise_error(F.concat(F.lit(f"{problem}: "), F.col("pair_id"))).cast("boolean")
        moves = F.when(usable, F.lit(True)).otherwise(error)
    marked = decided.withColumn("_moves", F.when(F.col("_here"), moves).otherwise(F.lit(False)))
    judged = _as_run_rows(staged_where(marked, F.col("_moves")))
    new = {name: route[name] for name in ("gate", "tier", "decided_by", "contradiction_flag")}
    new["run_request_id"] = F.col("run.run_request_id")
    for name in ("lease_owner", "lease_expires_at"):
        if name in state.columns:
            new[name] = F.lit(None).cast(state.schema[name].dataType)
    following = marked.select(*[
        F.when(F.col("_moves"), new[name]).otherwise(F.col(name)).alias(name) if name in new else F.col(name)
        for name in state.columns
    ])
    rejects = None
    if on_missing == "reject":
        rejects = staged_where(marked, F.col("_here") & ~F.col("_moves")).select("pair_id", "gate", F.lit(problem).alias("problem"))
    return judged, following, rejects


def _as_run_rows(judged: DataFrame) -> DataFrame:
    return judged.withColumns({
        "subject_id": F.col("run.subject_id"),
        "run_request_id": F.col("run.run_request_id"),
    })


def _counters(rows: DataFrame, conditions: dict[str, Column]) -> DataFrame:
    """Counters per run, zero where nothing happened."""
    return rows.groupBy("stage3_run_id").agg(
        *[count_if(condition).alias(name) for name, condition in conditions.items()]
    )


def long_counters(wide: DataFrame, columns: list[tuple[str, str, str, str | None]]) -> DataFrame:
    """(stage3_run_id, gate, name, value) out of one row per run.

    ``columns`` are (gate, counter, column, column that must not be zero or None).
    """
    def one(gate: str, name: str, column: str, reached: str | None) -> Column:
        entry = F.struct(F.lit(gate).alias("gate"), F.lit(name).alias("name"), F.col(column).cast("double").alias("value"))
        return entry if reached is None else F.when(F.col(reached) > 0, entry)

    entries = F.array_compact(F.array(*[one(*c) for c in columns]))
    return wide.select("stage3_run_id", F.explode(entries).alias("c")).select("stage3_run_id", "c.*")


# --- conditions shared by the single gates and the fused job --------------------------


def g1_counts(decision, truncated: Column) -> dict[str, Column]:
    d, v = decision["disposition"], decision["verdict"]
    return {
        "seen": F.lit(True),
        "neutral": (d == V.DECIDED) & (v == V.NEUTRAL),
        "repeats": (d == V.DECIDED) & (v != V.NEUTRAL),
        "contraFlagged": (d == V.FORWARD) & decision["contradiction_flag"],
        "forwarded": d == V.FORWARD,
        "truncated": truncated,
        "ctxDisagreed": decision["escalation_reason"] == V.CONTEXT_DISAGREEMENT,
    }


def g2_counts(decision, flagged: Column, grounded: Column, truncated: Column) -> dict[str, Column]:
    d = decision["disposition"]
    return {
        "seen": ~flagged,
        "corroborates": ~flagged & (d == V.DECIDED),
        "forwarded": flagged | (d == V.FORWARD),
        "grounded": ~flagged & grounded,
        "flaggedPassThrough": flagged,
        "truncated": ~flagged & truncated,
    }


def g3_counts(decision, truncated: Column) -> dict[str, Column]:
    d = decision["disposition"]
    return {
        "seen": F.lit(True),
        "neutral": d == V.DECIDED,
        "humanRouted": d == V.ROUTE_HUMAN,
        "escalated": d == V.ESCALATE_G4,
        "truncated": truncated,
    }


# --- single gates ---------------------------------------------------------------------


def _has(nli: Column, *names: str) -> Column:
    present = F.lit(True)
    for name in names:
        present = present & nli[name].isNotNull()
    return F.coalesce(present, F.lit(False))


def run_g1(
    state: DataFrame, scores: DataFrame, runs: DataFrame, *, on_missing: str = "fail"
) -> GateResult:
    """Neutral and repeated pairs leave; ``scores(pair_id, g1)``."""
    rows = _frame(state, V.G1, runs).join(scores.select("pair_id", "g1"), "pair_id", "left")
    g1 = F.col("g1")
    decided, decision = _decide(rows, "g1", D.g1_features(g1))
    judged, following, rejects = _settle(
        decided, state, _has(g1, "fwd", "bwd"), R.route_g1(decision), "no first-gate scores for pair", on_missing
    )
    edges = E.edge_updates(
        judged, method=V.METHOD_G1, slot=("g1", S.g1_slot(g1)), relation=decision["verdict"],
        escalation_reason=decision["escalation_reason"], truncated=D.g1_truncated(g1),
        attempt=F.col("run.attempt"), judge_model=F.col("run.g1_model"),
        mode=F.col("run.judge_mode"), seq=1,
    )
    return GateResult(
        following, edges, _counters(judged, g1_counts(decision, D.g1_truncated(g1))), rejects
    )


def _decide(
    rows: DataFrame, gate: str, features: dict[str, Column]
) -> tuple[DataFrame, dict[str, Column]]:
    """Rows with features and decision as flat columns, and the decision's columns."""
    staged = D.with_columns(rows, "_f_", features)
    judged = D.with_decision(staged, gate, D.prefixed("_f_", features), _thresholds())
    return judged, D.decision_columns(gate)


def _ungrounded_if_off(scores: DataFrame) -> tuple[Column, Column, Column]:
    """(scores the rule sees, both grounded orientations), nothing grounded when OFF."""
    on = F.col("run.grounding_mode") != "OFF"
    fwd = F.when(on, F.col("grounded_fwd"))
    bwd = F.when(on, F.col("grounded_bwd"))
    seen = struct_of({
        "fwd": F.col("g2.fwd"), "bwd": F.col("g2.bwd"), "grounded": S.stronger_grounding(fwd, bwd),
    })
    return seen, fwd, bwd


def run_g2(
    state: DataFrame, scores: DataFrame, runs: DataFrame, *, on_missing: str = "fail"
) -> GateResult:
    """Supported pairs leave; flagged ones pass without being judged.

    ``scores(pair_id, g2, grounded_fwd, grounded_bwd)`` is needed for unflagged
    pairs only. No score is stored for a pair this gate did not judge.
    """
    rows = _frame(state, V.G2, runs).join(
        scores.select("pair_id", "g2", "grounded_fwd", "grounded_bwd"), "pair_id", "left"
    )
    flagged = F.coalesce("contradiction_flag", F.lit(False))
    seen, fwd, bwd = _ungrounded_if_off(scores)
    staged = rows.withColumns({"seen": seen, "gf": fwd, "gb": bwd})
    decided, decision = _decide(staged, "g2", D.g2_features(F.col("seen")))
    route = R.choose(flagged, R.pass_g2(flagged), R.route_g2(decision, flagged))
    judged, following, rejects = _settle(
        decided, state, flagged | _has(F.col("g2"), "fwd", "bwd"), route, "no second-gate scores for pair", on_missing
    )
    truncated = D.g2_truncated(F.col("seen"))
    edges = E.edge_updates(
        judged.where(~flagged), method=V.METHOD_G2,
        slot=("g2", S.g2_slot(F.col("seen"), F.col("gf"), F.col("gb"))),
        relation=decision["verdict"], confidence=decision["confidence"], truncated=truncated,
        attempt=F.col("run.attempt"), judge_model=F.col("run.g2_model"),
        mode=F.col("run.judge_mode"), seq=2,
    )
    counts = g2_counts(decision, flagged, F.col("seen.grounded").isNotNull(), truncated)
    return GateResult(following, edges, _counters(judged, counts), rejects)


def run_g3(
    state: DataFrame, edges: DataFrame, scores: DataFrame, runs: DataFrame, *,
    on_missing: str = "fail",
) -> GateResult:
    """Cross-check of two families; the first one is read back from the verdict rows.

    A pair without a stored first family is never scored again here.
    """
    rows = E.read_family_a(_frame(state, V.G3, runs), edges).join(
        scores.select("pair_id", "g3"), "pair_id", "left"
    )
    usable = F.col("family_a").isNotNull() & _has(F.col("g3"), "fwd", "bwd")
    one, three = D.g1_features(F.col("family_a")), D.g3_features(F.col("g3"))
    features = {
        "a_contra": one["a_contra"], "b_contra": three["b_contra"],
        "leans": one["a_leans"] & three["b_leans"],
    }
    decided, decision = _decide(rows, "g3", features)
    judged, following, rejects = _settle(
        decided, state, usable, R.route_g3(decision, F.col("contradiction_flag")),
        "no scores to cross-check for pair", on_missing,
    )
    # The stored first family does not carry its truncation, so only the second counts.
    truncated = D.family_b_truncated(F.col("g3"))
    updates = E.edge_updates(
        judged, method=V.METHOD_G3, slot=("g3", S.g3_slot(F.col("g3"))),
        relation=R.edge_relation_g3(decision), confidence=decision["confidence"],
        escalation_reason=decision["escalation_reason"], truncated=truncated,
        attempt=F.col("run.attempt"), judge_model=F.col("run.g3_model"),
        mode=F.col("run.judge_mode"), seq=3,
    )
    return GateResult(
        following, updates, _counters(judged, g3_counts(decision, truncated)), rejects
    )


def tail_frame(state: DataFrame, runs: DataFrame, spent: DataFrame | None) -> DataFrame:
    """Pairs at the tail; ``_here`` those whose run is part of the job, ``called`` those within budget.

    What a run has left is the cap less the calls of earlier attempts: ``spent(stage3_run_id,
    spent)``, or counted from the pair table. A run without a cap is not ranked at all.
    """
    settled = T.spent_per_run(state) if spent is None else spent
    cap = F.col("run.tail.max_llm_pairs")
    left = F.greatest(cap - F.coalesce("spent", F.lit(0)), F.lit(0))
    shadow = F.col("run.judge_mode") == V.MODE_SHADOW
    budgets = runs.join(settled, "stage3_run_id", "left").select(
        "stage3_run_id", "run", F.when(shadow, F.lit(0)).otherwise(F.when(cap > 0, left)).cast("long").alias("budget")
    )
    waiting = state.where(F.col("gate") == V.G4)
    limits = budget_limits(waiting, budgets.select("stage3_run_id", "budget"), "stage3_run_id", ["rank", "pair_id"])
    known = budgets.join(limits, "stage3_run_id", "left")
    rows = waiting.join(known, "stage3_run_id", "left").withColumn("_here", F.col("run").isNotNull())
    called = F.col("_here") & within_budget("budget", ["rank", "pair_id"])
    return rows.withColumn("called", F.coalesce(called, F.lit(False))).drop("budget", "_last")


def tail_calls(
    state: DataFrame, runs: DataFrame, spent: DataFrame | None = None, *, frame: DataFrame | None = None
) -> DataFrame:
    """Pairs at the tail with ``called``: within budget, and not in SHADOW mode."""
    rows = tail_frame(state, runs, spent) if frame is None else frame
    return staged_where(rows, F.col("_here")).drop("_here")


def tail_prompts(calls: DataFrame, cards: DataFrame, rubric: str) -> DataFrame:
    """(pair_id, prompt) of the pairs that are called; a missing card stops the job."""
    called = H.require_text(H.hydrate(calls.where("called"), cards))
    return called.select(
        "pair_id",
        judge_prompt(F.col("a"), F.col("b"), F.lit(rubric), "with_context").alias("prompt"),
    )


def run_g4(
    state: DataFrame, answers: DataFrame, runs: DataFrame, *, live: bool, spent: DataFrame | None = None,
    frame: DataFrame | None = None,
) -> GateResult:
    """The tail: settled by an answer, or left to a human with the reason.

    ``answers(pair_id, answer, prompt_tokens, output_tokens, error)``. A deciding
    run refuses answers that are not ``live`` before anything is written. Pass ``frame``
    (``tail_frame``, written) where the prompts were made of it.
    """
    frame = tail_frame(state, runs, spent) if frame is None else frame
    shadow = F.col("run.judge_mode") == V.MODE_SHADOW
    usable = F.lit(True) if live else F.coalesce(shadow, F.lit(False))
    staged = T.judge_answers(frame, answers).withColumn(
        "outcome", F.when(F.col("_here"), F.when(shadow, V.MODE_SHADOW).otherwise(F.col("outcome")))
    )
    outcome, parsed = F.col("outcome"), F.col("parsed")
    judged, following, _ = _settle(
        staged, state, usable, R.route_g4(outcome, F.col("contradiction_flag")),
        "a deciding run must not be settled by dry-run answers", "fail",
    )
    settled = outcome == V.DECIDED

    def if_settled(name: str) -> Column:
        return F.when(settled, parsed[name])

    edges = E.edge_updates(
        judged, method=V.METHOD_G4, slot=None, relation=if_settled("relation"),
        confidence=if_settled("confidence"),
        escalation_reason=F.when(outcome.isin(V.CAP_EXCEEDED, V.LLM_ERROR), outcome),
        rationale=if_settled("rationale"), temporal_note=if_settled("temporal_note"),
        shadow_verdict=F.when(outcome == V.MODE_SHADOW, F.lit(V.WOULD_ESCALATE)),
        attempt=F.col("run.attempt"), judge_model=F.col("run.tail.llm_model"),
        mode=F.col("run.judge_mode"), seq=4,
    )
    # The tail is a few percent: the rest is passed by, not joined with answers.
    elsewhere = state.where(F.coalesce(F.col("gate") != V.G4, F.lit(True)))
    return GateResult(elsewhere.unionByName(following), edges, T.tail_counters(judged, ["stage3_run_id"]))


# --- the fused job --------------------------------------------------------------------


def judge_pairs(
    state: DataFrame, scores: DataFrame, runs: DataFrame, *, on_missing: str = "fail"
) -> tuple[GateResult, dict[str, DataFrame]]:
    """The first three gates over every pair at the start, in one projection.

    Same results as gate after gate (the tests compare them), but pairs are read,
    joined and routed once, and each verdict row is emitted finished instead of
    being merged three times. Returns the result and the counters per gate.
    """
    rows = _frame(state, V.G1, runs).join(
        scores.select("pair_id", "g1", "g2", "g3", "grounded_fwd", "grounded_bwd"),
        "pair_id", "left",
    )
    g1, g2, g3 = F.col("g1"), F.col("g2"), F.col("g3")
    usable = F.coalesce(D.scores_complete(g1, g2, g3), F.lit(False))
    seen, fwd, bwd = _ungrounded_if_off(scores)
    features = D.cascade_features(g1, F.col("seen"), g3)
    staged = D.with_columns(
        rows.withColumns({"seen": seen, "gf": fwd, "gb": bwd}), "_f_", features
    )
    for gate in ("g1", "g2", "g3"):
        staged = D.with_decision(staged, gate, D.prefixed("_f_", features), _thresholds())
    d1, d2, d3 = (D.decision_columns(gate) for gate in ("g1", "g2", "g3"))
    flag = d1["contradiction_flag"]
    at_g1_done = d1["disposition"] == V.FORWARD
    decided = staged.withColumns({
        "_past_g1": at_g1_done,
        "_judged_g2": at_g1_done & ~flag,
        "_past_g2": at_g1_done & (flag | (d2["disposition"] == V.FORWARD)),
    })
    past_g1, judged_g2, past_g2 = (F.col(n) for n in ("_past_g1", "_judged_g2", "_past_g2"))
    first, second = R.route_g1(d1), R.route_g2(d2, flag)
    route = R.choose(past_g2, R.route_g3(d3, flag), R.choose(judged_g2, second, first))
    judged, following, rejects = _settle(
        decided, state, usable, route, "no complete scores for pair", on_missing
    )

    def last(one: Column, two: Column, three: Column) -> Column:
        """Value of the last gate that judged the pair."""
        return F.when(past_g2, three).when(judged_g2, two).otherwise(one)

    nothing = F.lit(None)
    slots = {
        "g1": S.g1_slot(g1),
        "g2": F.when(judged_g2, S.g2_slot(F.col("seen"), F.col("gf"), F.col("gb"))),
        "g3": F.when(past_g2, S.g3_slot(g3)),
    }
    base = E.edge_updates(
        judged, method=V.METHOD_G1, slot=None,
        relation=last(d1["verdict"], d2["verdict"], R.edge_relation_g3(d3)),
        confidence=last(nothing.cast("double"), d2["confidence"], d3["confidence"]),
        escalation_reason=last(
            d1["escalation_reason"], nothing.cast("string"), d3["escalation_reason"]
        ),
        truncated=last(
            D.g1_truncated(g1), D.g2_truncated(F.col("seen")),
            D.family_b_truncated(g3),
        ),
        attempt=F.col("run.attempt"),
        judge_model=last(F.col("run.g1_model"), F.col("run.g2_model"), F.col("run.g3_model")),
        mode=F.col("run.judge_mode"), seq=3,
        scores=E.stage_scores(slots),
        method_column=last(F.lit(V.METHOD_G1), F.lit(V.METHOD_G2), F.lit(V.METHOD_G3)),
    )
    grounded = F.col("seen.grounded").isNotNull()
    counts = {
        V.G1: (F.lit(True), g1_counts(d1, D.g1_truncated(g1))),
        V.G2: (past_g1, g2_counts(d2, flag, grounded, D.g2_truncated(F.col("seen")))),
        V.G3: (past_g2, g3_counts(d3, D.family_b_truncated(g3))),
    }
    # One aggregate holds the counters of all gates; a gate no pair of a run reached has no row.
    once = judged.groupBy("stage3_run_id").agg(*[
        count_if(reached & condition).alias(f"{gate}_{name}")
        for gate, (reached, conditions) in counts.items()
        for name, condition in {"_reached": F.lit(True), **conditions}.items()
    ])
    counters = {
        gate: once.where(F.col(f"{gate}__reached") > 0).select(
            "stage3_run_id", *[F.col(f"{gate}_{name}").alias(name) for name in conditions]
        )
        for gate, (_, conditions) in counts.items()
    }
    every = [(gate, name, f"{gate}_{name}", f"{gate}__reached") for gate, (_, names) in counts.items() for name in names]
    return GateResult(following, base, counters[V.G1], rejects, long_counters(once, every)), counters


RUNNERS = {V.G1: run_g1, V.G2: run_g2, V.G3: run_g3, V.G4: run_g4}


def register(gate: str, runner, registry: dict | None = None) -> None:
    """Replace the job of a gate; unknown gates are refused."""
    if gate not in V.GATES:
        raise ValueError(f"unknown gate {gate!r}; known: {list(V.GATES)}")
    (RUNNERS if registry is None else registry)[gate] = runner


def runner_for(gate: str, registry: dict | None = None):
    known = RUNNERS if registry is None else registry
    if gate not in known:
        raise ValueError(f"no job registered for gate {gate!r}")
    return known[gate]
