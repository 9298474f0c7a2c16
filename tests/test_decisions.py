import itertools
import random

import pytest
from pyspark.sql import functions as F

from helpers import CONTRADICTORY, NEUTRAL, REPEATS, UNDECIDED, cascade, score_table, scores
from verdictflow.functions import decisions as D

THRESHOLDS = D.Thresholds()


def run(spark, rows, thresholds=THRESHOLDS):
    f = D.cascade_features(F.col("g1"), F.col("g2"), F.col("g3"))
    table = D.with_columns(score_table(spark, rows), "f_", f)
    judged = D.with_cascade(table, D.prefixed("f_", f), thresholds)
    return {r["pair_id"]: r for r in judged.collect()}


CASES = [
    (scores("neutral", NEUTRAL), "G1_NEUTRAL", "DECIDED", "NEUTRAL"),
    (scores("repeats", REPEATS), "G1_NEUTRAL", "DECIDED", "REPEATS"),
    (scores("one-sided", NEUTRAL, UNDECIDED), "G3_CONTRADICTION", "ESCALATE_G4", None),
    # exactly at the escape is no flag, just above is one, either direction counts
    (scores("at-escape", (0.01, 0.97, 0.02)), "G1_NEUTRAL", "DECIDED", "NEUTRAL"),
    (scores("above-escape", (0.01, 0.968, 0.021), b=(0.0, 0.9, 0.05)), "G3_CONTRADICTION", "DECIDED", "NEUTRAL"),
    (scores("backward-only", NEUTRAL, (0.01, 0.90, 0.09), b=CONTRADICTORY), "G3_CONTRADICTION", "ESCALATE_G4", None),
    # context moves a neutral pair; the flag outranks that
    (scores("context", NEUTRAL, ctx=(0.55, 0.44, 0.01)), "G1_NEUTRAL", "ESCALATE_G4", None),
    (scores("flag-first", CONTRADICTORY, ctx=NEUTRAL, b=CONTRADICTORY), "G3_CONTRADICTION", "ROUTE_HUMAN", None),
    (scores("one-context", NEUTRAL, ctx=((0.55, 0.44, 0.01), None)), "G1_NEUTRAL", "DECIDED", "NEUTRAL"),
    (scores("both-undecided", UNDECIDED, ctx=UNDECIDED, sup=(0.95, 0.1, None)), "G2_CORROBORATION", "DECIDED", "CORROBORATES"),
    (scores("inclusive", UNDECIDED, sup=(0.1, 0.90, None)), "G2_CORROBORATION", "DECIDED", "CORROBORATES"),
    # a flagged pair reaches the cross-check whatever its support
    (scores("flagged-support", CONTRADICTORY, sup=(0.99, 0.99, 0.99), b=NEUTRAL), "G3_CONTRADICTION", "ESCALATE_G4", None),
    # consensus is strict, and one entailing direction prevents it
    (scores("strict", (0.0, 0.90, 0.10), b=NEUTRAL), "G3_CONTRADICTION", "ESCALATE_G4", None),
    (scores("leaning", (0.6, 0.35, 0.05), NEUTRAL, b=NEUTRAL), "G3_CONTRADICTION", "ESCALATE_G4", None),
]


def test_hand_cases(spark):
    found = run(spark, [case[0] for case in CASES])
    for row, gate, disposition, verdict in CASES:
        got = found[row[0]]
        assert (got["gate"], got["disposition"], got["verdict"]) == (gate, disposition, verdict), row[0]


def test_direction_and_confidence(spark):
    found = run(spark, [
        scores("bwd", sup=(0.40, 0.94, None)),
        scores("grounded", sup=(0.40, 0.50, 0.97)),
        scores("tie", sup=(0.95, 0.95, None)),
        scores("tie3", sup=(0.95, 0.95, 0.95)),
        scores("human", (0.02, 0.08, 0.90), b=(0.02, 0.10, 0.88)),
    ])
    assert (found["bwd"]["direction"], found["bwd"]["confidence"]) == ("BACKWARD", 0.94)
    assert found["grounded"]["direction"] == "GROUNDED"
    assert found["tie"]["direction"] == "FORWARD" and found["tie3"]["direction"] == "GROUNDED"
    assert found["human"]["confidence"] == 0.88 and found["human"]["contradiction_flag"]


@pytest.mark.parametrize("seed", [1, 2])
def test_agrees_with_plain_python(spark, seed):
    rng = random.Random(seed)
    levels = (0.0, 0.01, 0.02, 0.021, 0.05, 0.1, 0.5, 0.85, 0.9, 0.95, 1.0)

    def any_nli():
        return tuple(rng.choice(levels) for _ in range(3))

    rows = []
    for n in range(600):
        ctx = rng.choice([None, (any_nli(), any_nli()), (any_nli(), None)])
        sup = (rng.choice(levels), rng.choice(levels), rng.choice([None, rng.choice(levels)]))
        calm = rng.random() < 0.6
        pick = (lambda: (rng.choice(levels), rng.choice(levels), rng.choice((0.0, 0.01, 0.02)))) if calm else any_nli
        rows.append(scores(str(n), pick(), pick(), ctx, sup, any_nli(), any_nli()))
    t = D.Thresholds(contra_min=0.5, neutral_consensus=0.5)
    found = run(spark, rows, t)
    for row in rows:
        got = found[row[0]]
        assert (
            got["gate"], got["disposition"], got["verdict"], got["confidence"], got["contradiction_flag"],
        ) == cascade(row, t)
    assert len({r["disposition"] for r in found.values()}) == 3


def test_cross_check_never_decides_a_contradiction(spark):
    rows = [
        scores(f"{a}-{b}", (0.0, 1 - a, a), b=(0.0, 1 - b, b))
        for a, b in itertools.product((0.05, 0.3, 0.6, 0.85, 0.99), repeat=2)
    ]
    assert all(r["verdict"] != "CONTRADICTS" for r in run(spark, rows).values())


def test_struct_form_matches_column_form(spark):
    rows = [case[0] for case in CASES]
    f = D.cascade_features(F.col("g1"), F.col("g2"), F.col("g3"))
    table = score_table(spark, rows)
    one = {r["pair_id"]: r["d"]["disposition"] for r in table.withColumn("d", D.decide_g1(f)).collect()}
    assert one["neutral"] == "DECIDED" and one["context"] == "ESCALATE_G4" and one["flag-first"] == "FORWARD"


def test_incomplete_and_nan_scores_are_refused(spark):
    rows = [
        scores("ok", NEUTRAL), scores("nan", (float("nan"), 0.9, 0.0)), scores("no-support", sup=(None, 0.1, None)),
    ]
    usable = D.scores_complete(F.col("g1"), F.col("g2"), F.col("g3"))
    kept = score_table(spark, rows).where(usable).select("pair_id").collect()
    assert [r[0] for r in kept] == ["ok"]
