"""Scored pairs by hand, and plain Python versions of the rules to compare with."""

from __future__ import annotations

from verdictflow import schemas

NEUTRAL = (0.02, 0.97, 0.01)
REPEATS = (0.95, 0.04, 0.01)
CONTRADICTORY = (0.02, 0.10, 0.88)
UNDECIDED = (0.50, 0.49, 0.01)


def nli(values, truncated=False):
    return None if values is None else (*values, truncated)


def support(value, truncated=False):
    return None if value is None else (value, truncated)


def scores(pair_id, fwd=UNDECIDED, bwd=None, ctx=None, sup=(0.1, 0.1, None), b=NEUTRAL, b_bwd=None):
    """A row of pair scores; one-sided arguments count for both directions."""
    bwd = fwd if bwd is None else bwd
    ctx = (ctx, ctx) if ctx is None or isinstance(ctx[0], float) else ctx
    return (
        pair_id,
        (nli(fwd), nli(bwd), nli(ctx[0]), nli(ctx[1])),
        (support(sup[0]), support(sup[1]), support(sup[2])),
        (nli(b), nli(b if b_bwd is None else b_bwd)),
    )


def score_table(spark, rows):
    return spark.createDataFrame(rows, schemas.PAIR_SCORES)


def cascade(row, t):
    """The rules in plain Python: (gate, disposition, verdict, confidence, flag)."""
    _, (fwd, bwd, cf, cb), (sf, sb, sg), (bf, bb) = row

    def bare(x, y):
        if x[1] >= t.neutral_min and y[1] >= t.neutral_min:
            return "NEUTRAL"
        if x[0] >= t.repeat_min and y[0] >= t.repeat_min:
            return "REPEATS"
        return None

    a = max(fwd[2], bwd[2])
    flag = a > t.contra_escape
    if not flag:
        outcome = bare(fwd, bwd)
        if cf and cb and bare(cf, cb) != outcome:
            return ("G1_NEUTRAL", "ESCALATE_G4", None, None, False)
        if outcome:
            return ("G1_NEUTRAL", "DECIDED", outcome, None, False)
        best = max(x[0] for x in (sf, sb, sg) if x)
        if best >= t.support_min:
            return ("G2_CORROBORATION", "DECIDED", "CORROBORATES", best, False)
    b = max(bf[2], bb[2])
    if a >= t.contra_min and b >= t.contra_min:
        return ("G3_CONTRADICTION", "ROUTE_HUMAN", None, min(a, b), True)
    leans = all(x[1] >= x[0] and x[1] >= x[2] for x in (fwd, bwd, bf, bb))
    if a < t.neutral_consensus and b < t.neutral_consensus and leans:
        return ("G3_CONTRADICTION", "DECIDED", "NEUTRAL", None, flag)
    return ("G3_CONTRADICTION", "ESCALATE_G4", None, None, flag)
