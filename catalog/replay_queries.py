"""Replay of scored pairs: metrics, sweeps, grids, reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import inputs as I
from catalog.registry import query
from verdictflow import vocab as V
from verdictflow.functions import decisions as D
from verdictflow.operators import metrics as M
from verdictflow.plans import replay as RP, reports

# The grid of 6 x 4 x 4 cells.
GRID = {
    "contraEscape": (0.02, 0.05, 0.1, 0.2, 0.3, 0.5),
    "neutralMin": (0.80, 0.85, 0.90, 0.95),
    "neutralConsensus": (0.05, 0.1, 0.2, 0.4),
}
SWEEPS = {
    "contraEscape": (0.02, 0.05, 0.1, 0.2, 0.3, 0.5),
    "supportMin": (0.5, 0.7, 0.9, 0.99),
    "contraMin": (0.5, 0.85),
}
# Synthetic scores cannot meet the real bar, so the choice is made against a lower one.
BAR = {
    "neutralPrecision": (">=", 0.5),
    "neutralCoverage": (">=", 0.3),
    "contradictsRecall": (">=", 0.6),
    "g4Share": ("<=", 0.5),
}

OUTCOMES_SQL = I.ROSTERS_SQL + ",\n" + I.cascade_sql("sr")

_COUNTS = """count(*) AS total,
    count(*) FILTER (disposition = 'DECIDED') AS decided,
    count(*) FILTER (disposition = 'ESCALATE_G4') AS to_g4,
    count(*) FILTER (disposition = 'ROUTE_HUMAN') AS to_human,
    count(*) FILTER (golden AND ensemble_verdict = 'CONTRADICTS') AS gold,
    count(*) FILTER (golden AND ensemble_verdict = 'CONTRADICTS' AND disposition <> 'DECIDED') AS kept,
    count(*) FILTER (verdict = 'NEUTRAL') AS pred_n,
    count(*) FILTER (verdict = 'NEUTRAL' AND ensemble_verdict = 'NEUTRAL') AS hit_n"""


def _div(a: str, b: str) -> str:
    return f"round(CASE WHEN {b} = 0 THEN 0.0 ELSE CAST({a} AS DOUBLE) / {b} END, 6)"


_REPORT = f"""{_div('pred_n', 'total')} AS coverage, {_div('hit_n', 'pred_n')} AS "precision",
  pred_n AS decided_neutral, {_div('decided', 'total')} AS decided_share,
  {_div('to_g4', 'total')} AS g4_share, {_div('to_human', 'total')} AS human_share,
  gold AS golden_contradictions, kept AS preserved, {_div('kept', 'gold')} AS contradicts_recall,
  gold - kept AS discarded"""


def features(spark, sf):
    return RP.pair_features(I.scored_pairs(spark, sf, I.ROSTERS))


def outcomes(spark, sf):
    return RP.replay(features(spark, sf))


def _counts(spark, sf):
    return M.outcome_counts(outcomes(spark, sf), ["roster"])


def _rounded(df, *names):
    return df.withColumns({name: F.round(name, 6) for name in names})


SHARES = ("coverage", "precision", "decided_share", "g4_share", "human_share", "contradicts_recall")


@query("replay", f"""WITH {OUTCOMES_SQL}
SELECT roster, pair_id, at_gate AS gate, disposition, coalesce(verdict, '-') AS verdict,
  round(coalesce(confidence, -1), 6) AS confidence, ensemble_verdict, golden
FROM c""")
def replay(spark, sf):
    return outcomes(spark, sf).select(
        "roster", "pair_id", "gate", "disposition",
        F.coalesce("verdict", F.lit("-")).alias("verdict"),
        F.round(F.coalesce("confidence", F.lit(-1.0)), 6).alias("confidence"),
        "ensemble_verdict", "golden",
    )


@query("per_verdict", f"""WITH {OUTCOMES_SQL}, n AS (
  SELECT roster, v.label, count(*) FILTER (verdict = v.label AND ensemble_verdict = v.label) AS true_positives,
    count(*) FILTER (verdict = v.label) AS predicted,
    count(*) FILTER (ensemble_verdict = v.label) AS actual
  FROM c, (VALUES ('NEUTRAL'), ('REPEATS'), ('CORROBORATES')) v(label) GROUP BY ALL
), pr AS (
  SELECT *, CASE WHEN predicted = 0 THEN 0.0 ELSE CAST(true_positives AS DOUBLE) / predicted END AS pr,
    CASE WHEN actual = 0 THEN 0.0 ELSE CAST(true_positives AS DOUBLE) / actual END AS re FROM n
)
SELECT roster, label, true_positives, predicted, actual, round(pr, 6) AS "precision", round(re, 6) AS recall,
  round(CASE WHEN pr + re = 0 THEN 0.0 ELSE 2 * pr * re / (pr + re) END, 6) AS f1 FROM pr""")
def per_verdict(spark, sf):
    return _rounded(
        M.per_verdict_scores(_counts(spark, sf), ["roster"]), "precision", "recall", "f1"
    )


@query("neutral_summary", f"""WITH {OUTCOMES_SQL}, n AS (SELECT roster, {_COUNTS} FROM c GROUP BY roster)
SELECT roster, {_div('pred_n', 'total')} AS coverage, {_div('hit_n', 'pred_n')} AS "precision",
  pred_n AS decided_neutral FROM n""")
def neutral_summary(spark, sf):
    return _rounded(M.neutral_summary(_counts(spark, sf), ["roster"]), "coverage", "precision")


@query("funnel", f"""WITH {OUTCOMES_SQL}, n AS (SELECT roster, {_COUNTS} FROM c GROUP BY roster)
SELECT roster, total, {_div('decided', 'total')} AS decided_share, {_div('to_g4', 'total')} AS g4_share,
  {_div('to_human', 'total')} AS human_share,
  {_div('(total - decided - to_g4 - to_human)', 'total')} AS undecided_share FROM n""")
def funnel(spark, sf):
    return _rounded(
        M.volumes(_counts(spark, sf), ["roster"]),
        "decided_share", "g4_share", "human_share", "undecided_share",
    )


@query("contradicts_recall", f"""WITH {OUTCOMES_SQL}, n AS (SELECT roster, {_COUNTS} FROM c GROUP BY roster)
SELECT roster, gold AS golden_contradictions, kept AS preserved,
  {_div('kept', 'gold')} AS contradicts_recall, gold - kept AS discarded FROM n""")
def contradicts_recall(spark, sf):
    return _rounded(M.contradicts_recall(_counts(spark, sf), ["roster"]), "contradicts_recall")


@query("ece", f"""WITH {OUTCOMES_SQL}, b AS (
  SELECT roster, least(CAST(floor(confidence * 10) AS INTEGER), 9) AS bin, count(*) AS n,
    count(*) FILTER (ensemble_verdict = verdict) AS hits, sum(confidence) AS conf
  FROM c WHERE confidence IS NOT NULL AND verdict IS NOT NULL GROUP BY ALL
)
SELECT roster, round(sum(abs(hits - conf)) / sum(n), 6) AS ece, CAST(sum(n) AS BIGINT) AS samples,
  CAST(10 AS BIGINT) AS bins FROM b GROUP BY roster""")
def ece(spark, sf):
    return _rounded(M.calibration_error(outcomes(spark, sf), ["roster"]), "ece")


@query("go_bar", f"""WITH {OUTCOMES_SQL}, n AS (SELECT roster, {_COUNTS} FROM c GROUP BY roster), m AS (
  SELECT roster, {_REPORT} FROM n
), k AS (
  SELECT roster, 'neutralPrecision' AS criterion, "precision" AS observed, '>=' AS comparison, 0.95::DOUBLE AS required, true AS measurable, "precision" >= 0.95 AS met FROM m
  UNION ALL SELECT roster, 'neutralCoverage', coverage, '>=', 0.60, true, coverage >= 0.60 FROM m
  UNION ALL SELECT roster, 'contradictsRecall', contradicts_recall, '>=', 0.95, golden_contradictions > 0, contradicts_recall >= 0.95 FROM m
  UNION ALL SELECT roster, 'g4Share', g4_share, '<=', 0.05, true, g4_share <= 0.05 FROM m
)
SELECT k.*, bool_and(NOT measurable OR met) OVER (PARTITION BY roster) AS passed FROM k""")
def go_bar(spark, sf):
    return _rounded(M.evaluate_go_bar(_counts(spark, sf), ["roster"]), "observed")


def _values(name):
    return ", ".join(f"({i}, CAST({v} AS DOUBLE))" for i, v in enumerate(GRID[name]))


_CELLS = f"""cells AS (
  SELECT (a.i * 16 + b.i * 4 + c.i)::INTEGER AS cell, a.v AS "contraEscape", b.v AS "neutralMin", c.v AS "neutralConsensus"
  FROM (VALUES {_values('contraEscape')}) a(i, v), (VALUES {_values('neutralMin')}) b(i, v),
       (VALUES {_values('neutralConsensus')}) c(i, v)
), sc AS (SELECT sr.*, cells.* FROM sr, cells)"""

GRID_SQL = f"""{I.ROSTERS_SQL}, {_CELLS}, {I.cascade_sql(
    "sc", contra_escape='"contraEscape"', neutral_min='"neutralMin"',
    neutral_consensus='"neutralConsensus"')}, n AS (
  SELECT roster, cell, "contraEscape", "neutralMin", "neutralConsensus", {_COUNTS} FROM c GROUP BY ALL
), grid AS (
  SELECT roster, cell, "contraEscape", "neutralMin", "neutralConsensus", total, {_REPORT}, round(0.0, 6) + {_div('(total - decided - to_g4 - to_human)', 'total')} AS undecided_share,
    (CAST(hit_n AS DOUBLE) / greatest(pred_n, 1) >= 0.5 AND CAST(pred_n AS DOUBLE) / total >= 0.3
     AND (gold = 0 OR CAST(kept AS DOUBLE) / gold >= 0.6) AND CAST(to_g4 AS DOUBLE) / total <= 0.5) AS passed
  FROM n
)"""


def _grid(spark, sf):
    return RP.grid_search(features(spark, sf), GRID, bar=BAR)


@query("grid_search", f"WITH {GRID_SQL} SELECT * FROM grid")
def grid_search(spark, sf):
    return _rounded(_grid(spark, sf), *SHARES, "undecided_share")


# Every threshold an axis: 3 x 3 x 3 x 3 x 3 x 3 cells, some values out of order.
FINE = {
    "contraEscape": (0.05, 0.4, 0.1), "neutralMin": (0.5, 0.8, 0.95), "repeatMin": (0.9, 0.4, 0.7),
    "supportMin": (0.5, 0.7, 0.9), "contraMin": (0.85, 0.3, 0.5), "neutralConsensus": (0.05, 0.2, 0.4),
}


def _fine_sql() -> str:
    cells, stride, number = [], 3 ** len(FINE), []
    for axis, points in FINE.items():
        stride //= 3
        rows = ", ".join(f"({i}, CAST({v} AS DOUBLE))" for i, v in enumerate(points))
        cells.append(f'(VALUES {rows}) "_{axis}"(i, v)')
        number.append(f'"_{axis}".i * {stride}')
    names = ", ".join(f'"_{axis}".v AS "{axis}"' for axis in FINE)
    judged = I.cascade_sql("sc", **{V.SWEEPABLE[axis]: f'"{axis}"' for axis in FINE})
    return f"""WITH {I.ROSTERS_SQL}, cells AS (
  SELECT CAST({' + '.join(number)} AS INTEGER) AS cell, {names} FROM {', '.join(cells)}
), sc AS (SELECT sr.*, cells.* FROM sr, cells), {judged}, n AS (
  SELECT roster, cell, {_COUNTS} FROM c GROUP BY ALL
)
SELECT roster, cell, total, decided, to_g4, to_human, gold AS golden_contradictions, kept AS golden_preserved,
  pred_n AS pred_neutral, hit_n AS hit_neutral FROM n"""


@query("grid_every_axis", _fine_sql())
def grid_every_axis(spark, sf):
    """Counts of every cell of a grid over all thresholds, by prefix sums over boxes."""
    return RP.grid_counts(features(spark, sf), FINE).select(
        "roster", "cell", "total", "decided", "to_g4", "to_human", "golden_contradictions", "golden_preserved",
        "pred_neutral", "hit_neutral",
    )


_BEST_SQL = f"""{GRID_SQL}, ranked AS (
  SELECT *, row_number() OVER (PARTITION BY roster ORDER BY coverage DESC, g4_share, cell) AS place
  FROM grid WHERE passed
)"""


@query("best_cell", f"""WITH {_BEST_SQL}
SELECT roster, cell, "contraEscape", "neutralMin", "neutralConsensus", coverage, "precision", g4_share
FROM ranked WHERE place = 1""")
def best_cell(spark, sf):
    best = RP.best_cell(_rounded(_grid(spark, sf), "coverage", "g4_share", "precision"))
    return best.select(
        "roster", "cell", *GRID, "coverage", "precision", "g4_share"
    )


def _rosters(spark, sf):
    """The roster list as a table, in listed order, as far as pairs were scored."""
    order = F.array_position(F.array(*[F.lit(name) for name in I.ROSTERS]), F.col("roster"))
    return I.scored_pairs(spark, sf, I.ROSTERS).select("roster").distinct().withColumn(
        "position", order.cast("int")
    )


@query("best_roster", f"""WITH {_BEST_SQL}
SELECT roster, coverage, g4_share FROM ranked WHERE place = 1
ORDER BY coverage DESC, g4_share, roster LIMIT 1""")
def best_roster(spark, sf):
    """Which roster to adopt: the single winner is the result."""
    tables = RP.build_report(features(spark, sf), _rosters(spark, sf), grid=GRID, bar=BAR)
    return _rounded(tables["winner"], "coverage", "g4_share").select(
        "roster", "coverage", "g4_share"
    )


@query("adopted_thresholds", f"""WITH {_BEST_SQL}
SELECT r.roster, place IS NOT NULL AS from_grid, coalesce("neutralMin", 0.95) AS neutral_min,
  0.9::DOUBLE AS repeat_min, coalesce("contraEscape", 0.02) AS contra_escape, 0.9::DOUBLE AS support_min,
  0.5::DOUBLE AS support_floor, 0.85::DOUBLE AS contra_min, coalesce("neutralConsensus", 0.1) AS neutral_consensus
FROM (SELECT DISTINCT roster FROM sr) r LEFT JOIN ranked ON ranked.roster = r.roster AND place = 1""")
def adopted_thresholds(spark, sf):
    best = RP.best_cell(_rounded(_grid(spark, sf), "coverage", "g4_share"))
    return RP.adopted_thresholds(best, _rosters(spark, sf), GRID)


_SWEEP_CELLS = " UNION ALL ".join(
    "SELECT '{0}' AS axis, CAST({1} AS DOUBLE) AS \"value\", CAST({2} AS DOUBLE) AS esc, "
    "CAST({3} AS DOUBLE) AS sup, CAST({4} AS DOUBLE) AS con".format(
        axis, value,
        value if axis == "contraEscape" else 0.02,
        value if axis == "supportMin" else 0.90,
        value if axis == "contraMin" else 0.85,
    )
    for axis, values in SWEEPS.items() for value in values
)


@query("coverage_curve", f"""WITH {I.ROSTERS_SQL}, cells AS ({_SWEEP_CELLS}),
sc AS (SELECT sr.*, cells.* FROM sr, cells), {I.cascade_sql(
    "sc", contra_escape="esc", support_min="sup", contra_min="con")}, n AS (
  SELECT roster, axis, "value", {_COUNTS} FROM c GROUP BY ALL
)
SELECT roster, axis, "value", {_div('pred_n', 'total')} AS coverage, {_div('hit_n', 'pred_n')} AS "precision",
  pred_n AS decided_neutral, {_div('to_g4', 'total')} AS g4_share, {_div('to_human', 'total')} AS human_share
FROM n""")
def coverage_curve(spark, sf):
    return _rounded(
        RP.sweep(features(spark, sf), SWEEPS), "coverage", "precision", "g4_share", "human_share"
    )


@query("label_scores", f"""WITH {I.SCORES_SQL}
SELECT pair_id, ensemble_verdict, golden, round(con_fwd, 6) AS contradiction
FROM s JOIN (SELECT doc_id FROM labels) l ON l.doc_id = s.b_doc""")
def label_scores(spark, sf):
    """Corpus records joined with their scores; unscored ones are dropped."""
    scored = I.scored_pairs(spark, sf)
    labelled = I.load(spark, sf, "labels").select(F.col("doc_id").alias("b_doc"))
    scores = scored.join(labelled, "b_doc", "left_semi").select("pair_id", "g1", "g2", "g3")
    corpus = scored.select("pair_id", "ensemble_verdict", "golden")
    return RP.label_scores(corpus, scores).select(
        "pair_id", "ensemble_verdict", "golden",
        F.round("g1.fwd.contradiction", 6).alias("contradiction"),
    )


def _facts_sql(part: str, items: dict[str, str], source: str, detail: str = "''") -> str:
    names = ", ".join(f"'{name}'" for name in items)
    values = ", ".join(f"CAST({value} AS DOUBLE)" for value in items.values())
    return f"SELECT roster, '{part}' AS part, {detail} AS detail, unnest([{names}]) AS item, unnest([{values}]) AS value FROM {source}"


_BAR_VALUES = {"neutralPrecision": "\"precision\"", "neutralCoverage": "coverage", "contradictsRecall": "contradicts_recall", "g4Share": "g4_share"}
_REPORT_FACTS = " UNION ALL ".join([
    _facts_sql("adopted", {
        "from_grid": "from_grid", "neutral_min": "nm", "repeat_min": "0.9", "contra_escape": "ce", "support_min": "0.9",
        "support_floor": "0.5", "contra_min": "0.85", "neutral_consensus": "nc",
    }, "adopted"),
    _facts_sql("grid", {"cells": "count(*)", "passing": "count(*) FILTER (passed)"}, "grid GROUP BY roster"),
    _facts_sql("volume", {n: n for n in ("total", "decided_share", "g4_share", "human_share")}, "m"),
    _facts_sql("neutral", {"coverage": "coverage", "precision": "\"precision\"", "decided_neutral": "decided_neutral"}, "m"),
    _facts_sql("golden", {n: n for n in ("golden_contradictions", "preserved", "discarded", "contradicts_recall")}, "m"),
    _facts_sql("verdict", {n: n for n in ("pr", "re", "f1", "predicted", "actual")}, "pv", "label").replace("'pr'", "'precision'").replace("'re'", "'recall'"),
    *[
        _facts_sql("bar", {"observed": value, "required": str(BAR[name][1]), "met": (
            f"CASE WHEN {'golden_contradictions > 0' if name == 'contradictsRecall' else 'true'} THEN {value} {BAR[name][0]} {BAR[name][1]} END"
        )}, "m", f"'{name}'")
        for name, value in _BAR_VALUES.items()
    ],
])


@query("report_text", f"""WITH {_BEST_SQL}, adopted AS (
  SELECT r.roster, place IS NOT NULL AS from_grid, coalesce("neutralMin", 0.95) AS nm, coalesce("contraEscape", 0.02) AS ce,
    coalesce("neutralConsensus", 0.1) AS nc
  FROM (SELECT DISTINCT roster FROM sr) r LEFT JOIN ranked ON ranked.roster = r.roster AND place = 1
), sw AS (SELECT sr.*, adopted.nm, adopted.ce, adopted.nc FROM sr JOIN adopted USING (roster)),
{I.cascade_sql("sw", neutral_min="nm", contra_escape="ce", neutral_consensus="nc")
   .replace("f AS (", "f2 AS (").replace("FROM f\n", "FROM f2\n").replace("c1 AS (", "e1 AS (")
   .replace("FROM c1\n", "FROM e1\n").replace("c2 AS (", "e2 AS (").replace("FROM c2\n", "FROM e2\n")
   .replace("), c AS (", "), e AS (")}, n2 AS (SELECT roster, {_COUNTS} FROM e GROUP BY roster),
m AS (SELECT roster, total, {_REPORT} FROM n2), nv AS (
  SELECT roster, v.label, count(*) FILTER (verdict = v.label AND ensemble_verdict = v.label) AS hits,
    count(*) FILTER (verdict = v.label) AS predicted, count(*) FILTER (ensemble_verdict = v.label) AS actual
  FROM e, (VALUES ('NEUTRAL'), ('REPEATS'), ('CORROBORATES')) v(label) GROUP BY ALL
), pw AS (
  SELECT *, CASE WHEN predicted = 0 THEN 0.0 ELSE CAST(hits AS DOUBLE) / predicted END AS pr,
    CASE WHEN actual = 0 THEN 0.0 ELSE CAST(hits AS DOUBLE) / actual END AS re FROM nv
), pv AS (SELECT *, CASE WHEN pr + re = 0 THEN 0.0 ELSE 2 * pr * re / (pr + re) END AS f1 FROM pw),
facts AS ({_REPORT_FACTS})
SELECT roster, part, item, detail, round(value, 6) AS value FROM facts WHERE value IS NOT NULL""")
def report_text(spark, sf):
    """The numbers of the report; calibration and sweeps have rows of their own (ece, report_sweeps)."""
    tables = RP.build_report(features(spark, sf), _rosters(spark, sf), grid=GRID, bar=BAR)
    facts = reports.report_facts(tables).where("part <> 'calibration'")
    return _rounded(facts, "value")


@query("report_sweeps", f"""WITH {_BEST_SQL}, adopted AS (
  SELECT r.roster, coalesce("neutralMin", 0.95) AS nm, coalesce("contraEscape", 0.02) AS ce,
    coalesce("neutralConsensus", 0.1) AS nc
  FROM (SELECT DISTINCT roster FROM sr) r LEFT JOIN ranked ON ranked.roster = r.roster AND place = 1
), axes AS (SELECT unnest([0.5, 0.7, 0.9]::DOUBLE[]) AS "value"),
sw AS (SELECT sr.*, adopted.nm, adopted.ce, adopted.nc, axes."value" FROM sr JOIN adopted USING (roster), axes),
{I.cascade_sql("sw", neutral_min="nm", contra_escape="ce", neutral_consensus="nc", support_min='"value"')
   .replace("f AS (", "f2 AS (").replace("FROM f\n", "FROM f2\n").replace("c1 AS (", "e1 AS (")
   .replace("FROM c1\n", "FROM e1\n").replace("c2 AS (", "e2 AS (").replace("FROM c2\n", "FROM e2\n")
   .replace("), c AS (", "), e AS (")}, n2 AS (
  SELECT roster, "value", {_COUNTS} FROM e GROUP BY ALL
)
SELECT roster, 'supportMin' AS axis, "value", {_div('pred_n', 'total')} AS coverage,
  {_div('hit_n', 'pred_n')} AS "precision", pred_n AS decided_neutral,
  {_div('to_g4', 'total')} AS g4_share, {_div('to_human', 'total')} AS human_share
FROM n2""")
def report_sweeps(spark, sf):
    """Curves around each roster's adopted thresholds, which are data here."""
    tables = RP.build_report(
        features(spark, sf), _rosters(spark, sf), grid=GRID,
        sweeps={"supportMin": (0.5, 0.7, 0.9)}, bar=BAR, base=D.Thresholds(),
    )
    return _rounded(tables["sweeps"], "coverage", "precision", "g4_share", "human_share")
