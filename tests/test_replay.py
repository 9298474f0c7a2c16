import itertools
import math
import random
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from helpers import CONTRADICTORY, NEUTRAL, UNDECIDED, cascade, score_table, scores
from verdictflow import vocab as V
from verdictflow.functions import decisions as D
from verdictflow.operators import metrics as M
from verdictflow.plans import replay as RP

OUTCOMES = "pair_id string, disposition string, verdict string, ensemble_verdict string, golden boolean, confidence double"


def outcomes(spark, *groups):
    rows = []
    for n, disposition, verdict, label, golden, confidence in groups:
        rows += [(str(len(rows) + i), disposition, verdict, label, golden, confidence) for i in range(n)]
    return spark.createDataFrame(rows, OUTCOMES)


GOOD = (
    (70, "DECIDED", "NEUTRAL", "NEUTRAL", False, None),
    (10, "ROUTE_HUMAN", None, "CONTRADICTS", True, None),
    (20, "DECIDED", "CORROBORATES", "CORROBORATES", False, 0.95),
)


def bar(spark, *groups):
    table = M.evaluate_go_bar(M.outcome_counts(outcomes(spark, *groups)))
    return {r["criterion"]: r for r in table.collect()}


def test_go_bar(spark):
    assert all(r["passed"] and r["met"] for r in bar(spark, *GOOD).values())
    low = bar(spark, (70, "DECIDED", "NEUTRAL", "REPEATS", False, None), *GOOD[1:])
    assert not low["neutralPrecision"]["met"] and not low["g4Share"]["passed"]
    lost = bar(spark, GOOD[0], (10, "DECIDED", "NEUTRAL", "CONTRADICTS", True, None), GOOD[2])
    assert not lost["contradictsRecall"]["met"]
    open_ = bar(spark, GOOD[0], GOOD[2])
    assert not open_["contradictsRecall"]["measurable"] and open_["contradictsRecall"]["passed"]


def test_per_verdict_and_recall(spark):
    counts = M.outcome_counts(outcomes(
        spark,
        (2, "DECIDED", "NEUTRAL", "NEUTRAL", False, None),
        (1, "DECIDED", "NEUTRAL", "REPEATS", False, None),
        (1, "ESCALATE_G4", None, "NEUTRAL", False, None),
        (1, "ESCALATE_G4", None, "CONTRADICTS", True, None),
        (1, "DECIDED", "NEUTRAL", "CONTRADICTS", False, None),
    ))
    neutral = {r["label"]: r for r in M.per_verdict_scores(counts).collect()}["NEUTRAL"]
    assert (neutral["true_positives"], neutral["predicted"], neutral["actual"]) == (2, 4, 3)
    assert neutral["precision"] == 0.5 and neutral["recall"] == pytest.approx(2 / 3)
    recall = M.contradicts_recall(counts).head()
    assert (recall["golden_contradictions"], recall["preserved"], recall["contradicts_recall"]) == (1, 1, 1.0)


def test_empty_corpus_measures_zero(spark):
    counts = M.outcome_counts(outcomes(spark))
    assert M.volumes(counts).head()["decided_share"] == 0.0
    assert M.neutral_summary(counts).head()["precision"] == 0.0
    assert M.calibration_error(outcomes(spark)).head()["samples"] == 0


def test_calibration(spark):
    def ece(*groups):
        return M.calibration_error(outcomes(spark, *groups)).head()

    good = ece(
        (19, "DECIDED", "CORROBORATES", "CORROBORATES", False, 0.95),
        (1, "DECIDED", "CORROBORATES", "NEUTRAL", False, 0.95),
    )
    assert good["ece"] == pytest.approx(0.0, abs=1e-9) and good["samples"] == 20
    assert ece((10, "DECIDED", "CORROBORATES", "NEUTRAL", False, 0.99))["ece"] > 0.9
    assert ece((5, "ROUTE_HUMAN", None, "NEUTRAL", False, 0.9))["samples"] == 0
    odd = ece(
        (1, "DECIDED", "CORROBORATES", "CORROBORATES", False, 1.0),
        (1, "DECIDED", "CORROBORATES", "CORROBORATES", False, 1.7),
    )
    assert odd["samples"] == 2 and odd["ece"] == pytest.approx(0.0)


def labelled(spark, n=400, seed=3):
    rng = random.Random(seed)
    levels = [x / 20 for x in range(21)]

    def any_nli():
        return (rng.choice(levels), rng.choice(levels), rng.choice([0.0, 0.02, 0.05, 0.1, 0.3, 0.9]))

    rows, labels = [], []
    for i in range(n):
        ctx = (any_nli(), any_nli()) if rng.random() < 0.2 else None
        sup = (rng.choice(levels), rng.choice(levels), rng.choice([None, 0.9]))
        rows.append(scores(str(i), any_nli(), any_nli(), ctx, sup, any_nli(), any_nli()))
        labels.append((str(i), rng.choice([*V.VERDICTS, "ODD"]), rng.random() < 0.4))
    table = score_table(spark, rows).withColumn("roster", F.lit("r")).join(
        spark.createDataFrame(labels, "pair_id string, ensemble_verdict string, golden boolean"), "pair_id"
    )
    return rows, labels, RP.pair_features(table)


AXES = {"contraEscape": (0.02, 0.1, 0.05), "neutralMin": (0.5, 0.9), "supportMin": (0.9, 0.5)}


def test_grid_equals_brute_force(spark):
    rows, labels, features = labelled(spark)
    grid = {r["cell"]: r for r in RP.grid_search(features, AXES).collect()}
    assert len(grid) == 12
    for cell, combo in enumerate(itertools.product(*AXES.values())):
        t = replace(D.Thresholds(), **{V.SWEEPABLE[a]: v for a, v in zip(AXES, combo)})
        judged = [(cascade(r, t), l) for r, l in zip(rows, labels)]
        got = grid[cell]
        assert tuple(got[a] for a in AXES) == combo
        neutral = [l for o, l in judged if o[2] == "NEUTRAL"]
        assert got["total"] == len(rows) and got["decided_neutral"] == len(neutral)
        assert got["g4_share"] == pytest.approx(sum(o[1] == "ESCALATE_G4" for o, _ in judged) / len(rows))
        assert got["precision"] == pytest.approx(sum(l[1] == "NEUTRAL" for l in neutral) / max(len(neutral), 1))
        golden = [o for o, l in judged if l[2] and l[1] == "CONTRADICTS"]
        assert got["golden_contradictions"] == len(golden)
        assert got["preserved"] == sum(o[1] != "DECIDED" for o in golden)


def every_axis(rng, points):
    """All thresholds as axes: unsorted values, some given twice, some on the features, some beyond all of them."""
    return {
        name: tuple(rng.choice([-0.5, 0.0, 0.02, 0.05, 0.1, 0.3, 0.5, 0.75, 0.9, 0.95, 1.0, 1.5]) for _ in range(points))
        for name in V.SWEEPABLE
    }


@pytest.mark.parametrize("seed", [1, 2])
def test_every_axis_equals_replay_of_every_cell(spark, seed):
    """Counts by prefix sums against the plain way, each pair judged in each cell, by key."""
    _, _, features = labelled(spark, 250, seed)
    features = features.withColumn("roster", F.when(F.col("pair_id").cast("int") % 3 == 0, "s").otherwise("r"))
    axes = every_axis(random.Random(seed), 3)
    axes["contraMin"] = axes["contraMin"][:1]
    got = RP.grid_counts(features, axes)
    cells = features.crossJoin(spark.range(243).select(F.col("id").cast("int").alias("cell")))
    at = {**D.Thresholds().columns(), **{V.SWEEPABLE[a]: c for a, c in RP.cell_columns(axes).items()}}
    judged = RP.replay(D.with_columns(cells, "_t_", at), D.prefixed("_t_", at), ["roster", "cell"])
    want = M.outcome_counts(judged, ["roster", "cell"])
    names = want.columns
    assert sorted(got.select(*names).collect()) == sorted(want.collect())
    assert got.count() == 2 * 243


def test_boxes_tile_the_grid_and_do_not_grow_with_its_values(spark):
    _, _, features = labelled(spark, 60)
    few = every_axis(random.Random(5), 4)
    for axes in (few, {name: tuple(i / 40 for i in range(40)) for name in few}):
        axes = {name: sorted(points) for name, points in axes.items()}
        size = F.lit(1).cast("double")
        for name in axes:
            size = size * (F.col(f"_hi_{name}") - F.col(f"_lo_{name}"))
        boxes = RP.outcome_boxes(features, axes, D.Thresholds().columns(), ["roster"])
        covered = boxes.agg(F.sum(size * F.col("pairs")).alias("n"), F.sum("pairs").alias("pieces")).head()
        assert covered["n"] == 60 * math.prod(len(points) for points in axes.values())
        # Flagged 3 x 3; unflagged 3 x 3, of which one box goes on: 1 that G2 settles and 3 x 3 at G3.
        assert covered["pieces"] <= 60 * (9 + 8 + 1 + 9)


def test_grid_refuses_empty_axes(spark):
    _, _, features = labelled(spark, 5)
    for axes in ({}, {"neutralMin": ()}, {"nope": (1.0,)}):
        with pytest.raises(ValueError):
            RP.grid_counts(features, axes)
    assert RP.grid_search(features.where("false"), AXES).count() == 0


def test_signatures_do_not_grow_with_pairs(spark):
    _, _, features = labelled(spark)
    values = {n: [c] for n, c in D.Thresholds().columns().items()}
    once = RP.signatures(features, values, ["roster"])
    twice = RP.signatures(features.unionByName(features), values, ["roster"])
    assert once.count() == twice.count()
    assert twice.agg(F.sum("pairs")).head()[0] == 2 * once.agg(F.sum("pairs")).head()[0]


def test_sweep_equals_single_replays(spark):
    rows, labels, features = labelled(spark, 150)
    curve = {(r["axis"], r["value"]): r for r in RP.sweep(features, {"contraEscape": (0.02, 0.3), "contraMin": (0.3,)}).collect()}
    for (axis, value), point in curve.items():
        t = replace(D.Thresholds(), **{V.SWEEPABLE[axis]: value})
        judged = [cascade(r, t) for r in rows]
        assert point["decided_neutral"] == sum(o[2] == "NEUTRAL" for o in judged)
        assert point["human_share"] == pytest.approx(sum(o[1] == "ROUTE_HUMAN" for o in judged) / len(rows))


def test_best_cell_ties_take_the_first(spark):
    cells = spark.createDataFrame(
        [("r", 0, 0.7, 0.04, False), ("r", 3, 0.6, 0.02, True), ("r", 2, 0.6, 0.02, True), ("r", 1, 0.6, 0.03, True)],
        "roster string, cell int, coverage double, g4_share double, passed boolean",
    )
    assert RP.best_cell(cells).head()["cell"] == 2
    assert RP.best_cell(cells.where("cell = 0")).count() == 0


def test_report_without_a_passing_cell_uses_the_base(spark):
    rosters = spark.createDataFrame([("r", 1)], "roster string, position int")
    table = score_table(spark, [scores("1", NEUTRAL), scores("2", CONTRADICTORY), scores("3", UNDECIDED)])
    features = RP.pair_features(table.withColumns({
        "roster": F.lit("r"), "ensemble_verdict": F.lit("NEUTRAL"), "golden": F.lit(False),
    }))
    tables = RP.build_report(features, rosters, grid={"neutralMin": (0.9, 0.99)}, sweeps={"neutralMin": (0.9,)})
    adopted = tables["thresholds"].head()
    assert not adopted["from_grid"] and adopted["neutral_min"] == 0.95
    assert tables["winner"].count() == 0 and tables["grid"].count() == 2
    assert tables["sweeps"].head()["decided_neutral"] == 1


def test_axis_options():
    assert RP.parse_axes(["contraEscape=0.02,0.1", " neutralMin = 0.9"]) == {"contraEscape": (0.02, 0.1), "neutralMin": (0.9,)}
    for bad in (["nope=1"], ["neutralMin"], ["neutralMin="], ["neutralMin=x"], ["neutralMin=1", "neutralMin=2"], ["a=b=1"]):
        with pytest.raises(ValueError):
            RP.parse_axes(bad)
    assert RP.with_overrides(["neutralMin=0.7"]).neutral_min == 0.7
    for bad in (["neutralMin=0.7,0.8"], ["nope=1"]):
        with pytest.raises(ValueError):
            RP.with_overrides(bad)
