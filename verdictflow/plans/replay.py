"""Replay: score once, then try any number of threshold combinations.

A grid search is pairs x cells by definition, but a cell only compares a pair's
features with threshold values. All pairs whose features lie between the same
neighbouring values behave alike in every cell. So pairs are first aggregated to
*signatures* (which side of each value each feature is on), whose number depends
on the grid and not on the data.

Signatures are not multiplied by cells either. A gate splits the cells of a
signature where a feature crosses a threshold the gate reads, and only for pairs
that reach the gate: 27 *boxes* of neighbouring cells at most, whatever the number
of values (9 of flagged pairs, 8 that G1 settles, 10 behind it). A box adds its pairs at its first corner and takes them away
behind its ends; prefix sums along one axis after the other turn these
differences into the counts of every cell. The cost is cells x axes.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from dataclasses import asdict, replace
from math import prod

from pyspark.sql import Column, DataFrame, Window, functions as F

from verdictflow import vocab as V
from verdictflow.functions import decisions as D
from verdictflow.functions.cols import staged_where
from verdictflow.operators import metrics as M
from verdictflow.session import materialize

LABELS = ("ensemble_verdict", "golden")
OUTCOME = (
    "gate", "disposition", "verdict", "method", "escalation_reason", "confidence",
    "contradiction_flag",
)


def _judge(features: DataFrame, thresholds) -> DataFrame:
    """Features and everything else on the row, with the outcome's columns."""
    staged = features.withColumnRenamed("direction", "_direction")
    f = {**D.feature_columns(), "direction": F.col("_direction")}
    return D.with_cascade(staged, f, thresholds)


def pair_features(scored: DataFrame, keys: Sequence[str] = ("roster",)) -> DataFrame:
    """Features and labels per pair; incomplete or NaN scores are left out."""
    g1, g2, g3 = F.col("g1"), F.col("g2"), F.col("g3")
    complete = staged_where(scored, D.scores_complete(g1, g2, g3))
    features = D.cascade_features(g1, g2, g3)
    return complete.select(
        *keys, "pair_id", *LABELS,
        *[features[name].alias(name) for name in D.FEATURES],
    )


def label_scores(corpus: DataFrame, scores: DataFrame) -> DataFrame:
    """Corpus records with their scores; records without scores are dropped."""
    return corpus.select("pair_id", *LABELS).join(scores, "pair_id")


def replay(
    features: DataFrame, thresholds: D.Thresholds | Mapping[str, Column] | None = None,
    keys: Sequence[str] = ("roster",),
) -> DataFrame:
    """Outcome of every pair at one setting of the thresholds: a projection."""
    return _judge(features, thresholds).select(*keys, "pair_id", *LABELS, *OUTCOME)


# --- signatures -----------------------------------------------------------------------


# Which thresholds each feature is compared with; the escape is strict.
_COMPARED = {
    "a_contra": (("contra_escape", True), ("contra_min", False), ("neutral_consensus", False)),
    "a_neutral": (("neutral_min", False),),
    "a_entail": (("repeat_min", False),),
    "c_neutral": (("neutral_min", False),),
    "c_entail": (("repeat_min", False),),
    "support": (("support_min", False),),
    "b_contra": (("contra_min", False), ("neutral_consensus", False)),
}


def signatures(
    features: DataFrame, values: Mapping[str, Sequence[Column]], keys: Sequence[str]
) -> DataFrame:
    """Pairs that no listed threshold value tells apart, with their number.

    The group's smallest feature value stands for all of them: it lies on the
    same side of every threshold value.
    """
    codes = {}
    for feature, compared in _COMPARED.items():
        column = F.col(feature)
        for threshold, strict in compared:
            passed = F.lit(0)
            for value in values[threshold]:
                passed = passed + (column > value if strict else column >= value).cast("int")
            # Pairs without a contexted pass have no such feature.
            codes[f"_{feature}_{threshold}"] = F.coalesce(passed, F.lit(-1))
    label = F.col("ensemble_verdict")
    staged = features.select(
        *keys,
        F.when(label.isin(*V.VERDICTS), label).otherwise("OTHER").alias("ensemble_verdict"),
        (F.coalesce("golden", F.lit(False)) & (label == V.CONTRADICTS)).alias("golden"),
        "leans",
        *_COMPARED,
        *[code.alias(name) for name, code in codes.items()],
    )
    return (
        staged.groupBy(*keys, *LABELS, "leans", *codes)
        .agg(
            F.count(F.lit(1)).alias("pairs"),
            *[F.min(feature).alias(feature) for feature in _COMPARED],
        )
        .drop(*codes)
        .withColumn("direction", F.lit(None).cast("string"))
    )


def _base_columns(base: D.Thresholds | Mapping[str, Column] | None) -> dict[str, Column]:
    return D.as_threshold_columns(base)


def _check_axes(axes: Mapping[str, Sequence[float]]) -> None:
    unknown = sorted(set(axes) - set(V.SWEEPABLE))
    if unknown:
        raise ValueError(f"unknown thresholds {unknown}; known: {sorted(V.SWEEPABLE)}")


_AXIS = re.compile(r"\s*(?P<name>\w+)\s*=(?P<values>[^=]*)")


def parse_axes(options: Sequence[str]) -> dict[str, tuple[float, ...]]:
    """Axes of a grid from texts like ``contraEscape=0.02,0.1``.

    Refused: another form, an axis without a number, a value that is no number, an axis named
    twice, and names that are no thresholds.
    """
    axes: dict[str, tuple[float, ...]] = {}
    for option in options:
        found = _AXIS.fullmatch(option)
        if not found:
            raise ValueError(f"an axis is a name, '=' and numbers with commas between, not {option!r}")
        name, numbers = found["name"], found["values"].replace(",", " ").split()
        if not numbers or name in axes:
            raise ValueError(f"axis {name} {'is given twice' if numbers else 'has no values'}")
        try:
            axes[name] = tuple(map(float, numbers))
        except ValueError as error:
            raise ValueError(f"axis {name}: {error}") from None
    _check_axes(axes)
    return axes


def with_overrides(options: Sequence[str], base: D.Thresholds | None = None) -> D.Thresholds:
    """Base thresholds with single values replaced, given in the same form as axes."""
    given = parse_axes(options)
    several = sorted(name for name, values in given.items() if len(values) > 1)
    if several:
        raise ValueError(f"one value each is wanted for {several}")
    return replace(base or D.Thresholds(), **{V.SWEEPABLE[name]: values[0] for name, values in given.items()})


def cell_columns(axes: Mapping[str, Sequence[float]]) -> dict[str, Column]:
    """Axis values of a cell number, the last axis running fastest."""
    columns, stride = {}, prod(len(v) for v in axes.values())
    for name, values in axes.items():
        stride //= len(values)
        options = F.array(*[F.lit(float(v)) for v in values])
        position = F.floor(F.col("cell") / F.lit(stride)) % F.lit(len(values))
        columns[name] = F.get(options, position.cast("int"))
    return columns


def _reads(f: Mapping[str, Column], at: Mapping[str, Column]) -> list[tuple[str, str, Column]]:
    """(gate, threshold, pairs for which the gate reads it), in the order of the cascade."""
    flag = D.g1_signals(f, at)["contradiction_flag"]
    to_g2 = (F.col("_g1_disposition") == V.FORWARD) & ~F.col("_g1_contradiction_flag")
    to_g3 = (F.col("_g1_disposition") == V.FORWARD) & (
        F.col("_g1_contradiction_flag") | (F.col("_g2_disposition") != V.DECIDED)
    )
    return [
        ("g1", "contra_escape", F.lit(True)), ("g1", "neutral_min", ~flag), ("g1", "repeat_min", ~flag),
        ("g2", "support_min", to_g2), ("g3", "contra_min", to_g3), ("g3", "neutral_consensus", to_g3),
    ]


def _split(df: DataFrame, axis: str, points: Sequence[float], wanted: Column) -> DataFrame:
    """Rows cut along one axis where a feature crosses a value: [``_lo_axis``, ``_hi_axis``).

    ``points`` ascend. Rows that are not ``wanted`` keep the whole axis in one piece.
    """
    given = F.array(*[F.lit(float(p)) for p in points])

    def crossed(feature: Column, strict: bool) -> Column:
        """How many values the feature passes; a missing one crosses nothing, nor does a row that stays whole."""
        passed = F.size(F.filter(given, lambda p: p < feature if strict else p <= feature))
        return F.when(wanted & feature.isNotNull(), passed).otherwise(F.lit(0))

    steps = [
        crossed(F.col(feature), strict)
        for feature, compared in _COMPARED.items()
        for threshold, strict in compared if threshold == V.SWEEPABLE[axis]
    ]
    whole = F.lit(len(points))
    cuts = F.array_sort(F.array_distinct(F.array(F.lit(0), whole, *steps)))
    ends = F.slice(cuts, 2, F.size(cuts) - 1)
    pieces = F.arrays_zip(F.slice(cuts, 1, F.size(cuts) - 1).alias("lo"), ends.alias("hi"))
    cut = df.withColumn("_piece", F.explode(pieces))
    return cut.withColumns({f"_lo_{axis}": F.col("_piece.lo"), f"_hi_{axis}": F.col("_piece.hi")}).drop("_piece")


def outcome_boxes(
    features: DataFrame, axes: Mapping[str, Sequence[float]], thresholds: Mapping[str, Column], keys: Sequence[str]
) -> DataFrame:
    """Boxes of cells in which a signature has one outcome, with ``pairs``.

    ``axes`` hold ascending values. The boxes of a signature tile the grid.
    """
    values = {name: [column] for name, column in thresholds.items()}
    for axis, points in axes.items():
        values[V.SWEEPABLE[axis]] = [F.lit(float(point)) for point in points]
    staged = signatures(features, values, keys).withColumnRenamed("direction", "_direction")
    f = {**D.feature_columns(), "direction": F.col("_direction")}
    at = dict(thresholds)
    axis_of = {V.SWEEPABLE[axis]: axis for axis in axes}
    for axis, points in axes.items():
        # Any cell of a box stands for all: its first.
        at[V.SWEEPABLE[axis]] = F.get(F.array(*[F.lit(float(p)) for p in points]), F.col(f"_lo_{axis}"))
    reads = _reads(f, at)
    for gate in D.STEPS:
        for _, threshold, wanted in [read for read in reads if read[0] == gate]:
            if threshold in axis_of:
                staged = _split(staged, axis_of[threshold], axes[axis_of[threshold]], wanted)
        staged = D.with_decision(staged, gate, f, at)
    outcome = D.cascade_outcome(*[D.decision_columns(gate) for gate in D.STEPS])
    judged = staged.withColumns({name: outcome[name] for name in ("disposition", "verdict")})
    sides = [f"_{end}_{axis}" for axis in axes for end in ("lo", "hi")]
    return judged.groupBy(*keys, *LABELS, "disposition", "verdict", *sides).agg(F.sum("pairs").alias("pairs"))


def grid_counts(
    features: DataFrame, axes: Mapping[str, Sequence[float]], base: D.Thresholds | Mapping[str, Column] | None = None,
    keys: Sequence[str] = ("roster",),
) -> DataFrame:
    """``outcome_counts`` of every cell: differences at the corners of boxes, then prefix sums.

    Cells are numbered as ``cell_columns`` reads them, whatever the order of the given values.
    """
    _check_axes(axes)
    if not axes or not all(axes.values()):
        raise ValueError("every axis of a grid needs values")
    order = {axis: sorted(range(len(points)), key=lambda i: points[i]) for axis, points in axes.items()}
    ascending = {axis: [points[i] for i in order[axis]] for axis, points in axes.items()}
    corners = outcome_boxes(features, ascending, _base_columns(base), keys).withColumns(
        {"_sign": F.lit(1), "_at": F.lit(0).cast("long")}
    )
    cells = stride = prod(len(points) for points in axes.values())
    strides = {}
    for axis, points in axes.items():
        stride //= len(points)
        strides[axis] = stride
        low, high = F.col(f"_lo_{axis}"), F.col(f"_hi_{axis}")
        first = F.struct(low.alias("at"), F.lit(1).alias("sign"))
        behind = F.struct(high.alias("at"), F.lit(-1).alias("sign"))
        # Behind the last value there is no cell to take the pairs away from.
        corners = corners.withColumn(
            "_corner", F.explode(F.when(high < len(points), F.array(first, behind)).otherwise(F.array(first)))
        ).withColumns({
            "_at": F.col("_at") + F.col("_corner.at") * F.lit(stride), "_sign": F.col("_sign") * F.col("_corner.sign"),
        }).drop("_corner", f"_lo_{axis}", f"_hi_{axis}")
    steps = M.outcome_counts(corners, [*keys, "_at"], F.col("pairs") * F.col("_sign"))
    counts = [name for name in steps.columns if name not in (*keys, "_at")]
    # Every key has a box that starts in cell 0; there all cells are opened.
    zero = F.lit(0).cast("long")
    opened = steps.withColumn(
        "_cell",
        F.explode(F.when(F.col("_at") == 0, F.sequence(zero, F.lit(cells - 1).cast("long"))).otherwise(F.array("_at"))),
    )
    here = F.col("_cell") == F.col("_at")
    cube = opened.groupBy(*keys, "_cell").agg(*[F.sum(F.when(here, F.col(name)).otherwise(zero)).alias(name) for name in counts])
    for axis, points in axes.items():
        place = F.floor(F.col("_cell") / F.lit(strides[axis])) % F.lit(len(points))
        line = cube.withColumn("_place", place).withColumn("_line", F.col("_cell") - F.col("_place") * F.lit(strides[axis]))
        along = Window.partitionBy(*keys, "_line").orderBy("_place").rowsBetween(Window.unboundedPreceding, 0)
        cube = line.select(*keys, "_cell", *[F.sum(name).over(along).alias(name) for name in counts])
    number = F.lit(0)
    for axis, points in axes.items():
        place = (F.floor(F.col("_cell") / F.lit(strides[axis])) % F.lit(len(points))).cast("int")
        number = number + F.get(F.array(*map(F.lit, order[axis])), place) * F.lit(strides[axis])
    return cube.select(*keys, number.cast("int").alias("cell"), *counts)


def grid_search(
    features: DataFrame,
    axes: Mapping[str, Sequence[float]],
    base: D.Thresholds | None = None,
    keys: Sequence[str] = ("roster",),
    bar: dict | None = None,
) -> DataFrame:
    """Every combination of the axis values with its metrics and its verdict.

    ``axes`` maps snapshot names to values; other thresholds come from ``base``.
    """
    counts = grid_counts(features, axes, base, keys)
    criteria = M.go_bar_columns(bar)
    return counts.select(
        *keys,
        "cell",
        *[column.alias(axis) for axis, column in cell_columns(axes).items()],
        "total",
        *[c.alias(n) for n, c in M.neutral_columns().items()],
        *[c.alias(n) for n, c in M.funnel_columns().items()],
        *[c.alias(n) for n, c in M.recall_columns().items()],
        M.bar_passed(criteria).alias("passed"),
    )


def sweep(
    features: DataFrame,
    axes: Mapping[str, Sequence[float]],
    base: D.Thresholds | Mapping[str, Column] | None = None,
    keys: Sequence[str] = ("roster",),
) -> DataFrame:
    """One curve per axis, the other thresholds staying at ``base``.

    ``base`` may be columns of ``features`` (per-roster thresholds).
    """
    _check_axes(axes)
    thresholds = _base_columns(base)
    values = {name: [column] for name, column in thresholds.items()}
    points = []
    for axis, given in axes.items():
        values[V.SWEEPABLE[axis]] = values[V.SWEEPABLE[axis]] + [F.lit(float(v)) for v in given]
        points += [
            F.struct(F.lit(axis).alias("axis"), F.lit(float(v)).alias("value")) for v in given
        ]
    carried = [] if isinstance(base, D.Thresholds) or base is None else list(V.THRESHOLD_PATHS)
    grouped = [*keys, *carried]
    expanded = signatures(features, values, grouped).withColumn("point", F.explode(F.array(*points)))
    for axis in axes:
        field = V.SWEEPABLE[axis]
        thresholds[field] = F.when(
            F.col("point.axis") == axis, F.col("point.value")
        ).otherwise(thresholds[field])
    staged = D.with_columns(
        expanded.withColumns({"axis": F.col("point.axis"), "value": F.col("point.value")}),
        "_t_", thresholds,
    )
    judged = _judge(staged, D.prefixed("_t_", thresholds))
    counts = M.outcome_counts(judged, [*keys, "axis", "value"], F.col("pairs"))
    return M.coverage_curve(counts, [*keys, "axis", "value"])


# --- choosing -------------------------------------------------------------------------


def best_cell(grid: DataFrame, keys: Sequence[str] = ("roster",)) -> DataFrame:
    """Per roster the passing cell with most coverage, then least G4 share, then
    the first in grid order."""
    columns = [name for name in grid.columns if name not in keys]
    order = F.struct((-F.col("coverage")).alias("c"), F.col("g4_share"), F.col("cell"))
    return (
        grid.where("passed")
        .groupBy(*keys)
        .agg(F.min_by(F.struct(*columns), order).alias("best"))
        .select(*keys, "best.*")
    )


def adopted_thresholds(
    best: DataFrame, rosters: DataFrame, axes: Mapping[str, Sequence[float]],
    base: D.Thresholds | None = None, keys: Sequence[str] = ("roster",),
) -> DataFrame:
    """One row of thresholds per roster: the best cell's, else the base ones."""
    fixed = asdict(base or D.Thresholds())
    of_axis = {field: axis for axis, field in V.SWEEPABLE.items() if axis in axes}
    joined = rosters.select(*keys).join(best, list(keys), "left")
    return joined.select(
        *keys,
        F.coalesce("passed", F.lit(False)).alias("from_grid"),
        *[
            (F.coalesce(F.col(of_axis[name]), F.lit(float(value))) if name in of_axis
             else F.lit(float(value))).alias(name)
            for name, value in fixed.items()
        ],
    )


def best_roster(reports: DataFrame) -> DataFrame:
    """The roster to adopt: passing, most coverage, least G4 share, first listed.

    ``reports(roster, position, passed, coverage, g4_share)``: a row per roster.
    """
    return (
        reports.where("passed")
        .orderBy(F.desc("coverage"), F.asc("g4_share"), F.asc("position"))
        .limit(1)
    )


def build_report(
    features: DataFrame,
    rosters: DataFrame,
    *,
    grid: Mapping[str, Sequence[float]] | None = None,
    sweeps: Mapping[str, Sequence[float]] | None = None,
    base: D.Thresholds | None = None,
    bar: dict | None = None,
    keep=materialize,
) -> dict[str, DataFrame]:
    """All report tables, each keyed by ``roster``.

    ``rosters(roster, position)`` has one row per combination measured, so what
    is joined back to the pairs is a handful of rows. With a grid, its best cell
    sets the reported thresholds; without a passing cell the base ones are
    reported, so a failure still shows what was measured.

    Grid, thresholds and counts are small and feed several tables, so ``keep``
    writes each of them once; otherwise every table would scan all pairs again.
    """
    tables: dict[str, DataFrame] = {}
    keys = ["roster"]
    if grid:
        tables["grid"] = keep(grid_search(features, grid, base, keys, bar))
        best = best_cell(tables["grid"], keys)
        tables["thresholds"] = keep(adopted_thresholds(best, rosters, grid, base, keys))
    else:
        fixed = asdict(base or D.Thresholds())
        tables["thresholds"] = rosters.select(
            "roster", F.lit(False).alias("from_grid"),
            *[F.lit(float(v)).alias(n) for n, v in fixed.items()],
        )
    calibrated = features.join(tables["thresholds"].drop("from_grid"), "roster")
    outcomes = _judge(calibrated, D.threshold_columns()).select(
        "roster", "pair_id", *LABELS, *OUTCOME
    )
    counts = keep(M.outcome_counts(outcomes, keys))
    tables["outcomes"] = outcomes
    tables["per_verdict"] = M.per_verdict_scores(counts, keys)
    tables["neutral"] = M.neutral_summary(counts, keys)
    tables["funnel"] = M.volumes(counts, keys)
    tables["contradictions"] = M.contradicts_recall(counts, keys)
    tables["calibration"] = M.calibration_error(outcomes, keys)
    tables["go_bar"] = M.evaluate_go_bar(counts, keys, bar)
    if sweeps:
        tables["sweeps"] = sweep(calibrated, sweeps, D.threshold_columns(), keys)
    summary = counts.select(
        "roster",
        M.bar_passed(M.go_bar_columns(bar)).alias("passed"),
        M.neutral_columns()["coverage"].alias("coverage"),
        M.funnel_columns()["g4_share"].alias("g4_share"),
    )
    tables["winner"] = best_roster(summary.join(rosters, "roster"))
    return tables
