"""Replay metrics.

One aggregate counts everything the reports need (``outcome_counts``); each
report is then a projection of that small row per group. An optional ``weight``
says how many pairs a row stands for.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from verdictflow import vocab as V
from verdictflow.functions.cols import count_if, ratio, weighted_count


def outcome_counts(
    outcomes: DataFrame, keys: Sequence[str] = (), weight: Column | None = None
) -> DataFrame:
    """Counts per group of ``outcomes(disposition, verdict, ensemble_verdict, golden)``."""
    d, v, label = F.col("disposition"), F.col("verdict"), F.col("ensemble_verdict")
    golden = F.col("golden") & (label == V.CONTRADICTS)

    def n(condition: Column) -> Column:
        return weighted_count(condition, weight)

    columns = [
        n(F.lit(True)).alias("total"),
        n(d == V.DECIDED).alias("decided"),
        n(d == V.ESCALATE_G4).alias("to_g4"),
        n(d == V.ROUTE_HUMAN).alias("to_human"),
        n(golden).alias("golden_contradictions"),
        n(golden & (d != V.DECIDED)).alias("golden_preserved"),
    ]
    for verdict in V.DECIDABLE_VERDICTS:
        name = verdict.lower()
        columns += [
            n((v == verdict) & (label == verdict)).alias(f"hit_{name}"),
            n(v == verdict).alias(f"pred_{name}"),
            n(label == verdict).alias(f"act_{name}"),
        ]
    return outcomes.groupBy(*keys).agg(*columns)


def per_verdict_scores(counts: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Precision, recall and F1 of every verdict the cascade can reach."""
    rows = F.array(*[
        F.struct(
            F.lit(verdict).alias("label"),
            F.col(f"hit_{verdict.lower()}").alias("true_positives"),
            F.col(f"pred_{verdict.lower()}").alias("predicted"),
            F.col(f"act_{verdict.lower()}").alias("actual"),
        )
        for verdict in V.DECIDABLE_VERDICTS
    ])
    flat = counts.select(*keys, F.inline(rows))
    precision = ratio(F.col("true_positives"), F.col("predicted"))
    recall = ratio(F.col("true_positives"), F.col("actual"))
    both = precision + recall
    return flat.withColumns({
        "precision": precision,
        "recall": recall,
        "f1": F.when(both == 0, F.lit(0.0)).otherwise(2 * precision * recall / both),
    })


def neutral_columns() -> dict[str, Column]:
    return {
        "coverage": ratio(F.col("pred_neutral"), F.col("total")),
        "precision": ratio(F.col("hit_neutral"), F.col("pred_neutral")),
        "decided_neutral": F.col("pred_neutral"),
    }


def funnel_columns() -> dict[str, Column]:
    whole = F.greatest(F.col("total"), F.lit(1))
    rest = F.col("total") - F.col("decided") - F.col("to_g4") - F.col("to_human")
    return {
        "decided_share": ratio(F.col("decided"), whole),
        "g4_share": ratio(F.col("to_g4"), whole),
        "human_share": ratio(F.col("to_human"), whole),
        "undecided_share": ratio(rest, whole),
    }


def recall_columns() -> dict[str, Column]:
    return {
        "golden_contradictions": F.col("golden_contradictions"),
        "preserved": F.col("golden_preserved"),
        "contradicts_recall": ratio(F.col("golden_preserved"), F.col("golden_contradictions")),
        "discarded": F.col("golden_contradictions") - F.col("golden_preserved"),
    }


def _project(counts: DataFrame, keys: Sequence[str], columns: dict[str, Column]) -> DataFrame:
    return counts.select(*keys, *[column.alias(name) for name, column in columns.items()])


def neutral_summary(counts: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Coverage is over the whole corpus, precision over what was called neutral."""
    return _project(counts, keys, neutral_columns())


def volumes(counts: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    return _project(counts, keys, {"total": F.col("total"), **funnel_columns()})


def contradicts_recall(counts: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Golden contradictions that were not decided away."""
    return _project(counts, keys, recall_columns())


def coverage_curve(counts: DataFrame, keys: Sequence[str] = ("axis", "value")) -> DataFrame:
    funnel = funnel_columns()
    return _project(counts, keys, {
        **neutral_columns(), "g4_share": funnel["g4_share"], "human_share": funnel["human_share"],
    })


def go_bar_columns(bar: dict[str, tuple[str, float]] | None = None) -> Column:
    """The criteria as an array of (criterion, observed, comparison, required,
    measurable, met). Without golden contradictions recall cannot be measured."""
    bar = bar or V.GO_BAR
    observed = {
        "neutralPrecision": neutral_columns()["precision"],
        "neutralCoverage": neutral_columns()["coverage"],
        "contradictsRecall": recall_columns()["contradicts_recall"],
        "g4Share": funnel_columns()["g4_share"],
    }
    rows = []
    for name, (comparison, required) in bar.items():
        value, wanted = observed[name], F.lit(float(required))
        measurable = (
            F.col("golden_contradictions") > 0 if name == "contradictsRecall" else F.lit(True)
        )
        rows.append(F.struct(
            F.lit(name).alias("criterion"),
            value.alias("observed"),
            F.lit(comparison).alias("comparison"),
            wanted.alias("required"),
            measurable.alias("measurable"),
            (value >= wanted if comparison == ">=" else value <= wanted).alias("met"),
        ))
    return F.array(*rows)


def bar_passed(criteria: Column) -> Column:
    """Every measurable criterion is met."""
    return F.forall(criteria, lambda c: ~c["measurable"] | c["met"])


def evaluate_go_bar(
    counts: DataFrame, keys: Sequence[str] = (), bar: dict | None = None
) -> DataFrame:
    """One row per criterion, each with the overall verdict ``passed``."""
    staged = counts.select(*keys, go_bar_columns(bar).alias("criteria"))
    return staged.select(
        *keys, bar_passed(F.col("criteria")).alias("passed"), F.inline("criteria")
    )


def calibration_error(
    outcomes: DataFrame, keys: Sequence[str] = (), bins: int = 10
) -> DataFrame:
    """Expected calibration error over rows with a confidence and a verdict.

    A confidence outside [0, 1] falls into no bin but counts as a sample.
    """
    confidence = F.col("confidence")
    scored = confidence.isNotNull() & F.col("verdict").isNotNull()
    # Compared with the bin edges themselves, so no rounding moves a row.
    edges_passed = F.lit(0)
    for index in range(1, bins):
        edges_passed = edges_passed + (confidence >= F.lit(index / bins)).cast("int")
    inside = (confidence >= 0.0) & (confidence <= 1.0)
    right = F.col("ensemble_verdict") == F.col("verdict")
    # Rows without a sample share the bin -1 and count nothing. Filtering them out
    # would make the optimizer repeat the whole cascade inside the filter.
    per_bin = (
        outcomes.withColumn("bin", F.when(scored & inside, edges_passed).otherwise(F.lit(-1)))
        .groupBy(*keys, "bin")
        .agg(
            count_if(scored).alias("members"),
            count_if(scored & right).alias("hits"),
            F.sum(F.when(scored, confidence)).alias("confidence_sum"),
        )
    )
    gap = F.when(
        (F.col("bin") >= 0) & (F.col("members") > 0),
        F.abs(F.col("hits") - F.col("confidence_sum")),
    ).otherwise(F.lit(0.0))
    # weight * |accuracy - confidence| per bin is |hits - sum(confidence)| / samples.
    totals = per_bin.groupBy(*keys).agg(
        F.sum(gap).alias("gap"), F.sum("members").alias("samples")
    )
    samples = F.coalesce(F.col("samples"), F.lit(0)).cast("long")
    return totals.select(
        *keys,
        F.when(samples == 0, F.lit(0.0)).otherwise(F.col("gap") / samples).alias("ece"),
        samples.alias("samples"),
        F.lit(bins).cast("long").alias("bins"),
    )
