"""Checks on model heads: label mapping, precision drift, column order."""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, functions as F

from verdictflow.functions.cols import strip

# How label names of known heads begin, per class.
LABEL_PREFIXES = {
    "entailment": ("entail", "support"),
    "neutral": ("neutral", "not_enough_info", "nei"),
    "contradiction": ("contradict", "refut", "not_entail"),
}
CLASSES = tuple(LABEL_PREFIXES)

# Limits of the drift check and of the column-order check.
DRIFT_LIMITS = {"max_mean_abs_diff": 0.02, "max_abs_diff": 0.15, "min_label_agreement": 0.98}
DECISIVE_MARGIN = 0.10
SUPPORT_BOUNDARY = 0.5


def label_class(label: Column) -> Column:
    name = F.lower(strip(label))
    name = F.replace(F.replace(name, F.lit("-"), F.lit("_")), F.lit(" "), F.lit("_"))
    chosen = F.lit(None).cast("string")
    for cls in reversed(CLASSES):
        hit = F.lit(False)
        for prefix in LABEL_PREFIXES[cls]:
            hit = hit | name.startswith(prefix)
        chosen = F.when(hit, F.lit(cls)).otherwise(chosen)
    return chosen


def _is(cls: str):
    return lambda found: found == F.lit(cls)


def resolve_label_maps(heads: DataFrame) -> DataFrame:
    """``heads(artifact, labels ARRAY<STRING>)`` to column numbers per class.

    ``problem`` is null for a usable head; a class named twice, or a missing one,
    makes the head unusable rather than guessed at. Each head is one row and is
    mapped in place.
    """
    classes = F.transform("labels", label_class)
    staged = heads.withColumn("_classes", classes)
    columns, duplicated = {}, F.lit(False)
    for cls in CLASSES:
        hits = F.size(F.filter("_classes", _is(cls)))
        duplicated = duplicated | (hits > 1)
        position = F.array_position("_classes", cls).cast("int")
        columns[f"{cls}_column"] = F.when(position > 0, position - 1)
    three_way = F.size("labels") >= 3
    return staged.select(
        *[name for name in heads.columns],
        *[column.alias(name) for name, column in columns.items()],
        F.when(duplicated, "DUPLICATE_CLASS")
        .when(columns["entailment_column"].isNull(), "NO_ENTAILMENT")
        .when(columns["contradiction_column"].isNull(), "NO_CONTRADICTION")
        .when(three_way & columns["neutral_column"].isNull(), "NO_NEUTRAL")
        .alias("problem"),
    )


def _arg(probabilities: Column) -> Column:
    """Class a row decides for: the first maximum, or the 0.5 boundary of one column."""
    return F.when(
        F.size(probabilities) == 1, (F.get(probabilities, 0) >= SUPPORT_BOUNDARY).cast("int")
    ).otherwise((F.array_position(probabilities, F.array_max(probabilities)) - 1).cast("int"))


def score_drift(reference: DataFrame, candidate: DataFrame, limits: dict | None = None) -> DataFrame:
    """Two precisions of one model over the same pairs.

    Both sides are ``(artifact, pair_id, probabilities ARRAY<DOUBLE>)``. Rows that
    are missing on one side or have another width are counted in ``mismatched``.
    """
    limits = {**DRIFT_LIMITS, **(limits or {})}
    both = reference.withColumnRenamed("probabilities", "p").join(
        candidate.withColumnRenamed("probabilities", "q"), ["artifact", "pair_id"], "full_outer"
    )
    same = F.coalesce(F.size("p") == F.size("q"), F.lit(False)) & F.col("p").isNotNull() & F.col(
        "q"
    ).isNotNull()
    gaps = F.zip_with("p", "q", lambda x, y: F.abs(x - y))
    measured = both.select(
        "artifact",
        same.alias("same"),
        F.when(same, F.aggregate(gaps, F.lit(0.0), lambda acc, x: acc + x)).alias("total_gap"),
        F.when(same, F.array_max(gaps)).alias("worst_gap"),
        F.when(same, F.size("p")).alias("cells"),
        F.when(same, (_arg(F.col("p")) == _arg(F.col("q"))).cast("int")).alias("agrees"),
    )
    result = measured.groupBy("artifact").agg(
        F.count_if("same").alias("pairs"),
        F.count_if(~F.col("same")).alias("mismatched"),
        (F.sum("total_gap") / F.sum("cells")).alias("mean_abs_diff"),
        F.max("worst_gap").alias("max_abs_diff"),
        F.avg("agrees").alias("label_agreement"),
    )
    failures = F.array_compact(F.array(
        F.when(F.col("mean_abs_diff") > limits["max_mean_abs_diff"], F.lit("MEAN_ABS_DIFF")),
        F.when(F.col("max_abs_diff") > limits["max_abs_diff"], F.lit("MAX_ABS_DIFF")),
        F.when(F.col("label_agreement") < limits["min_label_agreement"], F.lit("LABEL_AGREEMENT")),
        F.when(F.col("mismatched") > 0, F.lit("SHAPE")),
    ))
    return result.withColumn("failures", F.array_join(failures, ",")).withColumn(
        "passed", F.col("failures") == ""
    )


def label_order_accuracy(scored: DataFrame) -> DataFrame:
    """Accuracy of each of the six column orders per artifact.

    ``scored(artifact, probabilities, expected)``: ``expected`` is the class name
    a labelled pair leans to. All six hits of a row are counted in one aggregate;
    the orders become rows only afterwards.
    """
    top = _arg(F.col("probabilities"))
    orders = list(permutations(CLASSES))
    staged = scored.withColumn("_top", top)
    hits = [
        F.count_if(
            F.get(F.array(*[F.lit(c) for c in order]), F.col("_top")) == F.col("expected")
        ).alias(f"h{index}")
        for index, order in enumerate(orders)
    ]
    counted = staged.groupBy("artifact").agg(F.count(F.lit(1)).alias("pairs"), *hits)
    rows = F.array(*[
        F.struct(
            F.lit(",".join(order)).alias("column_order"),
            (F.col(f"h{index}").cast("double") / F.col("pairs")).alias("accuracy"),
        )
        for index, order in enumerate(orders)
    ])
    return counted.select("artifact", "pairs", F.inline(rows))


def label_order_winner(accuracies: DataFrame, margin: float = DECISIVE_MARGIN) -> DataFrame:
    """The best order of each artifact and whether it beats the runner-up clearly.

    Equal accuracies go to the later order by name. Six rows per artifact.
    """
    ranked = F.sort_array(
        F.collect_list(F.struct("accuracy", "column_order")), asc=False
    )
    top = accuracies.groupBy("artifact").agg(ranked.alias("r"))
    lead = F.col("r")[0]["accuracy"] - F.col("r")[1]["accuracy"]
    return top.select(
        "artifact",
        F.col("r")[0]["column_order"].alias("column_order"),
        F.col("r")[0]["accuracy"].alias("accuracy"),
        F.col("r")[1]["accuracy"].alias("runner_up"),
        lead.alias("margin"),
        F.when(lead >= margin, "OK").otherwise("UNDECIDED").alias("status"),
    )
