"""Reports as tables of facts, as text, and as files.

A report is a table with one number a row: which part of the report, which item, of what
(``detail``), and its value. Text is only a way to print such rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

PARTS = ("adopted", "grid", "volume", "neutral", "golden", "verdict", "calibration", "bar", "sweep")


def facts_of(table: DataFrame, keys: Sequence[str], part: str, items: Sequence[str], detail: Column | None = None) -> DataFrame:
    """``items`` (columns of numbers or flags) of each row as facts; missing numbers are left out."""
    values = F.array(*[F.struct(F.lit(i).alias("item"), F.col(i).cast("double").alias("value")) for i in items])
    shown = F.lit("") if detail is None else detail
    return table.select(*keys, F.lit(part).alias("part"), shown.alias("detail"), F.inline(values)).where("value IS NOT NULL").select(
        *keys, "part", "item", "detail", "value"
    )


def report_facts(tables: dict[str, DataFrame], keys: Sequence[str] = ("roster",)) -> DataFrame:
    """All numbers of ``plans.replay.build_report`` as facts of each roster."""
    thresholds = [c for c in tables["thresholds"].columns if c not in keys]
    found = [
        facts_of(tables["thresholds"], keys, "adopted", thresholds),
        facts_of(tables["funnel"], keys, "volume", ("total", "decided_share", "g4_share", "human_share")),
        facts_of(tables["neutral"], keys, "neutral", ("coverage", "precision", "decided_neutral")),
        facts_of(tables["contradictions"], keys, "golden", ("golden_contradictions", "preserved", "discarded", "contradicts_recall")),
        facts_of(tables["per_verdict"], keys, "verdict", ("precision", "recall", "f1", "predicted", "actual"), F.col("label")),
        facts_of(tables["calibration"], keys, "calibration", ("ece", "samples")),
        # A criterion without anything to measure has no outcome, which is neither met nor missed.
        facts_of(
            tables["go_bar"].withColumn("met", F.when(F.col("measurable"), F.col("met"))), keys, "bar",
            ("observed", "required", "met"), F.col("criterion"),
        ),
    ]
    if "grid" in tables:
        cells = tables["grid"].groupBy(*keys).agg(F.count("*").alias("cells"), F.count_if("passed").alias("passing"))
        found.append(facts_of(cells, keys, "grid", ("cells", "passing")))
    if "sweeps" in tables:
        point = F.concat_ws("=", "axis", F.format_string("%.4g", "value"))
        renamed = tables["sweeps"].withColumn("_point", point)
        found.append(facts_of(renamed, keys, "sweep", ("coverage", "precision", "g4_share", "human_share"), F.col("_point")))
    whole = found[0]
    for more in found[1:]:
        whole = whole.unionByName(more)
    return whole


def corpus_facts(stats: DataFrame, histogram: DataFrame) -> DataFrame:
    """Export statistics and label counts as facts; a label is a row, so any number of them will do."""
    labels = histogram.select(
        F.lit("label").alias("part"), F.lit("pairs").alias("item"), F.col("ensemble_verdict").alias("detail"), F.col("pairs").cast("double").alias("value")
    )
    return facts_of(stats, (), "export", stats.columns).unionByName(labels)


def lines(facts: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Facts as tab-separated text: part, item with its detail, number (whole, or six decimals)."""
    name = F.when(F.col("detail") == "", F.col("item")).otherwise(F.concat("item", F.lit("["), "detail", F.lit("]")))
    whole = F.col("value") == F.floor("value")
    number = F.when(whole, F.format_string("%d", F.col("value").cast("long"))).otherwise(F.round("value", 6).cast("decimal(20,6)").cast("string"))
    return facts.select(*keys, F.concat_ws("\t", "part", name, number).alias("line"))


def render(tables: dict[str, DataFrame]) -> DataFrame:
    """(roster, report): a roster's lines, part after part.

    Their number is that of thresholds, criteria, verdicts and sweep points, all given by the caller.
    """
    order = F.array_position(F.array(*map(F.lit, PARTS)), F.split("line", "\t")[0])
    return (
        lines(report_facts(tables), ("roster",)).groupBy("roster")
        .agg(F.sort_array(F.collect_list(F.struct(order.alias("o"), "line"))).alias("l"))
        .select("roster", F.array_join(F.transform("l", lambda x: x["line"]), "\n").alias("report"))
    )


def archive(tables: dict[str, DataFrame], path: str) -> str | None:
    """Write every report table under ``path``; returns the adopted roster or None.

    The winner is a single row, which is all that reaches the driver. Outcomes
    are pair-sized and written as parquet, the rest as JSON.
    """
    for name, table in tables.items():
        writer = table.write.mode("overwrite")
        if name == "outcomes":
            writer.parquet(f"{path}/{name}")
        else:
            writer.json(f"{path}/{name}")
    winner = tables["winner"].select("roster").head(1)
    return winner[0]["roster"] if winner else None
