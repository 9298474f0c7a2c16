"""Labelled text pairs for checking a model head."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

SANITY_PAIRS = T.StructType([
    T.StructField(name, T.StringType()) for name in ("id", "premise", "hypothesis", "lean")
])

# What a labelled pair leans to, as a class name.
LEAN_CLASS = {"ENTAIL": "entailment", "NEUTRAL": "neutral", "CONTRADICT": "contradiction"}


def load_sanity_pairs(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """The first ``limit`` pairs by id; fewer than that is an error, and so is an unreadable line."""
    lines = spark.read.text(path).where(F.trim("value") != "").select("value", F.from_json("value", SANITY_PAIRS).alias("p"))
    whole = F.col("p.premise").isNotNull() & F.col("p.hypothesis").isNotNull()
    stop = F.raise_error(F.concat(F.lit("no labelled pair: "), F.substring("value", 1, 200)))
    pairs = lines.where(F.when(whole, F.lit(True)).otherwise(stop.cast("boolean"))).select("p.*")
    if limit is None:
        return pairs
    first = pairs.orderBy("id").limit(limit)
    found = first.count()
    if found < limit:
        raise ValueError(f"{path} has {found} pairs, {limit} are wanted")
    return first


def expected_class(lean: str = "lean"):
    chosen = F.lit(None).cast("string")
    for token, cls in LEAN_CLASS.items():
        chosen = F.when(F.col(lean) == token, F.lit(cls)).otherwise(chosen)
    return chosen
