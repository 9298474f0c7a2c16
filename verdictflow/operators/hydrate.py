"""Pairs to the text they are about.

Everything known about a claim is first assembled into one row per claim, so
that pairs - the large side - are shuffled once per side and not once per kind
of text. A claim named by very many pairs makes a skewed join partition, which
AQE splits; the claim side of that join is a single row and is simply repeated.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from verdictflow.functions.cols import text_or_none

CARD_FIELDS = ("type", "source_class", "claimed_date", "relationship", "speaker_role")


def claim_texts(claims: DataFrame) -> DataFrame:
    """(claim_id, text) of claims that have a text."""
    return claims.where(
        (F.coalesce("claim_id", F.lit("")) != "") & (F.coalesce("text", F.lit("")) != "")
    ).select("claim_id", "text")


def first_explanations(explanations: DataFrame) -> DataFrame:
    """One explanation per claim: the lowest ``seq``, the smaller text on a tie."""
    return (
        explanations.groupBy("claim_id")
        .agg(F.min(F.struct("seq", "text")).alias("first"))
        .select("claim_id", F.col("first.text").alias("explanation"))
        .where(F.coalesce("explanation", F.lit("")) != "")
    )


def source_excerpts(excerpts: DataFrame) -> DataFrame:
    """(claim_id, excerpt) where there is one; blank ones are ignored."""
    return excerpts.where(text_or_none("excerpt").isNotNull()).select("claim_id", "excerpt")


def claim_cards(claims: DataFrame, explanations: DataFrame | None = None) -> DataFrame:
    """Everything a prompt shows of a claim; claims without a text are left out."""
    fields = [
        (text_or_none(name) if name in claims.columns else F.lit(None).cast("string")).alias(name)
        for name in CARD_FIELDS
    ]
    cards = claims.where(
        (F.coalesce("claim_id", F.lit("")) != "") & (F.coalesce("text", F.lit("")) != "")
    ).select("claim_id", "text", *fields)
    if explanations is None:
        return cards.withColumn("explanation", F.lit(None).cast("string"))
    return cards.join(first_explanations(explanations), "claim_id", "left").withColumn(
        "explanation", text_or_none("explanation")
    )


def claim_lookup(
    claims: DataFrame,
    explanations: DataFrame | None = None,
    excerpts: DataFrame | None = None,
) -> DataFrame:
    """One row per claim: text, and explanation and excerpt where they exist."""
    lookup = claim_texts(claims)
    if explanations is not None:
        lookup = lookup.join(first_explanations(explanations), "claim_id", "left")
    if excerpts is not None:
        lookup = lookup.join(source_excerpts(excerpts), "claim_id", "left")
    return lookup


def hydrate(pairs: DataFrame, lookup: DataFrame) -> DataFrame:
    """Columns ``a`` and ``b``: the lookup row of either side, null if unknown."""
    fields = [name for name in lookup.columns if name != "claim_id"]
    result = pairs
    for side in ("a", "b"):
        named = lookup.select(
            F.col("claim_id").alias(f"{side}_id"),
            F.struct(*fields).alias(side),
        )
        result = result.join(named, f"{side}_id", "left")
    return result


def both_texts(
    pairs: DataFrame, texts: DataFrame, a: str = "a_id", b: str = "b_id", wanted: Column | None = None,
    into: tuple[str, str] = ("a_text", "b_text"),
) -> DataFrame:
    """Pairs with the text of both sides, null if unknown or, with ``wanted``, not wanted.

    The longer text of a pair stays where it is and the shorter one is shuffled to it, so the length of every
    text is looked up first. ``texts(claim_id, text)``; ids that occur several times give several rows, as a join does.
    """
    sizes = texts.groupBy("claim_id").agg(F.max(F.length("text")).alias("size"))
    for side, name in (("a", a), ("b", b)):
        pairs = pairs.join(sizes.select(F.col("claim_id").alias(name), F.col("size").alias(f"_size_{side}")), name, "left")
    a_moves = F.coalesce("_size_a", F.lit(0)) <= F.coalesce("_size_b", F.lit(0))
    routed = pairs.withColumns({
        "_a_moves": a_moves, "_moves": F.when(a_moves, F.col(a)).otherwise(F.col(b)), "_stays": F.when(a_moves, F.col(b)).otherwise(F.col(a)),
    }).drop("_size_a", "_size_b")
    for key, name in (("_moves", "_short"), ("_stays", "_long")):
        routed = routed.join(texts.select(F.col("claim_id").alias(key), F.col("text").alias(name)), key, "left")
        if wanted is not None:
            routed = routed.withColumn(name, F.when(wanted, F.col(name)))
    return routed.withColumns({
        into[0]: F.when(F.col("_a_moves"), F.col("_short")).otherwise(F.col("_long")),
        into[1]: F.when(F.col("_a_moves"), F.col("_long")).otherwise(F.col("_short")),
    }).drop("_a_moves", "_moves", "_stays", "_short", "_long")


def missing_text(a: Column | str = "a", b: Column | str = "b") -> Column:
    """True where either side of a hydrated pair has no text."""

    def empty(side):
        column = F.col(side) if isinstance(side, str) else side
        # By length: ``text`` may be a digest in bytes.
        return F.coalesce(F.octet_length(column["text"]), F.lit(0)) == 0

    return empty(a) | empty(b)


def split_missing(hydrated: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pairs that can be judged, rejected pair ids with the reason)."""
    missing = missing_text()
    rejects = hydrated.where(missing).select(
        "pair_id",
        F.when(F.col("a.text").isNull() & F.col("b.text").isNull(), "BOTH")
        .when(F.coalesce("a.text", F.lit("")) == "", "A")
        .otherwise("B")
        .alias("missing_side"),
    )
    return hydrated.where(~missing), rejects


def require_text(hydrated: DataFrame) -> DataFrame:
    """Stop the job at the first pair without text, before anything is written."""
    problem = F.raise_error(
        F.concat(F.lit("no claim text for queued pair "), F.col("pair_id"))
    ).cast("boolean")
    return hydrated.where(F.when(missing_text(), problem).otherwise(F.lit(True)))
