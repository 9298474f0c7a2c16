"""Stored verdict documents to a labelled replay corpus, with statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from verdictflow import schemas, vocab as V
from verdictflow.functions import variants
from verdictflow.functions.cols import staged_where
from verdictflow.operators.documents import FieldMap
from verdictflow.operators.hydrate import both_texts

NOT_ENSEMBLE = "NOT_ENSEMBLE"
UNUSABLE = "UNUSABLE"
EXPORTED = "EXPORTED"


def _is_label(method: Column) -> Column:
    """The judge's own earlier output is never a label; no method means ENSEMBLE."""
    return F.upper(F.when(method == "", "ENSEMBLE").otherwise(method)).isin(*V.LABEL_METHODS)


def usable() -> Column:
    """Both texts and a verdict."""
    return (
        (F.col("claim_a_text") != "") & (F.col("claim_b_text") != "")
        & (F.col("ensemble_verdict") != "")
    )


def _records(documents: DataFrame, field_map: FieldMap) -> DataFrame:
    """Typed record columns. The paths are followed first, each once; the
    coercions then read the values found and their kinds."""
    steps = {path: f"_s_{number}" for number, path in enumerate(dict.fromkeys(p for own in field_map.paths.values() for p in own))}
    walked = documents.select("doc_id", *[variants.step_to(F.col("doc"), path).alias(name) for path, name in steps.items()])
    found = walked.select("doc_id", *[
        F.coalesce(*[variants.present(F.col(steps[path])) for path in own]).alias(f"_v_{name}") for name, own in field_map.paths.items()
    ])

    found = found.withColumns({f"_k_{name}": variants.kind(F.col(f"_v_{name}")) for name in field_map.paths})

    def value(name: str) -> Column:
        return F.col(f"_v_{name}")

    def which(name: str) -> Column:
        return F.col(f"_k_{name}")

    texts = (
        "claim_a_id", "claim_b_id", "claim_a_text", "claim_b_text", "context_a", "context_b",
        "source_snippet", "intake_id", "stage3_run_id", "method",
    )
    typed = found.select(
        F.col("doc_id").cast("string").alias("pair_id"),
        *[variants.text_or_empty(value(name), which(name)).alias(name) for name in texts],
        variants.scalar_text(value("verdict"), which("verdict")).alias("_verdict"),
        variants.coerce_votes(value("votes")).alias("votes"),
        variants.truthy(value("golden")).alias("golden"),
        variants.truthy(value("with_context")).alias("with_context"),
    )
    return typed.withColumns({
        "ensemble_verdict": variants.coerce_verdict("_verdict"),
        "is_label": _is_label(F.col("method")),
    }).drop("_verdict", "method")


def mark_documents(
    documents: DataFrame, field_map: FieldMap | None = None, claims: DataFrame | None = None
) -> DataFrame:
    """Every document as a record with ``status`` and ``hydrated``.

    ``documents(doc_id, doc VARIANT)``. A claims table fills in missing texts; it
    is only consulted for records that lack one, and then its texts win on both
    sides. Complete records are not shuffled.
    """
    records = _records(documents, field_map or FieldMap())
    if claims is None:
        records = records.withColumn("hydrated", F.lit(False))
    else:
        lacking = F.col("is_label") & ((F.col("claim_a_text") == "") | (F.col("claim_b_text") == ""))
        complete = staged_where(records, ~lacking).withColumn("hydrated", F.lit(False))
        records = complete.unionByName(_fill(staged_where(records, lacking), claims))
    status = (
        F.when(~F.col("is_label"), NOT_ENSEMBLE)
        .when(usable(), EXPORTED)
        .otherwise(UNUSABLE)
    )
    return records.withColumn("status", status).drop("is_label")


def _fill(records: DataFrame, claims: DataFrame) -> DataFrame:
    texts = claims.where(
        (F.coalesce("claim_id", F.lit("")) != "") & (F.coalesce("text", F.lit("")) != "")
    )
    filled = both_texts(records, texts, "claim_a_id", "claim_b_id", into=("_a", "_b"))
    return filled.withColumns({
        "claim_a_text": F.coalesce("_a", "claim_a_text"),
        "claim_b_text": F.coalesce("_b", "claim_b_text"),
        "hydrated": F.col("_a").isNotNull() | F.col("_b").isNotNull(),
    }).drop("_a", "_b")


def export_corpus(marked: DataFrame) -> DataFrame:
    return staged_where(marked, F.col("status") == EXPORTED).select(*schemas.CORPUS.fieldNames())


def corpus_stats(marked: DataFrame) -> DataFrame:
    """One row of counts in a single pass."""
    status = F.col("status")
    unusable = status == UNUSABLE
    exported = status == EXPORTED

    def missing(name: str) -> Column:
        return F.count_if(unusable & (F.col(name) == ""))

    return marked.agg(
        F.count(F.lit(1)).alias("scanned"),
        F.count_if(exported).alias("exported"),
        F.count_if(status == NOT_ENSEMBLE).alias("skipped_not_ensemble"),
        F.count_if(unusable).alias("skipped_unusable"),
        F.count_if(F.col("hydrated")).alias("hydrated"),
        F.count_if(exported & F.col("golden")).alias("golden"),
        F.count_if(exported & F.col("with_context")).alias("with_context"),
        missing("claim_a_text").alias("missing_claim_a_text"),
        missing("claim_b_text").alias("missing_claim_b_text"),
        missing("ensemble_verdict").alias("missing_verdict"),
    )


def verdict_histogram(marked: DataFrame) -> DataFrame:
    return (
        staged_where(marked, F.col("status") == EXPORTED)
        .groupBy("ensemble_verdict")
        .agg(F.count(F.lit(1)).alias("pairs"))
    )


def fingerprint(corpus: DataFrame, column: str = "pair_id") -> DataFrame:
    """Identity of a set of ids, whatever order or partitioning it comes in.

    Count, exclusive-or and sum of 60-bit digests (a prefix of SHA-256) merge
    map-side, so nothing is collected.
    """
    digest = F.conv(F.substring(F.sha2(F.col(column), 256), 1, 15), 16, 10).cast("long")
    return corpus.select(digest.alias("d")).agg(
        F.count(F.lit(1)).alias("n"),
        F.coalesce(F.bit_xor("d"), F.lit(0)).alias("x"),
        F.coalesce(F.sum(F.col("d").cast("decimal(20,0)")), F.lit(0)).alias("total"),
    ).select(
        F.col("n").alias("records"),
        F.concat_ws(
            ":", F.col("n").cast("string"), F.col("x").cast("string"),
            F.col("total").cast("string"),
        ).alias("fingerprint"),
    )
