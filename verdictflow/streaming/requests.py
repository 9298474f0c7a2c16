"""Run requests: decode, validate, split, de-duplicate, classify."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery

from verdictflow.functions import contracts
from verdictflow.functions.cols import staged_where
from verdictflow.functions.timestamps import parse_rfc3339
from verdictflow.operators.runs import classify_requests


def decode_requests(envelopes: DataFrame, column: str = "value") -> DataFrame:
    """Envelopes to request columns, delivery metadata and ``reject_reason``.

    Works on a stream and on a table alike.
    """
    parsed = contracts.parse_requests(contracts.decode_envelopes(envelopes, column), "body")
    return parsed.withColumn(
        "reject_reason", F.coalesce("envelope_problem", "reject_reason")
    ).drop("body", "envelope_problem")


def valid_requests(decoded: DataFrame) -> DataFrame:
    return staged_where(decoded, F.col("reject_reason").isNull()).withColumn(
        "requested_at", parse_rfc3339("request_timestamp")
    )


def dead_letters(decoded: DataFrame) -> DataFrame:
    return staged_where(decoded, F.col("reject_reason").isNotNull())


DEDUPE_KEYS = ["run_request_id", "gate", "mode"]


def dedupe_stream(valid: DataFrame, lateness: str = "2 hours") -> DataFrame:
    """Drop redeliveries of a request that arrive within ``lateness``.

    State is bounded by the watermark. A retrigger has another mode and passes.
    """
    return valid.withWatermark("requested_at", lateness).dropDuplicatesWithinWatermark(DEDUPE_KEYS)


def redeliveries(valid: DataFrame, window: str = "2 hours", lateness: str = "2 hours") -> DataFrame:
    """Per request and window, how many deliveries came after its first one.

    ``dedupe_stream`` drops them without a trace. On a stream the rows appear when the watermark has
    passed their window; requests that came once are left out.
    """
    counted = valid.withWatermark("requested_at", lateness).groupBy(F.window("requested_at", window).alias("w"), *DEDUPE_KEYS).agg(
        F.count(F.lit(1)).alias("deliveries")
    )
    return counted.where("deliveries > 1").select(
        F.col("w.start").alias("window_start"), *DEDUPE_KEYS, (F.col("deliveries") - 1).alias("dropped")
    )


def dedupe_table(valid: DataFrame) -> DataFrame:
    """The same on a table: the first delivery of each request, and how many came."""
    columns = [c for c in valid.columns if c not in DEDUPE_KEYS]
    return valid.groupBy(*DEDUPE_KEYS).agg(
        F.min(F.struct("requested_at", *[c for c in columns if c != "requested_at"])).alias("first"),
        F.count(F.lit(1)).alias("deliveries"),
    ).select(*DEDUPE_KEYS, "first.*", "deliveries")


def start_ingest(
    envelopes: DataFrame, valid_path: str, dead_path: str, checkpoint: str,
    *, column: str = "value", trigger: dict | None = None,
) -> StreamingQuery:
    """Write valid requests and dead letters to two folders.

    Each batch owns a partition and overwrites it, so a repeated batch changes
    nothing.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        decoded = decode_requests(batch, column).persist()
        valid_requests(decoded).write.mode("overwrite").parquet(f"{valid_path}/batch={batch_id}")
        dead_letters(decoded).write.mode("overwrite").parquet(f"{dead_path}/batch={batch_id}")
        decoded.unpersist()

    return (
        envelopes.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def classify_stream(valid: DataFrame, runs: DataFrame, as_of) -> DataFrame:
    """Stream-static join with the run table: why a request would be dropped."""
    return classify_requests(valid, runs, as_of)


def dead_letter_depth(dead: DataFrame) -> DataFrame:
    return dead.groupBy("reject_reason").agg(F.count(F.lit(1)).alias("messages"))
