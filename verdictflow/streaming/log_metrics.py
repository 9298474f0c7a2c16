"""Metrics over structured log lines in event-time windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, types as T

from verdictflow.functions.timestamps import decode_timestamp
from verdictflow.operators.quantiles import nearest_rank

LOG_LINE = T.StructType([
    T.StructField("timestamp", T.StringType()),
    T.StructField("severity", T.StringType()),
    T.StructField("runRequestId", T.StringType()),
    T.StructField("gate", T.StringType()),
    T.StructField("event", T.StringType()),
    T.StructField("errorCode", T.StringType()),
    T.StructField("durationMs", T.DoubleType()),
    T.StructField("escalatedLlm", T.LongType()),
])


def parse_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    """JSON lines to columns; unreadable lines have a null ``ts``."""
    entry = F.from_json(column, LOG_LINE)
    return lines.select(entry.alias("e")).select(
        decode_timestamp(F.col("e.timestamp")).alias("ts"),
        F.col("e.severity").alias("severity"),
        F.col("e.runRequestId").alias("run_request_id"),
        F.col("e.gate").alias("gate"),
        F.col("e.event").alias("event"),
        F.col("e.errorCode").alias("error_code"),
        F.col("e.durationMs").alias("duration_ms"),
        F.col("e.escalatedLlm").alias("escalated_llm"),
    )


def _counts(log: DataFrame, window: str):
    """Groups per window and gate with their counts as columns."""
    event, code = F.col("event"), F.col("error_code")
    committed = F.coalesce(event == "gate_committed", F.lit(False))
    columns = [
        F.count(F.lit(1)).alias("entries"),
        F.count_if(committed).alias("commits"),
        F.count_if(F.coalesce(code, F.lit("")) != "").alias("errors"),
        F.count_if(F.coalesce(code.endswith("CAP_EXCEEDED"), F.lit(False))).alias("cap_exceeded"),
        F.count_if(F.coalesce(event == "run_overdue", F.lit(False))).alias("overdue"),
        F.coalesce(
            F.sum(F.when(event == "run_finalized", F.col("escalated_llm"))), F.lit(0)
        ).alias("escalation_tail"),
    ]
    return committed, log.groupBy(F.window("ts", window).alias("w"), "gate"), columns


OUT = ("entries", "commits", "p50_ms", "p95_ms", "errors", "cap_exceeded", "overdue", "escalation_tail")


def windowed_metrics(log: DataFrame, window: str = "15 minutes") -> DataFrame:
    """Per window and gate of a table: commits with exact p50/p95 duration, errors, tail size, alerts."""
    committed, groups, columns = _counts(log, window)
    timed = log.where(committed).select(F.window("ts", window)["start"].alias("window_start"), "gate", "duration_ms")
    exact = nearest_rank(timed, ("window_start", "gate"), "duration_ms", {"p50_ms": "0.5", "p95_ms": "0.95"})
    counted = groups.agg(*columns).withColumn("window_start", F.col("w.start"))
    same = [counted[c].eqNullSafe(exact[c]) for c in ("window_start", "gate")]
    joined = counted.join(exact.withColumnRenamed("entries", "timed"), same, "left")
    return joined.select(counted["window_start"], counted["gate"], *OUT)


def streamed_metrics(log: DataFrame, window: str = "15 minutes", lateness: str = "10 minutes") -> DataFrame:
    """The same of a stream, in append mode behind a watermark of ``lateness``.

    A stream cannot look at its durations twice, so ``p50_sketch_ms`` and ``p95_sketch_ms`` come from
    a sketch: their rank is off by at most a 10,000th of the window's commits.
    """
    committed, groups, columns = _counts(log.withWatermark("ts", lateness), window)
    sketch = F.percentile_approx(F.when(committed, F.col("duration_ms")), [0.5, 0.95], 10_000)
    return groups.agg(*columns, sketch.alias("p")).select(
        F.col("w.start").alias("window_start"), "gate", "entries", "commits",
        F.col("p")[0].alias("p50_sketch_ms"), F.col("p")[1].alias("p95_sketch_ms"),
        "errors", "cap_exceeded", "overdue", "escalation_tail",
    )


# --- windows that can be merged -----------------------------------------------------------

SKETCH_SIZE = 2_000
# Fixed value of the sketch: ranks are off by at most this share in 99 of 100 cases, after any merging.
RANK_ERROR = 2.296 / SKETCH_SIZE**0.9723

_SUMMED = ("entries", "commits", "errors", "cap_exceeded", "overdue", "escalation_tail")


def sketched_windows(log: DataFrame, window: str = "15 minutes", lateness: str | None = None) -> DataFrame:
    """Counts and a KLL sketch of the durations per window and gate, small rows to be kept.

    Quantiles of windows cannot be added up, sketches can: ``merge_windows`` makes hours and days of
    them without the log. ``lateness`` is the watermark of a stream, in append mode.
    """
    committed, groups, columns = _counts(log if lateness is None else log.withWatermark("ts", lateness), window)
    sketch = F.kll_sketch_agg_double(F.when(committed, F.col("duration_ms")), SKETCH_SIZE)
    return groups.agg(*columns, sketch.alias("sketch")).select(F.col("w.start").alias("window_start"), "gate", *_SUMMED, "sketch")


def merge_windows(windows: DataFrame, window: str) -> DataFrame:
    """Stored windows in windows of a longer kind: counts summed up, sketches merged."""
    return windows.groupBy(F.window("window_start", window).alias("w"), "gate").agg(
        *[F.sum(name).alias(name) for name in _SUMMED], F.kll_merge_agg_double("sketch", SKETCH_SIZE).alias("sketch")
    ).select(F.col("w.start").alias("window_start"), "gate", *_SUMMED, "sketch")


def with_quantiles(windows: DataFrame) -> DataFrame:
    """p50 and p95 out of the sketches (null where nothing was timed), within ``RANK_ERROR`` of the rank."""
    timed = F.kll_sketch_get_n_double("sketch") > 0
    return windows.withColumns({
        name: F.when(timed, F.kll_sketch_get_quantile_double(F.col("sketch"), F.lit(p)))
        for name, p in (("p50_sketch_ms", 0.5), ("p95_sketch_ms", 0.95))
    }).drop("sketch")
