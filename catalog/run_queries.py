"""Requests, run tables and log metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import inputs as I
from catalog.registry import query
from verdictflow.functions import timestamps as TS
from verdictflow.operators import runs as RN
from verdictflow.streaming import log_metrics as LM, requests as RQ

# A request per event: the user is the run, so requests repeat. Every tenth is valid in
# most respects; the others break one rule each, by event id.
_UUID = """substr(md5('u' || user_id), 1, 8) || '-' || substr(md5('u' || user_id), 9, 4) || '-4' ||
  substr(md5('u' || user_id), 13, 3) || '-a' || substr(md5('u' || user_id), 16, 3) || '-' || substr(md5('u' || user_id), 19, 12)"""
_GATE = """CASE event_type WHEN 'click' THEN 'G1_NEUTRAL' WHEN 'view' THEN 'G2_CORROBORATION'
  WHEN 'purchase' THEN 'G3_CONTRADICTION' WHEN 'signup' THEN 'G4_ESCALATION' ELSE 'FINALIZE' END"""
_BODY = f"""CASE event_id % 17 WHEN 3 THEN '{{not json' WHEN 4 THEN '[1]' WHEN 5 THEN '{{"mode":"FULL"}}' ELSE
  '{{"schemaVersion":' || CASE event_id % 17 WHEN 6 THEN '2' WHEN 7 THEN '"1"' ELSE '1' END
  || ',"runRequestId":"' || CASE event_id % 17 WHEN 8 THEN upper({_UUID}) ELSE {_UUID} END
  || '","intakeId":"' || CASE event_id % 17 WHEN 9 THEN '' ELSE 'in-' || user_id END
  || '","stage3RunId":"run-' || user_id || '","gate":"' || {_GATE}
  || '","mode":"' || CASE event_id % 17 WHEN 10 THEN 'HALF' WHEN 11 THEN 'FROM_GATE' ELSE 'FULL' END
  || '","triggeredBy":"' || CASE event_id % 17 WHEN 12 THEN 'ALIEN' ELSE 'SYSTEM' END
  || '","requestTimestamp":"' || ts_text || CASE event_id % 17 WHEN 13 THEN '' ELSE 'Z' END || '"'
  || CASE event_id % 17 WHEN 14 THEN ',"extra":1' ELSE '' END || '}}' END"""

_REASON = f"""CASE event_id % 17 WHEN 0 THEN 'envelope_not_object' WHEN 1 THEN 'envelope_message_missing'
  WHEN 2 THEN 'envelope_data_not_base64' WHEN 3 THEN 'body_not_json' WHEN 4 THEN 'body_not_object'
  WHEN 5 THEN 'version_missing' WHEN 6 THEN 'version_unsupported' WHEN 7 THEN 'version_type'
  WHEN 13 THEN 'request_timestamp' WHEN 14 THEN 'unknown_fields' WHEN 8 THEN 'run_request_id' WHEN 9 THEN 'intake_id'
  ELSE CASE WHEN event_type = 'error' THEN 'gate' WHEN event_id % 17 = 10 THEN 'mode'
    WHEN event_id % 17 = 12 THEN 'triggered_by' ELSE '-' END END"""


def _events(spark, sf):
    return I.load(spark, sf, "events").selectExpr(
        "*", "date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss.SSS\") AS ts_text"
    )


_EVENTS_SQL = "ev AS (SELECT *, strftime(ts, '%Y-%m-%dT%H:%M:%S.%g') AS ts_text FROM events)"


def envelopes(spark, sf):
    """Delivery envelopes as JSON text, base64 inside, some of them broken."""
    return _events(spark, sf).selectExpr("event_id", "user_id", "event_type", "ts", f"{_BODY} AS b").selectExpr(
        "event_id",
        """CASE event_id % 17 WHEN 0 THEN '[]' WHEN 1 THEN '{"message":' || event_id || '}'
           WHEN 2 THEN '{"message":{"data":"%%%"}}'
           ELSE '{"message":{"data":"' || base64(encode(b, 'UTF-8')) || '","messageId":"' || event_id
             || '","publishTime":"now"},"deliveryAttempt":' || (event_id % 5) || ',"subscription":"s"}' END AS value""",
    ).withColumn("value", F.regexp_replace("value", "[\r\n]", ""))


def decoded(spark, sf):
    # A few files of small messages with some work each: spread them over all cores.
    return RQ.decode_requests(envelopes(spark, sf).repartition(spark.sparkContext.defaultParallelism, "event_id"))


@query("validate_requests", f"""WITH {_EVENTS_SQL}, r AS (SELECT *, {_REASON} AS reason FROM ev)
SELECT event_id, reason AS reject_reason,
  CASE WHEN reason = '-' THEN {_UUID} ELSE '-' END AS run_request_id,
  CASE WHEN reason = '-' THEN {_GATE} ELSE '-' END AS gate,
  CASE WHEN event_id % 17 > 2 THEN CAST(event_id % 5 AS INTEGER) ELSE -1 END AS delivery_attempt
FROM r""")
def validate_requests(spark, sf):
    rows = decoded(spark, sf)
    ok = F.col("reject_reason").isNull()
    return rows.select(
        "event_id", F.coalesce("reject_reason", F.lit("-")).alias("reject_reason"),
        F.when(ok, F.col("run_request_id")).otherwise("-").alias("run_request_id"),
        F.when(ok, F.col("gate")).otherwise("-").alias("gate"),
        F.coalesce("delivery_attempt", F.lit(-1)).alias("delivery_attempt"),
    )


@query("dead_letter_depth", f"""WITH {_EVENTS_SQL}, r AS (SELECT *, {_REASON} AS reason FROM ev)
SELECT reason AS reject_reason, count(*) AS messages FROM r WHERE reason <> '-' GROUP BY 1""")
def dead_letter_depth(spark, sf):
    return RQ.dead_letter_depth(RQ.dead_letters(decoded(spark, sf)))


@query("dedupe_requests", f"""WITH {_EVENTS_SQL}, r AS (SELECT *, {_REASON} AS reason FROM ev)
SELECT {_UUID} AS run_request_id, {_GATE} AS gate,
  CASE event_id % 17 WHEN 11 THEN 'FROM_GATE' ELSE 'FULL' END AS mode,
  strftime(min(ts), '%Y-%m-%dT%H:%M:%S.%g') || 'Z' AS first_requested, count(*) AS deliveries
FROM r WHERE reason = '-' GROUP BY ALL""")
def dedupe_requests(spark, sf):
    return RQ.dedupe_table(RQ.valid_requests(decoded(spark, sf))).select(
        "run_request_id", "gate", "mode",
        TS.format_rfc3339("requested_at").alias("first_requested"), "deliveries",
    )


# --- run table ------------------------------------------------------------------------

# An order is a run, its customer the pipeline run; gate states follow from the key.
_STATE = "CASE (o_orderkey // 3) % 5 WHEN 0 THEN 'REQUESTED' WHEN 1 THEN 'RUNNING' WHEN 2 THEN 'SUCCEEDED' WHEN 3 THEN 'FAILED' ELSE 'SUPERSEDED' END"
_DONE = "o_orderkey % 5"  # gates that have succeeded
_NOW_STATE = "CASE o_orderkey % 4 WHEN 0 THEN 'PENDING' WHEN 1 THEN 'RUNNING' WHEN 2 THEN 'FAILED' ELSE 'SKIPPED' END"
_AS_OF = "TIMESTAMP '1998-06-01 00:00:00'"
_GATES = ("G1_NEUTRAL", "G2_CORROBORATION", "G3_CONTRADICTION", "G4_ESCALATION")


def _spark(sql: str) -> str:
    return sql.replace("//", "div")


def run_rows(spark, sf):
    entries = ", ".join(
        f"'{gate}', named_struct('state', CASE WHEN {_DONE} > {i} THEN 'SUCCEEDED' WHEN {_DONE} = {i} THEN {_NOW_STATE} ELSE 'PENDING' END, "
        f"'sweep_attempt', cast(o_orderkey % 7 AS int), 'lease_expires_at', timestamp_seconds(unix_seconds(cast(o_orderdate AS timestamp)) + 5400))"
        for i, gate in enumerate(_GATES)
    )
    return I.load(spark, sf, "orders").selectExpr(
        "cast(o_orderkey AS string) AS run_request_id", "cast(o_custkey AS string) AS stage3_run_id",
        f"{_spark(_STATE)} AS state", "cast(o_orderdate AS timestamp) AS created_at",
        "CASE WHEN o_orderkey % 2 = 0 THEN timestamp_seconds(unix_seconds(cast(o_orderdate AS timestamp)) + 600) END AS updated_at",
        f"map({entries}) AS gates", "o_orderkey",
    )


_RUNS_SQL = f"""runs AS (
  SELECT CAST(o_orderkey AS VARCHAR) AS run_request_id, CAST(o_custkey AS VARCHAR) AS stage3_run_id, o_orderkey,
    {_STATE} AS state, o_orderdate AS created_at, {_DONE} AS done, {_NOW_STATE} AS now_state,
    o_orderdate + INTERVAL 90 MINUTE AS lease, o_orderkey % 7 AS sweeps,
    CASE WHEN o_orderkey % 2 = 0 THEN o_orderdate + INTERVAL 10 MINUTE END AS updated_at,
    ['G1_NEUTRAL','G2_CORROBORATION','G3_CONTRADICTION','G4_ESCALATION','-'] AS names
  FROM orders
)"""


@query("run_health", f"""WITH {_RUNS_SQL}, h AS (
  SELECT *, done < 4 AND now_state = 'RUNNING' AND lease <= {_AS_OF} AS expired,
    coalesce(updated_at, created_at) AS idle_since FROM runs WHERE state IN ('REQUESTED', 'RUNNING')
), k AS (
  SELECT *, NOT (done < 4 AND now_state = 'RUNNING') AND {_AS_OF} - idle_since >= INTERVAL 30 MINUTE
    AND done < 4 AND now_state = 'PENDING' AS stalled FROM h
)
SELECT run_request_id, CASE WHEN expired THEN CASE WHEN sweeps >= 3 THEN 'STUCK' ELSE 'RESCUABLE' END WHEN stalled THEN 'STALLED' ELSE 'OK' END AS status,
  state = 'RUNNING' AND {_AS_OF} - created_at >= INTERVAL 2 HOUR AS overdue,
  names[done + 1] AS blocking_gate, CASE WHEN expired THEN names[done + 1] ELSE '' END AS expired_gates,
  CASE WHEN stalled THEN names[done + 1] ELSE '-' END AS waiting_gate,
  CAST(epoch({_AS_OF}) - epoch(idle_since) AS BIGINT) AS idle_seconds
FROM k""")
def run_health(spark, sf):
    rows = RN.run_health(run_rows(spark, sf), F.lit("1998-06-01").cast("timestamp"))
    return rows.select(
        "run_request_id", "status", "overdue",
        F.coalesce("blocking_gate", F.lit("-")).alias("blocking_gate"), "expired_gates",
        F.coalesce("waiting_gate", F.lit("-")).alias("waiting_gate"), "idle_seconds",
    )


@query("classify_stale", f"""WITH {_RUNS_SQL}, req AS (
  SELECT l_orderkey, l_linenumber, (l_linenumber - 1) % 4 AS g, CASE WHEN l_returnflag = 'R' THEN 'FROM_GATE' ELSE 'FULL' END AS mode,
    CASE WHEN l_linestatus = 'O' THEN CAST(l_orderkey AS VARCHAR) ELSE 'gone-' || l_orderkey END AS run_request_id
  FROM lineitem
), j AS (
  SELECT req.*, runs.state AS run_state, CASE WHEN done > g THEN 'SUCCEEDED' WHEN done = g THEN now_state ELSE 'PENDING' END AS entry,
    g > 0 AND done < g AS blocked, lease FROM req LEFT JOIN runs USING (run_request_id)
)
SELECT mode, g, coalesce(CASE WHEN run_state IS NULL THEN CASE WHEN NOT (g = 0 AND mode = 'FULL') THEN 'INVALID_ENTRY' END
  WHEN run_state = 'SUPERSEDED' THEN 'RUN_SUPERSEDED' WHEN run_state = 'SUCCEEDED' THEN 'RUN_TERMINAL'
  WHEN run_state = 'FAILED' AND mode = 'FULL' THEN 'RUN_TERMINAL' WHEN blocked THEN 'PRIOR_GATE_NOT_SUCCEEDED'
  WHEN entry = 'RUNNING' AND lease > {_AS_OF} THEN 'GATE_LEASED' WHEN entry IN ('SUCCEEDED', 'SKIPPED') THEN 'GATE_TERMINAL'
  WHEN mode = 'FROM_GATE' AND entry NOT IN ('FAILED', 'RUNNING') THEN 'GATE_NOT_RETRIGGERABLE'
  WHEN mode = 'FULL' AND entry = 'FAILED' THEN 'GATE_TERMINAL' END, '-') AS rejection, count(*) AS requests
FROM j GROUP BY ALL""")
def classify_stale(spark, sf):
    """A request per line item, judged by the run table."""
    requests = I.load(spark, sf, "lineitem").selectExpr(
        "cast((l_linenumber - 1) % 4 AS int) AS g",
        "CASE WHEN l_returnflag = 'R' THEN 'FROM_GATE' ELSE 'FULL' END AS mode",
        "CASE WHEN l_linestatus = 'O' THEN cast(l_orderkey AS string) ELSE 'gone-' || l_orderkey END AS run_request_id",
    ).withColumn("gate", F.get(F.array(*[F.lit(g) for g in _GATES]), F.col("g")))
    judged = RN.classify_requests(requests, run_rows(spark, sf), F.lit("1998-06-01").cast("timestamp"))
    return judged.groupBy("mode", "g", F.coalesce("rejection", F.lit("-")).alias("rejection")).agg(
        F.count(F.lit(1)).alias("requests")
    )


@query("supersede", f"""WITH {_RUNS_SQL}, n AS (
  SELECT *, lead(run_request_id) OVER (PARTITION BY stage3_run_id ORDER BY created_at, run_request_id) AS following FROM runs
)
SELECT run_request_id, CASE WHEN following IS NOT NULL AND state IN ('REQUESTED', 'RUNNING') THEN 'SUPERSEDED' ELSE state END AS state,
  coalesce(CASE WHEN state IN ('REQUESTED', 'RUNNING') THEN following END, '-') AS superseded_by
FROM n""")
def supersede(spark, sf):
    runs = run_rows(spark, sf).select("run_request_id", "stage3_run_id", "state", "created_at")
    return RN.supersede(runs).select(
        "run_request_id", "state", F.coalesce("superseded_by", F.lit("-")).alias("superseded_by")
    )


@query("attempts", """SELECT event_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS attempt FROM events""")
def attempts(spark, sf):
    log = I.load(spark, sf, "events").select(
        F.col("event_id").alias("entry_id"), F.col("user_id").alias("run_request_id"),
        F.col("event_type").alias("gate"), F.col("ts").alias("started_at"),
    )
    return RN.number_attempts(log).select(F.col("entry_id").alias("event_id"), "attempt")


# --- log metrics ----------------------------------------------------------------------

_LINE = """'{"timestamp":"' || ts_text || 'Z","severity":"INFO","runRequestId":"r' || user_id || '","gate":"' || CASE event_type WHEN 'click' THEN 'G1_NEUTRAL' WHEN 'view' THEN 'G2_CORROBORATION' ELSE 'G3_CONTRADICTION' END
  || '","event":"' || CASE event_type WHEN 'purchase' THEN 'run_finalized' WHEN 'signup' THEN 'run_overdue' ELSE 'gate_committed' END
  || '","errorCode":"' || CASE WHEN event_type = 'error' THEN CASE WHEN event_id % 2 = 0 THEN 'E_CAP_EXCEEDED' ELSE 'E_STUCK' END ELSE '' END
  || '","durationMs":' || value || ',"escalatedLlm":' || user_id || '}'"""


def _log(spark, sf):
    lines = _events(spark, sf).selectExpr(f"{_LINE} AS value")
    return LM.parse_lines(lines)


def _pick(p):
    return f"round(coalesce(list_sort(list(value) FILTER (committed))[greatest(1, CAST(ceil({p} * count(*) FILTER (committed)) AS INTEGER))], -1), 6)"


@query("log_metrics", f"""WITH e AS (
  SELECT *, CASE event_type WHEN 'click' THEN 'G1_NEUTRAL' WHEN 'view' THEN 'G2_CORROBORATION' ELSE 'G3_CONTRADICTION' END AS gate,
    event_type IN ('click', 'view', 'error') AS committed, time_bucket(INTERVAL '15 minutes', ts) AS w FROM events
)
SELECT strftime(w, '%Y-%m-%d %H:%M') AS window_start, gate, count(*) AS entries, count(*) FILTER (committed) AS commits,
  {_pick(0.5)} AS p50_ms, {_pick(0.95)} AS p95_ms, count(*) FILTER (event_type = 'error') AS errors,
  count(*) FILTER (event_type = 'error' AND event_id % 2 = 0) AS cap_exceeded, count(*) FILTER (event_type = 'signup') AS overdue,
  CAST(coalesce(sum(user_id) FILTER (event_type = 'purchase'), 0) AS BIGINT) AS escalation_tail
FROM e GROUP BY w, gate""")
def log_metrics(spark, sf):
    rows = LM.windowed_metrics(_log(spark, sf))

    def number(name):
        return F.round(F.coalesce(F.col(name), F.lit(-1.0)), 6).alias(name)

    return rows.select(
        F.date_format("window_start", "yyyy-MM-dd HH:mm").alias("window_start"), "gate", "entries",
        "commits", number("p50_ms"), number("p95_ms"), "errors", "cap_exceeded", "overdue",
        "escalation_tail",
    )


@query("log_rollups", """WITH e AS (
  SELECT *, CASE event_type WHEN 'click' THEN 'G1_NEUTRAL' WHEN 'view' THEN 'G2_CORROBORATION' ELSE 'G3_CONTRADICTION' END AS gate,
    event_type IN ('click', 'view', 'error') AS committed FROM events
)
SELECT strftime(ts, '%Y-%m-%d') AS day, gate, count(*) AS entries, count(*) FILTER (committed) AS commits,
  count(*) FILTER (event_type = 'error') AS errors, count(*) FILTER (committed) > 0 AS p50_fits, count(*) FILTER (committed) > 0 AS p95_fits
FROM e GROUP BY ALL""")
def log_rollups(spark, sf):
    """Days merged out of sketches of 15 minutes, held against the log: is each quantile's rank within the bound?"""
    log = _log(spark, sf)
    days = LM.with_quantiles(LM.merge_windows(LM.sketched_windows(log), "1 day"))
    timed = log.where("event = 'gate_committed' AND duration_ms IS NOT NULL").select(F.date_trunc("day", "ts").alias("window_start"), "gate", "duration_ms")
    joined = days.join(timed, ["window_start", "gate"], "left")
    counts = ["entries", "commits", "errors"]

    def fits(name, p):
        # The rank of a value is a range: the shares below it and up to it.
        n, value = F.nullif(F.count("duration_ms"), F.lit(0)), F.col("duration_ms")
        below, upto = F.count_if(value < F.col(name)) / n, F.count_if(value <= F.col(name)) / n
        slack = 3 * LM.RANK_ERROR + 1 / n
        return F.coalesce((below <= p + slack) & (upto >= p - slack), F.lit(False)).alias(name[:3] + "_fits")

    return joined.groupBy(F.date_format("window_start", "yyyy-MM-dd").alias("day"), "gate", *counts).agg(
        fits("p50_sketch_ms", 0.5), fits("p95_sketch_ms", 0.95)
    )


@query("gate_durations", """SELECT event_type AS gate, count(*) AS entries,
  round(list_sort(list(value))[CAST(ceil(0.5 * count(*)) AS INTEGER)], 6) AS p50_ms,
  round(list_sort(list(value))[CAST(ceil(0.95 * count(*)) AS INTEGER)], 6) AS p95_ms
FROM events GROUP BY event_type""")
def gate_durations(spark, sf):
    log = I.load(spark, sf, "events").select(
        F.col("event_type").alias("gate"), F.col("value").alias("duration_ms")
    )
    return RN.gate_durations(log).withColumns({n: F.round(n, 6) for n in ("p50_ms", "p95_ms")})


@query("errors_by_code", """SELECT 'G3_CONTRADICTION' AS gate, CASE WHEN event_id % 2 = 0 THEN 'E_CAP_EXCEEDED' ELSE 'E_STUCK' END AS error_code,
  count(*) AS errors FROM events WHERE event_type = 'error' GROUP BY ALL""")
def errors_by_code(spark, sf):
    return RN.errors_by_code(_log(spark, sf))


@query("timestamps", """SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%g') || 'Z' AS utc,
  CASE WHEN event_id % 3 = 0 THEN '-' ELSE strftime(ts - INTERVAL 330 MINUTE, '%Y-%m-%dT%H:%M:%S.%g') || 'Z' END AS shifted
FROM events""")
def timestamps(spark, sf):
    rows = _events(spark, sf)
    offset = F.when(F.col("event_id") % 3 == 0, "").otherwise("+05:30")
    return rows.select(
        "event_id",
        TS.format_rfc3339(TS.parse_rfc3339(F.concat("ts_text", F.lit("Z")))).alias("utc"),
        F.coalesce(
            TS.format_rfc3339(TS.parse_rfc3339(F.concat("ts_text", offset))), F.lit("-")
        ).alias("shifted"),
    )
