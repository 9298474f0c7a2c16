"""Requests against what a stream has seen so far: redeliveries counted, stale requests told apart.

Both operators keep a small row of state per key with an event-time timer, so state is bounded by the
watermark and survives a restart with the stream's checkpoint. Request rows travel through them as
JSON next to their key and time, whatever columns they have.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from verdictflow.operators.runs import claim_rejection
from verdictflow.streaming.requests import DEDUPE_KEYS

_EXACT = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}
_GATES = "map<string,struct<state:string,lease_expires_at:timestamp>>"


def _micros(interval: str) -> int:
    """Length of an interval like ``2 hours``."""
    return int(pd.Timedelta(interval).value // 1000)


def _packed(df: DataFrame) -> Column:
    return F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]), _EXACT)


def _expire_at(state: GroupState, micros: int) -> None:
    """Sets the timer; a time the watermark has passed already means as soon as possible."""
    state.setTimeoutTimestamp(max(micros // 1000, state.getCurrentWatermarkMs()) + 1)


def counted_dedupe(valid: DataFrame, keep: str = "2 hours", lateness: str = "2 hours") -> DataFrame:
    """First deliveries as they come, and how many more of each came within ``keep`` of it.

    One operator drops, counts and expires. A first delivery is handed on at once, ``dropped`` null. When
    the watermark has passed the end of its time, or a delivery after that starts the key anew, a row with
    its keys and ``dropped`` follows if there were any, all other columns null. Deliveries that come in
    one batch are taken in the order of their times. A delivery behind the watermark is neither handed
    on nor counted here: Spark reports it as dropped by the watermark. Null keys are a key.
    """
    length = _micros(keep)

    def watch(key: tuple, frames: Iterable[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        first, dropped = state.get if state.exists else (None, 0)
        out: list[tuple] = []
        if state.hasTimedOut:
            state.remove()
            out = [(*key, None, dropped)] if dropped else []
        else:
            for frame in frames:
                for at, row in frame.sort_values(["_at", "_row"])[["_at", "_row"]].itertuples(index=False):
                    if first is not None and at <= first + length:
                        dropped += 1
                        continue
                    if dropped:
                        out.append((*key, None, dropped))
                    first, dropped = int(at), 0
                    out.append((*key, row, None))
            state.update((first, dropped))
            _expire_at(state, first + length)
        yield pd.DataFrame(out, columns=[*DEDUPE_KEYS, "_row", "dropped"], dtype=object)

    keys = ", ".join(f"{c} string" for c in DEDUPE_KEYS)
    rows = valid.withWatermark("requested_at", lateness).select(
        *[F.col(c).cast("string").alias(c) for c in DEDUPE_KEYS], "requested_at",
        F.unix_micros("requested_at").alias("_at"), _packed(valid).alias("_row"),
    ).where("_at IS NOT NULL")
    seen = rows.groupBy(*DEDUPE_KEYS).applyInPandasWithState(
        watch, f"{keys}, _row string, dropped long", "first long, dropped long", "append", GroupStateTimeout.EventTimeTimeout
    )
    request = F.from_json("_row", valid.schema, _EXACT)
    others = [c for c in valid.columns if c not in DEDUPE_KEYS]
    return seen.withColumn("_r", request).select(*DEDUPE_KEYS, *[F.col(f"_r.`{c}`").alias(c) for c in others], "dropped")


def classify_with_runs(valid: DataFrame, updates: DataFrame, lateness: str = "10 minutes", keep: str = "30 days") -> DataFrame:
    """Requests with the reason they would be dropped for, judged by the run as it was at their time.

    ``updates(run_request_id, updated_at, state, gates)`` is a stream of run rows. Both streams meet
    under one watermark, and a row is looked at when the watermark has passed it, in the order of times
    (a run's update before a request of the same time), so neither the order of arrival nor the batches
    change a reason. A run is forgotten ``keep`` after its last update; its requests are then those of
    an unknown run. What arrives behind the watermark is left to Spark's count of late rows.
    """
    length = _micros(keep)

    def judge(key: tuple, frames: Iterable[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        run, run_at, times, kinds, rows = state.get if state.exists else (None, None, [], [], [])
        waiting = list(zip(times, kinds, rows))
        for frame in () if state.hasTimedOut else frames:
            waiting += frame[["_at", "_kind", "_row"]].itertuples(index=False, name=None)
        passed = state.getCurrentWatermarkMs() * 1000
        waiting.sort()
        done = [w for w in waiting if w[0] < passed]
        waiting = waiting[len(done):]
        out = []
        for at, kind, row in done:
            if run_at is not None and at > run_at + length:
                run = run_at = None
            if kind == 0:
                run, run_at = row, int(at)
            else:
                out.append((row, run))
        if run_at is not None and passed > run_at + length and not waiting:
            run = run_at = None
        if run is None and not waiting:
            if state.exists:
                state.remove()
        else:
            state.update((run, run_at, [int(w[0]) for w in waiting], [int(w[1]) for w in waiting], [w[2] for w in waiting]))
            _expire_at(state, waiting[0][0] if waiting else run_at + length)
        yield pd.DataFrame(out, columns=["_row", "_run"], dtype=object)

    def rows(df: DataFrame, time: str, kind: int) -> DataFrame:
        return df.select(
            "run_request_id", F.col(time).alias("_time"), F.unix_micros(time).alias("_at"), F.lit(kind).alias("_kind"), _packed(df).alias("_row")
        ).where("run_request_id IS NOT NULL AND _at IS NOT NULL")

    both = rows(updates.select("run_request_id", "updated_at", "state", F.col("gates").cast(_GATES).alias("gates")), "updated_at", 0)
    both = both.unionByName(rows(valid, "requested_at", 1)).withWatermark("_time", lateness)
    met = both.groupBy("run_request_id").applyInPandasWithState(
        judge, "_row string, _run string",
        "run string, run_at long, times array<long>, kinds array<int>, rows array<string>", "append", GroupStateTimeout.EventTimeTimeout,
    )
    run = F.from_json("_run", f"state string, gates {_GATES}", _EXACT)
    return (
        met.select(F.from_json("_row", valid.schema, _EXACT).alias("_r"), run.alias("_u"))
        .select(*[F.col(f"_r.`{c}`").alias(c) for c in valid.columns], F.col("_u.state").alias("run_state"), F.col("_u.gates").alias("gates"))
        .withColumn("rejection", claim_rejection(F.col("requested_at"))).drop("run_state", "gates")
    )
