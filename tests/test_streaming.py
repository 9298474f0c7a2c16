"""Streams that run: windows behind a watermark, classification, redeliveries."""

import datetime
import json

from pyspark.sql import functions as F

from catalog import run_queries
from verdictflow.streaming import log_metrics as LM, requests as RQ

SMALL = "/root/testdata/sf0.001"


def fed(spark, folder, batches, name, query):
    """Feed text batches one after the other, each before a trigger; the sink's rows."""
    source = folder / f"{name}-in"
    source.mkdir()
    for number, lines in enumerate(batches):
        (source / f"{number}.txt").write_text("\n".join(lines) + "\n")
        stream = query(spark.readStream.text(str(source)))
        (
            stream.writeStream.format("parquet").option("path", str(folder / f"{name}-out"))
            .option("checkpointLocation", str(folder / f"{name}-check")).trigger(availableNow=True).start().awaitTermination()
        )
    return spark.read.parquet(str(folder / f"{name}-out")).collect()


def line(minute, event="gate_committed", duration=None, code=""):
    return json.dumps({
        "timestamp": f"2024-01-01T{minute // 60:02d}:{minute % 60:02d}:00.250Z", "gate": "G1_NEUTRAL", "event": event,
        "durationMs": duration, "errorCode": code,
    })


def test_log_windows_close_behind_the_watermark(spark, tmp_path):
    first = [line(m, duration=float(m)) for m in range(15)] + [line(3, "failed", code="E_CAP_EXCEEDED")]
    later = [line(45, duration=1.0), line(90, duration=2.0)]
    late = [line(5, duration=99.0), line(200, duration=3.0)]  # minute 5 is long closed
    rows = fed(spark, tmp_path, [first, later, late, [line(400)]], "log", lambda s: LM.streamed_metrics(LM.parse_lines(s)))
    by = {r.window_start: r for r in rows}
    start = by[min(by)]
    assert (start.entries, start.commits, start.errors, start.cap_exceeded) == (16, 15, 1, 1)
    assert start.p50_sketch_ms == 7.0 and start.p95_sketch_ms == 14.0
    assert len(by) == 4 and all(not r.errors for w, r in by.items() if w != min(by))
    table = LM.windowed_metrics(LM.parse_lines(spark.createDataFrame([(x,) for x in first], "value string"))).head()
    assert (table.entries, table.p50_ms, table.p95_ms) == (16, 7.0, 14.0)


def test_stored_sketches_make_hours(spark, tmp_path):
    lines = [line(m, duration=float(m)) for m in range(120)] + [line(70, "failed", code="E_CAP_EXCEEDED"), line(119, "other")]
    rows = fed(spark, tmp_path, [lines, [line(900)], [line(1200)]], "kll", lambda s: LM.sketched_windows(LM.parse_lines(s), lateness="10 minutes"))
    kept = spark.read.parquet(str(tmp_path / "kll-out"))
    assert kept.count() == len(rows) == 9  # eight quarters, and the one that closed last
    hours = LM.with_quantiles(LM.merge_windows(kept, "1 hour")).orderBy("window_start").collect()
    assert [(r.entries, r.commits, r.errors) for r in hours[:2]] == [(60, 60, 0), (62, 60, 1)]
    assert [(r.p50_sketch_ms, r.p95_sketch_ms) for r in hours[:2]] == [(29.0, 56.0), (89.0, 116.0)]
    assert hours[2].p50_sketch_ms is None  # a commit without a duration
    exact = LM.windowed_metrics(LM.parse_lines(spark.createDataFrame([(x,) for x in lines], "value string")), "1 hour").orderBy("window_start").collect()
    assert [(r.p50_ms, r.p95_ms) for r in exact] == [(r.p50_sketch_ms, r.p95_sketch_ms) for r in hours[:2]]


def envelopes(spark):
    return [r.value for r in run_queries.envelopes(spark, SMALL).orderBy("event_id").collect()]


def test_requests_are_classified_on_a_stream(spark, tmp_path):
    lines = envelopes(spark)
    runs = spark.createDataFrame([], "run_request_id string, state string, gates map<string,struct<state:string,lease_expires_at:timestamp>>")
    now = F.lit(datetime.datetime(2024, 6, 1))
    rows = fed(spark, tmp_path, [lines[:500], lines[500:]], "req", lambda s: RQ.classify_stream(RQ.valid_requests(RQ.decode_requests(s)), runs, now))
    table = spark.createDataFrame([(x,) for x in lines], "value string")
    want = RQ.classify_stream(RQ.valid_requests(RQ.decode_requests(table)), runs, now).collect()
    assert len(rows) == len(want) > 0
    assert sorted(map(str, rows)) == sorted(str(r) for r in want)


def test_redeliveries_are_counted(spark, tmp_path):
    valid = [x for x in RQ.valid_requests(RQ.decode_requests(spark.createDataFrame([(e,) for e in envelopes(spark)], "value string"))).select(
        "run_request_id", "gate", "mode", F.date_format("requested_at", "yyyy-MM-dd HH:mm:ss").alias("t")
    ).orderBy("requested_at").limit(3).collect()]
    once = [json.dumps(r.asDict()) for r in valid]
    closing = json.dumps({**valid[-1].asDict(), "t": "2030-01-01 00:00:00"})

    def parsed(stream):
        schema = "run_request_id string, gate string, mode string, t timestamp"
        return stream.select(F.from_json("value", schema).alias("r")).select("r.*").withColumnRenamed("t", "requested_at")

    rows = fed(spark, tmp_path, [once + once[:2] + once[:1], [closing], [closing]], "again", lambda s: RQ.redeliveries(parsed(s)))
    assert sorted(r.dropped for r in rows) == [1, 2]
