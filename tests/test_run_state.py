"""Streams with state per key: redeliveries, and requests against runs that move."""

import datetime
import json

from pyspark.sql import functions as F

from verdictflow.streaming import requests as RQ, run_state as RS

REQUEST = "run_request_id string, gate string, mode string, requested_at timestamp, n long"
UPDATE = "run_request_id string, updated_at timestamp, state string, gates map<string,struct<state:string,lease_expires_at:timestamp>>"


def at(minute):
    return (datetime.datetime(2024, 1, 1) + datetime.timedelta(minutes=minute)).isoformat() + ".000Z"


def request(run, minute, n=0, gate="G1_NEUTRAL", mode="FULL"):
    return json.dumps({"run_request_id": run, "gate": gate, "mode": mode, "requested_at": at(minute), "n": n})


def typed(lines, schema):
    return lines.select(F.from_json("value", schema).alias("r")).select("r.*")


def fed(spark, folder, batches, query):
    """Rows of a sink fed batch by batch, and the state rows left."""
    (folder / "in").mkdir()
    for number, lines in enumerate(batches):
        (folder / "in" / f"{number}.txt").write_text("\n".join(lines) + "\n")
        stream = query(spark.readStream.text(str(folder / "in"))).writeStream.format("parquet").option("path", str(folder / "out"))
        running = stream.option("checkpointLocation", str(folder / "check")).trigger(availableNow=True).start()
        running.awaitTermination()
    return spark.read.parquet(str(folder / "out")).collect(), running.lastProgress["stateOperators"][0]["numRowsTotal"]


def test_redeliveries_are_dropped_counted_and_forgotten(spark, tmp_path):
    big = (1 << 60) + 1
    first = [request("a", 0, big), request("b", 1), request("a", 2), request("a", 2, mode="FROM_GATE")]
    second = [request("a", 30), request("c", 31), request("b", 32), request("b", 33)]
    closing = [request("z", 5000)]
    rows, left = fed(spark, tmp_path, [first, second, closing, closing], lambda s: RS.counted_dedupe(typed(s, REQUEST)))
    passed = [(r.run_request_id, r.mode, r.n) for r in rows if r.dropped is None]
    assert sorted(passed) == [("a", "FROM_GATE", 0), ("a", "FULL", big), ("b", "FULL", 0), ("c", "FULL", 0), ("z", "FULL", 0)]
    lost = {(r.run_request_id, r.gate, r.mode): r.dropped for r in rows if r.dropped is not None}
    table = RQ.dedupe_table(typed(spark.createDataFrame([(x,) for x in first + second], "value string"), REQUEST)).collect()
    assert lost == {(r.run_request_id, r.gate, r.mode): r.deliveries - 1 for r in table if r.deliveries > 1}
    assert left == 1  # the closing request only


def test_a_delivery_after_its_time_is_a_new_request(spark, tmp_path):
    lines = [request("a", 0), request("a", 119), request("a", 121), request("a", 130)]
    rows, _ = fed(spark, tmp_path, [lines], lambda s: RS.counted_dedupe(typed(s, REQUEST)))
    assert sorted((r.requested_at is None, r.dropped or 0) for r in rows) == [(False, 0), (False, 0), (True, 1)]


def test_a_request_is_judged_by_the_run_of_its_time(spark, tmp_path):
    def update(run, minute, state, **gates):
        return json.dumps({"run_request_id": run, "updated_at": at(minute), "state": state, "gates": {g: {"state": s} for g, s in gates.items()}})

    early = request("a", 10, 1, gate="G2_CORROBORATION")
    late = request("a", 30, 2, gate="G2_CORROBORATION")
    batches = [
        [late, request("unknown", 5, 3), request("unknown", 5, 4, gate="G3_CONTRADICTION")],  # the later request comes first
        [update("a", 0, "RUNNING", G1_NEUTRAL="RUNNING"), early, update("a", 30, "RUNNING", G1_NEUTRAL="SUCCEEDED")],
        [update("a", 60, "SUPERSEDED"), request("a", 61, 5), request("z", 200, 6)],
        [request("z", 80_000, 7)], [request("z", 80_001, 8)],
    ]

    def query(lines):
        return RS.classify_with_runs(typed(lines, REQUEST).where("mode IS NOT NULL"), typed(lines, UPDATE).where("updated_at IS NOT NULL"), "60 minutes")

    rows, left = fed(spark, tmp_path, batches, query)
    assert {r.n: r.rejection for r in rows} == {
        1: "PRIOR_GATE_NOT_SUCCEEDED", 2: None, 3: None, 4: "INVALID_ENTRY", 5: "RUN_SUPERSEDED", 6: None,
    }
    assert left == 1  # the runs are forgotten, two requests wait
