"""Plain messages and all others give the same columns: the typed parse against VARIANT."""

import json
import random

from pyspark.sql import functions as F

from verdictflow.functions import contracts as K

GOOD = {
    "schemaVersion": 1, "runRequestId": "3f7c2a18-9b4e-4d6a-8c11-5e2f0a7d9b34", "intakeId": "i", "stage3RunId": "s",
    "gate": "G1_NEUTRAL", "mode": "FULL", "triggeredBy": "SYSTEM", "requestTimestamp": "2026-07-19T04:15:00.000Z",
}
VALUES = [1, 2, 0, -3, 1.0, 1e3, 10**17, 10**18, 10**30, "", "1", "x", " ", "ü", 'q"', "b\\", "a\nb", None, True, [], {}, {"intakeId": "x"}, ["a"]]
TEXTS = [
    "", " ", "null", "[]", "[1]", "{", "{}", " { } ", "1", '"x"', "{not json", '{"schemaVersion":1', '{"schemaVersion":1}', '{"schemaVersion":01}',
    '{"schemaVersion":1,"schemaVersion":1}', '{"a":NaN}', "{'a':1}", '{"schemaVersion":1,}', '{"schemaVersion" : 1 , "gate"\n:\t"FULL"}',
    '{"mode":"FULL"}', '{"schemaVersion":-0}', '{"a":"\u0000"}', "\ufeff{}", '{"schemaVersion":1}x', '{"schemaVersion":1}\n',
]


def bodies():
    draw = random.Random(3)
    out = list(TEXTS) + [json.dumps(GOOD), json.dumps(GOOD, indent=1), json.dumps(GOOD, ensure_ascii=False)]
    for name in GOOD:
        out += [json.dumps({**GOOD, name: v}) for v in VALUES] + [json.dumps({k: v for k, v in GOOD.items() if k != name})]
    for _ in range(60):
        names = draw.sample(sorted(GOOD), draw.randrange(9)) + draw.sample(["extra", "message", "GATE"], draw.randrange(3))
        out.append(json.dumps({n: GOOD.get(n, draw.choice(VALUES)) for n in names}, ensure_ascii=draw.random() < 0.5))
    out.append(json.dumps({**GOOD, **{f"m{i}": i for i in range(40)}}))
    return out


def test_both_ways_agree(spark, monkeypatch):
    texts, parse = bodies(), K.parse_requests
    frame = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    fast = {r.i: r for r in parse(frame, "t").collect()}
    monkeypatch.setattr(K, "PLAIN_BODY", "^(?!)$")
    slow = {r.i: r for r in parse(frame, "t").collect()}
    different = [(texts[i], fast[i], slow[i]) for i in slow if fast[i] != slow[i]]
    assert not different, different[:3]


def test_most_messages_are_plain(spark):
    good = [json.dumps(GOOD), json.dumps(GOOD, indent=2)]
    rows = spark.createDataFrame([(t,) for t in good], "t string")
    assert rows.where(F.col("t").rlike(K.PLAIN_BODY)).count() == 2
    many = "{" + ",".join(f'"m{i}":1' for i in range(200_000)) + "}"  # no recursion, whatever arrives
    assert K.parse_requests(spark.createDataFrame([(many,)], "t string"), "t").head().reject_reason == "version_missing"
