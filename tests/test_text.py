import json

import pytest
from pyspark.sql import functions as F

from verdictflow import schemas, vocab as V
from verdictflow.functions import prompts as PR, settings, variants
from verdictflow.operators import documents as DO, scoring as S
from verdictflow.plans import corpus as C
from verdictflow.sources import corpus_io, sanity, score_store
from verdictflow.streaming import requests as RQ

RECORD = {"claimAId": "a", "claimBId": "b", "claimAText": "x", "claimBText": "y", "verdict": "neutral"}


def docs(spark, *documents):
    rows = [(str(i), json.dumps(d)) for i, d in enumerate(documents)]
    return spark.createDataFrame(rows, "doc_id string, doc string").withColumn("doc", variants.parse("doc"))


@pytest.mark.parametrize("answer", [
    "", "I cannot", "[1, 2]", '"x"', '{"confidence":1}', '{"relation":"MAYBE"}', '{"relation":3}', "[]",
])
def test_bad_answers_are_errors(spark, answer):
    row = PR.parse_answers(spark.createDataFrame([(answer,)], "a string"), "a").head()["parsed"]
    assert row["parse_error"] and row["relation"] is None


def test_good_answers(spark):
    rows = [
        ('[{"relation":"contradicts ","confidence":4.2}]', "CONTRADICTS", 1.0),
        ('{"relation":"NEUTRAL","confidence":-1}', "NEUTRAL", 0.0),
        ('```json\n[{"relation":"REPEATS","confidence":"0.5"}]\n```', "REPEATS", 0.0),
    ]
    got = PR.parse_answers(spark.createDataFrame(rows, "a string, r string, c double"), "a").collect()
    assert all(g["parsed"]["relation"] == g["r"] and g["parsed"]["confidence"] == g["c"] for g in got)


def test_corpus_rules(spark):
    marked = C.mark_documents(
        docs(
            spark, RECORD, {**RECORD, "method": "GK_G1_NLI"}, {**RECORD, "verdict": "Odd-One", "golden": "false"},
            {"claimAId": "a", "claimBId": "b", "claimAText": "own", "verdict": "REPEATS"},
            {**RECORD, "claimAText": "", "textA": "blocked", "claimAId": "gone"},
        ),
        claims=spark.createDataFrame([("a", "graph a"), ("b", "graph b")], "claim_id string, text string"),
    )
    rows = {r["pair_id"]: r for r in marked.collect()}
    assert [rows[str(i)]["status"] for i in range(5)] == ["EXPORTED", "NOT_ENSEMBLE", "EXPORTED", "EXPORTED", "UNUSABLE"]
    assert rows["0"]["claim_a_text"] == "x" and rows["2"]["ensemble_verdict"] == "ODD_ONE" and rows["2"]["golden"]
    assert (rows["3"]["claim_a_text"], rows["3"]["claim_b_text"]) == ("graph a", "graph b")
    stats = C.corpus_stats(marked).head()
    assert (stats["scanned"], stats["exported"], stats["hydrated"], stats["missing_claim_a_text"]) == (5, 3, 2, 1)
    assert C.fingerprint(marked).head() == C.fingerprint(marked.repartition(3)).head()


def test_field_map_and_inspection(spark):
    with pytest.raises(ValueError):
        DO.FieldMap.from_options({"nope": "x"})
    table = docs(spark, {"a": {"b": {"c": 1}}, "l": [{"z": 1}]}, {"a": 2})
    got = {r["path"]: r["documents"] for r in DO.key_frequencies(table).collect()}
    assert got == {"a": 2, "a.b": 1, "a.b.c": 1, "l": 1}
    nested = DO.FieldMap.from_options({"verdict": "a.b.c"})
    assert table.select(variants.text_or_empty(nested.value(F.col("doc"), "verdict"))).head()[0] == "1"


def test_corpus_round_trip(spark, tmp_path):
    corpus = C.export_corpus(C.mark_documents(docs(spark, RECORD, {**RECORD, "votes": ["a", "b"]})))
    corpus_io.write_corpus(corpus, str(tmp_path / "c"))
    assert sorted(corpus_io.read_corpus(spark, str(tmp_path / "c")).collect()) == sorted(corpus.collect())
    with pytest.raises(ValueError):
        corpus_io.read_corpus(spark, str(tmp_path / "c"), kind="other")
    single = tmp_path / "one.jsonl"
    single.write_text('{"kind":"replayCorpus","schemaVersion":1}\n{"pairId":"p"}\n\n')
    assert corpus_io.read_corpus(spark, str(single)).head()["votes"] == []
    single.write_text('{"kind":"replayCorpus","schemaVersion":1}\n{"pairId":"p","golden":1,"withContext":"false"}\n{"pairId":\n{"x":1}\n7\n')
    assert {r["problem"] for r in corpus_io.read_lines(spark, str(single)).collect()} == {None, "not JSON", "no pair id", "not an object"}
    with pytest.raises(Exception, match="corpus line refused"):
        corpus_io.read_corpus(spark, str(single)).collect()
    row = corpus_io.read_lines(spark, str(single)).where("problem is null").head()
    assert row["golden"] and row["with_context"]
    pairs = tmp_path / "sanity.jsonl"
    pairs.write_text('{"id":"1","premise":"a","hypothesis":"b","lean":"ENTAIL"}\n')
    assert sanity.load_sanity_pairs(spark, str(pairs), 1).head()["premise"] == "a"
    pairs.write_text(pairs.read_text() + '{"id":\n')
    with pytest.raises(Exception, match="no labelled pair"):
        sanity.load_sanity_pairs(spark, str(pairs)).collect()
    (tmp_path / "empty.jsonl").write_text("")
    assert corpus_io.read_corpus(spark, str(tmp_path / "empty.jsonl")).count() == 0


def stub_factory(log):
    def factory(artifact, task):
        def score(premises, hypotheses):
            with open(log, "a") as handle:
                handle.write("".join(f"{artifact}\n" for _ in premises))
            width = 3 if task == "NLI" else 1
            return [[len(p) / 100] * width for p in premises], [False] * len(premises)

        return score

    return factory


def test_scores_are_computed_once(spark, tmp_path):
    log, path = str(tmp_path / "calls"), str(tmp_path / "scores")
    rows = [(f"p{i}", "same", "text", False, None, None, None, None) for i in range(50)] + [
        ("q", "other", "text", True, "why", None, "evidence", None)
    ]
    pairs = spark.createDataFrame(
        rows, "pair_id string, a_text string, b_text string, with_context boolean, context_a string, "
        "context_b string, snippet_a string, snippet_b string",
    )
    rosters = [S.Roster("one", "m@v1", "s@v1", "m@v1"), S.Roster("two", "m@v1", "s@v1", "n@v1")]
    first = score_store.score_pairs(pairs, rosters, stub_factory(log), path, parallelism=2)
    assert first.count() == 102
    calls = len(open(log).read().split())
    # two copies-only pairs of texts, both directions, two more contexted, one grounded
    assert calls == 2 * (4 + 2) + (4 + 1)
    again = score_store.score_pairs(pairs, rosters, stub_factory(log), path, parallelism=2)
    assert again.count() == 102 and len(open(log).read().split()) == calls
    store = score_store.ScoreStore(spark, path)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = store.missing(S.build_requests(S.pair_forms(pairs)), S.artifact_tasks(rosters))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    text = plan[plan.index("Join"):]
    # One exchange, of the requests; the stored side is read in buckets, and no text is near the join.
    assert text.count("Exchange") == 1 and "Bucketed: true" in text and "a_text" not in text.split("Project")[0]
    before = sorted(map(str, again.collect()))
    store.append(store.read().limit(3).drop("score_key"))  # what two jobs at once would leave
    store.compact()
    assert store.generation == 1 and store.read().count() == calls
    assert sorted(map(str, score_store.score_pairs(pairs, rosters, stub_factory(log), path, parallelism=2).collect())) == before
    assert len(open(log).read().split()) == calls
    q = again.where("pair_id = 'q' AND roster = 'two'").head()
    assert q["g1"]["ctx_fwd"] is not None and q["g2"]["grounded"]["support"] == 0.08


def test_batches_are_filled_by_padded_cost():
    assert S.fill_batches([], 10) == []
    assert S.fill_batches([1, 1, 1, 2, 5, 20, 30], 10) == [(0, 4), (4, 5), (5, 6), (6, 7)]
    assert S.fill_batches([4, 1, 1], 8) == [(0, 2), (2, 3)]


def test_request_stream(spark, tmp_path):
    import base64

    good = {
        "schemaVersion": 1, "runRequestId": "3f7c2a18-9b4e-4d6a-8c11-5e2f0a7d9b34", "intakeId": "i", "stage3RunId": "s",
        "gate": "G1_NEUTRAL", "mode": "FULL", "triggeredBy": "SYSTEM", "requestTimestamp": "2026-07-19T04:15:00.000Z",
    }
    bodies = [good, good, {**good, "mode": "FROM_GATE"}, {**good, "extra": 1}, {**good, "requestTimestamp": "2026-07-19T04:15:00"}]
    source = tmp_path / "in"
    source.mkdir()
    (source / "a.txt").write_text("\n".join(
        json.dumps({"message": {"data": base64.b64encode(json.dumps(b).encode()).decode()}}) for b in bodies
    ))
    stream = spark.readStream.text(str(source))
    query = RQ.start_ingest(stream, str(tmp_path / "ok"), str(tmp_path / "dead"), str(tmp_path / "cp"))
    query.awaitTermination(120)
    valid = spark.read.parquet(str(tmp_path / "ok"))
    assert valid.count() == 3 and RQ.dedupe_table(valid.drop("batch")).count() == 2
    dead = {r["reject_reason"]: r["messages"] for r in RQ.dead_letter_depth(spark.read.parquet(str(tmp_path / "dead"))).collect()}
    assert dead == {"unknown_fields": 1, "request_timestamp": 1}
    deduped = RQ.dedupe_stream(RQ.valid_requests(RQ.decode_requests(spark.readStream.text(str(source)))))
    sink = deduped.writeStream.format("memory").queryName("deduped").option(
        "checkpointLocation", str(tmp_path / "cp2")).trigger(availableNow=True).start()
    sink.awaitTermination(120)
    assert spark.table("deduped").count() == 2
