"""The cascade from pairs to totals: one commit, repeats, crashes, streams."""

import glob
import json

import pytest
from pyspark.sql import functions as F, types as T

from catalog import inputs as I
from verdictflow import schemas, vocab as V
from verdictflow.functions import settings
from verdictflow.operators import hydrate as H, scoring as S
from verdictflow.plans import cascade as C, gates as G
from verdictflow.sources import ledger as L
from verdictflow.streaming import continuous

SMALL = "/root/testdata/sf0.001"
def now():
    return F.lit("2024-01-02").cast("timestamp")


CANDIDATES = (
    "subject_id string, a_id string, b_id string, rank int, with_context boolean, human_asserted boolean, stage3_run_id string, intake_id string"
)


# --- the ledger -----------------------------------------------------------------------

KEYED = T.StructType([T.StructField("k", T.StringType()), T.StructField("n", T.LongType())])
TABLES = {name: L.Table(KEYED, "k", 8) for name in ("one", "two")}


def rows(spark, first, last, n=0):
    return spark.range(first, last).select(F.col("id").cast("string").alias("k"), F.lit(n).cast("long").alias("n"))


def files(root, table="*"):
    return set(glob.glob(f"{root}/data/{table}/*/*/*.parquet"))


def upsert(ledger, spark, changes, n):
    base = ledger.version()
    out = {}
    for name, new in changes.items():
        touched = base.touched(name, new)
        old = base.read(name, touched).join(new.select("k"), "k", "left_anti")
        out[name] = (old.unionByName(new.withColumn("n", F.lit(n).cast("long"))), touched)
    return ledger.commit(base, out)


def test_only_touched_buckets_are_rewritten(spark, tmp_path):
    tables = {"one": L.Table(KEYED, "k", 64)}
    ledger = L.Ledger(spark, str(tmp_path), tables)
    ledger.commit(ledger.version(), {"one": (rows(spark, 0, 5_000), None)})
    before = files(tmp_path)
    assert len(before) == 64
    version = upsert(ledger, spark, {"one": rows(spark, 100, 110)}, 7)
    new = files(tmp_path) - before
    assert 1 <= len(new) <= 10 and before <= files(tmp_path)
    assert version.rows("one") == version.read("one").count() == 5_000
    assert version.read("one").where("n = 7").count() == 10
    assert ledger.version(0).read("one").where("n = 7").count() == 0  # the earlier version is as it was


def test_tables_change_together(spark, tmp_path, monkeypatch):
    ledger = L.Ledger(spark, str(tmp_path), TABLES)
    upsert(ledger, spark, {"one": rows(spark, 0, 50), "two": rows(spark, 0, 50)}, 1)
    for broken in ("_write", "_publish"):
        true, calls = getattr(L.Ledger, broken), []

        def fails(self, *args, true=true, calls=calls):
            calls.append(args)
            if len(calls) == (2 if true.__name__ == "_write" else 1):
                raise RuntimeError("crash")
            return true(self, *args)

        monkeypatch.setattr(L.Ledger, broken, fails)
        with pytest.raises(RuntimeError, match="crash"):
            upsert(ledger, spark, {"one": rows(spark, 0, 80), "two": rows(spark, 0, 80)}, 2)
        monkeypatch.setattr(L.Ledger, broken, true)
        at = ledger.version()
        assert at.number == 0
        assert {(t, r.n, r["count"]) for t in TABLES for r in at.read(t).groupBy("n").count().collect()} == {("one", 1, 50), ("two", 1, 50)}
    at = upsert(ledger, spark, {"one": rows(spark, 0, 80), "two": rows(spark, 0, 80)}, 2)
    assert at.number == 1 and all(at.read(t).where("n = 2").count() == at.rows(t) == 80 for t in TABLES)


def test_versions_are_kept_and_forgotten(spark, tmp_path):
    ledger = L.Ledger(spark, str(tmp_path), TABLES, keep=2)
    for n in range(5):
        upsert(ledger, spark, {"one": rows(spark, 0, 40)}, n)
    assert [ledger.version(v).read("one").agg(F.max("n")).head()[0] for v in (3, 4)] == [3, 4]
    with pytest.raises(ValueError, match="not kept"):
        ledger.version(1)
    assert len(files(tmp_path)) == 16  # two versions of eight buckets
    base = ledger.version(4)
    emptied = ledger.commit(base, {"one": (rows(spark, 0, 0), None)})
    assert emptied.read("one").count() == 0 and emptied.read("two").count() == 0
    with pytest.raises(L.StaleVersion):
        ledger.commit(base, {"one": (rows(spark, 0, 3), None)})
    with pytest.raises(ValueError, match="not replaced"):
        ledger.commit(emptied, {"one": (rows(spark, 0, 40), [0])})
    assert ledger.version().number == emptied.number


# --- the cascade ----------------------------------------------------------------------


def scored(spark, limit=60):
    return I.scored_pairs(spark, SMALL).where("rank <= 4").orderBy("pair_id").limit(limit).cache()


def candidates(pairs, runs=("r1",)):
    return pairs.select(
        "subject_id", "a_id", "b_id", "rank", "with_context", F.lit(False).alias("human_asserted"),
        F.explode(F.array(*map(F.lit, runs))).alias("stage3_run_id"), F.lit("in").alias("intake_id"),
    )


def make(spark, pairs, runs=("r1",), cap=3, mode="CASCADE", answered=None, live=True):
    given = pairs.select("a_id", "b_id", "g1", "g2", "g3", "grounded_fwd", "grounded_bwd")
    text = settings.canonical_json(settings.snapshot(max_llm_pairs=cap))
    table = G.run_table(spark.createDataFrame(
        [(r, f"req-{r}", "subject", mode, 1, text) for r in runs],
        "stage3_run_id string, run_request_id string, subject_id string, judge_mode string, attempt int, snapshot string",
    ))

    def score(fresh):
        return fresh.select("pair_id", "a_id", "b_id").join(given, ["a_id", "b_id"]).drop("a_id", "b_id")

    def answer(prompts):
        if answered is not None:
            answered.append(prompts.count())
        return prompts.select(
            "pair_id", F.lit('[{"relation":"NEUTRAL","confidence":0.7}]').alias("answer"),
            F.lit(100).alias("prompt_tokens"), F.lit(10).alias("output_tokens"), F.lit(None).cast("string").alias("error"),
        )

    claims = I.load(spark, SMALL, "documents").select(F.col("doc_id").cast("string").alias("claim_id"), "text")
    return C.Cascade(runs=table, score=score, answer=answer, cards=H.claim_cards(claims), live=live)


def contents(version, drop=("created_at", "updated_at", "intake_id")):
    out = {}
    for name in version.tables:
        df = version.read(name)
        for column, kind in df.dtypes:
            if kind == "double":  # sums of several batches may differ in the last digit
                df = df.withColumn(column, F.round(column, 9))
        df = df.select(F.to_json(F.struct(*[c for c in sorted(df.columns) if c not in drop]), {"ignoreNullFields": "false"}).alias("row"))
        out[name] = sorted(r.row for r in df.collect())
    return out


def test_one_job_equals_the_gates_one_by_one(spark, tmp_path):
    pairs = scored(spark)
    job = make(spark, pairs)
    at = C.advance(C.open_ledger(spark, str(tmp_path / "l"), 8), candidates(pairs), job, now())
    state = C.P.seed_pairs(spark.createDataFrame([], schemas.PAIR_STATE), candidates(pairs))
    scores = job.score(state)
    edges, seen = spark.createDataFrame([], schemas.EDGES), {}
    for gate in V.GATES:
        if gate == V.G3:
            result = G.run_g3(state, edges, scores, job.runs)
        elif gate == V.G4:
            prompts = G.tail_prompts(G.tail_calls(state, job.runs), job.cards, job.rubric)
            result = G.run_g4(state, job.answer(prompts), job.runs, live=True)
        else:
            result = G.runner_for(gate)(state, scores, job.runs)
        row = result.counters.drop("stage3_run_id").head()
        seen.update({(gate, k): float(v) for k, v in (row.asDict() if row else {}).items()})
        edges = spark.createDataFrame(C.E.merge_edges(edges, result.edges, now()).collect(), schemas.EDGES)
        state = spark.createDataFrame(result.state.collect(), schemas.PAIR_STATE)
    assert sorted(map(str, at.read("pairs").collect())) == sorted(map(str, state.collect()))
    assert sorted(map(str, at.read("edges").collect())) == sorted(map(str, edges.collect()))
    assert {(r.gate, r.name): r.value for r in at.read("counters").collect()} == seen
    totals, refused = C.finalized(at)
    want, _ = C.RN.finalize(state)
    assert [r.asDict() for r in totals.drop("llm_spend_usd").collect()] == [r.asDict() for r in want.drop("llm_spend_usd").select(*totals.drop("llm_spend_usd").columns).collect()]
    assert refused.count() == 0 and C.check(at).count() == 0
    assert seen[V.G4, "decided"] == 3 and seen[V.G4, "capExceeded"] > 0 and len({g for g, _ in seen}) == 4


def test_repeats_change_nothing(spark, tmp_path):
    pairs, answered = scored(spark), []
    job = make(spark, pairs, answered=answered)
    ledger = C.open_ledger(spark, str(tmp_path), 8)
    first = C.advance(ledger, candidates(pairs), job, now(), writer="w", batch=0)
    before, on_disk = contents(first, ()), files(tmp_path)
    assert C.advance(ledger, candidates(pairs), job, now(), writer="w", batch=0).number == first.number
    assert C.advance(ledger, candidates(pairs), job, now(), writer="w", batch=1).number == first.number  # no new pair
    assert contents(ledger.version(), ()) == before and files(tmp_path) == on_disk and answered == [3]
    # A run that starts over ends as it did, and pays again.
    restart = spark.createDataFrame([("r1",)], "stage3_run_id string")
    again = C.advance(ledger, candidates(pairs), job, now(), restart=restart)
    assert again.number == first.number + 1 and contents(again, ()) == before and answered == [3, 3]
    none = candidates(pairs).where("false")
    assert C.advance(ledger, none, job, now()).number == again.number


def test_a_crash_between_any_two_writes_leaves_the_last_version(spark, tmp_path, monkeypatch):
    pairs = scored(spark)
    job = make(spark, pairs, cap=0)
    half = pairs.where("a_doc % 2 = 0")
    want = C.advance(C.open_ledger(spark, str(tmp_path / "whole"), 4), candidates(pairs), job, now())
    ledger = C.open_ledger(spark, str(tmp_path / "crashes"), 4)
    before = C.advance(ledger, candidates(half), job, now(), writer="w", batch=0)
    held = contents(before)
    true_write, true_publish = L.Ledger._write, L.Ledger._publish
    for crash in range(5):
        calls = []

        def step(true):
            def run(self, *args):
                if len(calls) == crash:
                    raise RuntimeError("crash")
                calls.append(1)
                return true(self, *args)
            return run

        monkeypatch.setattr(L.Ledger, "_write", step(true_write))
        monkeypatch.setattr(L.Ledger, "_publish", step(true_publish))
        with pytest.raises(RuntimeError, match="crash"):
            C.advance(ledger, candidates(pairs), job, now(), writer="w", batch=1)
        assert len(calls) == crash and ledger.version().number == before.number
    assert contents(ledger.version()) == held
    monkeypatch.setattr(L.Ledger, "_write", true_write)
    monkeypatch.setattr(L.Ledger, "_publish", true_publish)
    after = C.advance(ledger, candidates(pairs), job, now(), writer="w", batch=1)
    assert contents(after) == contents(want) and C.check(after).count() == 0


def test_budget_is_kept_over_batches(spark, tmp_path):
    pairs = scored(spark)
    job, ledger = make(spark, pairs, cap=5), C.open_ledger(spark, str(tmp_path), 4)
    for part in range(3):
        at = C.advance(ledger, candidates(pairs.where(f"a_doc % 3 = {part}")), job, now())
    paid = at.read("counters").where(f"gate = '{V.G4}' AND name = 'decided'").head()
    assert paid.value == 5 and at.read("pairs").where(f"decided_by = '{V.METHOD_G4}'").count() == 5
    assert C.check(at).count() == 0


def test_dry_answers_and_missing_texts_stop_before_anything_is_written(spark, tmp_path):
    pairs = scored(spark)
    ledger = C.open_ledger(spark, str(tmp_path / "l"), 4)
    with pytest.raises(Exception, match="dry-run answers"):
        C.advance(ledger, candidates(pairs), make(spark, pairs, live=False), now())
    lookup = H.claim_lookup(I.load(spark, SMALL, "documents").where("doc_id > 40").select(F.col("doc_id").cast("string").alias("claim_id"), "text"))
    score = C.text_scores(lookup, S.Roster("r", "m", "m", "m"), None, str(tmp_path / "scores"))
    job = C.Cascade(runs=make(spark, pairs).runs, score=score)
    with pytest.raises(Exception, match="no claim text"):
        C.advance(ledger, candidates(pairs), job, now())
    assert ledger.version().number == -1
    shadow = C.advance(ledger, candidates(pairs), make(spark, pairs, live=False, mode="SHADOW"), now())
    kinds = {r["verdict"] for r in shadow.read("edges").select("shadow.verdict").distinct().collect()}
    assert V.WOULD_ESCALATE in kinds and shadow.read("edges").where("relation IS NOT NULL").count() == 0


def test_a_stream_ends_where_one_job_does(spark, tmp_path, monkeypatch):
    """Two runs over the same pairs, files arriving one by one, a crash and a restart."""
    pairs, both = scored(spark, 40), ("r1", "r2")
    job = make(spark, pairs, both, cap=0)
    every = candidates(pairs, both)
    for n in range(3):
        every.where(F.col("rank") % 3 == n).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    ledger = C.open_ledger(spark, str(tmp_path / "l"), 8)

    def start():
        stream = spark.readStream.schema(every.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        continuous.start_cascade(stream, str(tmp_path / "check"), ledger, job, clock=lambda batch: now()).awaitTermination()

    true, calls = L.Ledger._publish, []

    def fails(self, *args):
        calls.append(1)
        if len(calls) == 2:
            raise RuntimeError("crash")
        return true(self, *args)

    monkeypatch.setattr(L.Ledger, "_publish", fails)
    with pytest.raises(Exception, match="crash"):
        start()
    monkeypatch.setattr(L.Ledger, "_publish", true)
    start()
    start()
    whole = C.advance(C.open_ledger(spark, str(tmp_path / "whole"), 8), every, job, now())
    got, want = contents(ledger.version()), contents(whole)
    assert {n: got[n] for n in ("pairs", "counters", "edges")} == {n: want[n] for n in ("pairs", "counters", "edges")}
    assert [json.loads(r)["pairs_seen"] for r in got["totals"]] == [40, 40] and C.check(ledger.version()).count() == 0
    assert ledger.version().read("edges").count() == 40 and ledger.version().batches == {"stream": 2}
