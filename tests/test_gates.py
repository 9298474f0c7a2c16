import pytest
from pyspark.sql import functions as F

from helpers import CONTRADICTORY, NEUTRAL, REPEATS, UNDECIDED, score_table, scores
from verdictflow import schemas, vocab as V
from verdictflow.functions import keys, settings
from verdictflow.operators import edges as E, pairs as P, runs as RN
from verdictflow.plans import gates as G

def as_of():
    return F.lit("2024-01-02").cast("timestamp")


def run_rows(spark, mode="CASCADE", cap=3000, run="run"):
    text = settings.canonical_json(settings.snapshot(max_llm_pairs=cap))
    return G.run_table(spark.createDataFrame(
        [(run, "req", "subject", mode, 1, text)],
        "stage3_run_id string, run_request_id string, subject_id string, judge_mode string, attempt int, snapshot string",
    ))


def start(spark, ids, with_context=()):
    rows = [("subject", f"a{i}", f"b{i}", n, i in with_context, None, "run", "in") for n, i in enumerate(ids)]
    candidates = spark.createDataFrame(
        rows, "subject_id string, a_id string, b_id string, rank int, with_context boolean, "
        "human_asserted boolean, stage3_run_id string, intake_id string",
    )
    return P.seed_pairs(spark.createDataFrame([], schemas.PAIR_STATE), candidates)


def score(spark, rows):
    table = score_table(spark, rows).withColumn("pair_id", F.concat(F.lit("run|a"), "pair_id", F.lit("|b"), "pair_id"))
    return table.withColumns({
        "grounded_fwd": F.col("g2.grounded"), "grounded_bwd": F.lit(None).cast(schemas.GROUNDING),
    })


ROWS = [
    scores("0", NEUTRAL), scores("1", REPEATS), scores("2", CONTRADICTORY, b=CONTRADICTORY),
    scores("3", UNDECIDED, sup=(0.95, 0.1, None)), scores("4", UNDECIDED, sup=(0.2, 0.1, 0.97)),
    scores("5", NEUTRAL, ctx=(0.55, 0.44, 0.01)), scores("6", UNDECIDED, b=CONTRADICTORY),
    scores("7", (0.01, 0.94, 0.05), b=NEUTRAL), scores("8", (0.0, 0.9, 0.0), b=NEUTRAL),
]


def chain(spark, mode="CASCADE"):
    """G1, G2, G3 one after the other, merging verdict rows in between."""
    runs, table = run_rows(spark, mode), score(spark, ROWS)
    state = start(spark, range(9), {5})
    edges = spark.createDataFrame([], schemas.EDGES)
    counters = []
    for gate in (V.G1, V.G2, V.G3):
        if gate == V.G3:
            result = G.run_g3(state, edges, table, runs)
        else:
            result = G.runner_for(gate)(state, table, runs)
        counters.append(result.counters.head())
        edges = spark.createDataFrame(
            E.merge_edges(edges, result.edges, as_of()).collect(), schemas.EDGES
        )
        state = spark.createDataFrame(result.state.collect(), schemas.PAIR_STATE)
    return state, edges, counters


@pytest.mark.parametrize("mode", ["CASCADE", "SHADOW"])
def test_fused_job_equals_gate_by_gate(spark, mode):
    state, edges, counters = chain(spark, mode)
    result, fused = G.judge_pairs(start(spark, range(9), {5}), score(spark, ROWS), run_rows(spark, mode))
    merged = E.merge_edges(spark.createDataFrame([], schemas.EDGES), result.edges, as_of(), combined=True)
    order = state.columns
    assert sorted(state.collect(), key=str) == sorted(result.state.select(*order).collect(), key=str)
    assert sorted(edges.collect(), key=str) == sorted(merged.collect(), key=str)
    assert counters == [fused[g].head() for g in (V.G1, V.G2, V.G3)]


def test_counters_and_totals(spark):
    state, _, (one, two, three) = chain(spark)
    assert one.asDict() == {
        "stage3_run_id": "run", "seen": 9, "neutral": 1, "repeats": 1, "contraFlagged": 2,
        "forwarded": 6, "truncated": 0, "ctxDisagreed": 1,
    }
    # flagged pairs are handed on without being seen
    assert (two["seen"], two["corroborates"], two["flaggedPassThrough"], two["forwarded"], two["grounded"]) == (4, 2, 2, 4, 1)
    assert (three["seen"], three["humanRouted"]) == (4, 1)
    total = RN.tally(state).head()
    assert total["stranded"] == 2 and not total["reconciles"]
    assert RN.finalize(state)[1].count() == 1


def answers(spark, rows):
    return spark.createDataFrame(rows, "pair_id string, answer string, prompt_tokens int, output_tokens int, error string")


def test_tail(spark):
    state, _, _ = chain(spark)
    tail = [r["pair_id"] for r in state.where("gate = 'G4_ESCALATION'").orderBy("rank", "pair_id").collect()]
    assert len(tail) == 2
    good = '[{"relation":"NEUTRAL","confidence":0.7,"rationale":"why"}]'
    table = answers(spark, [(tail[0], good, 1_000_000, 500_000, None), (tail[1], good, 10, 10, None)])
    result = G.run_g4(state, table, run_rows(spark, cap=1), live=True)
    counted = result.counters.head()
    assert (counted["seen"], counted["decided"], counted["capExceeded"], counted["llmCalls"]) == (2, 1, 1, 1)
    assert counted["llmSpendUsd"] == pytest.approx(0.10 + 0.20)
    totals, refused = RN.finalize(result.state)
    assert refused.count() == 0 and totals.head()["pairs_seen"] == 9
    reasons = {r["key"]: r["escalation_reason"] for r in result.edges.collect()}
    assert sorted(str(v) for v in reasons.values()) == ["CAP_EXCEEDED", "None"]
    failed = G.run_g4(state, answers(spark, [(tail[0], "no", 1, 1, None)]), run_rows(spark, cap=0), live=True)
    assert failed.counters.head()["llmError"] == 2
    shadow = G.run_g4(state, table, run_rows(spark, "SHADOW"), live=False)
    assert shadow.counters.head()["shadowSuppressed"] == 2 and shadow.counters.head()["llmCalls"] == 0
    assert {r["shadow"]["verdict"] for r in shadow.edges.collect()} == {V.WOULD_ESCALATE}
    with pytest.raises(Exception, match="dry-run"):
        G.run_g4(state, table, run_rows(spark), live=False).state.collect()


def test_missing_scores_stop_or_are_set_aside(spark):
    state, table = start(spark, range(3)), score(spark, ROWS[:2])
    with pytest.raises(Exception, match="run.a2.b2"):
        G.judge_pairs(state, table, run_rows(spark))[0].state.collect()
    result, _ = G.judge_pairs(state, table, run_rows(spark), on_missing="reject")
    assert [r["pair_id"] for r in result.rejects.collect()] == ["run|a2|b2"]
    assert result.state.count() == 3 and result.state.where("gate = 'G1_NEUTRAL'").count() == 1


def test_seed_reset_and_other_runs(spark):
    state = start(spark, range(3))
    assert P.seed_pairs(state, spark.createDataFrame(
        [("s", "b1", "a1", 0, False, None, "run", "in"), ("s", "x", "y", 5, None, None, "run", "in"),
         ("s", "y", "x", 2, None, None, "run", "in"), ("s", "", "y", 2, None, None, "run", "in")],
        "subject_id string, a_id string, b_id string, rank int, with_context boolean, human_asserted boolean, "
        "stage3_run_id string, intake_id string",
    )).select("pair_id", "rank").collect() == [("run|x|y", 2)]
    moved = state.withColumns({"gate": F.lit(None).cast("string"), "tier": F.lit(V.TIER_HUMAN)})
    assert P.reset_pairs(moved, "run").where("gate = 'G1_NEUTRAL' AND tier = 'CASCADE'").count() == 3
    assert P.reset_pairs(moved, "other").where("gate IS NULL").count() == 3
    # a job over other runs leaves this run's pairs alone
    result, _ = G.judge_pairs(state, score(spark, ROWS), run_rows(spark, run="elsewhere"))
    assert result.state.where("gate = 'G1_NEUTRAL'").count() == 3


def test_claiming_and_guarded_routes(spark):
    state = start(spark, range(4)).withColumns({
        "lease_owner": F.lit("w"), "lease_expires_at": F.when(F.col("rank") == 0, as_of() + F.expr("INTERVAL 1 HOUR")),
    })
    batch = P.claim_batch(state, "run", V.G1, 2, as_of())
    assert [r["rank"] for r in batch.collect()] == [1, 2]
    route = F.struct(
        F.lit(V.G2).alias("gate"), F.lit("CASCADE").alias("tier"), F.lit(None).cast("string").alias("decided_by"),
        F.lit(False).alias("contradiction_flag"), F.lit("req").alias("run_request_id"),
    )
    updates = state.where("rank < 3").select(
        "pair_id", F.lit(V.G1).alias("claimed_gate"),
        F.when(F.col("rank") < 2, "w").otherwise("someone").alias("claimed_owner"), route.alias("route"),
    )
    routed = {r["rank"]: r for r in P.guarded_routes(state, updates).collect()}
    assert [routed[i]["gate"] for i in range(4)] == [V.G2, V.G2, V.G1, V.G1]
    assert [routed[i]["applied"] for i in range(4)] == [True, True, False, None]
    assert routed[0]["lease_owner"] is None and routed[2]["lease_owner"] == "w"


def test_tally_order(spark):
    rows = [
        ("r", None, "CASCADE", V.METHOD_G1), ("r", None, "CASCADE", V.METHOD_G3), ("r", None, "LLM_TAIL", V.METHOD_G4),
        ("r", None, "HUMAN", None), ("s", "G2_CORROBORATION", "HUMAN", None), ("s", None, "CASCADE", None),
        ("t", None, "LLM_TAIL", None),
    ]
    got = {r["stage3_run_id"]: r for r in RN.tally(spark.createDataFrame(
        rows, "stage3_run_id string, gate string, tier string, decided_by string"
    )).collect()}
    assert (got["r"]["decided_by_gates"], got["r"]["escalated_llm"], got["r"]["escalated_human"]) == (2, 1, 1)
    assert got["r"]["reconciles"] and got["s"]["stranded"] == 2 and not got["s"]["reconciles"]
    assert got["t"]["escalated_llm"] == 1


def test_merge_keeps_what_an_update_does_not_set(spark):
    judged = spark.createDataFrame(
        [("b", "a", False, "s", "in", "run", "req")],
        "a_id string, b_id string, with_context boolean, subject_id string, intake_id string, stage3_run_id string, run_request_id string",
    )
    slot = F.struct(*[F.lit(0.5).alias(n) for n in schemas.G1_SLOT.fieldNames()])
    none = F.lit(None).cast("string")
    first = E.edge_updates(judged, method=V.METHOD_G1, slot=("g1", slot), relation=none,
                           escalation_reason=F.lit("CONTEXT_DISAGREEMENT"), judge_model=F.lit("one"))
    later = E.edge_updates(judged, method=V.METHOD_G2, slot=None, relation=F.lit("CORROBORATES"),
                           confidence=F.lit(0.9), judge_model=F.lit("two"), seq=2)
    empty = spark.createDataFrame([], schemas.EDGES)
    stored = E.merge_edges(empty, first, F.lit("2024-01-01").cast("timestamp"))
    row = E.merge_edges(stored, later, as_of()).head()
    assert row["key"] == "a|b|bare|GK" and row["method"] == V.METHOD_G2 and row["judge_model"] == "two"
    assert row["relation"] == "CORROBORATES" and row["escalation_reason"] == "CONTEXT_DISAGREEMENT"
    assert row["stage_scores"]["g1"]["ctx_delta"] == 0.5 and row["stage_scores"]["g2"] is None
    assert row["created_at"] < row["updated_at"]
    # both in one batch give the same row
    both = E.merge_edges(empty, first.unionByName(later), as_of()).head()
    assert both["relation"] == "CORROBORATES" and both["stage_scores"] == row["stage_scores"]
    # under shadow, a later update writes every field, null included
    s1 = E.edge_updates(judged, method=V.METHOD_G1, slot=("g1", slot), relation=F.lit("NEUTRAL"), mode=F.lit("SHADOW"))
    s2 = E.edge_updates(judged, method=V.METHOD_G2, slot=None, relation=none, mode=F.lit("SHADOW"), seq=2)
    shadow = E.merge_edges(E.merge_edges(empty, s1, as_of()), s2, as_of()).head()
    assert shadow["shadow"]["verdict"] is None and shadow["relation"] is None
    assert shadow["shadow"]["stage_scores"]["g1"]["ent_fwd"] == 0.5
    assert E.purge_edges(stored, "run").count() == 0 and E.purge_edges(stored, "other").count() == 1


def test_keys(spark):
    row = spark.createDataFrame([("10", "9")], "a string, b string").select(
        keys.pair_key(F.lit("r"), "a", "b"), keys.edge_key("b", "a", F.lit(True)), keys.contexted("a", F.lit(""))
    ).head()
    assert tuple(row) == ("r|10|9", "10|9|ctx|GK", "10")


def test_registry():
    table = dict(G.RUNNERS)
    G.register(V.G1, "job", table)
    assert G.runner_for(V.G1, table) == "job" and G.runner_for(V.G1) is G.run_g1
    with pytest.raises(ValueError):
        G.register("G9", "job", table)


def test_chained_gates_read_the_pairs_once_each(spark, tmp_path):
    """The first pair table is scanned once per gate of the chain, not once per branch and gate."""
    from catalog import inputs as I

    scored = I.scored_pairs(spark, "/root/testdata/sf0.001")
    I.start_state(scored).write.parquet(str(tmp_path / "pairs"))
    scores = I.scores_of(scored)
    runs = G.run_table(I.runs(spark, "/root/testdata/sf0.001"))

    def scans(df):
        text = df._jdf.queryExecution().optimizedPlan().toString()
        return sum("contradiction_flag" in line and "parquet" in line for line in text.splitlines())

    state, seen = spark.read.parquet(str(tmp_path / "pairs")), []
    for job in (G.run_g1, G.run_g2):
        state = job(state, scores, runs).state
        seen.append(scans(state))
    assert seen == [1, 1]
