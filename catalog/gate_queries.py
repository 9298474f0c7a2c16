"""Decisions, routing, gates and totals."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import inputs as I
from catalog.registry import query
from verdictflow import vocab as V
from verdictflow.functions import decisions as D, routing as R
from verdictflow.functions.cols import struct_of
from verdictflow.operators import pairs as P, runs as RN
from verdictflow.plans import gates as G


def _text(name):
    return F.coalesce(F.col(name), F.lit("-"))


def _number(name):
    return F.round(F.coalesce(F.col(name), F.lit(-1.0)), 6)


def _features(spark, sf):
    scored = I.scored_pairs(spark, sf)
    f = D.cascade_features(F.col("g1"), F.col("g2"), F.col("g3"))
    return scored.select(
        "pair_id", "g1", "g2", "g3", *[f[name].alias(name) for name in D.FEATURES]
    )


@query("decide_g1", f"""WITH {I.CASCADE_SQL}
SELECT pair_id, d1 AS disposition, coalesce(CASE WHEN d1 = 'DECIDED' THEN bare END, '-') AS verdict,
  coalesce(CASE WHEN d1 = 'ESCALATE_G4' THEN 'CONTEXT_DISAGREEMENT' END, '-') AS reason,
  flag, trunc_a AS truncated, round(a_contra, 6) AS max_contradiction
FROM c""")
def decide_g1(spark, sf):
    rows = _features(spark, sf).withColumn("d", D.decide_g1(D.feature_columns()))
    return rows.select(
        "pair_id", "d.disposition", _text("d.verdict").alias("verdict"),
        _text("d.escalation_reason").alias("reason"), F.col("d.contradiction_flag").alias("flag"),
        D.g1_truncated(F.col("g1")).alias("truncated"),
        F.round("a_contra", 6).alias("max_contradiction"),
    )


@query("decide_g2", f"""WITH {I.CASCADE_SQL}
SELECT pair_id, d2 AS disposition, CASE WHEN d2 = 'DECIDED' THEN direction ELSE '-' END AS direction,
  round(CASE WHEN d2 = 'DECIDED' THEN support ELSE -1 END, 6) AS confidence, below_floor,
  trunc_s AS truncated
FROM c""")
def decide_g2(spark, sf):
    rows = _features(spark, sf).withColumn("d", D.decide_g2(D.feature_columns()))
    return rows.select(
        "pair_id", "d.disposition", _text("d.direction").alias("direction"),
        _number("d.confidence").alias("confidence"), "d.below_floor",
        D.g2_truncated(F.col("g2")).alias("truncated"),
    )


@query("decide_g3", f"""WITH {I.CASCADE_SQL}
SELECT pair_id, d3 AS disposition, CASE WHEN d3 = 'DECIDED' THEN 'NEUTRAL' ELSE '-' END AS verdict,
  CASE d3 WHEN 'ROUTE_HUMAN' THEN 'CONTRADICTION_SIGNAL' WHEN 'ESCALATE_G4' THEN 'STAGE_DISAGREEMENT'
    ELSE '-' END AS reason,
  round(CASE WHEN d3 = 'ROUTE_HUMAN' THEN least(a_contra, b_contra) ELSE -1 END, 6) AS confidence,
  d3 = 'ROUTE_HUMAN' AS flag, trunc_a OR trunc_b AS truncated,
  CASE d3 WHEN 'ROUTE_HUMAN' THEN 'CONTRADICTS' WHEN 'DECIDED' THEN 'NEUTRAL' ELSE '-' END AS relation
FROM c""")
def decide_g3(spark, sf):
    rows = _features(spark, sf).withColumn("d", D.decide_g3(D.feature_columns()))
    return rows.select(
        "pair_id", "d.disposition", _text("d.verdict").alias("verdict"),
        _text("d.escalation_reason").alias("reason"), _number("d.confidence").alias("confidence"),
        F.col("d.contradiction_flag").alias("flag"),
        D.g3_truncated(F.col("g1"), F.col("g3")).alias("truncated"),
        F.coalesce(R.edge_relation_g3(F.col("d")), F.lit("-")).alias("relation"),
    )


@query("cascade", f"""WITH {I.CASCADE_SQL}
SELECT pair_id, at_gate AS gate, disposition, coalesce(verdict, '-') AS verdict,
  coalesce(reason, '-') AS reason, round(coalesce(confidence, -1), 6) AS confidence,
  CASE WHEN at_gate = 'G2_CORROBORATION' THEN false ELSE flag OR (at_gate = 'G3_CONTRADICTION' AND d3 = 'ROUTE_HUMAN') END AS flag
FROM c""")
def cascade(spark, sf):
    features = _features(spark, sf).withColumnRenamed("direction", "from")
    f = {**D.feature_columns(), "direction": F.col("from")}
    return D.with_cascade(features, f).select(
        "pair_id", "gate", "disposition", _text("verdict").alias("verdict"),
        _text("escalation_reason").alias("reason"), _number("confidence").alias("confidence"),
        F.col("contradiction_flag").alias("flag"),
    )


@query("routing", f"""WITH {I.CASCADE_SQL}
SELECT pair_id,
  CASE d1 WHEN 'FORWARD' THEN 'G2_CORROBORATION' WHEN 'ESCALATE_G4' THEN 'G4_ESCALATION' ELSE '-' END AS g1_gate,
  CASE d1 WHEN 'ESCALATE_G4' THEN 'LLM_TAIL' ELSE 'CASCADE' END AS g1_tier,
  CASE d1 WHEN 'DECIDED' THEN 'GK_G1_NLI' ELSE '-' END AS g1_by, flag AS g1_flag,
  CASE d2 WHEN 'FORWARD' THEN 'G3_CONTRADICTION' ELSE '-' END AS g2_gate,
  CASE d2 WHEN 'DECIDED' THEN 'GK_G2_GROUNDING' ELSE '-' END AS g2_by,
  CASE d3 WHEN 'ESCALATE_G4' THEN 'G4_ESCALATION' ELSE '-' END AS g3_gate,
  CASE d3 WHEN 'ROUTE_HUMAN' THEN 'HUMAN' WHEN 'DECIDED' THEN 'CASCADE' ELSE 'LLM_TAIL' END AS g3_tier,
  CASE d3 WHEN 'DECIDED' THEN 'GK_G3_XCHECK' ELSE '-' END AS g3_by,
  flag OR d3 = 'ROUTE_HUMAN' AS g3_flag
FROM c""")
def routing(spark, sf):
    f = D.feature_columns()
    rows = _features(spark, sf).withColumns({
        "d1": D.decide_g1(f), "d2": D.decide_g2(f), "d3": D.decide_g3(f),
    })
    flag = F.col("d1.contradiction_flag")
    rows = rows.withColumns({
        "r1": struct_of(R.route_g1(F.col("d1"))), "r2": struct_of(R.route_g2(F.col("d2"), flag)),
        "r3": struct_of(R.route_g3(F.col("d3"), flag)),
    })
    return rows.select(
        "pair_id",
        _text("r1.gate").alias("g1_gate"), F.col("r1.tier").alias("g1_tier"),
        _text("r1.decided_by").alias("g1_by"), F.col("r1.contradiction_flag").alias("g1_flag"),
        _text("r2.gate").alias("g2_gate"), _text("r2.decided_by").alias("g2_by"),
        _text("r3.gate").alias("g3_gate"), F.col("r3.tier").alias("g3_tier"),
        _text("r3.decided_by").alias("g3_by"), F.col("r3.contradiction_flag").alias("g3_flag"),
    )


# State after the first three gates, in SQL.
STATE_SQL = I.CASCADE_SQL + """, state AS (
  SELECT *, CASE WHEN disposition = 'ESCALATE_G4' THEN 'G4_ESCALATION' END AS gate,
    CASE disposition WHEN 'ESCALATE_G4' THEN 'LLM_TAIL' WHEN 'ROUTE_HUMAN' THEN 'HUMAN'
      ELSE 'CASCADE' END AS tier,
    CASE WHEN disposition = 'DECIDED' THEN CASE at_gate WHEN 'G1_NEUTRAL' THEN 'GK_G1_NLI'
      WHEN 'G2_CORROBORATION' THEN 'GK_G2_GROUNDING' ELSE 'GK_G3_XCHECK' END END AS decided_by,
    flag OR (at_gate = 'G3_CONTRADICTION' AND d3 = 'ROUTE_HUMAN') AS contradiction_flag
  FROM c
)"""


def judged(spark, sf):
    scored = I.scored_pairs(spark, sf)
    runs = G.run_table(I.runs(spark, sf))
    return G.judge_pairs(I.start_state(scored), I.scores_of(scored), runs)


def _shown_state(state):
    return state.select(
        "pair_id", _text("gate").alias("gate"), "tier", _text("decided_by").alias("decided_by"),
        F.col("contradiction_flag"), _text("run_request_id").alias("run_request_id"),
    )


@query("judge_pairs", f"""WITH {STATE_SQL}
SELECT pair_id, coalesce(gate, '-') AS gate, tier, coalesce(decided_by, '-') AS decided_by,
  contradiction_flag, 'req-' || run_id AS run_request_id
FROM state""")
def judge_pairs(spark, sf):
    return _shown_state(judged(spark, sf)[0].state)


@query("judge_pairs_edges", f"""WITH {STATE_SQL}
SELECT edge_key AS key, CASE at_gate WHEN 'G1_NEUTRAL' THEN 'GK_G1_NLI'
    WHEN 'G2_CORROBORATION' THEN 'GK_G2_GROUNDING' ELSE 'GK_G3_XCHECK' END AS method,
  coalesce(CASE WHEN disposition = 'ROUTE_HUMAN' THEN 'CONTRADICTS' ELSE verdict END, '-') AS relation,
  coalesce(reason, '-') AS escalation_reason, round(coalesce(confidence, -1), 6) AS confidence,
  CASE at_gate WHEN 'G1_NEUTRAL' THEN trunc_a WHEN 'G2_CORROBORATION' THEN trunc_s ELSE trunc_b END AS truncated,
  at_gate = 'G2_CORROBORATION' OR (at_gate = 'G3_CONTRADICTION' AND NOT flag) AS has_g2,
  at_gate = 'G3_CONTRADICTION' AS has_g3
FROM state""")
def judge_pairs_edges(spark, sf):
    edges = judged(spark, sf)[0].edges
    return edges.select(
        "key", "method", _text("relation").alias("relation"),
        _text("escalation_reason").alias("escalation_reason"),
        _number("confidence").alias("confidence"), "truncated",
        F.col("stage_scores.g2").isNotNull().alias("has_g2"),
        F.col("stage_scores.g3").isNotNull().alias("has_g3"),
    )


def _stack(counters, gate, names):
    rows = F.array(*[
        F.struct(F.lit(name).alias("counter"), F.col(name).cast("long").alias("value"))
        for name in names
    ])
    return counters.select("stage3_run_id", F.lit(gate).alias("gate"), F.inline(rows))


@query("gate_counters", f"""WITH {STATE_SQL}, n AS (
  SELECT run_id, count(*) AS s1,
    count(*) FILTER (d1 = 'DECIDED' AND bare = 'NEUTRAL') AS neutral,
    count(*) FILTER (d1 = 'DECIDED' AND bare = 'REPEATS') AS repeats,
    count(*) FILTER (flag) AS contra, count(*) FILTER (d1 = 'FORWARD') AS fwd,
    count(*) FILTER (trunc_a) AS t1, count(*) FILTER (d1 = 'ESCALATE_G4') AS ctx,
    count(*) FILTER (d1 = 'FORWARD' AND NOT flag) AS s2,
    count(*) FILTER (at_gate = 'G2_CORROBORATION') AS corr,
    count(*) FILTER (at_gate = 'G3_CONTRADICTION') AS fwd2,
    count(*) FILTER (d1 = 'FORWARD' AND NOT flag AND sup_grounded IS NOT NULL) AS grounded,
    count(*) FILTER (d1 = 'FORWARD' AND NOT flag AND trunc_s) AS t2,
    count(*) FILTER (at_gate = 'G3_CONTRADICTION' AND d3 = 'DECIDED') AS n3,
    count(*) FILTER (at_gate = 'G3_CONTRADICTION' AND d3 = 'ROUTE_HUMAN') AS h3c,
    count(*) FILTER (at_gate = 'G3_CONTRADICTION' AND d3 = 'ESCALATE_G4') AS e3,
    count(*) FILTER (at_gate = 'G3_CONTRADICTION' AND trunc_b) AS t3
  FROM state GROUP BY run_id
)
SELECT run_id AS stage3_run_id, gate, counter, CAST(value AS BIGINT) AS value FROM (
  SELECT run_id, 'G1_NEUTRAL' AS gate, unnest(['seen','neutral','repeats','contraFlagged','forwarded','truncated','ctxDisagreed']) AS counter,
    unnest([s1, neutral, repeats, contra, fwd, t1, ctx]) AS value FROM n
  UNION ALL SELECT run_id, 'G2_CORROBORATION', unnest(['seen','corroborates','forwarded','grounded','flaggedPassThrough','truncated']),
    unnest([s2, corr, fwd2, grounded, contra, t2]) FROM n WHERE fwd > 0
  UNION ALL SELECT run_id, 'G3_CONTRADICTION', unnest(['seen','neutral','humanRouted','escalated','truncated']),
    unnest([fwd2, n3, h3c, e3, t3]) FROM n WHERE fwd2 > 0
)""")
def gate_counters(spark, sf):
    counters = judged(spark, sf)[1]
    return P.union_all([
        _stack(counters[V.G1], V.G1, V.G1_COUNTERS),
        _stack(counters[V.G2], V.G2, V.G2_COUNTERS),
        _stack(counters[V.G3], V.G3, V.G3_COUNTERS),
    ])


def _gate_runs(spark, sf):
    """The first two gates one after the other, on the pair table."""
    scored = I.scored_pairs(spark, sf)
    runs = G.run_table(I.runs(spark, sf))
    scores = I.scores_of(scored)
    one = G.run_g1(I.start_state(scored), scores, runs)
    return one, G.run_g2(one.state, scores, runs), scores, runs


@query("run_g1", f"""WITH {I.CASCADE_SQL}
SELECT pair_id, CASE d1 WHEN 'FORWARD' THEN 'G2_CORROBORATION' WHEN 'ESCALATE_G4' THEN 'G4_ESCALATION' ELSE '-' END AS gate,
  CASE d1 WHEN 'ESCALATE_G4' THEN 'LLM_TAIL' ELSE 'CASCADE' END AS tier,
  CASE d1 WHEN 'DECIDED' THEN 'GK_G1_NLI' ELSE '-' END AS decided_by, flag AS contradiction_flag,
  'req-' || run_id AS run_request_id
FROM c""")
def run_g1(spark, sf):
    return _shown_state(_gate_runs(spark, sf)[0].state)


@query("g2_pass_through", f"""WITH {I.CASCADE_SQL}
SELECT pair_id, CASE WHEN d1 = 'ESCALATE_G4' THEN 'G4_ESCALATION' WHEN at_gate = 'G3_CONTRADICTION' THEN 'G3_CONTRADICTION' ELSE '-' END AS gate,
  CASE d1 WHEN 'ESCALATE_G4' THEN 'LLM_TAIL' ELSE 'CASCADE' END AS tier,
  CASE WHEN d1 = 'DECIDED' THEN 'GK_G1_NLI' WHEN at_gate = 'G2_CORROBORATION' THEN 'GK_G2_GROUNDING' ELSE '-' END AS decided_by,
  flag AS contradiction_flag, 'req-' || run_id AS run_request_id
FROM c""")
def g2_pass_through(spark, sf):
    return _shown_state(_gate_runs(spark, sf)[1].state)


@query("run_g3", f"""WITH {STATE_SQL}
SELECT pair_id, coalesce(gate, '-') AS gate, tier, coalesce(decided_by, '-') AS decided_by,
  contradiction_flag, 'req-' || run_id AS run_request_id
FROM state""")
def run_g3(spark, sf):
    from verdictflow import schemas
    from verdictflow.operators.edges import merge_edges

    one, two, scores, runs = _gate_runs(spark, sf)
    edges = merge_edges(
        spark.createDataFrame([], schemas.EDGES), one.edges,
        F.lit("2024-01-01").cast("timestamp"), combined=True,
    )
    return _shown_state(G.run_g3(two.state, edges, scores, runs).state)


@query("reset_run", f"""WITH {STATE_SQL}, first_run AS (SELECT min(source) AS run FROM documents)
SELECT pair_id, CASE WHEN run_id = run THEN 'G1_NEUTRAL' ELSE coalesce(gate, '-') END AS gate,
  CASE WHEN run_id = run THEN 'CASCADE' ELSE tier END AS tier,
  CASE WHEN run_id = run THEN '-' ELSE coalesce(decided_by, '-') END AS decided_by,
  CASE WHEN run_id = run THEN false ELSE contradiction_flag END AS contradiction_flag,
  CASE WHEN run_id = run THEN '-' ELSE 'req-' || run_id END AS run_request_id
FROM state, first_run""")
def reset_run(spark, sf):
    first = I.load(spark, sf, "documents").agg(F.min("source")).head(1)[0][0]
    return _shown_state(P.reset_pairs(judged(spark, sf)[0].state, first))


@query("count_at_gate", f"""WITH {STATE_SQL}
SELECT run_id AS stage3_run_id, coalesce(gate, '-') AS gate, count(*) AS pairs FROM state GROUP BY ALL""")
def count_at_gate(spark, sf):
    return P.count_at_gate(judged(spark, sf)[0].state).select(
        "stage3_run_id", _text("gate").alias("gate"), "pairs"
    )


@query("count_decided_by", f"""WITH {STATE_SQL}
SELECT run_id AS stage3_run_id, coalesce(decided_by, '-') AS decided_by, count(*) AS pairs FROM state GROUP BY ALL""")
def count_decided_by(spark, sf):
    return P.count_decided_by(judged(spark, sf)[0].state).select(
        "stage3_run_id", _text("decided_by").alias("decided_by"), "pairs"
    )


@query("claim_order", f"""WITH {STATE_SQL}, first_run AS (SELECT min(source) AS run FROM documents)
SELECT pair_id, rank FROM state, first_run WHERE run_id = run AND gate = 'G4_ESCALATION'
ORDER BY rank, pair_id LIMIT 32""")
def claim_order(spark, sf):
    """The next batch of 32 pairs in claim order; the limit is the feature."""
    first = I.load(spark, sf, "documents").agg(F.min("source")).head(1)[0][0]
    return P.claim_batch(judged(spark, sf)[0].state, first, V.G4, 32).select("pair_id", "rank")


@query("guarded_route", f"""WITH {STATE_SQL}
SELECT pair_id,
  CASE WHEN gate = 'G4_ESCALATION' AND golden THEN '-' ELSE coalesce(gate, '-') END AS gate,
  CASE WHEN gate = 'G4_ESCALATION' AND golden THEN 'HUMAN' ELSE tier END AS tier,
  CASE WHEN gate = 'G4_ESCALATION' AND golden THEN '-' ELSE coalesce(decided_by, '-') END AS decided_by,
  golden AND gate IS DISTINCT FROM 'G4_ESCALATION' AS stale
FROM state""")
def guarded_route(spark, sf):
    """Updates claim every golden pair from the tail; only pairs still there may move."""
    state = judged(spark, sf)[0].state
    route = struct_of({
        "gate": F.lit(None).cast("string"), "tier": F.lit(V.TIER_HUMAN),
        "decided_by": F.lit(None).cast("string"), "contradiction_flag": F.lit(True),
        "run_request_id": F.lit("late"),
    })
    golden = I.scored_pairs(spark, sf).where("golden").select(
        "pair_id", F.lit(V.G4).alias("claimed_gate"),
        F.lit(None).cast("string").alias("claimed_owner"), route.alias("route"),
    )
    return P.guarded_routes(state, golden).select(
        "pair_id", _text("gate").alias("gate"), "tier", _text("decided_by").alias("decided_by"),
        F.coalesce(~F.col("applied"), F.lit(False)).alias("stale"),
    )


@query("tally", f"""WITH {STATE_SQL}
SELECT run_id AS stage3_run_id, count(*) AS pairs_seen,
  count(*) FILTER (gate IS NULL AND tier = 'CASCADE') AS decided_by_gates,
  count(*) FILTER (gate IS NULL AND tier = 'LLM_TAIL') AS escalated_llm,
  count(*) FILTER (gate IS NULL AND tier = 'HUMAN') AS escalated_human,
  count(*) FILTER (gate IS NOT NULL) AS stranded,
  count(*) FILTER (gate IS NOT NULL) = 0 AS reconciles
FROM state GROUP BY run_id""")
def tally(spark, sf):
    return RN.tally(judged(spark, sf)[0].state)
