"""Keys, seeding, hydration and the verdict table."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import inputs as I
from catalog.registry import query
from verdictflow import schemas, vocab as V
from verdictflow.functions import decisions as D, keys, stage_scores as S
from verdictflow.operators import edges as E, hydrate as H, pairs as P


@query("pair_key", f"""WITH {I.PAIRS_SQL}
SELECT pair_id, low_id, high_id, edge_key, rank,
  CASE rank % 4 WHEN 0 THEN 'G1_NEUTRAL' WHEN 1 THEN 'G2_CORROBORATION'
    WHEN 2 THEN 'G3_CONTRADICTION' ELSE 'G4_ESCALATION' END AS gate,
  CASE rank % 4 WHEN 0 THEN '-' WHEN 1 THEN 'G1_NEUTRAL'
    WHEN 2 THEN 'G2_CORROBORATION' ELSE 'G3_CONTRADICTION' END AS prior,
  CASE rank % 4 WHEN 0 THEN 'G2_CORROBORATION' WHEN 1 THEN 'G3_CONTRADICTION'
    WHEN 2 THEN 'G4_ESCALATION' ELSE '-' END AS following
FROM pairs""")
def pair_key(spark, sf):
    gate = F.get(F.array(*[F.lit(g) for g in V.GATES]), F.col("rank") % 4)
    return I.pairs(spark, sf).withColumn("gate", gate).select(
        "pair_id", "low_id", "high_id", "edge_key", "rank", "gate",
        F.coalesce(keys.prior_gate("gate"), F.lit("-")).alias("prior"),
        F.coalesce(keys.next_gate("gate"), F.lit("-")).alias("following"),
    )


# Candidates name every pair in both directions, the reverse one with a lower rank
# where the first id is the larger text; pairs of labelled documents exist already.
_CANDIDATES_SQL = f"""{I.PAIRS_SQL}, both_ways AS (
  SELECT pair_id, run_id, a_id, b_id, rank, with_context, a_doc FROM pairs
  UNION ALL SELECT pair_id, run_id, b_id, a_id, CAST(rank + h1 % 3 - 1 AS INTEGER), with_context, a_doc FROM pairs
), known AS (
  SELECT DISTINCT pair_id FROM pairs JOIN labels ON labels.doc_id = pairs.a_doc
)"""


def _candidates(spark, sf):
    pairs = I.pairs(spark, sf)
    forward = pairs.select(
        F.col("run_id").alias("stage3_run_id"), F.lit("intake").alias("intake_id"), "a_id", "b_id",
        "rank", "with_context", F.lit(None).cast("boolean").alias("human_asserted"),
    )
    backward = pairs.select(
        F.col("run_id").alias("stage3_run_id"), F.lit("intake").alias("intake_id"),
        F.col("b_id").alias("a_id"), F.col("a_id").alias("b_id"),
        (F.col("rank") + F.col("h1") % 3 - 1).cast("int").alias("rank"), "with_context",
        F.lit(None).cast("boolean").alias("human_asserted"),
    )
    return P.union_all([forward, backward])


def _known(spark, sf):
    labelled = I.load(spark, sf, "labels").select(F.col("doc_id").alias("a_doc"))
    return I.pairs(spark, sf).join(labelled, "a_doc", "left_semi").select("pair_id")


@query("seed_pairs", f"""WITH {_CANDIDATES_SQL}, ranked AS (
  SELECT *, row_number() OVER (PARTITION BY pair_id ORDER BY rank, a_id) AS n FROM both_ways
)
SELECT pair_id, a_id, b_id, least(a_id, b_id) AS low_id, greatest(a_id, b_id) AS high_id, rank,
  with_context, false AS human_asserted, 'CASCADE' AS tier, 'G1_NEUTRAL' AS gate,
  false AS contradiction_flag
FROM ranked WHERE n = 1 AND pair_id NOT IN (SELECT pair_id FROM known)""")
def seed_pairs(spark, sf):
    return P.seed_pairs(_known(spark, sf), _candidates(spark, sf)).select(
        "pair_id", "a_id", "b_id", "low_id", "high_id", "rank", "with_context",
        "human_asserted", "tier", "gate", "contradiction_flag",
    )


@query("queued_pairs", f"""WITH {I.PAIRS_SQL}
SELECT pairs.a_id, CAST(labels.doc_id AS VARCHAR) AS b_id,
  CASE WHEN labels.toxic = 1 THEN 0 ELSE pairs.rank END AS rank,
  coalesce(labels.quality = 1, false) AS with_context, false AS human_asserted
FROM pairs JOIN labels ON labels.doc_id = pairs.b_doc""")
def queued_pairs(spark, sf):
    """Pairs with gaps: an unlabelled second document has no id here."""
    labels = I.load(spark, sf, "labels")
    gaps = I.pairs(spark, sf).join(
        labels, F.col("b_doc") == F.col("doc_id"), "left"
    ).select(
        "subject_id", "a_id", F.col("doc_id").cast("string").alias("b_id"),
        F.when(F.col("toxic") == 0, F.col("rank")).alias("rank"),
        (F.col("quality") == 1).alias("with_context"),
        F.lit(None).cast("boolean").alias("human_asserted"),
    )
    return P.queued_pairs(gaps).select("a_id", "b_id", "rank", "with_context", "human_asserted")


@query("run_subject_pairs", f"""WITH {I.PAIRS_SQL}, owners AS (
  SELECT lang AS subject_id, max(source) AS stage3_run_id, min(source) AS intake_id
  FROM documents GROUP BY lang
)
SELECT subject_id, stage3_run_id, intake_id, count(*) AS pairs, sum(rank)::BIGINT AS ranks
FROM pairs JOIN owners USING (subject_id) GROUP BY ALL""")
def run_subject_pairs(spark, sf):
    runs = I.load(spark, sf, "documents").groupBy(F.col("lang").alias("subject_id")).agg(
        F.max("source").alias("stage3_run_id"), F.min("source").alias("intake_id")
    )
    return P.attach_runs(I.pairs(spark, sf), runs).groupBy(
        "subject_id", "stage3_run_id", "intake_id"
    ).agg(F.count(F.lit(1)).alias("pairs"), F.sum("rank").alias("ranks"))


@query("resolve_subject", """
SELECT o_orderkey, coalesce(CAST(c_custkey AS VARCHAR), '') AS subject_id
FROM orders LEFT JOIN customer ON c_custkey = o_custkey AND c_acctbal > 0""")
def resolve_subject(spark, sf):
    requests = I.load(spark, sf, "orders").select(
        "o_orderkey", F.col("o_custkey").alias("stage3_run_id")
    )
    runs = I.load(spark, sf, "customer").select(
        F.col("c_custkey").alias("stage3_run_id"),
        F.when(F.col("c_acctbal") > 0, F.col("c_custkey").cast("string")).alias("subject_id"),
    )
    return P.resolve_subject(requests, runs).select("o_orderkey", "subject_id")


@query("distinct_claim_ids", f"""WITH {I.PAIRS_SQL}
SELECT DISTINCT claim_id FROM (SELECT a_id AS claim_id FROM pairs UNION ALL SELECT b_id FROM pairs)""")
def distinct_claim_ids(spark, sf):
    return P.distinct_claim_ids(I.pairs(spark, sf))


# --- hydration ------------------------------------------------------------------------

# Claims: a document labelled toxic has lost its text. Excerpts: documents labelled
# good have their whole text as evidence. Explanations: the turns of a conversation.
_CLAIMS_SQL = """claims AS (
  SELECT CAST(d.doc_id AS VARCHAR) AS claim_id,
    CASE WHEN l.toxic = 1 THEN NULL ELSE d.text END AS text, d.lang, d.source, d.n_chars,
    coalesce(l.quality, -1) AS quality
  FROM documents d LEFT JOIN labels l USING (doc_id)
), explanations AS (
  SELECT CAST(conv_id AS VARCHAR) AS claim_id, arg_min(text, turn) AS explanation
  FROM conversations GROUP BY conv_id
)"""


def claims(spark, sf):
    labels = I.load(spark, sf, "labels")
    docs = I.load(spark, sf, "documents").join(labels, "doc_id", "left")
    return docs.select(
        F.col("doc_id").cast("string").alias("claim_id"),
        F.lit("subject").alias("subject_id"),
        F.when(F.coalesce("toxic", F.lit(0)) != 1, F.col("text")).alias("text"),
        F.when(F.col("n_chars") > 2000, "LONG").otherwise(" ").alias("type"),
        F.col("source").alias("source_class"),
        F.when(F.col("quality") == 1, "2024-01-01").alias("claimed_date"),
        F.when(F.col("lang") == "en", "PEER").alias("relationship"),
        F.lit(None).cast("string").alias("speaker_role"),
        F.coalesce("quality", F.lit(-1)).alias("quality"),
    )


def explanations(spark, sf):
    return I.load(spark, sf, "conversations").select(
        F.col("conv_id").cast("string").alias("claim_id"), "text", F.col("turn").alias("seq")
    )


def excerpts(spark, sf):
    good = I.load(spark, sf, "labels").where(F.col("quality") == 1).select("doc_id")
    return I.load(spark, sf, "documents").join(good, "doc_id", "left").select(
        F.col("doc_id").cast("string").alias("claim_id"),
        F.col("text").alias("excerpt"),
    ).join(
        good.select(F.col("doc_id").cast("string").alias("claim_id")), "claim_id", "left_semi"
    )


@query("hydrate_texts", f"""WITH {I.PAIRS_SQL}, {_CLAIMS_SQL}
SELECT pair_id, coalesce(md5(ca.text), '-') AS a_md5, coalesce(md5(cb.text), '-') AS b_md5,
  coalesce(length(ca.text), 0) AS a_chars, coalesce(length(cb.text), 0) AS b_chars
FROM pairs LEFT JOIN claims ca ON ca.claim_id = a_id LEFT JOIN claims cb ON cb.claim_id = b_id""")
def hydrate_texts(spark, sf):
    lookup = H.claim_lookup(claims(spark, sf))
    rows = H.hydrate(I.pairs(spark, sf).select("pair_id", "a_id", "b_id"), lookup)
    return rows.select(
        "pair_id",
        F.coalesce(F.md5("a.text"), F.lit("-")).alias("a_md5"),
        F.coalesce(F.md5("b.text"), F.lit("-")).alias("b_md5"),
        F.coalesce(F.length("a.text"), F.lit(0)).cast("long").alias("a_chars"),
        F.coalesce(F.length("b.text"), F.lit(0)).cast("long").alias("b_chars"),
    )


@query("hydrate_explanations", f"""WITH {I.PAIRS_SQL}, {_CLAIMS_SQL}
SELECT pair_id, md5(ca.text || CASE WHEN with_context AND ea.explanation <> '' THEN chr(10) || chr(10) || ea.explanation ELSE '' END) AS a_md5,
  md5(cb.text || CASE WHEN with_context AND eb.explanation <> '' THEN chr(10) || chr(10) || eb.explanation ELSE '' END) AS b_md5
FROM pairs JOIN claims ca ON ca.claim_id = a_id JOIN claims cb ON cb.claim_id = b_id
LEFT JOIN explanations ea ON ea.claim_id = a_id LEFT JOIN explanations eb ON eb.claim_id = b_id
WHERE ca.text <> '' AND cb.text <> ''""")
def hydrate_explanations(spark, sf):
    lookup = H.claim_lookup(claims(spark, sf), explanations(spark, sf))
    rows, _ = H.split_missing(
        H.hydrate(I.pairs(spark, sf).select("pair_id", "a_id", "b_id", "with_context"), lookup)
    )

    def text(side):
        context = F.when(F.col("with_context"), F.col(f"{side}.explanation"))
        return F.md5(keys.contexted(F.col(f"{side}.text"), context)).alias(f"{side}_md5")

    return rows.select("pair_id", text("a"), text("b"))


@query("claim_cards", f"""WITH {_CLAIMS_SQL}
SELECT claim_id, md5(text) AS text_md5, CASE WHEN n_chars > 2000 THEN 'LONG' ELSE '-' END AS type,
  source AS source_class, CASE WHEN quality = 1 THEN '2024-01-01' ELSE '-' END AS claimed_date,
  CASE WHEN lang = 'en' THEN 'PEER' ELSE '-' END AS relationship, '-' AS speaker_role,
  coalesce(md5(regexp_replace(explanation, '^\\s+|\\s+$', '', 'g')), '-') AS explanation_md5
FROM claims LEFT JOIN explanations USING (claim_id) WHERE text <> ''""")
def claim_cards(spark, sf):
    def shown(name):
        return F.coalesce(F.col(name), F.lit("-")).alias(name)

    return H.claim_cards(claims(spark, sf), explanations(spark, sf)).select(
        "claim_id", F.md5("text").alias("text_md5"),
        shown("type"), shown("source_class"), shown("claimed_date"), shown("relationship"),
        shown("speaker_role"),
        F.coalesce(F.md5("explanation"), F.lit("-")).alias("explanation_md5"),
    )


@query("source_excerpts", f"""WITH {I.PAIRS_SQL}, e AS (
  SELECT CAST(doc_id AS VARCHAR) AS claim_id, text FROM documents
  WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) AND trim(text) <> ''
)
SELECT pair_id, coalesce(md5(ea.text), '-') AS a_excerpt, coalesce(md5(eb.text), '-') AS b_excerpt,
  ea.text IS NOT NULL OR eb.text IS NOT NULL AS grounded
FROM pairs LEFT JOIN e ea ON ea.claim_id = a_id LEFT JOIN e eb ON eb.claim_id = b_id""")
def source_excerpts(spark, sf):
    lookup = H.claim_lookup(
        I.load(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("claim_id"), "text"),
        excerpts=excerpts(spark, sf),
    )
    rows = H.hydrate(I.pairs(spark, sf).select("pair_id", "a_id", "b_id"), lookup)
    return rows.select(
        "pair_id",
        F.coalesce(F.md5("a.excerpt"), F.lit("-")).alias("a_excerpt"),
        F.coalesce(F.md5("b.excerpt"), F.lit("-")).alias("b_excerpt"),
        (F.col("a.excerpt").isNotNull() | F.col("b.excerpt").isNotNull()).alias("grounded"),
    )


@query("missing_text_guard", f"""WITH {I.PAIRS_SQL}, {_CLAIMS_SQL}
SELECT pair_id, CASE WHEN ca.text IS NULL AND cb.text IS NULL THEN 'BOTH'
  WHEN ca.text IS NULL THEN 'A' ELSE 'B' END AS missing_side
FROM pairs JOIN claims ca ON ca.claim_id = a_id JOIN claims cb ON cb.claim_id = b_id
WHERE ca.text IS NULL OR cb.text IS NULL""")
def missing_text_guard(spark, sf):
    lookup = H.claim_lookup(claims(spark, sf))
    rows = H.hydrate(I.pairs(spark, sf).select("pair_id", "a_id", "b_id"), lookup)
    return H.split_missing(rows)[1]


# --- verdict rows ---------------------------------------------------------------------


def _edge_inputs(spark, sf):
    return I.scored_pairs(spark, sf).select(
        "pair_id", "a_id", "b_id", "a_doc", "b_doc", "rank", "with_context", "subject_id",
        F.lit("intake").alias("intake_id"), F.col("run_id").alias("stage3_run_id"),
        F.concat(F.lit("req-"), "run_id").alias("run_request_id"),
        "g1", "g2", "g3", "grounded_fwd", "grounded_bwd",
    )


@query("stage_scores", f"""WITH {I.CASCADE_SQL}
SELECT edge_key, round(ent_fwd, 6) AS ent_fwd, round(con_bwd, 6) AS con_bwd,
  round(coalesce(greatest(abs(ctx_neu_fwd - neu_fwd), abs(ctx_neu_bwd - neu_bwd)), -1), 6) AS ctx_delta,
  round(sup_fwd, 6) AS support_fwd, round(coalesce(sup_grounded, -1), 6) AS support_grounded,
  round(neu_b, 6) AS neu_fwd_b, round(con_b, 6) AS con_bwd_b
FROM c""")
def stage_scores(spark, sf):
    rows = _edge_inputs(spark, sf)
    one = S.g1_slot(F.col("g1"))
    two = S.g2_slot(F.col("g2"), F.col("grounded_fwd"), F.col("grounded_bwd"))
    three = S.g3_slot(F.col("g3"))
    return rows.select(
        keys.edge_key("a_id", "b_id", "with_context").alias("edge_key"),
        F.round(one["ent_fwd"], 6).alias("ent_fwd"), F.round(one["con_bwd"], 6).alias("con_bwd"),
        F.round(F.coalesce(one["ctx_delta"], F.lit(-1.0)), 6).alias("ctx_delta"),
        F.round(two["support_fwd"], 6).alias("support_fwd"),
        F.round(F.coalesce(two["support_grounded"], F.lit(-1.0)), 6).alias("support_grounded"),
        F.round(three["neu_fwd_b"], 6).alias("neu_fwd_b"),
        F.round(three["con_bwd_b"], 6).alias("con_bwd_b"),
    )


def _stored_edges(spark, sf):
    """Verdict rows a first gate has left behind for pairs of labelled documents."""
    labelled = I.load(spark, sf, "labels").select(F.col("doc_id").alias("a_doc"))
    rows = _edge_inputs(spark, sf).join(labelled, "a_doc", "left_semi")
    decision = D.decide_g1(D.g1_features(F.col("g1")))
    updates = E.edge_updates(
        rows.withColumn("d", decision), method=V.METHOD_G1, slot=("g1", S.g1_slot(F.col("g1"))),
        relation=F.col("d.verdict"), escalation_reason=F.col("d.escalation_reason"),
        truncated=D.g1_truncated(F.col("g1")), judge_model=F.lit("model-a"),
    )
    empty = spark.createDataFrame([], schemas.EDGES)
    return E.merge_edges(empty, updates, F.lit("2024-01-01").cast("timestamp"), combined=True)


def _second_updates(spark, sf):
    """Updates of a second gate for every pair, and of a third one for even ranks."""
    rows = _edge_inputs(spark, sf).withColumn("d2", D.decide_g2(D.g2_features(F.col("g2"))))
    two = E.edge_updates(
        rows, method=V.METHOD_G2,
        slot=("g2", S.g2_slot(F.col("g2"), F.col("grounded_fwd"), F.col("grounded_bwd"))),
        relation=F.col("d2.verdict"), confidence=F.col("d2.confidence"),
        truncated=D.g2_truncated(F.col("g2")), judge_model=F.lit("model-b"), seq=2,
        attempt=F.lit(2),
    )
    even = rows.where(F.col("rank") % 2 == 0)
    three = E.edge_updates(
        even, method=V.METHOD_G3, slot=("g3", S.g3_slot(F.col("g3"))),
        relation=F.lit(None).cast("string"), escalation_reason=F.lit(V.STAGE_DISAGREEMENT),
        truncated=D.family_b_truncated(F.col("g3")), judge_model=F.lit("model-c"), seq=3,
    )
    return P.union_all([two, three])


@query("upsert_edges", f"""WITH {I.CASCADE_SQL}, one AS (
  SELECT edge_key FROM c JOIN labels ON labels.doc_id = a_doc
)
SELECT c.edge_key AS key, run_id AS stage3_run_id,
  CASE WHEN rank % 2 = 0 THEN 'GK_G3_XCHECK' ELSE 'GK_G2_GROUNDING' END AS method,
  CASE WHEN rank % 2 = 0 THEN 1 ELSE 2 END AS attempt,
  CASE WHEN rank % 2 = 0 THEN 'model-c' ELSE 'model-b' END AS judge_model,
  CASE WHEN rank % 2 = 0 THEN trunc_b ELSE trunc_s END AS truncated,
  coalesce(CASE WHEN d2 = 'DECIDED' THEN 'CORROBORATES' END,
           CASE WHEN one.edge_key IS NOT NULL AND d1 = 'DECIDED' THEN bare END, '-') AS relation,
  round(coalesce(CASE WHEN d2 = 'DECIDED' THEN support END, -1), 6) AS confidence,
  coalesce(CASE WHEN rank % 2 = 0 THEN 'STAGE_DISAGREEMENT' END,
           CASE WHEN one.edge_key IS NOT NULL AND d1 = 'ESCALATE_G4' THEN 'CONTEXT_DISAGREEMENT' END,
           '-') AS escalation_reason,
  round(coalesce(CASE WHEN one.edge_key IS NOT NULL THEN neu_fwd END, -1), 6) AS neu_fwd,
  round(sup_bwd, 6) AS support_bwd,
  round(coalesce(CASE WHEN rank % 2 = 0 THEN con_b END, -1), 6) AS con_fwd_b,
  CASE WHEN one.edge_key IS NOT NULL THEN '2024-01-01' ELSE '2024-02-01' END AS created
FROM c LEFT JOIN one ON one.edge_key = c.edge_key""")
def upsert_edges(spark, sf):
    merged = E.merge_edges(
        _stored_edges(spark, sf), _second_updates(spark, sf), F.lit("2024-02-01").cast("timestamp")
    )

    def number(name):
        return F.round(F.coalesce(F.col(name), F.lit(-1.0)), 6)

    return merged.select(
        "key", "stage3_run_id", "method", "attempt", "judge_model", "truncated",
        F.coalesce("relation", F.lit("-")).alias("relation"),
        number("confidence").alias("confidence"),
        F.coalesce("escalation_reason", F.lit("-")).alias("escalation_reason"),
        number("stage_scores.g1.neu_fwd").alias("neu_fwd"),
        number("stage_scores.g2.support_bwd").alias("support_bwd"),
        number("stage_scores.g3.con_fwd_b").alias("con_fwd_b"),
        F.date_format("created_at", "yyyy-MM-dd").alias("created"),
    )


def _mixed_judges(spark, sf):
    """Rows of several judges: the pair's rank says which, some have no method."""
    methods = F.array(*[F.lit(m) for m in (*V.OWN_METHODS, "ENSEMBLE")])
    return I.pairs(spark, sf).select(
        F.col("edge_key").alias("key"), F.col("run_id").alias("stage3_run_id"),
        F.get(methods, F.col("rank") % 6).alias("method"),
    )


_PURGE_SQL = f"""{I.PAIRS_SQL}, mixed AS (
  SELECT edge_key AS key, run_id AS stage3_run_id,
    CASE rank % 6 WHEN 0 THEN 'GK_G1_NLI' WHEN 1 THEN 'GK_G2_GROUNDING' WHEN 2 THEN 'GK_G3_XCHECK'
      WHEN 3 THEN 'GK_G4_LLM' WHEN 4 THEN 'ENSEMBLE' END AS method
  FROM pairs
), first_run AS (SELECT min(source) AS run FROM documents)"""


@query("purge_run", f"""WITH {_PURGE_SQL}
SELECT key, stage3_run_id, coalesce(method, '-') AS method FROM mixed, first_run
WHERE NOT coalesce(stage3_run_id = run AND method LIKE 'GK_%', false)""")
def purge_run(spark, sf):
    first = I.load(spark, sf, "documents").agg(F.min("source")).head(1)[0][0]
    return E.purge_edges(_mixed_judges(spark, sf), first).select(
        "key", "stage3_run_id", F.coalesce("method", F.lit("-")).alias("method")
    )


@query("count_purged", f"""WITH {_PURGE_SQL}
SELECT count(*) AS purged FROM mixed, first_run WHERE stage3_run_id = run AND method LIKE 'GK_%'""")
def count_purged(spark, sf):
    first = I.load(spark, sf, "documents").agg(F.min("source")).head(1)[0][0]
    return E.count_purged(_mixed_judges(spark, sf), first)


@query("read_family_a", f"""WITH {I.CASCADE_SQL}
SELECT c.pair_id, labels.doc_id IS NOT NULL AS found,
  round(CASE WHEN labels.doc_id IS NULL THEN -1 ELSE ent_fwd END, 6) AS entailment,
  round(CASE WHEN labels.doc_id IS NULL THEN -1 ELSE con_bwd END, 6) AS contradiction
FROM c LEFT JOIN labels ON labels.doc_id = a_doc""")
def read_family_a(spark, sf):
    rows = E.read_family_a(_edge_inputs(spark, sf).drop("g1"), _stored_edges(spark, sf))
    return rows.select(
        "pair_id", F.col("family_a").isNotNull().alias("found"),
        F.round(F.coalesce("family_a.fwd.entailment", F.lit(-1.0)), 6).alias("entailment"),
        F.round(F.coalesce("family_a.bwd.contradiction", F.lit(-1.0)), 6).alias("contradiction"),
    )


@query("read_slot", f"""WITH {I.CASCADE_SQL}
SELECT edge_key AS key, round(ent_fwd, 6) AS ent_fwd, round(con_bwd, 6) AS con_bwd
FROM c JOIN labels ON labels.doc_id = a_doc""")
def read_slot(spark, sf):
    """One stored slot of the verdict rows, asked for by the keys of all pairs."""
    wanted = I.pairs(spark, sf).select(F.col("edge_key").alias("key"))
    found = E.read_slot(_stored_edges(spark, sf), "g1", wanted)
    return found.select("key", F.round("g1.ent_fwd", 6).alias("ent_fwd"), F.round("g1.con_bwd", 6).alias("con_bwd"))


@query("shadow_projection", f"""WITH {I.CASCADE_SQL}
SELECT edge_key AS key, '-' AS relation, coalesce(CASE WHEN d2 = 'DECIDED' THEN 'CORROBORATES' END, '-') AS shadow_verdict,
  'GK_G2_GROUNDING' AS shadow_method, round(sup_fwd, 6) AS shadow_support, round(sup_fwd, 6) AS support,
  '-' AS judge_model
FROM c""")
def shadow_projection(spark, sf):
    rows = _edge_inputs(spark, sf).withColumn("d2", D.decide_g2(D.g2_features(F.col("g2"))))
    updates = E.edge_updates(
        rows, method=V.METHOD_G2,
        slot=("g2", S.g2_slot(F.col("g2"), F.col("grounded_fwd"), F.col("grounded_bwd"))),
        relation=F.col("d2.verdict"), confidence=F.col("d2.confidence"),
        judge_model=F.lit("model-b"), mode=F.lit(V.MODE_SHADOW),
    )
    return updates.select(
        "key", F.coalesce("relation", F.lit("-")).alias("relation"),
        F.coalesce("shadow.verdict", F.lit("-")).alias("shadow_verdict"),
        F.col("shadow.method").alias("shadow_method"),
        F.round("shadow.stage_scores.g2.support_fwd", 6).alias("shadow_support"),
        F.round("stage_scores.g2.support_fwd", 6).alias("support"),
        F.coalesce("judge_model", F.lit("-")).alias("judge_model"),
    )
