"""Explicit schemas of every table; camelCase occurs only in emitted JSON."""

from pyspark.sql import types as T

NLI = T.StructType([
    T.StructField("entailment", T.DoubleType()),
    T.StructField("neutral", T.DoubleType()),
    T.StructField("contradiction", T.DoubleType()),
    T.StructField("truncated", T.BooleanType()),
])
GROUNDING = T.StructType([
    T.StructField("support", T.DoubleType()),
    T.StructField("truncated", T.BooleanType()),
])
G1_SCORES = T.StructType([
    T.StructField(name, NLI) for name in ("fwd", "bwd", "ctx_fwd", "ctx_bwd")
])
G2_SCORES = T.StructType([
    T.StructField(name, GROUNDING) for name in ("fwd", "bwd", "grounded")
])
G3_SCORES = T.StructType([T.StructField("fwd", NLI), T.StructField("bwd", NLI)])

PAIR_SCORES = T.StructType([
    T.StructField("pair_id", T.StringType(), False),
    T.StructField("g1", G1_SCORES),
    T.StructField("g2", G2_SCORES),
    T.StructField("g3", G3_SCORES),
])

CLAIMS = T.StructType([
    T.StructField(name, T.StringType())
    for name in (
        "claim_id", "subject_id", "text", "type", "source_class",
        "claimed_date", "relationship", "speaker_role",
    )
])

CANDIDATE_PAIRS = T.StructType([
    T.StructField("subject_id", T.StringType()),
    T.StructField("a_id", T.StringType()),
    T.StructField("b_id", T.StringType()),
    T.StructField("rank", T.IntegerType()),
    T.StructField("with_context", T.BooleanType()),
    T.StructField("human_asserted", T.BooleanType()),
])

PAIR_STATE = T.StructType([
    T.StructField("pair_id", T.StringType()),
    T.StructField("stage3_run_id", T.StringType()),
    T.StructField("intake_id", T.StringType()),
    T.StructField("a_id", T.StringType()),
    T.StructField("b_id", T.StringType()),
    T.StructField("low_id", T.StringType()),
    T.StructField("high_id", T.StringType()),
    T.StructField("rank", T.IntegerType()),
    T.StructField("with_context", T.BooleanType()),
    T.StructField("human_asserted", T.BooleanType()),
    T.StructField("tier", T.StringType()),
    T.StructField("gate", T.StringType()),
    T.StructField("contradiction_flag", T.BooleanType()),
    T.StructField("decided_by", T.StringType()),
    T.StructField("run_request_id", T.StringType()),
])

G1_SLOT = T.StructType([
    T.StructField(name, T.DoubleType())
    for name in ("ent_fwd", "ent_bwd", "neu_fwd", "neu_bwd", "con_fwd", "con_bwd", "ctx_delta")
])
G2_SLOT = T.StructType([
    T.StructField(name, T.DoubleType())
    for name in (
        "support_fwd", "support_bwd", "support_grounded_fwd",
        "support_grounded_bwd", "support_grounded",
    )
])
G3_SLOT = T.StructType([
    T.StructField(name, T.DoubleType())
    for name in ("ent_fwd_b", "ent_bwd_b", "neu_fwd_b", "neu_bwd_b", "con_fwd_b", "con_bwd_b")
])
STAGE_SCORES = T.StructType([
    T.StructField("g1", G1_SLOT), T.StructField("g2", G2_SLOT), T.StructField("g3", G3_SLOT),
])
SHADOW = T.StructType([
    T.StructField("verdict", T.StringType()),
    T.StructField("method", T.StringType()),
    T.StructField("run_request_id", T.StringType()),
    T.StructField("escalation_reason", T.StringType()),
    T.StructField("stage_scores", STAGE_SCORES),
])
EDGES = T.StructType([
    T.StructField("key", T.StringType()),
    T.StructField("subject_id", T.StringType()),
    T.StructField("low_id", T.StringType()),
    T.StructField("high_id", T.StringType()),
    T.StructField("with_context", T.BooleanType()),
    T.StructField("intake_id", T.StringType()),
    T.StructField("stage3_run_id", T.StringType()),
    T.StructField("run_request_id", T.StringType()),
    T.StructField("method", T.StringType()),
    T.StructField("attempt", T.IntegerType()),
    T.StructField("stage_scores", STAGE_SCORES),
    T.StructField("judge_model", T.StringType()),
    T.StructField("truncated", T.BooleanType()),
    T.StructField("relation", T.StringType()),
    T.StructField("confidence", T.DoubleType()),
    T.StructField("escalation_reason", T.StringType()),
    T.StructField("rationale", T.StringType()),
    T.StructField("temporal_note", T.StringType()),
    T.StructField("shadow", SHADOW),
    T.StructField("created_at", T.TimestampType()),
    T.StructField("updated_at", T.TimestampType()),
])

CORPUS = T.StructType([
    T.StructField("pair_id", T.StringType()),
    T.StructField("claim_a_id", T.StringType()),
    T.StructField("claim_b_id", T.StringType()),
    T.StructField("claim_a_text", T.StringType()),
    T.StructField("claim_b_text", T.StringType()),
    T.StructField("ensemble_verdict", T.StringType()),
    T.StructField("votes", T.ArrayType(T.StringType())),
    T.StructField("golden", T.BooleanType()),
    T.StructField("with_context", T.BooleanType()),
    T.StructField("context_a", T.StringType()),
    T.StructField("context_b", T.StringType()),
    T.StructField("source_snippet", T.StringType()),
    T.StructField("intake_id", T.StringType()),
    T.StructField("stage3_run_id", T.StringType()),
])
