"""Pairs, scores and run tables derived from the given tables.

The driver's tables hold no claim pairs and no model scores. Claims are
``documents``, a pair is two documents of one language at most 16 ids apart, and
scores are integer arithmetic on the two ids: synthetic numbers that reach every
branch, computed alike by Spark and by SQL. They are no model output.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from verdictflow.functions import keys, settings
from verdictflow.session import RECOMMENDED

NEIGHBOURS = 16


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    for key in ("spark.sql.session.timeZone", "spark.sql.constraintPropagation.enabled"):
        spark.conf.set(key, RECOMMENDED[key])
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- pairs and scores -----------------------------------------------------------------

PAIRS_SQL = """
p AS (
  SELECT a.doc_id AS a_doc, b.doc_id AS b_doc,
         CAST(a.doc_id AS VARCHAR) AS a_id, CAST(b.doc_id AS VARCHAR) AS b_id,
         a.source AS run_id, a.lang AS subject_id,
         CAST(b.doc_id - a.doc_id AS INTEGER) AS rank,
         a.doc_id*31 + b.doc_id*17 AS h1, a.doc_id*13 + b.doc_id*7 AS h2,
         a.doc_id*37 + b.doc_id*53 AS h3, a.doc_id*11 + b.doc_id*29 AS h4,
         (a.doc_id + b.doc_id) % 7 = 0 AS with_context
  FROM documents a JOIN documents b
    ON a.lang = b.lang AND b.doc_id BETWEEN a.doc_id + 1 AND a.doc_id + 16
), pairs AS (
  SELECT *, least(a_id, b_id) AS low_id, greatest(a_id, b_id) AS high_id,
         run_id || '|' || least(a_id, b_id) || '|' || greatest(a_id, b_id) AS pair_id,
         least(a_id, b_id) || '|' || greatest(a_id, b_id) || '|'
           || CASE WHEN with_context THEN 'ctx' ELSE 'bare' END || '|GK' AS edge_key
  FROM p
)"""


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbouring documents of one language: an equi-join, linear in documents."""
    docs = load(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    # Every row becomes sixteen with some work each: spread the few bytes over all cores first.
    left = docs.repartition(spark.sparkContext.defaultParallelism, "doc_id").select(
        F.col("doc_id").alias("a_doc"), "lang", F.col("source").alias("run_id"),
        F.explode(F.sequence(F.lit(1), F.lit(NEIGHBOURS))).alias("rank"),
    ).withColumn("b_doc", F.col("a_doc") + F.col("rank"))
    right = docs.select(F.col("doc_id").alias("b_doc"), "lang")
    a, b = F.col("a_doc"), F.col("b_doc")
    named = left.join(right, ["b_doc", "lang"]).select(
        "a_doc", "b_doc",
        a.cast("string").alias("a_id"), b.cast("string").alias("b_id"),
        "run_id", F.col("lang").alias("subject_id"), F.col("rank").cast("int").alias("rank"),
        (a * 31 + b * 17).alias("h1"), (a * 13 + b * 7).alias("h2"),
        (a * 37 + b * 53).alias("h3"), (a * 11 + b * 29).alias("h4"),
        ((a + b) % 7 == 0).alias("with_context"),
    )
    return named.withColumns({
        "low_id": keys.claim_id_low("a_id", "b_id"),
        "high_id": keys.claim_id_high("a_id", "b_id"),
        "pair_id": keys.pair_key("run_id", "a_id", "b_id"),
        "edge_key": keys.edge_key("a_id", "b_id", "with_context"),
    })


SCORES_SQL = PAIRS_SQL + """, q AS (
  SELECT pairs.*, CASE WHEN h1 % 20 < 15 THEN h2 % 22 ELSE h3 % 1000 END AS conf_m,
         CASE WHEN h1 % 20 < 15 THEN (h2 + 5) % 22 ELSE (h3 + 300) % 1000 END AS conb_m,
         CASE WHEN h4 % 10 < 6 THEN 960 + h2 % 40
              WHEN h4 % 10 < 8 THEN h3 % 60 ELSE h3 % 1000 END AS share_m,
         CASE WHEN h1 % 20 < 15 THEN h3 % 130 ELSE (h3 + h4) % 1000 END AS b_con_m,
         coalesce(labels.quality = 1, false) AS golden
  FROM pairs LEFT JOIN labels ON labels.doc_id = pairs.a_doc
), r AS (
  SELECT *, ((1000 - conf_m) * share_m) // 1000 AS neuf_m,
         ((1000 - conb_m) * share_m) // 1000 AS neub_m
  FROM q
), s AS (
  SELECT *,
    (1000 - conf_m - neuf_m) / CAST(1000 AS DOUBLE) AS ent_fwd,
    neuf_m / CAST(1000 AS DOUBLE) AS neu_fwd, conf_m / CAST(1000 AS DOUBLE) AS con_fwd,
    (1000 - conb_m - neub_m) / CAST(1000 AS DOUBLE) AS ent_bwd,
    neub_m / CAST(1000 AS DOUBLE) AS neu_bwd, conb_m / CAST(1000 AS DOUBLE) AS con_bwd,
    CASE WHEN with_context AND h4 % 5 = 0 THEN neuf_m / CAST(2000 AS DOUBLE)
         WHEN with_context THEN neuf_m / CAST(1000 AS DOUBLE) END AS ctx_neu_fwd,
    CASE WHEN with_context AND h4 % 5 = 0 THEN neub_m / CAST(2000 AS DOUBLE)
         WHEN with_context THEN neub_m / CAST(1000 AS DOUBLE) END AS ctx_neu_bwd,
    CASE WHEN with_context THEN (1000 - conf_m - neuf_m) / CAST(1000 AS DOUBLE) END AS ctx_ent_fwd,
    CASE WHEN with_context THEN (1000 - conb_m - neub_m) / CAST(1000 AS DOUBLE) END AS ctx_ent_bwd,
    ((h2 * 7 + h3) % 1000) / CAST(1000 AS DOUBLE) AS sup_fwd,
    ((h2 * 3 + h4) % 1000) / CAST(1000 AS DOUBLE) AS sup_bwd,
    CASE WHEN rank % 3 = 0 THEN ((h3 * 5 + h4) % 1000) / CAST(1000 AS DOUBLE) END AS sup_gf,
    CASE WHEN rank % 5 = 0 THEN ((h1 * 3 + h2) % 1000) / CAST(1000 AS DOUBLE) END AS sup_gb,
    b_con_m / CAST(1000 AS DOUBLE) AS con_b, (1000 - b_con_m) / CAST(1000 AS DOUBLE) AS neu_b,
    h1 % 50 = 0 AS trunc_a, h2 % 40 = 0 AS trunc_s, h3 % 60 = 0 AS trunc_b,
    CASE WHEN conf_m >= 850 THEN 'CONTRADICTS' WHEN neuf_m >= 900 THEN 'NEUTRAL'
         WHEN (h2 * 7 + h3) % 1000 >= 850 THEN 'CORROBORATES'
         WHEN 1000 - conf_m - neuf_m >= 850 THEN 'REPEATS' ELSE 'NEUTRAL' END AS ensemble_verdict
  FROM r
)"""


ROSTERS = ("base", "half")

# A second roster: the same numbers with halved contradiction scores.
ROSTERS_SQL = SCORES_SQL + """, sr AS (
  SELECT 'base' AS roster, * FROM s UNION ALL
  SELECT 'half' AS roster, * REPLACE (con_fwd / 2 AS con_fwd, con_bwd / 2 AS con_bwd, con_b / 2 AS con_b)
  FROM s
)"""


def scored_pairs(
    spark: SparkSession, sf_dir: str, rosters: tuple[str, ...] = ROSTERS[:1]
) -> DataFrame:
    """Pairs with synthetic scores, labels, and the golden flag from ``labels``."""
    names = ", ".join(f"'{name}'" for name in rosters)
    labels = load(spark, sf_dir, "labels").selectExpr("doc_id AS a_doc", "quality = 1 AS golden")
    drawn = pairs(spark, sf_dir).join(labels, "a_doc", "left").selectExpr(
        "* EXCEPT (golden)",
        f"explode(array({names})) AS roster",
        "coalesce(golden, false) AS golden",
        "CASE WHEN h1 % 20 < 15 THEN h2 % 22 ELSE h3 % 1000 END AS conf_m",
        "CASE WHEN h1 % 20 < 15 THEN (h2 + 5) % 22 ELSE (h3 + 300) % 1000 END AS conb_m",
        "CASE WHEN h4 % 10 < 6 THEN 960 + h2 % 40 WHEN h4 % 10 < 8 THEN h3 % 60 "
        "ELSE h3 % 1000 END AS share_m",
        "CASE WHEN h1 % 20 < 15 THEN h3 % 130 ELSE (h3 + h4) % 1000 END AS b_con_m",
    ).selectExpr(
        "*", "((1000 - conf_m) * share_m) div 1000 AS neuf_m",
        "((1000 - conb_m) * share_m) div 1000 AS neub_m",
    )
    flat = drawn.selectExpr(
        "*", "CASE WHEN roster = 'half' THEN 0.5D ELSE 1D END AS factor"
    ).selectExpr(
        "*",
        "(1000 - conf_m - neuf_m) / 1000D AS ent_fwd", "neuf_m / 1000D AS neu_fwd",
        "conf_m / 1000D * factor AS con_fwd",
        "(1000 - conb_m - neub_m) / 1000D AS ent_bwd", "neub_m / 1000D AS neu_bwd",
        "conb_m / 1000D * factor AS con_bwd",
        "neuf_m / CASE WHEN h4 % 5 = 0 THEN 2000D ELSE 1000D END AS ctx_neu_fwd",
        "neub_m / CASE WHEN h4 % 5 = 0 THEN 2000D ELSE 1000D END AS ctx_neu_bwd",
        "((h2 * 7 + h3) % 1000) / 1000D AS sup_fwd", "((h2 * 3 + h4) % 1000) / 1000D AS sup_bwd",
        "CASE WHEN rank % 3 = 0 THEN ((h3 * 5 + h4) % 1000) / 1000D END AS sup_gf",
        "CASE WHEN rank % 5 = 0 THEN ((h1 * 3 + h2) % 1000) / 1000D END AS sup_gb",
        "b_con_m / 1000D * factor AS con_b", "(1000 - b_con_m) / 1000D AS neu_b",
        "h1 % 50 = 0 AS trunc_a", "h2 % 40 = 0 AS trunc_s", "h3 % 60 = 0 AS trunc_b",
        """CASE WHEN conf_m >= 850 THEN 'CONTRADICTS' WHEN neuf_m >= 900 THEN 'NEUTRAL'
           WHEN (h2 * 7 + h3) % 1000 >= 850 THEN 'CORROBORATES'
           WHEN 1000 - conf_m - neuf_m >= 850 THEN 'REPEATS' ELSE 'NEUTRAL' END
           AS ensemble_verdict""",
    )

    def nli(ent: str, neu: str, con: str, cut: str) -> str:
        return (
            f"named_struct('entailment', {ent}, 'neutral', {neu}, 'contradiction', {con}, "
            f"'truncated', {cut})"
        )

    def support(name: str) -> str:
        return (
            f"CASE WHEN {name} IS NOT NULL THEN "
            f"named_struct('support', {name}, 'truncated', trunc_s) END"
        )

    family_b = nli("0D", "neu_b", "con_b", "trunc_b")
    ctx_fwd = nli("ent_fwd", "ctx_neu_fwd", "con_fwd", "false")
    ctx_bwd = nli("ent_bwd", "ctx_neu_bwd", "con_bwd", "false")
    grounded = "CASE WHEN sup_gb IS NULL OR sup_gf >= sup_gb THEN sup_gf ELSE sup_gb END"
    return flat.selectExpr("*", f"{grounded} AS sup_g").selectExpr(
        "*",
        f"{support('sup_gf')} AS grounded_fwd", f"{support('sup_gb')} AS grounded_bwd",
        f"named_struct('fwd', {nli('ent_fwd', 'neu_fwd', 'con_fwd', 'trunc_a')}, "
        f"'bwd', {nli('ent_bwd', 'neu_bwd', 'con_bwd', 'false')}, "
        f"'ctx_fwd', CASE WHEN with_context THEN {ctx_fwd} END, "
        f"'ctx_bwd', CASE WHEN with_context THEN {ctx_bwd} END) AS g1",
        f"named_struct('fwd', {support('sup_fwd')}, 'bwd', {support('sup_bwd')}, "
        f"'grounded', {support('sup_g')}) AS g2",
        f"named_struct('fwd', {family_b}, 'bwd', {family_b}) AS g3",
    )


# --- the cascade in SQL ---------------------------------------------------------------


def cascade_sql(source: str = "s", **t: str) -> str:
    """CTEs ``f`` (features) and ``c`` (decisions of every gate and the outcome).

    ``t`` replaces a threshold by an SQL expression over ``source``.
    """
    th = {
        "neutral_min": "0.95", "repeat_min": "0.90", "contra_escape": "0.02",
        "support_min": "0.90", "support_floor": "0.50", "contra_min": "0.85",
        "neutral_consensus": "0.10", **t,
    }
    th = {k: f"CAST({v} AS DOUBLE)" for k, v in th.items()}
    return f"""f AS (
  SELECT *, greatest(con_fwd, con_bwd) AS a_contra, least(neu_fwd, neu_bwd) AS a_neutral,
    least(ent_fwd, ent_bwd) AS a_entail, con_b AS b_contra,
    CASE WHEN with_context THEN least(ctx_neu_fwd, ctx_neu_bwd) END AS c_neutral,
    CASE WHEN with_context THEN least(ctx_ent_fwd, ctx_ent_bwd) END AS c_entail,
    greatest(sup_gf, sup_gb) AS sup_grounded,
    greatest(sup_fwd, sup_bwd, sup_gf, sup_gb) AS support,
    CASE WHEN greatest(sup_gf, sup_gb) >= greatest(sup_fwd, sup_bwd) THEN 'GROUNDED'
         WHEN sup_fwd >= sup_bwd THEN 'FORWARD' ELSE 'BACKWARD' END AS direction,
    neu_fwd >= ent_fwd AND neu_fwd >= con_fwd AND neu_bwd >= ent_bwd AND neu_bwd >= con_bwd
      AND neu_b >= con_b AS leans
  FROM {source}
), c1 AS (
  SELECT *, a_contra > {th['contra_escape']} AS flag,
    CASE WHEN a_neutral >= {th['neutral_min']} THEN 'NEUTRAL'
         WHEN a_entail >= {th['repeat_min']} THEN 'REPEATS' END AS bare,
    CASE WHEN c_neutral >= {th['neutral_min']} THEN 'NEUTRAL'
         WHEN c_entail >= {th['repeat_min']} THEN 'REPEATS' END AS ctxd,
    CASE WHEN support >= {th['support_min']} THEN 'DECIDED' ELSE 'FORWARD' END AS d2,
    support < {th['support_floor']} AS below_floor,
    CASE WHEN a_contra >= {th['contra_min']} AND b_contra >= {th['contra_min']} THEN 'ROUTE_HUMAN'
         WHEN a_contra < {th['neutral_consensus']} AND b_contra < {th['neutral_consensus']}
              AND leans THEN 'DECIDED' ELSE 'ESCALATE_G4' END AS d3
  FROM f
), c2 AS (
  SELECT *, CASE WHEN flag THEN 'FORWARD'
    WHEN with_context AND bare IS DISTINCT FROM ctxd THEN 'ESCALATE_G4'
    WHEN bare IS NOT NULL THEN 'DECIDED' ELSE 'FORWARD' END AS d1
  FROM c1
), c AS (
  SELECT *,
    CASE WHEN d1 <> 'FORWARD' THEN 'G1_NEUTRAL'
         WHEN NOT flag AND d2 = 'DECIDED' THEN 'G2_CORROBORATION'
         ELSE 'G3_CONTRADICTION' END AS at_gate,
    CASE WHEN d1 <> 'FORWARD' THEN d1 WHEN NOT flag AND d2 = 'DECIDED' THEN d2 ELSE d3 END
      AS disposition,
    CASE WHEN d1 = 'DECIDED' THEN bare WHEN d1 <> 'FORWARD' THEN NULL
         WHEN NOT flag AND d2 = 'DECIDED' THEN 'CORROBORATES'
         WHEN d3 = 'DECIDED' THEN 'NEUTRAL' END AS verdict,
    CASE WHEN d1 = 'ESCALATE_G4' THEN 'CONTEXT_DISAGREEMENT' WHEN d1 <> 'FORWARD' THEN NULL
         WHEN NOT flag AND d2 = 'DECIDED' THEN NULL
         WHEN d3 = 'ROUTE_HUMAN' THEN 'CONTRADICTION_SIGNAL'
         WHEN d3 = 'ESCALATE_G4' THEN 'STAGE_DISAGREEMENT' END AS reason,
    CASE WHEN d1 <> 'FORWARD' THEN NULL WHEN NOT flag AND d2 = 'DECIDED' THEN support
         WHEN d3 = 'ROUTE_HUMAN' THEN least(a_contra, b_contra) END AS confidence
  FROM c2
)"""


CASCADE_SQL = SCORES_SQL + ",\n" + cascade_sql()


# --- runs -----------------------------------------------------------------------------


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One run per document source, all with the default settings."""
    text = settings.canonical_json(settings.snapshot())
    return load(spark, sf_dir, "documents").select("source").distinct().select(
        F.col("source").alias("stage3_run_id"),
        F.concat(F.lit("req-"), "source").alias("run_request_id"),
        F.lit("subject").alias("subject_id"),
        F.lit("CASCADE").alias("judge_mode"),
        F.lit(1).alias("attempt"),
        F.lit(text).alias("snapshot"),
    )


def start_state(scored: DataFrame) -> DataFrame:
    """The pair table before any gate has run."""
    return scored.select(
        "pair_id", F.col("run_id").alias("stage3_run_id"), F.lit("intake").alias("intake_id"),
        "a_id", "b_id", "low_id", "high_id", "rank", "with_context",
        F.lit(False).alias("human_asserted"), F.lit("CASCADE").alias("tier"),
        F.lit("G1_NEUTRAL").alias("gate"), F.lit(False).alias("contradiction_flag"),
        F.lit(None).cast("string").alias("decided_by"),
        F.lit(None).cast("string").alias("run_request_id"),
    )


def scores_of(scored: DataFrame) -> DataFrame:
    return scored.select("pair_id", "g1", "g2", "g3", "grounded_fwd", "grounded_bwd")
