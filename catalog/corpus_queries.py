"""Raw verdict documents with varying field names, exported to a corpus."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from catalog import inputs as I
from catalog.registry import query
from verdictflow.session import checkpoint_root, stored
from verdictflow.functions import variants
from verdictflow.operators import documents as DO, hydrate as H
from verdictflow.plans import corpus as C, reports
from verdictflow.sources import corpus_io

# Documents come in four spellings; the last one carries no texts, so they are looked
# up. A document labelled toxic has no text anywhere.
_FIELDS = [
    # (member, variants it occurs in, Spark SQL, DuckDB SQL where it differs)
    ("claimAId", (0,), "a_id", None), ("claimBId", (0,), "b_id", None),
    ("claimA", (1,), "a_id", None), ("claimB", (1,), "b_id", None),
    ("sourceClaimId", (2,), "a_id", None), ("targetClaimId", (2,), "b_id", None),
    ("fromClaimId", (3,), "a_id", None), ("toClaimId", (3,), "b_id", None),
    ("claimAText", (0,), "a_text", None), ("claimBText", (0,), "b_text", None),
    ("claimATextSnapshot", (1,), "a_text", None), ("claimBTextSnapshot", (1,), "b_text", None),
    ("textA", (2,), "a_text", None), ("textB", (2,), "b_text", None),
    ("verdict", (0,), "lower(ensemble_verdict)", None),
    ("ensembleVerdict", (1,), "ensemble_verdict", None),
    ("judgeVerdict", (2, 3), "CASE WHEN rank = 7 THEN NULL ELSE ' ' || ensemble_verdict END", None),
    ("votes", (0,), "array(ensemble_verdict, 'neutral', '')", "[ensemble_verdict, 'neutral', '']"),
    ("ensembleVotes", (1,),
     "array(named_struct('verdict', 'repeats', 'label', NULL), named_struct('verdict', NULL, 'label', 'odd-one'))",
     "[{'verdict': 'repeats', 'label': NULL}, {'verdict': NULL, 'label': 'odd-one'}]"),
    ("ensemble", (2,),
     "named_struct('votes', named_struct('m1', 'contradicts', 'm2', ensemble_verdict))",
     "{'votes': {'m1': 'contradicts', 'm2': ensemble_verdict}}"),
    ("judgeVotes", (3,), "lower(ensemble_verdict)", None),
    ("golden", (0,), "golden", None), ("isGolden", (1,), "cast(golden AS int)", None),
    ("humanConfirmed", (2,), "'false'", None),
    ("withContext", (0, 1), "with_context", None), ("hasContext", (2,), "cast(with_context AS int)", None),
    ("sourceSnippet", (1,), "a_text", None),
    ("method", (0, 1, 3), "CASE WHEN rank = 5 THEN 'GK_G1_NLI' WHEN rank = 6 THEN 'Rule' WHEN rank = 7 THEN NULL ELSE 'ENSEMBLE' END", None),
    ("intakeId", (0, 1, 2, 3), "subject_id", None), ("stage3RunId", (0, 1, 2, 3), "run_id", None),
]


def _kept(expression: str, spellings) -> str:
    allowed = ", ".join(str(v) for v in spellings)
    return f"CASE WHEN a_doc % 4 IN ({allowed}) THEN {expression} END"


def raw_documents(spark, sf):
    """(doc_id, doc): one JSON document per pair, whole texts included."""
    joined = H.both_texts(I.scored_pairs(spark, sf), _texts(spark, sf), wanted=F.expr("a_doc % 4 <> 3"))
    members = ", ".join(f"'{name}', {_kept(sql, spell)}" for name, spell, sql, _ in _FIELDS)
    return joined.selectExpr("pair_id AS doc_id", f"to_json(named_struct({members})) AS doc")


def documents(spark, sf):
    return raw_documents(spark, sf).withColumn("doc", variants.parse("doc"))


def _texts(spark, sf):
    toxic = I.load(spark, sf, "labels").where("toxic = 1").select("doc_id")
    return I.load(spark, sf, "documents").join(toxic, "doc_id", "left_anti").select(
        F.col("doc_id").cast("string").alias("claim_id"), "text"
    )


_RAW_SQL = I.SCORES_SQL + """, texts AS (
  SELECT CAST(doc_id AS VARCHAR) AS claim_id, text FROM documents
  WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)
), j AS (
  SELECT s.*, ta.text AS a_text, tb.text AS b_text FROM s
  LEFT JOIN texts ta ON ta.claim_id = a_id LEFT JOIN texts tb ON tb.claim_id = b_id
), raw AS (
  SELECT j.*, to_json({""" + ", ".join(
    f"'{name}': {_kept(duck or sql, spell)}" for name, spell, sql, duck in _FIELDS
) + """}) AS doc FROM j
)"""


def _text_of(*names):
    return "coalesce(" + ", ".join(
        f"CASE WHEN json_type(doc, '$.{n}') <> 'NULL' THEN doc->>'$.{n}' END" for n in names
    ) + ", '')"


_RECORDS_SQL = _RAW_SQL + f""", rec AS (
  SELECT pair_id, a_doc, {_text_of('claimAId', 'claimA', 'sourceClaimId', 'fromClaimId')} AS claim_a_id,
    {_text_of('claimBId', 'claimB', 'targetClaimId', 'toClaimId')} AS claim_b_id,
    {_text_of('claimAText', 'claimATextSnapshot', 'textA')} AS own_a,
    {_text_of('claimBText', 'claimBTextSnapshot', 'textB')} AS own_b,
    upper(trim(replace({_text_of('verdict', 'ensembleVerdict', 'judgeVerdict')}, '-', '_'))) AS ensemble_verdict,
    CASE a_doc % 4 WHEN 0 THEN upper(doc->>'$.votes[0]') || ',NEUTRAL' WHEN 1 THEN 'REPEATS,ODD_ONE'
      WHEN 2 THEN 'CONTRADICTS,' || upper(doc->>'$.ensemble.votes.m2') ELSE upper(doc->>'$.judgeVotes') END AS votes,
    coalesce(doc->>'$.golden' = 'true' OR doc->>'$.isGolden' = '1' OR doc->>'$.humanConfirmed' = 'false', false) AS golden,
    coalesce(doc->>'$.withContext' = 'true' OR doc->>'$.hasContext' = '1', false) AS with_context,
    {_text_of('sourceSnippet')} AS source_snippet, {_text_of('intakeId')} AS intake_id,
    {_text_of('stage3RunId')} AS stage3_run_id,
    upper(coalesce(nullif({_text_of('method')}, ''), 'ENSEMBLE')) IN ('ENSEMBLE', 'RULE', 'EMBEDDING') AS is_label
  FROM raw
), looked AS (
  SELECT rec.*, is_label AND (own_a = '' OR own_b = '') AS lacking, ta.text AS ga, tb.text AS gb FROM rec
  LEFT JOIN texts ta ON ta.claim_id = claim_a_id LEFT JOIN texts tb ON tb.claim_id = claim_b_id
), marked AS (
  SELECT *, CASE WHEN lacking THEN coalesce(ga, own_a) ELSE own_a END AS claim_a_text,
    CASE WHEN lacking THEN coalesce(gb, own_b) ELSE own_b END AS claim_b_text,
    lacking AND (ga IS NOT NULL OR gb IS NOT NULL) AS hydrated
  FROM looked
), done AS (
  SELECT *, CASE WHEN NOT is_label THEN 'NOT_ENSEMBLE'
    WHEN claim_a_text <> '' AND claim_b_text <> '' AND ensemble_verdict <> '' THEN 'EXPORTED' ELSE 'UNUSABLE' END AS status
  FROM marked
)"""


def marked(spark, sf):
    return C.mark_documents(documents(spark, sf), claims=_texts(spark, sf))


@query("corpus_export", f"""WITH {_RECORDS_SQL}
SELECT pair_id, claim_a_id, claim_b_id, md5(claim_a_text) AS a_md5, md5(claim_b_text) AS b_md5,
  ensemble_verdict, votes, golden, with_context, md5(source_snippet) AS snippet_md5, intake_id, stage3_run_id,
  CAST(len(list_filter(string_split(votes, ','), lambda x: x = ensemble_verdict)) AS INTEGER) AS agreeing
FROM done WHERE status = 'EXPORTED'""")
def corpus_export(spark, sf):
    rows = C.export_corpus(marked(spark, sf))
    return rows.select(
        "pair_id", "claim_a_id", "claim_b_id", F.md5("claim_a_text").alias("a_md5"),
        F.md5("claim_b_text").alias("b_md5"), "ensemble_verdict",
        F.array_join("votes", ",").alias("votes"), "golden", "with_context",
        F.md5("source_snippet").alias("snippet_md5"), "intake_id", "stage3_run_id",
        variants.vote_agreement("votes", "ensemble_verdict").alias("agreeing"),
    )


@query("corpus_stats", f"""WITH {_RECORDS_SQL}
SELECT count(*) AS scanned, count(*) FILTER (status = 'EXPORTED') AS exported,
  count(*) FILTER (status = 'NOT_ENSEMBLE') AS skipped_not_ensemble,
  count(*) FILTER (status = 'UNUSABLE') AS skipped_unusable, count(*) FILTER (hydrated) AS hydrated,
  count(*) FILTER (status = 'EXPORTED' AND golden) AS golden,
  count(*) FILTER (status = 'EXPORTED' AND with_context) AS with_context,
  count(*) FILTER (status = 'UNUSABLE' AND claim_a_text = '') AS missing_claim_a_text,
  count(*) FILTER (status = 'UNUSABLE' AND claim_b_text = '') AS missing_claim_b_text,
  count(*) FILTER (status = 'UNUSABLE' AND ensemble_verdict = '') AS missing_verdict
FROM done""")
def corpus_stats(spark, sf):
    return C.corpus_stats(marked(spark, sf))


@query("verdict_histogram", f"""WITH {_RECORDS_SQL}
SELECT ensemble_verdict, count(*) AS pairs FROM done WHERE status = 'EXPORTED' GROUP BY 1""")
def verdict_histogram(spark, sf):
    return C.verdict_histogram(marked(spark, sf))


_STATS = (
    "scanned", "exported", "skipped_not_ensemble", "skipped_unusable", "hydrated", "golden", "with_context",
    "missing_claim_a_text", "missing_claim_b_text", "missing_verdict",
)


@query("stats_text", f"""WITH {_RECORDS_SQL}, st AS (
  SELECT count(*) AS scanned, count(*) FILTER (status = 'EXPORTED') AS exported,
  count(*) FILTER (status = 'NOT_ENSEMBLE') AS skipped_not_ensemble,
  count(*) FILTER (status = 'UNUSABLE') AS skipped_unusable, count(*) FILTER (hydrated) AS hydrated,
  count(*) FILTER (status = 'EXPORTED' AND golden) AS golden,
  count(*) FILTER (status = 'EXPORTED' AND with_context) AS with_context,
  count(*) FILTER (status = 'UNUSABLE' AND claim_a_text = '') AS missing_claim_a_text,
  count(*) FILTER (status = 'UNUSABLE' AND claim_b_text = '') AS missing_claim_b_text,
  count(*) FILTER (status = 'UNUSABLE' AND ensemble_verdict = '') AS missing_verdict
  FROM done
)
SELECT printf('export%s%s%s%d', chr(9), item, chr(9), v) AS line FROM (
  SELECT unnest({list(_STATS)}) AS item, unnest([{', '.join(_STATS)}]) AS v FROM st)
UNION ALL SELECT printf('label%spairs[%s]%s%d', chr(9), ensemble_verdict, chr(9), count(*)) FROM done WHERE status = 'EXPORTED' GROUP BY ensemble_verdict""")
def stats_text(spark, sf):
    """The statistics as lines of text."""
    # Both reports read one scan of the documents; of a text they ask only whether it is there.
    found = marked(spark, sf).select(
        "status", "hydrated", "golden", "with_context", "ensemble_verdict",
        *[F.substring(name, 1, 1).alias(name) for name in ("claim_a_text", "claim_b_text")],
    )
    rows = stored(found)
    return reports.lines(reports.corpus_facts(C.corpus_stats(rows), C.verdict_histogram(rows)))


@query("corpus_inspect", f"""WITH {_RAW_SQL}, k AS (
  SELECT unnest(json_keys(doc)) AS path, doc FROM raw
), present AS (
  SELECT path FROM k WHERE json_type(doc, '$.' || path) <> 'NULL'
  UNION ALL SELECT 'ensemble.votes' FROM raw WHERE json_type(doc, '$.ensemble') = 'OBJECT'
  UNION ALL SELECT 'ensemble.votes.' || unnest(['m1', 'm2']) FROM raw WHERE json_type(doc, '$.ensemble') = 'OBJECT'
)
SELECT path, count(*) AS documents FROM present GROUP BY path ORDER BY documents DESC, path LIMIT 60""")
def corpus_inspect(spark, sf):
    """The 60 most frequent paths over all documents; the 60 is the report's own limit."""
    return DO.most_common(DO.key_frequencies(documents(spark, sf)))


_RESOLVED_SQL = (f"""WITH {_RAW_SQL}, n AS (SELECT count(*) AS sampled, """ + ", ".join(
    "count(*) FILTER (" + " OR ".join(
        f"coalesce(json_type(doc, '$.{p}'), 'NULL') <> 'NULL'" for p in paths
    ) + f") AS {name}" for name, paths in DO.DEFAULT_PATHS.items()
) + """ FROM raw)
SELECT sampled, field, resolved FROM n UNPIVOT (resolved FOR field IN (""" + ", ".join(
    DO.DEFAULT_PATHS) + "))")


@query("corpus_resolved", _RESOLVED_SQL)
def corpus_resolved(spark, sf):
    return DO.resolvability(documents(spark, sf))


@query("corpus_unresolved", f"SELECT field FROM ({_RESOLVED_SQL}) WHERE resolved = 0")
def corpus_unresolved(spark, sf):
    return DO.unresolved(DO.resolvability(documents(spark, sf)))


@query("coerce_votes", f"""WITH {_RECORDS_SQL} SELECT pair_id, votes, golden FROM done""")
def coerce_votes(spark, sf):
    field_map = DO.FieldMap.from_options({"golden": DO.DEFAULT_PATHS["golden"]})
    doc = F.col("doc")
    found = documents(spark, sf).select(
        "doc_id", field_map.value(doc, "votes").alias("v"), field_map.value(doc, "golden").alias("g")
    )
    return found.select(
        F.col("doc_id").alias("pair_id"),
        F.array_join(variants.coerce_votes(F.col("v")), ",").alias("votes"),
        variants.truthy(F.col("g")).alias("golden"),
    )


@query("corpus_wire", f"""WITH {_RECORDS_SQL}
SELECT pair_id, md5(claim_a_text) AS a_md5, ensemble_verdict, golden, votes FROM done WHERE status = 'EXPORTED'""")
def corpus_wire(spark, sf):
    """Corpus rows to JSON lines and back through the reader's schema."""
    lines = C.export_corpus(marked(spark, sf)).select(corpus_io.to_wire().alias("line"))
    return corpus_io.refuse_problems(corpus_io.decode(lines, "line")).select(
        "pair_id", F.md5("claim_a_text").alias("a_md5"), "ensemble_verdict", "golden",
        F.array_join("votes", ",").alias("votes"),
    )


_LINES_SQL = """SELECT doc_id, doc_id % 7 AS m,
  '{"pairId":"p' || doc_id || '","ensembleVerdict":"NEUTRAL","votes":["NEUTRAL","' || lang || '"],"golden":' ||
  list_extract(['1', '0', 'true', 'false', '""', '"x"', '[]'], CAST(doc_id % 7 + 1 AS INTEGER)) || ',"claimAText":"' || md5(text) || '"}' AS good
FROM documents"""


@query("corpus_round_trip", f"""WITH l AS ({_LINES_SQL}), v AS (
  SELECT CASE WHEN doc_id % 11 = 0 THEN '{{"pairId":' WHEN doc_id % 13 = 0 THEN '{{"golden":1}}' ELSE good END AS line FROM l
), j AS (SELECT line, CASE WHEN json_valid(line) THEN line::JSON END AS doc FROM v)
SELECT coalesce(doc->>'$.pairId', '') AS pair_id, coalesce(doc->>'$.claimAText', '') AS claim_a_text,
  coalesce(array_to_string(CAST(doc->'$.votes' AS VARCHAR[]), ','), '') AS votes,
  coalesce(CASE json_type(doc, '$.golden') WHEN 'VARCHAR' THEN doc->>'$.golden' <> '' WHEN 'BOOLEAN' THEN doc->>'$.golden' = 'true'
    WHEN 'ARRAY' THEN json_array_length(doc, '$.golden') > 0 ELSE CAST(doc->>'$.golden' AS INTEGER) <> 0 END, false) AS golden,
  CASE WHEN doc IS NULL THEN 'not JSON' WHEN doc->>'$.pairId' IS NULL THEN 'no pair id' END AS problem
FROM j""")
def corpus_round_trip(spark, sf):
    """Corpus files of whole texts written and read back: good lines, broken lines and lines without an id."""
    flags = F.array(*map(F.lit, ("1", "0", "true", "false", '""', '"x"', "[]")))
    good = F.concat(
        F.lit('{"pairId":"p'), "doc_id", F.lit('","ensembleVerdict":"NEUTRAL","votes":["NEUTRAL","'), "lang", F.lit('"],"golden":'),
        F.element_at(flags, (F.col("doc_id") % 7 + 1).cast("int")), F.lit(","),
        F.when(F.col("text").isNotNull(), F.expr("substr(to_json(struct(text AS claimAText)), 2)")),
    )
    lines = I.load(spark, sf, "documents").select(
        F.when(F.col("doc_id") % 11 == 0, '{"pairId":').when(F.col("doc_id") % 13 == 0, '{"golden":1}').otherwise(good).alias("value")
    )
    path = f"{checkpoint_root(spark)}/corpus-{uuid.uuid4().hex}"
    corpus_io.write_lines(lines, path)
    return corpus_io.read_lines(spark, path).select(
        "pair_id", F.when(F.col("problem").isNull(), F.md5("claim_a_text")).otherwise(F.lit("")).alias("claim_a_text"),
        F.array_join("votes", ",").alias("votes"), "golden", "problem",
    )


@query("scan_edges", f"""WITH {I.PAIRS_SQL}
SELECT pair_id, edge_key FROM pairs WHERE run_id = (SELECT max(source) FROM documents)""")
def scan_edges(spark, sf):
    """Verdict rows of one run: an equality filter that reaches the scan."""
    last = I.load(spark, sf, "documents").agg(F.max("source")).head(1)[0][0]
    return DO.scan_edges(I.pairs(spark, sf), last, run_column="run_id").select("pair_id", "edge_key")


@query("sample_documents", """SELECT doc_id, md5(text) AS digest FROM documents ORDER BY doc_id LIMIT 200""")
def sample_documents(spark, sf):
    """The inspection sample: the first 200 documents, which is the operator itself."""
    return DO.sample(I.load(spark, sf, "documents"), 200).select("doc_id", F.md5("text").alias("digest"))


@query("fingerprint", f"""WITH {I.PAIRS_SQL}, d AS (
  SELECT ('0x' || substr(sha256(pair_id), 1, 15))::BIGINT AS d FROM pairs
)
SELECT count(*) AS records, count(*) || ':' || bit_xor(d) || ':' || CAST(sum(d) AS VARCHAR) AS fingerprint FROM d""")
def fingerprint(spark, sf):
    return C.fingerprint(I.pairs(spark, sf))
