"""What the review of the third round found: texts moved too often, work done twice, models from a sample."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from verdictflow.functions import probabilities as PB
from verdictflow.llm import anomalies
from verdictflow.operators import hydrate as H, models as M, scoring as S
from verdictflow.plans import corpus as C
from verdictflow.sources import corpus_io


def _requests(spark, texts, pairs):
    lookup = spark.createDataFrame(texts, "claim_id string, text string, explanation string")
    rows = spark.createDataFrame(pairs, "pair_id string, a_id string, b_id string, with_context boolean")
    forms = S.hydrated_forms(H.hydrate(rows, S.claim_digests(lookup)))
    return S.build_requests(forms), S.claim_bodies(lookup)


def test_a_text_that_many_pairs_name_is_dealt_out_whole(spark, monkeypatch):
    monkeypatch.setattr(S, "PAIRS_PER_HUB", 3)
    texts = [("hub", "long " * 50, None), ("note", "short", "context")] + [(f"c{i}", f"text {i}", None) for i in range(20)]
    pairs = [(f"p{i}", "hub", f"c{i}", False) for i in range(20)] + [("same", "c1", "c1", False), ("ctx", "note", "hub", True)]
    requests, bodies = _requests(spark, texts, pairs)
    wanted = {(r.task, r.text_key, r.premise, r.hypothesis) for r in requests.collect()}
    own = {r.digest: r.body for r in bodies.collect()}
    assert bodies.where("body = 'text 1'").count() == 1  # a text without context is one form
    fetched = S.fetch_texts(S.missing_requests(requests, [("m", S.NLI), ("g", S.GROUNDING)], None), bodies).collect()
    got = set()
    for r in fetched:
        assert (own[r.x], own[r.y]) == (r.text_x, r.text_y) and r.x <= r.y
        got |= {(w.task, w.text_key, *((r.y, r.x) if w.turned else (r.x, r.y))) for w in r.wanted}
    assert got == wanted and len(fetched) == 23  # contexts make a pair of texts of their own
    assert {tuple(r) for r in S.unique_requests(requests).collect()} == wanted


def test_only_the_shorter_text_of_a_pair_moves(spark):
    requests, bodies = _requests(spark, [("a", "x" * 900, None), ("b", "y", None)], [("p", "a", "b", False)])
    plan = S.fetch_texts(S.missing_requests(requests, [("m", S.NLI)], None), bodies)._jdf.queryExecution().optimizedPlan().toString()
    assert "text_hub" in plan and "size" in plan
    [row] = S.fetch_texts(S.missing_requests(requests, [("m", S.NLI)], None), bodies).collect()
    assert {row.text_x, row.text_y} == {"x" * 900, "y"} and len(row.wanted) == 2


def test_both_texts_equal_two_joins(spark):
    pairs = spark.createDataFrame([(1, "a", "b"), (2, "b", "a"), (3, "a", None), (4, "no", "b"), (5, "c", "c"), (6, "e", "a")], "n int, a_id string, b_id string")
    texts = spark.createDataFrame([("a", "long text"), ("b", "x"), ("b", "another, longer text"), ("c", None), ("e", ""), (None, "z")], "claim_id string, text string")
    want = pairs.join(texts.toDF("a_id", "a_text"), "a_id", "left").join(texts.toDF("b_id", "b_text"), "b_id", "left")
    got = H.both_texts(pairs, texts)
    order = ("n", "a_id", "b_id", "a_text", "b_text")
    assert sorted(map(repr, got.select(*order).collect())) == sorted(map(repr, want.select(*order).collect()))
    none = H.both_texts(pairs, texts, wanted=F.col("n") > 3)
    assert none.count() == want.count() and none.where("n <= 3 and (a_text is not null or b_text is not null)").count() == 0


def test_a_line_is_parsed_once(spark):
    lines = spark.createDataFrame([('{"pairId":"p","golden":1,"votes":["A",true],"claimAText":true}',), ("  ",)], "seed string").select(
        F.concat("seed", F.lit("")).alias("line")
    )
    decoded = corpus_io.refuse_problems(corpus_io.decode(lines, "line"))
    plan = decoded._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("parseJson") <= 1 or plan.count("parse_json") <= 1
    [row] = decoded.select("pair_id", "golden", "votes", "claim_a_text", "claim_b_text").collect()
    assert tuple(row) == ("p", True, ["A", "True"], "True", "")


def test_softmax_of_wide_rows_is_linear(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=n).tolist()) for i, n in enumerate((1, 2, 64, 4000))] + [(9, None), (10, [])]
    got = {r.i: r.p for r in spark.createDataFrame(rows, "i int, l array<double>").select("i", PB.to_probabilities("l").alias("p")).collect()}
    for i, logits in rows[1:4]:
        powers = np.exp(np.array(logits) - max(logits))
        assert np.allclose(got[i], powers / powers.sum())
    assert got[0] == pytest.approx([1 / (1 + np.exp(-rows[0][1][0]))]) and got[9] is None and got[10] == []


def test_the_threshold_and_the_trees_see_every_labelled_row(spark):
    n = 9000
    good = spark.range(n).select(F.col("id").alias("doc_id"), *[(F.col("id") / n).alias(r) for r in anomalies.RATIOS])
    drawn = anomalies.subsamples(good, trees=40, size=256)
    assert [len(own) for own in drawn] == [256] * 40
    assert len({round(v * n) for own in drawn for v in own[:, 0]}) > 0.6 * n  # trees draw from all rows, not from one sample
    rows = good.withColumn("_label", F.when(F.col("doc_id") < 40, 0).otherwise(1))
    forest = anomalies.Forest(drawn, np.zeros(8), np.ones(8))
    path = forest.paths(np.repeat(np.arange(n)[:, None] / n, 8, axis=1))

    def worth(cut):
        return np.mean(path[:40] < cut) - anomalies.CARE * np.mean(path[40:] < cut)

    # Whatever is labelled counts: one bin of paths is all that the cut may be off.
    assert worth(anomalies.calibrate(rows, forest)) >= worth(anomalies.threshold(path[40:], path[:40])) - 0.1
    many, few = np.arange(10.0), np.array([-2.0, -1.0])
    assert anomalies.threshold(many, few) == anomalies.best_cut(*[np.arange(-2.0, 10)] * 2, np.array([0] * 2 + [1] * 10), np.array([1] * 2 + [0] * 10))
