"""Odd rows: nulls, empty and very long texts, ties, repeats, empty tables, clashing columns."""

import corpus_pipeline
import numpy as np
import pytest
from pyspark.sql import functions as F

from verdictflow.llm import boilerplate, common, decontaminate, fingerprints, mixing, neardup, packing, paragraphs, quality, tokens, urls

CLASHES = (
    "score predicted held_out size source_size target copies taken node root key keys sig set_a shard row block guest "
    "component component_id kept item_id similarity section start end count words names rule verdict _row _src _n _gone "
    "_r _rows _o _b a b u v m removed paragraph"
).split()
LONG = " ".join(f"w{i % 977}x{i % 31}" for i in range(60_000))
BENCH = "the quick brown fox jumps over the lazy dog while seven wizards quietly boil fresh nettle tea at noon"


def frame(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return docs.withColumns({c: F.lit(c) for c in CLASHES})


@pytest.fixture(scope="module")
def odd(spark):
    rows = [
        (1, None, "en", "a", None), (2, "", "en", "a", 0), (3, " \t\n ", "en", None, 4), (4, LONG, "en", "b", len(LONG)),
        (5, LONG, None, "b", len(LONG)), (6, "z" * 300_000, "en", "", 0), (7, "one", "en", "c", 3), (7, "one", "en", "c", 3),
        (None, "no id " + BENCH, "en", "c", 5), (None, None, None, None, None), (-9, f"lead {BENCH} tail", "en", "c", 1),
        (9, "\n".join(["short line"] * 2000), "en", "d", 1),
    ]
    return frame(spark, rows)


@pytest.fixture(scope="module")
def empty(spark):
    return frame(spark, []).where("false")


def test_mix(odd, empty):
    rows = mixing.mix_table(odd).collect()
    assert len(rows) == odd.count()
    assert {r.size for r in rows if r.doc_id in (1, 2, 3)} == {0}
    assert all(0 <= r.copies <= 2 and r.taken == r.copies * r["size"] for r in rows)
    mixed = mixing.mix(odd)
    assert mixed.columns == odd.columns and mixed.count() == sum(r.copies for r in rows)
    assert mixing.mix_table(empty).count() == 0 and mixing.mix(empty).count() == 0


def test_quality(spark, odd, empty):
    labels = spark.createDataFrame([(7, 1), (7, 0), (4, None), (None, 1)], "doc_id long, quality int")
    weights = quality.fit(odd, labels)
    assert not weights.any()  # nobody agrees on anything
    rows = quality.classify(odd, weights).collect()
    assert len(rows) == odd.count() and {r.score for r in rows} == {0.5} and {r.predicted for r in rows} == {1}
    assert quality.accepted(odd, weights).columns == odd.columns
    assert not quality.fit(empty, labels).any() and quality.classify(empty, weights).count() == 0


def test_near_duplicates(odd, empty):
    rows = neardup.near_duplicates(odd, k=3, percent=85).collect()
    assert len(rows) == odd.count()
    got = {(r.doc_id, r.component_id, r.kept) for r in rows}
    assert (5, 4, False) in got and (4, 4, True) in got and (7, 7, True) in got and (None, None, True) in got
    assert {r.n_shingles for r in rows if r.doc_id in (1, 2, 3)} == {0}
    kept = neardup.deduplicate(odd)
    # One of the two long texts and one of the repeated rows go.
    assert kept.columns == odd.columns and kept.count() == odd.count() - 2
    assert sorted(r.doc_id for r in kept.select("doc_id").where("doc_id IN (4, 5, 7)").collect()) == [4, 7]
    assert neardup.near_duplicates(empty).count() == 0 and neardup.deduplicate(empty).count() == 0


def test_paragraphs(odd, empty):
    rows = {(r.doc_id, r.removed) for r in paragraphs.repeated_paragraphs(odd).collect()}
    assert rows == {(4, False), (5, True)}  # one line each; short lines are left alone
    out = paragraphs.remove(odd)
    assert out.columns == odd.columns and out.count() == odd.count()
    assert {r.doc_id: r.text for r in out.where("doc_id in (4, 5)").collect()} == {4: LONG, 5: ""}
    assert paragraphs.repeated_paragraphs(empty).count() == 0 and paragraphs.repeated_pieces(empty).count() == 0
    cut = paragraphs.remove_pieces(odd)
    assert cut.columns == odd.columns and cut.count() == odd.count()
    assert len({r.text for r in cut.where("doc_id in (4, 5)").collect()}) == 2


def test_decontaminate(spark, odd, empty):
    bench = spark.createDataFrame([(1, BENCH), (2, None), (3, ""), (4, "too short"), (5, BENCH.upper())], "item_id long, text string")
    rows = {(r.doc_id, r.item_id) for r in decontaminate.leaks(odd, bench).collect()}
    assert rows == {(None, 1), (None, 5), (-9, 1), (-9, 5)}
    kept = decontaminate.clean(odd, bench)
    assert kept.columns == odd.columns and kept.count() == odd.count() - 2
    assert sorted(str(r.doc_id) for r in kept.select("doc_id").collect()) == sorted(["None"] + list("12345679") + ["7"])
    assert decontaminate.leaks(empty, bench).count() == 0 and decontaminate.leaks(odd, bench.where("false")).count() == 0


def test_packing_and_tokens(odd, empty):
    rows = packing.pack_documents(odd, length=512).collect()
    assert sum(r.n_tokens for r in rows) == sum(len(tokens.Encoder.read().ids(r.text)) + 1 for r in odd.collect())
    counted = tokens.count_tokens(odd).groupBy("doc_id").agg(F.sum("tokens_start").alias("n")).collect()
    assert {r.doc_id: r.n for r in counted}[7] == 2 and {r.doc_id: r.n for r in counted}[1] == 0
    assert packing.pack_documents(empty).count() == 0 and tokens.count_tokens(empty).count() == 0


def test_fingerprints(odd, empty, spark):
    rows = fingerprints.fingerprint_editions(odd).collect()
    assert len(rows) == odd.count()
    by = {r.doc_id: r for r in rows}
    assert by[1].fingerprint == by[2].fingerprint and by[4].fingerprint == by[5].fingerprint
    assert by[1].near_edited == 1.0 and by[1].near_next == 1.0 and by[4].near_next == 1.0 and by[3].near_next == 0.0
    assert all(0 <= v <= 1 for r in rows for v in (r.near_edited, r.near_next))
    assert fingerprints.fingerprint_editions(empty).count() == 0
    one = fingerprints.fingerprint_editions(odd.where("doc_id = 4")).first()
    assert one.near_next == 1.0 and one.n_chars == len(LONG)


def test_pages(spark):
    rows = [
        (1, None, None), (2, "", ""), (3, "nothing", "<p>x</p>"), (3, "nothing", "<p>x</p>"), (None, "http://h.org", "<p>y</p>"),
        (5, "https://" + "a" * 5_000 + ".org/" + "b" * 5_000, "<p>" + "long " * 50_000),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({c: F.lit(c) for c in CLASHES if c not in ("page_id",)})
    judged = urls.judge(pages).collect()
    assert len(judged) == len(rows)
    assert {(r.host, r.path, r.rule, r.verdict) for r in judged if r.page_id in (1, 2, 3)} == {("", "", None, "allow")}
    shown = pages.select("page_id", urls.host_of(F.col("url")).alias("host"), boilerplate.visible_text(F.col("html")).alias("text"))
    cleaned = boilerplate.drop_boilerplate(shown).collect()
    assert len(cleaned) == len(rows) and {r.n_lines for r in cleaned if r.page_id in (1, 2)} == {0}
    assert urls.judge(pages.where("false")).count() == 0 and boilerplate.drop_boilerplate(shown.where("false")).count() == 0


def test_pipeline_stages(spark, odd, empty):
    sf_dir = "/root/testdata/sf0.001"
    for docs in (odd, empty):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, sf_dir)
            assert out.columns == docs.columns
            out.count()
    assert np.isclose(packing.position_ids([0, 3], 5), [0, 1, 2, 0, 1]).all()


def test_rows_are_judged_by_their_own_text(spark):
    """Null and shared ids: a leak or a copy takes no other row with it."""
    bench = spark.createDataFrame([(1, BENCH)], "item_id long, text string")
    rows = [(None, f"lead {BENCH} tail"), (None, "clean without an id"), (1, "clean with an id"), (2, f"see {BENCH}"), (2, "clean with a shared id")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.text for r in decontaminate.clean(docs, bench).collect()) == ["clean with a shared id", "clean with an id", "clean without an id"]
    text = [" ".join(f"{name}{i}" for i in range(40)) for name in "abcd"]
    rows = [(5, text[0]), (None, text[0]), (None, text[1]), (None, text[1]), (7, text[0]), (7, text[2]), (7, text[2]), (9, text[3]), (11, text[3])]
    docs = spark.createDataFrame([(*r, n) for n, r in enumerate(rows)], "doc_id long, text string, n int").repartition(3)
    kept = neardup.deduplicate(docs).collect()
    assert sorted(str((r.doc_id, r.text[0])) for r in kept) == sorted(map(str, [(5, "a"), (None, "b"), (7, "c"), (9, "d")]))
    far = neardup.deduplicate(docs.withColumn("doc_id", F.expr("CASE WHEN doc_id = 9 THEN 9223372036854775807 ELSE doc_id END"))).collect()
    assert len(far) == 4 and {r.text[0] for r in far} == set("abcd")
    copies = spark.createDataFrame([(None, text[0])] * 500 + [(3, text[0] + " z")] + [(4, "")] * 3, "doc_id long, text string").repartition(4)
    assert sorted(str(r.doc_id) for r in neardup.deduplicate(copies).collect()) == ["3", "4", "4", "4"]


def test_rows_without_an_id_are_dealt_to_all_shards(spark):
    docs = spark.createDataFrame([(None, "same words in every row")] * 400, "doc_id long, text string").repartition(4)
    rows = packing.pack_documents(docs, shard_chars=500).collect()
    assert len({r.shard for r in rows}) > 10 and sum(len(r.doc_ids) for r in rows) == 400


def test_broadcasts_are_bounded_in_bytes(spark, empty):
    """Few rows with long arrays are no small side; neither rows nor an empty table change the answer."""
    def hinted(df, limit):
        return "ResolvedHint" in common.small_side(df, limit)._jdf.queryExecution().analyzed().toString()

    ids = spark.range(1000).withColumnRenamed("id", "doc_id")
    long_rows = ids.where("doc_id < 4").withColumn("wanted", F.transform(F.sequence(F.lit(1), F.lit(5000)), lambda x: F.struct(x.alias("a"), x.alias("b"))))
    assert hinted(ids, 1000 * 32) and not hinted(ids, 1000 * 32 - 1)
    assert not hinted(long_rows, 4 * 5000 * 16) and hinted(long_rows, 4 * 5000 * 40)
    assert hinted(empty.select("doc_id", "text"), 0)
    for limit in (0, 1 << 30):
        assert ids.join(common.small_side(long_rows, limit), "doc_id").count() == 4
