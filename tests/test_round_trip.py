"""The registered round trip writes and reads whole texts."""

import hashlib
import json

from catalog import corpus_queries


def test_corpus_round_trip_holds_whole_texts(spark, tmp_path, monkeypatch):
    texts = {1: 'two\nlines, a "quote"', 2: "back\\slash\ttab\r\x01 end", 3: "long " * 20_000, 4: "", 5: "caf\u00e9 \u2028 \U0001f600"}
    rows = [(d, t, "en", "s", len(t)) for d, t in texts.items()]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    lines, write = [], corpus_queries.corpus_io.write_lines

    def seen(df, path):
        lines.extend(r.value for r in df.collect())
        return write(df, path)

    monkeypatch.setattr(corpus_queries.corpus_io, "write_lines", seen)
    got = {r.pair_id: (r.claim_a_text, r.problem) for r in corpus_queries.corpus_round_trip(spark, str(tmp_path)).collect()}
    assert {json.loads(x)["claimAText"] for x in lines} == set(texts.values())
    assert got == {f"p{d}": (hashlib.md5(t.encode()).hexdigest(), None) for d, t in texts.items()}
