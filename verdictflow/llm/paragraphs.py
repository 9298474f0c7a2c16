"""Repeated passages: MinHash banding of paragraphs, exact Jaccard, removals by components.

A paragraph is a line with at least ``MIN_WORDS`` words, or the fewest lines in a row, all shorter, that
together have as many; one begins at every short line that is not blank, so a repeated passage of
several lines is found wherever it stands. Its set are the shingles of ``K`` words.

A passage may also stand in the middle of a longer text. ``repeated_pieces`` therefore cuts further
paragraphs by content: windows of ``WINDOW`` words begin ``APART`` words before a hash of two words that is
least among its ``APART`` neighbours on both sides, so the same text is cut alike wherever it stands. What is
covered by windows that the same documents have, of which there are several, is a *piece*: it ends
where the holders change, so a passage is a piece of its own also inside a document that has
copies. Pieces are banded, compared and clustered just as lines are. A passage of 51 words is cut nowhere inside, and missed, about once in a
hundred times, one of 55 words once in several hundred.

Bands of three minima each are tuned for recall: paragraphs at the threshold 0.8 collide in none of
the 21 bands with a chance of 3e-7. Paragraphs that collide in a band and agree in enough minima
are candidates, full sets are compared exactly, and of every component all paragraphs but the one
first in (document, place) are to be removed. A band whose bucket is too full is read on into the
next minima, as far as it takes (see ``neardup.regions``). Equal paragraphs are one class before
that, so a passage in a third of all documents costs one comparison.

Components inside one document only are left alone: they repeat nothing across documents.

Defined cases: null and empty texts, and texts of fewer words, have no paragraphs; repeated rows of one id have
the same paragraphs, which count once; rows with a null id are not looked at; an empty table gives an
empty result; texts of any length are read whole; other columns are passed through by ``remove``.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import hashing
from .common import BROADCAST_BYTES, held_by, likely_rows, small_side, table, table_bytes, written
from .neardup import DEPTH, HASHES, SAME, _signed, link, shingle_bytes
from .streams import per_batch, small_batches

K = 5
PERCENT = 80
MIN_WORDS = 30
BAND = DEPTH
WINDOW = 32
APART = 4
#: Band t reads on from its own three minima through all others.
_BANDS = np.stack([(np.arange(HASHES) + BAND * t) % HASHES for t in range(HASHES // BAND)])


def signature_columns(values: np.ndarray, offset: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(minima, first and second sum that name the set) of each run of shingles."""
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(values)))
    other = np.concatenate((np.zeros(1, np.uint64), np.cumsum(hashing.mix(values ^ np.uint64(0x5DEECE66D)))))
    low, high = total[offset[1:]] - total[offset[:-1]], other[offset[1:]] - other[offset[:-1]]
    return hashing.minhashes(values, offset, HASHES), _signed(low), _signed(high)


def units(text: bytes) -> list[tuple[int, int, bytes]]:
    """(first line, number of lines, text) of the paragraphs of a text."""
    held = text.split(b"\n")
    counts = [len(line.split()) for line in held]
    out = []
    for i, total in enumerate(counts):
        j = i
        while 0 < total < MIN_WORDS and j + 1 < len(held) and counts[j + 1] < MIN_WORDS:
            j += 1
            total += counts[j]
        if total >= MIN_WORDS:
            out.append((i, j - i + 1, b"\n".join(held[i : j + 1])))
    return out


def sign_paragraphs(docs: DataFrame) -> DataFrame:
    """doc_id, paragraph (first line), n_lines and signature columns of every paragraph."""

    def sign(batch: pa.RecordBatch) -> dict:
        out: dict[str, list] = {name: [] for name in ("doc_id", "paragraph", "n_lines", "n_shingles", "set_a", "set_b", "sig")}
        held = [(d, *u) for d, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()) for u in units(text)]
        for first, block in hashing.blocks(x for *_, x in held):
            words = hashing.Words(block)
            values, offset = words.shingles(K)
            values, offset = hashing.distinct(values, offset)
            sig, low, high = signature_columns(values, offset)
            for j in range(len(block)):
                doc_id, i, n, _ = held[first + j]
                for name, value in zip(out, (doc_id, i, n, int(offset[j + 1] - offset[j]), int(low[j]), int(high[j]), sig[j].tobytes())):
                    out[name].append(value)
        return out

    rows = docs.where("doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id", F.col("text").cast("binary").alias("text"))
    return per_batch(
        rows, sign, "doc_id long, paragraph int, n_lines int, n_shingles long, set_a long, set_b long, sig binary"
    )


def named(signed: DataFrame) -> DataFrame:
    """A written table with a number, ``node``, for every row: aggregates of numbers need no sort."""
    return written(signed.withColumn("node", F.monotonically_increasing_id()))


def repeated_paragraphs(docs: DataFrame) -> DataFrame:
    """Every paragraph of a component that spans documents.

    doc_id, paragraph (its first line), n_lines, component_doc and component_paragraph (the first of the
    component), removed.
    """
    signed = named(sign_paragraphs(docs))

    def fetch(nodes: DataFrame) -> DataFrame:
        """A document's paragraphs in question are picked while its text is read, once."""
        wanted = written(
            nodes.join(signed.select("node", "doc_id", "paragraph", "n_lines"), "node")
            .groupBy("doc_id").agg(F.collect_set(F.struct("paragraph", "n_lines", "node", "root")).alias("wanted"))
        )

        def pick(batch: pa.RecordBatch) -> dict:
            found, texts = [], []
            for text, rows in zip(batch.column("text").to_pylist(), batch.column("wanted").to_pylist()):
                own = text.split(b"\n")
                for row in rows:
                    i, n = row["paragraph"], row["n_lines"]
                    if i + n <= len(own):
                        found.append(row)
                        texts.append(b"\n".join(own[i : i + n]))
            return {"root": [r["root"] for r in found], "node": [r["node"] for r in found], "shingles": shingle_bytes(texts, K)}

        return per_batch(texts_of(docs, wanted), pick, "root long, node long, shingles binary")

    return _members(signed, fetch, ["paragraph", "n_lines"], "component_paragraph")


def _members(signed: DataFrame, fetch, place: list[str], first_place: str) -> DataFrame:
    """Rows of all components that span documents, with the document and place of their first."""
    classes = link(signed, fetch, PERCENT, _BANDS).select(*SAME, "component")
    members = written(signed.select("doc_id", *place, *SAME).join(classes, SAME).select("doc_id", *place, "component").distinct())
    ends = members.groupBy("component").agg(F.min("doc_id").alias("component_doc"), F.max("doc_id").alias("_b")).where("component_doc <> _b")
    # The first place of the first document: numbers only, so no group is sorted.
    inside = members.join(ends.select("component", "component_doc"), "component")
    first = inside.where("doc_id = component_doc").groupBy("component").agg(F.min(place[0]).alias(first_place))
    return inside.join(first, "component").select(
        "doc_id", *place, "component_doc", first_place,
        ((F.col("doc_id") != F.col("component_doc")) | (F.col(place[0]) != F.col(first_place))).alias("removed"),
    )


def remove(docs: DataFrame, removals: DataFrame | None = None) -> DataFrame:
    """``docs`` with the repeated lines taken out of ``text``; all other columns as they are."""
    found = repeated_paragraphs(docs) if removals is None else removals
    line = F.explode(F.sequence("paragraph", F.col("paragraph") + F.col("n_lines") - 1))
    # At most a document's lines are collected.
    gone = found.where("removed").select(F.col("doc_id").alias("_doc"), line.alias("_line")).groupBy("_doc").agg(F.collect_set("_line").alias("_gone"))
    joined = docs.join(gone, docs["doc_id"] == gone["_doc"], "left")
    text, lost = docs["text"], gone["_gone"]
    kept = F.array_join(F.filter(F.split(text, "\n"), lambda x, i: ~F.array_contains(lost, i)), "\n")
    return joined.select(*[
        F.when(lost.isNotNull(), kept).otherwise(text).alias("text") if c == "text" else docs[f"`{c}`"] for c in docs.columns
    ])


# --- pieces inside longer texts -------------------------------------------------------


def windows(words: hashing.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, first word in the text, hash) of the windows cut by content."""
    h = words.hash
    if len(h) < WINDOW:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64)
    pairs = hashing.mix(h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:])
    least = np.ones(len(pairs), dtype=bool)
    for k in range(1, APART + 1):
        least[k:] &= pairs[k:] < pairs[:-k]
        least[:-k] &= pairs[:-k] <= pairs[k:]
    at = np.flatnonzero(least)
    text = np.searchsorted(words.first, at, side="right") - 1
    # A window holds all that chose it, so every document with its words has it, whatever stands around.
    at -= APART
    inside = (at >= words.first[text]) & (at + WINDOW <= words.first[text + 1])
    at, text = at[inside], text[inside]
    factors = hashing._powers(0xC2B2AE3D27D4EB4F, WINDOW + 1)[1:]
    own = (h[at[:, None] + np.arange(WINDOW)] * factors).sum(axis=1, dtype=np.uint64)
    return text, at - words.first[text], hashing.mix(own)


def _all_windows(docs: DataFrame) -> DataFrame:
    def cut(batch: pa.RecordBatch) -> dict:
        ids = batch.column("doc_id").to_numpy()
        found = [(ids[first + text], at, own) for first, block in hashing.blocks(batch.column("text").to_pylist()) for text, at, own in [windows(hashing.Words(block))]]
        doc_ids, at, own = (np.concatenate(x) for x in zip(*found))
        return {"doc_id": doc_ids, "first_word": at.astype(np.int32), "window": _signed(own)}

    return per_batch(_texts(docs), cut, "doc_id long, first_word int, window long")


def _texts(docs: DataFrame) -> DataFrame:
    return docs.where("doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id", F.col("text").cast("binary").alias("text"))


def texts_of(docs: DataFrame, wanted: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """(doc_id, text, what is wanted) of the documents in a written table of one row each.

    Where the table is too large to be broadcast, its ids alone may not be, and a bitmap of them never is: texts
    that nobody wants stay where they are.
    """
    texts, ids = _texts(docs), wanted.select("doc_id")
    held = texts.join(F.broadcast(ids), "doc_id", "left_semi") if table_bytes(ids) <= limit else likely_rows(texts, ids, "doc_id")
    return held.join(small_side(wanted, limit), "doc_id")


def runs(starts: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """(first word, number of words) of what windows, as (first word, holders), cover.

    Windows are joined where they touch and have the same holders.
    """
    out: list[list[int]] = []
    for at, holders in sorted(set(starts)):
        if out and at <= out[-1][1] and holders == out[-1][2]:
            out[-1][1] = at + WINDOW
        else:
            out.append([at, at + WINDOW, holders])
    return [(a, b - a) for a, b, _ in out]


def _span(words: hashing.Words, i: int, first_word: int, n_words: int) -> bytes:
    """Words of text ``i``, as they are written."""
    at = words.first[i] + first_word
    return words.raw[words.start[at] : words.end[at + n_words - 1]].tobytes()


def repeated_pieces(docs: DataFrame) -> DataFrame:
    """Every piece of a component that spans documents.

    doc_id, first_word and n_words, component_doc and component_word (of the first piece), removed.
    """
    cut = written(_all_windows(docs))
    # One number for all holders of a window, the same in each of them.
    shared = written(
        cut.groupBy("window").agg(
            F.min("doc_id").alias("_a"), F.max("doc_id").alias("_b"), F.count("*").alias("_n"),
            F.sum(F.xxhash64("doc_id").bitwiseAND(0xFFFFFFFF)).alias("_s"),
        )
        .where("_a <> _b").select("window", F.hash("_a", "_b", "_n", "_s").alias("holders"))
    )
    # Of a document at most its own windows are collected.
    starts = held_by(cut, shared, "window").groupBy("doc_id").agg(F.collect_set(F.struct("first_word", "holders")).alias("starts"))

    def cover(batch: pa.RecordBatch) -> dict:
        found = [runs([(w["first_word"], w["holders"]) for w in own]) for own in batch.column("starts").to_pylist()]
        return {"doc_id": batch.column("doc_id"), "pieces": [[{"first_word": a, "n_words": n} for a, n in own] for own in found]}

    # Texts meet what is covered, which is several windows a piece.
    covered = written(per_batch(starts, cover, "doc_id long, pieces array<struct<first_word: int, n_words: int>>"))

    def sign(batch: pa.RecordBatch) -> dict:
        out: dict[str, list] = {name: [] for name in ("doc_id", "first_word", "n_words", "n_shingles", "set_a", "set_b", "sig")}
        ids, pieces = batch.column("doc_id").to_pylist(), batch.column("pieces").to_pylist()
        held = []  # document, first word, words, text
        for first, block in hashing.blocks(batch.column("text").to_pylist()):
            words = hashing.Words(block)
            sizes = np.diff(words.first).tolist()
            for i, size in enumerate(sizes):
                found = [(p["first_word"], p["n_words"]) for p in pieces[first + i]]
                held += [(ids[first + i], *r, _span(words, i, *r)) for r in found if sum(r) <= size]
        for first, block in hashing.blocks(x for *_, x in held):
            values, offset = hashing.Words(block).shingles(K)
            values, offset = hashing.distinct(values, offset)
            sig, low, high = signature_columns(values, offset)
            for j in range(len(block)):
                doc_id, at, n, _ = held[first + j]
                for name, value in zip(out, (doc_id, at, n, int(offset[j + 1] - offset[j]), int(low[j]), int(high[j]), sig[j].tobytes())):
                    out[name].append(value)
        return out

    signed = named(per_batch(
        texts_of(docs, covered), sign,
        "doc_id long, first_word int, n_words int, n_shingles long, set_a long, set_b long, sig binary",
    ))

    def fetch(nodes: DataFrame) -> DataFrame:
        wanted = written(
            nodes.join(signed.select("node", "doc_id", "first_word", "n_words"), "node")
            .groupBy("doc_id").agg(F.collect_set(F.struct("first_word", "n_words", "node", "root")).alias("wanted"))
        )

        def pick(batch: pa.RecordBatch) -> dict:
            found, texts = [], []
            wanted = batch.column("wanted").to_pylist()
            for first, block in hashing.blocks(batch.column("text").to_pylist()):
                words = hashing.Words(block)
                for i, size in enumerate(np.diff(words.first).tolist()):
                    for row in wanted[first + i]:
                        if row["first_word"] + row["n_words"] <= size:
                            found.append(row)
                            texts.append(_span(words, i, row["first_word"], row["n_words"]))
            return {"root": [r["root"] for r in found], "node": [r["node"] for r in found], "shingles": shingle_bytes(texts, K)}

        return per_batch(texts_of(docs, wanted), pick, "root long, node long, shingles binary")

    return _members(signed, fetch, ["first_word", "n_words"], "component_word")


def remove_pieces(docs: DataFrame, pieces: DataFrame | None = None) -> DataFrame:
    """``docs`` with repeated pieces taken out of ``text``; all other columns as they are."""
    found = repeated_pieces(docs) if pieces is None else pieces
    gone = found.where("removed").groupBy(F.col("doc_id").alias("_doc")).agg(F.collect_set(F.struct("first_word", "n_words")).alias("_gone"))

    small_batches(docs.sparkSession)

    @F.pandas_udf("string")
    def without(texts: pd.Series, spans: pd.Series) -> pd.Series:
        out = []
        for text, own in zip(texts, spans):
            if text is None or own is None:
                out.append(text)
                continue
            data = text.encode()
            words, kept, done = hashing.Words([data]), [], 0
            for row in sorted(own, key=lambda r: r["first_word"]):
                a, b = row["first_word"], row["first_word"] + row["n_words"]
                begin = words.start[a] - 1
                kept.append(data[done : max(done, begin)])
                done = max(done, words.start[b] - 1 if b < len(words.start) else len(data))
            out.append((b"".join(kept) + data[done:]).decode())
        return pd.Series(out)

    joined = docs.join(gone, docs["doc_id"] == gone["_doc"], "left")
    return joined.select(*[without(docs["text"], gone["_gone"]).alias("text") if c == "text" else docs[f"`{c}`"] for c in docs.columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated paragraphs (by line) and pieces (by word), each with the first of its component."""
    docs = table(spark, sf_dir, "documents")
    nothing = F.lit(None).cast("int")
    by_line = repeated_paragraphs(docs).withColumns({"first_word": nothing, "n_words": nothing, "component_word": nothing})
    by_word = repeated_pieces(docs).withColumns({"paragraph": nothing, "n_lines": nothing, "component_paragraph": nothing})
    return by_line.unionByName(by_word)
