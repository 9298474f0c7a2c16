"""Importance resampling towards a target distribution, with bit-sliced sums.

Features are runs of words, each counted in one of ``BUCKETS`` buckets. A bucket's gain says in whole
thousandths how much likelier it is in the target (the benchmark) than in the documents. A
document's weight, the floored mean of the gains of its features, is summed by bits:

* its bucket counts become planes of ``BUCKETS`` bits, plane p holding bit p of every count,
* the gains are planes as well, in two's complement, so the top plane counts negatively,
* a pair of planes gives 2^(p + q) times the bits set in both (AND, popcount); the sum over all
  pairs is exact.

Texts are read twice and never shuffled: once for the counts of all buckets (at most ``BUCKETS``
rows leave a task), once for the weights. The draw takes the highest scores (weight plus Gumbel
noise from a digest of the id). The lowest score drawn is found from two histograms, each of a
few hundred rows; only the rows from there on are put in order, by a range shuffle and a prefix sum
of its partitions' counts, so no task holds them all.

Defined cases: null and empty texts have no features and weight 0; a null id counts as the empty
text in the noise; repeated rows are drawn one by one; equal scores go by id, nulls first, then
by the other columns; without a target every gain is that of empty counts; empty tables give an
empty result; texts of any length are read whole; extra columns are not read.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from verdictflow.operators.ordered import numbered

from . import hashing
from .common import table, written
from .streams import per_batch, small_batches

BUCKETS = 10_000
LONGEST = 1  # words of the longest feature
SHARE = 10  # percent of the documents that are long enough
LEAST_WORDS = 20
SEED = "2024"
STEP = 256  # scores in one cell of the first histogram
_LONG_WORD = 64


def _crc_table() -> np.ndarray:
    out = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        out = np.where(out & 1, (out >> 1) ^ np.uint32(0xEDB88320), out >> 1)
    return out


_CRC = _crc_table()


def feed(state: np.ndarray, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """crc32 states after the bytes ``start`` to ``end`` of ``data`` too, for many runs at once."""
    state, size = state.copy(), end - start
    for i in np.flatnonzero(size > _LONG_WORD).tolist():
        state[i] = zlib.crc32(data[start[i] : end[i]].tobytes(), int(state[i]) ^ 0xFFFFFFFF) ^ 0xFFFFFFFF
    open_ = np.flatnonzero((size > 0) & (size <= _LONG_WORD))
    for j in range(_LONG_WORD):
        if not len(open_):
            break
        held = state[open_]
        state[open_] = _CRC[(held ^ data[start[open_] + j]) & np.uint32(255)] ^ (held >> np.uint32(8))
        open_ = open_[size[open_] > j + 1]
    return state


def features(texts: list[bytes], longest: int = LONGEST, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number and bucket of every feature, words of every text)."""
    words = hashing.Words(texts, letters=True)
    begin, n = words.first, len(words.start)
    owner = np.repeat(np.arange(len(texts)), np.diff(begin))
    last = begin[1:][owner] if n else np.empty(0, dtype=np.int64)
    at = np.arange(n)
    state = np.full(n, 0xFFFFFFFF, dtype=np.uint32)
    owners, found = [], []
    for length in range(1, longest + 1):
        if length > 1:
            whole = at + length <= last
            at, state, last = at[whole], state[whole], last[whole]
            state = _CRC[(state ^ np.uint32(32)) & np.uint32(255)] ^ (state >> np.uint32(8))
        state = feed(state, words.data, words.start[at + length - 1], words.end[at + length - 1])
        owners.append(owner[at])
        found.append(((state ^ np.uint32(0xFFFFFFFF)) % np.uint32(buckets)).astype(np.int64))
    return np.concatenate(owners), np.concatenate(found), np.diff(begin)


def bucket_counts(texts: DataFrame, longest: int = LONGEST, buckets: int = BUCKETS) -> np.ndarray:
    """Features in each bucket over all rows; ``buckets`` numbers reach the driver."""
    small_batches(texts.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            for _, block in hashing.blocks(batch.column(0).to_pylist()):
                total += np.bincount(features(block, longest, buckets)[1], minlength=buckets)
        full = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"bucket": full, "n": total[full]})

    parts = texts.select(F.col("text").cast("binary")).mapInArrow(run, "bucket long, n long")
    out = np.zeros(buckets, dtype=np.int64)
    for r in parts.groupBy("bucket").agg(F.sum("n").alias("n")).toLocalIterator():
        out[r.bucket] = r.n
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Whole thousandths of the log of each bucket's smoothed share in the target over the source."""
    n, every, wanted = len(source), float(source.sum()), float(target.sum())
    return np.array(
        [math.floor(1000 * math.log(((t + 1) * (every + n)) / ((s + 1) * (wanted + n)))) for s, t in zip(source.astype(float), target.astype(float))],
        dtype=np.int64,
    )


def bits(rows: np.ndarray, places: np.ndarray, count: int, width: int) -> np.ndarray:
    """``count`` planes of ``width`` bits as 64-bit words, with the bits (row, place) set."""
    out = np.zeros((count, -(-width // 64)), dtype=np.uint64)
    np.bitwise_or.at(out, (rows, places >> 6), np.uint64(1) << (places & 63).astype(np.uint64))
    return out


def gain_planes(gain: np.ndarray) -> tuple[np.ndarray, list[int]]:
    """Planes of the gains in two's complement, and what a bit of each plane counts."""
    size = int(max(gain.max(initial=0), -gain.min(initial=0) - 1)).bit_length()
    row, place = np.nonzero((gain[None, :] >> np.arange(size + 1)[:, None]) & 1)
    return bits(row, place, size + 1, len(gain)), [1 << q for q in range(size)] + [-(1 << size)]


def plane_sums(owner: np.ndarray, bucket: np.ndarray, texts: int, planes: np.ndarray, values: list[int], buckets: int) -> np.ndarray:
    """Sum of gains over the features of each text, by AND and popcount of planes."""
    out = np.zeros(texts, dtype=np.int64)
    cell, count = np.unique(owner * buckets + bucket, return_counts=True)
    for p in range(int(count.max(initial=0)).bit_length()):
        own = cell[(count >> p) & 1 == 1]
        who, row = np.unique(own // buckets, return_inverse=True)
        held = bits(row, own % buckets, len(who), buckets)
        total = np.zeros(len(who), dtype=np.int64)
        for plane, value in zip(planes, values):
            total += value * np.bitwise_count(held & plane).sum(axis=1, dtype=np.int64)
        out[who] += total << p
    return out


def noise(doc_id: int | None, seed: str = SEED) -> int:
    """Gumbel noise in whole thousandths."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def weigh(docs: DataFrame, gain: np.ndarray, longest: int = LONGEST, seed: str = SEED) -> DataFrame:
    """doc_id, n_words, n_features, weight and score of every row."""
    buckets = len(gain)
    shared = docs.sparkSession.sparkContext.broadcast(gain_planes(gain))

    def run(batch: pa.RecordBatch) -> dict:
        planes, values = shared.value
        sums, counts, words = [], [], []
        for _, block in hashing.blocks(batch.column("text").to_pylist()):
            owner, bucket, n = features(block, longest, buckets)
            sums.append(plane_sums(owner, bucket, len(block), planes, values, buckets))
            counts.append(np.bincount(owner, minlength=len(block)))
            words.append(n)
        total, count = np.concatenate(sums), np.concatenate(counts)
        weight = np.where(count > 0, total // np.maximum(count, 1), 0)
        luck = np.array([noise(i, seed) for i in batch.column("doc_id").to_pylist()], dtype=np.int64)
        return {"doc_id": batch.column("doc_id"), "n_words": np.concatenate(words), "n_features": count, "weight": weight, "score": weight + luck}

    rows = docs.select("doc_id", F.col("text").cast("binary").alias("text"))
    return per_batch(rows, run, "doc_id long, n_words long, n_features long, weight long, score long")


def lowest_drawn(rows: DataFrame, count: int, step: int = STEP) -> int:
    """The ``count``-th highest score, from a histogram of cells and one of the cell it is in.

    Scores are logarithms in thousandths, so there are a few hundred cells whatever the table's size.
    """
    left, inside = count, rows
    for cell in (F.floor(F.col("score") / step), F.col("score")):
        held = {r.cell: r.n for r in inside.groupBy(cell.alias("cell")).agg(F.count("*").alias("n")).collect()}
        for key in sorted(held, reverse=True):
            if held[key] >= left:
                break
            left -= held[key]
        inside = rows.where(cell == key)
    return key


def draw(weighed: DataFrame, share: int = SHARE, least: int = LEAST_WORDS) -> DataFrame:
    """A written table of ``weigh`` -> doc_id, n_features, weight, score, rank (null if not drawn)."""
    able = weighed.where(F.col("n_words") >= least)
    count = share * able.count() // 100
    columns = ["doc_id", "n_features", "weight", "score"]
    if not count:
        return weighed.select(*columns, F.lit(None).cast("long").alias("rank"))
    high = F.coalesce((F.col("n_words") >= least) & (F.col("score") >= lowest_drawn(able, count)), F.lit(False))
    order = [F.col("score").desc(), F.col("doc_id").asc(), F.col("weight").asc(), F.col("n_features").asc()]
    ranked = numbered(weighed.where(high), [], order, "rank")
    rank = F.when(F.col("rank") <= count, F.col("rank"))
    return ranked.select(*columns, rank.alias("rank")).unionByName(weighed.where(~high).select(*columns, F.lit(None).cast("long").alias("rank")))


def resample(docs: DataFrame, target: DataFrame, longest: int = LONGEST, buckets: int = BUCKETS, share: int = SHARE, least: int = LEAST_WORDS, seed: str = SEED) -> DataFrame:
    gain = gains(bucket_counts(docs, longest, buckets), bucket_counts(target, longest, buckets))
    return draw(written(weigh(docs, gain, longest, seed)), share, least)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


# crc32 bit by bit: a table of 256 steps, then one look-up per byte of each distinct word.
ORACLE = rf"""
WITH RECURSIVE step(b, i, c) AS (
  SELECT range::BIGINT, 0, range::BIGINT FROM range(256)
  UNION ALL SELECT b, i + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM step WHERE i < 8
), crc AS MATERIALIZED (SELECT list(c ORDER BY b) AS t FROM step WHERE i = 8),
split AS MATERIALIZED (
  SELECT 0 AS target, doc_id AS id, row_number() OVER () AS row, regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
  UNION ALL
  SELECT 1, item_id, -row_number() OVER (), regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') FROM benchmark
), feature AS MATERIALIZED (SELECT target, row, unnest(w) AS word FROM split),
bucketed AS MATERIALIZED (
  SELECT word, xor(4294967295, list_reduce(
    list_prepend(4294967295, list_transform(range(1, len(hex(encode(word))), 2), lambda i: ('0x' || substr(hex(encode(word)), i, 2))::BIGINT)),
    lambda a, b: xor(a >> 8, crc.t[(xor(a, b) & 255) + 1]))) % {BUCKETS} AS bucket
  FROM (SELECT DISTINCT word FROM feature) CROSS JOIN crc
), counted AS (
  SELECT bucket, count(*) FILTER (target = 0)::DOUBLE AS s, count(*) FILTER (target = 1)::DOUBLE AS t
  FROM feature JOIN bucketed USING (word) GROUP BY bucket
), gain AS (
  SELECT bucket, floor(1000 * ln(((t + 1) * (sum(s) OVER () + {BUCKETS})) / ((s + 1) * (sum(t) OVER () + {BUCKETS}))))::BIGINT AS g FROM counted
), total AS (
  SELECT row, count(*) AS n, sum(g) AS g FROM feature JOIN bucketed USING (word) JOIN gain USING (bucket) WHERE target = 0 GROUP BY row
), scored AS (
  SELECT id AS doc_id, len(coalesce(w, [])) AS n_words, coalesce(n, 0)::BIGINT AS n_features, coalesce(floor(g::DOUBLE / n), 0)::BIGINT AS weight,
    floor(-1000 * ln(-ln((('0x' || substr(sha256('{SEED}:' || coalesce(id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS luck
  FROM split LEFT JOIN total USING (row) WHERE target = 0
), ranked AS (
  SELECT *, weight + luck AS score, n_words >= {LEAST_WORDS} AS able,
    row_number() OVER (PARTITION BY n_words >= {LEAST_WORDS} ORDER BY weight + luck DESC, doc_id NULLS FIRST, weight, n_features) AS r,
    count(*) FILTER (n_words >= {LEAST_WORDS}) OVER () AS many
  FROM scored
)
SELECT doc_id, n_features, weight, score, CASE WHEN able AND r <= {SHARE} * many // 100 THEN r END AS rank FROM ranked
"""
