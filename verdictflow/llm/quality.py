"""Quality classifier: hashed word n-gram logistic regression, trained by FTRL-proximal.

Features of a text are its words, its pairs of neighbouring words, and n-grams of up to three word
*shapes* (capitals, digits, last letters that are no letters, length, equality with the words
before), each hashed to one of ``2**BITS`` weights. A feature's value is its count over the number
of words, so a score is a sparse dot product: the mean weight along the text.

Training reads a bounded sample of labelled documents (``SAMPLE`` of them about, chosen by a hash
of the id, whatever the table's size). They are dealt to ``SHARDS`` tasks by the same hash; each
task makes ``EPOCHS`` passes of follow-the-regularised-leader updates, and the shards' weights are
averaged. The model has at most ``2**BITS`` numbers, so it may be sent to every task.

Defined cases: null and empty texts have no words and score by the bias alone; ids labelled twice
with different answers, and null labels, are not learned from; without labels of both kinds every
score is 0.5; a null id counts as the empty text in crc32; repeated rows score alike; texts of any
length are read whole, about ``hashing.BLOCK_BYTES`` at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from . import hashing
from .common import held_out, table
from .streams import small_batches

BITS = 18
SAMPLE = 8_000
SHARDS = 4
EPOCHS = 3
ALPHA, BETA, L1, L2 = 0.3, 1.0, 1e-5, 1e-5
SCALE = 16.0  # of the values, so that a few steps move a weight
THRESHOLD = 0.3

_U = np.uint64


def features(words: hashing.Words) -> np.ndarray:
    """(feature kinds, words) -> weight numbers; entry j of each kind belongs to word j."""
    h, raw = words.hash, words.raw
    n = len(h)
    if not n:
        return np.empty((5, 0), dtype=np.int32)
    begins = np.zeros(n + 2, dtype=bool)
    begins[words.first] = True
    begins = begins[:n]
    one = np.concatenate((h[:1], h[:-1]))
    one[begins] = _U(1)
    two = np.concatenate((one[:1], one[:-1]))
    two[begins] = _U(2)
    size = words.end - words.start
    last, prior = raw[words.end - 1], raw[words.end - 2]
    small = np.concatenate(([0], np.cumsum((raw >= 97) & (raw <= 122))))
    digit = np.concatenate(([0], np.cumsum((raw >= 48) & (raw <= 57))))
    letter = (last >= 128) | ((last >= 97) & (last <= 122)) | ((last >= 65) & (last <= 90))
    tail = np.where(letter, 0, last).astype(np.int64)
    tail2 = np.where(~letter & (size > 1) & (prior == last), 1, 0)
    upper = (raw[words.start] >= 65) & (raw[words.start] <= 90)
    shape = tail | (tail2 << 8) | (upper.astype(np.int64) << 9)
    shape |= (small[words.end] == small[words.start]).astype(np.int64) << 10
    shape |= (digit[words.end] > digit[words.start]).astype(np.int64) << 11
    shape |= np.minimum(size // 4, 7) << 12
    shape |= (h == one).astype(np.int64) << 15
    shape |= (h == two).astype(np.int64) << 16
    s = hashing.mix(shape.astype(_U) + _U(77))
    s1 = np.concatenate((s[:1], s[:-1]))
    s1[begins] = _U(3)
    s2 = np.concatenate((s1[:1], s1[:-1]))
    s2[begins] = _U(4)
    kinds = (h + _U(11), hashing.mix(h * _U(3) + one), s, hashing.mix(s * _U(3) + s1), hashing.mix(s * _U(9) + s1 * _U(3) + s2))
    return np.stack([(k >> _U(64 - BITS)).astype(np.int32) for k in kinds])


def train(texts, labels) -> tuple[np.ndarray, np.ndarray]:
    """Weight numbers and weights of one shard; the bias is the weight numbered ``2**BITS``."""
    docs = []
    for first, block in hashing.blocks(texts):
        words = hashing.Words(block)
        kinds = features(words)
        for i, (a, b) in enumerate(zip(words.first[:-1], words.first[1:])):
            ids, counts = np.unique(kinds[:, a:b], return_counts=True)
            values = counts * (SCALE / max(1, b - a))
            docs.append((np.append(ids, 1 << BITS), np.append(values, 1.0).astype(np.float32), float(labels[first + i])))
    z, n = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)

    def weights(zi, ni):
        return np.where(np.abs(zi) <= L1, 0.0, -(zi - np.sign(zi) * L1) / ((BETA + np.sqrt(ni)) / ALPHA + L2))

    for _ in range(EPOCHS):
        for ids, values, label in docs:
            zi, ni = z[ids], n[ids]
            w = weights(zi, ni)
            p = 1 / (1 + np.exp(-np.clip(w @ values, -30, 30)))
            g = (p - label) * values
            z[ids] = zi + g - (np.sqrt(ni + g * g) - np.sqrt(ni)) / ALPHA * w
            n[ids] = ni + g * g
    w = weights(z, n)
    used = np.flatnonzero(w)
    return used, w[used]


def score_texts(texts, weights: np.ndarray) -> np.ndarray:
    out = np.empty(len(texts))
    for first, block in hashing.blocks(texts):
        words = hashing.Words(block)
        per_word = weights[features(words)].sum(axis=0) if len(words.hash) else np.empty(0)
        total = np.concatenate(([0.0], np.cumsum(per_word)))
        a, b = words.first[:-1], words.first[1:]
        dot = (total[b] - total[a]) * SCALE / np.maximum(1, b - a) + weights[-1]
        out[first : first + len(block)] = 1 / (1 + np.exp(-np.clip(dot, -30, 30)))
    return out


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> np.ndarray:
    """Weights learned from rows that are not held out; zeros without labels of both kinds."""
    agreed = (
        labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
        .groupBy("doc_id").agg(F.min("quality").alias("_low"), F.max("quality").alias("_high"))
        .where("_low = _high").select("doc_id", F.col("_low").cast("double").alias("_label"))
    )
    found = agreed.agg(F.count("*").alias("n"), F.min("_label").alias("low"), F.max("_label").alias("high")).first()
    weights = np.zeros((1 << BITS) + 1)
    if not found.n or found.low == found.high:
        return weights
    # The same hash chooses on both sides, so only the sample's texts are shuffled.
    ticket = F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(1 << 30))
    chosen = ticket < min(1 << 30, int((1 << 30) * sample / found.n))
    rows = (
        docs.select("doc_id", "text").where(chosen)
        .join(agreed.where(chosen), "doc_id")
        .select("text", "_label", (ticket % SHARDS).alias("_shard"), F.xxhash64(F.col("doc_id").cast("string"), F.lit(7)).alias("_order"))
    )

    def shard(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["_order", "text"], kind="stable")
        ids, values = train(frame["text"].tolist(), frame["_label"].to_numpy())
        return pd.DataFrame({"feature": ids, "weight": values / SHARDS})

    # At most 2**BITS rows reach the driver, whatever the corpus.
    model = rows.groupBy("_shard").applyInPandas(shard, "feature long, weight double").groupBy("feature").agg(F.sum("weight").alias("weight")).toPandas()
    weights[model["feature"].to_numpy()] = model["weight"].to_numpy()
    return np.round(weights, 9)


def score(weights: np.ndarray, spark: SparkSession):
    """text column -> score column."""
    small_batches(spark)
    shared = spark.sparkContext.broadcast(weights.astype(np.float64))

    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(score_texts(texts.tolist(), shared.value))

    return scored


def classify(docs: DataFrame, weights: np.ndarray, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score and predicted of every row."""
    model = score(weights, docs.sparkSession)
    return docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), model(F.col("text")).alias("score")).withColumn(
        "predicted", (F.col("score") >= threshold).cast("int")
    )


def accepted(docs: DataFrame, weights: np.ndarray, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that are predicted to be of quality, all columns as they are."""
    model = score(weights, docs.sparkSession)
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), model(F.col("text")).alias("_score"))
    return packed.where(F.col("_score") >= threshold).select("_row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return classify(docs, fit(docs, table(spark, sf_dir, "labels")))
