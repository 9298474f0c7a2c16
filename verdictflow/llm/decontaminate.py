"""Benchmark decontamination by SimHash windows, Hamming blocks and exact shingle similarity.

1. Words are runs of letters and digits, A-Z lowered. A window's fingerprint is the 64-bit SimHash
   of its pairs of neighbouring words.
2. An item is searched by windows of about its own size: the largest step of ``LADDER`` that any
   passage at the threshold must hold unbroken (``run_length``). All windows of that size of the
   item, and all of the documents at every word, are fingerprinted.
3. Fingerprints within ``RADIUS`` bits agree in one of ``RADIUS + 1`` blocks of 16 bits. One table
   per block therefore finds them all; the whole distance is then counted.
4. A candidate places the item in the document. The item-sized window there, and those up to
   ``SHIFT`` words beside it, are compared with the item by the shingles of ``K`` words, weighted
   by how often they occur (sum of smaller over sum of greater counts).

Documents are read once, where they lie, and only leaks leave a task. The index holds the items'
windows; benchmarks of more than ``ITEMS`` items are searched part by part.

Defined cases: null and empty texts leak nothing; an item with fewer than ``K`` words has no shingle
and is not searched; equal items are all reported; repeated documents are reported once per id;
rows without an id are searched and reported with a null id (``clean`` judges row by row); empty tables give an empty result;
texts of any length are searched whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import hashing
from .common import table
from .streams import small_batches

K = 5
THRESHOLD = 0.8
RADIUS = 3
SHIFT = 2
ITEMS = 20_000
LADDER = tuple(dict.fromkeys(int(5 * 2 ** (j / 2)) for j in range(28)))
SCHEMA = "doc_id long, item_id long, similarity double, start_word long"
_U = np.uint64


def run_length(n: int, k: int = K, threshold: float = THRESHOLD) -> int:
    """Words in a row that a window like an item of ``n`` words has at least in common with it.

    Of s shingles a share (1 - t) / (1 + t) may be lost, and a changed word costs k of them, or
    fewer near an end. So the ends may be short by that many words, or the middle broken.
    """
    lost = int((n - k + 1) * (1 - threshold) / (1 + threshold) + 1e-9)
    breaks = lost // k
    return max(k, (n - breaks - (lost - k * breaks)) // (breaks + 1))


def simhashes(features: np.ndarray, sizes: list[int]) -> dict[int, np.ndarray]:
    """size -> fingerprints of the windows of ``size`` words; entry i begins at word i.

    ``features[i]`` is the hash of words i and i + 1.
    """
    n = len(features) + 1
    if not len(features):
        return {size: np.empty(0, dtype=_U) for size in sizes}
    kind = np.uint8 if max(sizes) < 256 else np.uint16 if max(sizes) < 65_536 else np.uint32
    bits = np.unpackbits(features.view(np.uint8)).reshape(-1, 64)
    total = np.zeros((n, 64), dtype=kind)
    np.cumsum(bits, axis=0, dtype=kind, out=total[1:])
    out = {}
    for size in sizes:
        if n < size:
            out[size] = np.empty(0, dtype=_U)
            continue
        ones = total[size - 1 :] - total[: n - size + 1]
        out[size] = np.packbits(ones > (size - 1) // 2, axis=1).view(_U).ravel()
    return out


def _features(h: np.ndarray) -> np.ndarray:
    return hashing.mix(h[:-1] * _U(0x9E3779B97F4A7C15) + h[1:])


class Index:
    """Windows of the items by size, found through blocks of their fingerprints."""

    def __init__(self, ids: list[int], texts: list[str | None]):
        self.items: list[tuple[int, np.ndarray, int]] = []  # id, word hashes, words
        held: dict[int, list[tuple[int, int, int]]] = {}
        for item_id, text in zip(ids, texts):
            h = hashing.Words([(text or "").encode()], letters=True).hash
            if len(h) < K:
                continue
            size = max(s for s in LADDER if s <= run_length(len(h)))
            for offset, f in enumerate(simhashes(_features(h), [size])[size].tolist()):
                held.setdefault(size, []).append((f, len(self.items), offset))
            self.items.append((item_id, _counts(h, 0, len(h)), len(h)))
        self.sizes, self.tables = sorted(held), {}
        for size, rows in held.items():
            prints = np.array([r[0] for r in rows], dtype=_U)
            where = np.array([r[1:] for r in rows], dtype=np.int64)
            blocks = []
            for b in range(RADIUS + 1):
                own = _block(prints, b)
                order = np.argsort(own, kind="stable")
                begin = np.searchsorted(own[order], np.arange(65_537))
                blocks.append((order, begin, np.diff(begin) > 0))
            self.tables[size] = (prints, where, blocks)

    def near(self, size: int, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window, entry) pairs within the radius, each once per block that finds it."""
        own, _, blocks = self.tables[size]
        windows, entries = [], []
        for b, (order, begin, full) in enumerate(blocks):
            key = _block(prints, b)
            hit = np.flatnonzero(full[key])
            count = begin[key[hit] + 1] - begin[key[hit]]
            w = np.repeat(hit, count)
            at = np.arange(len(w)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(begin[key[hit]], count)
            e = order[at]
            keep = np.bitwise_count(prints[w] ^ own[e]) <= RADIUS
            windows.append(w[keep])
            entries.append(e[keep])
        return np.concatenate(windows), np.concatenate(entries)


def _block(prints: np.ndarray, b: int) -> np.ndarray:
    return ((prints >> _U(16 * b)) & _U(0xFFFF)).astype(np.int64)


def _counts(h: np.ndarray, begin: int, end: int) -> dict[int, int]:
    """Shingles of words ``begin`` to ``end`` with how often they occur."""
    out: dict[int, int] = {}
    words = h[begin:end].tolist()
    for i in range(len(words) - K + 1):
        key = hash(tuple(words[i : i + K]))
        out[key] = out.get(key, 0) + 1
    return out


def similarity(a: dict[int, int], b: dict[int, int]) -> float:
    less = sum(min(n, b.get(s, 0)) for s, n in a.items())
    more = sum(a.values()) + sum(b.values()) - less
    return less / more if more else 0.0


def search(texts: list, index: Index) -> Iterator[tuple[int, int, float, int]]:
    """(text number, item id, similarity, first word) for the best place of each leaked item."""
    for first, block in hashing.blocks(texts):
        words = hashing.Words(block, letters=True)
        h = words.hash
        if len(h) < K or not index.sizes:
            continue
        prints = simhashes(_features(h), index.sizes)
        places = set()
        for size in index.sizes:
            w, e = index.near(size, prints[size])
            if not len(w):
                continue
            doc = np.searchsorted(words.first, w, side="right") - 1
            inside = w + size <= words.first[doc + 1]
            _, where, _ = index.tables[size]
            begin = w - where[e, 1]
            places.update(zip(doc[inside].tolist(), where[e[inside], 0].tolist(), begin[inside].tolist()))
        best: dict[tuple[int, int], tuple[float, int]] = {}
        done = set()
        for doc, item, begin in places:
            _, shingles, n = index.items[item]
            low, high = int(words.first[doc]), int(words.first[doc + 1])
            for at in range(begin - SHIFT, begin + SHIFT + 1):
                a, b = max(low, at), min(high, at + n)
                if (doc, item, a, b) in done or b - a < K:
                    continue
                done.add((doc, item, a, b))
                found = (similarity(shingles, _counts(h, a, b)), low - a)
                if found > best.get((doc, item), (0.0, 0)):
                    best[doc, item] = found
        for (doc, item), (value, back) in sorted(best.items()):
            if value >= THRESHOLD - 1e-12:
                yield first + doc, index.items[item][0], value, -back


def indexes(benchmark: DataFrame) -> Iterator[Broadcast[Index]]:
    """The items' windows, at most about ``ITEMS`` items at a time."""
    items = benchmark.select("item_id", "text")
    parts = max(1, -(-items.count() // ITEMS))
    for part in range(parts):
        own = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == part).toPandas()
        yield benchmark.sparkSession.sparkContext.broadcast(Index(own["item_id"].tolist(), own["text"].tolist()))


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, similarity and start_word of each item that a document holds."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    spark = docs.sparkSession
    small_batches(spark)
    arrow = to_arrow_schema(StructType.fromDDL(SCHEMA))
    rows = docs.select("doc_id", F.col("text").cast("binary").alias("text"))
    found = None
    for shared in indexes(benchmark):

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                hits = list(search(batch.column("text").to_pylist(), shared.value))
                if hits:
                    number, item, value, start = zip(*hits)
                    yield pa.RecordBatch.from_arrays(
                        [batch.column("doc_id").take(pa.array(number)), pa.array(item, pa.int64()), pa.array(value, pa.float64()), pa.array(start, pa.int64())],
                        schema=arrow,
                    )

        one = rows.mapInArrow(run, SCHEMA)
        found = one if found is None else found.unionByName(one)
    return found.groupBy("doc_id", "item_id").agg(F.max(F.struct("similarity", -F.col("start_word"))).alias("_b")).select(
        "doc_id", "item_id", F.round("_b.similarity", 6).alias("similarity"), (-F.col("_b.col2")).alias("start_word")
    )


def _leaky(shared: Broadcast[Index]):
    """text column -> whether the text holds an item."""

    @F.pandas_udf("boolean")
    def leaky(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            held = np.zeros(len(texts), dtype=bool)
            held[[hit[0] for hit in search(texts.tolist(), shared.value)]] = True
            yield pd.Series(held)

    return leaky


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose own text holds no item; all columns as they are.

    Every row is judged by its text, whatever its id; only texts go to Python, and nothing is shuffled.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), "text")
    for shared in indexes(benchmark):
        rows = rows.where(~_leaky(shared)("text"))
    return rows.select("_row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
