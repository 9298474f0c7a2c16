"""Quality rules: an isolation forest on rule statistics, calibrated by labelled rows.

1. Statistics of every whole text are counted in one pass and written (some numbers a row).
2. The forest grows on rows labelled good, so it knows where good documents are. A tree takes
   ``SUBSAMPLE`` of them and splits the box that holds *all* rows of the table at random places of
   random ``RATIOS``, until a cell holds one row or the tree is ``DEPTH`` deep. Splitting the box and
   not the subsample's own range lets a ratio that is the same for every good row be split too.
3. A row's path ends where its cell ends, plus the usual mean path of the rows in that cell. Rows
   far from all good ones fall into empty cells early: their mean path over all trees is short.
4. The threshold is calibrated on the labelled rows: the mean path below which the share of bad
   rows caught less ``CARE`` times the share of good rows lost is greatest, in the middle of the gap.

The fit reads every labelled row but those held out (``common.held_out``): each tree draws its
``SUBSAMPLE`` rows from all good ones, which is the method itself, and the threshold counts the paths of all
labelled rows in ``BINS`` to a step. The box, the statistics and the verdicts
cover all rows. The forest has at most ``TREES * 2 * SUBSAMPLE`` nodes, so it goes to every task.

Defined cases: null and empty texts have zeros throughout and fail the base rules; ids labelled
twice with different answers, null ids and null labels are not learned from; without good rows there
is no forest and the base rules decide alone; without bad ones no row is anomalous unless its path
is shorter than every good one's; repeated rows are judged alike; empty tables give an empty
result; texts of any length are read whole.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from . import hashing
from .common import held_out, table, written
from .streams import per_batch

WINDOW = 5
TREES = 100
SUBSAMPLE = 256
DEPTH = 12
CARE = 20.0
BINS = 4096
SEED = 11

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_marks", "n_upper", "n_letters", "n_echoes")
SCHEMA = "doc_id long, " + ", ".join(f"{name} long" for name in COUNTS)
RATIOS = ("symbols", "marks", "upper", "echoes", "dup_lines", "repeats", "word_length", "line_length")

_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_BYTES = np.arange(256)
_UPPER = (_BYTES >= 65) & (_BYTES <= 90)
_LETTER = _UPPER | ((_BYTES >= 97) & (_BYTES <= 122)) | (_BYTES >= 192)
_MARK = (_BYTES > 32) & (_BYTES < 127) & ~_LETTER & ~((_BYTES >= 48) & (_BYTES <= 57))
_HEAD = (_BYTES & 0xC0) != 0x80  # first byte of a code point
_SPACE = (_BYTES == 32) | ((_BYTES >= 9) & (_BYTES <= 13))


def repeated_words(words: hashing.Words, window: int = WINDOW) -> np.ndarray:
    """Words of each text that lie in a window of words found twice or more in that text."""
    begin, n = words.first, len(words.hash)
    count = np.diff(begin)
    prints, offset = words.shingles(window)
    owner = np.repeat(np.arange(len(count)), np.diff(offset))
    at = np.arange(len(prints)) - offset[owner] + begin[owner]
    whole = count[owner] >= window
    own = hashing.mix(prints[whole] + hashing.mix(owner[whole].astype(np.uint64) + np.uint64(1)))
    _, back, times = np.unique(own, return_inverse=True, return_counts=True)
    start = at[whole][times[back] > 1]
    change = np.zeros(n + 1, dtype=np.int64)
    np.add.at(change, start, 1)
    np.add.at(change, start + window, -1)
    inside = np.concatenate(([0], np.cumsum(np.cumsum(change[:-1]) > 0)))
    return inside[begin[1:]] - inside[begin[:-1]]


def echoes(words: hashing.Words) -> np.ndarray:
    """Words of each text that equal the word before."""
    same = np.zeros(len(words.hash) + 1, dtype=bool)
    same[1:-1] = words.hash[1:] == words.hash[:-1]
    same[words.first] = False
    total = np.concatenate(([0], np.cumsum(same[:-1])))
    return total[words.first[1:]] - total[words.first[:-1]]


def count_texts(texts: list[bytes]) -> dict[str, np.ndarray]:
    """``COUNTS`` of each text; words are ``[^\\x20\\x09-\\x0D]+``, letter case as it is."""
    words = hashing.Words(texts, lower=False)
    raw, base = words.raw, words.base

    def per_text(kind: np.ndarray) -> np.ndarray:
        total = np.concatenate(([0], np.cumsum(kind[raw])))
        return total[base[1:] - 1] - total[base[:-1]]

    lines = [[line for line in text.split(b"\n") if line.strip()] for text in texts]
    return {
        "n_words": np.diff(words.first), "word_chars": per_text(_HEAD & ~_SPACE), "n_symbols": per_text(_SYMBOL),
        "n_dup_lines": np.array([len(own) - len(set(own)) for own in lines], dtype=np.int64),
        "n_repeat_words": repeated_words(words),
        "n_lines": np.fromiter(map(len, lines), dtype=np.int64, count=len(lines)),
        "n_marks": per_text(_MARK), "n_upper": per_text(_UPPER), "n_letters": per_text(_LETTER), "n_echoes": echoes(words),
    }


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id and ``COUNTS`` of every row."""

    def run(batch: pa.RecordBatch) -> dict:
        parts = [count_texts(block) for _, block in hashing.blocks(batch.column("text").to_pylist())]
        return {"doc_id": batch.column("doc_id"), **{name: np.concatenate([p[name] for p in parts]) for name in COUNTS}}

    return per_batch(docs.select("doc_id", F.col("text").cast("binary").alias("text")), run, SCHEMA)


def ratios() -> list[Column]:
    def share(name: str, of: str) -> Column:
        return F.col(name) / F.greatest(F.col(of), F.lit(1))

    return [
        share("n_symbols", "word_chars").alias("symbols"), share("n_marks", "word_chars").alias("marks"),
        share("n_upper", "n_letters").alias("upper"), share("n_echoes", "n_words").alias("echoes"),
        share("n_dup_lines", "n_lines").alias("dup_lines"), share("n_repeat_words", "n_words").alias("repeats"),
        F.log1p(share("word_chars", "n_words")).alias("word_length"), F.log1p(share("n_words", "n_lines")).alias("line_length"),
    ]


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def mean_path(n: np.ndarray) -> np.ndarray:
    """Mean path of an unsuccessful search among ``n`` rows."""
    n = np.asarray(n, dtype=float)
    many = np.maximum(n, 2)
    return np.where(n < 2, 0.0, 2 * (np.log(many - 1) + np.euler_gamma) - 2 * (many - 1) / many)


class Forest:
    """Trees as arrays: split column (-1 in a leaf), split place, first of two children, path if it ends here."""

    def __init__(self, subsamples: list[np.ndarray], low: np.ndarray, high: np.ndarray, seed: int = SEED):
        draw = np.random.default_rng(seed)
        self.trees = [self._grow(own, low, high, draw) for own in subsamples]

    @staticmethod
    def _grow(rows: np.ndarray, low: np.ndarray, high: np.ndarray, draw: np.random.Generator):
        column, place, child, path = [], [], [], []
        todo = [(rows, low, high, 0)]
        for own, a, b, depth in todo:  # grows while it is walked
            wide = np.flatnonzero(b > a)
            if len(own) < 2 or depth == DEPTH or not len(wide):
                column.append(-1), place.append(0.0), child.append(0), path.append(depth + float(mean_path(len(own))))
                continue
            c = int(draw.choice(wide))
            cut = float(draw.uniform(a[c], b[c]))
            column.append(c), place.append(cut), child.append(len(todo)), path.append(0.0)
            left = own[:, c] < cut
            below, above = b.copy(), a.copy()
            below[c] = above[c] = cut
            todo += [(own[left], a, below, depth + 1), (own[~left], above, b, depth + 1)]
        return np.array(column), np.array(place), np.array(child), np.array(path)

    def paths(self, rows: np.ndarray) -> np.ndarray:
        """Mean path of each row, rounded so that equal rows compare equal everywhere."""
        total = np.zeros(len(rows))
        number = np.arange(len(rows))
        for column, place, child, path in self.trees:
            node = np.zeros(len(rows), dtype=np.int64)
            for _ in range(DEPTH):
                c = column[node]
                node = np.where(c < 0, node, child[node] + (rows[number, c] >= place[node]))
            total += path[node]
        return np.round(total / len(self.trees), 9)


def best_cut(first: np.ndarray, last: np.ndarray, good: np.ndarray, bad: np.ndarray, care: float = CARE) -> float:
    """The mean path under which rows are anomalous, out of rising bins of paths: their least and greatest path and what they count."""
    caught = (np.cumsum(bad) - bad) / max(1, bad.sum())
    lost = (np.cumsum(good) - good) / max(1, good.sum())
    best = int(np.argmax(caught - care * lost))
    return float((first[best] + last[best - 1]) / 2) if best else float(first[0])


def threshold(good: np.ndarray, bad: np.ndarray, care: float = CARE) -> float:
    """``best_cut`` with a bin for each path."""
    cuts = np.unique(np.concatenate((good, bad)))
    counts = [np.bincount(np.searchsorted(cuts, side), minlength=len(cuts)) for side in (good, bad)]
    return best_cut(cuts, cuts, *counts, care)


def subsamples(good: DataFrame, trees: int = TREES, size: int = SUBSAMPLE, seed: int = SEED) -> list[np.ndarray]:
    """``size`` rows for each tree, drawn from all of ``good``: those whose tickets of that tree are smallest."""
    ticket = F.pmod(F.xxhash64(F.lit(seed), F.col("_tree"), F.col("doc_id").cast("string")), F.lit(1 << 40))
    # Eight times as many rows as a tree wants are under this limit, so the smallest tickets are.
    limit = min(1 << 40, (1 << 40) * 8 * size // max(1, good.count()))
    order = Window.partitionBy("_tree").orderBy("_ticket", "doc_id", *RATIOS)
    rows = (
        good.withColumn("_tree", F.explode(F.sequence(F.lit(0), F.lit(trees - 1)))).withColumn("_ticket", ticket)
        .where(F.col("_ticket") < limit).withColumn("_place", F.row_number().over(order)).where(F.col("_place") <= size)
        .select("_tree", *RATIOS).orderBy("_tree", *RATIOS).toPandas()
    )
    tree, values = rows["_tree"].to_numpy(), rows[list(RATIOS)].to_numpy(dtype=float)
    return [values[tree == t] for t in range(trees)]


def calibrate(rows: DataFrame, forest: Forest) -> float:
    """The threshold by the paths of all of ``rows(_label, RATIOS)``."""
    shared = rows.sparkSession.sparkContext.broadcast(forest)

    def run(batch: pa.RecordBatch) -> dict:
        path = shared.value.paths(np.column_stack([batch.column(r).to_numpy() for r in RATIOS]))
        return {"path": path, "good": batch.column("good")}

    paths = per_batch(rows.select((F.col("_label") == 1).alias("good"), *RATIOS), run, "path double, good boolean")
    bins = paths.groupBy(F.floor(F.col("path") * BINS).alias("bin")).agg(
        F.min("path").alias("first"), F.max("path").alias("last"), F.count_if("good").alias("good"), F.count_if(~F.col("good")).alias("bad"),
    ).orderBy("bin").toPandas()
    return best_cut(*(bins[name].to_numpy() for name in ("first", "last", "good", "bad")))


def fit(stats: DataFrame, labels: DataFrame) -> tuple[Forest, float] | None:
    """Forest and threshold learned from all labelled rows of a written table of ``statistics``."""
    agreed = (
        labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
        .groupBy("doc_id").agg(F.min("quality").alias("_low"), F.max("quality").alias("_high"))
        .where("_low = _high").select("doc_id", F.col("_low").alias("_label"))
    )
    rows = written(stats.join(agreed, "doc_id").where(~base_failed()).select("doc_id", "_label", *ratios()))
    sides = stats.select(*ratios()).agg(*[F.min(r).alias(f"low_{r}") for r in RATIOS], *[F.max(r).alias(f"high_{r}") for r in RATIOS]).first()
    good = rows.where("_label = 1")
    if good.isEmpty():
        return None
    forest = Forest(subsamples(good), np.array([sides[f"low_{r}"] for r in RATIOS]), np.array([sides[f"high_{r}"] for r in RATIOS]))
    return forest, calibrate(rows, forest)


def judge(stats: DataFrame, model: tuple[Forest, float] | None) -> DataFrame:
    """doc_id, the base counts, base_failed, path (null without a forest) and kept of every row."""
    names = ["doc_id", *COUNTS[:5]]
    rows = stats.select(*names, base_failed().alias("base_failed"), *ratios())
    if model is None:
        return rows.select(*names, "base_failed", F.lit(None).cast("double").alias("path"), (~F.col("base_failed")).alias("kept"))
    shared = stats.sparkSession.sparkContext.broadcast(model)

    def run(batch: pa.RecordBatch) -> dict:
        forest, limit = shared.value
        path = forest.paths(np.column_stack([batch.column(r).to_numpy() for r in RATIOS]))
        failed = batch.column("base_failed").to_numpy(zero_copy_only=False)
        return {**{n: batch.column(n) for n in names}, "base_failed": failed, "path": path, "kept": ~failed & (path >= limit)}

    return per_batch(rows, run, ", ".join(f"{n} long" for n in names) + ", base_failed boolean, path double, kept boolean")


def judged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    stats = written(statistics(docs))
    return judge(stats, fit(stats, labels))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
