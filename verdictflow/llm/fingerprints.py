"""Document fingerprints: invertible Bloom lookup sketches of paragraph digests.

A text is cut into paragraphs: lines; where that gives fewer than ``PIECES``, sentences; where that
gives fewer, words. A paragraph's digest is a 64-bit hash of its bytes and of how often it has come
before in the text, so repeats count. The sketch has cells in three parts; every digest is entered
once in each part (count, exclusive-or of digests, exclusive-or of check values). Subtracting two
sketches leaves the digests that differ, and peeling cells that hold a single one recovers them
all, or shows that there were too many. Then both texts are sketched again with more cells and
other hashes, until the difference is recovered. Likeness is shared over all digests.

The fingerprint is the sketch with ``CELLS`` cells, at the text's own level. Texts cut at different
levels are compared at the finer one.

For editions, documents must meet their successor in the order of ids. Blocks of neighbouring ids
are dealt out once; a block's first document also goes to the block before it, so that no
block waits for another and texts are shuffled once.

Defined cases: a null text counts as empty; an empty text has no paragraphs, is like another empty
text (1.0) and unlike any other (0.0); a null id comes first in order; of repeated ids the order is
that of their texts; a single document follows itself; an empty table gives an empty result; texts
are read whole, whatever their length.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import table
from .hashing import mix
from .streams import small_batches

PIECES = 12
CELLS = 24
BLOCK_CHARS = 8_000_000
MAX_BLOCKS = 20_000
BATCH_CHARS = 1_500_000
_SENTENCE = re.compile(r"[^.!?\n]+[.!?]*\s*|[.!?\n]+\s*")
_WORD = re.compile(r"\S+\s*|\s+")
_U = np.uint64
_EMPTY = np.empty(0, dtype=_U)


def pieces(text: str, level: int) -> list[str]:
    if not text:
        return []
    return text.split("\n") if level == 0 else (_SENTENCE if level == 1 else _WORD).findall(text)


def digests(text: str, level: int) -> np.ndarray:
    seen: dict[str, int] = {}
    out = []
    for piece in pieces(text, level):
        n = seen[piece] = seen.get(piece, -1) + 1
        # Small seeds are no good: on short pieces they only flip low bits.
        out.append(xxhash.xxh3_64_intdigest(piece, n * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
    return np.array(out, dtype=_U)


def level_of(text: str) -> int:
    if text.count("\n") + 1 >= PIECES:
        return 0
    return 1 if len(pieces(text, 1)) >= PIECES else 2


class Sketches:
    """Sketches of many texts side by side, ``thirds[i]`` cells in each part of sketch ``i``."""

    def __init__(self, thirds: np.ndarray, seed: int):
        self.thirds, self.seed = thirds.astype(np.int64), seed
        self.offset = np.concatenate(([0], np.cumsum(3 * self.thirds)))
        size = int(self.offset[-1])
        self.count, self.keys, self.checks = np.zeros(size, np.int64), np.zeros(size, _U), np.zeros(size, _U)

    def enter(self, owner: np.ndarray, values: np.ndarray, sign: np.ndarray | int) -> None:
        for part in range(3):
            drawn = mix(values + _U(0x51ED270B * (3 * self.seed + part + 1)))
            at = self.offset[owner] + part * self.thirds[owner] + (drawn % self.thirds[owner].astype(_U)).astype(np.int64)
            np.add.at(self.count, at, sign)
            np.bitwise_xor.at(self.keys, at, values)
            np.bitwise_xor.at(self.checks, at, self._check(values))

    @staticmethod
    def _check(values: np.ndarray) -> np.ndarray:
        return mix(values ^ _U(0xA5A5F00DCAFE1234)) & _U(0xFFFFFFFF)

    def text(self, i: int, level: int, n: int) -> str:
        own = slice(self.offset[i], self.offset[i + 1])
        data = self.count[own].astype("<i4").tobytes() + self.keys[own].astype("<u8").tobytes() + self.checks[own].astype("<u4").tobytes()
        return f"{level}.{n}." + base64.b85encode(data).decode()

    def minus(self, other: "Sketches", left: np.ndarray, right: np.ndarray) -> "Sketches":
        """Sketch ``left[i]`` of this less sketch ``right[i]`` of the other, all of one size."""
        out = Sketches(self.thirds[left], self.seed)
        width = 3 * int(self.thirds[0]) if len(self.thirds) else 0
        a, b = (self.offset[left][:, None] + np.arange(width)).ravel(), (other.offset[right][:, None] + np.arange(width)).ravel()
        out.count, out.keys, out.checks = self.count[a] - other.count[b], self.keys[a] ^ other.keys[b], self.checks[a] ^ other.checks[b]
        return out

    def peel(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(digests only on the left, only on the right, whether all were recovered) of each sketch."""
        n = len(self.thirds)
        only = [np.zeros(n, np.int64), np.zeros(n, np.int64)]
        cell_owner = np.repeat(np.arange(n), 3 * self.thirds)
        while True:
            pure = np.flatnonzero((np.abs(self.count) == 1) & (self.checks == self._check(self.keys)))
            if not len(pure):
                break
            owner, keys, sign = cell_owner[pure], self.keys[pure], self.count[pure]
            order = np.lexsort((keys, owner))
            owner, keys, sign = owner[order], keys[order], sign[order]
            first = np.ones(len(keys), bool)
            first[1:] = (owner[1:] != owner[:-1]) | (keys[1:] != keys[:-1])
            owner, keys, sign = owner[first], keys[first], sign[first]
            np.add.at(only[0], owner[sign > 0], 1)
            np.add.at(only[1], owner[sign < 0], 1)
            self.enter(owner, keys, -sign)
        left = np.zeros(n, bool)
        left[cell_owner[(self.count != 0) | (self.keys != 0)]] = True
        return only[0], only[1], ~left


def _flat(values: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    return np.repeat(np.arange(len(values)), [len(v) for v in values]), np.concatenate(values) if values else _EMPTY


def sketch(values: list[np.ndarray], thirds: np.ndarray, seed: int = 0) -> Sketches:
    out = Sketches(thirds, seed)
    out.enter(*_flat(values), 1)
    return out


def likeness(pairs: list[tuple[np.ndarray, np.ndarray]], first: Sketches | None = None) -> np.ndarray:
    """Shared over all digests of each pair; ``first`` may hold differences to begin with."""
    sizes = np.array([(len(a), len(b)) for a, b in pairs], dtype=np.int64).reshape(-1, 2)
    out = np.ones(len(pairs))
    todo, sketches, seed = np.arange(len(pairs)), first, 0
    while len(todo):
        if sketches is None:
            seed += 1
            thirds = (sizes[todo].sum(axis=1) * 2 ** (seed - 1) * 2) // 3 + 4
            sketches = Sketches(thirds, seed)
            sketches.enter(*_flat([pairs[i][0] for i in todo]), 1)
            sketches.enter(*_flat([pairs[i][1] for i in todo]), -1)
        a, b, whole = sketches.peel()
        done = todo[whole]
        union = sizes[done, 0] + b[whole]
        out[done] = np.where(union > 0, (sizes[done, 0] - a[whole]) / np.maximum(1, union), 1.0)
        todo, sketches = todo[~whole], None
    return out


def compare(texts: list[str], editions: list[str], successors: list[int]) -> tuple[list[str], list[str], np.ndarray, np.ndarray]:
    """Fingerprints of texts and editions, likeness to the edition, likeness to the next text.

    ``successors[i]`` is the number of the text after text i; only as many texts as there are
    editions are judged.
    """
    everything = texts + editions
    levels = [level_of(t) for t in everything]
    held: dict[tuple[int, int], np.ndarray] = {}

    def at(i: int, level: int) -> np.ndarray:
        if (i, level) not in held:
            held[i, level] = digests(everything[i], level)
        return held[i, level]

    base = sketch([at(i, levels[i]) for i in range(len(everything))], np.full(len(everything), CELLS // 3))
    n, m = len(editions), len(texts)

    def near(left: list[int], right: list[int]) -> np.ndarray:
        same = np.array([levels[i] == levels[j] for i, j in zip(left, right)], dtype=bool)
        out = np.empty(len(left))
        for part, begin in ((np.flatnonzero(same), True), (np.flatnonzero(~same), False)):
            if len(part):
                a, b = [left[p] for p in part], [right[p] for p in part]
                pairs = [(at(i, l := max(levels[i], levels[j])), at(j, l)) for i, j in zip(a, b)]
                out[part] = likeness(pairs, base.minus(base, np.array(a), np.array(b)) if begin else None)
        return out

    prints = [base.text(i, levels[i], len(held[i, levels[i]])) for i in range(len(everything))]
    own = list(range(n))
    return prints[:n], prints[m:], near(own, [m + i for i in own]), near(own, successors)


def edition(text: str, following: str) -> str:
    """The last quarter (rounded down) replaced by the first as many letters of the next text."""
    k = len(text) // 4
    return text[: len(text) - k] + following[:k]


SCHEMA = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
    "near_edited double, near_next double"
)


def fingerprint_editions(docs: DataFrame) -> DataFrame:
    """``SCHEMA`` for every row; one shuffle of the texts."""
    spark = docs.sparkSession
    small_batches(spark)
    least = -(1 << 63)
    rows = docs.select("doc_id", F.coalesce(F.col("doc_id"), F.lit(least)).alias("_o"), F.coalesce("text", F.lit("")).alias("text"))
    found = rows.agg(F.min("_o").alias("low"), F.sum(F.length("text") + 1).alias("chars")).first()
    if found.low is None:
        return spark.createDataFrame([], SCHEMA)
    count = max(1, min(MAX_BLOCKS, found.chars // BLOCK_CHARS))
    cuts = rows.agg(F.percentile_approx("_o", [i / count for i in range(1, count)] or [0.5], 10 * max(1_000, count))).first()[0]
    # Block starts are ids that exist; at most MAX_BLOCKS of them, whatever the table's size.
    starts = spark.sparkContext.broadcast(np.unique(np.array([found.low] + (cuts if count > 1 else []), dtype=np.int64)))

    @F.pandas_udf("array<long>")
    def blocks_of(ids: Iterator[pd.Series]) -> Iterator[pd.Series]:
        """2 * block, and for the first id of a block also 2 * the block before + 1."""
        for values in ids:
            at = np.searchsorted(starts.value, values.to_numpy(), side="right") - 1
            first = starts.value[at] == values.to_numpy()
            last = len(starts.value) - 1
            yield pd.Series([[2 * b, 2 * (b - 1 if b else last) + 1] if f else [2 * b] for b, f in zip(at.tolist(), first.tolist())])

    dealt = rows.select("doc_id", "_o", "text", F.explode(blocks_of(F.col("_o"))).alias("_b")).select(
        F.shiftright("_b", 1).alias("block"), (F.col("_b") % 2).alias("guest"), "_o", "doc_id", "text"
    )
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    arrow = to_arrow_schema(StructType.fromDDL(SCHEMA))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list = []
        texts: list[str] = []
        chars, block, closed = 0, None, True

        def flush() -> pa.RecordBatch:
            n = len(texts) - 1
            editions = [edition(texts[i], texts[i + 1]) for i in range(n)]
            own, edited, near_edited, near_next = compare(texts, editions, list(range(1, n + 1)))
            return pa.RecordBatch.from_pydict({
                "doc_id": ids[:n], "n_chars": [len(t) for t in texts[:n]],
                "edited_sha256": [hashlib.sha256(e.encode()).hexdigest() for e in editions],
                "fingerprint": own, "edited_fingerprint": edited, "near_edited": near_edited, "near_next": near_next,
            }, schema=arrow)

        for batch in batches:
            for b, guest, doc_id, text in zip(*(batch.column(c).to_pylist() for c in ("block", "guest", "doc_id", "text"))):
                if b != block:
                    ids, texts, chars, block, closed = [], [], 0, b, False
                if closed:
                    continue
                ids.append(doc_id)
                texts.append(text)
                chars += len(text)
                closed = guest == 1
                if len(texts) > 1 and (closed or chars >= BATCH_CHARS or len(texts) >= 1_000):
                    yield flush()
                    ids, texts, chars = ids[-1:], texts[-1:], len(texts[-1])

    return dealt.repartition("block").sortWithinPartitions("block", "guest", "_o", "text").mapInArrow(run, SCHEMA)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_editions(table(spark, sf_dir, "documents"))
