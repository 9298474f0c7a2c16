"""Token ids packed into rows of one length by best-fit-decreasing.

Documents are dealt by a hash of their id to shards of about ``SHARD_CHARS`` characters, so a shard
fits one task at any size of the corpus and reruns give the same rows. In a shard every document is
encoded and ended with the end-of-text id. Documents longer than a row are split; their full
pieces are rows of their own, and the last pieces are packed like short documents: longest first,
each into the fullest row that still holds it. A segment tree over the free room finds that row
in logarithmic time.

An output row is one row of the packed matrix of its shard: ``ids`` (``length`` little-endian
unsigned integers of ``width`` bytes, padded with the end-of-text id), ``n_tokens`` (without
padding), ``cu_seqlens`` (ends of the segments, with a leading 0), ``position_resets`` (the places
where positions start again from 0), and for each segment its document and the number of its piece.
Joining the pieces of a document in order gives its ids again: nothing is lost or repeated.

Defined cases: a null or empty text is the end-of-text id alone; repeated rows are packed each, next to
each other in order of text; a null id is packed with a null in ``doc_ids``; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import table
from .streams import per_group
from .tokens import END_OF_TEXT, Encoder

LENGTH = 2_048
SHARD_CHARS = 4_000_000
SCHEMA = (
    "shard long, row int, length int, width int, n_tokens int, ids binary, cu_seqlens array<int>, "
    "position_resets array<int>, doc_ids array<long>, pieces array<int>"
)


class RoomTree:
    """How many rows have each amount of free room, with the least sufficient room in O(log length)."""

    def __init__(self, length: int):
        self.leaves = 1 << length.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.rows: list[list[int]] = [[] for _ in range(length + 1)]

    def add(self, room: int, row: int) -> None:
        self.rows[room].append(row)
        self._change(room, 1)

    def _change(self, room: int, by: int) -> None:
        node = room + self.leaves
        while node:
            self.count[node] += by
            node >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """(row, room) of the fullest row with at least ``need`` free, taken out; None if there is none."""
        node = need + self.leaves
        if not self.count[node]:
            # Up until a right neighbour holds rows, then down along its left side.
            while node > 1 and not (node % 2 == 0 and self.count[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.leaves:
                node = 2 * node if self.count[2 * node] else 2 * node + 1
        room = node - self.leaves
        row = self.rows[room].pop()
        self._change(room, -1)
        return row, room


def pack(sizes: list[int], length: int) -> list[list[tuple[int, int]]]:
    """Rows of (document, piece): full pieces first, the rest by best-fit-decreasing."""
    rows = [[(i, p)] for i, n in enumerate(sizes) for p in range(n // length)]
    rest = sorted(((n % length, i) for i, n in enumerate(sizes) if n % length), key=lambda x: (-x[0], x[1]))
    tree = RoomTree(length)
    for n, i in rest:
        found = tree.take(n)
        if found is None:
            row, room = len(rows), length
            rows.append([])
        else:
            row, room = found
        rows[row].append((i, sizes[i] // length))
        if room > n:
            tree.add(room - n, row)
    return rows


def pack_documents(
    docs: DataFrame, encoder: Encoder | None = None, length: int = LENGTH, shard_chars: int = SHARD_CHARS, end_of_text: int = END_OF_TEXT
) -> DataFrame:
    """``SCHEMA``; one shuffle of the texts."""
    chars = docs.agg(F.sum(F.length("text") + 1)).first()[0] or 0
    shards = max(1, -(-chars // shard_chars))
    shared = docs.sparkSession.sparkContext.broadcast((encoder or Encoder.read()).ranks)
    width = 2 if end_of_text < 1 << 16 else 4

    def shard(group: pa.Table) -> dict[str, list]:
        own = Encoder(shared.value)
        kind = np.dtype(f"<u{width}")
        doc_ids = group.column("doc_id").to_pylist()
        ids = [np.append(own.ids(text), end_of_text).astype(kind) for text in group.column("text").to_pylist()]
        out: dict[str, list] = {name: [] for name in ("shard", "row", "length", "width", "n_tokens", "ids", "cu_seqlens", "position_resets", "doc_ids", "pieces")}
        number = group.column("shard")[0].as_py()
        for row, held in enumerate(pack([len(x) for x in ids], length)):
            parts = [ids[i][p * length : (p + 1) * length] for i, p in held]
            ends = np.cumsum([0] + [len(x) for x in parts])
            matrix = np.full(length, end_of_text, dtype=kind)
            matrix[: ends[-1]] = np.concatenate(parts)
            for name, value in zip(out, (
                number, row, length, width, int(ends[-1]), matrix.tobytes(), ends.tolist(), ends[:-1].tolist(),
                [doc_ids[i] for i, _ in held], [p for _, p in held],
            )):
                out[name].append(value)
        return out

    # Rows without an id are dealt by their place in the table, so they do not meet in one shard.
    dealt_by = F.xxhash64(F.coalesce(F.col("doc_id"), F.monotonically_increasing_id()).cast("string"), "text")
    dealt = docs.select("doc_id", "text", F.pmod(dealt_by, F.lit(shards)).alias("shard"))
    return per_group(dealt, "shard", ["doc_id", "text"], shard, SCHEMA)


def position_ids(resets: list[int], length: int) -> np.ndarray:
    """Positions of one packed row: they start from 0 at every reset."""
    at = np.zeros(length, dtype=np.int64)
    at[resets] = resets
    return np.arange(length) - np.maximum.accumulate(at)


def unpack(rows: DataFrame) -> DataFrame:
    """(doc_id, piece, ids binary) of every segment, to read packed rows back."""
    segments = F.explode(F.arrays_zip("doc_ids", "pieces", "position_resets", F.slice("cu_seqlens", 2, F.size("doc_ids")).alias("ends")))
    return rows.select("ids", "width", segments.alias("s")).select(
        F.col("s.doc_ids").alias("doc_id"), F.col("s.pieces").alias("piece"),
        F.expr("substring(ids, s.position_resets * width + 1, (s.ends - s.position_resets) * width)").alias("ids"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))
