"""Token ids of a public byte-level vocabulary, and token counts by section.

Whole documents are encoded once. Every token has a span of characters (the characters that its
bytes belong to), and the spans are joined with the sections of the document by interval overlap.
A token inside one section counts there. For a token that crosses a boundary there are three rules,
each a column of its own:

* ``tokens_start``: it belongs to the section of its first character that lies in a section;
* ``tokens_major``: to the section with most of its characters, the earlier one of a tie;
* ``tokens_share``: to each section in proportion to its characters among those in sections.

Tokens that touch no section are counted in a row with section -1, if there are any. All three
columns sum to the number of tokens of the document.

Defined cases: null and empty texts have one empty section and no tokens when sections are lines,
and no rows where a document has no sections and no tokens; sections are taken in the order of
their start, and where two overlap the earlier keeps the characters; bounds beyond the text are cut
to it; empty sections count 0; null sections are left out; repeated rows are counted each; texts are
encoded whole.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import table
from .streams import small_batches

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the pattern of that vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
END_OF_TEXT = 50_256  # free in that vocabulary
SCHEMA = (
    "doc_id long, section int, name string, start long, `end` long, tokens_start long, tokens_major long, "
    "tokens_share double, crossing long"
)


@lru_cache(maxsize=2)
def _encoding(ranks: bytes):
    import tiktoken

    merges = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, ranks.splitlines())}
    sizes = np.zeros(max(merges.values()) + 1, dtype=np.int64)
    for token, rank in merges.items():
        sizes[rank] = len(token)
    return tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=merges, special_tokens={}), sizes


class Encoder:
    """The vocabulary, sent to tasks as the bytes of its file (about 1 MB) and built once a worker."""

    def __init__(self, ranks: bytes):
        self.ranks = ranks

    @classmethod
    def read(cls, path: str = VOCABULARY) -> "Encoder":
        with open(path, "rb") as file:
            return cls(file.read())

    def ids(self, text: str | None) -> np.ndarray:
        return np.array(_encoding(self.ranks)[0].encode_ordinary(text or ""), dtype=np.int64)

    def spans(self, text: str, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First character and end of each token; tokens that share a character overlap."""
        end = np.cumsum(_encoding(self.ranks)[1][ids])
        start = np.concatenate(([0], end[:-1]))
        if text.isascii() or not len(ids):
            return start, end
        data = np.frombuffer(text.encode(), dtype=np.uint8)
        character = np.cumsum((data & 0xC0) != 0x80)
        return character[start] - 1, character[end - 1]


def lines_of(text: str) -> list[tuple[str | None, int, int]]:
    """Lines with their line ends; the last may be empty."""
    out, start = [], 0
    for line in text.split("\n"):
        end = min(len(text), start + len(line) + 1)
        out.append((None, start, end))
        start = end
    return out


def attribute(start: np.ndarray, end: np.ndarray, sections: list[tuple[str | None, int, int]], length: int) -> list[tuple]:
    """(section, name, start, end, tokens_start, tokens_major, tokens_share, crossing) per section."""
    held, low = [], 0
    for name, a, b in sorted(sections, key=lambda s: s[1]):
        a = min(max(a, low), length)
        b = min(max(b, a), length)
        held.append((name, a, b))
        low = b
    n = len(held)
    a, b = np.array([h[1] for h in held], dtype=np.int64), np.array([h[2] for h in held], dtype=np.int64)
    real = np.flatnonzero(b > a)
    by_start, by_major, share, crossing = np.zeros(n + 1), np.zeros(n + 1), np.zeros(n + 1), np.zeros(n + 1)
    if len(start):
        first = np.searchsorted(b[real], start, side="right")
        last = np.searchsorted(a[real], end, side="left") - 1
        inside = (first == last) & (start >= np.append(a[real], length)[np.minimum(first, len(real))]) & (end <= np.append(b[real], 0)[last])
        place = np.append(real, n)
        counts = np.bincount(place[first[inside]], minlength=n + 1)
        by_start += counts
        by_major += counts
        share += counts
        for i in np.flatnonzero(~inside).tolist():
            f, l = int(first[i]), int(last[i])
            if f > l:
                for column in (by_start, by_major, share):
                    column[n] += 1
                continue
            own = real[f : l + 1]
            common = np.minimum(b[own], end[i]) - np.maximum(a[own], start[i])
            by_start[own[0]] += 1
            by_major[own[np.argmax(common)]] += 1
            share[own] += common / common.sum()
            crossing[own] += 1
    rows = [(i, name, x, y) for i, (name, x, y) in enumerate(held)]
    if by_start[n]:
        rows.append((-1, None, None, None))
    return [
        (*row, int(by_start[j]), int(by_major[j]), float(share[j]), int(crossing[j]))
        for j, row in enumerate(rows)
    ]


def field_sections(*fields: str, separator: str = "\n") -> tuple[Column, Column]:
    """(text, sections) of several string columns put one after the other; null fields are empty."""
    values = [F.coalesce(F.col(f).cast("string"), F.lit("")) for f in fields]
    start, sections = F.lit(0), []
    for name, value in zip(fields, values):
        end = start + F.length(value)
        sections.append(F.struct(F.lit(name).alias("name"), start.cast("long").alias("start"), end.cast("long").alias("end")))
        start = end + len(separator)
    return F.concat_ws(separator, *values), F.array(*sections)


def count_tokens(docs: DataFrame, encoder: Encoder | None = None, sections: str | None = None) -> DataFrame:
    """``SCHEMA`` per document and section.

    ``sections`` names an array<struct<name, start, end>> column of character places (end
    exclusive); without it the sections are lines.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    shared = docs.sparkSession.sparkContext.broadcast((encoder or Encoder.read()).ranks)
    arrow = to_arrow_schema(StructType.fromDDL(SCHEMA))
    own = F.col(f"`{sections}`") if sections else F.lit(None).cast("array<struct<name:string,start:long,end:long>>")
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), own.alias("sections"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Encoder(shared.value)
        for batch in batches:
            out: list[tuple] = []
            for doc_id, text, parts in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "sections"))):
                ids = own.ids(text)
                if sections is None:
                    parts = lines_of(text)
                else:
                    parts = [(p["name"], p["start"], p["end"]) for p in parts or () if p and p["start"] is not None and p["end"] is not None]
                out += [(doc_id, *row) for row in attribute(*own.spans(text, ids), parts, len(text))]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), arrow.types)], schema=arrow)

    small_batches(docs.sparkSession)
    return rows.mapInArrow(run, SCHEMA)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"))
