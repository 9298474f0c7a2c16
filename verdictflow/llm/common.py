"""Small helpers shared by the operators of this folder."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import ArrayType, BinaryType, StringType, StructType

from verdictflow.session import checkpoint_root

from .streams import per_batch

WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame) -> DataFrame:
    """``df`` as a Parquet table in the shared checkpoint folder, read back.

    Used where a result is needed more than once or ends a round of an iteration: the lineage
    ends there, and a lost executor costs nothing that was written.
    """
    path = f"{checkpoint_root(df.sparkSession)}/llm-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ascii_lower(text: Column) -> Column:
    """A-Z lowered, every other letter as it is."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def id_crc(doc_id: Column) -> Column:
    """crc32 of the id as text; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))


def held_out(doc_id: Column) -> Column:
    return id_crc(doc_id) % 5 == 0


BROADCAST_BYTES = 32 << 20


def row_bytes(schema: StructType) -> Column:
    """About what a row takes in a hash table: 8 bytes a number and a header, texts and arrays by their length."""
    size, number = F.lit(24), 8
    for field in schema.fields:
        column, kind = F.col(f"`{field.name}`"), field.dataType
        if isinstance(kind, ArrayType):
            inner = kind.elementType
            width = number * (len(inner.fields) + 2) if isinstance(inner, StructType) else number
            size = size + 16 + F.coalesce(F.size(column), F.lit(0)) * width
        elif isinstance(kind, (StringType, BinaryType)):
            size = size + 16 + F.coalesce(F.octet_length(column), F.lit(0))
        else:
            size = size + number
    return size.cast("long")


def small_side(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """A written table with a broadcast hint if its rows, arrays included, take at most ``limit`` bytes.

    Arrays hold numbers or structs of numbers. Beyond the limit the join shuffles both sides; the
    result is the same.
    """
    return F.broadcast(df) if table_bytes(df) <= limit else df


def table_bytes(df: DataFrame) -> int:
    return df.agg(F.sum(row_bytes(df.schema)).alias("n")).head()["n"] or 0


FILTER_BITS = 1 << 27


def may_hold(bitmap: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which of some 64-bit hashes have both of their bits in a bitmap of 64-bit words."""
    last = np.uint64(len(bitmap) * 64 - 1)
    out = np.ones(len(keys), dtype=bool)
    for bit in (keys & last, (keys >> np.uint64(32)) & last):
        out &= (bitmap[(bit >> np.uint64(6)).astype(np.int64)] >> (bit & np.uint64(63)) & np.uint64(1)).astype(bool)
    return out


def likely_rows(rows: DataFrame, keys: DataFrame, key: str, bits: int = FILTER_BITS) -> DataFrame:
    """All rows whose ``key`` is among ``keys``, and few others: two bits of a bitmap are set for each.

    The bitmap has 16 to 32 bits a key, but at most ``bits`` (a power of two), 16 MB, whatever the number of keys: of
    40 million, about as many as 30 GB of text have, one row in five that is not wanted passes.
    """
    bits = max(64, min(bits, 1 << (16 * keys.count()).bit_length()))
    digest = F.xxhash64(key)
    spots = F.array(*[x.bitwiseAND(F.lit(bits - 1)) for x in (digest, F.shiftrightunsigned(digest, 32))])
    spots = keys.select(F.explode(spots).alias("_bit"))
    words = spots.select(F.shiftright("_bit", 6).alias("word"), F.expr("shiftleft(1L, CAST(_bit & 63 AS int))").alias("bits"))
    found = words.groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    bitmap = np.zeros(bits // 64, dtype=np.int64)
    for batch in found.to_batches():
        bitmap[batch.column("word").to_numpy()] = batch.column("bits").to_numpy()
    shared = rows.sparkSession.sparkContext.broadcast(bitmap.view(np.uint64))
    names = rows.columns

    def pick(batch: pa.RecordBatch) -> dict:
        held = pa.array(may_hold(shared.value, batch.column("_digest").to_numpy().view(np.uint64)))
        return {name: batch.column(name).filter(held) for name in names}

    return per_batch(rows.withColumn("_digest", digest), pick, ", ".join(f"`{name}` {kind}" for name, kind in rows.dtypes))


def held_by(rows: DataFrame, keys: DataFrame, key: str, limit: int = BROADCAST_BYTES) -> DataFrame:
    """``rows`` joined with a written table of keys, most of which most rows do not have.

    Where the table is too large to be broadcast, a bitmap of it keeps most other rows from being shuffled.
    """
    if table_bytes(keys) <= limit:
        return rows.join(F.broadcast(keys), key)
    return likely_rows(rows, keys, key).join(keys, key)
