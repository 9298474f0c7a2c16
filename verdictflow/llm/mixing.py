"""Mixing sources to target weights by systematic sampling.

Every document has an expected number of copies, its source's target over its source's size.
Within a source the expected copies are summed up in the order (size, digest of the id, id), one
random offset per source is added, and a document is taken once for every whole number its
interval crosses. Going by size keeps the words taken near the target, whatever the draw.

No source is ever sorted or summed in one task: a document's place is the number of smaller
documents of its source (from a histogram of sizes), plus the documents of its size in earlier
digest buckets, plus its place in its own bucket. Sources and sizes meet as counts only.

Defined cases: a null text has size 0; documents of size 0 take places like any other and add no
words; a source of size 0 has target 0 and is not taken; a null source is a source of its own,
last in order; repeated rows are separate documents; an empty table gives an empty mix. Other
columns, whatever their names, are passed through by ``mix``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .common import WORD, word_count, written

WEIGHTS = (5, 2, 1)
SHARE = 1.5
CAP = 2.0
SEED = "mix-1"
UNIT = 1 << 24  # copies are counted in fractions of this, so sums are exact in any order


def _source_key(source: Column) -> Column:
    return F.when(source.isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), source.cast("string")))


def targets(sizes: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """(_src, source_size) with one row a source -> also target and _copies (in units).

    Targets are ``level * weight``, stopped at ``cap`` times the size. The level that uses up the
    share is the greatest of those found by stopping the first k sources in the order of cap over
    weight, so no iteration is needed. The windows run over one row per source.
    """
    everything = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    before = W.orderBy("_ratio", "_src").rowsBetween(W.unboundedPreceding, -1)
    place = (F.row_number().over(W.orderBy("_src")) - 1) % len(weights)
    return (
        sizes.withColumn("_weight", F.element_at(F.array(*map(F.lit, map(float, weights))), place + 1))
        .withColumn("_top", F.lit(cap) * F.col("source_size"))
        .withColumn("_ratio", F.col("_top") / F.col("_weight"))
        .withColumn("_left", F.lit(share) * F.sum("source_size").over(everything) - F.coalesce(F.sum("_top").over(before), F.lit(0.0)))
        .withColumn("_open", F.sum("_weight").over(everything) - F.coalesce(F.sum("_weight").over(before), F.lit(0.0)))
        .withColumn("_level", F.max(F.col("_left") / F.col("_open")).over(everything))
        .withColumn("target", F.least("_top", F.col("_level") * F.col("_weight")))
        .withColumn("_copies", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size") * UNIT)).otherwise(0).cast("long"))
        .select("_src", "source_size", "target", "_copies")
    )


def place(docs: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, cap: float = CAP, seed: str = SEED) -> DataFrame:
    """Rows with doc_id, _src and size -> also source_size, target and copies.

    ``docs`` is read twice: once for counts, once for the rows themselves, which are shuffled
    once by (source, size, digest bucket).
    """
    digest = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    rows = docs.withColumn("_digest", digest).withColumn("_bucket", F.substring("_digest", 1, 3))
    cells = written(rows.groupBy("_src", "size", "_bucket").agg(F.count("*").alias("_n")))
    by_size = cells.groupBy("_src", "size").agg(F.sum("_n").alias("_n"))
    smaller = F.coalesce(F.sum("_n").over(W.partitionBy("_src").orderBy("size").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    earlier = F.coalesce(F.sum("_n").over(W.partitionBy("_src", "size").orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    sources = targets(by_size.groupBy("_src").agg(F.sum(F.col("size") * F.col("_n")).cast("long").alias("source_size")), weights, share, cap)
    offsets = (
        cells.select("_src", "size", "_bucket", earlier.alias("_earlier"))
        .join(by_size.select("_src", "size", smaller.alias("_smaller")), ["_src", "size"])
        .join(sources, "_src")
        .select("_src", "size", "_bucket", "source_size", "target", "_copies", (F.col("_earlier") + F.col("_smaller")).alias("_before"))
    )
    draw = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}|"), "_src").cast("binary")), 1, 6), 16, 10).cast("long")
    end = draw + F.col("_place") * F.col("_copies")
    in_bucket = F.row_number().over(W.partitionBy("_src", "size", "_bucket").orderBy("_digest", "doc_id"))
    return (
        rows.withColumn("_in", in_bucket)
        .join(offsets, ["_src", "size", "_bucket"])
        .withColumn("_place", F.col("_before") + F.col("_in"))
        .withColumn("copies", F.floor(end / UNIT) - F.floor((end - F.col("_copies")) / UNIT))
        .drop("_digest", "_bucket", "_in", "_before", "_place", "_copies")
    )


def mix_table(docs: DataFrame, **options) -> DataFrame:
    """One row a document: doc_id, source, size, source_size, target, copies, taken (words)."""
    sizes = written(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), _source_key(F.col("source")).alias("_src")))
    return place(sizes, **options).select(
        "doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken")
    )


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mixed documents themselves: all columns of ``docs``, each row as often as it is taken."""
    packed = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), "doc_id",
        word_count(F.col("text")).alias("size"), _source_key(F.col("source")).alias("_src"),
    )
    taken = place(packed, **options).where("copies > 0")
    return taken.select("_row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("_row.*")


ORACLE = f"""
WITH d AS (
  SELECT doc_id, coalesce(len(regexp_extract_all(text, '{WORD}')), 0)::BIGINT AS size,
         CASE WHEN source IS NULL THEN '1' ELSE '0' || source END AS src, md5(coalesce(doc_id::VARCHAR, '')) AS h
  FROM documents
), s AS (
  SELECT src, sum(size)::BIGINT AS source_size,
         CASE (row_number() OVER (ORDER BY src) - 1) % 3 WHEN 0 THEN 5e0 WHEN 1 THEN 2e0 ELSE 1e0 END AS weight
  FROM d GROUP BY src
), l AS (
  SELECT *, 2e0 * source_size AS top,
    1.5e0 * sum(source_size) OVER () - coalesce(sum(2e0 * source_size) OVER w, 0e0) AS rest,
    sum(weight) OVER () - coalesce(sum(weight) OVER w, 0e0) AS open
  FROM s WINDOW w AS (ORDER BY 2e0 * source_size / weight, src ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), t AS (
  SELECT src, source_size, least(top, max(rest / open) OVER () * weight) AS target FROM l
), p AS (
  SELECT d.*, t.source_size, t.target,
    CASE WHEN t.source_size > 0 THEN floor(t.target / t.source_size * {UNIT})::BIGINT ELSE 0 END AS e,
    ('0x' || substr(md5('{SEED}|' || d.src), 1, 6))::BIGINT AS u,
    row_number() OVER (PARTITION BY d.src ORDER BY size, h, doc_id) AS k
  FROM d JOIN t USING (src)
)
SELECT doc_id, size, source_size, target,
  ((u + k * e) // {UNIT} - (u + (k - 1) * e) // {UNIT}) AS copies,
  ((u + k * e) // {UNIT} - (u + (k - 1) * e) // {UNIT}) * size AS taken
FROM p
"""


def query(spark, sf_dir: str) -> DataFrame:
    from .common import table

    return mix_table(table(spark, sf_dir, "documents")).drop("source")
