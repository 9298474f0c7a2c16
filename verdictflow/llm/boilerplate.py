"""Line dedup by site: lines on too large a share of a host's pages are dropped.

For each host the pages that hold a line are counted (once a page) and divided by the host's pages;
lines above ``RATIO`` that are on at least ``MIN_PAGES`` pages are boilerplate. Lines travel as two
64-bit hashes, never as text. All counts are summed before they are shuffled, so a host with a third
of all pages, or a line on all of them, costs no more than its distinct lines. Only boilerplate,
of which a host has at most its lines per page over ``RATIO``, meets the pages again.

Defined cases: null urls and urls without ``://`` form the host ''; null and empty texts have no lines
and give an empty text; blank lines are no lines; a line that is repeated on its page counts once and
is dropped each time; repeated rows are pages of their own; an empty table gives an empty result;
pages of hosts with fewer than ``MIN_PAGES`` pages keep all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import table, written
from .urls import host_of

RATIO = 0.2
MIN_PAGES = 3
_HIDDEN = r"(?is)<script\b.*?</script>|<style\b.*?</style>|<!--.*?-->"
_BLOCK = (
    r"(?i)</?(?:p|div|h[1-6]|li|ul|ol|br|tr|td|th|table|article|nav|footer|header|section|title|body|head|html|main"
    r"|aside|blockquote|pre|form|dl|dt|dd|hr)\b[^>]*>"
)


def visible_text(html: Column) -> Column:
    """Text outside tags; block tags end a line. Character references stay as they are."""
    shown = F.regexp_replace(F.regexp_replace(html, _HIDDEN, ""), _BLOCK, "\n")
    return F.regexp_replace(shown, r"<[^>]*>", "")


def lines_of(text: Column) -> Column:
    """Trimmed lines that are not blank, inner runs of blanks made one."""
    even = F.regexp_replace(F.coalesce(text, F.lit("")), r"[ \t\r\f]+", " ")
    return F.filter(F.transform(F.split(even, "\n"), lambda x: F.trim(x)), lambda x: x != "")


def _key(line: Column) -> Column:
    return F.struct(F.xxhash64(line).alias("a"), F.xxhash64(F.lit(1), line).alias("b"))


def drop_boilerplate(pages: DataFrame, ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """(page_id, host, text) -> page_id, host, n_lines, n_dropped and the text without boilerplate."""
    own = pages.select("page_id", F.coalesce("host", F.lit("")).alias("host"), lines_of(F.col("text")).alias("lines"))
    seen = written(own.select("page_id", "host", F.transform(F.array_distinct("lines"), _key).alias("keys")))
    lines = seen.select("page_id", "host", F.explode("keys").alias("_k")).select("page_id", "host", "_k.a", "_k.b")
    totals = seen.groupBy("host").agg(F.count("*").alias("_pages")).where(F.col("_pages") >= min_pages)
    counts = lines.groupBy("host", "a", "b").agg(F.count("*").alias("_n")).where(F.col("_n") >= min_pages)
    boilerplate = counts.join(totals, "host").where(F.col("_n") > F.lit(ratio) * F.col("_pages")).select("host", "a", "b")
    # Of a page at most its distinct lines are collected.
    gone = (
        lines.join(written(boilerplate), ["host", "a", "b"])
        .groupBy("page_id", "host").agg(F.collect_set(F.struct("a", "b")).alias("_gone"))
    )
    joined = own.alias("p").join(gone.alias("g"), F.col("p.page_id").eqNullSafe(F.col("g.page_id")) & (F.col("p.host") == F.col("g.host")), "left")
    kept = F.when(F.col("_gone").isNull(), F.col("lines")).otherwise(F.filter("lines", lambda x: ~F.array_contains(F.col("_gone"), _key(x))))
    return joined.select("p.page_id", "p.host", "lines", kept.alias("kept")).select(
        "page_id", "host", F.size("lines").cast("long").alias("n_lines"), (F.size("lines") - F.size("kept")).cast("long").alias("n_dropped"),
        F.array_join("kept", "\n").alias("text"),
    )


ORACLE = rf"""
WITH p AS (
  SELECT row_number() OVER () AS r, page_id,
    lower(regexp_extract(coalesce(url, ''), '^(?s:.*?)://([^/?#]*)', 1)) AS host,
    regexp_replace(regexp_replace(regexp_replace(html, '{_HIDDEN}', '', 'g'), '{_BLOCK}', chr(10), 'g'), '<[^>]*>', '', 'g') AS shown
  FROM pages
), l AS (
  SELECT r, page_id, host, list_filter(
    list_transform(string_split(regexp_replace(coalesce(shown, ''), '[ \t\r\f]+', ' ', 'g'), chr(10)), lambda x: trim(x, ' ')),
    lambda x: x <> '') AS lines
  FROM p
), n AS (SELECT host, count(*) AS pages FROM l GROUP BY host),
c AS (SELECT host, line, count(*) AS k FROM (SELECT DISTINCT r, host, unnest(lines) AS line FROM l) GROUP BY ALL),
b AS (SELECT host, list(line) AS bad FROM c JOIN n USING (host) WHERE pages >= {MIN_PAGES} AND k >= {MIN_PAGES} AND k > {RATIO}e0 * pages GROUP BY host),
k AS (SELECT page_id, host, lines, list_filter(lines, lambda x: NOT list_contains(coalesce(bad, []), x)) AS kept FROM l LEFT JOIN b USING (host))
SELECT page_id, host, len(lines) AS n_lines, len(lines) - len(kept) AS n_dropped, array_to_string(kept, chr(10)) AS text FROM k
"""


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return drop_boilerplate(pages.select("page_id", host_of(F.col("url")).alias("host"), visible_text(F.col("html")).alias("text")))
