"""URL filters: rules first, then host word segmentation and naive Bayes.

1. Rules name a host and the beginning of a path; a rule fits its host and all subdomains, the
   longest fitting rule decides.
2. Hosts and paths are split into letter runs (*names*). A unigram Viterbi splits a name into the
   most probable words. Word counts come from the text of all pages, plus a seed list that gives
   words of advertising, gambling, adult and drug sites a count of their own. Only those
   substrings of names that are words at all meet their counts, by a join: the vocabulary, which
   grows with the corpus, is never sent to a task as a whole.
3. Multinomial naive Bayes over the segmented words judges a url. It learns from all urls: those
   with a seed word among their words are taken for examples to block, the others to allow.
   Class counts are per word; again only the words a name has meet them. The prior is fixed and
   equal, so the share of bad urls in a crawl doesn't move the verdicts.

Defined cases: a null url or one without ``://`` has an empty host and path, no words and so the
verdict allow; letters other than a-z count as separators of names; names of any length are split
as a whole, at a cost linear in their length; repeated rows are judged alike; an empty table gives an empty result.
"""

from __future__ import annotations

from math import log

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import ascii_lower, table, written
from .streams import per_group

RULES = (
    ("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"), ("net", "/fr/", "block"),
)
# Words of sites that are not wanted.
SEEDS = (
    "adult", "sex", "sexy", "porn", "xxx", "nude", "escort", "dating", "casino", "poker", "bet", "bets", "betting",
    "gambling", "jackpot", "slots", "lottery", "pills", "viagra", "cialis", "pharmacy", "drugs", "weed", "spam",
    "scam", "fraud", "phishing", "warez", "torrent", "crack", "keygen", "malware", "ads", "adserver", "banner",
    "popup", "tracker", "clickbait",
)
# Words that only help to segment names of such sites.
HELPERS = ("free", "cheap", "win", "farm", "track", "online", "best", "live", "hot", "click", "buy", "shop", "site", "page", "blog", "example", "www")
SEED_COUNT = 1_000
LONGEST_WORD = 20
LONGEST_NAME = 60
UNKNOWN = 12.0  # extra cost (nats) of a word that is in no text, beside that of its length
SMOOTHING = 20.0


def host_of(url: Column) -> Column:
    return F.coalesce(ascii_lower(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule as text, its verdict), null where none fits; of equally long rules the first."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for name, begin, says in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == name) | F.endswith(host, F.lit("." + name))) & F.startswith(path, F.lit(begin))
        text, verdict = F.when(fits, F.lit(name + begin)).otherwise(text), F.when(fits, F.lit(says)).otherwise(verdict)
    return text, verdict


def names_of(host: Column, path: Column) -> Column:
    """Letter runs of host and path."""
    return F.regexp_extract_all(F.concat_ws(" ", host, ascii_lower(path)), F.lit("[a-z]+"), 0)


def vocabulary(pages: DataFrame) -> DataFrame:
    """(word, count): words of a-z in the visible text of all pages, with the seed list."""
    visible = F.regexp_replace(F.col("html"), r"(?is)<(script|style)\b.*?</\1>|<!--.*?-->|<[^>]*>", " ")
    words = pages.select(F.explode(F.regexp_extract_all(ascii_lower(visible), F.lit(rf"(?<!\p{{L}})[a-z]{{1,{LONGEST_WORD}}}(?!\p{{L}})"), 0)).alias("word"))
    listed = pages.sparkSession.createDataFrame([(w,) for w in (*SEEDS, *HELPERS)], "word string")
    counted = words.groupBy("word").agg(F.count("*").alias("count"))
    seeds = listed.withColumn("count", F.lit(SEED_COUNT).cast("long"))
    return counted.unionByName(seeds).groupBy("word").agg(F.sum("count").alias("count"))


def viterbi(name: str, counts: dict[str, int], total: int) -> list[str]:
    """The cheapest split of a name; of equally cheap splits the one whose last words are longer."""
    best, back = [0.0] + [float("inf")] * len(name), [0] * (len(name) + 1)
    for end in range(1, len(name) + 1):
        for begin in range(max(0, end - LONGEST_WORD), end):
            n = counts.get(name[begin:end])
            cost = best[begin] + (log(total / n) if n else UNKNOWN + 3.0 * (end - begin) + log(total))
            if cost < best[end] - 1e-12:
                best[end], back[end] = cost, begin
    words, end = [], len(name)
    while end:
        words.append(name[back[end]:end])
        end = back[end]
    return words[::-1]


def segment(names: DataFrame, vocab: DataFrame) -> DataFrame:
    """(name) -> (name, words). Single letters are words only where nothing longer fits."""
    total = int(vocab.agg(F.sum("count")).first()[0] or 1)
    # Long names travel as digests and are looked through in parts that overlap by a word.
    names = names.withColumn("_id", F.when(F.length("name") <= LONGEST_NAME, F.col("name")).otherwise(F.sha2("name", 256)))
    step = LONGEST_NAME - LONGEST_WORD
    parts = F.expr(f"transform(sequence(1, length(name), {step}), c -> substring(name, c, {LONGEST_NAME - 1}))")
    pieces = names.select("_id", F.explode(parts).alias("_part")).select(
        "_id", "_part", F.explode(F.expr(f"sequence(1, least({step}, length(_part)))")).alias("_a")
    ).select(
        "_id", "_part", "_a", F.explode(F.expr(f"sequence(1, least({LONGEST_WORD}, length(_part) - _a + 1))")).alias("_n")
    ).select("_id", F.expr("substring(_part, _a, _n)").alias("word")).where("length(word) > 1").distinct()
    known = pieces.join(vocab.where("length(word) > 1"), "word", "left")
    # At most LONGEST_WORD pieces a letter.
    held = known.groupBy("_id").agg(F.collect_list(F.when(F.col("count").isNotNull(), F.struct("word", "count"))).alias("found"))
    all_names = names.join(held, "_id", "left").select("name", F.xxhash64("name").alias("_k"), "found")

    def split(group: pa.Table) -> dict:
        out: dict[str, list] = {"name": [], "words": []}
        for row in group.to_pylist():
            out["name"].append(row["name"])
            out["words"].append(viterbi(row["name"], {f["word"]: f["count"] for f in row["found"] or ()}, total))
        return out

    return per_group(all_names, "_k", ["name"], split, "name string, words array<string>")


def judge(pages: DataFrame, rules=RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, words and block_odds of every page."""
    urls = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    urls = urls.withColumn("names", names_of(F.col("host"), F.col("path")))
    vocab = written(vocabulary(pages))
    names = urls.select(F.explode("names").alias("name")).groupBy("name").agg(F.count("*").alias("n"))
    split = written(segment(names.select("name"), vocab))
    # One row per distinct (host, path letters): its number of urls and its words.
    sites = urls.where("size(names) > 0").groupBy("names").agg(F.count("*").alias("n"))
    placed = sites.select("names", "n", F.posexplode("names").alias("_p", "name")).join(split, "name")
    kinds = written(
        placed.groupBy("names", "n").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("_p", "words"))), lambda x: x["words"])).alias("words"))
        .withColumn("bad", F.exists("words", lambda w: w.isin(*SEEDS)))
    )
    tokens = kinds.select("n", "bad", F.explode("words").alias("word"))
    counts = written(
        tokens.groupBy("word").agg(
            F.sum(F.when(F.col("bad"), F.col("n")).otherwise(0)).alias("in_bad"), F.sum(F.when(F.col("bad"), 0).otherwise(F.col("n"))).alias("in_good")
        )
    )
    sums = counts.agg(F.sum("in_bad").alias("bad"), F.sum("in_good").alias("good"), F.count("*").alias("words")).first()
    bad, good = sums.bad or 0, sums.good or 0
    # Each class borrows SMOOTHING words dealt out as in both classes together: a rare word then
    # says little, whichever class is the smaller.
    share = SMOOTHING * (F.col("in_bad") + F.col("in_good")) / F.lit(float(max(1, bad + good)))
    weight = F.log((F.col("in_bad") + share) / F.lit(bad + SMOOTHING)) - F.log((F.col("in_good") + share) / F.lit(good + SMOOTHING))
    odds = (
        kinds.select("names", F.explode("words").alias("word")).join(counts.select("word", weight.alias("w")), "word")
        .groupBy("names").agg(F.round(F.sum("w"), 6).alias("block_odds"))
    )
    judged = urls.join(kinds.select("names", "words").join(odds, "names"), "names", "left")
    rule, says = rule_of(F.col("host"), F.col("path"), rules)
    return judged.select(
        "page_id", "host", "path", rule.alias("rule"),
        F.coalesce(says, F.when(F.col("block_odds") > 0, F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"),
        "words", "block_odds",
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"))
