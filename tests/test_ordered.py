"""Ranks, followers and cut-offs of groups that hold most rows."""

import random

import pytest
from pyspark.sql import functions as F

from verdictflow.operators import ordered
from verdictflow.operators.ordered import numbered


def largest_share(held):
    counts = [r["count"] for r in held.groupBy("_part").count().collect()]
    return max(counts) / sum(counts)


def test_numbered_spreads_one_group(spark):
    draw = random.Random(4)
    rows = [("hot" if draw.random() < 0.8 else draw.choice(["a", "b", None]), draw.randrange(500), i) for i in range(20_000)]
    frame = spark.createDataFrame(rows, "g string, x long, id long").repartition(7)
    order = [F.col("x").desc(), F.col("id").asc()]
    got = numbered(frame, ["g"], order, "n").collect()
    want = {}
    for g, x, i in sorted(rows, key=lambda r: (-r[1], r[2])):
        want.setdefault(g, []).append(i)
    assert len(got) == len(rows) and all(want[r.g][r.n - 1] == r.id for r in got)
    whole = numbered(frame, [], [F.col("id").asc()], "n").collect()
    assert all(r.n == r.id + 1 for r in whole)
    assert numbered(frame.where("false"), ["g"], [F.col("x").asc()], "n").count() == 0
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert largest_share(ordered._dealt(frame, ["g"], order)) < 0.4  # 4 partitions
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_following_matches_a_plain_window(spark):
    rng = random.Random(5)
    rows = [("hot" if n % 4 else None, rng.randrange(3), n) for n in range(2_000)]
    table = spark.createDataFrame(rows, "k string, t int, id int").repartition(5)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        led = ordered.following(table, ["k"], [F.col("t"), F.col("id")], F.col("id"), "next").collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    table.createOrReplaceTempView("plain_rows")
    plain = spark.sql("SELECT id, lead(id) OVER (PARTITION BY k ORDER BY t, id) nx FROM plain_rows").collect()
    assert {r["id"]: r["next"] for r in led} == {r["id"]: r["nx"] for r in plain}


@pytest.mark.parametrize("hot", [0, 1, 37, 450, 100_000, None])
def test_budget_of_one_hot_run(spark, hot):
    rng = random.Random(hot)
    rows = [("hot" if n % 3 else f"r{n % 9}", rng.randrange(5), f"p{n:05d}") for n in range(1_350)]
    budget = {"hot": hot, "r0": 5, "r3": 0, "r6": None}
    table = spark.createDataFrame(rows, "run string, rank int, pair_id string").repartition(6)
    budgets = spark.createDataFrame(list(budget.items()), "run string, budget long")
    order = ["rank", "pair_id"]
    limits = ordered.budget_limits(table, budgets, "run", order)
    got = table.join(budgets, "run").join(limits, "run", "left").withColumn("called", ordered.within_budget("budget", order)).collect()
    wanted = set()
    for run, cap in budget.items():
        mine = sorted((r[1], r[2]) for r in rows if r[0] == run)
        wanted |= {p for _, p in (mine if cap is None else mine[:cap])}
    assert len(got) == len(rows) and {r["pair_id"] for r in got if r["called"]} == wanted
