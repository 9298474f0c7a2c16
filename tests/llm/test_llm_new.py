"""Isolation forest, bit-sliced resampling and centroid clustering against plain versions."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from verdictflow.llm import anomalies, clusters, resampling
from verdictflow.llm.common import written

SMALL = "/root/testdata/sf0.001"
SPACED = re.compile(r"[^\x20\x09-\x0D]+")
LETTERS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}
ODD_TEXTS = [
    None, "", " \t\n ", "one", "z" * 300_000, "ü" * 70 + " é", "a b c d e " * 4_000, "same line\nsame line\n\n \nsame line", "x y #*$ A|B\r\nx y",
    "Tausend Wörter\n" * 3_000, "a b c d e f a b c d e g", "1 2 3 4 5 6 7 8 9 10 11",
]


def odd_documents(spark):
    rows = [(i, t, "src") for i, t in enumerate(ODD_TEXTS)] + [(None, "no id at all " * 9, None), (None, None, None), (3, "one", "src"), (3, "two", "src")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    return docs.withColumns({c: F.lit(c) for c in "score weight rank n_words kept path base_failed v apex cluster bucket n _at _part low_marks".split()})


def plain_counts(text):
    words = SPACED.findall(text or "")
    lines = [x for x in (text or "").split("\n") if SPACED.search(x)]
    places = {}
    for i in range(len(words) - 4):
        places.setdefault(tuple(words[i : i + 5]), []).append(i)
    covered = {i + j for own in places.values() if len(own) > 1 for i in own for j in range(5)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)


def test_statistics_against_plain_counts(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    for frame in (docs, odd_documents(spark)):
        rows = frame.select("doc_id", "text").withColumn("key", F.coalesce(F.col("text"), F.lit("-")))
        texts = {r.key: r.text for r in rows.collect()}
        got = anomalies.statistics(frame).collect()
        assert len(got) == rows.count()
        want = sorted((repr(r.doc_id), *plain_counts(r.text)) for r in rows.collect())
        assert sorted((repr(r.doc_id), *[r[c] for c in anomalies.COUNTS[:5]]) for r in got) == want and texts


def plain_path(tree, row):
    """The path of one row, step by step."""
    column, place, child, path = tree
    node, steps = 0, 0
    while column[node] >= 0:
        node = child[node] + (row[column[node]] >= place[node])
        steps += 1
    return path[node], steps


def test_forest_against_plain_walk(spark):
    stats = written(anomalies.statistics(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")))
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    forest, limit = anomalies.fit(stats, labels)
    rows = stats.select("doc_id", "n_words", "n_repeat_words", *anomalies.ratios()).collect()
    want = {}
    for r in rows:
        paths = [plain_path(tree, [r[x] for x in anomalies.RATIOS]) for tree in forest.trees]
        assert all(steps <= path <= anomalies.DEPTH + 12 for path, steps in paths)
        mean = round(math.fsum(p for p, _ in paths) / len(paths), 9)
        failed = r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words
        want[r.doc_id] = (mean, failed, not failed and mean >= limit)
    got = {r.doc_id: r for r in anomalies.judge(stats, (forest, limit)).collect()}
    for doc_id, (mean, failed, kept) in want.items():
        assert abs(got[doc_id].path - mean) < 1e-6 and got[doc_id].base_failed == failed
        assert got[doc_id].kept == kept or abs(mean - limit) < 1e-6
    # Each leaf's rows add up to the subsample, and deeper cells lie inside their parents.
    for column, _, child, path in forest.trees:
        assert len(path) < 2 * 2 ** anomalies.DEPTH and (child[column >= 0] > 0).all()


def test_forest_finds_anomalies_in_held_out_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    out = anomalies.judged(docs, labels).join(labels, "doc_id").where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0)
    found = {(r.quality, r.kept): r["count"] for r in out.where("NOT base_failed").groupBy("quality", "kept").count().collect()}
    assert found[1, True] >= 0.99 * (found[1, True] + found.get((1, False), 0))
    assert found[0, False] >= 0.9 * (found[0, False] + found.get((0, True), 0))


def test_threshold():
    good, bad = np.array([5.0, 6.0, 7.0]), np.array([1.0, 2.0, 6.5])
    assert anomalies.threshold(good, bad) == 3.5
    assert anomalies.threshold(good, np.array([])) == 5.0
    assert anomalies.threshold(good, np.array([9.0])) == 5.0  # nothing is caught without a loss
    path = anomalies.mean_path(np.array([0, 1, 2, 256]))
    assert path[0] == path[1] == 0 and abs(path[2] - (2 * np.euler_gamma - 1)) < 1e-12 and abs(path[3] - 10.244) < 1e-2


def test_anomalies_of_odd_rows(spark):
    docs = odd_documents(spark)
    labels = spark.createDataFrame([(9, 1), (9, 0), (None, 1), (8, None), (3, 0)], "doc_id long, quality int")
    rows = anomalies.judged(docs, labels).collect()
    assert len(rows) == docs.count() and {r.path for r in rows} == {None}  # nobody is called good
    assert all(r.kept != r.base_failed for r in rows)
    learn = next(i for i in range(6, 12) if zlib.crc32(str(i).encode()) % 5)
    rows = anomalies.judged(docs, spark.createDataFrame([(learn, 1)], "doc_id long, quality int")).collect()
    assert len(rows) == docs.count() and all(r.kept is not None for r in rows)
    empty = docs.where("false")
    assert anomalies.judged(empty, labels).count() == 0 and anomalies.judged(docs, labels.where("false")).count() == docs.count()


def plain_features(text, longest):
    words = LETTERS.findall((text or "").translate(LOWER))
    runs = [" ".join(words[i : i + n]) for n in range(1, longest + 1) for i in range(len(words) - n + 1)]
    return words, [zlib.crc32(x.encode()) for x in runs]


def plain_resample(docs, target, longest, buckets, share, least, seed):
    source, wanted = [0] * buckets, [0] * buckets
    for out, texts in ((source, [t for _, t in docs]), (wanted, target)):
        for text in texts:
            for c in plain_features(text, longest)[1]:
                out[c % buckets] += 1
    gain = [
        math.floor(1000 * math.log((t + 1) * (sum(source) + buckets) / ((s + 1) * (sum(wanted) + buckets)))) for s, t in zip(source, wanted)
    ]
    rows = []
    for doc_id, text in docs:
        words, prints = plain_features(text, longest)
        weight = sum(gain[c % buckets] for c in prints) // len(prints) if prints else 0
        h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        rows.append((doc_id, len(prints), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), len(words)))
    able = sorted((r for r in rows if r[4] >= least), key=lambda r: (-r[3], r[0] is not None, r[0] or 0, r[2], r[1]))
    drawn = able[: share * len(able) // 100]
    left = list(rows)
    for r in drawn:
        left.remove(r)
    return sorted([repr((*r[:4], i + 1)) for i, r in enumerate(drawn)] + [repr((*r[:4], None)) for r in left])


@pytest.mark.parametrize("longest,buckets,share,least", [(1, 10_000, 10, 20), (3, 97, 50, 0), (2, 64, 100, 5), (1, 1, 33, 1)])
def test_resample_against_plain_version(spark, longest, buckets, share, least):
    docs = odd_documents(spark).select("doc_id", "text").unionByName(spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text"))
    target = spark.createDataFrame([("ü é one two",), (None,), ("a b c " * 50,)], "text string")
    got = resampling.resample(docs, target, longest=longest, buckets=buckets, share=share, least=least).select("doc_id", "n_features", "weight", "score", "rank")
    rows = [tuple(r) for r in docs.collect()]
    want = plain_resample(rows, [r.text for r in target.collect()], longest, buckets, share, least, resampling.SEED)
    assert sorted(repr(tuple(r)) for r in got.collect()) == want


def test_plane_sums_are_exact():
    draw = np.random.default_rng(5)
    for buckets in (1, 63, 64, 65, 1000):
        gain = draw.integers(-40_000, 40_000, buckets)
        for special in (gain, np.zeros(buckets, dtype=np.int64), np.full(buckets, -1), np.full(buckets, -32_768), np.full(buckets, 32_768)):
            owner, bucket = np.sort(draw.integers(0, 7, 5_000)), draw.integers(0, buckets, 5_000)
            planes, values = resampling.gain_planes(special)
            want = np.zeros(9, dtype=np.int64)
            np.add.at(want, owner, special[bucket])
            assert (resampling.plane_sums(owner, bucket, 9, planes, values, buckets) == want).all()


def test_resample_without_rows(spark):
    docs = odd_documents(spark)
    none = docs.where("false")
    assert resampling.resample(none, docs).count() == 0
    rows = resampling.resample(docs, none.select("text"), least=1_000_000).collect()
    assert len(rows) == docs.count() and {r["rank"] for r in rows} == {None}
    same = spark.createDataFrame([(4, "w " * 30)] * 2_000, "doc_id long, text string")
    ranks = sorted(r["rank"] for r in resampling.resample(same, none).where("rank IS NOT NULL").collect())
    assert ranks == list(range(1, 201))


def plain_clusters(vectors, k, rounds, seed, scale=64):
    own = [(i, tuple(math.floor(scale * x) for x in v)) for i, v in vectors]
    own.sort(key=lambda r: (hashlib.sha256(f"{seed}:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[0] is not None, r[0] or 0, r[1]))
    centroids = [list(v) for _, v in own[:k]]

    def best(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(centroids))

    for _ in range(rounds):
        members = {}
        for _, v in own:
            members.setdefault(best(v)[1], []).append(v)
        for n, rows in members.items():
            centroids[n] = [sum(x) // len(rows) for x in zip(*rows)]
    placed = [(i, *best(v)) for i, v in own]
    total = {n: sum(d for _, d, m in placed if m == n) for _, _, n in placed}
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted(repr((i, n, d, total[n], sum(total.values()), digest[n])) for i, d, n in placed)


@pytest.mark.parametrize("kind", ["spread", "ties", "copies", "line"])
@pytest.mark.parametrize("pivots", [1, 3, 16])
def test_clusters_against_plain_version(spark, kind, pivots):
    draw = random.Random(kind)
    make = {
        "spread": lambda i: [draw.uniform(-40, 40) for _ in range(6)],
        "ties": lambda i: [draw.choice((-1.0, 0.0, 1.0)) / 64 for _ in range(6)],
        "copies": lambda i: [float(i % 3)] * 6,
        "line": lambda i: [i * 1.0, 0.0, 0.0, 0.0, 0.0, 1e5],
    }[kind]
    rows = [(i if i % 50 else None, make(i)) for i in range(400)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5)
    got = clusters.report(frame, k=9, rounds=2, seed="s", dim=6, pivots=pivots)
    names = ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert sorted(repr(tuple(r)) for r in got.select(*names).collect()) == plain_clusters(rows, 9, 2, "s")


def test_bounds_hold_and_rule_centroids_out():
    draw = np.random.default_rng(3)
    # Vectors near a plane of three dimensions, as embeddings mostly are.
    flat = draw.normal(size=(3_000, 3)) @ draw.normal(size=(3, 64)) * 60 + draw.normal(size=(3_000, 64))
    v = np.floor(flat).astype(np.int64)
    simplex = clusters.Simplex(v[:16], 6)
    a, places = simplex.apexes(v), simplex.apexes(v[:16])
    exact = np.sqrt(clusters.squared(v, v[:16]))
    low, high = clusters.bounds(a, places)
    assert (low <= exact + 1e-5 * exact.max()).all() and (exact <= high + 1e-5 * exact.max()).all()
    best, distance, compared = clusters.nearest(v, a, v[:16], places)
    assert (best == exact.argmin(axis=1)).all() and (distance == clusters.squared(v, v[:16]).min(axis=1)).all()
    assert compared.mean() < 4


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    good = [0.5] * 64
    rows = [(1, good), (1, good), (2, None), (3, []), (4, [1.0] * 63), (5, [nan] + good[1:]), (6, good[1:] + [inf]), (7, good[1:] + [None]), (None, [-0.01] * 64)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({c: F.lit(c) for c in ("v", "apex", "cluster", "distance", "_x")})
    got = clusters.report(frame).collect()
    assert sorted(repr(r.vec_id) for r in got) == ["1", "1", "None"] and {r.distance for r in got} == {0}
    assert clusters.kept(frame).where("vec_id IS NULL").first().v == [-1] * 64
    assert clusters.report(frame.where("false")).count() == 0 and clusters.report(frame.where("vec_id = 2")).count() == 0
    with pytest.raises(Exception, match="too large"):
        clusters.kept(spark.createDataFrame([(1, [1e30] * 64)], "vec_id long, embedding array<float>")).collect()
