"""Centroid clustering of integer vectors, with centroids ruled out by N-simplex projection.

Lloyd's rounds over exact integers. What is told apart by arithmetic alone:

1. Some of the starting centroids become *pivots*. Their distances to each other span a simplex;
   the distances of a vector to the pivots place it above that simplex as an *apex*: one
   coordinate for each pivot, the last one its altitude.
2. Between two apexes the Euclidean distance is a lower bound of the true distance, and the one
   with the second altitude turned round an upper bound. Apexes of the vectors are worked out once
   and written beside them; those of the centroids are worked out for every round.
3. A centroid whose lower bound lies above the smallest upper bound cannot be nearest. The others
   are compared by exact squared integer distances, ties going to the smaller number. Bounds are
   widened by ``SLACK`` of the lengths involved, far above the error of doubles, so the result is
   that of comparing all of them.

Every round reads the written table once and sends only sums per centroid to the driver: at most
``k * dim`` numbers, whatever the table's size. No vector is ever shuffled.

Defined cases: vectors that are null, of another length, or that hold a null, NaN or infinity are
not kept; repeated ids and vectors are clustered row by row; with fewer kept vectors than ``k``
there are as many centroids; a null id counts as the empty text in the hash; empty tables give an
empty result; extra columns are not read. Components beyond 2**27 after scaling are an error, as
their squared distances would not fit a long.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import table, written
from .streams import per_batch, small_batches

SCALE = 64
DIM = 64
CENTROIDS = 16
ROUNDS = 3
SEED = "1"
PIVOTS = 16
FLAT = 0.05  # a pivot lower than this share of the simplex's size would make it ill-conditioned
SLACK = 1e-5
LIMIT = 1 << 27


def kept(vectors: DataFrame, dim: int = DIM, scale: int = SCALE) -> DataFrame:
    """vec_id and v, the vector as integers, of the vectors that can be clustered."""
    wide = F.transform("embedding", lambda x: x.cast("double"))
    bad = F.exists("_x", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    whole = F.transform("_x", lambda x: F.floor(x * scale))
    checked = F.when(F.exists("v", lambda x: F.abs(x) > LIMIT), F.raise_error(F.lit("a component is too large to be squared exactly"))).otherwise(F.col("v"))
    return (
        vectors.where(F.size("embedding") == dim).select("vec_id", wide.alias("_x")).where(~bad)
        .select("vec_id", whole.alias("v")).select("vec_id", checked.alias("v"))
    )


def ticket(vec_id: Column, seed: str = SEED) -> Column:
    return F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(vec_id.cast("string"), F.lit(""))), 256)


def first_centroids(vectors: DataFrame, k: int = CENTROIDS, seed: str = SEED) -> np.ndarray:
    """The ``k`` vectors with the smallest digests, in that order; only they reach the driver."""
    rows = vectors.orderBy(ticket(F.col("vec_id"), seed), "vec_id", "v").limit(k).select("v").collect()
    return np.array([r.v for r in rows], dtype=np.int64)


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact squared distances of each row of ``a`` to each row of ``b``."""
    out = np.empty((len(a), len(b)), dtype=np.int64)
    for j, row in enumerate(b):
        apart = a - row
        out[:, j] = np.einsum("ij,ij->i", apart, apart)
    return out


class Simplex:
    """Pivots and the triangular system that turns distances to them into an apex."""

    def __init__(self, candidates: np.ndarray, pivots: int = PIVOTS):
        """Takes the candidate that stands highest above the pivots so far, until none does."""
        between = squared(candidates, candidates).astype(float)
        size = float(np.sqrt(between.max()))
        chosen, base = [0], np.zeros((0, 0))
        while len(chosen) < min(pivots, len(candidates)):
            apexes = self._apexes(between[:, chosen], base)
            best = int(np.argmax(apexes[:, -1]))
            if not size or apexes[best, -1] <= FLAT * size:
                break
            n = len(chosen)
            grown = np.zeros((n, n))
            grown[: n - 1, : n - 1] = base
            grown[n - 1] = apexes[best]
            base = grown
            chosen.append(best)
        self.points, self.base = candidates[chosen], base

    @staticmethod
    def _apexes(distances: np.ndarray, base: np.ndarray) -> np.ndarray:
        """Squared distances to the pivots -> coordinates over the simplex and the altitude."""
        own = distances[:, :1]
        if len(base):
            sides = (own - distances[:, 1:] + (base * base).sum(axis=1)) / 2
            flat = np.linalg.solve(base, sides.T).T
        else:
            flat = np.zeros((len(distances), 0))
        high = np.sqrt(np.maximum(0.0, own[:, 0] - (flat * flat).sum(axis=1)))
        return np.column_stack((flat, high))

    def apexes(self, vectors: np.ndarray) -> np.ndarray:
        return self._apexes(squared(vectors, self.points).astype(float), self.base)


def bounds(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of the distances between objects with apexes ``a`` and ``b``."""
    flat = ((a[:, None, :-1] - b[None, :, :-1]) ** 2).sum(axis=2)
    high, other = a[:, None, -1], b[None, :, -1]
    return np.sqrt(flat + (high - other) ** 2), np.sqrt(flat + (high + other) ** 2)


def nearest(vectors: np.ndarray, apexes: np.ndarray, centroids: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(nearest centroid, squared distance, centroids compared exactly) of each vector."""
    low, high = bounds(apexes, places)
    reach = np.sqrt((apexes * apexes).sum(axis=1)) + np.sqrt((places * places).sum(axis=1)).max() + 1
    open_ = low <= high.min(axis=1)[:, None] + SLACK * reach[:, None]
    rows, columns = np.nonzero(open_)
    apart = vectors[rows] - centroids[columns]
    exact = np.full(open_.shape, np.iinfo(np.int64).max)
    exact[rows, columns] = np.einsum("ij,ij->i", apart, apart)
    best = exact.argmin(axis=1)  # the first of equals
    return best, exact[np.arange(len(best)), best], open_.sum(axis=1)


def matrix(column: pa.Array, width: int, kind) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width).astype(kind, copy=False)


def project(vectors: DataFrame, simplex: Simplex, dim: int = DIM) -> DataFrame:
    """vec_id, v and apex, written once for all rounds."""

    def run(batch: pa.RecordBatch) -> dict:
        apexes = simplex.apexes(matrix(batch.column("v"), dim, np.int64))
        return {"vec_id": batch.column("vec_id"), "v": batch.column("v"), "apex": list(apexes)}

    return written(per_batch(vectors, run, "vec_id long, v array<long>, apex array<double>"))


def totals(projected: DataFrame, simplex: Simplex, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums of the components and counts of the vectors nearest to each centroid."""
    k, dim = centroids.shape
    places, width = simplex.apexes(centroids), len(simplex.points)
    small_batches(projected.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros((k, dim), dtype=np.int64), np.zeros(k, dtype=np.int64)
        for batch in batches:
            if batch.num_rows:
                v = matrix(batch.column("v"), dim, np.int64)
                best, _, _ = nearest(v, matrix(batch.column("apex"), width, float), centroids, places)
                np.add.at(sums, best, v)
                counts += np.bincount(best, minlength=k)
        full = np.flatnonzero(counts)
        # The count travels as one more component.
        both = np.column_stack((sums, counts))[full]
        yield pa.RecordBatch.from_pydict({
            "cluster": np.repeat(full, dim + 1), "component": np.tile(np.arange(dim + 1), len(full)), "total": both.ravel(),
        })

    parts = projected.select("v", "apex").mapInArrow(run, "cluster long, component long, total long")
    both = np.zeros((k, dim + 1), dtype=object)
    for r in parts.groupBy("cluster", "component").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect():
        both[r.cluster, r.component] = int(r.total)
    return both[:, :dim], both[:, dim]


def assign(projected: DataFrame, simplex: Simplex, centroids: np.ndarray) -> DataFrame:
    """vec_id, cluster, distance (squared) and n_compared, the centroids the bounds left open."""
    dim, width, places = centroids.shape[1], len(simplex.points), simplex.apexes(centroids)

    def run(batch: pa.RecordBatch) -> dict:
        best, distance, count = nearest(
            matrix(batch.column("v"), dim, np.int64), matrix(batch.column("apex"), width, float), centroids, places
        )
        return {"vec_id": batch.column("vec_id"), "cluster": best.astype(np.int32), "distance": distance, "n_compared": count.astype(np.int32)}

    return per_batch(projected, run, "vec_id long, cluster int, distance long, n_compared int")


def cluster(vectors: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, seed: str = SEED, dim: int = DIM, scale: int = SCALE, pivots: int = PIVOTS) -> tuple[DataFrame, np.ndarray] | None:
    """(assigned vectors, final centroids), or None if no vector is kept."""
    own = kept(vectors, dim, scale)
    centroids = first_centroids(own, k, seed)
    if not len(centroids):
        return None
    simplex = Simplex(centroids, pivots)
    projected = project(own, simplex, dim)
    for _ in range(rounds):
        sums, counts = totals(projected, simplex, centroids)
        full = counts > 0
        centroids = centroids.copy()
        centroids[full] = (sums[full] // counts[full, None]).astype(np.int64)
    return assign(projected, simplex, centroids), centroids


def report(vectors: DataFrame, **options) -> DataFrame:
    """One row a kept vector, with the inertia of its cluster and of all, and its centroid's digest."""
    spark = vectors.sparkSession
    found = cluster(vectors, **options)
    if found is None:
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    rows, centroids = written(found[0].select("vec_id", "cluster", "distance")), found[1]
    own = {r.cluster: int(r.total) for r in rows.groupBy("cluster").agg(F.sum("distance").alias("total")).collect()}
    facts = spark.createDataFrame(
        [(c, total, sum(own.values()), hashlib.sha256(",".join(map(str, centroids[c].tolist())).encode()).hexdigest()) for c, total in own.items()],
        "cluster int, cluster_inertia long, inertia long, centroid_sha256 string",
    )
    return rows.join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(table(spark, sf_dir, "embeddings"))


def _oracle() -> str:
    apart = "list_sum(list_transform(list_zip(e.v, c.v), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT"
    steps = [f"""e AS MATERIALIZED (
  SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS v
  FROM embeddings
  WHERE len(embedding) = {DIM} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {DIM}
), c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY sha256('{SEED}:' || coalesce(vec_id::VARCHAR, '')), vec_id, v) - 1 AS c, v
  FROM e QUALIFY c < {CENTROIDS}
)"""]
    for i in range(ROUNDS + 1):
        steps.append(f"""a{i} AS MATERIALIZED (
  SELECT row, vec_id, e.v, arg_min(c, d * 1000 + c) AS c, min(d) AS d
  FROM (SELECT e.row, e.vec_id, e.v, c.c, {apart} AS d FROM e CROSS JOIN c{i} c) e GROUP BY ALL
)""")
        if i < ROUNDS:
            steps.append(f"""u{i} AS (
  SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY i)::BIGINT[] AS v
  FROM (SELECT c, i, sum(x) AS s, count(*) AS n FROM (SELECT c, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM a{i}) GROUP BY c, i)
  GROUP BY c
), c{i + 1} AS MATERIALIZED (SELECT c, coalesce(u.v, o.v) AS v FROM c{i} o LEFT JOIN u{i} u USING (c))""")
    return "WITH " + ", ".join(steps) + f"""
SELECT vec_id, c::INTEGER AS cluster, d AS distance, (sum(d) OVER (PARTITION BY c))::BIGINT AS cluster_inertia,
  (sum(d) OVER ())::BIGINT AS inertia, sha256(array_to_string(k.v, ',')) AS centroid_sha256
FROM a{ROUNDS} JOIN c{ROUNDS} k USING (c)
"""


ORACLE = _oracle()
