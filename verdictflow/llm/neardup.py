"""Near-duplicate documents by an LSH forest of MinHash signatures, with exact confirmation.

1. A text becomes the set of its word shingles, the set a signature of ``HASHES`` minima.
   Texts with equal sets are one *class*; only its smallest id goes on.
2. The forest has ``TREES`` sorted orders of the signatures, each with its own permutation of the
   minima. Neighbours in an order whose longest common prefix is at least ``DEPTH`` minima form a
   *region*. A region of more than ``REGION`` classes is *crowded*: it is split at greater depth, by
   itself, until its parts are small enough, which finds most of its links but not all of them.
3. In a region, neighbours whose signatures agree as documents above the threshold do (five
   standard deviations below it) and whose set sizes allow it are candidates. What candidates
   connect is a *cluster*; every set is then shipped once, to its cluster's task.
4. There the exact test runs on full sets, most alike first, until no two components of the
   cluster are left untested. Clusters too large for one task are tested region by region instead,
   and the links found are joined up by rounds of ``components``.
5. The classes of crowded regions then meet once more, by an exact prefix-filter join over their
   full sets (``crowded_links``) that looks only at pairs not connected so far.

A link of classes that are not both in crowded regions, at the threshold 0.85 is missed by all 24 orders with a chance of 1e-10, by the agreement
test with 3e-7. The number of candidates kept is linear in the classes: a region hands on a
spanning forest, never its pairs.

Defined cases: null texts and texts without words have an empty set and are linked with nothing;
repeated rows are in one class; rows with a null id keep component null and are kept; an empty
table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Callable
from math import sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from verdictflow.operators.ordered import numbered

from . import hashing
from .common import held_by, small_side, table, written
from .components import components
from .streams import per_batch, per_group, small_batches

HASHES = 64
TREES = 24
DEPTH = 3
DEEPEST = 16
REGION = 2_000  # classes of a region that are compared with each other
CLUSTER = 4_000  # classes, and
CLUSTER_SHINGLES = 6_000_000  # shingles of a cluster that is confirmed in one task
MATRIX_SETS = 1_000  # sets, and
MATRIX = 2_000_000  # cells of the largest matrix of sets and shingles; larger clusters are compared set by set

_ORDERS = np.stack([np.random.default_rng(900 + t).permutation(HASHES) for t in range(TREES)])


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def prefix_keys(sig: np.ndarray, tree: int, depth: int, orders: np.ndarray = _ORDERS) -> np.ndarray:
    """One 64-bit key for the first ``depth`` minima of each signature in the order of ``tree``."""
    key = np.full(len(sig), tree + 1, dtype=np.uint64)
    for j in orders[tree][:depth]:
        key = hashing.mix(key * np.uint64(0x9E3779B97F4A7C15) + sig[:, j].astype(np.uint64))
    return key


def shingle_sets(texts, k: int):
    """(first text, sorted distinct shingles of a run of texts, offsets), run by run."""
    for first, block in hashing.blocks(texts):
        values, offset = hashing.Words(block).shingles(k)
        yield first, *hashing.distinct(values, offset)


def signatures(docs: DataFrame, k: int) -> DataFrame:
    def sign(batch: pa.RecordBatch) -> dict:
        sizes, low, high, sigs = [], [], [], []
        for _, values, offset in shingle_sets(batch.column("text").to_pylist(), k):
            n = np.diff(offset)
            sig = hashing.minhashes(values, offset, HASHES)
            total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(values)))
            other = np.concatenate((np.zeros(1, np.uint64), np.cumsum(hashing.mix(values ^ np.uint64(0x5DEECE66D)))))
            sizes.append(n)
            low.append(_signed(total[offset[1:]] - total[offset[:-1]]))
            high.append(_signed(other[offset[1:]] - other[offset[:-1]]))
            sigs += [row.tobytes() for row in sig]
        return {
            "doc_id": batch.column("doc_id"), "n_shingles": np.concatenate(sizes), "set_a": np.concatenate(low),
            "set_b": np.concatenate(high), "sig": sigs,
        }

    rows = docs.select("doc_id", F.col("text").cast("binary").alias("text"))
    return per_batch(rows, sign, "doc_id long, n_shingles long, set_a long, set_b long, sig binary")


def agreement(threshold: float) -> int:
    """Equal minima that two documents at the threshold have but for five standard deviations."""
    return int(HASHES * (threshold - 5 * sqrt(threshold * (1 - threshold) / HASHES)))


class Forest:
    """Union-find over the members of one group, joined under the smallest id."""

    def __init__(self, ids: list[int]):
        self.up = list(range(len(ids)))
        self.ids = ids

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.root(i), self.root(j)
        if i == j:
            return False
        if (self.ids[j], j) < (self.ids[i], i):
            i, j = j, i
        self.up[j] = i
        return True

    def stars(self) -> dict[str, list]:
        pairs = [(self.ids[i], self.ids[r]) for i in range(len(self.up)) if self.ids[r := self.root(i)] != self.ids[i]]
        return {"a": [p[0] for p in pairs], "b": [p[1] for p in pairs]}


def region_stars(nodes: list[int], sizes: np.ndarray, sig: np.ndarray, threshold: float) -> dict[str, list]:
    """Candidates among neighbours of one region, as a spanning forest."""
    forest, least = Forest(nodes), agreement(threshold)
    for i in range(len(nodes) - 1):
        rest = slice(i + 1, None)
        fits = np.minimum(sizes[rest], sizes[i]) >= threshold * np.maximum(sizes[rest], sizes[i]) - 1e-9
        near = np.flatnonzero(fits & ((sig[rest] == sig[i]).sum(axis=1) >= least))
        for j in near.tolist():
            forest.join(i, i + 1 + j)
    return forest.stars()


def common_sizes(sets: list[np.ndarray]) -> np.ndarray | None:
    """Sizes of all intersections of some sets, as a product of matrices (None: too large for one)."""
    sizes = [len(s) for s in sets]
    if len(sets) > MATRIX_SETS or sum(sizes) > MATRIX:
        return None
    _, place, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    # Shingles of one set only are in no intersection.
    shared = count > 1
    if len(sets) * int(shared.sum()) > MATRIX:
        return None
    column = np.cumsum(shared) - 1
    row, held = np.repeat(np.arange(len(sets)), sizes), shared[place]
    holds = np.zeros((len(sets), int(shared.sum())), dtype=np.float32)
    holds[row[held], column[place[held]]] = 1
    return (holds @ holds.T).astype(np.int64)


def confirm(nodes: list[int], sets: list[np.ndarray], percent: int) -> dict[str, list]:
    """Components of the exact links among some sets, as stars."""
    forest = Forest(nodes)
    offset = np.concatenate(([0], np.cumsum([len(s) for s in sets])))
    sizes = np.diff(offset)
    both = common_sizes(sets)
    if both is not None:
        linked = 100 * both >= percent * (sizes[:, None] + sizes - both)
        left = np.ones(len(nodes), dtype=bool)
        for i in range(len(nodes)):
            reached = np.array([i]) if left[i] else np.empty(0, dtype=np.int64)
            while len(reached):
                left[reached] = False
                for j in reached.tolist():
                    forest.join(i, j)
                reached = np.flatnonzero(linked[reached].any(axis=0) & left)
        return forest.stars()
    flat = np.concatenate(sets)
    sig = hashing.minhashes(flat, offset, HASHES)
    least = agreement(percent / 100)
    for i in range(1, len(nodes)):
        small, large = np.minimum(sizes[:i], sizes[i]), np.maximum(sizes[:i], sizes[i])
        alike = (sig[:i] == sig[i]).sum(axis=1)
        left = np.flatnonzero((100 * small >= percent * large) & (alike >= least))
        left = left[np.argsort(-alike[left], kind="stable")]
        step = 1
        while len(left):
            own = forest.root(i)
            left = np.array([j for j in left.tolist() if forest.root(j) != own], dtype=np.int64)
            now, left = left[:step], left[step:]
            if not len(now):
                break
            joined = np.concatenate([sets[j] for j in now.tolist()])
            at = np.minimum(np.searchsorted(sets[i], joined), sizes[i] - 1)
            cuts = np.concatenate(([0], np.cumsum(sizes[now])[:-1]))
            both = np.add.reduceat((sets[i][at] == joined).astype(np.int64), cuts)
            for j in now[100 * both >= percent * (sizes[now] + sizes[i] - both)].tolist():
                forest.join(i, j)
            step = min(256, step * 4)
    return forest.stars()


def regions(reps: DataFrame, orders: np.ndarray = _ORDERS) -> tuple[DataFrame, DataFrame | None]:
    """(key, node) of every region with at least two and at most about ``REGION`` classes, and the
    nodes of crowded regions (None: there are none)."""
    rows = _first_keys(reps, orders).select("node", F.posexplode("keys").alias("tree", "key"))
    found, depth, crowd_nodes = None, DEPTH, None
    while True:
        crowd = written(rows.groupBy("key").agg(F.count("*").alias("_n")).where("_n > 1"))
        # All keys are read once more; whatever follows reads the rows of regions only.
        met = written(held_by(rows, crowd.select("key"), "key").select("key", "node", "tree"))
        full = crowd.where(F.col("_n") > REGION)
        if full.isEmpty():
            part = met.select("key", "node")
            return part if found is None else found.unionByName(part), crowd_nodes
        part = met.join(small_side(full.select("key")), "key", "left_anti").select("key", "node")
        found = part if found is None else found.unionByName(part)
        crowded = met.join(small_side(full), "key").select("key", "node", "tree", "_n")
        if crowd_nodes is None:
            crowd_nodes = written(crowded.select("node").distinct())
            held = classes_of(reps.select("node", "sig"), crowd_nodes)
        if depth >= DEEPEST:
            parts = F.ceil(F.col("_n") / F.lit(REGION))
            dealt = F.xxhash64("key", F.pmod(F.xxhash64("tree", "node"), parts))
            return found.unionByName(crowded.select(dealt.alias("key"), "node")), crowd_nodes
        depth = min(DEEPEST, depth + 2)
        # At least three rows a class meet here, and only for classes of crowded regions.
        rows = written(_deeper(crowded.select("node", "tree").join(held, "node"), depth, orders))


def classes_of(reps: DataFrame, nodes: DataFrame) -> DataFrame:
    """The classes of a written table of nodes, written: signatures of all others stay where they are."""
    return written(held_by(reps, nodes, "node"))


def distinct_regions(near: DataFrame) -> DataFrame:
    """``near`` without the regions whose members are, all of them, those of another region.

    Two classes that are much alike share most of their bands and are alone in them. Members are named
    by their number and two exclusive-ors of digests.
    """
    digests = {"_x": F.bit_xor(F.xxhash64("node")), "_y": F.bit_xor(F.xxhash64("node", F.lit(1)))}
    regions_named = near.groupBy("key").agg(F.count("*").alias("_n"), *[d.alias(c) for c, d in digests.items()])
    kept = regions_named.groupBy("_n", *digests).agg(F.min("key").alias("key")).select("key")
    return near.join(kept, "key")


def _minima(batch: pa.RecordBatch) -> np.ndarray:
    return np.frombuffer(b"".join(batch.column("sig").to_pylist()), dtype=np.uint16).reshape(-1, HASHES)


def _first_keys(reps: DataFrame, orders: np.ndarray) -> DataFrame:
    """(node, keys): derived whenever they are read, as they are larger than they cost."""

    def keys(batch: pa.RecordBatch) -> dict:
        sig = _minima(batch)
        flat = np.stack([_signed(prefix_keys(sig, t, DEPTH, orders)) for t in range(len(orders))], axis=1)
        ends = np.arange(0, flat.size + 1, len(orders), dtype=np.int32)
        return {"node": batch.column("node"), "keys": pa.ListArray.from_arrays(ends, flat.ravel())}

    return per_batch(reps.select("node", "sig"), keys, f"node {dict(reps.dtypes)['node']}, keys array<long>")


def _deeper(rows: DataFrame, depth: int, orders: np.ndarray) -> DataFrame:
    def key(batch: pa.RecordBatch) -> dict:
        sig = _minima(batch)
        trees = batch.column("tree").to_numpy()
        keys = np.zeros(len(trees), dtype=np.uint64)
        for t in np.unique(trees).tolist():
            keys[trees == t] = prefix_keys(sig[trees == t], t, depth, orders)
        return {"node": batch.column("node"), "tree": batch.column("tree"), "key": _signed(keys)}

    return per_batch(rows, key, f"node {dict(rows.dtypes)['node']}, tree int, key long")


BUCKETS = 1 << 18  # counters of shingles; equal counts only cost time
BLOCK = 10_000  # rows of one shingle that are held against as many others in a task


def _prefixes(sets: DataFrame, percent: int) -> DataFrame:
    """(token, node, root, size, place): the first shingles of each set, rare ones first.

    Two sets above the threshold have one of them in common. Any one order of all shingles gives the
    same links; counters that several shingles may share make it one with rare shingles first.
    """

    def count(batches):
        held = np.zeros(BUCKETS, dtype=np.int64)
        for batch in batches:
            for x in batch.column("shingles").to_pylist():
                np.add.at(held, (np.frombuffer(x, dtype=np.uint64) % np.uint64(BUCKETS)).astype(np.int64), 1)
        at = np.flatnonzero(held)
        yield pa.RecordBatch.from_pydict({"bucket": at, "n": held[at]})

    small_batches(sets.sparkSession)
    counted = sets.select("shingles").mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(BUCKETS, dtype=np.int64)
    counts[counted["bucket"].to_numpy(dtype=np.int64)] = counted["n"].to_numpy(dtype=np.int64)
    shared = sets.sparkSession.sparkContext.broadcast(counts)

    def first(batch: pa.RecordBatch) -> dict:
        tokens, places, rows, sizes = [], [], [], []
        for i, x in enumerate(batch.column("shingles").to_pylist()):
            own = np.frombuffer(x, dtype=np.uint64)
            # A partner has at least percent of the larger set in common with it.
            n = len(own) - -(-percent * len(own) // 100) + 1 if len(own) else 0
            ranked = own[np.lexsort((own, shared.value[(own % np.uint64(BUCKETS)).astype(np.int64)]))][:n]
            tokens.append(ranked)
            places.append(np.arange(n, dtype=np.int32))
            rows.append(np.full(n, i))
            sizes.append(np.full(n, len(own), dtype=np.int64))
        at = pa.array(np.concatenate(rows))
        return {
            "token": _signed(np.concatenate(tokens)), "node": batch.column("node").take(at), "root": batch.column("root").take(at),
            "size": np.concatenate(sizes), "place": np.concatenate(places),
        }

    kind = dict(sets.dtypes)["node"]
    return per_batch(sets.select("node", "root", "shingles"), first, f"token long, node {kind}, root {kind}, size long, place int")


def prefix_pairs(group: pa.Table, percent: int) -> dict[str, list]:
    """Pairs of a shingle's rows with different roots that may reach the threshold by size and place."""
    side, root, nodes = (group.column(c).to_numpy() for c in ("side", "root", "node"))
    sizes, places = group.column("size").to_numpy(), group.column("place").to_numpy()
    out: dict[str, list] = {"a": [], "b": []}
    # Both parts of a block pair meet each other; a part that meets itself has one side only.
    left = np.flatnonzero(side == 0)
    right = np.flatnonzero(side == 1)
    alone = not len(right)
    if alone:
        right = left
    _, number = np.unique(root, return_inverse=True)
    if number.max() == 0:
        return out
    for at, i in enumerate(left.tolist()):
        rest = right[at + 1 :] if alone else right
        other = sizes[rest]
        fits = (number[rest] != number[i]) & (100 * np.minimum(other, sizes[i]) >= percent * np.maximum(other, sizes[i]))
        # Shingles before the first common one are not common, so this many at most are.
        most = np.minimum(other - places[rest], sizes[i] - places[i])
        fits &= 100 * most >= percent * (other + sizes[i] - most)
        found = nodes[rest[fits]].tolist()
        out["a"] += [nodes[i]] * len(found)
        out["b"] += found
    return out


def crowded_links(sets: DataFrame, percent: int) -> DataFrame:
    """(a, b) of all pairs of ``sets`` (node, root, shingles) at the threshold whose roots differ."""
    kind = dict(sets.dtypes)["node"]
    tokens = written(_prefixes(sets, percent))
    # A shingle inside one component only has nothing left to link.
    known = written(
        tokens.groupBy("token").agg(F.count("*").alias("_n"), F.min("root").alias("_a"), F.max("root").alias("_b"))
        .where("_a <> _b").select("token", F.ceil(F.col("_n") / F.lit(BLOCK)).cast("int").alias("_p"))
    )
    rows = tokens.join(small_side(known), "token").withColumn("_i", F.pmod(F.xxhash64("node"), F.col("_p")).cast("int"))
    # Part i meets itself and, as the first or second side, every other part.
    met = rows.withColumn("_j", F.explode(F.sequence(F.lit(0), F.col("_p") - 1))).select(
        F.xxhash64("token", F.least("_i", "_j"), F.greatest("_i", "_j")).alias("key"),
        F.when(F.col("_i") > F.col("_j"), 1).otherwise(0).alias("side"), "node", "root", "size", "place",
    )
    found = written(
        per_group(met, "key", ["side", "node"], lambda g: prefix_pairs(g, percent), f"a {kind}, b {kind}")
        .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    )
    if found.isEmpty():
        return found

    def test(batch: pa.RecordBatch) -> dict:
        held = []
        for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist()):
            p, q = np.frombuffer(x, dtype=np.uint64), np.frombuffer(y, dtype=np.uint64)
            both = len(np.intersect1d(p, q, assume_unique=True))
            held.append(100 * both >= percent * (len(p) + len(q) - both))
        at = pa.array(np.flatnonzero(held))
        return {"a": batch.column("a").take(at), "b": batch.column("b").take(at)}

    pairs = found.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("x")), "a")
    return per_batch(pairs.join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("y")), "b"), test, f"a {kind}, b {kind}")


SAME = ["n_shingles", "set_a", "set_b"]


def shingle_bytes(texts, k: int) -> list[bytes]:
    """The sorted distinct shingles of each text, 8 bytes each."""
    out = []
    for _, values, offset in shingle_sets(texts, k):
        out += [values[a:b].tobytes() for a, b in zip(offset[:-1], offset[1:])]
    return out


def link(signed: DataFrame, fetch: Callable[[DataFrame], DataFrame], percent: int, orders: np.ndarray = _ORDERS) -> DataFrame:
    """Components of units with exactly confirmed links.

    ``signed`` has node, ``SAME`` and sig per unit and is a written table; ``fetch`` takes
    (node, root) rows and adds each node's ``shingles``. Returned are ``SAME``, node (the smallest of
    the class), component and ``_rows`` (units of the class) of every class with more than one
    unit or a link.
    """
    threshold = percent / 100
    kind = dict(signed.dtypes)["node"]
    reps = written(
        signed.where("n_shingles > 0 AND node IS NOT NULL").groupBy(*SAME)
        .agg(F.min(F.struct("node", "sig")).alias("_r"), F.count("*").alias("_rows"))
        .select(*SAME, "_rows", F.col("_r.node").alias("node"), F.col("_r.sig").alias("sig"))
    )
    near, crowded = regions(reps, orders)
    near = written(distinct_regions(near if crowded is None else written(near)))
    grouped = classes_of(reps.select("node", "n_shingles", "sig"), written(near.select("node").distinct()))

    def candidates(group: pa.Table) -> dict | None:
        sig = np.frombuffer(b"".join(group.column("sig").to_pylist()), dtype=np.uint16).reshape(-1, HASHES)
        return region_stars(group.column("node").to_pylist(), group.column("n_shingles").to_numpy(), sig, threshold)

    def test(group: pa.Table) -> dict | None:
        sets = [np.frombuffer(x, dtype=np.uint64) for x in group.column("shingles").to_pylist()]
        held = [i for i, s in enumerate(sets) if len(s)]
        nodes = group.column("node").to_pylist()
        return confirm([nodes[i] for i in held], [sets[i] for i in held], percent) if len(held) > 1 else None

    stars = f"a {kind}, b {kind}"
    members = near.join(grouped, "node")
    clusters = written(components(per_group(members, "key", ["node", "n_shingles"], candidates, stars)))
    too_large = written(
        clusters.join(reps.select("node", "n_shingles"), "node").groupBy("root")
        .agg(F.count("*").alias("_n"), F.sum("n_shingles").alias("_s"))
        .where((F.col("_n") > CLUSTER) | (F.col("_s") > CLUSTER_SHINGLES)).select("root")
    )
    sets = fetch(clusters)
    if too_large.isEmpty():
        links = written(per_group(sets, "root", ["node", "shingles"], test, stars))
    else:
        sets = written(sets)
        whole = sets.join(too_large, "root", "left_anti").select(F.xxhash64("root").alias("key"), "node", "shingles")
        split = sets.join(too_large, "root").select("node", "shingles").join(near, "node").select("key", "node", "shingles")
        tested = per_group(whole.unionByName(split), "key", ["node", "shingles"], test, stars)
        links = written(components(tested).select(F.col("node").alias("a"), F.col("root").alias("b")))
    if crowded is not None:
        roots = links.select(F.col("a").alias("node"), F.col("b").alias("_root")).groupBy("node").agg(F.min("_root").alias("_root"))
        sets = fetch(crowded.withColumn("root", F.col("node"))).where("length(shingles) > 0").select("node", "shingles").distinct()
        sets = written(sets.join(roots, "node", "left").select("node", F.coalesce("_root", "node").alias("root"), "shingles"))
        more = written(crowded_links(sets, percent))
        if not more.isEmpty():
            links = components(links.select("a", "b").unionByName(more)).select(F.col("node").alias("a"), F.col("root").alias("b"))
            links = written(links)
    joined = links.groupBy("a").agg(F.min("b").alias("b"))
    joined = joined.unionByName(joined.select(F.col("b").alias("a"), "b").distinct().join(joined.select("a"), "a", "left_anti"))
    return (
        reps.select(*SAME, "node", "_rows").join(joined, F.col("node") == F.col("a"), "left")
        .where("_rows > 1 OR b IS NOT NULL").select(*SAME, "node", F.coalesce("b", "node").alias("component"), "_rows")
    )


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row."""
    signed = written(signatures(docs, k).withColumnRenamed("doc_id", "node"))

    def to_sets(batch: pa.RecordBatch) -> dict:
        return {"root": batch.column("root"), "node": batch.column("node"), "shingles": shingle_bytes(batch.column("text").to_pylist(), k)}

    def fetch(nodes: DataFrame) -> DataFrame:
        texts = docs.select(F.col("doc_id").alias("node"), F.col("text").cast("binary").alias("text"))
        return per_batch(held_by(texts, nodes, "node"), to_sets, "root long, node long, shingles binary")

    classes = link(signed, fetch, percent).select(*SAME, "component")
    out = signed.select(F.col("node").alias("doc_id"), *SAME).join(classes, SAME, "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id")).withColumn(
        "kept", F.col("doc_id").eqNullSafe(F.col("component_id"))
    )


def numbered_rows(docs: DataFrame) -> DataFrame:
    """(_row, text, _node): every row with a number of its own.

    A row's number is its id where no other row has it. Rows without an id, and rows that share one, are
    numbered behind all others (before them, where an id is beyond 2**62), in the order of id and text;
    where there are none, nothing is shuffled but ids.
    """
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), "doc_id", "text")
    odd = written(docs.groupBy("doc_id").agg(F.count("*").alias("_n")).where("_n > 1 OR doc_id IS NULL").select(F.col("doc_id").alias("_odd")))
    if odd.isEmpty():
        return packed.select("_row", "text", F.col("doc_id").alias("_node"))
    shared = small_side(odd)
    same = F.col("doc_id").eqNullSafe(F.col("_odd"))
    ends = docs.agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.count("*").alias("n")).first()
    high = 0 if ends.high is None else ends.high
    start = high if high < 1 << 62 else ends.low - ends.n - 1
    # Equal rows are dealt out at random, so that a third of all rows may be equal.
    rest = written(packed.join(shared, same, "left_semi").withColumns({"_md5": F.md5(F.col("text").cast("binary")), "_draw": F.rand(7)}))
    order = [F.col(c).asc() for c in ("doc_id", "_md5", "_draw")]
    given = numbered(rest, [], order, "_place").select("_row", "text", (F.col("_place") + start).alias("_node"))
    return packed.join(shared, same, "left_anti").select("_row", "text", F.col("doc_id").alias("_node")).unionByName(given)


def deduplicate(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """One row of each component: the one with the smallest id; all columns as they are.

    Rows are compared and kept one by one (``numbered_rows``): of repeated rows one stays, rows without
    an id are compared like any other, and rows that share an id but not their text are told apart.
    """
    rows = numbered_rows(docs)
    found = near_duplicates(rows.select(F.col("_node").alias("doc_id"), "text"), k, percent)
    gone = small_side(written(found.where("NOT kept").select(F.col("doc_id").alias("_gone"))))
    return rows.join(gone, F.col("_node") == F.col("_gone"), "left_anti").select("_row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), k=3, percent=85)


ORACLE = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE
    WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS shingle
  FROM d
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
overlap AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS i FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id
  GROUP BY 1, 2
), links AS (
  SELECT x, y FROM overlap JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * i >= 85 * (p.n + q.n - i)
), ways AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach AS (
  SELECT doc_id AS x, doc_id AS r FROM documents
  UNION SELECT ways.y, reach.r FROM reach JOIN ways ON ways.x = reach.x
), c AS (SELECT x AS doc_id, min(r) AS component_id FROM reach GROUP BY x)
SELECT documents.doc_id, coalesce(n.n, 0) AS n_shingles, component_id, documents.doc_id = component_id AS kept
FROM documents LEFT JOIN n USING (doc_id) LEFT JOIN c USING (doc_id)
"""
