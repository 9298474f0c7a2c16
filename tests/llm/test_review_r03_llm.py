"""What the review of the third round found in op7_repeated_paragraphs: rows and texts moved that nothing needs."""

import collections

import numpy as np
import pytest

from verdictflow.llm import common, hashing, neardup, paragraphs
from verdictflow.llm.common import written


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def _reps(spark, draw, template, size):
    """Signatures of which ``template`` agree in all but a few minima, and pairs that agree in most."""
    sig = draw.integers(0, 1 << 16, size=(size, neardup.HASHES)).astype(np.uint16)
    sig[1:template] = sig[0]
    for row in sig[:template]:
        row[draw.integers(0, neardup.HASHES, size=6)] = draw.integers(0, 1 << 16, size=6)
    sig[template + 1 : size : 2, 9:] = sig[template : size - 1 : 2, 9:]
    return sig, written(spark.createDataFrame([(i, bytearray(row.tobytes())) for i, row in enumerate(sig)], "node long, sig binary"))


def _wanted(sig, orders, depth):
    held = collections.defaultdict(list)
    for t, order in enumerate(orders):
        for i, row in enumerate(sig):
            held[t, *row[order[:depth]].tolist()].append(i)
    return [tuple(x) for x in held.values() if len(x) > 1]


def _found(regions):
    held = collections.defaultdict(list)
    for r in regions.collect():
        held[r["key"]].append(r["node"])
    return sorted(tuple(sorted(x)) for x in held.values())


def test_keys_of_all_classes_are_held_against_regions_once(spark, monkeypatch):
    sig, reps = _reps(spark, np.random.default_rng(5), 20, 60)
    orders = paragraphs._BANDS
    regions, crowded = neardup.regions(reps, orders)
    assert crowded is None and _found(regions) == sorted(_wanted(sig, orders, neardup.DEPTH))
    # What is handed on reads a table of the regions' rows, not the keys of all classes again.
    assert "MapInArrow" not in _plan(regions)


def test_crowded_regions_are_split_without_moving_all_keys(spark, monkeypatch):
    monkeypatch.setattr(neardup, "REGION", 12)
    sig, reps = _reps(spark, np.random.default_rng(6), 20, 60)
    orders = paragraphs._BANDS
    plain = _wanted(sig, orders, neardup.DEPTH)
    want = [x for x in plain if len(x) <= 12]
    crowds = [x for x in plain if len(x) > 12]
    assert want and crowds
    seen = []
    first_keys = neardup._first_keys
    monkeypatch.setattr(neardup, "_first_keys", lambda *a: seen.append(1) or first_keys(*a))
    regions, crowded = neardup.regions(reps, orders)
    assert {r["node"] for r in crowded.collect()} == {i for x in crowds for i in x}
    found = _found(regions)
    assert not collections.Counter(want) - collections.Counter(found) and max(map(len, found)) <= 20
    assert "MapInArrow" not in _plan(regions) and "MapInArrow" not in _plan(crowded) and len(seen) == 1


@pytest.mark.parametrize("percent", [80, 85])
def test_small_clusters_are_confirmed_by_one_product(monkeypatch, percent):
    draw = np.random.default_rng(7)

    def brute(ids, sets):
        root = {x: x for x in ids}
        for a, p in zip(ids, sets):
            for b, q in zip(ids, sets):
                both = len(np.intersect1d(p, q))
                if 100 * both >= percent * (len(p) + len(q) - both):
                    low, high = sorted((root[a], root[b]))
                    root = {x: low if r == high else r for x, r in root.items()}
        return sorted((x, r) for x, r in root.items() if x != r)

    cases = [([8], [np.array([3], np.uint64)])]
    for _ in range(25):
        bases = [np.unique(draw.integers(0, 1 << 62, size=int(draw.integers(1, 60)))) for _ in range(3)]
        sets = []
        for _ in range(int(draw.integers(2, 25))):
            own = bases[int(draw.integers(3))]
            held = own[draw.random(len(own)) > draw.choice([0, 0.04, 0.1, 0.2])]
            sets.append(np.unique(np.concatenate((held if len(held) else own, draw.integers(0, 1 << 62, size=int(draw.integers(0, 3)))))).astype(np.uint64))
        cases.append((draw.permutation(900)[: len(sets)].tolist(), sets))
    want = [brute(*x) for x in cases]
    with monkeypatch.context() as m:
        m.setattr(hashing, "minhashes", lambda *_: pytest.fail("a small cluster needs no signatures"))
        assert [sorted(zip(*neardup.confirm(*x, percent).values())) for x in cases] == want and any(want)
    monkeypatch.setattr(neardup, "MATRIX", 0)
    assert [sorted(zip(*neardup.confirm(*x, percent).values())) for x in cases] == want


def test_texts_that_nobody_wants_are_not_moved(spark):
    docs = spark.createDataFrame([(i % 9, f"text {i}") for i in range(12)] + [(None, "x"), (3, None)], "doc_id long, text string")
    wanted = written(spark.createDataFrame([(i, [i] * 50) for i in (1, 2, 40)], "doc_id long, wanted array<int>"))
    rows = {(i % 9, f"text {i}".encode()) for i in range(12) if i % 9 in (1, 2)}
    for limit in (0, 120, 1 << 20):
        got = paragraphs.texts_of(docs, wanted, limit)
        assert {(r.doc_id, bytes(r.text)) for r in got.collect()} == rows and {len(r.wanted) for r in got.collect()} == {50}
    analyzed = paragraphs.texts_of(docs, wanted, 120)._jdf.queryExecution().analyzed().toString()
    assert "LeftSemi" in analyzed and analyzed.count("ResolvedHint") == 1  # ids are broadcast, lists are not


def test_rows_without_a_wanted_hash_are_dropped_before_the_shuffle(spark):
    draw = np.random.default_rng(8)
    hashes = draw.integers(-(1 << 63), (1 << 63) - 1, size=600).tolist()
    rows = spark.createDataFrame([(h, i) for i, h in enumerate(hashes + hashes[:50])], "key long, n int")
    keys = written(spark.createDataFrame([(h, i) for i, h in enumerate(hashes[:40] + [7])], "key long, other int"))
    want = sorted((h, n, o) for o, h in enumerate(hashes[:40]) for n in (o, 600 + o))
    for limit in (0, 1 << 20):
        assert sorted(map(tuple, common.held_by(rows, keys, "key", limit).collect())) == want
    passed = {r.key for r in common.likely_rows(rows, keys, "key", 1 << 12).collect()}
    assert set(hashes[:40]) <= passed and len(passed) < 60
    assert "MapInArrow" in _plan(common.held_by(rows, keys, "key", 0))


def test_regions_and_pieces_are_the_same_where_nothing_can_be_broadcast(spark, monkeypatch):
    draw = np.random.default_rng(9)
    words = lambda n: " ".join(f"w{x}" for x in draw.integers(0, 10**6, size=n))
    shared = [words(90) for _ in range(6)]
    texts = [" ".join([words(20), shared[i % 6], words(20)]) for i in range(18)] + [words(200) for _ in range(6)]
    docs = spark.createDataFrame([*enumerate(texts), (None, shared[0]), (90, None)], "doc_id long, text string")
    want = sorted(map(tuple, paragraphs.repeated_pieces(docs).collect()))
    assert {w[0] for w in want} == set(range(18))
    moved, texts_of = [], paragraphs.texts_of
    monkeypatch.setattr(paragraphs, "texts_of", lambda d, wanted: moved.append(wanted) or texts_of(d, wanted, 0))
    held_by = common.held_by
    for module in (paragraphs, neardup):
        monkeypatch.setattr(module, "held_by", lambda rows, keys, key: held_by(rows, keys, key, 0))
    assert sorted(map(tuple, paragraphs.repeated_pieces(docs).collect())) == want
    # Texts meet a row a piece, not a row a window; a passage of 90 words holds more than two windows.
    assert max(len(r[1]) for r in moved[0].collect()) <= 2
