"""Results against SQL twins, brute force, round trips and held-out accuracy."""

import collections
import hashlib
import itertools
import random
import re

import compare
import numpy as np
import pytest
from pyspark.sql import functions as F

from verdictflow.llm import decontaminate, fingerprints, hashing, neardup, packing, paragraphs, quality, registry, tokens, urls
from verdictflow.llm.components import components

SMALL = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def texts_of(spark, sf_dir=SMALL):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def shingles(text, k):
    w = words(text)
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_twin(spark, name):
    problem, rows, _ = compare.compare(spark, name, registry.QUERIES[name], registry.ORACLES[name], SMALL)
    assert problem is None and rows > 0


def brute_components(sets, percent):
    ids = sorted(sets)
    root = {i: i for i in ids}
    for i, j in itertools.combinations(ids, 2):
        both = len(sets[i] & sets[j])
        if sets[i] and sets[j] and 100 * both >= percent * len(sets[i] | sets[j]):
            a, b = root[i], root[j]
            for x in ids:
                if root[x] == max(a, b):
                    root[x] = min(a, b)
    return root


def variants(seed, families, copies, size):
    """Families of texts with ever more words changed: links at every degree, in stars and chains."""
    draw = random.Random(seed)
    vocabulary = [f"v{i}" for i in range(3_000)]
    out = []
    for _ in range(families):
        base = draw.choices(vocabulary, k=size)
        for c in range(copies):
            text = list(base)
            for _ in range(draw.randrange(0, max(2, size // 25))):
                text[draw.randrange(size)] = draw.choice(vocabulary)
            out.append(" ".join(text))
            if draw.random() < 0.3:
                base = text
    return out


@pytest.mark.parametrize("k, percent", [(3, 85), (5, 80)])
def test_near_duplicates_are_exact(spark, k, percent):
    texts = dict(enumerate(variants(3, 12, 18, 120) + ["a b c", "A  B\tc", "a b", "a"]))
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    want = brute_components({i: shingles(t, k) for i, t in texts.items()}, percent)
    rows = neardup.near_duplicates(docs, k, percent).collect()
    assert {r.doc_id: r.component_id for r in rows} == want
    assert all(r.n_shingles == len(shingles(texts[r.doc_id], k)) for r in rows)


def test_crowded_regions_and_large_clusters(spark, monkeypatch):
    """The ways for regions and clusters beyond the limits of one task give the same components."""
    texts = dict(enumerate(variants(5, 3, 40, 100)))
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    want = brute_components({i: shingles(t, 3) for i, t in texts.items()}, 85)
    monkeypatch.setattr(neardup, "REGION", 16)
    monkeypatch.setattr(neardup, "CLUSTER", 10)
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(docs, 3, 85).collect()}
    wrong = sum(got[i] != want[i] for i in want)
    assert wrong <= 2  # depth costs a little recall in crowded regions only


@pytest.mark.parametrize("block", [10_000, 20])
def test_crowded_regions_are_exact(spark, monkeypatch, block):
    """Texts from one template that are not linked crowd every region; true pairs among them are all found."""
    draw = random.Random(8)
    template = [f"t{i}" for i in range(110)]
    texts = {}
    for i in range(120):
        # Two changed words a text: 6 of 108 shingles, so two texts have a Jaccard of about 0.8.
        own = list(template)
        for at in draw.sample(range(5, 105), 2):
            own[at] = f"own{i}-{at}"
        texts[2 * i] = " ".join(own)
        if i % 3 == 0:
            at = draw.choice([x for x in range(8, 100) if own[x] == template[x]])
            own[at] = f"late{i}"
            own[at + 1 if own[at + 1] == template[at + 1] else at - 1] = f"later{i}"
            texts[2 * i + 1] = " ".join(own)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    want = brute_components({i: shingles(t, 3) for i, t in texts.items()}, 85)
    monkeypatch.setattr(neardup, "REGION", 8)
    monkeypatch.setattr(neardup, "CLUSTER", 10)
    monkeypatch.setattr(neardup, "BLOCK", block)
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(docs, 3, 85).collect()}
    assert 20 < len(set(want.values())) < len(texts) - 20
    assert sum(got[i] != want[i] for i in want) == 0


def test_components(spark):
    draw = random.Random(1)
    edges = [(draw.randrange(60), draw.randrange(60)) for _ in range(35)] + [(i, i + 1) for i in range(100, 140)]
    want = brute_components({i: set() for i in range(1)}, 1)
    root = {x: x for e in edges for x in e}
    for _ in range(200):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert want and got == {x: r for x, r in root.items() if any(a != b and x in (a, b) for a, b in edges)}


def test_repeated_paragraphs(spark):
    draw = random.Random(2)
    fresh = lambda n: " ".join(f"u{draw.randrange(10**6)}" for _ in range(n))
    passage = fresh(55)
    near = passage.split()
    near[2] = "changed"
    texts = {
        1: "\n".join([fresh(40), passage, fresh(60)]), 2: "\n".join([passage.upper(), fresh(45)]), 3: " ".join(near),
        4: "\n".join([fresh(50), fresh(50)]), 8: "\n".join([fresh(35), block := "\n".join([fresh(20), fresh(20), fresh(15)]), fresh(40)]),
        9: "\n".join([fresh(70), block]), 5: "\n".join([own := fresh(40), own]), 6: "\n".join(["short and shared by all"] * 3),
        7: "short and shared by all",
    }
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    rows = {(r.doc_id, r.paragraph, r.component_doc, r.component_paragraph, r.removed) for r in paragraphs.repeated_paragraphs(docs).collect()}
    assert rows == {
        (1, 1, 1, 1, False), (2, 0, 1, 1, True), (3, 0, 1, 1, True), (8, 1, 8, 1, False), (9, 1, 8, 1, True),
        (8, 2, 8, 2, False), (9, 2, 8, 2, True),
    }
    cleaned = {r.doc_id: r.text for r in paragraphs.remove(docs).collect()}
    assert cleaned[9] == texts[9].split("\n")[0] and cleaned[8] == texts[8]
    assert cleaned[2] == texts[2].split("\n")[1] and cleaned[3] == "" and all(cleaned[i] == texts[i] for i in (1, 4, 5, 6, 7))


def test_pieces_inside_longer_texts(spark):
    draw = random.Random(12)
    fresh = lambda n: [f"m{draw.randrange(10**6)}" for _ in range(n)]
    texts, holders = {}, collections.defaultdict(list)
    for p in range(30):
        passage = fresh(draw.randrange(51, 90))
        for c in range(draw.randrange(2, 5)):
            doc = len(texts)
            w = fresh(draw.randrange(20, 200)) + passage + fresh(draw.randrange(20, 200))
            for _ in range(3):
                w.insert(draw.choice([0, len(w)]), "\n")
            texts[doc] = " ".join(w) if c else "\n".join([" ".join(fresh(60)), " ".join(passage)])
            holders[p].append(doc)
    clean = {len(texts) + i: " ".join(fresh(300)) for i in range(20)}
    docs = spark.createDataFrame(list({**texts, **clean}.items()), "doc_id long, text string")
    rows = paragraphs.repeated_pieces(docs).collect()
    found = collections.defaultdict(set)
    for r in rows:
        found[r.component_doc].add(r.doc_id)
        assert not r.removed == (r.doc_id == r.component_doc) and r.doc_id in texts
    assert sum(found.get(ds[0]) == set(ds) for ds in holders.values()) >= 28
    cut = {r.doc_id: r.text for r in paragraphs.remove_pieces(docs).collect()}
    gone = [r for r in rows if r.removed]
    for r in gone:
        assert len(words(cut[r.doc_id])) == len(words(texts[r.doc_id])) - sum(x.n_words for x in gone if x.doc_id == r.doc_id)
    assert all(cut[d] == t for d, t in clean.items())


def test_pieces_where_one_holder_has_copies(spark):
    """A passage is found though one holder shares more around it, and where two passages touch."""
    draw = random.Random(21)
    fresh = lambda n: [f"h{draw.randrange(10**6)}" for _ in range(n)]
    texts, want = {}, []
    for _ in range(6):
        passage, first, second = fresh(90), fresh(90), fresh(90)
        whole = fresh(150) + passage + fresh(150)
        near = whole[:60] + fresh(1) + whole[61:]
        d = len(texts)
        texts |= {d: whole, d + 1: list(whole), d + 2: near, d + 3: fresh(80) + passage + fresh(80)}
        texts |= {d + 4: fresh(70) + first + second + fresh(70), d + 5: fresh(40) + first + fresh(90), d + 6: fresh(90) + second + fresh(40)}
        want += [(d, d + 3, passage), (d + 4, d + 5, first), (d + 4, d + 6, second)]
    docs = spark.createDataFrame([(d, " ".join(w)) for d, w in texts.items()], "doc_id long, text string")
    rows = paragraphs.repeated_pieces(docs).collect()
    for first_holder, holder, passage in want:
        own = {" ".join(texts[holder][r.first_word : r.first_word + r.n_words]) for r in rows if r.doc_id == holder and r.removed}
        assert own and all(x in " ".join(passage) for x in own)
        assert sum(len(x.split()) for x in own) >= 60
        assert {r.component_doc for r in rows if r.doc_id == holder} == {first_holder}
    kept = " ".join(r.text for r in paragraphs.remove_pieces(docs).collect()).split()
    assert set(kept) == {w for words_ in texts.values() for w in words_}


def test_paragraphs_against_brute_force(spark):
    texts = texts_of(spark, "/root/testdata/sf0.001")
    sets = {}
    for d, t in texts.items():
        held = (t or "").split("\n")
        for i in range(len(held)):
            run = list(itertools.takewhile(lambda x: len(words(x)) < paragraphs.MIN_WORDS, held[i:])) if words(held[i]) else []
            sizes = list(itertools.accumulate(len(words(x)) for x in run))
            enough = next((n for n, size in enumerate(sizes, 1) if size >= paragraphs.MIN_WORDS), None)
            if len(words(held[i])) >= paragraphs.MIN_WORDS:
                sets[d, i] = shingles(held[i], 5)
            elif enough:
                sets[d, i] = shingles("\n".join(held[i : i + enough]), 5)
    root = brute_components(sets, 80)
    docs_of = collections.defaultdict(set)
    for node, r in root.items():
        docs_of[r].add(node[0])
    want = {(*n, *r, n != r) for n, r in root.items() if len(docs_of[r]) > 1}
    rows = paragraphs.query(spark, "/root/testdata/sf0.001").where("paragraph IS NOT NULL").collect()
    assert {(r.doc_id, r.paragraph, r.component_doc, r.component_paragraph, r.removed) for r in rows} == want


def brute_leaks(texts, items):
    split = re.compile(r"[a-z0-9\u0080-\U0010ffff]+")
    count = lambda w: collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    out = {}
    for (d, t), (i, x) in itertools.product(texts.items(), items.items()):
        w, v = split.findall((t or "").translate(LOWER)), split.findall((x or "").translate(LOWER))
        own = count(v)
        for a in range(-3, len(w)):
            q = count(w[max(0, a) : max(0, a + len(v))])
            less = sum((own & q).values())
            if less and less / sum((own | q).values()) >= decontaminate.THRESHOLD:
                out[d, i] = max(out.get((d, i), 0), less / sum((own | q).values()))
    return out


def test_leaks(spark):
    draw = random.Random(4)
    fresh = lambda n: [f"q{draw.randrange(400)}" for _ in range(n)]
    items = {i: " ".join(fresh(n)) for i, n in enumerate((5, 7, 9, 15, 24, 40, 58, 90, 130, 300))}
    texts = {}
    for number, (i, item) in enumerate(itertools.product(items, range(6))):
        w = items[i].split()
        for _ in range(item):
            place = draw.choice([0, 1, len(w) - 1, draw.randrange(len(w))])
            w[place] = draw.choice([w[place] + "!", w[place].upper(), "changed"])
        texts[number] = " ".join(fresh(draw.randrange(0, 80)) + w + fresh(draw.randrange(0, 80)))
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    bench = spark.createDataFrame(list(items.items()), "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.similarity for r in decontaminate.leaks(docs, bench).collect()}
    want = brute_leaks(texts, items)
    assert set(got) == set(want) and len(want) > 25
    assert all(abs(got[p] - want[p]) < 1e-5 for p in want)


def test_hamming_blocks_find_all():
    draw = np.random.default_rng(3)
    index = decontaminate.Index(list(range(40)), [" ".join(map(str, draw.integers(0, 500, 30))) for _ in range(40)])
    size = index.sizes[0]
    own, _, _ = index.tables[size]
    prints = own[draw.integers(0, len(own), 3_000)].copy()
    for i in range(len(prints)):
        for bit in draw.integers(0, 64, draw.integers(0, 6)).tolist():
            prints[i] ^= np.uint64(1 << bit)
    want = {(i, j) for i in range(len(prints)) for j in np.flatnonzero(np.bitwise_count(own ^ prints[i]) <= decontaminate.RADIUS).tolist()}
    assert set(zip(*(x.tolist() for x in index.near(size, prints)))) == want


def test_quality_held_out(spark):
    rows = quality.query(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id").where("held_out").collect()
    assert np.mean([r.predicted == r.quality for r in rows]) > 0.95
    good, bad = [r.score for r in rows if r.quality], [r.score for r in rows if not r.quality]
    assert np.mean([a > b for a in good for b in bad]) > 0.98


def test_packing_round_trip(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    packed = packing.pack_documents(docs, length=700, shard_chars=100_000).cache()
    encoder = tokens.Encoder.read()
    pieces = collections.defaultdict(list)
    for r in packing.unpack(packed).orderBy("doc_id", "piece").collect():
        pieces[r.doc_id].append(np.frombuffer(r.ids, "<u2"))
    for doc_id, text in texts_of(spark).items():
        assert np.concatenate(pieces[doc_id]).tolist() == encoder.ids(text).tolist() + [tokens.END_OF_TEXT]
    for r in packed.collect():
        assert r.cu_seqlens[-1] == r.n_tokens <= 700 and r.position_resets == r.cu_seqlens[:-1] and len(r.ids) == 1400


def test_best_fit_decreasing():
    draw = random.Random(6)
    sizes = [draw.randrange(0, 150) for _ in range(400)]
    room = []
    for n in sorted((s % 100 for s in sizes if s % 100), reverse=True):
        fits = [r for r in room if r >= n]
        if fits:
            room.remove(min(fits))
            room.append(min(fits) - n)
        else:
            room.append(100 - n)
    rows = packing.pack(sizes, 100)
    left = sorted(100 - sum(min(100, sizes[i] - 100 * p) for i, p in row) for row in rows[sum(s // 100 for s in sizes) :])
    assert left == sorted(room)


def test_token_attribution():
    encoder = tokens.Encoder.read()
    draw = random.Random(7)
    for text in ("Zwei Wörter — naïve 日本語 tests\n\nand more", "a b c", "🙂🙂 ok", ""):
        ids = encoder.ids(text)
        start, end = encoder.spans(text, ids)
        for _ in range(20):
            cuts = sorted(draw.choices(range(len(text) + 1), k=4))
            sections = [("x", cuts[0], cuts[1]), ("y", cuts[1], cuts[2]), ("z", cuts[2] + draw.randrange(2), cuts[3])]
            rows = tokens.attribute(start, end, sections, len(text))
            low, held = 0, []
            for _, a, b in sections:
                a = min(max(a, low), len(text))
                b = max(a, min(b, len(text)))
                low = b
                held.append((a, b))
            by_start, by_major, share = collections.Counter(), collections.Counter(), collections.Counter()
            for s, e in zip(start.tolist(), end.tolist()):
                common = [max(0, min(b, e) - max(a, s)) for a, b in held]
                if not sum(common):
                    by_start[-1] += 1; by_major[-1] += 1; share[-1] += 1  # noqa: E702
                    continue
                by_start[next(i for i, c in enumerate(common) if c)] += 1
                by_major[common.index(max(common))] += 1
                for i, c in enumerate(common):
                    share[i] += c / sum(common)
            for section, _, _, _, a, b, c, _ in rows:
                assert (a, b) == (by_start[section], by_major[section]) and abs(c - share[section]) < 1e-9
            assert sum(r[4] for r in rows) == len(ids)


def test_token_sections_of_fields(spark):
    docs = spark.createDataFrame([(1, "A title", "Some text here"), (2, None, "Only text")], "doc_id long, title string, body string")
    text, sections = tokens.field_sections("title", "body")
    rows = tokens.count_tokens(docs.select("doc_id", text.alias("text"), sections.alias("parts")), sections="parts").collect()
    assert {(r.doc_id, r.name, r.tokens_start) for r in rows} >= {(1, "title", 2), (1, "body", 3), (2, "title", 0), (2, "body", 2)}


def test_fingerprints_against_sets(spark):
    texts = texts_of(spark)
    ids = sorted(texts)
    rows = {r.doc_id: r for r in fingerprints.query(spark, SMALL).collect()}

    def jaccard(a, b):
        level = max(fingerprints.level_of(a), fingerprints.level_of(b))
        a, b = (collections.Counter(fingerprints.pieces(t, level)) for t in (a, b))
        return sum((a & b).values()) / max(1, sum((a | b).values())) if a or b else 1.0

    for i, following in zip(ids, ids[1:] + ids[:1]):
        k = len(texts[i]) // 4
        edited = texts[i][: len(texts[i]) - k] + texts[following][:k]
        r = rows[i]
        assert r.n_chars == len(texts[i]) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert abs(r.near_edited - jaccard(texts[i], edited)) < 1e-9 and abs(r.near_next - jaccard(texts[i], texts[following])) < 1e-9


def test_urls_against_brute_force(spark):
    pages = spark.read.parquet(f"{SMALL}/pages.parquet")
    rows = urls.judge(pages).collect()
    assert len(rows) == pages.count()
    by_url = {r.page_id: r.url for r in pages.collect()}
    for r in rows:
        rest = by_url[r.page_id].split("://", 1)[1]
        host = re.split(r"[/?#]", rest)[0].translate(LOWER)
        path = re.split(r"[?#]", rest[len(host) :])[0]
        fits = [(h + p, v) for h, p, v in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        rule = max(fits, key=lambda x: len(x[0]), default=(None, None))
        assert (r.host, r.path, r.rule) == (host, path, rule[0])
        assert r.verdict == (rule[1] or ("block" if (r.block_odds or 0) > 0 else "allow"))
        assert "".join(r.words or []) == "".join(re.findall("[a-z]+", host + path.translate(LOWER)))


def test_long_names_are_split_whole(spark):
    """Seed words of names longer than LONGEST_NAME are found wherever they stand."""
    listed = [("casino", 900), ("garden", 500), ("tool", 400)]
    vocab = spark.createDataFrame(listed, "word string, count long")
    want = {}
    for n in range(30, 75, 3):
        split = ["garden"] * (n // 6) + ["tool"] * (n % 6) + ["casino"] + ["tool"] * 20
        want["".join(split)] = split
    urls_of = spark.createDataFrame([(f"http://{x}.org/",) for x in want], "url string")
    names = urls_of.select(F.explode(urls.names_of(urls.host_of(F.col("url")), urls.path_of(F.col("url")))).alias("name")).distinct()
    got = {r.name: r.words for r in urls.segment(names, vocab).collect()}
    assert all(got.get(x) == split for x, split in want.items())


def test_viterbi_is_optimal():
    counts, total = {"free": 50, "bets": 40, "be": 30, "ts": 20, "fr": 3, "ee": 2, "freebet": 1}, 1_000

    def cost(w):
        return np.log(total / counts[w]) if w in counts else urls.UNKNOWN + 3.0 * len(w) + np.log(total)

    for name in ("freebets", "tsbe", "xfree", "beeets", ""):
        splits = [[name[a:b] for a, b in zip((0, *c), (*c, len(name)))] for r in range(len(name)) for c in itertools.combinations(range(1, len(name)), r)]
        best = min((sum(map(cost, s)) for s in splits), default=0)
        assert abs(sum(map(cost, urls.viterbi(name, counts, total))) - best) < 1e-9
    assert urls.viterbi("freebets", counts, total) == ["free", "bets"]


def test_words_and_shingles():
    texts = ["A b\x0bC  d", "", "é É ß a\tb", "x" * 9_000 + " y", "one two"]
    held = hashing.Words([t.encode() for t in texts])
    assert np.diff(held.first).tolist() == [len(words(t)) for t in texts]
    seen = {}
    for h, w in zip(held.hash.tolist(), itertools.chain.from_iterable(map(words, texts))):
        assert seen.setdefault(w, h) == h
    assert len(set(seen.values())) == len(seen)
    _, offset = held.shingles(3)
    assert np.diff(offset).tolist() == [2, 0, 3, 1, 1]


def test_pipeline(spark):
    """Each stage's result, on its own input, against a plain version."""
    import corpus_pipeline

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    kept = stages["quality classifier"](spark, docs, SMALL).cache()
    weights = quality.fit(docs, spark.read.parquet(f"{SMALL}/labels.parquet"))
    texts = texts_of(spark)
    scores = dict(zip(texts, quality.score_texts(list(texts.values()), weights)))
    assert {r.doc_id for r in kept.collect()} == {i for i, s in scores.items() if s >= quality.THRESHOLD}
    single = stages["near duplicates"](spark, kept, SMALL).cache()
    own = {r.doc_id: shingles(r.text, 5) for r in kept.collect()}
    assert {r.doc_id for r in single.collect()} == {i for i, r in brute_components(own, 80).items() if i == r}
    clean = stages["benchmark decontamination"](spark, single, SMALL).cache()
    bench = {r.item_id: r.text for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()}
    leaked = {d for d, _ in brute_leaks({r.doc_id: r.text for r in single.collect()}, bench)}
    assert {r.doc_id for r in clean.collect()} == {r.doc_id for r in single.collect()} - leaked
    assert corpus_pipeline.run(spark, SMALL).agg(F.sum("n_tokens")).first()[0] > 0


def test_regions_with_the_same_members_are_read_once(spark):
    near = spark.createDataFrame(
        [(1, 10), (1, 11), (2, 10), (2, 11), (3, 10), (3, 11), (3, 12), (4, 12), (4, 13)], "key long, node long"
    )
    left = sorted((r["key"], r["node"]) for r in neardup.distinct_regions(near).collect())
    assert left == [(1, 10), (1, 11), (3, 10), (3, 11), (3, 12), (4, 12), (4, 13)]
    assert neardup.distinct_regions(near.where("key > 9")).count() == 0
