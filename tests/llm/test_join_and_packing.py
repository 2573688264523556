"""N-gram Jaccard join and best-fit packing against brute force; odd inputs."""

import bisect
import random

import numpy as np
import pytest

from docsail.llm import jaccard, packing, skew
from docsail.session import table

SCHEMA = "doc_id bigint, text string, node string, gone_id string, again_id string, shard int, level string, rank int"
ODD = [
    (1, None, *["x"] * 3, 1, "l", 2),
    (2, "", *["x"] * 3, 1, "l", 2),
    (3, " \n ", *["x"] * 3, 1, "l", 2),
    (None, "one two three four", *["x"] * 3, 1, "l", 2),
    (4, "one two three four", *["x"] * 3, 1, "l", 2),
    (5, "One  two three FOUR", *[None] * 3, None, None, None),
    (6, "solo", *["x"] * 3, 1, "l", 2),
    (6, "solo", *["x"] * 3, 1, "l", 2),
    (7, "long text here " * 40_000, *["x"] * 3, 1, "l", 2),
]


def gram_set(text, n=jaccard.GRAM):
    w = text.lower().split()
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def brute(rows, threshold):
    sets = [(i, gram_set(t)) for i, t in rows if t]
    sets = [(i, s) for i, s in sets if s]
    out = {}
    for x in range(len(sets)):
        for y in range(x + 1, len(sets)):
            (a, s), (b, t) = sets[x], sets[y]
            if min(len(s), len(t)) >= threshold * max(len(s), len(t)):
                j = len(s & t) / len(s | t)
                if j >= threshold:
                    out[min(a, b), max(a, b)] = j
    return out


def families(seed=3, words=120):
    """Groups of texts at many distances from their first, exact copies among them, and unrelated ones."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(4000)]
    rows = []
    for _ in range(40):
        base = rng.choices(vocabulary, k=words)
        for changes in (0, 0, 1, 3, 6, 9, 12):
            copy = list(base)
            for at in rng.sample(range(words), changes):
                copy[at] = rng.choice(vocabulary)
            rows.append(" ".join(copy))
    return list(enumerate(rows))


def classes_of(rows, links):
    """(class_id, n_links, best) of every document, by brute force over the links of all pairs."""
    root, count, best = {i: i for i, _ in rows}, dict.fromkeys((i for i, _ in rows), 0), {}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for (a, b), j in links.items():
        for x in (a, b):
            count[x] += 1
            best[x] = max(best.get(x, 0), j)
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: (find(i), count[i], best.get(i)) for i, _ in rows}


def found_links(join, rows):
    """The operator's links of representatives, spread over their copies, beside those within classes of equal sets."""
    pairs = {(r.doc_a, r.doc_b): r.jaccard for r in join.pairs().collect()}
    by = {}
    for i, t in rows:
        if t and (s := gram_set(t)):
            by.setdefault(frozenset(s), []).append(i)
    rep = {i: min(ids) for ids in by.values() for i in ids}
    out = {}
    for a in rep:
        for b in rep:
            if a < b and (rep[a] == rep[b] or (min(rep[a], rep[b]), max(rep[a], rep[b])) in pairs):
                out[a, b] = 1.0 if rep[a] == rep[b] else pairs[min(rep[a], rep[b]), max(rep[a], rep[b])]
    return out


def check_join(spark, rows, docs):
    want = brute(rows, jaccard.THRESHOLD)
    join = jaccard.JaccardJoin(spark, docs)
    links = found_links(join, rows)
    assert all(k in want and abs(v - want[k]) < 1e-9 for k, v in links.items())
    assert len(links) >= 0.95 * len(want)
    got = {r.doc_id: (r.class_id, r.n_links, r.jaccard) for r in join.classes().collect()}
    expected = classes_of(rows, links)
    assert set(got) == set(expected)
    for i, (root, n, best) in expected.items():
        assert got[i][:2] == (root, n) and (got[i][2] is None if best is None else abs(got[i][2] - best) < 1e-9)
    return want


def test_jaccard_recall_and_exactness(spark):
    rows = families()
    assert len(check_join(spark, rows, spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5))) > 300


def test_jaccard_on_documents(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    check_join(spark, [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()], docs)


def test_jaccard_large_group_in_parts_and_skewed(spark, monkeypatch):
    """Blocks in many cells, every key hot, no membership filter: the same links as ever."""
    rows = families(seed=5)[:140]
    rows += [(1000 + i, rows[0][1]) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    monkeypatch.setattr(jaccard, "BLOCK", 7)
    monkeypatch.setattr(jaccard, "_FILTER_BITS", 1)
    monkeypatch.setattr(skew, "_LEAST", 2)
    monkeypatch.setattr(skew, "_HOT_KEYS", 1 << 40)
    check_join(spark, rows, docs)


def test_keep_one_matches_components(spark):
    rows = families(seed=9)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    first = {r.doc_id for r in jaccard.JaccardJoin(spark, docs).classes().where("first").collect()}
    assert {r.doc_id for r in jaccard.keep_one(spark, docs).collect()} == first


def test_components_of_a_long_chain(spark):
    """Every text shares most of its words with the next only; one class all the same."""
    words = [f"w{i}" for i in range(2000)]
    rows = [(i, " ".join(words[i * 4 : i * 4 + 60])) for i in range(90)]
    got = jaccard.near_duplicates(spark, spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert {r.class_id for r in got} == {0} and all(r.n_links >= 1 for r in got)


def test_jaccard_odd_rows(spark):
    docs = spark.createDataFrame(ODD, SCHEMA)
    got = {r.doc_id: (r.class_id, r.n_links, r.jaccard) for r in jaccard.near_duplicates(spark, docs).collect()}
    assert got == {1: (1, 0, None), 2: (2, 0, None), 3: (3, 0, None), 4: (4, 1, 1.0), 5: (4, 1, 1.0), 6: (6, 0, None), 7: (7, 0, None)}
    kept = jaccard.keep_one(spark, docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 2, 3, 4, 6, 7]
    empty = spark.createDataFrame([], SCHEMA)
    assert jaccard.near_duplicates(spark, empty).count() == 0 and jaccard.keep_one(spark, empty).count() == 0
    alone = spark.createDataFrame([(1, "a b c"), (2, "d e f")], "doc_id bigint, text string")
    assert jaccard.similar_pairs(spark, alone).count() == 0 and jaccard.keep_one(spark, alone).count() == 2


def test_keep_one_loses_no_text(spark):
    """Two texts under one doc_id: each stays unless it is similar to one that does; of equal ones the least text stays."""
    rows = [(1, "a b c d"), (1, "e f g h"), (1, "A B c d"), (2, "e f g h"), (3, "i j k l"), (3, "i j k l"), (4, None), (4, None), (4, "")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "1 as node", "2 as d", "3 as many")
    kept = jaccard.keep_one(spark, docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id, r.text or "-") for r in kept.collect()) == [(1, "A B c d"), (1, "e f g h"), (3, "i j k l"), (4, "-"), (4, "-"), (4, "-")]


def check_packing(rows, lengths, capacity):
    by_bin, by_doc = {}, {}
    for r in rows:
        by_bin.setdefault(r.bin, []).append((r.start, r.n_tokens))
        by_doc.setdefault(r.doc_id, []).append((r.doc_start, r.n_tokens))
    for spans in by_bin.values():
        at = 0
        for start, n in sorted(spans):
            assert start == at and n > 0
            at += n
        assert at <= capacity
    got = sorted(sum(n for _, n in spans) for spans in by_doc.values())
    assert got == sorted(n for n in lengths if n)
    return sum(lengths) / (len(by_bin) * capacity) if by_bin else 1.0


def test_packing_places_every_token(spark):
    rng = np.random.default_rng(0)
    lengths = [int(x) for x in np.minimum(rng.lognormal(5.5, 1.2, 3000), 9000)]
    docs = spark.createDataFrame([(i, n) for i, n in enumerate(lengths)], "doc_id bigint, n bigint").repartition(4)
    packed = packing.pack(spark, docs, docs.n)
    used = check_packing(packed.collect(), lengths, packing.CAPACITY)
    assert used > 0.9 and used == pytest.approx(packing.efficiency(packed))


def best_fit_bins(lengths, capacity):
    space = []
    for n in sorted(lengths, reverse=True):
        at = bisect.bisect_left(space, n)
        bisect.insort(space, (space.pop(at) if at < len(space) else capacity) - n)
    return len(space)


MIXES = {
    "1 to 30": lambda rng: rng.integers(1, 31, 20_000),
    "all 17": lambda rng: np.full(20_000, 17),
    "all 1000": lambda rng: np.full(3000, 1000),
    "uniform": lambda rng: rng.integers(1, 2049, 3000),
    "half and rest": lambda rng: np.r_[np.full(800, 1024), rng.integers(1, 2049, 1500)],
    "short and long": lambda rng: np.r_[rng.integers(1, 31, 20_000), rng.integers(1500, 2048, 1200)],
    "skewed": lambda rng: np.minimum(rng.lognormal(5.5, 1.2, 3000), 2047).astype(int) + 1,
}


@pytest.mark.parametrize("mix", MIXES)
def test_packing_needs_no_more_bins_than_best_fit(mix):
    lengths = MIXES[mix](np.random.default_rng(4))
    made = packing.plan(np.bincount(lengths, minlength=packing.CAPACITY + 1))
    assert made.bins <= best_fit_bins([int(x) for x in lengths], packing.CAPACITY)
    used, placed = np.zeros(made.bins, int), np.zeros(packing.CAPACITY + 1, int)
    for length, lo, hi, first, many, _, start in made.intervals:
        assert placed[length] == lo and (hi - lo) % many == 0
        bins = slice(first, first + (hi - lo) // many)
        assert (used[bins] == start).all()
        used[bins] += many * length
        placed[length] = hi
    assert used.max() <= packing.CAPACITY and (placed == np.bincount(lengths, minlength=packing.CAPACITY + 1)).all()


def test_packed_sequences_hold_every_token(spark, monkeypatch):
    monkeypatch.setattr(packing, "_PER_RANKING", 20)
    rng = random.Random(6)
    rows = [(i if i % 9 else None, [rng.randrange(1000) for _ in range(rng.choice([0, 1, 5, 60, 64, 65, 300]))]) for i in range(200)]
    docs = spark.createDataFrame([*rows, (7, None)], "doc_id bigint, tokens array<int>").repartition(3)
    got = packing.pack_tokens(spark, docs, capacity=64).collect()
    assert len({r.bin for r in got}) == len(got) and all(r.n_tokens == len(r.tokens) <= 64 for r in got)
    parts = {}
    for r in got:
        for i, a, b, at in zip(r.doc_ids, r.starts, [*r.starts[1:], r.n_tokens], r.doc_starts, strict=True):
            parts.setdefault(i, []).append((at, r.tokens[a:b]))
    for i, tokens in rows:
        if i is not None:
            assert sum((t for _, t in sorted(parts.get(i, []))), []) == tokens
    assert sorted(x for _, t in parts[None] for x in t) == sorted(x for i, t in rows if i is None for x in t)


def test_packed_words_are_the_texts(spark):
    docs = spark.createDataFrame(ODD, SCHEMA)
    got = packing.pack_words(spark, docs).collect()
    words = {}
    for r in got:
        assert r.n_tokens == sum(len(t.split()) for t in r.texts) <= packing.CAPACITY
        for i, at, text in zip(r.doc_ids, r.doc_starts, r.texts, strict=True):
            words.setdefault(i, []).append((at, text.split()))
    assert sum((w for _, w in sorted(words[7])), []) == "long text here".split() * 40_000
    assert words[4] == [(0, "one two three four".split())] and words[6] == [(0, ["solo"])] * 2 and words[None] == words[4] and len(words) == 5
    assert packing.pack_words(spark, spark.createDataFrame([], SCHEMA)).count() == 0 and packing.pack_words(spark, docs.where("doc_id < 4")).count() == 0


def test_packing_many_shards(spark, monkeypatch):
    monkeypatch.setattr(packing, "_PER_RANKING", 50)
    lengths = [1 + i % 5000 for i in range(0, 30_000, 17)]
    docs = spark.createDataFrame(list(enumerate(lengths)), "doc_id bigint, n bigint")
    check_packing(packing.pack(spark, docs, docs.n).collect(), lengths, packing.CAPACITY)


def test_packing_odd_rows(spark):
    docs = spark.createDataFrame(ODD, SCHEMA)
    rows = packing.pack(spark, docs).collect()
    assert sum(r.n_tokens for r in rows) == 4 * 3 + 1 * 2 + 3 * 40_000
    assert max(r.start + r.n_tokens for r in rows) <= packing.CAPACITY
    assert packing.pack(spark, spark.createDataFrame([], SCHEMA)).count() == 0
    assert packing.pack(spark, docs.where("doc_id < 4")).count() == 0


def test_nnls_against_projected_gradient():
    rng = np.random.default_rng(1)
    a, b = rng.random((20, 12)), rng.random(20)
    x = packing.nnls(a, b)
    y, step = np.zeros(12), 1 / np.linalg.norm(a.T @ a, 2)
    for _ in range(200_000):
        y = np.maximum(0, y - step * (a.T @ (a @ y - b)))
    assert (x >= 0).all() and np.linalg.norm(a @ x - b) <= np.linalg.norm(a @ y - b) + 1e-6
