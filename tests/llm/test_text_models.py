"""Language identification, quality classifier, language-model scoring: accuracy, brute force, odd inputs."""

import math
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from docsail.llm import langid, lm, quality
from docsail.session import table

SCHEMA = "doc_id bigint, text string, lang string, keep string, found string, quality_prob string"
ODD = [
    (1, None, "en", "x", "y", "z"),
    (2, "", "en", "x", "y", "z"),
    (None, "the the the", None, None, None, None),
    (3, "word " * 60_000, "en", "x", "y", "z"),
    (4, "the and of", "en", "x", "y", "z"),
    (4, "the and of", "en", "x", "y", "z"),
    (5, " é😀", "fr", "x", "y", "z"),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_langid_held_out(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    model = langid.fit(docs.where("doc_id % 2 = 0"))
    assert model.sparsity() > 0.5 and model.temperature > 0
    found = langid.identify_documents(docs.where("doc_id % 2 = 1"), model).join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    assert (found.lang == found.lang_pred).mean() > 0.97
    assert found.keep.mean() > 0.98


def test_langid_document_frequencies_brute_force(spark):
    texts = ["abc", "ABC", "", None, "ab", "zz top"]
    df, n = langid.document_frequencies(spark.createDataFrame([(t,) for t in texts], "text string"))
    assert n == 4
    want = Counter()
    for t in texts:
        if t:
            points = np.frombuffer(t.lower().encode("utf-32-le"), np.uint32)
            want.update({int(x) for g in langid.gram_buckets(points) for x in g})
    assert {i: int(v) for i, v in enumerate(df) if v} == dict(want)


def test_langid_odd_rows(spark, odd, empty):
    rows = langid.identify_documents(odd, langid.fit(odd)).collect()
    assert len(rows) == len(ODD)
    by = {r.doc_id: r for r in rows}
    assert by[1].lang_pred is None and by[2].lang_pred is None and not by[1].keep and by[3].lang_pred is not None
    assert langid.keep_identified(odd, langid.fit(odd)).columns == odd.columns
    assert langid.identify_documents(odd, langid.fit(empty)).where("keep").count() == 0
    assert langid.identify_documents(empty, langid.fit(odd)).count() == 0


def test_calibration_lowers_loss():
    rng = np.random.default_rng(0)
    y = rng.integers(0, 3, 400)
    logits = rng.normal(0, 6, (400, 3))
    logits[np.arange(400), y] += 4
    t = langid.calibrate(logits, y)

    def loss(temperature):
        return -np.log(langid.softmax(logits / temperature)[np.arange(400), y]).mean()

    assert loss(t) <= min(loss(1.0), loss(t * 1.2), loss(t / 1.2)) + 1e-9


def slow_vector(model, raw):
    """What quality.pooled should give, one window at a time."""
    t = model.tables()
    tops = []
    _, starts, ends = quality.chunk_spans(np.array([len(raw)]))
    padded = raw + b"\0" * quality.WIDTH
    for a, b in zip(starts, ends, strict=True):
        responses = [sum(t[j][padded[i + j]] for j in range(quality.WIDTH)) for i in range(a, b)]
        tops.append(np.maximum(np.max(responses, axis=0) + model.bias, 0))
    return np.r_[np.mean(tops, axis=0), np.max(tops, axis=0)]


def test_quality_brute_force(monkeypatch):
    rng = np.random.default_rng(1)
    model = quality.ByteCNN(rng.normal(0, 1, (256, 4)), rng.normal(0, 1, (quality.WIDTH, 4, 5)), rng.normal(0, 1, 5).astype(np.float32), rng.normal(0, 1, 10), 0.1)
    texts = ["a", "hello world", "x" * 700, "é" * 900, "".join(map(chr, rng.integers(32, 120, 3000)))]
    want = [1 / (1 + math.exp(-(slow_vector(model, t.encode()) @ model.head + 0.1))) for t in texts]
    for part in (1 << 16, 100):
        monkeypatch.setattr(quality, "PART", part)
        assert np.allclose(quality.predict(model, pa.array(texts)).to_pylist(), want, atol=1e-4)


def test_quality_gradient():
    rng = np.random.default_rng(2)
    p = {"embed": rng.normal(0, 0.5, (256, 3)), "filters": rng.normal(0, 0.5, (quality.WIDTH, 3, 4)), "bias": rng.normal(0, 0.1, 4), "head": rng.normal(0, 1, 8), "offset": np.zeros(1)}
    texts, y, w = [b"good text here", b"b@d" * 300], np.array([1.0, 0.0]), np.ones(2)

    def loss():
        model = quality.ByteCNN(p["embed"], p["filters"], p["bias"], p["head"], float(p["offset"][0]))
        prob = np.array([1 / (1 + np.exp(-(slow_vector(model, t) @ p["head"] + p["offset"][0]))) for t in texts])
        return float(-(y * np.log(prob) + (1 - y) * np.log(1 - prob)).mean() + 0.5e-4 * (p["head"] ** 2).sum())

    grad = quality._gradient(p, texts, y, w)
    for name in ("head", "bias", "filters", "embed", "offset"):
        at = np.unravel_index(np.abs(grad[name]).argmax(), grad[name].shape)
        keep = p[name][at]
        p[name][at] = keep + 1e-3
        up = loss()
        p[name][at] = keep - 1e-3
        down = loss()
        p[name][at] = keep
        assert abs((up - down) / 2e-3 - grad[name][at]) < 0.02 * max(0.05, abs(grad[name][at]))


def test_quality_held_out(spark):
    docs, labels = (table(spark, "/root/testdata/sf0.01", t) for t in ("documents", "labels"))
    model = quality.fit(docs, labels.where("doc_id % 3 > 0"))
    got = quality.score_documents(docs, model).join(labels.where("doc_id % 3 = 0"), "doc_id").toPandas()
    assert ((got.quality == 1) == got.keep).mean() > 0.93
    assert got[got.quality == 1].keep.mean() > 0.97


def test_quality_odd_rows(spark, odd, empty):
    labels = spark.createDataFrame([(3, 1), (4, 0), (4, 0), (None, 1), (5, None), (2, 0)], "doc_id bigint, quality int")
    model = quality.fit(odd, labels, epochs=1)
    rows = quality.score_documents(odd, model).collect()
    assert len(rows) == len(ODD)
    by = {r.doc_id: r for r in rows}
    assert by[1].quality_prob is None and not by[1].keep and by[2].quality_prob == 0
    assert quality.keep_good(odd, model).columns == odd.columns
    assert quality.score_documents(empty, quality.fit(empty, labels)).count() == 0
    one = quality.fit(odd, labels.where("quality = 1"))
    assert all(r.keep for r in quality.score_documents(odd.where("text <> ''"), one).collect())


def slow_model(texts, order):
    """Word n-grams interpolated with a Dirichlet prior, straight from the definition."""
    start, end = object(), object()
    counts, vocabulary, tokens = defaultdict(Counter), set(), 0

    def padded(t):
        return [start] * (order - 1) + t.split() + [end]

    for t in texts:
        s = padded(t)
        for i in range(order - 1, len(s)):
            vocabulary.add(s[i])
            tokens += 1
            for k in range(order):
                counts[tuple(s[i - k : i])][s[i]] += 1

    def p(context, symbol):
        low = p(context[1:], symbol) if context else 1 / (len(vocabulary) + 1)
        seen = counts.get(tuple(context), Counter())
        return (seen[symbol] + lm.PRIOR * low) / (sum(seen.values()) + lm.PRIOR)

    def score(t):
        s = padded(t)
        return sum(math.log(p(s[i - order + 1 : i], s[i])) for i in range(order - 1, len(s)))

    return score


TALES = ["a b r a c a d", "a b r a", "", "c a d a b r a  c a\nd a b", "x " * 50, "a b r a", "d d", " \n "]


@pytest.mark.parametrize("order", [1, 2, 3, 5])
def test_lm_brute_force(spark, order):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(TALES)] + [(99, None)], "doc_id bigint, text string").repartition(3)
    score = slow_model(TALES, order)
    rows = {r.doc_id: r for r in lm.score_documents(spark, docs, order=order).collect()}
    assert rows[99].logprob is None and rows[99].n_symbols is None and len(rows) == len(TALES) + 1
    for i, t in enumerate(TALES):
        n = len(t.split()) + 1
        assert rows[i].n_symbols == n and rows[i].log_likelihood == pytest.approx(score(t), rel=1e-9, abs=1e-9)
        assert rows[i].logprob == pytest.approx(score(t) / n) and rows[i].perplexity == pytest.approx(math.exp(-score(t) / n))


@pytest.mark.parametrize("order", [1, 3, 4])
def test_lm_of_another_corpus_takes_failure_arcs(spark, order, monkeypatch):
    """Unknown words and contexts, documents cut into lanes, many small blocks and shards."""
    monkeypatch.setattr(lm, "LANE", 5)
    monkeypatch.setattr(lm, "BLOCK_BYTES", 40)
    monkeypatch.setattr(lm, "SHARD_BYTES", 64)
    others = ["a b z r a", "q", "", "a b r a c a d a b r a b b b a z z a b r " * 3, "a b r a", "a b r a"]
    corpus = spark.createDataFrame([(t,) for t in TALES], "text string").repartition(2)
    docs = spark.createDataFrame(list(enumerate(others)), "doc_id bigint, text string").repartition(2)
    score = slow_model(TALES, order)
    got = {r.doc_id: r.log_likelihood for r in lm.score_documents(spark, docs, corpus, order).collect()}
    for i, t in enumerate(others):
        assert got[i] == pytest.approx(score(t), rel=1e-9)
    lone = lm.score_documents(spark, docs, corpus.where("text is null"), order).collect()
    assert all(r.log_likelihood == pytest.approx(0.0) for r in lone)  # the one unknown word has all the probability


def test_lm_tells_repeated_documents_apart(spark):
    """Texts of common words: those that occur twice have the higher probabilities."""
    rng = np.random.default_rng(8)
    texts = [" ".join(f"w{i}" for i in np.minimum(rng.zipf(1.3, 200), 3000)) for _ in range(600)]
    rows = list(enumerate(texts)) + [(1000 + i, texts[i]) for i in range(60)]
    found = {r.doc_id: r.logprob for r in lm.score_documents(spark, spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    limit = np.quantile([found[i] for i in range(60, 600)], 0.9)
    assert np.mean([found[i] > limit for i in range(60)]) > 0.9


def test_lm_odd_rows(spark, odd, empty):
    rows = lm.score_documents(spark, odd).collect()
    by = {r.doc_id: r for r in rows}
    assert len(rows) == len(ODD) and by[1].logprob is None and by[2].n_symbols == 1 and by[3].n_symbols == 60_001
    assert by[3].logprob > -0.1 and sorted(r.n_symbols for r in rows if r.doc_id == 4) == [4, 4]
    assert lm.score_documents(spark, empty).count() == 0
    with pytest.raises(ValueError):
        lm.score_documents(spark, odd, order=33)


def test_key_packing():
    rng = np.random.default_rng(3)
    for n in (0, 1, 1000):
        keys = np.sort(rng.integers(0, 1 << 56, n, dtype=np.uint64))
        assert (lm.unpack_keys(lm.pack_keys(keys)) == keys).all()
