"""The pipeline and the registered queries of the text operators, on the smallest tables, against brute force."""

import math
from collections import defaultdict

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
import sentencepiece

import corpus_pipeline
from docsail.llm import fingerprints, jaccard, langid, media, packing, pieces, quality, queries, warc
from docsail.session import BATCH_BYTES, table
from tests.llm.test_join_and_packing import brute, classes_of
from tests.llm.test_records import archived, slow_hash
from tests.llm.test_text_models import slow_model, slow_vector

ODD = [
    (1, None, "en", "s", 0, "x", 1), (2, "", "en", "s", 0, "x", 1), (3, " \n ", "fr", "s", 3, "x", 1), (None, "the word of the day", None, None, None, None, None),
    (4, "the word of the day and more of it", "en", "s", 9, "x", 1), (4, "the word of the day and more of it", "en", "s", 9, "x", 1), (5, "the word of the day and more of it", "en", "s", 9, "x", 1),
    (6, "was ist das und wo " * 20_000, "de", "s", 9, "x", 1), (7, "mot de la fin et du jour", "fr", "s", 9, "x", 1),
]
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, node string, tokens int"


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return [r.asDict() for r in table(spark, sf_dir, "documents").collect()]


def check_sequences(rows, texts):
    """Every text's ids, piece by piece, are in the sequences; nothing else is."""
    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    found = defaultdict(list)
    for r in rows:
        assert len(r.tokens) == r.n_tokens <= packing.CAPACITY
        for i, a, b, at in zip(r.doc_ids, r.starts, [*r.starts[1:], r.n_tokens], r.doc_starts, strict=True):
            found[i].append((at, r.tokens[a:b]))
    wanted = defaultdict(list)
    for i, t in texts:
        if t:
            wanted[i] += sp.encode(t)
    assert set(found) == set(wanted)
    for i in wanted:
        assert sorted(x for _, part in found[i] for x in part) == sorted(wanted[i])
        if len({at for at, _ in found[i]}) == len(found[i]):
            assert sum((part for _, part in sorted(found[i], key=lambda p: p[0])), []) == wanted[i]


def test_pipeline_stage_by_stage(spark, sf_dir, docs):
    frame = table(spark, sf_dir, "documents")
    columns = frame.columns
    model = quality.fit(frame, table(spark, sf_dir, "labels"))
    good = {d["doc_id"] for d in docs if d["text"] and 1 / (1 + math.exp(-(slow_vector(model, d["text"].encode()) @ model.head + model.offset))) >= 0.5} if max(len(d["text"]) for d in docs) < 20_000 else None
    kept = corpus_pipeline.quality_stage(spark, frame, sf_dir)
    assert kept.columns == columns
    if good is None:
        good = {d["doc_id"] for d, p in zip(docs, quality.predict(model, pa.array([d["text"] for d in docs])).to_pylist(), strict=True) if p >= 0.5}
    assert {r.doc_id for r in kept.collect()} == good and 0 < len(good) < len(docs)
    some = frame.where(frame.doc_id.isin(sorted(good)))
    kept = corpus_pipeline.language_stage(spark, some, sf_dir)
    known = langid.fit(some)
    one = [d for d in docs if d["doc_id"] in good]
    sure = {d["doc_id"] for d in one if slow_language(known, d["text"])[1] >= 0.5}
    assert kept.columns == columns and {r.doc_id for r in kept.collect()} == sure
    some = frame.where(frame.doc_id.isin(sorted(sure)))
    rows = [(d["doc_id"], d["text"]) for d in docs if d["doc_id"] in sure]
    kept = corpus_pipeline.duplicates_stage(spark, some, sf_dir)
    first = {r.doc_id for r in kept.collect()}
    assert kept.columns == columns and first == {i for i, (root, *_) in classes_of(rows, brute(rows, jaccard.THRESHOLD)).items() if root == i}
    some = frame.where(frame.doc_id.isin(sorted(first)))
    check_sequences(corpus_pipeline.packing_stage(spark, some, sf_dir).collect(), [r for r in rows if r[0] in first])
    whole = corpus_pipeline.run(spark, sf_dir).collect()
    assert {i for r in whole for i in r.doc_ids} == first


def test_stages_on_odd_rows(spark, sf_dir, tmp_path):
    labels = [(4, 1, 0), (5, 1, 0), (7, 0, 0), (3, 0, None), (None, 1, 0), (6, None, 0)]
    pd.DataFrame(labels, columns=["doc_id", "quality", "toxic"]).astype("Int64").to_parquet(tmp_path / "labels.parquet")
    odd, empty = spark.createDataFrame(ODD, SCHEMA), spark.createDataFrame([], SCHEMA)
    for name, stage in corpus_pipeline.STAGES:
        rows, none = stage(spark, odd, str(tmp_path)), stage(spark, empty, str(tmp_path))
        assert none.count() == 0
        if name == "packing":
            check_sequences(rows.collect(), [(r[0], r[1]) for r in ODD])
            continue
        assert rows.columns == odd.columns == none.columns
        got = [r.doc_id for r in rows.collect()]
        if name == "near_duplicates":
            assert sorted(i or 0 for i in got) == [0, 1, 2, 3, 4, 6, 7]
        else:
            assert not {1, 2} & set(got) and got.count(4) in (0, 2)


def slow_language(model, text):
    """(language, confidence) of a text by a plain loop over its n-grams."""
    points, counts = [ord(c) for c in text.lower()], defaultdict(int)
    for n in langid.ORDERS:
        for i in range(len(points) - n + 1):
            h = 0
            for k in range(n):
                h = (h + points[i + k] + k + 1) * 0x9E3779B1 & 0xFFFFFFFF
                h ^= h >> 15
            counts[h >> (32 - langid.BITS)] += 1
    x = {f: (1 + math.log(c)) * model.idf[f] for f, c in counts.items()}
    norm = math.sqrt(sum(v * v for v in x.values()))
    z = [(sum(v / norm * model.weights[f, k] for f, v in x.items()) + model.intercept[k]) / model.temperature for k in range(len(model.classes))]
    e = [math.exp(v - max(z)) for v in z]
    best = max(range(len(z)), key=lambda k: e[k])
    return model.classes[best], e[best] / sum(e)


def test_op1(spark, sf_dir, docs):
    model = langid.fit(table(spark, sf_dir, "documents"))
    got = {r.doc_id: r for r in queries.op1_language_id(spark, sf_dir).collect()}
    assert len(got) == len(docs)
    for d in docs:
        lang, sure = slow_language(model, d["text"])
        assert got[d["doc_id"]].lang_pred == lang and got[d["doc_id"]].confidence == pytest.approx(sure, abs=1e-9) and got[d["doc_id"]].keep == (sure >= 0.5)


def test_ftrl_against_a_plain_loop():
    """Weights after every example by the published update, one coordinate at a time, in dictionaries."""
    rng = np.random.default_rng(5)
    texts = ["".join(rng.choice(list("abcde"), 12)) for _ in range(8)]
    labels = [["x", "y", "z"][i % 3] for i in range(8)]
    idf = rng.uniform(1, 3, langid.BUCKETS)
    alpha, beta, l1, l2 = 0.5, 1.0, 0.02, 0.5
    model = langid.train(texts, labels, idf, alpha, beta, l1, l2, epochs=2)
    z, n, classes = defaultdict(float), defaultdict(float), sorted(set(labels))

    def weight(f, k):
        if abs(z[f, k]) <= l1:
            return 0.0
        return -(z[f, k] - math.copysign(l1, z[f, k])) / ((beta + math.sqrt(n[f, k])) / alpha + l2)

    rows = []
    for t in texts:
        f, c = next(langid.counted((np.frombuffer(t.encode(), np.uint8), np.array([0, len(t)]))))
        rows.append([*zip(f.tolist(), langid.tfidf(f, c, idf).tolist(), strict=True), (langid.BUCKETS, 1.0)])
    for _ in range(2):
        for i in np.random.default_rng(11).permutation(8):
            w = {(f, k): weight(f, k) for f, _ in rows[i] for k in range(3)}
            s = [sum(v * w[f, k] for f, v in rows[i]) for k in range(3)]
            p = [math.exp(v) / sum(map(math.exp, s)) for v in s]
            for k in range(3):
                for f, v in rows[i]:
                    g = (p[k] - (classes[k] == labels[i])) * v
                    sigma = (math.sqrt(n[f, k] + g * g) - math.sqrt(n[f, k])) / alpha
                    z[f, k] += g - sigma * w[f, k]
                    n[f, k] += g * g
    for f, k in list(z):
        have = model.intercept[k] if f == langid.BUCKETS else model.weights[f, k]
        assert have == pytest.approx(weight(f, k), abs=1e-9)
    assert (model.weights != 0).sum() == sum(weight(f, k) != 0 for f, k in list(z) if f < langid.BUCKETS)


def test_op2(spark, sf_dir):
    records = [warc.parse_record(r) for raw in archived(queries.op2_warc(spark, sf_dir).collect()).values() for r in warc.read_archive(raw)]
    assert sorted((h["WARC-Target-URI"], b.decode()) for h, b in records) == sorted((p.url, p.html) for p in table(spark, sf_dir, "pages").collect())


def test_op3(spark, sf_dir, docs):
    score = slow_model([d["text"] for d in docs], 4)
    got = {r.doc_id: r for r in queries.op3_lm_scoring(spark, sf_dir).collect()}
    assert len(got) == len(docs)
    for d in docs:
        if d["text"].isascii() and len(d["text"]) < 5000:  # elsewhere str.split knows other white space
            assert got[d["doc_id"]].log_likelihood == pytest.approx(score(d["text"]), rel=1e-6)


def test_op4(spark, sf_dir, docs):
    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    got = {r.doc_id: r for r in queries.op4_sentencepiece(spark, sf_dir).collect()}
    assert {i: r.tokens for i, r in got.items()} == {d["doc_id"]: sp.encode(d["text"]) for d in docs} and all(r.round_trip for r in got.values())


def test_op5(spark, sf_dir, docs):
    rows, words = queries.op5_packing(spark, sf_dir).collect(), defaultdict(list)
    for r in rows:
        for i, at, text in zip(r.doc_ids, r.doc_starts, r.texts, strict=True):
            words[i].append((at, text.split()))
    assert {i: sum((w for _, w in sorted(p)), []) for i, p in words.items()} == {d["doc_id"]: d["text"].split() for d in docs if d["text"].split()}
    assert all(r.n_tokens <= packing.CAPACITY for r in rows)


def test_op6(spark, sf_dir, docs):
    rows = [(d["doc_id"], d["text"]) for d in docs]
    want = classes_of(rows, brute(rows, jaccard.THRESHOLD))
    got = {r.doc_id: (r.class_id, r.n_links, r.jaccard) for r in queries.op6_jaccard_join(spark, sf_dir).collect()}
    assert set(got) == set(want)
    assert np.mean([got[i][:2] == w[:2] and (got[i][2] or 0) == pytest.approx(w[2] or 0) for i, w in want.items()]) >= 0.95


def test_op7(spark, sf_dir, docs):
    model = quality.fit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    got = {r.doc_id: r.quality_prob for r in queries.op7_quality(spark, sf_dir).collect()}
    assert len(got) == len(docs)
    for d in docs:
        if len(d["text"]) < 3000:
            assert got[d["doc_id"]] == pytest.approx(1 / (1 + math.exp(-(slow_vector(model, d["text"].encode()) @ model.head + model.offset))), abs=1e-4)


def test_op8(spark, sf_dir, docs):
    got = {r.doc_id: r.fingerprint for r in queries.op8_fingerprints(spark, sf_dir).collect()}
    near = [(a, b, j) for (a, b), j in brute([(d["doc_id"], d["text"]) for d in docs], 0.5).items()]
    errors = [fingerprints.similarity(got[a], got[b]) - j for a, b, j in near]
    assert len(got) == len(docs) and len(near) > 5 and np.abs(errors).mean() < 0.06


def test_op9(spark, sf_dir):
    got = {r.vec_id: r for r in queries.op9_media(spark, sf_dir).collect()}
    rows = table(spark, sf_dir, "embeddings").collect()
    assert len(got) == len(rows) and all(r.status == "ok" for r in got.values())
    for r in rows[:40]:
        pixels = np.clip(np.round(128 + 255 * np.array(r.embedding, float)), 0, 255).astype(np.uint8).reshape(8, 8, 1)
        assert (media.decode(bytes(got[r.vec_id].image)) == pixels).all() and bytes(got[r.vec_id].dct_hash) == slow_hash(pixels)


@pytest.mark.parametrize("stage", [f for _, f in corpus_pipeline.STAGES])
def test_stages_bound_the_batches_of_workers(spark, sf_dir, stage):
    def sizes(batches):
        for b in batches:
            yield pa.record_batch({"bytes": pa.array([b.nbytes], pa.int64()), "rows": pa.array([b.num_rows], pa.int64())})

    bound = "spark.sql.execution.arrow.maxBytesPerBatch"
    spark.conf.unset(bound)
    stage(spark, spark.createDataFrame([], SCHEMA), sf_dir)
    texts = spark.range(0, 200, 1, 1).selectExpr("repeat('word ', 20000) AS text")
    found = texts.mapInArrow(sizes, "bytes bigint, rows bigint").collect()
    assert max(r.bytes for r in found) <= BATCH_BYTES + 200_000 and sum(r.rows for r in found) == 200
    spark.conf.set(bound, "1m")  # a session's own bound stays
    stage(spark, spark.createDataFrame([], SCHEMA), sf_dir)
    assert spark.conf.get(bound) == "1m"
    spark.conf.unset(bound)


def test_packing_starts_no_workers_for_its_plan(spark):
    rows = [(i, list(range(n))) for i, n in enumerate([1, 5, 2048, 3000, 0])]
    frame = spark.createDataFrame(rows, "doc_id bigint, tokens array<int>")
    packed = packing.pack_tokens(spark, frame)
    assert "ExistingRDD" not in packed._jdf.queryExecution().toString()
    assert sorted(x for r in packed.collect() for x in r.tokens) == sorted(x for _, t in rows for x in t)
