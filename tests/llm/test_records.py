"""WARC archives, SentencePiece scans, fingerprints, PNG columns, URL rules: round trips, brute force, odd inputs."""

import os
import random
import struct
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
import sentencepiece
from pyspark.sql import functions as F
from sentencepiece import sentencepiece_model_pb2 as proto

from docsail.llm import fingerprints, media, pieces, queries, urlfilter, warc
from docsail.session import table

TEXTS = [None, "", "a", "one two", "One  TWO", "repeat repeat repeat repeat", "é😀 ß", "w " * 30_000, "one two"]


def docs_of(spark, texts=TEXTS):
    rows = [(None if i == 3 else i, t, "x", "y", "z") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, p string, e string, tokens string")


# WARC


def archived(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r.archive, r.seq)):
        assert len(out.setdefault(r.archive, b"")) == r.start and len(r.frame) == r.length
        out[r.archive] += bytes(r.frame)
    return out


def test_warc_round_trip(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    rows = warc.archive(pages).collect()
    blocks = [warc.parse_record(r) for raw in archived(rows).values() for r in warc.read_archive(raw)]
    want = sorted((p.url, p.html.encode()) for p in pages.collect())
    assert sorted((h["WARC-Target-URI"], b) for h, b in blocks) == want


def test_warc_dictionary_pays_and_records_stand_alone():
    rng = random.Random(0)
    words = [f"<div class='c{i}'>" for i in range(300)]
    records = [warc.record(i, f"http://a/{i}", "".join(rng.choices(words, k=40))) for i in range(2000)]
    frames = list(warc.frames(records))
    raw = b"".join(frames)
    assert list(warc.read_archive(raw)) == records
    assert struct.unpack("<I", raw[:4])[0] == warc.SKIPPABLE
    alone = warc.zstandard.ZstdCompressor(level=warc.LEVEL)
    assert len(raw) < sum(len(alone.compress(r)) for r in records)
    for few in (records[:1], records[:9], records[:1] * 70, [warc.record(None, None, None)], [warc.record(1, None, "z" * 3_000_000)]):
        assert list(warc.read_archive(b"".join(warc.frames(few)))) == few


def test_warc_odd_rows_and_files(spark, tmp_path):
    rows = [(1, "http://a/\r\nX: y", "b"), (None, None, None), (2, "", ""), (2, "", ""), (3, "http://b", "z" * 300_000)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").selectExpr("*", "1 as frame", "2 as seq")
    done = warc.write_files(warc.archive(pages), str(tmp_path)).collect()
    records = [r for f in os.listdir(tmp_path) if not f.startswith(".") for r in warc.read_archive((tmp_path / f).read_bytes())]
    assert sum(d.records for d in done) == len(records) == 5
    assert sorted(warc.parse_record(r)[1] for r in records) == sorted((b or "").encode() for _, _, b in rows)
    assert warc.archive(pages.where("page_id > 9")).count() == 0


# SentencePiece


def test_pieces_match_library(spark, sf_dir):
    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    want = {r.doc_id: sp.encode(r.text) for r in docs.collect()}
    for giant in (pieces.GIANT_BYTES, 500):
        got = pieces.encode_documents(spark, docs, giant_bytes=giant, chunk=300).collect()
        assert {r.doc_id: r.tokens for r in got} == want and all(r.round_trip for r in got)


def unigram():
    model = proto.ModelProto()
    model.trainer_spec.model_type = 1
    model.trainer_spec.unk_id = 0
    model.normalizer_spec.add_dummy_prefix = True
    model.normalizer_spec.remove_extra_whitespaces = False
    model.pieces.add(piece="<unk>", score=0, type=2)
    rng = random.Random(1)
    for p in {"".join(rng.choices("abc▁", k=n)) for n in (1, 1, 1, 1, 2, 2, 3, 3, 3, 4, 5) for _ in range(9)} | set("abc▁"):
        model.pieces.add(piece=p, score=-rng.uniform(1, 9))
    return pieces.PieceModel(model.SerializeToString())


def test_unigram_scan_is_best_path():
    model, rng = unigram(), random.Random(2)
    for n in (1, 7, 60, 400):
        text = "".join(rng.choices("abc d", k=n))
        s = model.normalized(text)
        best = [0.0] + [-np.inf] * len(s)
        for end in range(1, len(s) + 1):
            for start in range(max(0, end - model.longest), end):
                p = s[start:end]
                if p in model.vocabulary or len(p) == 1:
                    best[end] = max(best[end], best[start] + model.scores.get(p, model.unknown_score))
        for size in (5, 16, 1000):
            ids = pieces.encode_giant(model, text, size)
            names = {v: k for k, v in model.vocabulary.items()}
            score = sum(model.scores[names[i]] if i in names else model.unknown_score for i in ids)
            assert score == pytest.approx(best[-1])


def test_transfer_composition_is_associative():
    model, rng = unigram(), random.Random(3)
    parts = pieces.cut_chunks(model, "".join(rng.choices("abc", k=90)), 20)
    made = [pieces.Chunk(model, *p, first=i == 0, last=i == len(parts) - 1).transfer() for i, p in enumerate(parts)]
    left = pieces.compose(pieces.compose(made[0], made[1]), made[2])
    right = pieces.compose(made[0], pieces.compose(made[1], made[2]))
    assert left[:2] == right[:2] and np.allclose(left[2], right[2])


def test_pieces_odd_rows(spark):
    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    got = pieces.encode_documents(spark, docs_of(spark), giant_bytes=1000, chunk=256).select("*", pieces.decode_tokens("tokens").alias("back")).collect()
    assert len(got) == len(TEXTS)
    by = {r.doc_id: r for r in got}
    assert by[0].tokens is None and by[0].n_tokens is None and by[1].tokens == [] and by[0].back is None
    assert all(by[i].tokens == sp.encode(TEXTS[i]) and by[i].back == TEXTS[i] for i in (2, 4, 5, 6, 7))
    assert pieces.encode_documents(spark, docs_of(spark).where("doc_id > 99")).count() == 0


def test_round_trip_says_what_decoding_gives():
    model = pieces.load(pieces.MODEL)
    texts = ["", " ", "a b", "  two  spaces ", "▁", "a▁b", "é\u0301 \U0001f600\n\t", "<s> </s> <unk> <0x41>", "汉字 и ещё", "\x00\x01"]
    ids = model.encode_block(texts)
    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    assert [x.tolist() for x in ids] == [sp.encode(t) for t in texts]
    assert [model.decode(x) for x in ids] == [sp.decode(x.tolist()) for x in ids]
    same = pieces._same(model, pa.array([*texts, None]), pieces._lists([*ids, None])).to_pylist()
    assert same == [sp.decode(x.tolist()) == t for x, t in zip(ids, texts, strict=True)] + [None] and not all(same[:-1])


def test_scan_over_levels(spark, monkeypatch):
    """Hundreds of chunks combined three at a time."""
    monkeypatch.setattr(pieces, "FAN", 3)
    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    rng = random.Random(12)
    texts = ["".join(rng.choices("abcdefgh etaoin  ß漢😀", k=n)) for n in (40, 3000, 9000)] + ["a" * 4000, " " * 3000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = pieces.encode_documents(spark, docs, giant_bytes=20, chunk=40).collect()
    assert {r.doc_id: r.tokens for r in got} == {i: sp.encode(t) for i, t in enumerate(texts)} and all(r.round_trip for r in got)


def test_model_with_ties_of_any_kind():
    """Pieces of equal score: chunks end at forced cuts, and the scan is the library's encoding."""
    model, rng = proto.ModelProto(), random.Random(5)
    model.trainer_spec.model_type, model.trainer_spec.unk_id = 2, 0
    model.normalizer_spec.add_dummy_prefix, model.normalizer_spec.remove_extra_whitespaces = True, False
    model.normalizer_spec.escape_whitespaces = True
    model.pieces.add(piece="<unk>", score=0, type=2)
    for p in ("ab", "bc", "abc", "ca", "aa", "▁a"):
        model.pieces.add(piece=p, score=-1 - len(p) % 2)
    for p in "abcd▁":
        model.pieces.add(piece=p, score=-9)
    own = pieces.PieceModel(model.SerializeToString())
    sp = sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString())
    assert own.wide_ties
    for n in (5, 50, 500):
        text = "".join(rng.choices("abcd ", k=n))
        assert pieces.encode_giant(own, text, 7).tolist() == sp.encode(text)


# fingerprints


def test_fingerprint_estimates(spark):
    rng = random.Random(0)
    words = [f"w{i}" for i in range(5000)]
    for share in (0.0, 0.3, 0.6, 0.9, 1.0):
        errors = []
        for _ in range(25):
            a = rng.choices(words, k=600)
            b = a[: int(600 * share)] + rng.choices(words, k=600 - int(600 * share))
            sa, sb = ({tuple(t[i : i + 3]) for i in range(len(t) - 2)} for t in (a, b))
            p, q = (fingerprints.fingerprints(pa.array([" ".join(t)])).to_pylist()[0]["fingerprint"] for t in (a, b))
            errors.append(fingerprints.similarity(p, q) - len(sa & sb) / len(sa | sb))
        assert abs(np.mean(errors)) < 0.04 and np.abs(errors).max() < 0.17


def test_densification_is_shared_and_total():
    low, filled = np.zeros((2, 256), np.uint32), np.zeros((2, 256), bool)
    low[:, [3, 77]], filled[:, [3, 77]] = [11, 22], True
    out = fingerprints.densified(low, filled)
    assert (out[0] == out[1]).all() and set(out[0]) == {11, 22}
    assert (fingerprints.densified(low, np.zeros_like(filled)) == low).all()


def test_binned_brute_force():
    value = np.random.default_rng(0).integers(0, 1 << 63, 500, dtype=np.uint64) * np.uint64(2)
    low, filled = fingerprints.binned(value, np.array([0, 200, 200, 500]))
    for d, (a, b) in enumerate(((0, 200), (200, 200), (200, 500))):
        for k in range(256):
            mine = [int(v) >> 24 & 0xFFFFFFFF for v in value[a:b] if int(v) >> 56 == k]
            assert filled[d, k] == bool(mine) and (not mine or low[d, k] == min(mine))


def test_fingerprint_odd_rows(spark):
    got = fingerprints.fingerprint_documents(docs_of(spark)).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == len(TEXTS) and by[0].fingerprint is None and by[1].fingerprint is None
    assert by[4].fingerprint == by[8].fingerprint and len(by[7].fingerprint) == 128
    pair = spark.createDataFrame([(by[4].fingerprint, by[8].fingerprint), (None, by[8].fingerprint)], "a binary, b binary")
    assert [r[0] for r in pair.select(fingerprints.similarity_column("a", "b")).collect()] == [1.0, None]
    assert fingerprints.fingerprint_documents(docs_of(spark).where("doc_id > 99")).count() == 0


# PNG


def slow_unfilter(data, rows, row_bytes, step):
    out, at = np.zeros((rows, row_bytes), int), 0
    for y in range(rows):
        kind = data[at]
        for x in range(row_bytes):
            a = out[y, x - step] if x >= step else 0
            b = out[y - 1, x] if y else 0
            c = out[y - 1, x - step] if y and x >= step else 0
            p = a + b - c
            paeth = a if abs(p - a) <= abs(p - b) and abs(p - a) <= abs(p - c) else b if abs(p - b) <= abs(p - c) else c
            out[y, x] = (int(data[at + 1 + x]) + (0, a, b, (a + b) // 2, paeth)[kind]) & 255
        at += row_bytes + 1
    return out


@pytest.mark.parametrize("step", [1, 3, 4])
def test_unfilter_brute_force(step):
    rng = np.random.default_rng(step)
    images, rows, row_bytes = 3, 13, 7 * step
    data = rng.integers(0, 256, (images, rows, row_bytes + 1)).astype(np.uint8)
    data[:, :, 0] = rng.integers(0, 5, (images, rows))
    want = np.stack([slow_unfilter(x.ravel(), rows, row_bytes, step) for x in data])
    assert (media.unfiltered(data, step) == want).all()
    first = media.unfiltered(data[:, :5], step)
    assert (np.concatenate([first, media.unfiltered(data[:, 5:], step, first[:, -1])], axis=1) == want).all()


def one_png(image):
    image = np.asarray(image)
    return media.encode((image if image.ndim == 3 else image[:, :, None])[None])[0]


@pytest.mark.parametrize("channels", [1, 2, 3, 4])
@pytest.mark.parametrize("band", [1 << 22, 60])
def test_png_round_trip(channels, band, monkeypatch):
    monkeypatch.setattr(media, "BAND", band)
    images = np.random.default_rng(channels).integers(0, 256, (3, 9, 14, channels)).astype(np.uint8)
    for image, raw in zip(images, media.encode(images), strict=True):
        assert (media.decode(raw) == image).all()


def slow_hash(image):
    """The hash from its definition: mean brightness of 32 x 32 cells, their cosine transform as direct sums, the median."""
    h, w, channels = image.shape
    gray = image[:, :, :3] @ [0.299, 0.587, 0.114] if channels >= 3 else image[:, :, 0].astype(float)
    if channels in (2, 4):
        gray = gray * image[:, :, -1] / 255

    def cells(n):
        return [[(i, min(i + 1, (k + 1) * n / 32) - max(i, k * n / 32)) for i in range(n) if min(i + 1, (k + 1) * n / 32) > max(i, k * n / 32)] for k in range(32)]

    small = np.array([[sum(gray[y, x] * p * q for y, p in rows for x, q in columns) * 32 / h * 32 / w for columns in cells(w)] for rows in cells(h)])
    at = np.arange(32)
    low = np.array([[(small * np.outer(np.cos(np.pi * (2 * at + 1) * u / 64), np.cos(np.pi * (2 * at + 1) * v / 64))).sum() for v in range(8)] for u in range(8)])
    low = np.round(low.ravel(), 6)
    return np.packbits(low > np.median(low[1:])).tobytes()


@pytest.mark.parametrize("shape", [(40, 50, 3), (8, 8, 1), (33, 7, 4), (64, 20, 2)])
def test_hash_brute_force_stacked_and_in_bands(shape, monkeypatch):
    images = np.random.default_rng(shape[0]).integers(0, 256, (5, *shape)).astype(np.uint8)
    raws = media.encode(images)
    want = [slow_hash(x) for x in images]
    for band in (1 << 22, 200, 1):
        monkeypatch.setattr(media, "BAND", band)
        got = media.inspect(pa.array([*raws, None, b"x"], pa.binary())).to_pylist()
        assert [r["dct_hash"] for r in got[:5]] == want and [r["status"] for r in got] == ["ok"] * 5 + [None, "signature"]


def test_png_of_real_size():
    """A picture of 1.5 million pixels, decoded in bands, and its half: hashes that are close."""
    y, x = np.mgrid[0:1000, 0:1500]
    image = np.stack([(x * 255 // 1500), (y * 255 // 1000), ((x + y) % 256)], axis=2).astype(np.uint8)
    raw = one_png(image)
    assert media.unpacked(raw).header.bytes() > media.BAND and (media.decode(raw) == image).all()
    got = media.inspect(pa.array([raw, one_png(image[::2, ::2])], pa.binary())).to_pylist()
    assert got[0]["width"] == 1500 and got[0]["channels"] == 3
    a, b = (np.unpackbits(np.frombuffer(r["dct_hash"], np.uint8)) for r in got)
    assert (a != b).sum() <= 6


def png(width, height, depth, color, body, interlace=0, palette=None):
    def chunk(name, data):
        return struct.pack(">I", len(data)) + name + data + struct.pack(">I", zlib.crc32(name + data))

    middle = chunk(b"PLTE", palette) if palette else b""
    return media.SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, depth, color, 0, 0, interlace)) + middle + chunk(b"IDAT", zlib.compress(body)) + chunk(b"IEND", b"")


def test_png_depths_palette_and_interlace():
    assert media.decode(png(9, 1, 1, 0, b"\0\xaa\x80"))[0, :, 0].tolist() == [255, 0, 255, 0, 255, 0, 255, 0, 255]
    assert media.decode(png(2, 1, 16, 0, b"\0\xff\xff\0\0"))[0, :, 0].tolist() == [255, 0]
    assert media.decode(png(2, 1, 8, 3, b"\0\1\0", palette=bytes(range(6)))).tolist() == [[[3, 4, 5], [0, 1, 2]]]
    image = np.arange(64, dtype=np.uint8).reshape(8, 8) * 3
    body = b"".join(b"\0" + image[y::dy, x::dx][r].tobytes() for x, y, dx, dy in media.ADAM7 for r in range(len(image[y::dy, x::dx])))
    assert (media.decode(png(8, 8, 8, 0, body, interlace=1))[:, :, 0] == image).all()
    mixed = pa.array([png(8, 8, 8, 0, body, interlace=1), one_png(image), png(2, 1, 8, 3, b"\0\1\7", palette=bytes(range(6))), png(8, 8, 8, 0, b"\5" + body[1:], interlace=1)], pa.binary())
    got = media.inspect(mixed).to_pylist()
    assert [r["status"] for r in got] == ["ok", "ok", "palette", "filter"] and got[0]["dct_hash"] == got[1]["dct_hash"] == slow_hash(image[:, :, None])


def test_png_damage_and_hash(spark):
    rng = np.random.default_rng(7)
    smooth = np.clip(np.add.outer(np.arange(40) * 3, np.arange(50) * 2), 0, 255).astype(np.uint8)
    good = one_png(smooth)
    wrong = bytearray(good)
    wrong[45] ^= 1
    rows = [(1, good), (2, bytes(wrong)), (3, good[:-20]), (4, b""), (5, None), (6, b"GIF89a.."), (7, png(3, 2, 8, 0, b"\0abc")), (None, good), (1, good)]
    images = spark.createDataFrame(rows, "k bigint, image binary").selectExpr("*", "1 as status", "2 as found")
    got = media.hash_images(images, "k").collect()
    by = {r.k: r.status for r in got}
    assert by[1] == "ok" and by[2] in ("checksum", "truncated") and by[3] == "truncated" and by[4] == by[6] == "signature" and by[5] is None and by[7] == "deflate"
    assert len(got) == len(rows) and media.hash_images(images.where("k > 99"), "k").count() == 0
    for name in ("found", "status", "is", "of", "image"):
        clash = spark.createDataFrame([(1, good)], f"{name} bigint, picture binary")
        assert media.hash_images(clash, name, "picture").first()[name] == 1 and len(set(media.hash_images(clash, name, "picture").columns)) == 7
    other = rng.integers(0, 256, (40, 50)).astype(np.uint8)
    near = np.repeat(np.repeat(smooth, 2, axis=0), 2, axis=1)

    def bits(x):
        return np.unpackbits(np.frombuffer(media.cosine_hash(one_png(x)), np.uint8))

    assert (bits(near) != bits(smooth)).sum() <= 4 < (bits(other) != bits(smooth)).sum()


def test_vector_image(spark):
    rows = spark.createDataFrame([([0.0, 0.5, float("nan"), None, -9.0],), (None,), ([],)], "v array<float>").select(media.vector_image("v").alias("i")).collect()
    assert media.decode(bytes(rows[0].i))[:, :, 0].ravel().tolist() == [128, 255, 128, 128, 0, 128, 128, 128, 128]
    assert rows[1].i is None and rows[2].i is None


# URL rules


def slow_rules(urls, rules):
    def key(host, path):
        return ".".join(reversed(host.split("."))) + "." + path

    out = {}
    known = {(p, a, key(p.split("/")[0].lower().rstrip("."), "/" + p.partition("/")[2] if "/" in p else "")) for p, a in rules if p and p.split("/")[0].rstrip(".")}
    for i, url in urls:
        found = []
        if url and "://" in url:
            rest = url.split("://", 1)[1].split("#")[0]
            end = min([x for x in (rest.find("/"), rest.find("?")) if x >= 0], default=len(rest))
            host, path = rest[:end].split("@")[-1], rest[end:]
            host, tail = (host[: host.find("]") + 1], host[host.find("]") + 1 :]) if host.startswith("[") else (host.split(":")[0], "")
            host, path = host.lower().rstrip("."), path if tail[:1] in ("", ":") else tail + path
            if host:
                k = key(host, path if path.startswith("/") else "/" + path)
                found = sorted(((-len(x), p, a) for p, a, x in known if k.startswith(x)), key=lambda r: (r[0], r[1], r[2]))
        out[i] = (len(found), found[0][1] if found else None, found[0][2] if found else None)
    return out


@pytest.mark.parametrize(("partitions", "batch"), [("1", "10000"), ("1", "3"), ("7", "10000")])
def test_url_rules_brute_force(spark, partitions, batch):
    rng = random.Random(4)
    hosts = ["a.com", "b.a.com", "c.b.a.com", "ab.com", "d.org", "E.ORG."]
    urls = [(i, f"http://{rng.choice(hosts)}{rng.choice(['', ':80'])}/{rng.choice('xyz')}/{rng.randrange(5)}{rng.choice(['', '#f', '?q'])}") for i in range(400)]
    urls += [(400, None), (401, ""), (402, "no host"), (403, "http:///p"), (404, "https://u@a.com?x"), (405, urls[0][1]), (406, "http://[::1]:80/a/b"), (407, "http://[::1]x/a")]
    rules = [("a.com", "block"), ("b.a.com", "allow"), ("b.a.com", "block"), ("b.a.com", "block"), ("a.com/x/", "review"), ("a.com/x/1", "allow"), ("com", "ok"), ("e.org./y", "z"), (None, "q"), ("", "q"), ("org", None), ("[::1]/a/", "six")]
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        u = spark.createDataFrame(urls, "page_id bigint, url string").selectExpr("*", "1 as key", "2 as part", "3 as row")
        r = spark.createDataFrame(rules, "pattern string, action string")
        got = urlfilter.apply_rules(spark, u, r).collect()
        assert urlfilter.apply_rules(spark, u.where("page_id > 999"), r).count() == 0
        assert {x.rule for x in urlfilter.apply_rules(spark, u, r.where("pattern = 'zz'")).collect()} == {None}
        clash = urlfilter.apply_rules(spark, u.select(F.col("page_id").alias("rule"), F.col("url").alias("action")), r, "rule", "action")
        assert clash.columns == ["rule", "action", "n_rules", "rule_", "action_"] and clash.count() == len(urls)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = slow_rules(urls, [(p, a) for p, a in rules])
    assert len(got) == len(urls)
    assert {x.page_id: (x.n_rules, x.rule, x.action) for x in got} == want


def test_url_query_matches_sql(spark, sf_dir):
    con = duckdb.connect()
    con.sql(f"create view pages as select * from '{sf_dir}/pages.parquet'")
    want = sorted(con.sql(urlfilter.ORACLE).fetchall(), key=str)
    got = sorted((tuple(r) for r in queries.op10_url_filters(spark, sf_dir).collect()), key=str)
    assert got == want
