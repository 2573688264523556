"""The engine end to end: catalog, writes, builds, consistent reads, clones, streaming, errors."""

import contextlib
import io
import json
import os
import random
import shutil
import time
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from docsail.engine import Engine
from docsail.errors import EngineError
from docsail.operators.merge import SCHEMA, current, merge
from docsail.operators.search import matching
from docsail.schema import Mapping
from docsail.session import Workspace
from docsail.sources.documents import base62, base62_column
from docsail.sources.files import Lock, claim, read_text

FIELDS = {
    "title": {"type": "text", "analyzers": ["standard", "english"]}, "tags": {"type": "keyword"}, "n": {"type": "long"}, "x": {"type": "double"}, "ok": {"type": "boolean"},
    "at": {"type": "datetime"}, "v": {"type": "vector", "dimensions": 17, "similarity": "l2_norm"}, "o": {"type": "object", "objectMapping": {"k": {"type": "long"}, "p": {"type": "object", "objectMapping": {"s": {"type": "keyword"}}}}},
}
DOCS = [
    {"id": "a", "title": "Running dogs", "tags": ["red", "blue"], "n": 3, "x": 1.5, "ok": "TRUE", "at": "2024-01-01T00:00:00.1239Z", "v": [0.5] * 17, "o": {"k": 1, "p": {"s": "deep"}}, "free": [1, 2]},
    {"id": "b", "title": "A dog ran", "tags": "red", "n": -1, "ok": False, "at": "2024-01-01T09:00:00+09:00", "v": [0.1] * 17},
    {"id": "c", "title": "cats", "tags": "z" * 5000, "x": 2.5},
    {"id": "d"},
]


@pytest.fixture
def engine(spark, tmp_path):
    e = Engine(spark, str(tmp_path))
    e.create_project("proj")
    e.create_index("proj", "idx", FIELDS)
    return e


def ids(engine, query=None, **request):
    return [d["doc"]["id"] for d in engine.query("proj", "idx", {"query": query, **request})["docs"]]


def text(q, **more):
    return {"queryString": {"query": q, **more}}


def test_write_build_query(engine):
    assert engine.upsert("proj", "idx", DOCS) == ["a", "b", "c", "d"]
    assert ids(engine, text("*:*")) == []
    assert sorted(ids(engine, text("*:*"), consistentRead=True)) == ["a", "b", "c", "d"]
    assert engine.build("proj", "idx") == 4 and engine.describe_index("proj", "idx")["numDocs"] == 4
    for consistent in (False, True):
        def find(q, c=consistent):
            return sorted(ids(engine, text(q), consistentRead=c))

        assert find("title:dog") == ["a", "b"] and find("title:running") == ["a"] and find("title:run") == ["a"]
        assert find("tags:red") == ["a", "b"] and find("tags:blue") == ["a"] and find("tags:" + "z" * 5000) == []
        assert find("ok:true") == ["a"] and find("o.k:1") == ["a"] and find("o.p.s:de*") == ["a"]
        assert find('at:["2024-01-01T00:00:00Z" TO "2024-01-01T00:00:00Z"]') == ["b"]
        assert find("at:\"2024-01-01T00:00:00.123Z\"") == ["a"]
        assert find("n:[* TO 0]") == ["b"] and find("x:{1.5 TO *]") == ["c"] and find("*:* -tags:red") == ["c", "d"]
    assert ids(engine, sort=[{"n": "desc"}]) == ["a", "b", "c", "d"] and ids(engine, sort=[{"tags": "asc"}])[:2] == ["b", "c"]
    near = {"knn": {"field": "v", "queryVector": [0.1] * 17, "k": 1}}
    assert ids(engine, near) == ["b"] and ids(engine, {"knn": near["knn"] | {"filter": text("tags:blue")}}) == ["a"]


def test_projection_vectors_and_scores(engine):
    engine.upsert("proj", "idx", DOCS)
    engine.build("proj", "idx")
    got = engine.query("proj", "idx", {"query": text("tags:blue"), "fields": ["o.p.s", "free", "o"]})
    assert got["docs"][0]["doc"] == {"id": "a", "o": {"p": {"s": "deep"}}, "free": [1, 2]} and got["total"] == 1 and got["maxScore"] > 0
    assert "v" not in engine.fetch("proj", "idx", {"ids": ["a"]})["docs"][0]["doc"]
    assert engine.fetch("proj", "idx", {"ids": ["a", "zz"], "includeVectors": True})["docs"][0]["doc"]["v"] == [0.5] * 17
    assert "maxScore" not in engine.query("proj", "idx", {"query": text("n:99")})
    assert engine.query("proj", "idx", {"sort": [{"n": "asc"}]})["maxScore"] == -1


def test_deletes_and_last_write(engine):
    engine.upsert("proj", "idx", DOCS)
    engine.delete("proj", "idx", ids=["d", "never"])
    engine.delete("proj", "idx", filter=text("title:dog AND n:>0"))
    engine.upsert("proj", "idx", [{"id": "c", "n": 9}])
    want = ["b", "c"]
    assert sorted(ids(engine, text("*:*"), consistentRead=True)) == want
    engine.build("proj", "idx")
    assert sorted(ids(engine, text("*:*"))) == want and ids(engine, text("n:9")) == ["c"] and ids(engine, text("title:cats")) == []
    engine.upsert("proj", "idx", [{"id": "a", "title": "dog", "n": 5}])
    engine.build("proj", "idx")
    engine.build("proj", "idx")
    assert ids(engine, text("title:dog AND n:>0")) == ["a"]


def test_auto_ids_and_bulk(engine, tmp_path):
    one, two = engine.upsert("proj", "idx", [{"n": 1}, {"n": 2}])
    assert one != two and one[:-1] == two[:-1]
    path = engine.bulk_path("proj", "idx")
    (tmp_path / "up.json").write_text(json.dumps({"documents": [{"id": "k", "n": 7}, {"n": 8}, {}]}))
    (tmp_path / "up.jsonl").write_text('{"id": "l", "n": 7}\n\n{"n": 9, "title": "x \\" y"}\n')
    (tmp_path / "bad.json").write_text('{"documents": [{"n": 1.5}]}')
    (tmp_path / "broken.json").write_text('{"documents": [{"n": ')
    engine.bulk_upsert("proj", "idx", str(tmp_path / "up.json"))
    engine.bulk_upsert("proj", "idx", str(tmp_path / "up.jsonl"), "jsonl")
    for name in ("bad", "broken"):
        with pytest.raises(EngineError):
            engine.bulk_upsert("proj", "idx", str(tmp_path / f"{name}.json"))
    assert engine.build("proj", "idx") == 7 and path.startswith(str(tmp_path))
    assert sorted(ids(engine, text("n:7"))) == ["k", "l"] and len(ids(engine, text("n:[8 TO 9]"))) == 2


def test_clone_and_mapping_update(engine):
    engine.upsert("proj", "idx", DOCS)
    more = FIELDS | {"free": {"type": "keyword"}}
    engine.create_index("proj", "copy", more, source=("proj", "idx"))
    engine.upsert("proj", "copy", [{"id": "e", "n": 1}])
    engine.build("proj", "copy")
    engine.delete("proj", "idx", ids=["a"])
    engine.build("proj", "idx")
    engine.upsert("proj", "idx", [{"id": "q"}])
    engine.build("proj", "idx")
    assert engine.describe_index("proj", "copy")["numDocs"] == 5
    assert engine.query("proj", "copy", {"query": text("free:1")})["docs"][0]["doc"]["id"] == "a"
    engine.update_index("proj", "idx", more)
    assert sorted(ids(engine, text("*:*"))) == ["b", "c", "d", "q"]
    with pytest.raises(EngineError):
        engine.update_index("proj", "idx", FIELDS)
    with pytest.raises(EngineError):
        engine.delete_index("proj", "idx")
    engine.delete_index("proj", "copy")
    assert [i["name"] for i in engine.list_indexes("proj")] == ["idx"]


def test_streaming_build(engine):
    engine.upsert("proj", "idx", DOCS)
    engine.delete("proj", "idx", ids=["b"])
    engine.stream("proj", "idx", {"availableNow": True}).awaitTermination()
    assert sorted(ids(engine, text("*:*"))) == ["a", "c", "d"]
    engine.upsert("proj", "idx", [{"id": "b", "n": 4}])
    engine.stream("proj", "idx", {"availableNow": True}).awaitTermination()
    assert ids(engine, text("n:4")) == ["b"]


def test_stream_with_a_new_checkpoint_loses_nothing(engine, tmp_path):
    for i in range(2):
        engine.upsert("proj", "idx", [{"id": f"d{i}", "n": i}])
        engine.stream("proj", "idx", {"availableNow": True}).awaitTermination()
        shutil.rmtree(tmp_path / "data/proj/idx/checkpoint")
    engine.upsert("proj", "idx", [{"id": "d0", "n": 9}])
    engine.stream("proj", "idx", {"availableNow": True}).awaitTermination()
    assert sorted(ids(engine, text("*:*"))) == ["d0", "d1"] and ids(engine, text("n:9")) == ["d0"]
    copy = [p for p in os.listdir(tmp_path / "data/proj/idx/collection") if p.startswith("v")]
    assert len(copy) == 2 and engine.describe_index("proj", "idx")["numDocs"] == 2


def log_files(tmp_path):
    return [f for f in os.listdir(tmp_path / "data/proj/idx/wal") if f.endswith(".parquet")]


def test_log_and_filters_are_removed(engine, tmp_path):
    """Builds and streams alike remove what the build before the last had merged; reads leave it out before that."""
    engine.upsert("proj", "idx", [{"id": f"d{i}", "n": i} for i in range(10)])
    engine.delete("proj", "idx", filter=text("n:[0 TO 4]"))
    assert engine.describe_index("proj", "idx")["numDocs"] == 0
    assert engine.build("proj", "idx") == 5 == engine.describe_index("proj", "idx")["numDocs"]
    for step in range(2):
        engine.upsert("proj", "idx", [{"id": f"e{step}", "n": 2}])
        engine.stream("proj", "idx", {"availableNow": True}).awaitTermination()
        assert sorted(ids(engine, text("*:*"), consistentRead=True)) == sorted(ids(engine, text("*:*")))
    assert engine.describe_index("proj", "idx")["numDocs"] == 7
    assert len(log_files(tmp_path)) == 1 and not [f for f in os.listdir(tmp_path / "data/proj/idx/filters") if f.endswith(".json")]
    engine.upsert("proj", "idx", [{"id": "d3", "n": 3}])
    assert engine.build("proj", "idx") == 8 and len(log_files(tmp_path)) == 1


def test_bulk_lines_of_many_splits_keep_their_order(engine, spark, tmp_path):
    """Ids repeat over files and splits; the last line of each wins, and generated ids have one form."""
    (tmp_path / "many").mkdir()
    want = {}
    for part in range(3):
        lines = []
        for i in range(2000):
            key, n = f"k{i * 7 % 40}", part * 2000 + i
            lines.append(json.dumps({"id": key, "n": n}))
            want[key] = n
        (tmp_path / f"many/part-{part}.jsonl").write_text("\n".join(lines) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "9000")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        engine.bulk_upsert("proj", "idx", str(tmp_path / "many"), "jsonl")
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    engine.build("proj", "idx")
    got = {d["doc"]["id"]: d["doc"]["n"] for d in engine.query("proj", "idx", {"query": text("*:*"), "size": 100})["docs"]}
    assert got == want
    rows = spark.createDataFrame([(n,) for n in (0, 61, 62, 3843, 3844, 10**15)], "n bigint").select("n", base62_column(F.col("n")).alias("s")).collect()
    assert all(r.s == base62(r.n) for r in rows)


def test_locks(spark, tmp_path):
    path = str(tmp_path / "some/lock.json")
    with Lock(spark, path):
        with pytest.raises(EngineError):
            Lock(spark, path).__enter__()
    with Lock(spark, path):
        pass
    claim(spark, path, json.dumps({"owner": "gone", "at": time.time() - 10_000}))
    with Lock(spark, path):
        assert json.loads(read_text(spark, path))["owner"] != "gone"
    with ThreadPoolExecutor(8) as pool:
        assert sum(pool.map(lambda i: claim(spark, str(tmp_path / "one"), str(i)), range(16))) == 1


def test_scans_of_built_collections_filter_keywords(engine, spark):
    engine.upsert("proj", "idx", DOCS)
    engine.build("proj", "idx")
    df, mapping = engine.collection("proj", "idx")
    said = io.StringIO()
    with contextlib.redirect_stdout(said):
        matching(df, mapping, text("tags:red")).select("id", "score").explain("formatted")
    assert "Or(EqualTo(_k_tags,red),EqualTo(_m_tags,true))" in said.getvalue()


def test_catalog_errors(engine):
    for call in (
        lambda: engine.create_project("proj"), lambda: engine.create_project("x"), lambda: engine.create_index("nope", "idx", FIELDS), lambda: engine.create_index("proj", "idx", FIELDS),
        lambda: engine.create_index("proj", "i", FIELDS), lambda: engine.describe_index("proj", "none"), lambda: engine.delete("proj", "idx"), lambda: engine.delete("proj", "idx", ["a"], text("n:1")),
        lambda: engine.delete("proj", "idx", filter={"knn": {"field": "v", "queryVector": [0.0] * 17, "k": 1}}), lambda: engine.delete_project("proj"), lambda: engine.query("proj", "idx", {"size": 1001, "query": text("*:*")}),
        lambda: engine.query("proj", "idx", {}), lambda: engine.fetch("proj", "idx", {"ids": []}), lambda: engine.upsert("proj", "idx", []), lambda: engine.upsert("proj", "idx", [{"n": "1"}]),
    ):
        with pytest.raises(EngineError):
            call()
    assert engine.update_project("proj", rateLimit=5)["rateLimit"] == 5 and [p["name"] for p in engine.list_projects()] == ["proj"]


def test_merge_commutes(spark):
    """Random logs with deletes by filter, shuffled and batched, against a dictionary that reads them in order."""
    mapping, rng = Mapping.parse({"g": {"type": "long"}}), random.Random(11)
    for _ in range(3):
        rows, filters, model = [], [], {}
        for seq in range(120):
            kind, key, g = rng.random(), f"k{rng.randrange(12)}", rng.randrange(4)
            if kind < 0.7:
                rows.append((key, seq, 0, False, json.dumps({"id": key, "g": g})))
                model[key] = g
            elif kind < 0.9:
                rows.append((key, seq, 0, True, None))
                model.pop(key, None)
            else:
                filters.append(({"queryString": {"query": f"g:{g}"}}, seq))
                model = {k: v for k, v in model.items() if v != g}
        rng.shuffle(rows)
        base, work = None, Workspace(spark)
        for i in range(0, len(rows), 40):
            base = work.save(merge(base, spark.createDataFrame(rows[i : i + 40], SCHEMA)), f"b{i}")
        got = {r.id: r.g for r in current(base, mapping, filters).select("id", "g").collect()}
        assert got == model
