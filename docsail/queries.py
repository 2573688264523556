"""The engine's queries over the test tables, and the same in SQL."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docsail.engine import Engine
from docsail.functions.analysis import WORD, standard
from docsail.operators.merge import current, merge
from docsail.operators.search import fetch, matching, max_score, search
from docsail.schema import Mapping
from docsail.session import Workspace, table
from docsail.streaming.build import build_available

VECTOR = [round(((i * 37) % 64 - 31.5) / 150, 6) for i in range(64)]

MAPPINGS = {
    "documents": {"text": {"type": "text"}, "lang": {"type": "keyword"}, "source": {"type": "keyword"}, "n_chars": {"type": "long"}},
    "english": {"text": {"type": "text", "analyzers": ["standard", "english"]}},
    "events": {"ts": {"type": "datetime"}, "user_id": {"type": "long"}, "event_type": {"type": "keyword"}, "value": {"type": "double"}, "props": {"type": "object", "objectMapping": {"k": {"type": "long"}}}},
    "orders": {"o_orderstatus": {"type": "keyword"}, "o_orderpriority": {"type": "keyword"}, "o_totalprice": {"type": "double"}, "o_orderdate": {"type": "datetime"}, "o_custkey": {"type": "long"}},
    "part": {"p_name": {"type": "keyword"}, "p_brand": {"type": "keyword"}, "p_type": {"type": "keyword"}, "p_size": {"type": "long"}, "p_retailprice": {"type": "double"}},
    "labels": {"quality": {"type": "boolean"}, "toxic": {"type": "boolean"}},
    "embeddings": {"label": {"type": "long"}, "embedding": {"type": "vector", "dimensions": 64}},
}
_KEYS = {"documents": "doc_id", "events": "event_id", "orders": "o_orderkey", "part": "p_partkey", "labels": "doc_id", "embeddings": "vec_id"}


def collection(spark: SparkSession, sf_dir: str, name: str, similarity: str = "cosine", mapping: str | None = None) -> tuple[DataFrame, Mapping]:
    """A table with its key as the string id, and its mapping."""
    declared = json.loads(json.dumps(MAPPINGS[mapping or name]))
    if name == "embeddings":
        declared["embedding"]["similarity"] = similarity
    df = table(spark, sf_dir, name).withColumn("id", F.col(_KEYS[name]).cast("string"))
    if name == "events":
        df = df.withColumn("props", F.from_json("props", "k bigint"))
    return df, Mapping.parse(declared)


def _text(query: str, **options) -> dict:
    return {"queryString": {"query": query, **options}}


def _clause(occur: str, query: dict, **options) -> dict:
    return {"occur": occur, **query, **options}


def _knn(k: int, **options) -> dict:
    return {"knn": {"field": "embedding", "queryVector": VECTOR, "k": k, **options}}


Q: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _register(name: str, sql: str | None, run: Callable[[SparkSession, str], DataFrame]) -> None:
    Q[name] = run
    if sql:
        SQL[name] = sql


def _search(name: str, table_name: str, sql: str | None, similarity: str = "cosine", mapping: str | None = None, **request) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df, declared = collection(spark, sf_dir, table_name, similarity, mapping)
        return search(df, declared, **request).withColumn("score", F.round("score", 6))

    _register(name, sql, run)


# SQL building blocks

_TOKENS = f"regexp_extract_all(lower(text), '{WORD.replace(chr(39), chr(39) * 2)}')"
_DOCS = f"d as (select cast(doc_id as varchar) as id, lang, source, n_chars, {_TOKENS} as t from documents), " "st as (select count(*) filter (len(t) > 0) as n, sum(len(t)) as total from d)"
_DL = "(case when len(t) < 40 then len(t)::double else 24 + floor((len(t) - 24) / pow(2, length(bin((len(t) - 24)::bigint)) - 4)) * pow(2, length(bin((len(t) - 24)::bigint)) - 4) end)"


def _bm25(word: str) -> str:
    tf = f"len(list_filter(t, lambda x: x = '{word}'))::double"
    df = f"(select count(*) from d where list_contains(t, '{word}'))"
    idf = f"ln(1 + ((select n from st) - {df} + 0.5) / ({df} + 0.5))"
    return f"(case when list_contains(t, '{word}') then {idf} * {tf} / ({tf} + 1.2 * (0.25 + 0.75 * {_DL} / ((select total from st) / (select n from st)))) else 0 end)"


def _flat(relation: str, condition: str) -> str:
    n, df = f"(select count(*) from {relation})", f"(select count(*) from {relation} where {condition})"
    return f"(ln(1 + ({n} - {df} + 0.5) / ({df} + 0.5)) / 2.2)"


def _has(word: str) -> str:
    return f"list_contains(t, '{word}')"


def _docs_sql(where: str, score: str, size: int = 10, columns: str = "", order: str = "score desc, id") -> str:
    return f"with {_DOCS}, s as (select id, round({score}, 6) as score, {score} as exact{columns and ', ' + columns} from d where {where}) select id, score{columns and ', ' + columns} from s order by {order.replace('score', 'exact')} limit {size}"


_EV = "ev as (select cast(event_id as varchar) as id, ts, user_id, event_type, value, cast(json_extract(props, '$.k') as bigint) as k from events)"


def _events_sql(where: str, score: str = "1.0", size: int = 10, columns: str = "", order: str = "score desc, id") -> str:
    return f"with {_EV}, s as (select id, ts, user_id, event_type, value, k, {score} as exact from ev where {where}) select id, round(cast(exact as double), 6) as score{columns and ', ' + columns} from s order by {order.replace('score', 'exact')} limit {size}"


def _sorted_sql(relation: str, key: str, order: str, columns: str, where: str = "true", size: int = 100) -> str:
    return f"select cast({key} as varchar) as id, cast(null as double) as score, {columns} from {relation} where {where} order by {order}, cast({key} as varchar) limit {size}"


def _part_sql(where: str, size: int = 1000) -> str:
    return f"select cast(p_partkey as varchar) as id, cast(1.0 as double) as score, p_name from part where {where} order by id limit {size}"


_Q64 = f"{VECTOR}::double[64]"
_V = "embedding::double[]::double[64]"
_SIMILAR = {
    "cosine": f"(1 + list_cosine_similarity({_V}, {_Q64})) / 2",
    "dot_product": f"(1 + list_dot_product({_V}, {_Q64})) / 2",
    "l2_norm": f"1 / (1 + pow(list_distance({_V}, {_Q64}), 2))",
    "max_inner_product": f"case when list_dot_product({_V}, {_Q64}) < 0 then 1 / (1 - list_dot_product({_V}, {_Q64})) else list_dot_product({_V}, {_Q64}) + 1 end",
}


def _knn_sql(similarity: str, k: int, where: str = "true", times: str = "1", columns: str = "") -> str:
    return f"with v as (select cast(vec_id as varchar) as id, *, {_SIMILAR[similarity]} as exact from embeddings where {where}) select id, round({times} * exact, 6) as score{columns} from v order by exact desc, id limit {k}"


# full text

_search("term_bm25_top10", "documents", _docs_sql(_has("the"), _bm25("the")), query=_text("text:the"))
_search("match_multi_bm25", "documents", _docs_sql(f"{_has('the')} or {_has('idiot')} or {_has('der')}", f"{_bm25('the')} + {_bm25('idiot')} + {_bm25('der')}", 50), query=_text("the, idiot: (der)", defaultField="text", skipSyntax=True), size=50)
_search("match_repeat_term", "documents", _docs_sql(_has("of"), f"{_bm25('of')} + {_bm25('of')}", 20), query=_text("of of", defaultField="text", skipSyntax=True), size=20)
_search("default_field_bare_terms", "documents", _docs_sql(f"{_has('the')} or {_has('est')}", f"{_bm25('the')} + 2 * {_bm25('est')}", 30), query=_text("the est^2", defaultField="text"), size=30)
_search("unmapped_field_words", "documents", _docs_sql(f"{_has('note')} or {_has('the')}", f"{_bm25('note')} + {_bm25('the')}", 30), query=_text("note:the", defaultField="text"), size=30)
_search("text_phrase_as_words", "documents", _docs_sql(f"{_has('the')} or {_has('of')}", f"{_bm25('the')} + {_bm25('of')}", 25), query=_text('text:"the of"~3'), size=25)
_search("text_wildcard", "documents", _docs_sql("len(list_filter(t, lambda x: regexp_full_match(x, 'th.*ing'))) > 0", "1.0::double", 100), query=_text("text:th*ing"), size=100)
_search("english_bm25", "documents", None, mapping="english", query=_text("text:(hehely thed)"), size=20)
_search("bool_must_should", "documents", _docs_sql(f"{_has('the')}", f"{_bm25('the')} + {_bm25('idiot')}", 20), query={"bool": [_clause("MUST", _text("text:the")), _clause("SHOULD", _text("text:idiot"))]}, size=20)
_search("bool_must_not", "documents", _docs_sql(f"({_has('the')}) and not {_has('of')}", _bm25("the"), 20), query=_text("text:the -text:of"), size=20)
_search("bool_filter", "documents", _docs_sql(f"{_has('the')} and lang = 'en' and n_chars between 500 and 1500", _bm25("the"), 20, "n_chars"), query={"bool": [_clause("MUST", _text("text:the")), _clause("FILTER", _text("lang:en AND n_chars:[500 TO 1500]"))]}, size=20, fields=["n_chars"])
_search("bool_nested_boost", "documents", _docs_sql(f"{_has('of')} or {_has('la')}", f"(case when {_has('of')} then 3 * {_bm25('of')} else 0 end) + (case when {_has('la')} then 0.5 * 2 * {_bm25('la')} else 0 end)", 20), query={"bool": [_clause("SHOULD", _text("text:of"), boost=3), {"bool": [_clause("MUST", _text("text:la", boost=2))], "boost": 0.5}]}, size=20)
_search("bool_pure_negative_empty", "documents", _docs_sql("false", "1.0"), query={"bool": [_clause("MUST_NOT", _text("text:the"))]})
_search("keyword_term_score", "documents", _docs_sql("lang = 'fr'", _flat("d", "lang = 'fr'"), 20), query=_text("lang:fr"), size=20)
_search("track_scores", "documents", _docs_sql(_has("the"), _bm25("the"), 20, "n_chars", "n_chars desc nulls last, id"), query=_text("text:the"), sort=[{"n_chars": "desc"}], track_scores=True, size=20, fields=["n_chars"])

# structured

_search("match_all_sorted", "events", _sorted_sql("events", "event_id", "value desc nulls last", "value"), sort=[{"value": "desc"}], size=100, fields=["value"])
_search("keyword_term", "events", _events_sql("event_type = (select min(event_type) from events where event_type = 'click')", _flat("ev", "event_type = 'click'"), 100), query=_text("event_type:click"), size=100)
_search("long_range", "events", _events_sql("user_id between 10 and 20", "1.0", 1000, "user_id"), query=_text("user_id:[10 TO 20]"), size=1000, fields=["user_id"])
_search("double_range_exclusive", "events", _events_sql("value > 10.5 and value < 11.5", "1.0", 1000, "value"), query=_text("value:{10.5 TO 11.5}"), size=1000, fields=["value"])
_search("range_open", "events", _events_sql("value >= 100 or user_id < 3", "(case when value >= 100 then 1.0 else 0 end) + (case when user_id < 3 then 1.0 else 0 end)", 1000), query=_text("value:>=100 user_id:[* TO 3}"), size=1000)
_search("datetime_range", "orders", "select cast(o_orderkey as varchar) as id, cast(1.0 as double) as score from orders where o_orderdate >= timestamp '1995-01-01' and o_orderdate < timestamp '1995-02-01' order by id limit 1000", query=_text('o_orderdate:["1995-01-01T00:00:00Z" TO "1995-02-01T00:00:00Z"}'), size=1000)
_search("datetime_offset_equality", "orders", "select cast(o_orderkey as varchar) as id, cast(1.0 as double) as score from orders where o_orderdate = timestamp '1995-03-05' order by id limit 1000", query=_text('o_orderdate:"1995-03-05T09:00:00+09:00"'), size=1000)
_search("keyword_range", "orders", "select cast(o_orderkey as varchar) as id, cast(1.0 as double) as score, o_orderpriority from orders where o_orderpriority >= '1' and o_orderpriority < '3' order by id limit 500", query=_text("o_orderpriority:[1 TO 3}"), size=500, fields=["o_orderpriority"])
_search("nested_object_term", "events", _events_sql("k = 7", "1.0", 1000, "k as props_k"), query=_text("props.k:7"), size=1000, fields=["props.k"])
_search("boolean_term", "labels", f"select cast(doc_id as varchar) as id, round({_flat('labels', 'toxic = 1')}, 6) as score from labels where toxic = 1 order by id limit 1000", query=_text("toxic:TRUE"), size=1000)
_search("wildcard", "part", _part_sql("regexp_full_match(p_name, '.*a.e.*')"), query=_text("p_name:*a?e*"), size=1000, fields=["p_name"])
_search("prefix", "part", _part_sql("starts_with(p_name, 'sm')"), query=_text("p_name:sm*"), size=1000, fields=["p_name"])
_search("leading_wildcard", "part", _part_sql("p_name like '%ring'"), query=_text("p_name:*ring"), size=1000, fields=["p_name"])
_search("regexp", "part", _part_sql("regexp_full_match(p_brand, 'Brand#[1-3][24]')"), query=_text("p_brand:/Brand\\#[1-3][24]/"), size=1000, fields=["p_name"])
_search("fuzzy1", "part", _part_sql("damerau_levenshtein(p_brand, 'Brnad#12') <= 1"), query=_text("p_brand:Brnad\\#12~1"), size=1000, fields=["p_name"])
_search("fuzzy2", "part", _part_sql("damerau_levenshtein(p_brand, 'Brnad#1') <= 2"), query=_text("p_brand:Brnad\\#1~"), size=1000, fields=["p_name"])
_search("exists_wildcard", "part", _part_sql("p_name is not null", 50), query=_text("p_name:*"), size=50, fields=["p_name"])
_search("sort_nulls_last", "events", "with e as (select cast(event_id as varchar) as id, cast(json_extract(props, '$.k') as bigint) as k from events) select id, cast(null as double) as score, k as props_k from e order by k asc nulls last, id limit 200", sort=[{"props.k": "asc"}], size=200, fields=["props.k"])
_search("sort_multi_key", "orders", _sorted_sql("orders", "o_orderkey", "o_orderstatus desc nulls last, o_totalprice asc nulls last", "o_orderstatus, o_totalprice"), sort=[{"o_orderstatus": "desc"}, {"o_totalprice": None}], size=100, fields=["o_orderstatus", "o_totalprice"])
_search("sort_desc_keyword", "part", _sorted_sql("part", "p_partkey", "p_type desc nulls last", "p_type, p_size", "p_size > 40"), query=_text("p_size:>40"), sort=[{"p_type": "desc"}], size=100, fields=["p_type", "p_size"])
_search("sort_datetime", "events", _sorted_sql("events", "event_id", "ts desc nulls last", "ts"), sort=[{"ts": "desc"}], size=100, fields=["ts"])

# vectors

for _name in ("cosine", "dot_product", "l2_norm", "max_inner_product"):
    _search({"cosine": "knn_cosine", "dot_product": "knn_dot", "l2_norm": "knn_l2", "max_inner_product": "knn_mip"}[_name], "embeddings", _knn_sql(_name, 20), _name, query=_knn(20), size=20)
_search("knn_filtered", "embeddings", _knn_sql("cosine", 15, "label between 2 and 5", columns=", label"), query=_knn(15, numCandidates=100, filter=_text("label:[2 TO 5]")), size=15, fields=["label"])
_search("knn_boosted", "embeddings", _knn_sql("l2_norm", 10, times="2.5"), "l2_norm", query={"bool": [_clause("MUST", _knn(10), boost=2.5)]}, size=10)
_search("include_vectors", "embeddings", _knn_sql("cosine", 5, columns=", embedding"), query=_knn(5), size=5, fields=["embedding"])
_search("hybrid_knn_bool", "embeddings", f"with v as (select cast(vec_id as varchar) as id, label, {_SIMILAR['cosine']} as sim from embeddings), k as (select id, sim from v order by sim desc, id limit 30), s as (select v.id, coalesce(k.sim, 0) + case when label = 3 then 1 else 0 end as exact from v left join k using (id) where k.id is not null or label = 3) select id, round(exact, 6) as score from s order by exact desc, id limit 60", query={"bool": [_clause("SHOULD", _knn(30)), _clause("SHOULD", _text("label:3"))]}, size=60)

# whole-table results and reads


def _fetch_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fetch(*collection(spark, sf_dir, "documents"), ["3", "14", "15", "92", "no such id", "3"], ["lang", "n_chars"])


def _all_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = matching(*collection(spark, sf_dir, "documents"), _text("text:(the la der) AND n_chars:>200"))
    return found.select("id", F.round("score", 6).alias("score"))


def _max_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return max_score(search(*collection(spark, sf_dir, "documents"), _text("text:the")), False).select(F.round("max_score", 6).alias("max_score"))


def _token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One pass: a document's tokens are sorted, so that the first of each kind also counts the document."""
    sorted_ = F.array_sort(standard(F.col("text")))
    found = table(spark, sf_dir, "documents").select(F.inline(F.array(F.struct(sorted_.alias("s")))))  # a generator: analysed once
    before = F.slice(F.concat(F.array(F.lit(None).cast("string")), "s"), F.lit(1), F.size("s"))
    words = found.select(F.inline(F.zip_with("s", before, lambda x, y: F.struct(x.alias("token"), (~x.eqNullSafe(y)).cast("int").alias("first")))))
    return words.groupBy("token").agg(F.count("*").alias("n"), F.sum("first").alias("docs"))


_register("fetch_ids", "select cast(doc_id as varchar) as id, lang, n_chars from documents where cast(doc_id as varchar) in ('3', '14', '15', '92')", _fetch_ids)
_register("all_matches", f"with {_DOCS} select id, round({_bm25('the')} + {_bm25('la')} + {_bm25('der')} + 1.0, 6) as score from d where ({_has('the')} or {_has('la')} or {_has('der')}) and n_chars > 200", _all_matches)
_register("max_score", f"with m as ({_docs_sql(_has('the'), _bm25('the'))}) select max(score) as max_score from m having count(*) > 0", _max_score)
_register("token_counts", f"with w as (select doc_id, unnest({_TOKENS}) as token from documents) select token, count(*) as n, count(distinct doc_id) as docs from w group by token", _token_counts)

# writes: the events table read as a log of upserts and deletes

_LOG = Mapping.parse({"user_id": {"type": "long"}, "event_type": {"type": "keyword"}, "value": {"type": "double"}})


def event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event as a write to its user's record, in order of event_id; every seventh one deletes the record."""
    e = table(spark, sf_dir, "events")
    gone = F.pmod("event_id", F.lit(7)) == 3
    doc = F.to_json(F.struct(F.col("user_id").cast("string").alias("id"), "user_id", "event_type", "value"))
    return e.select(F.col("user_id").cast("string").alias("id"), F.col("event_id").alias("_seq"), F.lit(0).alias("_pos"), gone.alias("_deleted"), F.when(~gone, doc).alias("_doc"))


_FILTERS = [({"queryString": {"query": "event_type:click AND value:<50"}}, 9950), ({"queryString": {"query": "event_type:view AND value:>80"}}, 1 << 40)]
_LAST = "with l as (select user_id, event_id, event_type, value, row_number() over (partition by user_id order by event_id desc) as nth from events) select cast(user_id as varchar) as id, user_id, event_type, value from l where nth = 1 and event_id % 7 <> 3"


def _shown(df: DataFrame) -> DataFrame:
    return df.select("id", "user_id", F.col("event_type")[0].alias("event_type"), "value")


def _upsert_lww(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(current(merge(None, event_log(spark, sf_dir)), _LOG))


def _delete_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(current(merge(None, event_log(spark, sf_dir)), _LOG, _FILTERS))


def _consistent_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A base of the older half of the log, written; the newer half read over it at query time."""
    log = event_log(spark, sf_dir)
    base = Workspace(spark).save(merge(None, log.where("_seq % 2 = 0")), "base")
    return _shown(current(merge(base, log.where("_seq % 2 = 1")), _LOG))


def _stream_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log as files, merged by Structured Streaming in micro-batches."""
    work = Workspace(spark)
    event_log(spark, sf_dir).repartition(4, "_seq").write.parquet(work.path("wal"))
    base = build_available(spark, work.path("wal"), work.path("collection"), work.path("checkpoint"), files_per_batch=2)
    return _shown(current(base, _LOG))


def _engine(spark: SparkSession) -> tuple[Engine, Workspace]:
    work = Workspace(spark)
    engine = Engine(spark, work.path("engine"))
    engine.create_project("project")
    engine.create_index("project", "index", _LOG.to_json())
    return engine, work


def _bulk_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as lines of bulk files, each a write to its user's record: the last line of a user stays."""
    engine, work = _engine(spark)
    doc = F.to_json(F.struct(F.col("user_id").cast("string").alias("id"), "user_id", "event_type", "value"))
    lines = table(spark, sf_dir, "events").repartitionByRange(4, "event_id").sortWithinPartitions("event_id")
    lines.select(doc.alias("value")).write.text(work.path("lines"))
    engine.bulk_upsert("project", "index", work.path("lines"), "jsonl")
    engine.build("project", "index")
    return _shown(engine.collection("project", "index")[0])


def _events_indexed(spark: SparkSession, sf_dir: str) -> Engine:
    engine, work = _engine(spark)
    table(spark, sf_dir, "events").select(F.to_json(F.struct(F.col("event_id").cast("string").alias("id"), "user_id", "event_type", "value")).alias("value")).write.text(work.path("lines"))
    engine.bulk_upsert("project", "index", work.path("lines"), "jsonl")
    return engine


def _num_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many documents an index says it has, after a delete by filter and a build, and how many a scan finds."""
    engine = _events_indexed(spark, sf_dir)
    engine.delete("project", "index", filter=_text("event_type:click AND value:<50"))
    engine.build("project", "index")
    said = engine.describe_index("project", "index")["numDocs"]
    return engine.collection("project", "index")[0].agg(F.lit(said).cast("bigint").alias("num_docs"), F.count("*").alias("found"))


def _stream_restart(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log in two halves, each built by a stream with a checkpoint of its own: none of the batches is lost."""
    work, log = Workspace(spark), event_log(spark, sf_dir)
    for half in range(2):
        log.where(F.col("_seq") % 2 == half).repartition(2, "id").write.mode("append").parquet(work.path("wal"))
        base = build_available(spark, work.path("wal"), work.path("collection"), work.path(f"checkpoint{half}"), files_per_batch=2)
    return _shown(current(base, _LOG))


_register("bulk_last_wins", _LAST.replace(" and event_id % 7 <> 3", ""), _bulk_last_wins)
_register("num_docs_after_filter_delete", "select count(*) as num_docs, count(*) as found from events where not coalesce(event_type = 'click' and value < 50, false)", _num_docs)
_register("stream_restart", _LAST, _stream_restart)
_register("upsert_lww", _LAST, _upsert_lww)
_register("delete_filter", _LAST + " and not (event_type = 'click' and value < 50 and event_id < 9950) and not (event_type = 'view' and value > 80)", _delete_filter)
_register("consistent_overlay", _LAST, _consistent_overlay)
_register("stream_build_equals_batch", _LAST, _stream_build)
