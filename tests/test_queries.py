"""Every registered query of the engine against its SQL, and the plans of some."""

import contextlib
import io
import math

import duckdb
import pytest

import __spark_entry__
from docsail.functions.analysis import analyze
from docsail.queries import SQL, Q

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return round(v, 6)
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


@pytest.mark.parametrize("name", sorted(Q))
def test_query(spark, sf_dir, con, name):
    df = Q[name](spark, sf_dir)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=str)
    if name not in SQL:
        assert got
        return
    found = con.sql(SQL[name])
    assert sorted(found.columns) == columns
    at = [found.columns.index(c) for c in columns]
    assert got == sorted((tuple(plain(r[i]) for i in at) for r in found.fetchall()), key=str)


def test_entry(spark):
    assert __spark_entry__.entry(spark).columns == ["id", "score"]
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def plan(df):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


def test_plans_push_down_and_stop_at_top_k(spark, sf_dir):
    said = plan(Q["long_range"](spark, sf_dir))
    assert "GreaterThanOrEqual(user_id,10)" in said and "TakeOrderedAndProject" in said
    assert "ReadSchema: struct<event_id:bigint,user_id:bigint>" in said
    assert "EqualTo(event_type,click)" in plan(Q["keyword_term"](spark, sf_dir))
    said = plan(Q["datetime_range"](spark, sf_dir))
    assert "GreaterThanOrEqual(o_orderdate" in said and "Exchange" not in said
    said = plan(Q["bool_filter"](spark, sf_dir))
    assert "EqualTo(lang,en)" in said and said.count("Scan parquet") == 4  # two scans, each named twice


def test_english_analyses_a_text_once_a_scan(spark, sf_dir):
    said = plan(Q["english_bm25"](spark, sf_dir))
    nodes = [x for x in said.split("\n\n") if "regexp_extract_all(lower(" in x]
    assert len(nodes) == 2 and all(") Generate" in x for x in nodes)  # the scan for the statistics and the one for the rows
    assert int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")) <= 4 << 20


def test_english_scores(spark, sf_dir):
    texts = {str(r.doc_id): r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    score = dict.fromkeys(texts, 0.0)
    for analyzer in ("standard", "english"):
        found = {i: analyze(t or "", analyzer) for i, t in texts.items()}
        sizes = [len(x) for x in found.values() if x]
        for term in analyze("hehely thed", analyzer):
            df = sum(term in x for x in found.values())
            for i, x in found.items():
                if term in x:
                    n, over = len(x), len(x) - 24
                    kept = n if n < 40 else 24 + (over >> over.bit_length() - 4 << over.bit_length() - 4)
                    norm = 1.2 * (0.25 + 0.75 * kept * len(sizes) / sum(sizes))
                    score[i] += math.log(1 + (len(sizes) - df + 0.5) / (df + 0.5)) * x.count(term) / (x.count(term) + norm)
    want = sorted(((i, s) for i, s in score.items() if s), key=lambda x: (-x[1], x[0]))[:20]
    assert [(r.id, r.score) for r in Q["english_bm25"](spark, sf_dir).collect()] == [(i, pytest.approx(s, abs=2e-6)) for i, s in want]
