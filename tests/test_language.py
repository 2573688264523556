"""Grammar, requests, mappings, analysis and small predicates."""

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from docsail.errors import EngineError
from docsail.functions import analysis
from docsail.functions.analysis import analyze, english_lists, english_terms, stem, tokens
from docsail.functions.scoring import quantized
from docsail.plans.compiler import Compiler, within
from docsail.plans.grammar import parse
from docsail.plans.nodes import FILTER, MUST, MUST_NOT, SHOULD, Boolean, Boost, Everything, Fuzzy, Pattern, Range, Term
from docsail.plans.requests import read_query
from docsail.schema import Mapping, document_error

MAPPING = Mapping.parse({"a": {"type": "long"}, "k": {"type": "keyword"}, "t": {"type": "text"}, "v": {"type": "vector", "dimensions": 17}})


def test_grammar():
    assert parse("f:x") == Term("f", "x") and parse(r"f:a\:b\*") == Term("f", "a:b*") and parse("*:*") == Everything()
    assert parse("a AND NOT b") == Boolean(((MUST, Term(None, "a")), (MUST_NOT, Term(None, "b"))))
    assert parse("a OR b AND c") == Boolean(((SHOULD, Term(None, "a")), (SHOULD, Boolean(((MUST, Term(None, "b")), (MUST, Term(None, "c")))))))
    assert parse("a || !b") == Boolean(((SHOULD, Term(None, "a")), (MUST_NOT, Term(None, "b"))))
    assert parse("f:(+a -b)^2.5") == Boost(Boolean(((MUST, Term("f", "a")), (MUST_NOT, Term("f", "b")))), 2.5)
    assert parse("f:[1 TO *}") == Range("f", "1", None, True, False) and parse("f:>=3") == Range("f", "3", None, True, False) and parse("f<3") == Range("f", None, "3", False, False)
    assert parse('f:{"a b" TO "c"]') == Range("f", "a b", "c", False, True) and parse('f:"x y"~2') == Term("f", "x y")
    assert parse("f:ab*") == Pattern("f", "ab.*", "ab", "ab*") and parse("f:a?b").prefix is None and parse("f:/a[bc]/") == Pattern("f", "a[bc]")
    assert parse("f:abc~1") == Fuzzy("f", "abc", 1) and parse("f:abc~") == Fuzzy("f", "abc", 2) and parse("ORacle NOTe") == Boolean(((SHOULD, Term(None, "ORacle")), (SHOULD, Term(None, "NOTe"))))


@pytest.mark.parametrize("q", ["", "  ", "(", ")", "a)", "f:", "f:[1 TO", "f:[1 2]", '"open', "a AND", "f:/x", "f:/a&b/", "^2", "a^x", "\\", " OR "])
def test_bad_query_strings(q):
    with pytest.raises(EngineError):
        parse(q)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet='ab:()[]{}"^~*?/\\+-!<>= TOANDR1', max_size=14))
def test_grammar_never_breaks(q):
    try:
        parse(q)
    except EngineError:
        pass


def test_request_errors():
    for query in (
        {}, {"bool": []}, {"bool": [{}]}, {"bool": [{"occur": "MAYBE", "queryString": {"query": "a:1"}}]}, {"queryString": {"query": "nope:1"}}, {"queryString": {"query": "word"}},
        {"queryString": {"query": "x", "skipSyntax": True}}, {"queryString": {"query": "a:1", "boost": -1}}, {"knn": {"field": "a", "queryVector": [], "k": 1}}, {"knn": {"field": "v", "queryVector": [0.0] * 17, "k": 0}},
        {"knn": {"field": "v", "queryVector": [0.0] * 17, "k": 9, "numCandidates": 5}}, {"knn": {"field": "v", "queryVector": [0.0] * 16, "k": 1}}, {"knn": {"field": "v", "queryVector": [0.0] * 17, "k": 1, "filter": {}}},
        {"bool": [{"queryString": {"query": "a:1"}}] * 1025},
    ):
        with pytest.raises(EngineError):
            read_query(query, MAPPING)
    assert read_query({"queryString": {"query": "x:y", "defaultField": "t"}}, MAPPING) == Term("t", "x y")
    assert read_query({"bool": [{"occur": "filter", "queryString": {"query": "*:*", "boost": 3}}]}, MAPPING) == Boolean(((FILTER, Everything()),))


def test_mapping_rules():
    for bad in ({}, {"a.b": {"type": "long"}}, {"_doc": {"type": "long"}}, {"x": {"type": "int"}}, {"x": {"type": "long", "analyzers": ["standard"]}}, {"x": {"type": "text", "analyzers": ["latin"]}}, {"x": {"type": "vector", "dimensions": 16}}, {"x": {"type": "vector", "dimensions": 17, "similarity": "far"}}, {"id": {"type": "long"}}):
        with pytest.raises(EngineError):
            Mapping.parse(bad)
    assert Mapping.parse(MAPPING.to_json()).to_json() == MAPPING.to_json()
    assert document_error({"id": "1", "a": 1, "k": ["x", 1], "other": None}, MAPPING) is None
    for bad in ({"id": ""}, {"a": None}, {"a": 1.5}, {"a": True}, {"k": {"x": 1}}, {"v": [1.0]}, {"t": []}, []):
        assert document_error(bad, MAPPING)


def test_analysis(spark):
    texts = ["The dog's DON'T stop, 3.14 a_b", None, "", "x" * 600, "汉字测试 word"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(*[tokens(F.col("t"), a).alias(a) for a in ("standard", "english", "korean")]).collect()
    for t, r in zip(texts, rows, strict=True):
        for a in ("standard", "english", "korean"):
            assert r[a] == (None if t is None else analyze(t, a))
    assert rows[0].english == ["dog", "don't", "stop", "3.14", "a_b"] and [len(w) for w in rows[3].standard] == [255, 255, 90] and rows[4].korean == ["汉字", "字测", "测试", "word"]
    pairs = "caresses caress ponies poni ties ti cats cat feed feed agreed agre plastered plaster motoring motor sing sing conflated conflat troubled troubl sized size hopping hop falling fall hissing hiss filing file happy happi sky sky relational relat rational ration digitizer digit vietnamization vietnam formalize formal electrical electr hopefulness hope goodness good revival reviv allowance allow adoption adopt probate probat rate rate cease ceas controll control roll roll".split()
    assert [stem(w) for w in pairs[::2]] == pairs[1::2]


WORDS = st.one_of(st.sampled_from("the dog's DOG ponies their's is’s ’s s y yy sky relational hopping filing 汉字 été sses".split()), st.text("abeiylstdngu'é", max_size=9))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.none() | st.lists(WORDS, max_size=6), max_size=8), st.integers(0, 8))
def test_english_batches_equal_lists(rows, start):
    want = [None if r is None else english_terms(r) for r in rows]
    got = english_lists(pa.array(rows, pa.list_(pa.string()))[start:])
    got.validate(full=True)
    assert got.to_pylist() == want[start:]


def test_english_batches_stem_few_words(monkeypatch):
    seen = []
    monkeypatch.setattr(analysis, "stem", lambda w: seen.append(w) or stem(w))
    words = ["running", "dog", "the", "ponies", "x" * 300]
    assert english_lists(pa.array([words] * 500, pa.list_(pa.string()))).to_pylist() == [["run", "dog", "poni", "x" * 300]] * 500
    assert len(seen) <= 3


@settings(max_examples=300, deadline=None)
@given(st.text("abeiyyt", max_size=8))
def test_stem_measures(w):
    shape = [analysis._consonant(w, i) for i in range(len(w))]
    assert analysis._measure(w) == sum(not a and b for a, b in zip(shape, shape[1:], strict=False)) and analysis._has_vowel(w) == (not all(shape))


def test_quantized_lengths(spark):
    def slow(n):
        if n < 40:
            return n
        v, bits = n - 24, (n - 24).bit_length()
        return 24 + (v >> (bits - 4) << (bits - 4))

    assert all(r.q == slow(r.id) for r in spark.range(5000).select("id", quantized(F.col("id")).alias("q")).collect())


def distance(a, b):
    """Edits with swaps of neighbours, each part of a string edited once."""
    d = {(i, j): max(i, j) for i in range(len(a) + 1) for j in range(len(b) + 1) if not i or not j}
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
    return d[len(a), len(b)]


def test_fuzzy_covers_every_edit(spark):
    import itertools

    words = ["".join(w) for n in range(6) for w in itertools.product("abc", repeat=n)]
    df = spark.createDataFrame([(w,) for w in words], "w string")
    for text in ("abca", "cab", "aab", "ab"):
        for edits in (1, 2):
            got = {r.w for r in df.where(within(F.col("w"), text, edits)).collect()}
            want = {w for w in words if distance(w, text) <= edits}
            assert want == got


CLAUSE = st.deferred(lambda: st.one_of(st.tuples(st.just("leaf"), st.integers(0, 3)), st.tuples(st.just("bool"), st.lists(st.tuples(st.sampled_from([MUST, SHOULD, MUST_NOT, FILTER]), CLAUSE), min_size=1, max_size=3))))


def model(node, value):
    """(match, score) of one row by the rules of boolean queries."""
    if node[0] == "leaf":
        return value == node[1], float(value == node[1])
    parts = [(o, *model(n, value)) for o, n in node[1]]
    needed = [m for o, m, _ in parts if o in (MUST, FILTER)]
    optional = [m for o, m, _ in parts if o == SHOULD]
    ok = (all(needed) if needed else any(optional)) and not any(m for o, m, _ in parts if o == MUST_NOT)
    return ok, sum(s for o, m, s in parts if m and o in (MUST, SHOULD))


def tree(node):
    return Range("a", str(node[1]), str(node[1])) if node[0] == "leaf" else Boolean(tuple((o, tree(n)) for o, n in node[1]))


@settings(max_examples=25, deadline=None)
@given(st.lists(CLAUSE, min_size=4, max_size=4))
def test_boolean_algebra(spark, nodes):
    df = spark.createDataFrame([(str(i), v) for i, v in enumerate([0, 1, 2, 3, None])], "id string, a bigint")
    for node in nodes:
        compiler = Compiler(df, MAPPING)
        pair = compiler.compile(tree(node))
        got = {r.id: r.s for r in compiler.relation().where(pair.match).select("id", pair.score.alias("s")).collect()}
        want = {str(i): s for i, v in enumerate([0, 1, 2, 3, None]) for ok, s in [model(node, v)] if ok}
        assert got == want
