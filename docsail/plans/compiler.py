"""Query trees to columns: every node becomes a (match, score) pair over one wide row.

Term statistics are one-row aggregates over the relation that is searched, joined by a broadcast of that single row, so a query is
a scan, a small aggregate and a top-k that Catalyst sees as a whole. A match may be null, which counts
as false, so that plain comparisons reach the scan as they are.
"""

from __future__ import annotations

import functools
import operator
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from docsail.errors import bad_request
from docsail.functions.analysis import analyze, english, tokens
from docsail.functions.scoring import bm25, occurrences, quantized, vector_score
from docsail.plans.nodes import FILTER, MUST, MUST_NOT, SHOULD, Boolean, Boost, Everything, Fuzzy, Match, Nearest, Node, Pattern, Range, Term
from docsail.schema import MAX_KEYWORD, Mapping, parse_instant
from docsail.session import small_batches


class Pair(NamedTuple):
    match: Column
    score: Column


def token_name(path: str, analyzer: str) -> str:
    return f"_t_{path.replace('.', '__')}_{analyzer}"


def known(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def any_of(conditions: list[Column]) -> Column:
    return functools.reduce(operator.or_, conditions, F.lit(False))


def field_column(df: DataFrame, path: str) -> Column:
    """A field's column: flattened under its dotted name, or a member of a struct."""
    return F.col(f"`{path}`") if path in df.columns else F.col(".".join(f"`{p}`" for p in path.split(".")))


class Compiler:
    """Compiles nodes against one relation; ``relation`` then has every column that the pairs refer to."""

    def __init__(self, df: DataFrame, mapping: Mapping):
        self.df, self.mapping = df, mapping
        self.tokens: dict[str, Column] = {}
        self.derived: dict[str, Column] = {}  # made from other tokens
        self.stats: dict[tuple, tuple[str, Column]] = {}
        self.nearest: list[DataFrame] = []

    def relation(self) -> DataFrame:
        df = self.df
        for found in (self.tokens, self.derived):
            if found:  # a generator, which filters aren't pushed through: every text is analysed once
                df = df.select("*", F.inline(F.array(F.struct(*[c.alias(name) for name, c in found.items()]))))
        if self.stats:
            row = df.agg(*[expr.alias(name) for name, expr in self.stats.values()])
            df = df.crossJoin(F.broadcast(row))  # one row
        for top in self.nearest:
            df = df.join(F.broadcast(top), "id", "left")  # at most 5000 rows
        return df

    def compile(self, node: Node) -> Pair:
        pair = getattr(self, "_" + type(node).__name__.lower())(node)
        return Pair(pair.match, F.coalesce(pair.score, F.lit(0.0)))

    # columns and statistics

    def _column(self, path: str) -> Column:
        return field_column(self.df, path)

    def _is_array(self, path: str) -> bool:
        return isinstance(self.df.select(self._column(path)).schema[0].dataType, ArrayType)

    def _tokens(self, path: str, analyzer: str) -> Column:
        name = token_name(path, analyzer)
        if name not in self.df.columns:
            if analyzer != "standard":
                small_batches(self.df.sparkSession)
            if analyzer == "english":
                self.derived[name] = english(self._tokens(path, "standard"))
            else:
                self.tokens[name] = tokens(self._column(path).cast("string"), analyzer)
        return F.col(name)

    def _stat(self, key: tuple, expr: Column) -> Column:
        if key not in self.stats:
            self.stats[key] = (f"_s{len(self.stats)}", expr)
        return F.col(self.stats[key][0])

    def _some(self, path: str, test) -> Column:
        """Whether any value of a keyword field passes the test; values over MAX_KEYWORD characters are not searchable."""

        def short(v: Column) -> Column:
            return (F.length(v) <= MAX_KEYWORD) & test(v)

        c = self._column(path)
        return F.exists(c, short) if self._is_array(path) else short(c.cast("string"))

    def _one(self, predicate: Column) -> Pair:
        return Pair(predicate, F.lit(1.0))

    # leaves

    def _everything(self, node: Everything) -> Pair:
        return Pair(F.lit(True), F.lit(1.0))

    def _match(self, node: Match) -> Pair:
        return self._term(Term(node.field, node.text))

    def _term(self, node: Term) -> Pair:
        kind, c = self.mapping.leaf(node.field).kind, self._column(node.field)
        if kind == "text":
            return self._words(node.field, node.text)
        if kind == "keyword":
            return self._keyword(node.field, node.text)
        if kind == "boolean":
            wanted = node.text.lower() == "true"
            match = c.cast("boolean") == F.lit(wanted) if node.text.lower() in ("true", "false") else F.lit(False)
            return Pair(match, self._flat_score(node.field, match, c.isNotNull(), c.isNotNull().cast("int"), node.text.lower()))
        if kind in ("long", "double", "datetime"):
            value = self._literal(node.field, node.text)
            if kind == "datetime":
                return self._range(Range(node.field, node.text, node.text))
            return self._one(c == value)
        raise bad_request(f"'{node.field}' of type {kind} can't be searched by value")

    def _words(self, path: str, text: str) -> Pair:
        matches, scores = [], []
        for analyzer in self.mapping.leaf(path).analyzers:
            column = self._tokens(path, analyzer)
            documents = self._stat((path, analyzer, "n"), F.sum((F.size(column) > 0).cast("double")))
            total = self._stat((path, analyzer, "len"), F.sum(F.when(F.size(column) > 0, F.size(column)).cast("double")))
            for term in analyze(text, analyzer):
                has = known(F.array_contains(column, F.lit(term)))
                frequency = self._stat((path, analyzer, "df", term), F.sum(has.cast("double")))
                matches.append(has)
                scores.append(F.when(has, bm25(occurrences(column, term), quantized(F.size(column)), documents, frequency, total)).otherwise(0.0))
        return Pair(any_of(matches), functools.reduce(operator.add, scores, F.lit(0.0)))

    def _keyword(self, path: str, text: str) -> Pair:
        c = self._column(path)
        if len(text) > MAX_KEYWORD:
            return Pair(F.lit(False), F.lit(0.0))
        match = F.array_contains(c, F.lit(text)) if self._is_array(path) else c.cast("string") == F.lit(text)
        if f"_m_{path}" in self.df.columns:  # what a scan can filter by, besides the exact test
            match = ((F.col(f"`_k_{path}`") == F.lit(text)) | (F.col(f"`_m_{path}`") == F.lit(True))) & match
        if self._is_array(path):
            values = F.size(F.array_distinct(F.filter(c, lambda v: F.length(v) <= MAX_KEYWORD)))
        else:
            values = F.when(F.length(c.cast("string")) <= MAX_KEYWORD, 1).otherwise(0)
        return Pair(match, self._flat_score(path, match, values > 0, F.when(values > 0, values).otherwise(0), text))

    def _flat_score(self, path: str, match: Column, present: Column, values: Column, text: str) -> Column:
        """BM25 of a field without lengths: every value counts as one word of a one-word field."""
        documents = self._stat((path, "n"), F.sum(known(present).cast("double")))
        total = self._stat((path, "len"), F.sum(values.cast("double")))
        frequency = self._stat((path, "df", text), F.sum(known(match).cast("double")))
        return bm25(F.lit(1.0), F.lit(1.0), documents, frequency, total)

    def _literal(self, path: str, text: str) -> Column:
        kind = self.mapping.leaf(path).kind
        try:
            if kind == "datetime":
                return F.lit(parse_instant(text).isoformat()).cast("timestamp")
            return F.lit(int(text)).cast("bigint") if kind == "long" else F.lit(float(text))
        except ValueError:
            raise bad_request(f"'{text}' is not a {kind}") from None

    def _range(self, node: Range) -> Pair:
        kind = self.mapping.leaf(node.field).kind
        if kind in ("keyword", "text"):
            low, high = (None if b is None else F.lit(b) for b in (node.low, node.high))
        elif kind in ("long", "double", "datetime"):
            low, high = (None if b is None else self._literal(node.field, b) for b in (node.low, node.high))
        else:
            raise bad_request(f"'{node.field}' of type {kind} has no ranges")

        def inside(v: Column) -> Column:
            out = v.isNotNull()
            if low is not None:
                out = out & (v >= low if node.with_low else v > low)
            if high is not None:
                out = out & (v <= high if node.with_high else v < high)
            return out

        if kind == "keyword":
            return self._one(self._some(node.field, inside))
        if kind == "text":
            return self._each_analyzer(node.field, inside)
        if kind == "datetime":  # whole milliseconds against the raw column, so that the scan can use the bounds
            tick = F.expr("interval 1 millisecond")
            c, out = self._column(node.field), self._column(node.field).isNotNull()
            if low is not None:
                out = out & (c >= (low if node.with_low else low + tick))
            if high is not None:
                out = out & (c < (high + tick if node.with_high else high))
            return self._one(out)
        return self._one(inside(self._column(node.field)))

    def _each_analyzer(self, path: str, test) -> Pair:
        pairs = [F.exists(self._tokens(path, a), test) for a in self.mapping.leaf(path).analyzers]
        return Pair(any_of(pairs), functools.reduce(operator.add, [F.coalesce(p, F.lit(False)).cast("double") for p in pairs]))

    def _pattern(self, node: Pattern) -> Pair:
        def fits(v: Column) -> Column:
            if node.prefix is not None:
                return F.startswith(v, F.lit(node.prefix))
            return F.rlike(v, F.lit(f"(?s)^({node.expression})$"))

        kind = self.mapping.leaf(node.field).kind
        if node.plain == "*":
            return self._one(self._column(node.field).isNotNull())
        if kind == "keyword":
            return self._one(self._some(node.field, fits))
        if kind == "text":
            return self._each_analyzer(node.field, fits)
        raise bad_request(f"'{node.field}' of type {kind} has no patterns")

    def _fuzzy(self, node: Fuzzy) -> Pair:
        kind = self.mapping.leaf(node.field).kind
        if kind == "text":
            return self._words(node.field, node.text)
        if kind != "keyword" or node.edits == 0:
            return self._term(Term(node.field, node.text))
        return self._one(self._some(node.field, lambda v: within(v, node.text, node.edits)))

    # composition

    def _boost(self, node: Boost) -> Pair:
        pair = self.compile(node.node)
        return Pair(pair.match, pair.score * F.lit(node.factor))

    def _boolean(self, node: Boolean) -> Pair:
        pairs = [(occur, self.compile(n)) for occur, n in node.clauses]
        needed = [p.match for o, p in pairs if o in (MUST, FILTER)]
        optional = [p for o, p in pairs if o == SHOULD]
        if not needed and not optional:
            return Pair(F.lit(False), F.lit(0.0))
        match = functools.reduce(operator.and_, needed) if needed else any_of([p.match for p in optional])
        for occur, p in pairs:
            if occur == MUST_NOT:
                match = match & ~known(p.match)
        scores = [p.score for o, p in pairs if o == MUST] + [F.when(p.match, p.score).otherwise(0.0) for p in optional]
        return Pair(match, functools.reduce(operator.add, scores, F.lit(0.0)))

    def _nearest(self, node: Nearest) -> Pair:
        name = f"_k{len(self.nearest)}"
        self.nearest.append(nearest(self.df, self.mapping, node).withColumnRenamed("score", name))
        return Pair(F.col(name).isNotNull(), F.col(name))


def within(v: Column, text: str, edits: int) -> Column:
    """Whether v is at most 1 or 2 edits from text, a swap of neighbours being one edit and no character edited twice.

    Beside plain edits that is a swap, with the other edit wholly before or wholly after it, or two swaps.
    """
    swaps = [(text[:i], text[i + 1] + text[i], text[i + 2 :]) for i in range(len(text) - 1) if text[i] != text[i + 1]]
    tests = [F.levenshtein(v, F.lit(text)) <= edits]
    exact = {a + s + b for a, s, b in swaps}
    if edits == 2:
        exact |= {a + s + b[:j] + b[j + 1] + b[j] + b[j + 2 :] for a, s, b in swaps for j in range(len(b) - 1)}
        for a, s, b in swaps:
            head, tail = a + s, s + b
            tests.append(F.startswith(v, F.lit(head)) & (F.levenshtein(F.substring(v, len(head) + 1, 1 << 30), F.lit(b)) <= 1))
            tests.append(F.endswith(v, F.lit(tail)) & (F.levenshtein(F.substring(v, F.lit(1), F.length(v) - len(tail)), F.lit(a)) <= 1))
    if exact:
        tests.append(v.isin(sorted(exact)))
    return (F.length(v) >= len(text) - edits) & (F.length(v) <= len(text) + edits) & any_of(tests)


def nearest(df: DataFrame, mapping: Mapping, node: Nearest) -> DataFrame:
    """(id, score) of the k rows with the best similarity among those that pass the filter; ties go to the least id."""
    if node.filter is not None:
        inner = Compiler(df, mapping)
        match = inner.compile(node.filter).match
        df = inner.relation().where(match)
    column = field_column(df, node.field)
    score = vector_score(column, list(node.vector), mapping.leaf(node.field).similarity)
    return df.where(column.isNotNull()).select("id", score.alias("score")).orderBy(F.desc("score"), "id").limit(node.k)
