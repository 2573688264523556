"""Relevance in column algebra: BM25 with quantised lengths, and scores of vector similarities."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

K1, B = 1.2, 0.75


def quantized(length: Column) -> Column:
    """A field length as one byte keeps it: exact below 40, beyond that the 4 leading bits of what exceeds 24."""
    over = (length - 24).cast("bigint")
    unit = F.pow(F.lit(2.0), F.length(F.bin(F.greatest(over, F.lit(1)))) - 4)
    return F.when(length < 40, length.cast("double")).otherwise(24 + F.floor(over / unit) * unit)


def idf(documents: Column, frequency: Column) -> Column:
    return F.log(1 + (documents - frequency + 0.5) / (frequency + 0.5))


def bm25(tf: Column, length: Column, documents: Column, frequency: Column, total: Column) -> Column:
    """documents that have the field, those with the term, and the field's length summed over documents; tf is above 0.

    tf is written once, as counting a term goes through all tokens.
    """
    norm = K1 * (1 - B + B * length / (total / documents))
    return idf(documents, frequency) / (1 + norm / tf)


def occurrences(tokens: Column, term: str) -> Column:
    def same(x: Column) -> Column:
        return x == F.lit(term)

    return F.size(F.filter(tokens, same)).cast("double")


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda total, x: total + x)


def dot(v: Column, q: list[float]) -> Column:
    return _sum(F.zip_with(v.cast("array<double>"), F.lit(q).cast("array<double>"), lambda x, y: x * y))


def vector_score(v: Column, q: list[float], similarity: str) -> Column:
    """A score that grows with the similarity and is never negative; null for a null vector."""
    q = [float(x) for x in q]
    if similarity == "l2_norm":
        return 1 / (1 + _sum(F.zip_with(v.cast("array<double>"), F.lit(q).cast("array<double>"), lambda x, y: (x - y) * (x - y))))
    product = dot(v, q)
    if similarity == "dot_product":
        return (1 + product) / 2
    if similarity == "max_inner_product":
        return F.when(product < 0, 1 / (1 - product)).otherwise(product + 1)
    size = F.sqrt(_sum(F.transform(v.cast("array<double>"), lambda x: x * x))) * math.sqrt(sum(x * x for x in q))
    return (1 + F.when(size > 0, product / size).otherwise(0.0)) / 2
