"""Bounded, repeatable samples of labelled rows for fitting classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_SPACE = 1 << 30


def stratified(rows: DataFrame, label: str, key: str, per_class: int) -> DataFrame:
    """About per_class rows of each non-null label, by a hash of the key: the same rows on every run and partitioning.

    Classes with fewer rows stay whole. Rows with a null label or key are left out.
    """
    rows = rows.where(F.col(label).isNotNull() & F.col(key).isNotNull())
    counts = {r[0]: r[1] for r in rows.groupBy(label).count().collect()}
    keep: Column = F.lit(False)
    place = F.pmod(F.xxhash64(F.col(key), F.lit("sample")), F.lit(_SPACE))
    for value, n in sorted(counts.items(), key=lambda kv: str(kv[0])):
        keep = keep | ((F.col(label) == F.lit(value)) & (place < F.lit(int(_SPACE * min(1.0, per_class / n)))))
    return rows.where(keep)
