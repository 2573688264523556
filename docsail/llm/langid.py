"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Character n-grams of 1 to 4 letters are hashed to BUCKETS features. Document frequencies are counted over the whole corpus;
the weights are fitted on a bounded labelled sample by follow-the-regularised-leader with elastic-net penalties, which leaves
most of them exactly zero; a held-out part of the sample sets the temperature that calibrates the probabilities.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docsail.llm.sampling import stratified
from docsail.llm.textblocks import blocks, release

ORDERS = (1, 2, 3, 4)
BITS = 15
BUCKETS = 1 << BITS
_SMALL = 2048


@dataclass
class LangModel:
    """weights (BUCKETS, classes), intercept (classes), idf (BUCKETS), temperature; classes are sorted language names."""

    classes: list[str]
    weights: np.ndarray
    intercept: np.ndarray
    idf: np.ndarray
    temperature: float = 1.0

    def sparsity(self) -> float:
        return float((self.weights == 0).mean())


def letters(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(code points, offsets in code points) of a block of UTF-8 documents; invalid bytes become U+FFFD."""
    text = data.tobytes()
    points = np.frombuffer(text.decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    starts = np.r_[0, np.cumsum((data & 0xC0) != 0x80)]
    if starts[-1] == len(points):
        return points, starts[off]
    each = [np.frombuffer(text[a:b].decode("utf-8", "replace").encode("utf-32-le"), np.uint32) for a, b in zip(off[:-1], off[1:], strict=True)]
    return np.concatenate([*each, np.zeros(0, np.uint32)]).astype(np.uint32), np.r_[0, np.cumsum([len(x) for x in each])].astype(np.int64)


def gram_buckets(points: np.ndarray) -> list[np.ndarray]:
    """For each order the feature of the n-gram that starts at every place."""
    out, h = [], np.zeros(len(points), np.uint32)
    for n in ORDERS:
        m = len(points) - n + 1
        if m <= 0:
            out.append(np.zeros(0, np.uint16))
            continue
        h = (h[:m] + points[n - 1 :] + np.uint32(n)) * np.uint32(0x9E3779B1)
        h ^= h >> np.uint32(15)
        out.append((h >> np.uint32(32 - BITS)).astype(np.uint16))
    return out


def counted(block: tuple[np.ndarray, np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(features, counts) of each document of a block."""
    points, at = letters(*block)
    grams = gram_buckets(points)
    for a, b in zip(at[:-1], at[1:], strict=True):
        every = np.concatenate([g[a : max(a, b - n + 1)] for n, g in zip(ORDERS, grams, strict=True)])
        if len(every) < _SMALL:
            yield np.unique(every, return_counts=True)
        else:
            dense = np.bincount(every, minlength=BUCKETS)
            features = np.flatnonzero(dense)
            yield features, dense[features]


def tfidf(features: np.ndarray, counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Sublinear term frequency times inverse document frequency, of unit length."""
    x = (1 + np.log(counts)) * idf[features]
    norm = np.sqrt((x * x).sum())
    return x / norm if norm > 0 else x


def lowered(column: pa.Array) -> pa.Array:
    return pc.utf8_lower(column.cast(pa.large_string()))


def document_frequencies(docs: DataFrame) -> tuple[np.ndarray, int]:
    """(documents that hold each feature, documents with any) over every row of docs; null and empty texts have none.

    Each partition sends at most BUCKETS counts, which are summed by feature, so the result doesn't grow with the corpus.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(BUCKETS, np.int64), 0
        for batch in batches:
            for _, _, data, off, _ in blocks(lowered(batch.column(0)), 1 << 18):
                for features, _ in counted((data, off)):
                    df[features] += 1
                    n += len(features) > 0
        at = np.flatnonzero(df)
        if n:
            yield pa.record_batch({"feature": pa.array(np.r_[-1, at], pa.int32()), "n": pa.array(np.r_[n, df[at]], pa.int64())})
        release()

    rows = docs.select("text").mapInArrow(count, "feature int, n bigint").groupBy("feature").agg(F.sum("n").alias("n")).collect()
    df, total = np.zeros(BUCKETS, np.int64), 0
    for feature, n in rows:
        if feature < 0:
            total = n
        else:
            df[feature] = n
    return df, total


def smooth_idf(df: np.ndarray, total: int) -> np.ndarray:
    return (np.log((1 + total) / (1 + df)) + 1).astype(np.float64)


def train(texts: list[str], labels: list[str], idf: np.ndarray, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 0.5, epochs: int = 3, held_out: float = 0.2, seed: int = 11) -> LangModel:
    """Follow-the-regularised-leader (proximal) with elastic net, then a temperature by held-out likelihood.

    Rows with a null or empty text or a null label are skipped. With no rows there are no classes and nothing is identified.
    """
    rows = [(t, y) for t, y in zip(texts, labels, strict=True) if t and y is not None]
    classes = sorted({y for _, y in rows})
    k = len(classes)
    if k == 0:
        return LangModel([], np.zeros((BUCKETS, 0)), np.zeros(0), idf)
    column = lowered(pa.array([t for t, _ in rows], pa.string()))
    x = []
    for _, _, data, off, _ in blocks(column, 1 << 18):
        x += [(f, tfidf(f, c, idf)) for f, c in counted((data, off))]
    y = np.array([classes.index(label) for _, label in rows])
    order = np.random.default_rng(seed).permutation(len(rows))
    n_held = int(len(rows) * held_out) if len(rows) >= 10 else 0
    held, fit_rows = order[:n_held], order[n_held:]
    z, n, w = (np.zeros((BUCKETS + 1, k)) for _ in range(3))

    def scores(i: int) -> np.ndarray:
        features, values = x[i]
        return values @ w[features] + w[BUCKETS]

    for _ in range(epochs):
        for i in fit_rows:
            features, values = np.r_[x[i][0], BUCKETS], np.r_[x[i][1], 1.0]
            zi, ni = z[features], n[features]
            w[features] = np.where(np.abs(zi) <= l1, 0.0, -(zi - np.sign(zi) * l1) / ((beta + np.sqrt(ni)) / alpha + l2))
            p = softmax(values @ w[features])
            p[y[i]] -= 1
            g = values[:, None] * p[None, :]
            sigma = (np.sqrt(ni + g * g) - np.sqrt(ni)) / alpha
            z[features] += g - sigma * w[features]
            n[features] += g * g
    w[:] = np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((beta + np.sqrt(n)) / alpha + l2))
    logits = np.array([scores(i) for i in (held if len(held) else fit_rows)])
    t = calibrate(logits, y[held if len(held) else fit_rows])
    return LangModel(classes, w[:BUCKETS].copy(), w[BUCKETS].copy(), idf, t)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def calibrate(logits: np.ndarray, y: np.ndarray) -> float:
    """The temperature with the least negative log-likelihood, by golden section over its logarithm."""

    def loss(log_t: float) -> float:
        p = softmax(logits / np.exp(log_t))
        return float(-np.log(np.maximum(p[np.arange(len(y)), y], 1e-300)).mean())

    lo, hi, r = np.log(0.02), np.log(20.0), (np.sqrt(5) - 1) / 2
    for _ in range(50):
        a, b = hi - r * (hi - lo), lo + r * (hi - lo)
        lo, hi = (lo, b) if loss(a) <= loss(b) else (a, hi)
    return float(np.exp((lo + hi) / 2))


def identify(model: LangModel, column: pa.Array) -> pa.StructArray:
    """struct(lang, confidence) of every text; both null where the text is null or has no characters, or without classes."""
    names, best, none = np.array([*model.classes, ""], object), np.zeros(len(column)), np.ones(len(column), bool)
    pick = np.full(len(column), len(model.classes))
    if model.classes:
        used = np.flatnonzero((model.weights != 0).any(axis=1))
        slot = np.full(BUCKETS, len(used))
        slot[used] = np.arange(len(used))
        weights = np.r_[model.weights[used], np.zeros((1, len(model.classes)))]
        for first, _, data, off, _ in blocks(lowered(column), 1 << 18):
            for i, (features, counts) in enumerate(counted((data, off)), start=first):
                if len(features):
                    p = softmax((tfidf(features, counts, model.idf) @ weights[slot[features]] + model.intercept) / model.temperature)
                    pick[i] = p.argmax()
                    best[i], none[i] = p[pick[i]], False
    return pa.StructArray.from_arrays([pa.array(names[pick], pa.string(), mask=none), pa.array(best, pa.float64(), mask=none)], ["lang", "confidence"])


def fit(docs: DataFrame, label: str = "lang", per_class: int = 1000, **options) -> LangModel:
    """Document frequencies over all of docs; weights from about per_class labelled documents of each language.

    The sample is chosen by a hash of doc_id and bounded by per_class, so the driver's share stays constant.
    """
    df, total = document_frequencies(docs)
    rows = stratified(docs.select("doc_id", "text", label), label, "doc_id", per_class).select("doc_id", "text", label).collect()
    rows.sort(key=lambda r: (r[0], r[1] or "", r[2]))
    return train([r[1] for r in rows], [r[2] for r in rows], smooth_idf(df, total), **options)


def language(model: LangModel, text: str | Column = "text") -> Column:
    """struct(lang, confidence) as a column expression; no shuffle."""

    @F.arrow_udf("lang string, confidence double")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield identify(model, batch)
        release()

    return run(text)


def identify_documents(docs: DataFrame, model: LangModel, min_confidence: float = 0.5) -> DataFrame:
    """(doc_id, lang_pred, confidence, keep) for every row of docs.

    A null or empty text has a null language and confidence and keep = false. Null ids and repeated rows pass through; an
    empty table gives an empty result; further columns are ignored. Ties between languages go to the first by name.
    """
    found = docs.select("doc_id", language(model).alias("found"))
    keep = F.coalesce(F.col("found.confidence") >= min_confidence, F.lit(False))
    return found.select("doc_id", F.col("found.lang").alias("lang_pred"), F.col("found.confidence").alias("confidence"), keep.alias("keep"))


def keep_identified(docs: DataFrame, model: LangModel, min_confidence: float = 0.5) -> DataFrame:
    """The rows of docs whose language is identified with enough confidence, with all their columns."""
    return docs.where(F.coalesce(language(model).getField("confidence") >= min_confidence, F.lit(False)))
