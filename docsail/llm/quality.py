"""Quality classifier: a byte-level convolutional network in numpy.

A document's UTF-8 bytes are cut into overlapping chunks that together cover all of it. Learned filters slide over each
chunk, their rectified responses are max-pooled within the chunk, and the chunk vectors' mean and maximum feed one
logistic unit: one probability for the whole document.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docsail.llm.sampling import stratified
from docsail.llm.textblocks import blocks, release

WIDTH = 6
CHUNK = 512
STRIDE = 384
PART = 1 << 16


@dataclass
class ByteCNN:
    """embed (256, d), filters (WIDTH, d, f), bias (f), head (2 f), offset; prior is used when there was nothing to learn."""

    embed: np.ndarray
    filters: np.ndarray
    bias: np.ndarray
    head: np.ndarray
    offset: float
    prior: float | None = None

    def tables(self) -> np.ndarray:
        """(WIDTH, 256, f): what a byte at each place in the window adds to every filter."""
        return np.einsum("bd,wdf->wbf", self.embed, self.filters).astype(np.float32)

    def pair_tables(self) -> np.ndarray:
        """(WIDTH / 2, 65536, f): the same for two neighbouring bytes, which halves the look-ups."""
        t = self.tables()
        return np.ascontiguousarray((t[0::2, :, None, :] + t[1::2, None, :, :]).reshape(WIDTH // 2, 65536, -1))


def chunk_spans(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, start, end) of the chunks that cover documents of these byte lengths; none for an empty document."""
    n = np.where(lengths > CHUNK, -(-(lengths - CHUNK) // STRIDE) + 1, (lengths > 0).astype(np.int64))
    doc = np.repeat(np.arange(len(lengths)), n)
    nth = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
    start = nth * STRIDE
    return doc, start, np.minimum(start + CHUNK, lengths[doc])


def padded(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The documents with WIDTH - 1 zero bytes after each, and where each starts, so that windows don't leave a document."""
    lengths = np.diff(off)
    start = off[:-1] + np.arange(len(lengths)) * (WIDTH - 1)
    out = np.zeros(len(data) + len(lengths) * (WIDTH - 1) + WIDTH, np.uint8)
    out[np.arange(len(data)) + np.repeat(np.arange(len(lengths)) * (WIDTH - 1), lengths)] = data
    return out, start


def pooled(model: ByteCNN, data: np.ndarray, off: np.ndarray, pair: np.ndarray) -> np.ndarray:
    """(documents, 2 f): mean and maximum over a document's chunks of the chunks' max-pooled responses.

    Responses are held for PART bytes at a time, so the memory doesn't grow with a document's length.
    """
    lengths = np.diff(off)
    text, at = padded(data, off)
    doc, start, end = chunk_spans(lengths)
    f = pair.shape[2]
    vectors = np.zeros((len(lengths), 2 * f), np.float32)
    if len(doc) == 0:
        return vectors
    begin, end = at[doc] + start, at[doc] + end
    top = np.empty((len(doc), f), np.float32)
    a = 0
    while a < len(doc):
        b = max(a + 1, int(np.searchsorted(begin, begin[a] + PART)))
        first, n = begin[a], end[b - 1] - begin[a]
        part = text[first : first + n + WIDTH - 1]
        two = part[:-1].astype(np.int32) << 8 | part[1:]
        score = np.take(pair[0], two[:n], axis=0)
        for j in range(1, WIDTH // 2):
            score += np.take(pair[j], two[2 * j : 2 * j + n], axis=0)
        bounds = np.empty(2 * (b - a), np.int64)
        bounds[0::2], bounds[1::2] = begin[a:b] - first, end[a:b] - first
        top[a:b] = np.maximum.reduceat(score, bounds[:-1], axis=0)[::2]
        a = b
    top = np.maximum(top + model.bias, 0)
    first = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
    count = np.diff(np.r_[first, len(doc)])
    vectors[doc[first], :f] = np.add.reduceat(top, first, axis=0) / count[:, None]
    vectors[doc[first], f:] = np.maximum.reduceat(top, first, axis=0)
    return vectors


def predict(model: ByteCNN, column: pa.Array, pair: np.ndarray | None = None) -> pa.Array:
    """Probability of good quality for every text: null for a null text, 0 for an empty one."""
    out = np.zeros(len(column))
    mask = np.zeros(len(column), bool)
    if pair is None and model.prior is None:
        pair = model.pair_tables()
    for first, end, data, off, valid in blocks(column, 1 << 17):
        if model.prior is not None:
            p = np.full(end - first, model.prior)
        else:
            z = pooled(model, data, off, pair) @ model.head + model.offset
            p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        out[first:end] = np.where(np.diff(off) > 0, p, 0.0)
        mask[first:end] = ~valid
    return pa.array(out, pa.float64(), mask=mask)


def train(texts: list[str], labels: list[int], filters: int = 12, dim: int = 6, epochs: int = 8, batch: int = 32, rate: float = 0.01, seed: int = 7) -> ByteCNN:
    """Fits the network by Adam on whole texts; texts that are null or empty are skipped.

    With no rows, or rows of one class only, there is nothing to separate: the model then answers that class (1 for none).
    """
    rows = [(t.encode(), int(y)) for t, y in zip(texts, labels, strict=True) if t and y is not None]
    classes = {y for _, y in rows}
    rng = np.random.default_rng(seed)
    p = {
        "embed": rng.normal(0, 0.5, (256, dim)),
        "filters": rng.normal(0, 0.35, (WIDTH, dim, filters)),
        "bias": np.zeros(filters),
        "head": rng.normal(0, 0.1, 2 * filters),
        "offset": np.zeros(1),
    }
    if len(classes) < 2:
        return ByteCNN(p["embed"], p["filters"], p["bias"], p["head"], 0.0, prior=float(max(classes, default=1)))
    m, v = ({k: np.zeros_like(x) for k, x in p.items()} for _ in range(2))
    weight = {y: len(rows) / (len(classes) * sum(z == y for _, z in rows)) for y in classes}
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for lo in range(0, len(order), batch):
            pick = [rows[i] for i in order[lo : lo + batch]]
            grad = _gradient(p, [t for t, _ in pick], np.array([y for _, y in pick], float), np.array([weight[y] for _, y in pick]))
            step += 1
            for k, g in grad.items():
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                p[k] -= rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    return ByteCNN(p["embed"], p["filters"], p["bias"].astype(np.float32), p["head"].astype(np.float32), float(p["offset"][0]))


def _gradient(p: dict, texts: list[bytes], y: np.ndarray, weight: np.ndarray) -> dict:
    data = np.frombuffer(b"".join(texts), np.uint8)
    off = np.r_[0, np.cumsum([len(t) for t in texts])].astype(np.int64)
    text, at = padded(data, off)
    doc, start, end = chunk_spans(np.diff(off))
    begin, size = at[doc] + start, end - start
    table = np.einsum("bd,wdf->wbf", p["embed"], p["filters"]).astype(np.float32)
    f = table.shape[2]
    best, raw = np.empty((len(doc), f), np.int64), np.empty((len(doc), f))
    place = np.arange(CHUNK)
    for a in range(0, len(doc), 128):
        at_chunk, inside = begin[a : a + 128, None] + place, place < size[a : a + 128, None]
        score = np.zeros((*at_chunk.shape, f), np.float32)
        for j in range(WIDTH):
            score += table[j][text[np.where(inside, at_chunk + j, 0)]]
        score[~inside] = -np.inf
        which = score.argmax(axis=1)
        best[a : a + 128] = begin[a : a + 128, None] + which
        raw[a : a + 128] = np.take_along_axis(score, which[:, None, :], axis=1)[:, 0, :]
    raw += p["bias"]
    top = np.maximum(raw, 0)
    n_docs = len(texts)
    count = np.bincount(doc, minlength=n_docs)
    mean = np.zeros((n_docs, f))
    np.add.at(mean, doc, top)
    mean /= count[:, None]
    first = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
    highest = np.maximum.reduceat(top, first, axis=0)
    vector = np.concatenate([mean, highest], axis=1)
    z = vector @ p["head"] + p["offset"][0]
    dz = weight * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) / n_docs
    d_mean = (dz[:, None] * p["head"][:f] / count[:, None])[doc]
    at_top = (top == highest[doc]).astype(float)
    at_top /= np.add.reduceat(at_top, first, axis=0)[doc]  # chunks that tie for the maximum share its gradient
    d_top = d_mean + at_top * dz[doc][:, None] * p["head"][f:]
    d_top[raw <= 0] = 0
    g = {"head": vector.T @ dz + 1e-4 * p["head"], "offset": np.array([dz.sum()]), "bias": d_top.sum(0)}
    g["filters"], g["embed"] = np.zeros_like(p["filters"]), np.zeros_like(p["embed"])
    for j in range(WIDTH):
        byte = text[best + j]
        flat = np.bincount((byte.astype(np.int64) * f + np.arange(f)).ravel(), d_top.ravel(), 256 * f).reshape(256, f)
        g["filters"][j] = p["embed"].T @ flat
        g["embed"] += flat @ p["filters"][j].T
    return g


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", per_class: int = 1000, **options) -> ByteCNN:
    """Trains on a bounded sample: about per_class labelled documents of each class, chosen by a hash of doc_id.

    The bound keeps the driver's share constant however large the corpus is; scoring always covers every document.
    """
    sample = stratified(labels.select("doc_id", label), label, "doc_id", per_class).dropDuplicates(["doc_id", label])
    rows = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select("doc_id", "text", label).collect()
    rows.sort(key=lambda r: (r[0], r[1] or ""))
    return train([r[1] for r in rows], [r[2] for r in rows], **options)


def probability(model: ByteCNN, text: str | Column = "text") -> Column:
    """The network as a column expression: one pass over the text, no shuffle."""

    @F.arrow_udf("double")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        pair = model.pair_tables() if model.prior is None else None
        for batch in batches:
            yield predict(model, batch, pair)
        release()

    return score(text)


def score_documents(docs: DataFrame, model: ByteCNN, threshold: float = 0.5) -> DataFrame:
    """(doc_id, quality_prob, keep) for every row of docs.

    A null text has a null probability and keep = false; an empty text has probability 0. Null ids and repeated rows pass
    through as they are; an empty table gives an empty result; columns of docs other than doc_id and text are ignored.
    """
    scored = docs.select("doc_id", probability(model).alias("quality_prob"))
    return scored.select("doc_id", "quality_prob", F.coalesce(F.col("quality_prob") >= threshold, F.lit(False)).alias("keep"))


def keep_good(docs: DataFrame, model: ByteCNN, threshold: float = 0.5) -> DataFrame:
    """The rows of docs whose probability reaches the threshold, with all their columns; null texts go."""
    return docs.where(F.coalesce(probability(model) >= threshold, F.lit(False)))
