"""Best-fit packing of documents into fixed-size training sequences, by patterns fitted with non-negative least squares.

Only the histogram of exact lengths reaches the driver: at most ``capacity`` counts. Patterns of few documents that fill a
sequence (to 1/256) are enumerated over the HEAVY lengths that hold most tokens, with a sequence of repeats for each; their repeat
counts are fitted to the histogram, rounded down to the supply, and all that is left over is packed best-fit by exact length, into
the patterns' gaps first. The plan is a table of some thousand rank intervals, whatever the corpus size: a document's rank among
those of its length says which sequence, slot and offset it has.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docsail.session import Workspace

CAPACITY = 2048
HEAVY = 96
MAX_DOCS = 3
_PER_RANKING = 500_000


def patterns(lengths: np.ndarray, capacity: int, max_docs: int = MAX_DOCS) -> np.ndarray:
    """(patterns, lengths) multiplicities of ascending lengths: multisets of up to max_docs of them that fill a sequence to within
    capacity / 256, the last being the longest that fits; and as many of every length as fit, with one of the rest's length."""
    slack, found = capacity // 256, set()
    known = [int(x) for x in lengths]

    def longest(limit: int) -> int | None:
        at = int(np.searchsorted(lengths, limit, side="right")) - 1
        return known[at] if at >= 0 else None

    def extend(parts: tuple[int, ...], left: int) -> None:
        last = longest(left)
        if last is not None and left - last <= slack and (not parts or last >= parts[-1]):
            found.add((*parts, last))
        if len(parts) + 1 < max_docs:
            for q in known:
                if q <= left and (not parts or q >= parts[-1]) and left - q >= q:
                    extend((*parts, q), left - q)

    extend((), capacity)
    for q in known:
        rest, many = capacity % q, capacity // q
        piece = longest(rest) if rest else None
        if piece is not None and rest - piece <= slack:
            found.add((piece,) + (q,) * many)
        elif many and rest <= slack:
            found.add((q,) * many)
    place = {q: i for i, q in enumerate(known)}
    out = np.zeros((len(found), len(known)), np.int64)
    for i, parts in enumerate(sorted(found)):
        np.add.at(out[i], [place[q] for q in parts], 1)
    return out


def nnls(a: np.ndarray, b: np.ndarray, tolerance: float = 1e-9) -> np.ndarray:
    """x >= 0 with the least |a x - b|, by the active-set method of Lawson and Hanson on the normal equations.

    An error where 100 steps a column don't reach it.
    """
    n = a.shape[1]
    gram, target = a.T @ a, a.T @ b
    x, free = np.zeros(n), np.zeros(n, bool)
    ridge = 1e-10 * max(1e-300, np.trace(gram) / max(1, n))
    limit = tolerance * max(1.0, np.abs(target).max(initial=0))
    for _ in range(100 * n + 1):
        slope = target - gram @ x
        slope[free] = -np.inf
        if free.all() or slope.max() <= limit:
            return x
        free[slope.argmax()] = True
        while True:
            at = np.flatnonzero(free)
            s = np.linalg.solve(gram[np.ix_(at, at)] + ridge * np.eye(len(at)), target[at])
            if (s > 0).all():
                x[:] = 0
                x[at] = s
                break
            low = s <= 0
            step = np.min(x[at][low] / np.maximum(x[at][low] - s[low], 1e-300))
            x[at] += step * (s - x[at])
            x[at[(x[at] <= 1e-12 * max(1.0, x.max())) & low]] = 0
            free[at] = x[at] > 0
            if not free.any():
                break
    raise RuntimeError("the least squares of the patterns didn't converge")


@dataclass
class Plan:
    """intervals: (length, first rank, end rank, first bin, pieces of the length in a bin, first slot, first offset).

    ``spaces[s]`` lists runs of bins with s tokens of room: (first bin, bins, slots used).
    """

    capacity: int
    intervals: list[tuple[int, int, int, int, int, int, int]] = field(default_factory=list)
    bins: int = 0

    def __post_init__(self) -> None:
        self.spaces: list[list[tuple[int, int, int]]] = [[] for _ in range(self.capacity + 1)]
        self.open = np.zeros(self.capacity + 1, bool)

    def _room(self, space: int, run: tuple[int, int, int]) -> None:
        if space:
            self.spaces[space].append(run)
            self.open[space] = True

    def use(self, lengths: np.ndarray, pattern: np.ndarray, repeats: int, taken: np.ndarray) -> None:
        """``repeats`` new bins, each with this pattern."""
        slot = start = 0
        for q, m in [(int(q), int(m)) for q, m in zip(lengths, pattern, strict=True) if m][::-1]:
            self.intervals.append((q, int(taken[q]), int(taken[q] + repeats * m), self.bins, m, slot, start))
            taken[q] += repeats * m
            slot, start = slot + m, start + m * q
        self._room(self.capacity - start, (self.bins, repeats, slot))
        self.bins += repeats

    def fill(self, length: int, count: int, taken: np.ndarray) -> None:
        """Puts pieces of one length into the bins with the least room that takes them, and into new bins when there are none."""
        while count > 0:
            fits = np.flatnonzero(self.open[length:])
            if len(fits) == 0:
                fresh = -(-count // (self.capacity // length))
                self._room(self.capacity, (self.bins, fresh, 0))
                self.bins += fresh
                continue
            space = length + int(fits[0])
            first, bins, slots = self.spaces[space].pop()
            many = min(space // length, count)
            used = min(bins, count // many)
            self.intervals.append((length, int(taken[length]), int(taken[length] + used * many), first, many, slots, self.capacity - space))
            taken[length] += used * many
            count -= used * many
            if bins > used:
                self.spaces[space].append((first + used, bins - used, slots))
            self.open[space] = bool(self.spaces[space])
            self._room(space - many * length, (first, used, slots + many))


def plan(counts: np.ndarray, max_docs: int = MAX_DOCS, heavy: int = HEAVY) -> Plan:
    """Packs counts[q] documents of each length q = 1 .. capacity; every document gets a place.

    Patterns can take short documents that would have filled gaps of long ones, so the plan is also made with the patterns of few
    documents alone and with none, and the one of fewest bins is taken: it never needs more than best-fit by exact length.
    """
    capacity = len(counts) - 1
    mass = counts * np.arange(capacity + 1)
    lengths = np.sort(np.argsort(-mass, kind="stable")[: min(heavy, int((mass > 0).sum()))])
    forms = patterns(lengths, capacity, max_docs)
    few = forms[forms.sum(axis=1) <= max_docs]
    return min((_fitted(counts, lengths, f) for f in (forms, few, forms[:0])), key=lambda made: made.bins)


def _fitted(counts: np.ndarray, lengths: np.ndarray, forms: np.ndarray) -> Plan:
    capacity = len(counts) - 1
    left, taken, out = counts.astype(np.int64).copy(), np.zeros(len(counts), np.int64), Plan(capacity)
    if len(forms):
        weight = np.sqrt(lengths / capacity)  # what stays over of a short length fills gaps; of a long one it can't
        scale = float(left[lengths].max())
        x = nnls((forms * weight).T.astype(float), left[lengths] * weight / scale) * scale
        for i in np.argsort(-x, kind="stable"):
            used = forms[i] > 0
            repeats = min(int(np.floor(x[i] + 1e-6)), int((left[lengths[used]] // forms[i][used]).min()))
            if repeats > 0:
                out.use(lengths, forms[i], repeats, taken)
                left[lengths] -= repeats * forms[i]
    for q in range(capacity, 0, -1):
        out.fill(q, int(left[q]), taken)
    return out


def word_count(text: str | Column = "text") -> Column:
    return F.regexp_count(text, F.lit(r"\S+"))


def _local(spark: SparkSession, rows: list[tuple], names: list[str]) -> DataFrame:
    """Rows of integers, the first an int and the others bigints, as a local relation: no executor starts Python workers to read it."""
    columns = zip(*rows, strict=True) if rows else [()] * len(names)
    return spark.createDataFrame(pa.table({n: pa.array(x, pa.int64() if i else pa.int32()) for i, (n, x) in enumerate(zip(names, columns, strict=True))}))


def _placed(spark: SparkSession, rows: DataFrame, capacity: int, max_docs: int) -> DataFrame:
    """(doc_id, body, piece, bin, slot, start, n_tokens, doc_start) of rows (doc_id, spread, n, body): a row for every piece.

    ``spread`` deals the rows out to rankings and orders those of one doc_id. The rows are evaluated twice, first for their
    lengths alone, and must be the same both times.
    """
    work = Workspace(spark)
    shards = 1 + rows.select(F.lit(1)).count() // _PER_RANKING
    full, rest = F.floor(F.col("n") / capacity), F.pmod("n", F.lit(capacity)).cast("int")
    shard = F.pmod(F.xxhash64("doc_id", "spread"), F.lit(shards))
    rows = rows.where("n > 0").withColumns({"full": full, "rest": rest, "shard": shard})

    groups = work.save(rows.groupBy("rest", "shard").agg(F.count("*").alias("rows"), F.sum("full").alias("fulls")), "lengths")
    counts, bases, wholes = np.zeros(capacity + 1, np.int64), [], 0
    for row in groups.groupBy("rest").agg(F.sum("rows"), F.sum("fulls")).orderBy("rest").toLocalIterator():
        counts[row[0]] = row[1] if row[0] else 0
        bases.append((row[0], wholes))
        wholes += row[2]
    made = plan(counts, max_docs)

    before = Window.partitionBy("rest").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # a row a shard
    ahead = groups.select("rest", "shard", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}_ahead") for c in ("rows", "fulls")])
    base = F.broadcast(_local(spark, bases, ["rest", "base"]))  # a row a length
    spots = ["at", "lo", "hi", "first_bin", "many", "first_slot", "first_start"]
    spots = F.broadcast(_local(spark, made.intervals, spots))  # some thousand rows at most, whatever the corpus

    within = Window.partitionBy("rest", "shard").orderBy("doc_id", "spread")
    running = within.rowsBetween(Window.unboundedPreceding, -1)
    ranked = rows.withColumns({"nth": F.row_number().over(within) - 1, "sum": F.coalesce(F.sum("full").over(running), F.lit(0))})
    ranked = ranked.join(ahead, ["rest", "shard"]).join(base, "rest")
    rank = F.col("nth") + F.col("rows_ahead")
    ranked = ranked.select("doc_id", "body", "full", "rest", rank.alias("rank"), (F.lit(made.bins) + F.col("base") + F.col("fulls_ahead") + F.col("sum")).alias("first"))
    placed = ranked.join(spots, (F.col("rest") == F.col("at")) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi")), "left")
    nth, zero = F.col("rank") - F.col("lo"), F.lit(0).cast("bigint")

    def piece(number: Column, bin_: Column, slot: Column, start: Column, n: Column) -> Column:
        return F.struct(number.alias("piece"), bin_.alias("bin"), slot.cast("int").alias("slot"), start.alias("start"), n.cast("bigint").alias("n_tokens"), (number * capacity).alias("doc_start"))

    in_bin = F.pmod(nth, "many")
    last = piece(F.col("full"), F.col("first_bin") + F.floor(nth / F.col("many")), F.col("first_slot") + in_bin, F.col("first_start") + in_bin * F.col("rest"), F.col("rest"))
    whole = F.transform(F.sequence(zero, F.col("full") - 1), lambda k: piece(k, F.col("first") + k, F.lit(0), zero, F.lit(capacity)))
    none = F.slice(F.array(last), 1, 0)
    pieces = F.concat(F.when(F.col("full") > 0, whole).otherwise(none), F.when(F.col("rest") > 0, F.array(last)).otherwise(none))
    return placed.select("doc_id", "body", F.explode(pieces).alias("at")).select("doc_id", "body", "at.*")


def pack(spark: SparkSession, docs: DataFrame, length: Column | None = None, capacity: int = CAPACITY, max_docs: int = MAX_DOCS) -> DataFrame:
    """(doc_id, piece, bin, slot, start, n_tokens, doc_start): where every token of every document goes.

    ``length`` counts a document's tokens (words by default). A document longer than ``capacity`` is cut into full pieces,
    which have a bin each, and a rest; rests and short documents share bins. ``start`` is the offset in the bin, ``doc_start``
    the one in the document. Null and empty texts have no tokens and no rows. Null ids and repeated rows are documents like any
    other. An empty table gives no rows; further columns are ignored.
    """
    n = F.coalesce((word_count() if length is None else length).cast("bigint"), F.lit(0))
    rows = docs.select("doc_id", F.monotonically_increasing_id().alias("spread"), n.alias("n"), F.lit(None).cast("string").alias("body"))
    return _placed(spark, Workspace(spark).save(rows, "rows"), capacity, max_docs).drop("body")


def _sequences(pieces: DataFrame, body: Column, name: str) -> DataFrame:
    """One row a bin, its pieces in order as parallel arrays."""
    one = F.struct("slot", "doc_id", "start", "n_tokens", "doc_start", body.alias("part"))
    bins = pieces.select("bin", "n_tokens", one.alias("one")).repartition("bin").groupBy("bin")
    bins = bins.agg(F.sum("n_tokens").alias("n_tokens"), F.sort_array(F.collect_list("one")).alias("all"))
    return bins.select("bin", "n_tokens", F.col("all.doc_id").alias("doc_ids"), F.col("all.start").alias("starts"), F.col("all.doc_start").alias("doc_starts"), F.col("all.part").alias(name))


def pack_words(spark: SparkSession, docs: DataFrame, capacity: int = CAPACITY, max_docs: int = MAX_DOCS) -> DataFrame:
    """(bin, n_tokens, doc_ids, starts, doc_starts, texts): the training sequences of all texts, a token being a word.

    A row is one sequence of at most ``capacity`` words: the documents in it, where each starts in the sequence and from which of
    its words on it is there, and its words, joined by single spaces. Long documents, nulls, repeats and empty tables as in pack.
    """
    spread = F.xxhash64("text")
    rows = docs.select("doc_id", spread.alias("spread"), F.coalesce(word_count().cast("bigint"), F.lit(0)).alias("n"), F.col("text").alias("body"))
    pieces = _placed(spark, rows, capacity, max_docs)
    words = F.split(F.regexp_replace("body", r"^\s+", ""), r"\s+")
    part = F.array_join(F.slice(words, F.col("doc_start") + 1, F.col("n_tokens")), " ")
    return _sequences(pieces, part, "texts")


def pack_tokens(spark: SparkSession, docs: DataFrame, capacity: int = CAPACITY, max_docs: int = MAX_DOCS) -> DataFrame:
    """(bin, n_tokens, doc_ids, starts, doc_starts, tokens): the training sequences of docs (doc_id, tokens array<int>).

    ``tokens`` is the sequence itself, the documents' ids one after the other; the rest is as in pack_words.
    """
    rows = docs.select("doc_id", F.monotonically_increasing_id().alias("spread"), F.coalesce(F.size("tokens"), F.lit(0)).cast("bigint").alias("n"), F.col("tokens").alias("body"))
    pieces = _placed(spark, Workspace(spark).save(rows, "tokens"), capacity, max_docs)
    found = _sequences(pieces, F.slice("body", F.col("doc_start") + 1, F.col("n_tokens")), "tokens")
    return found.withColumn("tokens", F.flatten("tokens"))


def efficiency(packed: DataFrame, capacity: int = CAPACITY) -> float:
    """The share of the used bins' space that holds tokens; 1 for no bins."""
    tokens, bins = packed.agg(F.sum("n_tokens"), F.countDistinct("bin")).first()
    return tokens / (bins * capacity) if bins else 1.0
