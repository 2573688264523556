"""N-gram Jaccard join: a MinHash LSH forest, then exact verification.

Every document has TREES labels of DEPTH min-hash values; a tree is those labels sorted as a prefix trie. Two documents are
candidates when their labels share a prefix of some depth in some tree. The join starts at a deep prefix, which finds close
copies with few candidates, verifies them, estimates its own recall from the verified similarities, and shortens the prefix
until the estimate reaches the target or the depth is reached that guarantees it even for pairs right at the threshold.

Documents with equal n-gram sets are one node. Candidates travel as (node, block) memberships, a block being a set of nodes
tied by common prefixes, and each pair is verified in one block, on whole n-gram sets of 64-bit hashes. What a block sends on is
not its pairs but one row a node: how many documents it is linked to, and the least node that it is tied to. So neither copies
nor the pairs of a group are ever written out, and no link is lost.
"""

from __future__ import annotations

import hashlib
import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docsail.llm.shingles import grams, lower
from docsail.llm.skew import share, spread_join
from docsail.llm.textblocks import blocks, mix64, release
from docsail.session import Workspace

TREES = 32
DEPTH = 4
GRAM = 3
THRESHOLD = 0.5
RECALL = 0.95
BLOCK = 8192
BLOCK_BYTES = 16 << 20
_SEED = np.random.default_rng(99).integers(0, 1 << 32, (2, TREES * DEPTH), dtype=np.uint32)
_FILTER_BITS = 1 << 28
_REMEMBERED = 1 << 20


def detection(similarity: float, depth: int, trees: int = TREES) -> float:
    """Probability that a pair of this similarity shares a prefix of this depth in some tree."""
    return 1 - (1 - similarity**depth) ** trees


def depths(threshold: float, recall: float, margin: float = 0.1) -> list[int]:
    """Prefix depths to try, deepest first: from the deepest that reaches the recall a margin above the threshold down to the
    deepest that reaches it at the threshold itself (1 if none does)."""

    def deepest(s: float) -> int:
        return max([d for d in range(1, DEPTH + 1) if detection(s, d) >= recall], default=1)

    low = deepest(threshold)
    return list(range(max(low, deepest(min(1.0, threshold + margin))), low - 1, -1))


def signatures(value: np.ndarray, off: np.ndarray) -> np.ndarray:
    """(documents, TREES * DEPTH) 16-bit min-hash values of documents that each have at least one gram."""
    g = (value >> np.uint64(32)).astype(np.uint32)
    out = np.empty((len(off) - 1, TREES * DEPTH), np.uint16)
    for k in range(TREES * DEPTH):
        low = np.minimum.reduceat((g ^ _SEED[0, k]) * (_SEED[1, k] | np.uint32(1)), off[:-1])
        out[:, k] = (mix64(low) >> np.uint64(48)).astype(np.uint16)
    return out


def node_of(members: np.ndarray) -> int:
    """The 64-bit name of a set of n-grams (sorted distinct hashes)."""
    return int.from_bytes(hashlib.blake2b(members.tobytes(), digest_size=8).digest(), "little", signed=True)


def _sketch(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    """(doc_id, node, size, labels) of every row; node, size and labels are null for a text without words, and labels also for a
    row that repeats an earlier one of its task."""
    seen: set[tuple[int, int]] = set()
    for batch in batches:
        ids = batch.column(0).to_pylist()
        for first, end, data, off, _ in blocks(lower(batch.column(1)), 1 << 18):
            value, at = grams(data, off, n)
            has = np.flatnonzero(np.diff(at) > 0)
            nodes: list[int | None] = [None] * (end - first)
            sizes: list[int | None] = [None] * (end - first)
            labels: list[bytes | None] = [None] * (end - first)
            fresh = []
            for i in has:
                members = np.unique(value[at[i] : at[i + 1]])
                nodes[i], sizes[i] = node_of(members), len(members)
                mark = (ids[first + i], nodes[i])
                if mark not in seen:
                    seen.add(mark)
                    fresh.append(i)
            if fresh:
                some = np.array(fresh)
                lengths = at[some + 1] - at[some]
                start = np.r_[0, np.cumsum(lengths)]
                pick = np.repeat(at[some] - start[:-1], lengths) + np.arange(start[-1])
                for i, row in zip(fresh, signatures(value[pick], start), strict=True):
                    labels[i] = row.tobytes()
            if len(seen) > _REMEMBERED:
                seen.clear()
            yield pa.record_batch({
                "doc_id": pa.array(ids[first:end], pa.int64()),
                "node": pa.array(nodes, pa.int64()),
                "size": pa.array(sizes, pa.int32()),
                "labels": pa.array(labels, pa.binary()),
            })
    release()


def nodes_of(text: str | Column, n: int = GRAM) -> Column:
    """The node of every text: null where it is null or has no words."""

    @F.arrow_udf("bigint")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in batches:
            out: list[int | None] = [None] * len(column)
            for first, _, data, off, _ in blocks(lower(column), 1 << 18):
                value, at = grams(data, off, n)
                for i in np.flatnonzero(np.diff(at) > 0):
                    out[first + i] = node_of(np.unique(value[at[i] : at[i + 1]]))
            yield pa.array(out, pa.int64())

    return run(text)


def _sets(batches: Iterator[pa.RecordBatch], n: int, bits: np.ndarray | None) -> Iterator[pa.RecordBatch]:
    """(rep, node, grams) of the documents that the membership filter may hold: sorted distinct n-gram hashes, 8 bytes each."""
    seen: set[tuple[int, int]] = set()
    for batch in batches:
        if bits is not None:
            batch = batch.filter(pa.array(_may_hold(bits, batch.column(0).to_numpy(zero_copy_only=False))))
        ids = batch.column(0).to_pylist()
        for first, _, data, off, _ in blocks(lower(batch.column(1)), 1 << 18):
            value, at = grams(data, off, n)
            out: tuple[list, list, list] = ([], [], [])
            for i in np.flatnonzero(np.diff(at) > 0):
                members = np.unique(value[at[i] : at[i + 1]])
                mark = (ids[first + i], node_of(members))
                if mark not in seen:
                    seen.add(mark)
                    for column, x in zip(out, (*mark, members.tobytes()), strict=True):
                        column.append(x)
            if len(seen) > _REMEMBERED:
                seen.clear()
            yield pa.record_batch({"rep": pa.array(out[0], pa.int64()), "node": pa.array(out[1], pa.int64()), "grams": pa.array(out[2], pa.binary())})
    release()


def _places(bits: int, ids: np.ndarray) -> Iterator[np.ndarray]:
    h = mix64(ids.astype(np.int64).view(np.uint64))
    for _ in range(4):
        yield (h & np.uint64(bits - 1)).astype(np.int64)
        h = mix64(h + np.uint64(0x9E3779B97F4A7C15))


def _may_hold(table: np.ndarray, ids: np.ndarray) -> np.ndarray:
    ok = np.ones(len(ids), bool)
    for at in _places(len(table) * 8, ids):
        ok &= (table[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
    return ok


def _membership_filter(ids: DataFrame, n: int) -> np.ndarray | None:
    """A Bloom filter of the ids, 12 bits each and more; None where it would be larger than _FILTER_BITS."""
    size = 1 << max(13, math.ceil(math.log2(max(1, 12 * n))))
    if size > _FILTER_BITS:
        return None

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(size, bool)
        for batch in batches:
            for at in _places(size, batch.column(0).to_numpy(zero_copy_only=False)):
                table[at] = True
        yield pa.record_batch({"bits": pa.array([np.packbits(table, bitorder="little").tobytes()], pa.binary())})

    table = np.zeros(size // 8, np.uint8)
    for row in ids.coalesce(8).mapInArrow(build, "bits binary").toLocalIterator():
        table |= np.frombuffer(row[0], np.uint8)
    return table


def _verified(batches: Iterator[pa.RecordBatch], depth: int, threshold: float, pairs: bool) -> Iterator[pa.RecordBatch]:
    """What _block finds in each cell of a block; the rows of a cell are adjacent."""
    held: list[pa.RecordBatch] = []
    current = None
    for batch in batches:
        keys = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in range(3)], axis=1)
        cut = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
        for a, b in zip(np.r_[0, cut], np.r_[cut, len(keys)], strict=True):
            if a == b:
                continue
            if current is not None and tuple(keys[a]) != current:
                yield from _block(held, current, depth, threshold, pairs)
                held = []
            current = tuple(keys[a])
            held.append(batch.slice(a, b - a))
    if held:
        yield from _block(held, current, depth, threshold, pairs)
    release()


def _tie(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Labels after joining the components of every i and j; a label is the least place of its component."""
    while True:
        a, b = label[i], label[j]
        if (a == b).all():
            return label
        low = np.minimum(a, b)
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        while (label[label] != label).any():
            label = label[label]


def _block(held: list[pa.RecordBatch], key: tuple, depth: int, threshold: float, pairs: bool) -> Iterator[pa.RecordBatch]:
    """The exact similar pairs of a cell, as pairs or summed up: one row for every node that has one."""
    t = pa.Table.from_batches(held)
    node, order = np.unique(t["node"].to_numpy(), return_index=True)
    if len(node) < 2:
        return
    t = t.take(pa.array(order))
    side, copies = t["side"].to_numpy(), t["copies"].to_numpy()
    homes = t["homes"].to_pylist()
    sets = [np.frombuffer(x, np.uint64) for x in t["grams"].to_pylist()]
    size = np.array([len(x) for x in sets])
    label = np.frombuffer(b"".join(t["labels"].to_pylist()), np.uint16).reshape(len(node), TREES, DEPTH)[:, :, :depth].astype(np.uint64)
    prefix = label[:, :, 0].copy()
    for j in range(1, depth):
        prefix = prefix << np.uint64(16) | label[:, :, j]
    prefix = np.ascontiguousarray(prefix.T)
    lone = np.array([len(h) == 1 for h in homes])
    m, step = len(node), max(16, (1 << 22) // len(node))
    links, found, tied = np.zeros(m, np.int64), np.zeros(m, np.int64), np.arange(m)
    expected, best = np.zeros(m), np.zeros(m)
    left, right, waiting = [], [], 0
    for a in range(0, m, step):
        b = min(m, a + step)
        hit = np.zeros((b - a, m), bool)
        for tree in prefix:
            hit |= tree[a:b, None] == tree[None, :]
        hit &= np.arange(m)[None, :] > np.arange(a, b)[:, None]
        hit &= np.minimum(size[a:b, None], size[None, :]) >= threshold * np.maximum(size[a:b, None], size[None, :])
        if key[1] != key[2]:
            hit &= side[a:b, None] != side[None, :]
        i, j = (x.astype(np.int32) for x in np.nonzero(hit))
        i += np.int32(a)
        odd = np.flatnonzero(~(lone[i] | lone[j]))
        if len(odd):  # a pair that meets in several blocks belongs to the first of them
            keep = np.ones(len(i), bool)
            keep[odd] = [min(set(homes[x]) & set(homes[y])) == key[0] for x, y in zip(i[odd], j[odd], strict=True)]
            i, j = i[keep], j[keep]
        left.append(i)
        right.append(j)
        waiting += len(i)
        if waiting and (waiting >= 1 << 20 or b == m):
            i, j = np.concatenate(left), np.concatenate(right)
            left, right, waiting = [], [], 0
            common = _intersections(sets, i, j)
            jaccard = common / (size[i] + size[j] - common)
            ok = jaccard >= threshold
            i, j, jaccard = i[ok], j[ok], jaccard[ok]
            if pairs:
                for lo in range(0, len(i), 1 << 16):
                    part = slice(lo, lo + (1 << 16))
                    yield pa.record_batch({"node_a": pa.array(node[i[part]]), "node_b": pa.array(node[j[part]]), "jaccard": pa.array(jaccard[part])})
                continue
            chance = 1 / (1 - (1 - jaccard**depth) ** TREES)
            for x, y in ((i, j), (j, i)):
                links += np.bincount(x, copies[y], m).astype(np.int64)
                found += np.bincount(x, minlength=m)
                expected += np.bincount(x, chance, m)
                np.maximum.at(best, x, jaccard)
            tied = _tie(tied, i, j)
    at = np.flatnonzero(found)
    if len(at):
        yield pa.record_batch([pa.array(x[at]) for x in (node, node[tied], links, found, expected, best)], ["node", "lead", "links", "found", "expected", "best"])


def _intersections(sets: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of the given pairs of sorted sets: bit rows over shared members, or merges if those are few."""
    used = np.unique(np.r_[i, j])
    spot = np.full(len(sets), -1)
    spot[used] = np.arange(len(used))
    every = np.concatenate([sets[u] for u in used])
    owner = np.repeat(np.arange(len(used)), [len(sets[u]) for u in used])
    _, column, count = np.unique(every, return_inverse=True, return_counts=True)
    shared = count[column] > 1
    remap = np.cumsum(count > 1) - 1
    owner, column = owner[shared], remap[column[shared]]
    width = int((count > 1).sum())
    out = np.zeros(len(i), np.int64)
    if width > 600_000:
        for p, (x, y) in enumerate(zip(i, j, strict=True)):
            out[p] = len(np.intersect1d(sets[x], sets[y], assume_unique=True))
        return out
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    step = max(512, ((1 << 25) // len(used)) & ~511)
    for lo in range(0, width, step):
        a, b = np.searchsorted(column, [lo, lo + step])
        wide = np.zeros((len(used), step if width - lo >= step else -(-(width - lo) // 64) * 64), bool)
        wide[owner[a:b], column[a:b] - lo] = True
        bits = np.packbits(wide, axis=1).view(np.uint64)
        chunk = max(1, (1 << 21) // bits.shape[1])
        for p in range(0, len(i), chunk):
            out[p : p + chunk] += np.bitwise_count(bits[spot[i[p : p + chunk]]] & bits[spot[j[p : p + chunk]]]).sum(axis=1, dtype=np.int64)
    return out


_LINKS = "node bigint, lead bigint, links bigint, found bigint, expected double, best double"


class JaccardJoin:
    """The join over one table of documents (doc_id, text); its intermediates are written to the shared folder.

    ``members`` (doc_id, node, rows): which n-gram set every document has, and how many rows say so; a doc_id with several texts
    is a document for each. ``labels`` (node, rep, size, copies, labels): every set, the least doc_id that has it, how many
    have it. ``linked``: for every node with a link, in each cell where it has one, see _block; ``recall`` is the estimate.

    Rows with a null doc_id take no part; texts that are null or without words have a null node and no links. Further columns
    are ignored. Sets and n-grams are told apart by 64-bit hashes.
    """

    def __init__(self, spark: SparkSession, docs: DataFrame, n: int = GRAM, threshold: float = THRESHOLD, recall: float = RECALL):
        self.work, self.n, self.threshold = Workspace(spark), n, threshold
        self.docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").where("doc_id is not null")
        sketch = self.work.save(self.docs.mapInArrow(lambda it: _sketch(it, n), "doc_id bigint, node bigint, size int, labels binary"), "sketch")
        self.members = self.work.save(sketch.groupBy("doc_id", "node").agg(F.count("*").alias("rows")), "members")
        self.total = self.members.count()
        nodes = self.members.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"))
        firsts = sketch.where("labels is not null").withColumnRenamed("doc_id", "rep")
        self.labels = self.work.save(firsts.join(nodes, ["node", "rep"]).select("node", "rep", "size", "copies", "labels"), "labels")
        self.work.drop("sketch")
        self.recall, self.depth = 1.0, 0
        for self.depth in depths(threshold, recall):
            self._find_homes()
            self.linked = self.work.save(self._verify(False), f"linked{self.depth}")
            found, expected = self.linked.agg(F.sum("found"), F.sum("expected")).first()
            self.recall = found / expected if found else 1.0
            if self.recall >= recall and found:
                break

    def _find_homes(self) -> None:
        """(node, rep, copies, labels, homes, block, side, one, two) of the nodes that share a prefix of this depth in a tree.

        A block of many nodes, or of large sets, is divided into sides, and each pair of sides is a cell of its own.
        """
        tree = F.explode(F.sequence(F.lit(0), F.lit(TREES - 1)))
        part = F.expr(f"substring(labels, tree * {2 * DEPTH} + 1, {2 * self.depth})")
        rows = self.labels.select("node", "labels", tree.alias("tree")).select("node", F.xxhash64("tree", part).alias("prefix"))
        limit = share(TREES * self.total)
        same = rows.groupBy("prefix").agg(F.min("node").alias("lead"), F.max("node").alias("last"), F.count("*").alias("n"))
        same = self.work.save(same.where("lead < last").drop("last"), f"same{self.depth}")
        tied = self.work.save(spread_join(rows, same, "prefix", "n", limit), f"tied{self.depth}")
        label = tied.groupBy("node").agg(F.min("lead").alias("label"))
        least = tied.select("node", "prefix").join(label, "node").groupBy("prefix").agg(F.min("label").alias("block"), F.count("*").alias("n"))
        least = self.work.save(least, f"least{self.depth}")
        home = self.work.save(spread_join(tied.select("node", "prefix"), least, "prefix", "n", limit).select("node", "block").distinct(), f"block{self.depth}")
        heavy = home.join(self.labels.select("node", "size"), "node").groupBy("block").agg(F.count("*").alias("n"), F.sum("size").alias("grams"))
        parts = F.ceil(F.greatest(F.col("n") / BLOCK, F.col("grams") * 8 / BLOCK_BYTES)).cast("int")
        heavy = self.work.save(heavy.select("block", "n", parts.alias("parts")), f"heavy{self.depth}")
        homes = home.groupBy("node").agg(F.sort_array(F.collect_list("block")).alias("homes"))
        home = spread_join(home, heavy, "block", "n", limit).join(homes, "node")
        home = home.withColumn("side", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
        home = home.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        home = home.select("node", "homes", "block", "side", F.least("side", "other").alias("one"), F.greatest("side", "other").alias("two"))
        self.home = self.work.save(home.join(self.labels.drop("size"), "node"), f"home{self.depth}")
        for name in ("same", "tied", "least", "block", "heavy"):
            self.work.drop(f"{name}{self.depth}")

    def _verify(self, pairs: bool) -> DataFrame:
        depth, n, threshold, wanted = self.depth, self.n, self.threshold, self.home.select("rep").distinct()
        bits, docs = _membership_filter(wanted, wanted.count()), self.docs.where("text is not null")
        if bits is None:  # too many to broadcast a filter of them: their texts are found by a join
            docs = docs.join(wanted.withColumnRenamed("rep", "doc_id"), "doc_id", "left_semi")
        sets = docs.mapInArrow(lambda it: _sets(it, n, bits), "rep bigint, node bigint, grams binary")
        cells = self.home.join(sets, ["node", "rep"]).select("block", "one", "two", "side", "node", "copies", "homes", "labels", "grams")
        cells = cells.repartition("block", "one", "two").sortWithinPartitions("block", "one", "two")
        return cells.mapInArrow(lambda it: _verified(it, depth, threshold, pairs), "node_a bigint, node_b bigint, jaccard double" if pairs else _LINKS)

    def pairs(self) -> DataFrame:
        """(doc_a, doc_b, jaccard): the similar pairs of different n-gram sets, each set named by the least doc_id that has it."""
        a, b = self.labels.select("node", "rep").distinct().toDF("node_a", "a"), self.labels.select("node", "rep").distinct().toDF("node_b", "b")
        both = self._verify(True).join(a, "node_a").join(b, "node_b")
        return both.select(F.least("a", "b").alias("doc_a"), F.greatest("a", "b").alias("doc_b"), "jaccard")

    def components(self) -> DataFrame:
        """(node, root): the connected component of every node that has a link, by the least node in it.

        Every round takes the least label among a node's neighbours, then the label of that label, until nothing changes.
        """
        work, limit = self.work, share(TREES * self.total)
        star = self.linked.where("node <> lead").select(F.col("node").alias("x"), F.col("lead").alias("y"))
        edges = work.save(star.unionByName(star.select(F.col("y").alias("x"), F.col("x").alias("y"))).distinct(), "edges")
        label = work.save(edges.groupBy("x").agg(F.least(F.min("y"), F.col("x")).alias("root"), F.count("*").alias("n")), "round0")
        for turn in itertools.count(1):
            near = spread_join(edges, label.toDF("y", "theirs", "n"), "y", "n", limit).groupBy("x").agg(F.min("theirs").alias("theirs"))
            met = work.save(label.join(near, "x").select("x", F.least("root", "theirs").alias("next"), "root", "n"), f"met{turn}")
            jump = met.groupBy("next").agg(F.count("*").alias("many")).join(label.select(F.col("x").alias("next"), F.col("root").alias("beyond")), "next")
            moved = spread_join(met, jump, "next", "many", limit).select("x", F.least("next", "beyond").alias("root"), F.col("root").alias("was"), "n")
            moved = work.save(moved, f"round{turn}")
            work.drop(f"round{turn - 1}")
            work.drop(f"met{turn}")
            label = moved.select("x", "root", "n")
            if moved.where("root <> was").isEmpty():
                return label.select(F.col("x").alias("node"), "root")

    def classes(self) -> DataFrame:
        """(doc_id, node, rows, class_id, first, n_links, jaccard) of every member; first: it is the one that names the class."""
        limit = share(self.total)
        component = self.work.save(self.components(), "components")
        reps = self.labels.select("node", "rep", "copies").distinct()
        named = component.join(reps, "node").groupBy("root").agg(F.min(F.struct("rep", "node")).alias("lead"), F.count("*").alias("n"))
        named = self.work.save(named, "named")
        inside = spread_join(component, named, "root", "n", limit)
        links = self.linked.groupBy("node").agg(F.sum("links").alias("links"), F.max("best").alias("best"))
        known = reps.join(inside.select("node", "lead").join(links, "node"), "node", "left").where("copies > 1 or lead is not null")
        known = known.select("node", "copies", F.coalesce("lead", F.struct("rep", "node")).alias("lead"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.when(F.col("copies") > 1, 1.0).otherwise(F.col("best")).alias("jaccard"))
        known = self.work.save(known, "known")
        found = spread_join(self.members, known, "node", "copies", limit, "left")
        first = F.coalesce((F.col("lead.rep") == F.col("doc_id")) & (F.col("lead.node") == F.col("node")), F.lit(True))
        return found.select("doc_id", "node", "rows", F.coalesce("lead.rep", "doc_id").alias("class_id"), first.alias("first"), F.coalesce("n_links", F.lit(0)).alias("n_links"), "jaccard")


def near_duplicates(spark: SparkSession, docs: DataFrame, n: int = GRAM, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """(doc_id, class_id, n_links, jaccard): a row for every document, by the similarity of its set of lower-case word n-grams.

    A document is linked to every other one whose set has at least the ``threshold`` of Jaccard similarity with its own:
    ``n_links`` counts those documents, copies included, ``jaccard`` is the highest similarity among them (null without any), and
    ``class_id`` is the least doc_id that links lead to. Similarities are exact; a link is missed only by the forest's chance,
    and the estimated recall is at least ``recall``. Rows with a null doc_id have no row; repeated rows have one; a doc_id with
    several texts has one for each. A text that is null, empty or without words is linked to nothing, one of fewer than ``n``
    words is one n-gram, very long ones count whole. An empty table gives no rows; further columns, of whatever name, are ignored.
    """
    return JaccardJoin(spark, docs, n, threshold, recall).classes().select("doc_id", "class_id", "n_links", "jaccard")


def similar_pairs(spark: SparkSession, docs: DataFrame, n: int = GRAM, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """(doc_a, doc_b, jaccard): the links themselves, between the least doc_ids of different n-gram sets; see near_duplicates."""
    return JaccardJoin(spark, docs, n, threshold, recall).pairs()


_SMALL_SIDE = 2_000_000


def keep_one(spark: SparkSession, docs: DataFrame, n: int = GRAM, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """One row of every class of similar documents, the one with the least doc_id, with all columns of docs.

    Rows that can't be compared stay: a null doc_id, a null text, no words. Of rows that repeat a doc_id and a set of n-grams
    one stays, that of the least text; different texts under one doc_id are documents of their own, and none of them is lost
    unless it is similar to one that stays. An empty table stays empty; further columns, of whatever name, are kept.
    """
    join = JaccardJoin(spark, docs, n, threshold, recall)
    members = join.work.save(join.classes().where("node is not null"), "classes")
    again = join.members.groupBy("doc_id").agg(F.sum("rows").alias("many")).where("many > 1")
    again = join.work.save(again, "again")
    gone = join.work.save(members.where("not first").select(F.col("doc_id").alias("gone_id")).join(again, F.col("gone_id") == again.doc_id, "left_anti"), "gone")
    rows = docs.select(F.struct("*").alias("d")).withColumn("i", F.col("d.doc_id").cast("bigint"))
    rest = rows.join(F.broadcast(gone) if gone.count() <= _SMALL_SIDE else gone, F.col("i") == gone.gone_id, "left_anti")
    repeated = again.count()
    if repeated == 0:
        return rest.select("d.*")
    ids = again.select(F.col("doc_id").alias("again_id"), "many")
    if repeated <= _SMALL_SIDE:
        ids = F.broadcast(ids)
    single = rest.join(ids, F.col("i") == F.col("again_id"), "left_anti").select("d.*")
    twice = rows.join(ids, F.col("i") == F.col("again_id"), "left_semi").withColumn("node", nodes_of("d.text", n))
    kept = members.where("first").join(again.select("doc_id"), "doc_id", "left_semi").select(F.col("doc_id").alias("kept_id"), F.col("node").alias("kept_node"))
    one = twice.groupBy("i", "node").agg(F.min_by("d", F.struct("d.text")).alias("d"))
    one = one.join(kept, (F.col("i") == F.col("kept_id")) & (F.col("node") == F.col("kept_node")), "left_semi").select("d.*")
    return single.unionByName(twice.where("node is null").select("d.*")).unionByName(one)
