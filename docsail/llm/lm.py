"""Language-model scoring with a weighted backoff automaton over word n-grams of the whole corpus.

Every known n-gram shorter than the order is a state. It has an arc for every word seen after it, with the word's smoothed
log-probability, and a failure arc to the state of one word less, with the log of the backoff weight. Probabilities are
interpolated with a Dirichlet prior: p(w | h) = (n(h w) + PRIOR p(w | h')) / (n(h) + PRIOR), h' being h without its first word;
the last resort is uniform over the vocabulary and one unknown word. Scoring is one left-to-right traversal that carries the
state and adds up the weights of arcs and failure arcs; documents run side by side as lanes.

The automaton of a corpus is as large as the corpus, so no task ever holds it. Texts are taken in blocks. A block sends its
distinct n-grams with their counts, as sorted and packed hashes, to the shards that own them; a shard adds up the counts of all
blocks and answers each with those of the n-grams it asked about. That is the part of the automaton the block's texts can
reach, and there it is compiled and traversed. The traffic grows with the text, hot n-grams travel once a block.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docsail.llm.shingles import words
from docsail.llm.textblocks import mix64, release, utf8_buffers
from docsail.session import Workspace

ORDER = 4
PRIOR = 5.0
BLOCK_BYTES = 6 << 20
SHARD_BYTES = 8 << 20
LANE = 1024
_SPARE_BITS = 18
_MARKS = np.random.default_rng(31).integers(0, 1 << 63, 34, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
START, END = _MARKS[32], _MARKS[33]


def symbols(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(word hashes of all documents, offsets), an end symbol after each document."""
    word, at = words(data, off)
    ends = at + np.arange(len(at))
    out = np.full(ends[-1], END, np.uint64)
    out[np.arange(len(word)) + np.repeat(np.arange(len(at) - 1), np.diff(at))] = word
    return out, ends


def key_bits(text_bytes: int) -> int:
    """Bits of a key: so many that a given n-gram of a corpus shares its key with another with a chance below 2 to the -_SPARE_BITS."""
    return min(63, max(1, text_bytes).bit_length() + _SPARE_BITS)


def gram_keys(symbol: np.ndarray, at: np.ndarray, order: int, bits: int) -> list[np.ndarray]:
    """For each length the key of the n-gram that ends at every symbol; start symbols stand before a document's first."""
    place = np.arange(len(symbol)) - np.repeat(at[:-1], np.diff(at))
    out, total = [], np.zeros(len(symbol), np.uint64)
    with np.errstate(over="ignore"):
        for back in range(order):
            before = np.full(len(symbol), START, np.uint64)
            before[back:] = symbol[: len(symbol) - back]
            before[place < back] = START
            total = total + before * _MARKS[back]
            out.append(mix64(total + np.uint64(back)) >> np.uint64(64 - bits))
    return out


def _planes(x: np.ndarray) -> bytes:
    """Unsigned integers by byte planes, compressed."""
    return zstandard.ZstdCompressor(level=1).compress(x.view(np.uint8).reshape(len(x), x.itemsize).T.tobytes())


def _unplaned(raw: bytes, kind: type) -> np.ndarray:
    flat = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8)
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(flat.reshape(width, -1).T).view(kind).ravel()


def pack_keys(keys: np.ndarray) -> bytes:
    """Ascending keys by their differences."""
    return _planes(np.diff(keys, prepend=np.uint64(0)))


def unpack_keys(raw: bytes) -> np.ndarray:
    return np.cumsum(_unplaned(raw, np.uint64), dtype=np.uint64)


def _counted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    keys = np.sort(keys)
    first = np.flatnonzero(np.r_[np.ones(min(1, len(keys)), bool), keys[1:] != keys[:-1]])
    return keys[first], np.diff(np.r_[first, len(keys)]).astype(np.uint32)


def _bounds(keys: np.ndarray, shards: int, bits: int) -> np.ndarray:
    edges = np.array([-(-(i << bits) // shards) for i in range(shards + 1)], np.uint64)
    return np.searchsorted(keys, edges)


def text_blocks(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, int]]:
    """(rows, name) of runs of rows of about equal size, at most BLOCK_BYTES or one text; the name tells the texts apart."""
    _, off, _ = utf8_buffers(batch.column(batch.num_columns - 1))
    step, first, n = off[-1] / max(1, -(-int(off[-1]) // BLOCK_BYTES)), 0, batch.num_rows
    while first < n:
        end = min(n, max(first + 1, int(np.searchsorted(off, off[first] + step, side="right")) - 1))
        rows = batch.slice(first, end - first)
        data, at, _ = utf8_buffers(rows.column(batch.num_columns - 1))
        name = hashlib.blake2b(at.tobytes(), digest_size=8)
        name.update(np.ascontiguousarray(data))
        yield rows, int.from_bytes(name.digest(), "little", signed=True)
        first = end


_ASKED = "block bigint, shard int, asks boolean, word_keys binary, word_counts binary, keys binary, counts binary"
_ANSWERED = "block bigint, slot int, docs binary, words binary, grams binary, tokens bigint, kinds bigint, ends bigint"


def _requests(batches: Iterator[pa.RecordBatch], order: int, bits: int, shards: int, asks: bool, trains: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for rows, name in text_blocks(batch):
            keys = gram_keys(*symbols(*utf8_buffers(rows.column(0))[:2]), order, bits)
            word, word_n = _counted(keys[0])
            longer = [_counted(k) for k in keys[1:]]
            gram, n = np.concatenate([np.zeros(0, np.uint64), *[k for k, _ in longer]]), np.concatenate([np.zeros(0, np.uint32), *[c for _, c in longer]])
            by = np.argsort(gram, kind="stable")
            gram, n = gram[by], n[by]
            a, b = _bounds(word, shards, bits), _bounds(gram, shards, bits)
            used = np.flatnonzero((np.diff(a) > 0) | (np.diff(b) > 0))
            out: dict[str, list] = {k: [] for k in ("word_keys", "word_counts", "keys", "counts")}
            for s in used:
                w, g = slice(a[s], a[s + 1]), slice(b[s], b[s + 1])
                out["word_keys"].append(pack_keys(word[w]))
                out["keys"].append(pack_keys(gram[g]))
                out["word_counts"].append(_planes(word_n[w]) if trains else None)
                out["counts"].append(_planes(n[g]) if trains else None)
            head = {"block": pa.array([name] * len(used), pa.int64()), "shard": pa.array(used, pa.int32()), "asks": pa.array([asks] * len(used), pa.bool_())}
            yield pa.record_batch(head | {k: pa.array(v, pa.binary()) for k, v in out.items()})
    release()


def _summed(keys: list[bytes], counts: list[bytes | None]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """(each row's keys' totals, the distinct keys, their totals) of a shard's rows."""
    lists = [unpack_keys(k) for k in keys]
    every = np.concatenate([np.zeros(0, np.uint64), *lists])
    n = np.concatenate([np.zeros(0, np.uint32), *[np.zeros(len(k), np.uint32) if c is None else _unplaned(c, np.uint32) for k, c in zip(lists, counts, strict=True)]])
    by = np.argsort(every, kind="stable")
    every = every[by]
    first = np.flatnonzero(np.r_[np.ones(min(1, len(every)), bool), every[1:] != every[:-1]])
    total = np.add.reduceat(n[by].astype(np.int64), first) if len(first) else np.zeros(0, np.int64)
    spread = np.empty(len(every), np.int64)
    spread[by] = np.repeat(total, np.diff(np.r_[first, len(every)]))
    return np.split(spread, np.cumsum([len(k) for k in lists])[:-1]) if lists else [], every[first], total


def _answers(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    """A shard's answers to the blocks that asked, and its share of the corpus's totals."""
    batches = [b for b in batches if b.num_rows]
    if not batches:
        return
    rows = pa.Table.from_batches(batches).sort_by([("shard", "ascending"), ("block", "ascending")])
    shards, end = rows["shard"].to_numpy(), gram_keys(np.array([END]), np.array([0, 1]), 1, bits)[0][0]
    for s in np.unique(shards):
        own = rows.slice(int(np.searchsorted(shards, s)), int((shards == s).sum())).to_pydict()
        words_, key, n = _summed(own["word_keys"], own["word_counts"])
        grams, *_ = _summed(own["keys"], own["counts"])
        ends = int(n[key == end].sum())
        at = [i for i, asks in enumerate(own["asks"]) if asks]
        out = {
            "block": [own["block"][i] for i in at] + [None], "slot": [int(s)] * (len(at) + 1), "docs": [None] * (len(at) + 1),
            "words": [_planes(words_[i].astype(np.uint64)) for i in at] + [None], "grams": [_planes(grams[i].astype(np.uint64)) for i in at] + [None],
            "tokens": [None] * len(at) + [int(n.sum())], "kinds": [None] * len(at) + [int((n > 0).sum())], "ends": [None] * len(at) + [ends],
        }
        kinds = (pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int64())
        yield pa.record_batch([pa.array(v, kind) for v, kind in zip(out.values(), kinds, strict=True)], list(out))
    release()


def _payloads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The blocks' rows themselves, packed."""
    for batch in batches:
        for rows, name in text_blocks(batch):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                out.write_batch(rows)
            none = pa.nulls(1, pa.binary())
            yield pa.record_batch([pa.array([name], pa.int64()), pa.array([-1], pa.int32()), pa.array([sink.getvalue().to_pybytes()], pa.binary()), none, none], ["block", "slot", "docs", "words", "grams"])


class Automaton:
    """The part of the corpus's automaton that a block's texts can reach.

    ``state[k][i]``: the state (an n-gram of k words) that ends at symbol i; ``weight[k][s]``: of the arc that is n-gram s of k
    words, known where ``count[k][s] > 0``; ``backoff[k][s]``: of the failure arc of state s. An arc leads to the state that it
    spells, or, from the longest states, to that without its first word, so which states a text meets is known beforehand and a
    state in the traversal is its number of words.
    """

    def __init__(self, keys: list[np.ndarray], at: np.ndarray, word_totals: np.ndarray, gram_totals: np.ndarray, tokens: int, kinds: int, ends: int, prior: float):
        self.order, self.at = len(keys), at
        sizes, self.state, self.count, first = [], [], [], []
        for k in keys:
            by = np.argsort(k, kind="stable")
            new = np.r_[np.ones(min(1, len(k)), bool), k[by][1:] != k[by][:-1]]
            place = np.empty(len(k), np.int32)
            place[by] = np.cumsum(new) - 1
            self.state.append(place)
            first.append(by[new])
            sizes.append(k[by[new]])
        merged = np.argsort(np.concatenate([np.zeros(0, np.uint64), *sizes[1:]]), kind="stable")
        if len(word_totals) != len(sizes[0]) or len(gram_totals) != len(merged):
            raise RuntimeError("the texts were not the same when they were counted and when they were scored; save them first")
        longer = np.empty(len(merged), np.int64)
        longer[merged] = gram_totals
        self.count = [word_totals.astype(np.int64), *np.split(longer, np.cumsum([len(s) for s in sizes[1:]])[:-1])] if self.order > 1 else [word_totals.astype(np.int64)]
        start = np.zeros(len(keys[0]), bool)
        start[at[:-1][np.diff(at) > 0]] = True
        place = np.arange(len(start)) - np.repeat(at[:-1], np.diff(at))
        shorter = np.full(len(sizes[0]), 1.0 / (kinds + 1))
        seen = np.full(len(sizes[0]), float(tokens))
        self.weight, self.backoff = [], [np.array([np.log(prior / (tokens + prior))])]
        for k in range(self.order):
            if k:
                i = first[k]
                shorter = p[self.state[k - 1][i]]  # noqa: F821
                inside = place[i] > 0
                seen = np.where(inside, self.count[k - 1][self.state[k - 1][np.maximum(i - 1, 0)]], ends).astype(float)
            p = (self.count[k] + prior * shorter) / (seen + prior)
            self.weight.append(np.log(p))
            self.backoff.append(np.log(prior / (self.count[k] + prior)))
        self.unknown = np.log(1.0 / (kinds + 1))
        self.begin = float(np.log(prior / (ends + prior)))
        self.start = self.order - 1 if ends else 0

    def _leave(self, length: np.ndarray, i: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Weights of the failure arcs of the states of these lengths before symbols i."""
        out = np.empty(len(i))
        for k in range(self.order):
            at = np.flatnonzero(length == k)
            if k == 0:
                out[at] = self.backoff[0][0]
                continue
            begins = first[at]
            out[at] = np.where(begins, self.begin, self.backoff[k][self.state[k - 1][np.maximum(i[at] - 1, 0)]])
        return out

    def step(self, length: np.ndarray, i: np.ndarray, first: np.ndarray, total: np.ndarray) -> np.ndarray:
        """The states after symbols i, from states of these lengths; adds the weights passed on the way to total."""
        length = length.copy()
        waiting = np.arange(len(i))
        while len(waiting):
            k = length[waiting]
            known = np.zeros(len(waiting), bool)
            for n in range(self.order):
                at = np.flatnonzero(k == n)
                if len(at):
                    arc = self.state[n][i[waiting[at]]]
                    known[at] = self.count[n][arc] > 0
                    hit = at[known[at]]
                    total[waiting[hit]] += self.weight[n][arc[known[at]]]
            lost = waiting[~known]
            root = lost[length[lost] == 0]
            total[root] += self.backoff[0][0] + self.unknown
            length[root] = -1
            lost = lost[length[lost] > 0]
            total[lost] += self._leave(length[lost], i[lost], first[lost])
            length[lost] -= 1
            waiting = lost
        return np.minimum(length + 1, self.order - 1)

    def score(self) -> np.ndarray:
        """Log-probability of every document, end included. A long one is cut into lanes, each of which first takes the symbols
        before it, after which it is in the state that an uncut traversal would be in."""
        at, size = self.at, np.diff(self.at)
        lanes = -(-size // LANE)
        doc = np.repeat(np.arange(len(size)), lanes)
        nth = np.arange(len(doc)) - np.repeat(np.cumsum(lanes) - lanes, lanes)
        begin = at[:-1][doc] + nth * LANE
        length = np.minimum(LANE, at[1:][doc] - begin)
        by = np.argsort(-length, kind="stable")
        doc, nth, begin, length = doc[by], nth[by], begin[by], length[by]
        state = np.where(nth == 0, self.start, 0)
        inner = np.flatnonzero(nth > 0)
        for back in range(min(self.order - 1, LANE), 0, -1):
            if len(inner):
                state[inner] = self.step(state[inner], begin[inner] - back, np.zeros(len(inner), bool), np.zeros(len(inner)))
        total = np.zeros(len(doc))
        active = np.searchsorted(-length, -np.arange(int(length.max(initial=0))), side="left")
        for t, k in enumerate(active):
            state[:k] = self.step(state[:k], begin[:k] + t, (nth[:k] == 0) & (t == 0), total[:k])
        return np.bincount(doc, total, len(size))


def _scored(batches: Iterator[pa.RecordBatch], order: int, bits: int, prior: float, totals: tuple[int, int, int]) -> Iterator[pa.RecordBatch]:
    """Compiles and traverses each block's automaton; a block's rows are adjacent, its texts before the answers, by shard."""
    block, held, words_, grams, last = None, [], [], [], None

    def shut() -> Iterator[pa.RecordBatch]:
        word_totals, gram_totals = (np.concatenate([np.zeros(0, np.uint64), *[_unplaned(x, np.uint64) for x in xs]]) for xs in (words_, grams))
        for raw in held:
            rows = pa.ipc.open_stream(raw).read_all().combine_chunks().to_batches()[0]
            sym, at = symbols(*utf8_buffers(rows.column(1))[:2])
            automaton = Automaton(gram_keys(sym, at, order, bits), at, word_totals, gram_totals, *totals, prior)
            total, n = automaton.score(), np.diff(at)
            yield pa.record_batch([rows.column(0), pa.array(n, pa.int64()), pa.array(total), pa.array(total / n), pa.array(np.exp(-total / n))], ["doc_id", "n_symbols", "log_likelihood", "logprob", "perplexity"])

    for batch in batches:
        for name, slot, docs, w, g in zip(*(batch.column(c).to_pylist() for c in range(5)), strict=True):
            if name != block:
                yield from shut()
                block, held, words_, grams, last = name, [], [], [], None
            if slot < 0:
                held.append(docs)
            elif slot != last:  # blocks of the same texts have the same answers
                last = slot
                words_.append(w)
                grams.append(g)
    yield from shut()
    release()


def score_documents(spark: SparkSession, docs: DataFrame, corpus: DataFrame | None = None, order: int = ORDER, prior: float = PRIOR) -> DataFrame:
    """(doc_id, n_symbols, log_likelihood, logprob, perplexity) of every row under a model of all texts of ``corpus``, or of docs.

    Words are runs without ASCII white space; ``n_symbols`` counts them and the end. ``log_likelihood`` is the natural
    log-probability of the text, ``logprob`` that per symbol, ``perplexity`` its inverse as a probability. A null text has nulls,
    an empty one is its end symbol; a very long one is scored whole. Null ids and repeated rows pass through and count as often
    as they occur; an empty table gives an empty result, and with an empty corpus every symbol is unknown; further columns are
    ignored. Keys of n-grams grow with the corpus (see key_bits); n-grams of one key share their counts. ``order`` is from 1 to 32.

    The rows of docs are read twice and must be the same both times, as those of a table are; an error says where they weren't.
    """
    if not 1 <= order <= 32:
        raise ValueError("the order must be from 1 to 32")
    kind = dict(docs.dtypes)["doc_id"]
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    known = rows.where("text is not null")
    trained = known if corpus is None else corpus.select(F.col("text").cast("string").alias("text")).where("text is not null")
    size = F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")
    total = sum(r[0] for r in [t.select("text").agg(size).first() for t in ([known] if corpus is None else [known, trained])])
    bits = key_bits(total)
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1 + total // SHARD_BYTES)

    def requests(texts: DataFrame, asks: bool, trains: bool) -> DataFrame:
        return texts.select("text").mapInArrow(lambda it: _requests(it, order, bits, shards, asks, trains), _ASKED)

    asked = requests(known, True, True) if corpus is None else requests(known, True, False).unionByName(requests(trained, False, True))
    answers = Workspace(spark).save(asked.repartitionById(shards, "shard").mapInArrow(lambda it: _answers(it, bits), _ANSWERED), "answers")
    counted = answers.agg(*[F.coalesce(F.sum(c), F.lit(0)) for c in ("tokens", "kinds", "ends")]).first()
    totals = (int(counted[0]), int(counted[1]), int(counted[2]))
    columns = ["block", "slot", "docs", "words", "grams"]
    texts = known.mapInArrow(_payloads, "block bigint, slot int, docs binary, words binary, grams binary")
    met = texts.unionByName(answers.where("block is not null").select(*columns))
    met = met.repartitionById(shards, F.pmod("block", F.lit(shards)).cast("int")).sortWithinPartitions("block", "slot")
    schema = f"doc_id {kind}, n_symbols bigint, log_likelihood double, logprob double, perplexity double"
    scored = met.select(*columns).mapInArrow(lambda it: _scored(it, order, bits, prior, totals), schema)
    none = rows.where("text is null").select("doc_id", F.lit(None).cast("bigint").alias("n_symbols"), *[F.lit(None).cast("double").alias(c) for c in ("log_likelihood", "logprob", "perplexity")])
    return scored.unionByName(none)
