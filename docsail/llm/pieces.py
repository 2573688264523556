"""SentencePiece encoding and decoding; giant documents by a max-plus parallel scan.

A text is a path over its characters, each step a piece. Where two neighbouring characters occur together in no piece, every
path must cut (a forced cut), so the spans between such cuts are encoded alone and remembered.

A giant document is split into chunks at arbitrary places. A boundary's state is the step that crosses or ends at it: how far
it reaches into the next chunk and, for merge-based models, which piece it is. A chunk yields a transfer matrix in the (max, +)
algebra from the states at its start to those at its end; matrices combine associatively, so FAN neighbours at a time are
combined, level by level, up to one matrix a document. The best path through that fixes the document's two outer states, and level
by level downwards those of its parts, until the states at every boundary are known and each chunk is traced back on its own.

For a unigram model a step weighs its score. For a merge-based (BPE) model a step weighs 0 if it and the step before form a pair
that merging reproduces, and -inf otherwise: a sequence is the model's encoding exactly if all its neighbouring pairs are.
Where a pair's validity depends on more than the pair (pieces of equal score), the span between two forced cuts is kept whole: its
chunk is extended to the span's end. In the public model only runs of spaces have equal scores; for a model with others every
boundary is moved to a forced cut.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import sentencepiece
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from sentencepiece import sentencepiece_model_pb2 as proto

from docsail.llm.textblocks import blocks, release
from docsail.session import Workspace

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
GIANT_BYTES = 1 << 15
CHUNK = 1 << 13
FAN = 64
UNIGRAM, BPE = 1, 2
_UNKNOWN_PENALTY = 10.0
_MEMORY = 200_000
NONE = -np.inf
State = tuple[int, str]


class PieceModel:
    """A SentencePiece model's vocabulary, and for BPE the library's processor for spans between forced cuts."""

    def __init__(self, raw: bytes):
        model = proto.ModelProto()
        model.ParseFromString(raw)
        self.kind = model.trainer_spec.model_type
        if self.kind not in (UNIGRAM, BPE):
            raise ValueError("only unigram and BPE models have piece scores")
        if model.normalizer_spec.precompiled_charsmap or model.normalizer_spec.remove_extra_whitespaces:
            raise ValueError("only the identity normalisation is supported")
        self.prefix = model.normalizer_spec.add_dummy_prefix
        self.unknown = model.trainer_spec.unk_id
        self.vocabulary = {p.piece: i for i, p in enumerate(model.pieces) if p.type in (1, 4, 5)}
        self.scores = {p.piece: p.score for p in model.pieces if p.type in (1, 4, 5)}
        self.unknown_score = min(self.scores.values(), default=0.0) - _UNKNOWN_PENALTY
        self.bytes = {int(p.piece[3:5], 16): i for i, p in enumerate(model.pieces) if p.type == 6}
        self.longest = max(map(len, self.vocabulary), default=1)
        scores = list(self.scores.values())
        self.ties = len(scores) != len(set(scores))
        spread = [v for p, v in self.scores.items() if p.strip(SPACE)]
        self.wide_ties = self.kind == BPE and len(spread) != len(set(spread))
        self.text = [b"" if p.type == 3 else bytes([int(p.piece[3:5], 16)]) if p.type == 6 else " ⁇ ".encode() if p.type == 2 else p.piece.replace(SPACE, " ").encode() for p in model.pieces]
        self.piece_bytes = np.frombuffer(b"".join(self.text), np.uint8)
        self.piece_start = np.r_[0, np.cumsum([len(t) for t in self.text])].astype(np.int64)
        letters = sorted({c for p in self.vocabulary if len(p) > 1 for c in p})
        self.letter = np.zeros(0x110000, np.int16)
        self.letter[[ord(c) for c in letters]] = np.arange(1, len(letters) + 1)
        self.joined = np.zeros((len(letters) + 1, len(letters) + 1), bool)
        pairs = sorted({(a, b) for p in self.vocabulary for a, b in zip(p, p[1:], strict=False)})
        if pairs:
            self.joined[[self.letter[ord(a)] for a, _ in pairs], [self.letter[ord(b)] for _, b in pairs]] = True
        model.normalizer_spec.add_dummy_prefix = False
        self.library = sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString())
        self._forget()
        self._fits: dict[tuple[str, str], bool] = {}

    def normalized(self, text: str) -> str:
        if not text:
            return ""
        return (SPACE if self.prefix else "") + text.replace(" ", SPACE)

    def forced(self, points: np.ndarray) -> np.ndarray:
        """For every place between two code points, whether every path cuts there."""
        at = self.letter[points]
        return ~self.joined[at[:-1], at[1:]]

    def _forget(self) -> None:
        self.memory: dict[str, int] = {}
        self.flat, self.begin, self.count = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def encode_spans(self, spans: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all spans, how many each has); spans begin and end at forced cuts."""
        if len(self.memory) > _MEMORY:
            self._forget()
        memory = self.memory
        index = np.fromiter(map(memory.get, spans, repeat(-1)), np.int64, len(spans))
        missing = list(dict.fromkeys(spans[i] for i in np.flatnonzero(index < 0)))
        if missing:
            found = self._encode_missing(missing)
            memory.update(zip(missing, range(len(memory), len(memory) + len(missing)), strict=True))
            count = np.array([len(x) for x in found], np.int64)
            self.begin = np.r_[self.begin, len(self.flat) + np.cumsum(count) - count]
            self.count = np.r_[self.count, count]
            self.flat = np.concatenate([self.flat, np.fromiter(chain.from_iterable(found), np.int32, int(count.sum()))])
            index = np.fromiter(map(memory.__getitem__, spans), np.int64, len(spans))
        count = self.count[index]
        shift = self.begin[index] - (np.cumsum(count) - count)
        return self.flat[np.repeat(shift, count) + np.arange(int(count.sum()))], count

    def _encode_missing(self, spans: list[str]) -> list[list[int]]:
        if self.kind == BPE:
            return self.library.encode(spans, num_threads=1)
        ends = [np.r_[True, np.zeros(len(s) - 1, bool), True] for s in spans]
        return [[i for p in self.trace(s, (0, ""), len(s), e) for i in self.ids(p)] for s, e in zip(spans, ends, strict=True)]

    def encode_block(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of whole texts."""
        normal = [self.normalized(t) for t in texts]
        joined = "".join(normal)
        if not joined:
            return [np.zeros(0, np.int32) for _ in texts]
        points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        ends = np.cumsum([len(t) for t in normal])
        cut = np.r_[True, self.forced(points), True]
        cut[ends] = True
        at = np.flatnonzero(cut)
        bounds = at.tolist()
        spans = [joined[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        ids, count = self.encode_spans(spans)
        place = np.r_[0, np.cumsum(count)][np.searchsorted(at, np.r_[0, ends])]
        return [ids[a:b] for a, b in zip(place[:-1], place[1:], strict=True)]

    def ids(self, piece: str) -> list[int]:
        """A step's ids: one, or those of its bytes where a character is in no piece."""
        found = self.vocabulary.get(piece)
        if found is not None:
            return [found]
        return [self.bytes[b] for b in piece.encode()] if self.bytes else [self.unknown]

    def merged(self, text: str) -> list[str]:
        """Plain BPE: merge the neighbouring pair of best score, leftmost first, until none is in the vocabulary."""
        parts = list(text)
        while len(parts) > 1:
            scored = [(-self.scores[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in self.scores]
            if not scored:
                break
            i = min(scored)[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def fits(self, before: str, piece: str) -> bool:
        """Whether a step may follow another: always in a unigram model; if merging reproduces the pair in a BPE model."""
        if self.kind == UNIGRAM or not before:
            return True
        found = self._fits.get((before, piece))
        if found is None:
            found = self._fits[before, piece] = self.merged(before + piece) == [before, piece]
        return found

    def weight(self, piece: str) -> float:
        if self.kind == BPE:
            return 0.0
        return self.scores.get(piece, self.unknown_score)

    def steps(self, text: str, at: int, limit: int) -> list[str]:
        """The steps that may start here: pieces, and the single character (in a unigram model only if it is no piece)."""
        found = [text[at : at + n] for n in range(1, min(self.longest, limit - at) + 1)]
        return [p for n, p in enumerate(found) if n == 0 or p in self.vocabulary]

    def walk(self, text: str, starts: dict[State, np.ndarray], stop: int, cut: np.ndarray) -> tuple[dict[State, np.ndarray], dict]:
        """Best scores of all paths from the start states (place, last step) to states at or beyond stop, and the back links.

        cut[i]: whether there is a forced cut before character i; a state at a cut forgets its last step.
        """
        waiting: dict[int, dict[str, np.ndarray]] = {}
        for (place, last), value in starts.items():
            waiting.setdefault(place, {})[last] = value
        back: dict = {}
        done: dict[State, np.ndarray] = {}
        while waiting:
            place = min(waiting)
            here = waiting.pop(place)
            if place >= stop:
                done |= {(place, last): v for last, v in here.items()}
                continue
            limit = place + 1
            while limit < len(text) and limit - place < self.longest and not cut[limit]:
                limit += 1
            for piece in self.steps(text, place, limit):
                weight, end = self.weight(piece), place + len(piece)
                last = piece if self.kind == BPE and not cut[end] else ""
                for before, value in here.items():
                    if not self.fits(before, piece):
                        continue
                    new, there = value + weight, waiting.setdefault(end, {})
                    if last not in there:
                        there[last], back[end, last] = new, (place, before, piece)
                        continue
                    if new[0] > there[last][0]:
                        back[end, last] = (place, before, piece)
                    there[last] = np.maximum(there[last], new)
        return done, back

    def trace(self, text: str, start: State, stop: int, cut: np.ndarray, goal: State | None = None) -> list[str]:
        """The steps of the best path from a state to the goal, or to the best state at or beyond stop."""
        done, back = self.walk(text, {start: np.zeros(1)}, stop, cut)
        state = goal if goal is not None else max(done, key=lambda s: done[s][0])
        out = []
        while state != start:
            place, before, piece = back[state]
            out.append(piece)
            state = (place, before)
        return out[::-1]

    def decode_block(self, ids: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bytes, offsets) of the texts of documents' ids: their pieces' bytes, the dummy prefix dropped."""
        size = np.diff(self.piece_start)[ids]
        total = np.r_[0, np.cumsum(size)]
        data = np.empty(total[-1], np.uint8)
        for a in range(0, len(ids), 1 << 16):  # the indices take many times the bytes
            b = min(len(ids), a + (1 << 16))
            shift = np.repeat(self.piece_start[ids[a:b]] - total[a:b], size[a:b])
            data[total[a] : total[b]] = self.piece_bytes[shift + np.arange(total[a], total[b])]
        at = total[off]
        if not self.prefix:
            return data, at
        filled = np.flatnonzero(np.diff(at) > 0)
        drop = at[filled][data[at[filled]] == 32]
        keep = np.ones(len(data), bool)
        keep[drop] = False
        return data[keep], at - np.searchsorted(drop, at)

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids; undecodable bytes replaced."""
        ids = np.asarray(ids, np.int64)
        return self.decode_block(ids, np.array([0, len(ids)]))[0].tobytes().decode("utf-8", "replace")


@lru_cache(maxsize=2)
def load(raw: bytes | str) -> PieceModel:
    """The model of a file's bytes, or of a file on this machine."""
    if isinstance(raw, str):
        with open(raw, "rb") as file:
            raw = file.read()
    return PieceModel(raw)


def shipped(spark: SparkSession, path: str) -> Broadcast:
    """A model file's bytes (a MB at most), read on the driver for all executors."""
    with open(path, "rb") as file:
        return spark.sparkContext.broadcast(file.read())


class Chunk:
    """Characters lo .. hi of a document, with enough text on both sides to know all states at its two boundaries."""

    def __init__(self, model: PieceModel, left: str, body: str, right: str, first: bool, last: bool):
        self.model, self.first, self.last = model, first, last
        self.text = left + body + right
        self.lo, self.hi = len(left), len(left) + len(body)
        points = np.frombuffer(self.text.encode("utf-32-le", "surrogatepass"), np.uint32)
        self.cut = np.r_[True, model.forced(points), True] if len(points) else np.ones(1, bool)
        if not first and not left:
            raise ValueError("an inner chunk needs the text before it")
        inside = np.flatnonzero(self.cut[self.lo : self.hi + 1]) + self.lo
        self.head = int(inside[0]) if len(inside) else None
        self.tail = int(inside[-1]) if len(inside) else None

    def entries(self) -> list[State]:
        """States at the chunk's start, as (characters beyond it, step)."""
        if self.first or self.cut[self.lo]:
            return [(0, "")]
        found = set()
        for start in range(self.lo - 1, max(-1, self.lo - self.model.longest), -1):
            for end in range(self.lo, min(len(self.text), start + self.model.longest) + 1):
                piece = self.text[start:end]
                if piece in self.model.vocabulary or len(piece) == 1:
                    keep = self.model.kind == BPE and not self.cut[end]
                    found.add((end - self.lo, piece if keep else ""))
            if self.cut[start]:
                break
        return sorted(found)

    def transfer(self) -> tuple[list[State], list[State], np.ndarray]:
        """(states in, states out, matrix): the best score from each to each, -inf where no path leads."""
        entries = self.entries()
        unit = np.where(np.eye(len(entries), dtype=bool), 0.0, NONE)
        starts = {(self.lo + e, p): unit[i] for i, (e, p) in enumerate(entries)}
        if self.head is None:
            done, _ = self.model.walk(self.text, starts, self.hi, self.cut)
            names, columns = self._exits(done)
            return entries, names, np.stack(columns, axis=1) if columns else np.zeros((len(entries), 0))
        done, _ = self.model.walk(self.text, starts, self.head, self.cut)
        head = np.max(list(done.values()), axis=0)
        done, _ = self.model.walk(self.text, {(self.tail, ""): np.zeros(1)}, self.hi, self.cut)
        names, columns = self._exits(done)
        return entries, names, head[:, None] + np.concatenate(columns)[None, :]  # what all paths share between head and tail is left out

    def _exits(self, done: dict[State, np.ndarray]) -> tuple[list[State], list[np.ndarray]]:
        order = sorted(done)
        return [(place - self.hi, last) for place, last in order], [done[s] for s in order]

    def _spans(self) -> list[str]:
        at = np.flatnonzero(self.cut[self.head : self.tail + 1]) + self.head
        return [self.text[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]

    def backtrace(self, enter: State, leave: State) -> np.ndarray:
        """The ids of the steps that start in this chunk, given its two boundary states."""
        start, goal = (self.lo + enter[0], enter[1]), (self.hi + leave[0], leave[1])
        if self.head is None:
            pieces = self.model.trace(self.text, start, self.hi, self.cut, goal)
            return np.array([i for p in pieces for i in self.model.ids(p)], np.int32)
        before = [i for p in self.model.trace(self.text, start, self.head, self.cut) for i in self.model.ids(p)]
        after = [i for p in self.model.trace(self.text, (self.tail, ""), self.hi, self.cut, goal) for i in self.model.ids(p)]
        return np.concatenate([np.array(before, np.int32), self.model.encode_spans(self._spans())[0], np.array(after, np.int32)])


def compose(a: tuple, b: tuple) -> tuple:
    """The product of two neighbouring transfers; associative."""
    place = {s: i for i, s in enumerate(b[0])}
    rows = np.full((len(a[1]), len(b[1])), NONE)
    for k, s in enumerate(a[1]):
        if s in place:
            rows[k] = b[2][place[s]]
    out = (a[2][:, :, None] + rows[None, :, :]).max(axis=1) if len(a[1]) else np.full((len(a[0]), len(b[1])), NONE)
    return a[0], b[1], out


def _through(value: np.ndarray, out: list[State], transfer: tuple) -> np.ndarray:
    """Best scores at a transfer's end from those of the states before it."""
    place = {s: i for i, s in enumerate(transfer[0])}
    start = np.full(len(transfer[0]), NONE)
    for k, s in enumerate(out):
        if s in place:
            start[place[s]] = value[k]
    return (start[:, None] + transfer[2]).max(axis=0) if len(start) else np.full(len(transfer[1]), NONE)


def best_states(transfers: list[tuple], enter: State | None = None, leave: State | None = None) -> list[State]:
    """The states of the best path at the start, at every boundary and at the end, between the given outer ones.

    Without them the start is a document's, which has one state, and the end is the best.
    """
    enter = transfers[0][0][0] if enter is None else enter
    values, names = [np.zeros(1)], [[enter]]
    for t in transfers:
        values.append(_through(values[-1], names[-1], t))
        names.append(t[1])
    state = names[-1][int(values[-1].argmax())] if leave is None else leave
    states = [state]
    for t, value, out in zip(transfers[::-1], values[-2::-1], names[-2::-1], strict=True):
        onward = t[2][:, t[1].index(state)]
        place = {s: i for i, s in enumerate(t[0])}
        state = out[int(np.argmax([value[k] + (onward[place[s]] if s in place else NONE) for k, s in enumerate(out)]))]
        states.append(state)
    return states[::-1]


def cut_chunks(model: PieceModel, text: str, size: int = CHUNK) -> list[tuple[str, str, str]]:
    """(left, body, right) of a text's chunks, whatever the text is: text on both sides as long as the longest piece."""
    normal, halo = model.normalized(text), model.longest + 1
    bounds = list(range(0, len(normal), size)) + [len(normal)]
    if model.wide_ties and len(bounds) > 2:
        cuts = np.flatnonzero(model.forced(np.frombuffer(normal.encode("utf-32-le", "surrogatepass"), np.uint32))) + 1
        found = np.searchsorted(cuts, bounds[1:-1])
        bounds = [0, *np.unique(cuts[found[found < len(cuts)]]).tolist(), bounds[-1]]
    elif model.ties and len(bounds) > 2:
        bounds = _outside_ties(model, normal, bounds)
    return [(normal[max(0, a - halo) : a], normal[a:b], normal[b : b + halo]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]


def _outside_ties(model: PieceModel, text: str, bounds: list[int]) -> list[int]:
    """Boundaries moved to the end of runs of spaces, whose pieces have equal scores."""
    out = [0]
    for b in bounds[1:-1]:
        while b < len(text) and (text[b] == SPACE or text[b - 1] == SPACE):
            b += 1
        if out[-1] < b < len(text):
            out.append(b)
    return [*out, bounds[-1]]


def encode_giant(model: PieceModel, text: str, size: int = CHUNK) -> np.ndarray:
    """The whole scan in one process: what encode_documents spreads over tasks."""
    parts = cut_chunks(model, text, size)
    chunks = [Chunk(model, *p, first=i == 0, last=i == len(parts) - 1) for i, p in enumerate(parts)]
    if not chunks:
        return np.zeros(0, np.int32)
    states = best_states([c.transfer() for c in chunks])
    return np.concatenate([c.backtrace(a, b) for c, a, b in zip(chunks, states[:-1], states[1:], strict=True)])


def _lists(ids: list[np.ndarray | None]) -> pa.ListArray:
    sizes = np.array([0 if x is None else len(x) for x in ids], np.int64)
    offsets = pa.array(np.r_[0, np.cumsum(sizes)].astype(np.int32), pa.int32())
    values = pa.array(np.concatenate([np.zeros(0, np.int32), *[x for x in ids if x is not None]]), pa.int32())
    return pa.ListArray.from_arrays(offsets, values, mask=pa.array([x is None for x in ids]))


def _encoded(model: PieceModel, column: pa.Array) -> list[np.ndarray | None]:
    ids: list[np.ndarray | None] = []
    for first, end, *_ in blocks(column, 1 << 20):
        texts = column.slice(first, end - first).to_pylist()
        ids += [None if text is None else found for text, found in zip(texts, model.encode_block([t or "" for t in texts]), strict=True)]
    return ids


def _flat(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(ids, offsets) of a list column; a null list is empty."""
    off = np.asarray(lists.offsets).astype(np.int64)
    size = np.where(np.asarray(lists.is_valid()), np.diff(off), 0)
    value, start = lists.values.to_numpy(zero_copy_only=False), np.r_[0, np.cumsum(size)]
    if (size == np.diff(off)).all():  # nothing between the lists
        return value[off[0] : off[-1]], start
    return value[np.repeat(off[:-1] - start[:-1], size) + np.arange(start[-1])], start


def _same(model: PieceModel, text: pa.Array, ids: pa.Array) -> pa.Array:
    """Whether the decoded ids are the text, byte for byte; null for a null text."""
    out, known = np.zeros(len(text), bool), np.zeros(len(text), bool)
    for first, end, wanted, at, valid in blocks(text, 1 << 20):
        data, spot = model.decode_block(*_flat(ids.slice(first, end - first)))
        known[first:end] = valid
        for i in range(end - first):
            out[first + i] = np.array_equal(data[spot[i] : spot[i + 1]], wanted[at[i] : at[i + 1]])
    return pa.array(out, pa.bool_(), mask=~known)


def encode_documents(spark: SparkSession, docs: DataFrame, model_path: str = MODEL, giant_bytes: int = GIANT_BYTES, chunk: int = CHUNK) -> DataFrame:
    """(doc_id, n_tokens, tokens, round_trip) of every row: its ids, which are decoded again to see whether they give the text back.

    Texts of up to giant_bytes are encoded where they are, in one pass; giant ones are scanned in parallel by chunks. A null
    text has nulls, an empty one no tokens. Null ids and repeated rows pass through; an empty table gives an empty result;
    further columns are ignored. U+2581 stands for a space in the vocabulary, so a text that holds it doesn't round-trip.
    """

    sent = shipped(spark, model_path)

    @F.arrow_udf("tokens array<int>, round_trip boolean")
    def whole(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = load(sent.value)
        for batch in batches:
            ids = _lists(_encoded(model, batch))
            yield pa.StructArray.from_arrays([ids, _same(model, batch, ids)], ["tokens", "round_trip"])
        release()

    docs = docs.select("doc_id", "text")
    giant = F.coalesce(F.octet_length("text") > giant_bytes, F.lit(False))
    small = docs.where(~giant).select("doc_id", whole("text").alias("e")).select("doc_id", F.size("e.tokens").alias("n_tokens"), "e.tokens", "e.round_trip")
    small = small.withColumn("n_tokens", F.when(F.col("tokens").isNotNull(), F.col("n_tokens")))
    return small.unionByName(_scanned(spark, docs.where(giant), sent, chunk))


_TRANSFER = "row bigint, nth int, ins array<string>, outs array<string>, best array<double>"


def _said(made: list[tuple]) -> dict[str, list]:
    """Transfers as plain columns; a state is its reach and its step."""
    named = [[[f"{e}:{p}" for e, p in states] for states in (t[k] for t in made)] for k in (0, 1)]
    return {"ins": named[0], "outs": named[1], "best": [t[2].ravel().tolist() for t in made]}


def _state(said: str) -> State:
    reach, _, piece = said.partition(":")
    return int(reach), piece


def _read(ins: list[str], outs: list[str], best: list[float]) -> tuple:
    return [_state(x) for x in ins], [_state(x) for x in outs], np.array(best, float).reshape(len(ins), len(outs))


def _combined(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
    """The product of at most FAN neighbouring transfers."""
    frame = frame.sort_values("nth")
    made = [_read(*x) for x in zip(frame["ins"], frame["outs"], frame["best"], strict=True)]
    total = made[0]
    for t in made[1:]:
        total = compose(total, t)
    return pd.DataFrame({"row": [key[0]], "nth": [key[1]]} | _said([total]))


def _divided(frame: pd.DataFrame) -> pd.DataFrame:
    """The outer states of each of at most FAN neighbours, given those of all together."""
    frame = frame.sort_values("nth")
    made = [_read(*x) for x in zip(frame["ins"], frame["outs"], frame["best"], strict=True)]
    enter, leave = frame["enter"].iloc[0], frame["leave"].iloc[0]
    found = [f"{e}:{p}" for e, p in best_states(made, None if enter is None else _state(enter), None if leave is None else _state(leave))]
    return pd.DataFrame({"row": frame["row"], "nth": frame["nth"], "enter": found[:-1], "leave": found[1:]})


def _scanned(spark: SparkSession, docs: DataFrame, sent: Broadcast, chunk: int) -> DataFrame:
    work = Workspace(spark)
    docs = work.save(docs.withColumn("row", F.monotonically_increasing_id()), "giant")

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(sent.value)
        for batch in batches:
            for row, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                parts = cut_chunks(model, text, chunk)
                n = len(parts)
                for lo in range(0, n, 64):
                    some = parts[lo : lo + 64]
                    columns = [pa.array([row] * len(some), pa.int64()), pa.array(range(lo, lo + len(some)), pa.int32()), pa.array([n] * len(some), pa.int32())]
                    yield pa.record_batch([*columns, *(pa.array(x, pa.string()) for x in zip(*some, strict=True))], ["row", "nth", "parts", "before", "body", "after"])
        release()

    pieces = docs.select("row", "text").mapInArrow(split, "row bigint, nth int, parts int, before string, body string, after string")
    pieces = work.save(pieces.repartition("row", "nth"), "chunks")

    def chunk_of(model: PieceModel, r: dict) -> Chunk:
        return Chunk(model, r["before"], r["body"], r["after"], r["nth"] == 0, r["nth"] == r["parts"] - 1)

    def transfers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(sent.value)
        for batch in batches:
            made = _said([chunk_of(model, r).transfer() for r in batch.to_pylist()])
            kinds = (pa.list_(pa.string()), pa.list_(pa.string()), pa.list_(pa.float64()))
            yield pa.record_batch([batch.column(0), batch.column(1), *(pa.array(v, k) for v, k in zip(made.values(), kinds, strict=True))], ["row", "nth", *made])
        release()

    def traced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(sent.value)
        for batch in batches:
            rows = batch.to_pylist()
            ids = [chunk_of(model, r).backtrace(_state(r["enter"]), _state(r["leave"])) for r in rows]
            yield pa.record_batch([batch.column(0), batch.column(1), _lists(ids)], ["row", "nth", "ids"])
        release()

    above = F.floor(F.col("nth") / FAN).cast("int").alias("above")
    levels, most = [work.save(pieces.mapInArrow(transfers, _TRANSFER), "level0")], (pieces.agg(F.max("parts")).first()[0] or 0)
    while most > FAN:
        most = -(-most // FAN)
        levels.append(work.save(levels[-1].groupBy("row", above).applyInPandas(_combined, _TRANSFER), f"level{len(levels)}"))
    known = levels[-1].select("row", F.lit(0).alias("above"), F.lit(None).cast("string").alias("enter"), F.lit(None).cast("string").alias("leave")).distinct()
    for level in levels[::-1]:
        below = level.withColumn("above", above).join(known, ["row", "above"])
        known = below.groupBy("row", "above").applyInPandas(_divided, "row bigint, nth int, enter string, leave string")
        if level is not levels[0]:
            known = known.withColumnRenamed("nth", "above")
    parts = pieces.join(known, ["row", "nth"]).mapInArrow(traced, "row bigint, nth int, ids array<int>")
    tokens = parts.groupBy("row").agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("nth", "ids"))), lambda x: x["ids"])).alias("tokens"))

    @F.arrow_udf("boolean")
    def same(text: pa.Array, ids: pa.Array) -> pa.Array:
        return _same(load(sent.value), text, ids)

    return docs.join(tokens, "row").select("doc_id", F.size("tokens").alias("n_tokens"), "tokens", same("text", "tokens").alias("round_trip"))


def decode_tokens(tokens: str | Column, model_path: str = MODEL) -> Column:
    """The text of an array of ids; null for a null array, empty for an empty one; ids outside the vocabulary are an error."""
    sent = shipped(SparkSession.active(), model_path)

    @F.arrow_udf("string")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = load(sent.value)
        for batch in batches:
            value, off = _flat(batch)
            if len(value) and (value.min() < 0 or value.max() >= len(model.text)):
                raise ValueError("an id is outside the vocabulary")
            data, at = model.decode_block(value, off)
            raw, null = data.tobytes(), ~np.asarray(batch.is_valid())
            yield pa.array([None if n else raw[a:b].decode("utf-8", "replace") for n, a, b in zip(null, at[:-1], at[1:], strict=True)], pa.string())

    return run(tokens)
