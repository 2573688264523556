"""Media columns: PNG images in binary columns, decoded by zlib and numpy, and their low-frequency cosine-transform hashes.

Images of one shape are decoded together, as a stack, up to BAND bytes of them; a larger image is decoded in bands of scan
lines, each of which needs only the last line of the band before. The hash is a linear function of the pixels up to its last
step, so every band (and every pass of an interlaced image) adds its share and is forgotten: memory doesn't grow with an image.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SIGNATURE = b"\x89PNG\r\n\x1a\n"
CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}
DEPTHS = {0: (1, 2, 4, 8, 16), 2: (8, 16), 3: (1, 2, 4, 8), 4: (8, 16), 6: (8, 16)}
ADAM7 = ((0, 0, 8, 8), (4, 0, 8, 8), (0, 4, 4, 8), (2, 0, 4, 4), (0, 2, 2, 4), (1, 0, 2, 2), (0, 1, 1, 2))
BAND = 1 << 22
SIDE = 32


class BadImage(ValueError):
    """Why a PNG can't be read."""


def chunks(raw: bytes) -> Iterator[tuple[bytes, bytes]]:
    """(type, data) of every chunk up to IEND, each checked against its CRC."""
    if raw[:8] != SIGNATURE:
        raise BadImage("signature")
    at = 8
    while True:
        if at + 12 > len(raw):
            raise BadImage("truncated")
        size, kind = struct.unpack(">I4s", raw[at : at + 8])
        if at + 12 + size > len(raw):
            raise BadImage("truncated")
        data = raw[at + 8 : at + 8 + size]
        if zlib.crc32(kind + data) != struct.unpack(">I", raw[at + 8 + size : at + 12 + size])[0]:
            raise BadImage("checksum")
        yield kind, data
        if kind == b"IEND":
            return
        at += 12 + size


def unfiltered(lines: np.ndarray, step: int, above: np.ndarray | None = None) -> np.ndarray:
    """(images, rows, row bytes) of a stack of filtered scan lines (images, rows, 1 + row bytes), by anti-diagonals.

    A byte needs its left, upper and upper-left neighbours a pixel (``step`` bytes) away; those on one anti-diagonal of pixels
    need none of each other, so each diagonal of all images is one vectorised step. ``above``: the line before, zero by default.
    """
    images, rows, row_bytes = lines.shape[0], lines.shape[1], lines.shape[2] - 1
    kind = lines[:, :, 0].T
    if (kind > 4).any():
        raise BadImage("filter")
    width = -(-row_bytes // step)
    body = np.zeros((rows, width * step, images), np.uint8)
    body[:, :row_bytes] = lines[:, :, 1:].transpose(1, 2, 0)
    if not kind.any():
        return body[:, :row_bytes].transpose(2, 0, 1)
    out = np.zeros((rows + 1, width + 1, step, images), np.uint8)
    if above is not None:
        out[0, 1:].reshape(width * step, images)[:row_bytes] = above.T
    body = body.reshape(rows, width, step, images)
    sub, up_, mean, path = ((kind == k).astype(np.int16)[:, None, :] for k in (1, 2, 3, 4))
    averages, paths = bool(mean.any()), bool(path.any())
    every = np.arange(rows)
    for d in range(rows + width - 1):
        lo, hi = max(0, d - width + 1), min(rows, d + 1)
        y, x = every[lo:hi], d - every[lo:hi]
        left, up = out[y + 1, x].astype(np.int16), out[y, x + 1].astype(np.int16)
        guess = sub[lo:hi] * left + up_[lo:hi] * up
        if averages:
            guess += mean[lo:hi] * ((left + up) >> 1)
        if paths:
            corner = out[y, x].astype(np.int16)
            pa_, pb, pc = np.abs(up - corner), np.abs(left - corner), np.abs(left + up - 2 * corner)
            guess += path[lo:hi] * np.where((pa_ <= pb) & (pa_ <= pc), left, np.where(pb <= pc, up, corner))
        out[y + 1, x + 1] = body[y, x] + guess.astype(np.uint8)
    return out[1:, 1:].reshape(rows, width * step, images)[:, :row_bytes].transpose(2, 0, 1)


class Header(NamedTuple):
    width: int
    height: int
    depth: int
    color: int
    interlace: int

    @property
    def channels(self) -> int:
        return CHANNELS[self.color]

    @property
    def step(self) -> int:
        return max(1, self.channels * self.depth // 8)

    def passes(self) -> list[tuple[slice, slice, int, int, int]]:
        """(rows, columns, how many rows, how many columns, bytes of a row) of every pass."""
        found = ADAM7 if self.interlace else ((0, 0, 1, 1),)
        sizes = [(x, y, dx, dy, -(-(self.height - y) // dy), -(-(self.width - x) // dx)) for x, y, dx, dy in found if x < self.width and y < self.height]
        return [(slice(y, None, dy), slice(x, None, dx), h, w, -(-w * self.channels * self.depth // 8)) for x, y, dx, dy, h, w in sizes]

    def bytes(self) -> int:
        return sum(h * (b + 1) for *_, h, _, b in self.passes())


class Packed(NamedTuple):
    header: Header
    palette: np.ndarray | None
    data: bytes


def unpacked(raw: bytes) -> Packed:
    """An image's header, palette and compressed data; BadImage says what is wrong."""
    header, palette, packed = None, None, []
    for kind, data in chunks(raw):
        if header is None and kind != b"IHDR":
            raise BadImage("header")
        if kind == b"IHDR":
            if len(data) != 13:
                raise BadImage("header")
            header = struct.unpack(">IIBBBBB", data)
        elif kind == b"PLTE":
            palette = np.frombuffer(data[: len(data) // 3 * 3], np.uint8).reshape(-1, 3)
        elif kind == b"IDAT":
            packed.append(data)
        elif kind != b"IEND" and not kind[0] & 32:
            raise BadImage("chunk")
    width, height, depth, color, method, filtering, interlace = header
    if not width or not height or depth not in DEPTHS.get(color, ()) or method or filtering or interlace > 1 or (color == 3 and (palette is None or not len(palette))):
        raise BadImage("header")
    return Packed(Header(width, height, depth, color, interlace), palette, b"".join(packed))


def _samples(lines: np.ndarray, width: int, channels: int, depth: int) -> np.ndarray:
    """(images, rows, width, channels) of lines (images, rows, row bytes)."""
    shape = (*lines.shape[:2], width, channels)
    if depth == 16:
        pairs = np.ascontiguousarray(lines).reshape(*shape, 2)
        return pairs[..., 0].astype(np.uint16) << 8 | pairs[..., 1]
    if depth == 8:
        return np.ascontiguousarray(lines).reshape(shape)
    bits = np.unpackbits(np.ascontiguousarray(lines), axis=2)[:, :, : width * channels * depth].reshape(*shape, depth)
    return (bits @ (1 << np.arange(depth - 1, -1, -1)).astype(np.uint8)).astype(np.uint8)


def inflated(data: bytes, need: int) -> bytes:
    """All of a small image's filtered bytes."""
    inflate = zlib.decompressobj()
    try:
        out = inflate.decompress(data, need + 1)
        if len(out) <= need and not inflate.eof:
            out += inflate.flush()
    except zlib.error:
        raise BadImage("deflate") from None
    if len(out) != need or not inflate.eof:
        raise BadImage("deflate")
    return out


def bands(packed: Packed) -> Iterator[tuple[int, int, np.ndarray]]:
    """(pass, first row in it, samples (1, rows, width, channels)) of one image, BAND bytes at a time, or a scan line if longer."""
    head, inflate, waiting = packed.header, zlib.decompressobj(), packed.data

    def take(n: int) -> bytes:
        nonlocal waiting
        out = []
        while n:
            try:
                part = inflate.decompress(waiting, n)
            except zlib.error:
                raise BadImage("deflate") from None
            waiting = inflate.unconsumed_tail
            if not part and not waiting:
                raise BadImage("deflate")
            out.append(part)
            n -= len(part)
        return b"".join(out)

    for nth, (_, _, rows, width, size) in enumerate(head.passes()):
        above, step = None, max(1, BAND // (size + 1))
        for first in range(0, rows, step):
            n = min(step, rows - first)
            lines = np.frombuffer(take(n * (size + 1)), np.uint8).reshape(1, n, size + 1)
            done = unfiltered(lines, head.step, above)
            above = done[:, -1]
            yield nth, first, _samples(done, width, head.channels, head.depth)
    try:
        rest = inflate.decompress(waiting, 1)
    except zlib.error:
        raise BadImage("deflate") from None
    if rest or not inflate.eof:
        raise BadImage("deflate")


def stacked(head: Header, data: list[bytes]) -> Iterator[tuple[int, int, np.ndarray]]:
    """The same of several images of one shape together, each given by its filtered bytes."""
    flat, at = np.frombuffer(b"".join(data), np.uint8).reshape(len(data), -1), 0
    for nth, (_, _, rows, width, size) in enumerate(head.passes()):
        lines = flat[:, at : at + rows * (size + 1)].reshape(len(data), rows, size + 1)
        at += rows * (size + 1)
        yield nth, 0, _samples(unfiltered(lines, head.step), width, head.channels, head.depth)


def _scaled(samples: np.ndarray, packed: Packed) -> np.ndarray:
    """Samples from 0 to 255; red, green and blue of a palette."""
    if packed.header.color != 3:
        return samples * (255.0 / ((1 << packed.header.depth) - 1))
    if samples.max() >= len(packed.palette):
        raise BadImage("palette")
    return packed.palette[samples[..., 0]].astype(np.float64)


def decode(raw: bytes) -> np.ndarray:
    """(height, width, channels) of a whole image in memory, from 0 to 255; BadImage says what is wrong with it."""
    packed = unpacked(raw)
    head, image = packed.header, None
    for nth, first, samples in bands(packed):
        rows, columns, *_ = head.passes()[nth]
        part = _scaled(samples, packed)[0]
        if image is None:
            image = np.zeros((head.height, head.width, part.shape[2]))
        image[rows, columns][first : first + len(part)] = part
    return image


def encode(images: np.ndarray) -> list[bytes]:
    """PNGs of a stack (images, height, width, channels) of 8-bit samples, the filter of each line chosen by least absolute sum."""
    images = np.asarray(images, np.uint8)
    n, h, w, channels = images.shape
    now = images.astype(np.int16)
    left, up, corner = np.zeros_like(now), np.zeros_like(now), np.zeros_like(now)
    left[:, :, 1:], up[:, 1:], corner[:, 1:, 1:] = now[:, :, :-1], now[:, :-1], now[:, :-1, :-1]
    a, b, c = np.abs(up - corner), np.abs(left - corner), np.abs(left + up - 2 * corner)
    paeth = np.where((a <= b) & (a <= c), left, np.where(b <= c, up, corner))
    lines = np.stack([now, now - left, now - up, now - ((left + up) >> 1), now - paeth]).astype(np.uint8).reshape(5, n, h, -1)
    kind = np.minimum(lines, -lines).sum(axis=3, dtype=np.int64).argmin(axis=0)
    chosen = np.take_along_axis(lines, kind[None, :, :, None], axis=0)[0]
    bodies = np.concatenate([kind[:, :, None].astype(np.uint8), chosen], axis=2).reshape(n, -1)
    color = {1: 0, 2: 4, 3: 2, 4: 6}[channels]

    def chunk(name: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + name + data + struct.pack(">I", zlib.crc32(name + data))

    head = SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, color, 0, 0, 0))
    tail = chunk(b"IEND", b"")
    return [head + chunk(b"IDAT", zlib.compress(x.tobytes())) + tail for x in bodies]


def _basis(n: int, terms: int) -> np.ndarray:
    return np.cos(np.pi * (2 * np.arange(n)[None, :] + 1) * np.arange(terms)[:, None] / (2 * n))


_DCT = _basis(SIDE, 8)


@lru_cache(maxsize=256)
def _shrink(size: int, lo: int, hi: int) -> np.ndarray:
    """(SIDE, hi - lo): what the places lo .. hi of an axis add to the mean over the part of it that each of SIDE cells covers."""
    edges = np.arange(SIDE + 1) * (size / SIDE)
    at = np.arange(lo, hi)[None, :]
    return np.clip(np.minimum(edges[1:, None], at + 1) - np.maximum(edges[:-1, None], at), 0, None) * (SIDE / size)


def brightness(image: np.ndarray) -> np.ndarray:
    """Of the last axis's channels (grey, grey and alpha, red green blue, or these and alpha); transparent is dark."""
    channels = image.shape[-1]
    gray = image[..., :3] @ [0.299, 0.587, 0.114] if channels >= 3 else image[..., 0]
    return gray * (image[..., -1] / 255.0) if channels in (2, 4) else gray


def shrunk(parts: Iterator[tuple[int, int, np.ndarray]], packed: Packed) -> np.ndarray:
    """(images, SIDE, SIDE) mean brightness of the cells of a grid over the images, added up over their bands and passes."""
    head = packed.header
    total, passes = 0.0, head.passes()
    for nth, first, samples in parts:
        rows, columns, *_ = passes[nth]
        lo, hi = rows.start + first * rows.step, rows.start + (first + samples.shape[1] - 1) * rows.step + 1
        tall = _shrink(head.height, lo, hi)[:, :: rows.step]
        wide = _shrink(head.width, 0, head.width)[:, columns]
        total = total + tall @ brightness(_scaled(samples, packed)) @ wide.T
    return total


def cosine_hashes(small: np.ndarray) -> list[bytes]:
    """64 bits an image: which of the 8 x 8 lowest cosine frequencies of the brightness lie above their median; row by row."""
    low = np.round(_DCT @ small @ _DCT.T, 6).reshape(len(small), 64)
    return [x.tobytes() for x in np.packbits(low > np.median(low[:, 1:], axis=1)[:, None], axis=1)]


def cosine_hash(raw: bytes) -> bytes:
    packed = unpacked(raw)
    return cosine_hashes(shrunk(bands(packed), packed))[0]


def inspect(column: pa.Array) -> pa.StructArray:
    """struct(status, width, height, channels, dct_hash); status is ok or what is wrong, null with all else for a null image."""
    rows: list[tuple] = [(None,) * 5] * len(column)
    stacks: dict[tuple, list[tuple[int, bytes]]] = {}

    def done(packed: Packed, parts: Callable[[], Iterator], at: list[int]) -> None:
        head = packed.header
        try:
            for i, h in zip(at, cosine_hashes(shrunk(parts(), packed)), strict=True):
                rows[i] = ("ok", head.width, head.height, 3 if head.color == 3 else head.channels, h)
        except BadImage as e:
            for i in at:
                rows[i] = (str(e), None, None, None, None)

    def shut(packed: Packed, held: list[tuple[int, bytes]]) -> None:
        lines = [np.frombuffer(x, np.uint8) for _, x in held]
        starts = np.concatenate([np.arange(h) * (b + 1) + at for (*_, h, _, b), at in zip(packed.header.passes(), _starts(packed.header), strict=True)])
        bad = [bool((x[starts] > 4).any()) for x in lines]
        for k, (i, _) in enumerate(held):
            if bad[k]:
                rows[i] = ("filter", None, None, None, None)
        if good := [x for x, wrong in zip(held, bad, strict=True) if not wrong]:
            done(packed, lambda: stacked(packed.header, [x for _, x in good]), [i for i, _ in good])

    for i in range(len(column)):
        if not column[i].is_valid:
            continue
        try:
            packed = unpacked(column[i].as_py())
            need = packed.header.bytes()
            if need > BAND or packed.header.color == 3:
                done(packed, lambda packed=packed: bands(packed), [i])
                continue
            key = packed.header
            held = stacks.setdefault(key, [])
            held.append((i, inflated(packed.data, need)))
            if len(held) * need >= BAND:
                shut(packed, stacks.pop(key))
        except BadImage as e:
            rows[i] = (str(e), None, None, None, None)
    for head, held in stacks.items():
        shut(Packed(head, None, b""), held)
    kinds = (("status", pa.string()), ("width", pa.int32()), ("height", pa.int32()), ("channels", pa.int32()), ("dct_hash", pa.binary()))
    columns = [pa.array([r[k] for r in rows], kind) for k, (_, kind) in enumerate(kinds)]
    return pa.StructArray.from_arrays(columns, [name for name, _ in kinds])


def _starts(head: Header) -> np.ndarray:
    """Where each pass begins among an image's filtered bytes."""
    return np.cumsum([0] + [h * (b + 1) for *_, h, _, b in head.passes()])[:-1]


def hash_images(images: DataFrame, key: str, image: str = "image") -> DataFrame:
    """(key, image, status, width, height, channels, dct_hash) for every row, in one pass without a shuffle.

    A null image has nulls; an unreadable one has the reason as status and nulls. An image of any size is read, a few MB or, if
    that is longer, a scan line at a time. Null keys and repeated rows pass through; an empty table gives an empty result;
    further columns, of whatever name, are left out. Where the key has the name of another column of the result, that one ends in _.
    """

    @F.arrow_udf("status string, width int, height int, channels int, dct_hash binary")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield inspect(batch)

    names = ("image", "status", "width", "height", "channels", "dct_hash")
    rows = images.select(F.struct(F.col(f"`{key}`").alias("k"), F.col(f"`{image}`").alias("v")).alias("of"))
    found = rows.withColumn("is", run("of.v"))
    return found.select(F.col("of.k").alias(key), *[F.col("of.v" if n == "image" else f"is.{n}").alias(f"{n}_" if n == key else n) for n in names])


def vector_image(vector: str | Column) -> Column:
    """A square grey PNG of a vector, row by row, 0 at mid-grey and 0.5 to white; null for a null or empty vector, missing
    or not finite values as mid-grey."""

    @F.arrow_udf("binary")
    def run(column: pa.Array) -> pa.Array:
        lists = column.cast(pa.list_(pa.float64()))
        size = np.diff(np.asarray(lists.offsets)).astype(np.int64)
        value = lists.flatten().to_numpy(zero_copy_only=False)
        size[~np.asarray(lists.is_valid())] = 0
        start = np.cumsum(size) - size
        pixel = np.clip(np.round(128 + 255 * np.nan_to_num(value, posinf=0, neginf=0)), 0, 255).astype(np.uint8)
        out: list[bytes | None] = [None] * len(column)
        for n in np.unique(size[size > 0]):
            side = int(np.ceil(np.sqrt(n)))
            every = np.flatnonzero(size == n)
            for at in np.array_split(every, -(-len(every) * side * side // BAND)):
                square = np.full((len(at), side * side), 128, np.uint8)
                square[:, :n] = pixel[start[at][:, None] + np.arange(n)]
                for i, raw in zip(at, encode(square.reshape(-1, side, side, 1)), strict=True):
                    out[i] = raw
        return pa.array(out, pa.binary())

    return run(vector)
