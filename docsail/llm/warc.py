"""WARC archives with per-record Zstandard frames and an embedded dictionary.

An archive starts with a skippable frame that holds a dictionary built from all of the archive's own records, itself compressed
where that is smaller; then every record is one frame compressed with it, so any record can be read from its offset alone.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SKIPPABLE = 0x184D2A5D
FRAME = b"\x28\xb5\x2f\xfd"
ARCHIVE_BYTES = 32 << 20
DICTIONARY_BYTES = 112 << 10
LEVEL = 3
DATE = "2024-01-01T00:00:00Z"
SCHEMA = "archive string, seq int, page_id bigint, start bigint, length int, frame binary"


def record(page_id: int | None, url: str | None, body: str | None, date: str = DATE) -> bytes:
    """A resource record; its id follows from its content, so that a task run again writes the same bytes.

    A null body is an empty block; a null URL has no WARC-Target-URI, and line breaks in one are percent-encoded.
    """
    block = (body or "").encode()
    digest = base64.b32encode(hashlib.sha1(block).digest()).decode()
    name = uuid.uuid5(uuid.NAMESPACE_URL, f"{page_id}|{url}|{digest}")
    head = ["WARC/1.1", "WARC-Type: resource", f"WARC-Record-ID: <urn:uuid:{name}>", f"WARC-Date: {date}"]
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    head += ["Content-Type: text/html", f"WARC-Block-Digest: sha1:{digest}", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def build_dictionary(records: list[bytes], size: int = DICTIONARY_BYTES) -> zstandard.ZstdCompressionDict:
    """A dictionary trained on all the records, on every position of them; an eighth of them at most, so that it pays.

    Training needs several samples, so a few long records are handed over in parts. Records that can't be trained on (too few
    bytes, or all alike) are a raw-content dictionary: the last ``size`` bytes of them.
    """
    total = sum(map(len, records))
    size, step = min(size, max(1 << 10, total // 8)), max(16, total // 64)
    samples = records if len(records) >= 64 else [r[a : a + step] for r in records for a in range(0, len(r), step)]
    try:
        return zstandard.train_dictionary(size, samples, k=1024, d=8, f=20, accel=1)
    except zstandard.ZstdError:
        return zstandard.ZstdCompressionDict(b"".join(records)[-size:], dict_type=zstandard.DICT_TYPE_RAWCONTENT)


def dictionary_frame(dictionary: zstandard.ZstdCompressionDict) -> bytes:
    raw = dictionary.as_bytes()
    small = zstandard.ZstdCompressor(level=19).compress(raw)
    body = small if len(small) < len(raw) else raw
    return struct.pack("<II", SKIPPABLE, len(body)) + body


def frames(records: list[bytes], level: int = LEVEL) -> Iterator[bytes]:
    """The archive's frames in order: the dictionary, then one a record."""
    dictionary = build_dictionary(records)
    yield dictionary_frame(dictionary)
    press = zstandard.ZstdCompressor(level=level, dict_data=dictionary, write_checksum=True)
    for r in records:
        yield press.compress(r)


def read_archive(raw: bytes) -> Iterator[bytes]:
    """The records of an archive's bytes."""
    magic, size = struct.unpack("<II", raw[:8])
    if magic != SKIPPABLE:
        raise ValueError("no leading dictionary frame")
    body = raw[8 : 8 + size]
    if body[:4] == FRAME:
        body = zstandard.ZstdDecompressor().decompress(body)
    kind = zstandard.DICT_TYPE_FULLDICT if body[:4] == b"\x37\xa4\x30\xec" else zstandard.DICT_TYPE_RAWCONTENT
    open_ = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(body, dict_type=kind))
    at = 8 + size
    while at < len(raw):
        step = open_.decompressobj()
        yield step.decompress(raw[at:])
        at = len(raw) - len(step.unused_data)


def parse_record(raw: bytes) -> tuple[dict[str, str], bytes]:
    """(headers, block) of a record; checks its length and digest."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    headers = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(headers["Content-Length"])]
    if rest[len(block) :] != b"\r\n\r\n" or headers["WARC-Block-Digest"] != "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode():
        raise ValueError("damaged record")
    return headers, block


def archive(pages: DataFrame, archive_bytes: int = ARCHIVE_BYTES, level: int = LEVEL, date: str = DATE) -> DataFrame:
    """(archive, seq, page_id, start, length, frame): the frames of the archives that hold every row of pages.

    Each input partition writes its own archives of about ``archive_bytes`` of records, without a shuffle: seq 0 is the
    dictionary (page_id null), the others are the records in order. Null columns, empty and repeated rows are records like any
    other (see ``record``). A page of any length is one record, whole, and so may make an archive longer than ``archive_bytes``;
    a task holds one archive's records. An empty table gives no archive; columns other than page_id, url and html are left out.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, held, ids, size, nth = TaskContext.get().partitionId(), [], [], 0, 0
        for batch in batches:
            for page_id, url, body in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
                held.append(record(page_id, url, body, date))
                ids.append(page_id)
                size += len(held[-1])
                if size >= archive_bytes:
                    yield from shut(f"{place:06d}-{nth:04d}", held, ids)
                    held, ids, size, nth = [], [], 0, nth + 1
        if held:
            yield from shut(f"{place:06d}-{nth:04d}", held, ids)

    def shut(name: str, held: list[bytes], ids: list[int | None]) -> Iterator[pa.RecordBatch]:
        out = list(frames(held, level))
        start = [0]
        for f in out:
            start.append(start[-1] + len(f))
        for a in range(0, len(out), 2000):
            b = min(len(out), a + 2000)
            yield pa.record_batch({
                "archive": pa.array([f"{name}.warc.zst"] * (b - a)),
                "seq": pa.array(range(a, b), pa.int32()),
                "page_id": pa.array([None, *ids][a:b], pa.int64()),
                "start": pa.array(start[a:b], pa.int64()),
                "length": pa.array([len(f) for f in out[a:b]], pa.int32()),
                "frame": pa.array(out[a:b], pa.binary()),
            })

    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(write, SCHEMA)


def write_files(archived: DataFrame, folder: str) -> DataFrame:
    """Writes the archives as files into a folder that all executors reach; returns (archive, records, bytes).

    Each file is written under a name of the attempt and then moved, so that a lost or repeated task leaves whole files only.
    """

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = pyarrow.fs.FileSystem.from_uri(folder)
        system.create_dir(base, recursive=True)
        name, out, done = None, None, []
        attempt = TaskContext.get().taskAttemptId()

        def shut() -> None:
            out.close()
            system.move(f"{base}/.{name}.{attempt}", f"{base}/{name}")

        for batch in batches:
            for archive_name, frame in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if archive_name != name:
                    if out:
                        shut()
                    name, out = archive_name, system.open_output_stream(f"{base}/.{archive_name}.{attempt}")
                    done.append([name, -1, 0])
                out.write(frame)
                done[-1][1] += 1
                done[-1][2] += len(frame)
        if out:
            shut()
        for row in done:
            yield pa.record_batch({"archive": pa.array([row[0]]), "records": pa.array([row[1]], pa.int64()), "bytes": pa.array([row[2]], pa.int64())})

    rows = archived.repartition("archive").sortWithinPartitions("archive", "seq").select("archive", "frame")
    return rows.mapInArrow(put, "archive string, records bigint, bytes bigint")
