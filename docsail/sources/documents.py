"""Documents as JSON: files of many, checks against a mapping, generated ids, and the rows of the log."""

from __future__ import annotations

import base64
import json
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docsail.errors import bad_request
from docsail.operators.merge import SCHEMA
from docsail.schema import Mapping, document_error, json_error

_DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


def base62(n: int) -> str:
    out = ""
    while True:
        n, digit = divmod(n, 62)
        out = _DIGITS[digit] + out
        if n == 0:
            return out


def base62_column(n: Column) -> Column:
    digits = [F.substring(F.lit(_DIGITS), F.pmod(F.floor(n / F.lit(62**k)), F.lit(62)).cast("int") + 1, F.lit(1)) for k in range(10, -1, -1)]
    return F.regexp_replace(F.concat(*digits), "^0+(?=.)", "")


def new_write() -> str:
    """A name for one write, from which the ids of its documents without one derive."""
    return base64.urlsafe_b64encode(uuid.uuid4().bytes).decode().rstrip("=")


def problem(doc: str | Column, mapping: Mapping) -> Column:
    """Why each JSON document can't be stored, null where it can."""

    @F.arrow_udf("string")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([json_error(x, mapping) for x in batch.to_pylist()], pa.string())

    return run(doc)


def read_bulk(spark: SparkSession, path: str, kind: str = "json") -> DataFrame:
    """(_doc, _pos) of a file of documents: one object with an array of them (json), or one a line (jsonl), which splits by size.

    A line's position is the bytes of the files before its own (by name) and of the splits before its own, plus the lines before it
    in its split: it grows along the files, as every line has a byte at least.
    """
    if kind == "json":
        read = spark.read.schema("documents array<string>, _bad string").option("multiLine", True).option("columnNameOfCorruptRecord", "_bad").json(path).cache()
        try:
            if read.where("_bad is not null or documents is null").limit(1).count():
                raise bad_request("the file must be an object with an array of documents")
        finally:
            read.unpersist()
        return read.select(F.posexplode("documents").alias("_pos", "_doc"))
    if kind != "jsonl":
        raise bad_request("type must be json or jsonl")
    at = F.struct(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("size"), F.col("_metadata.file_block_start").alias("start"))
    lines = spark.read.text(path).select("value", at.alias("at"), F.monotonically_increasing_id().alias("nth")).select("value", "at.*", "nth")
    splits = lines.groupBy("path", "size", "start").agg(F.min("nth").alias("first"))
    before = Window.orderBy("path").rowsBetween(Window.unboundedPreceding, -1)  # a row a file
    files = splits.select("path", "size").distinct().select("path", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("ahead"))
    lines = lines.where("trim(value) <> ''").join(splits.join(files, "path"), ["path", "size", "start"])
    return lines.select((F.col("ahead") + F.col("start") + F.col("nth") - F.col("first")).alias("_pos"), F.col("value").alias("_doc"))


def log_of_bulk(rows: DataFrame, mapping: Mapping, seq: int, write: str) -> DataFrame:
    """The log's rows of bulk documents; BAD_REQUEST if one of them can't be stored. Later ones of an id win."""
    wrong = rows.select(problem("_doc", mapping).alias("why")).where("why is not null").limit(1).collect()
    if wrong:
        raise bad_request(wrong[0].why)
    own = F.get_json_object("_doc", "$.id")
    place = F.concat(F.lit(write), base62_column(F.col("_pos")))
    doc = F.when(own.isNull(), F.concat(F.lit('{"id":"'), place, F.lit('",'), F.ltrim(F.substring(F.ltrim("_doc"), 2, 2147483647)))).otherwise(F.col("_doc"))
    doc = F.regexp_replace(doc, r'^(\{"id":"[^"]*"),\s*\}\s*$', "$1}")
    return rows.select(F.coalesce(own, place).alias("id"), F.lit(seq).alias("_seq"), F.col("_pos").cast("bigint").alias("_pos"), F.lit(False).alias("_deleted"), doc.alias("_doc"))


def log_of_documents(spark: SparkSession, documents: list[dict], mapping: Mapping, seq: int) -> tuple[DataFrame, list[str]]:
    """The log's rows of documents in hand, and their ids in order."""
    if not isinstance(documents, list) or not documents:
        raise bad_request("documents must be a non-empty array")
    write, rows = new_write(), []
    for i, doc in enumerate(documents):
        if why := document_error(doc, mapping):
            raise bad_request(why)
        doc = doc if "id" in doc else {"id": write + base62(i)} | doc
        rows.append((doc["id"], seq, i, False, json.dumps(doc, ensure_ascii=False)))
    return spark.createDataFrame(rows, SCHEMA), [r[0] for r in rows]


def log_of_deletes(spark: SparkSession, ids: list[str], seq: int) -> DataFrame:
    if not isinstance(ids, list) or not ids or not all(isinstance(i, str) and i for i in ids):
        raise bad_request("ids must be a non-empty array of strings")
    return spark.createDataFrame([(i, seq, 0, True, None) for i in ids], SCHEMA)
