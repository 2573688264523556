"""Merging a log of writes into a collection, in any order and any batching.

A stored row is (id, _seq, _pos, _deleted, _doc): the last write of its id, tombstones included. The greatest (_seq, _pos) wins, so
merging commutes and can be repeated. A delete by filter hides the rows that match it and were written before it, from when it is
given until a build has made tombstones of them; those keep the rows' own (_seq, _pos), so a write that arrives late still finds
its place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docsail.errors import bad_request
from docsail.functions.analysis import english, tokens
from docsail.plans.compiler import Compiler, known, token_name
from docsail.plans.requests import read_query
from docsail.schema import Mapping
from docsail.session import small_batches

STORED = ["id", "_seq", "_pos", "_deleted", "_doc"]
SCHEMA = "id string, _seq bigint, _pos bigint, _deleted boolean, _doc string"
_TYPES = {"text": "string", "boolean": "string", "long": "bigint", "double": "double", "datetime": "string", "vector": "array<float>"}


def merge(base: DataFrame | None, log: DataFrame) -> DataFrame:
    """The last write of every id in the base and the log: one aggregation by id, partial before the shuffle."""
    rows = [d.select("id", F.col("_seq").cast("bigint").alias("_seq"), F.col("_pos").cast("bigint").alias("_pos"), "_deleted", "_doc") for d in (base, log) if d is not None]
    every = rows[0] if len(rows) == 1 else rows[0].unionByName(rows[1])
    last = every.groupBy("id").agg(F.max(F.struct("_seq", "_pos", "_deleted", "_doc")).alias("w"))
    return last.select("id", "w._seq", "w._pos", "w._deleted", "w._doc")


def typed(rows: DataFrame, mapping: Mapping) -> DataFrame:
    """Stored rows with the declared fields as columns under their dotted names.

    A keyword is an array of its values, with its only value beside it (null for an array) and whether it is an array, which are
    plain columns that a scan can filter by; what can't be read is null.
    """
    rows = rows.withColumn("_v", F.try_parse_json("_doc"))
    columns: dict[str, Column] = {}
    for path, f in mapping.flat.items():
        if path == "id":
            continue
        at = "$" + "".join(f"['{p}']" for p in path.split("."))
        if f.kind == "keyword":
            many, one = F.try_variant_get("_v", at, "array<string>"), F.try_variant_get("_v", at, "string")
            columns[path] = F.coalesce(many, F.when(one.isNotNull(), F.array(one)))
            columns[f"_k_{path}"] = F.when(many.isNull(), one)
            columns[f"_m_{path}"] = many.isNotNull()
        elif f.kind == "boolean":
            columns[path] = F.lower(F.try_variant_get("_v", at, "string")) == "true"
        elif f.kind == "datetime":
            columns[path] = F.date_trunc("millisecond", F.try_to_timestamp(F.try_variant_get("_v", at, "string")))
        else:
            columns[path] = F.try_variant_get("_v", at, _TYPES[f.kind])
    return rows.withColumns(columns).drop("_v")


def with_tokens(rows: DataFrame, mapping: Mapping) -> DataFrame:
    """Typed rows with the tokens of every text, so that no query has to analyse texts again; English ones come from standard ones."""
    wanted = [(p, a, f.analyzers) for p, f in mapping.flat.items() if f.kind == "text" for a in f.analyzers]
    if any(a != "standard" for _, a, _ in wanted):
        small_batches(rows.sparkSession)
    derived = {token_name(p, a): english(F.col(token_name(p, "standard"))) for p, a, others in wanted if a == "english" and "standard" in others}
    found = {name: tokens(F.col(f"`{p}`"), a) for p, a, _ in wanted if (name := token_name(p, a)) not in derived}
    for columns in (found, derived):
        rows = rows.withColumns(columns) if columns else rows
    return rows


def hidden(rows: DataFrame, mapping: Mapping, filters: list[tuple[dict, int]]) -> Column:
    """Whether a later delete by filter covers a row."""
    out = F.lit(False)
    for query, seq in filters:
        compiler = Compiler(rows, mapping)
        match = compiler.compile(read_query(query, mapping)).match
        if compiler.nearest:
            raise bad_request("a delete filter can't use knn")
        out = out | ((F.col("_seq") < seq) & known(match))
    return out


def buried(rows: DataFrame, mapping: Mapping, filters: list[tuple[dict, int]]) -> DataFrame:
    """Typed rows with their tokens, those that a delete by filter covers as tombstones of the same (_seq, _pos)."""
    gone = ~F.col("_deleted") & hidden(rows, mapping, filters)
    kept = {c: F.when(~F.col("_gone"), F.col(f"`{c}`")) for c in rows.columns if c not in STORED[:4]}
    return rows.withColumn("_gone", gone).withColumns(kept | {"_deleted": F.col("_deleted") | F.col("_gone")}).drop("_gone")


def current(rows: DataFrame, mapping: Mapping, filters: list[tuple[dict, int]] | None = None, store: bool = False) -> DataFrame:
    """The live rows of a merged collection, typed; with their tokens for storing."""
    live = typed(rows.where("not _deleted"), mapping)
    if filters or store:
        live = with_tokens(live, mapping)
    return live.where(~hidden(live, mapping, filters)) if filters else live
