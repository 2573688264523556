"""Search over one relation: filter and rank, sort, cut, project, fetch by id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docsail.errors import bad_request
from docsail.plans.compiler import Compiler, field_column
from docsail.plans.nodes import Everything
from docsail.plans.requests import read_query
from docsail.schema import SORTABLE, Mapping

MAX_SIZE = 1000


def sort_keys(df: DataFrame, mapping: Mapping, sort: list | None) -> list[Column]:
    """Every key of the request in turn, missing values last either way, then the id; without keys, the score, then the id."""
    if sort is None:
        return [F.desc("score"), F.asc("id")]
    if not isinstance(sort, list) or not sort:
        raise bad_request("sort must be a non-empty array")
    keys = []
    for element in sort:
        if not isinstance(element, dict) or len(element) != 1:
            raise bad_request("an element of sort must have one field")
        (path, direction), = element.items()
        declared = mapping.leaf(path)
        if declared is None or declared.kind not in SORTABLE:
            raise bad_request(f"'{path}' can't be sorted by")
        if str(direction or "asc").lower() not in ("asc", "desc"):
            raise bad_request("the direction must be asc or desc")
        scalar = f"_k_{path}"
        c = F.col(f"`{scalar}`") if scalar in df.columns else field_column(df, path)
        keys.append(F.desc_nulls_last(c) if str(direction or "asc").lower() == "desc" else F.asc_nulls_last(c))
    return [*keys, F.asc("id")]


def check_size(size: int) -> None:
    if not isinstance(size, int) or isinstance(size, bool) or not 1 <= size <= MAX_SIZE:
        raise bad_request(f"size must be from 1 to {MAX_SIZE}")


def matching(df: DataFrame, mapping: Mapping, query: dict | None) -> DataFrame:
    """The rows that match, with their score beside their columns."""
    compiler = Compiler(df, mapping)
    pair = compiler.compile(Everything() if query is None else read_query(query, mapping))
    return compiler.relation().where(pair.match).withColumn("score", pair.score)


def search(df: DataFrame, mapping: Mapping, query: dict | None = None, size: int = 10, sort: list | None = None, fields: list[str] | None = None, track_scores: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, score, fields...) of the first ``size`` rows; with a sort, scores are null unless they are tracked.

    A field is named by its dotted path and is flat in the result. Fields are taken after sorting, so a key needn't be among them.
    """
    check_size(size)
    if query is None and sort is None:
        raise bad_request("a request needs a query or a sort")
    if track_scores and sort is None:
        raise bad_request("trackScores needs a sort")
    found = matching(df, mapping, query)
    if sort is not None and not track_scores:
        found = found.withColumn("score", F.lit(None).cast("double"))
    top = found.orderBy(*sort_keys(df, mapping, sort)).limit(size)
    return project(top, mapping, fields, ["id", "score", *keep])


def project(df: DataFrame, mapping: Mapping, fields: list[str] | None, always: list[str]) -> DataFrame:
    wanted = [] if fields is None else [f for f in fields if f not in always]
    if unknown := [f for f in wanted if mapping.leaf(f) is None]:
        raise bad_request(f"unknown field '{unknown[0]}'")
    return df.select(*always, *[field_column(df, f).alias(f.replace(".", "_")) for f in wanted])


def fetch(df: DataFrame, mapping: Mapping, ids: list[str], fields: list[str] | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, fields...) of the rows with these ids; ids that don't exist are absent, repeated ones count once."""
    if not isinstance(ids, list) or not 1 <= len(ids) <= MAX_SIZE:
        raise bad_request(f"ids must hold 1 to {MAX_SIZE}")
    return project(df.where(F.col("id").isin(ids)), mapping, fields, ["id", *keep])


def max_score(hits: DataFrame, sorted_: bool) -> DataFrame:
    """(max_score): of unsorted hits the first one's; of sorted ones the largest that isn't null, -1 if all are; none for no hits."""
    best = F.max("score")
    return hits.agg(F.count("*").alias("n"), (F.coalesce(best, F.lit(-1.0)) if sorted_ else best).alias("max_score")).where("n > 0").select("max_score")
