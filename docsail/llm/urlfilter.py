"""URL filters by a sort-merge range join.

A canonical key is the host's labels in reverse, each with a dot, then the path: ``com.example.blog./en/7``. A rule for a host
and all hosts under it, or for a path on one host, is then a key prefix, that is, an interval of keys. URLs and rules are range
partitioned and sorted together; a sweep over each partition keeps the stack of the nested rules that are active.

Rules nest, so the ones that reach over a partition's bound are prefixes of that bound: each is copied to the partitions it
reaches. A key that many rows share is spread over all the partitions between whose bounds it lies.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_PER_PARTITION = 1_000_000
_SAMPLES = 16
_MOST_PARTITIONS = 8192
_URL = r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?(\[[^\]/]*\]|[^/?#:@\[\]]+)(?::[0-9]*)?([^#]*)"


def canonical_key(url: str | Column) -> Column:
    """Reversed host and path, without scheme, user, port, fragment and final dots of the host; null where there is no host.

    The host is in lower case and may be an address in brackets; percent-escapes are left as they are written.
    """
    url = F.col(url) if isinstance(url, str) else url
    host = F.rtrim(F.lower(F.regexp_extract(url, _URL, 1)), F.lit("."))
    path = F.regexp_extract(url, _URL, 2)
    path = F.when(F.startswith(path, F.lit("/")), path).otherwise(F.concat(F.lit("/"), path))
    return F.when(host != "", F.concat(F.concat_ws(".", F.reverse(F.split(host, r"\."))), F.lit("."), path))


def rule_prefix(pattern: str | Column) -> Column:
    """The key prefix of a rule: ``example.com`` covers the host and those under it, ``example.com/a/`` a path of that host alone."""
    pattern = F.col(pattern) if isinstance(pattern, str) else pattern
    host = F.rtrim(F.lower(F.regexp_extract(pattern, r"^([^/]+)", 1)), F.lit("."))
    return F.when(host != "", F.concat(F.concat_ws(".", F.reverse(F.split(host, r"\."))), F.lit("."), F.regexp_extract(pattern, r"(/.*)$", 1)))


def _bounds(keys: DataFrame, partitions: int, total: int) -> np.ndarray:
    """Partition bounds from a hash sample of about _SAMPLES keys a partition; they decide balance only, never a result."""
    share = min(1.0, partitions * _SAMPLES / max(1, total))
    rows = keys.where(F.pmod(F.xxhash64("row"), F.lit(1 << 30)) < int(share * (1 << 30))).select("key").toLocalIterator()
    at = sorted(r[0].encode() for r in rows) if partitions > 1 else []
    return _bytes([at[len(at) * i // partitions] for i in range(1, partitions)] if len(at) >= partitions else [])


def _bytes(values: list[bytes]) -> np.ndarray:
    out = np.empty(len(values), object)
    out[:] = values
    return out


def apply_rules(spark: SparkSession, urls: DataFrame, rules: DataFrame, key: str = "page_id", url: str = "url") -> DataFrame:
    """(key, url, n_rules, rule, action) for every row of urls.

    ``rules`` has (pattern, action). ``n_rules`` counts the rules that cover the URL; ``rule`` and ``action`` are those of the
    most specific one, ties going to the least pattern, then the least action; null where none does. A null or empty URL, or one
    without a host, has no rule; very long ones are compared whole. Rules with a null or empty pattern are left out and repeated
    rules count once. Null keys and repeated rows pass through; empty tables of either kind are allowed; further columns are left
    out. Where the key or the URL has the name of another column of the result, that one ends in _.

    A partition is swept as a stream, so their number is bounded (_MOST_PARTITIONS) and with it the sample behind their bounds.
    """
    rows = urls.select(F.col(f"`{key}`").alias("row"), F.col(f"`{url}`").alias("url")).withColumn("key", canonical_key("url"))
    known = rules.select("pattern", "action", rule_prefix("pattern").alias("key")).where("key is not null").distinct()
    total = rows.count()
    partitions = min(_MOST_PARTITIONS, max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1 + total // _PER_PARTITION))
    bounds = _bounds(rows.where("key is not null"), partitions, total)

    @F.arrow_udf("int")
    def place(column: pa.Array, salt: pa.Array) -> pa.Array:
        raw = _bytes(pc.fill_null(column, "").cast(pa.binary()).to_pylist())
        low, high = np.searchsorted(bounds, raw, side="left"), np.searchsorted(bounds, raw, side="right")
        return pa.array((low + salt.to_numpy() % (high - low + 1)).astype(np.int32))

    @F.arrow_udf("array<int>")
    def reach(column: pa.Array) -> pa.Array:
        raws = column.cast(pa.binary()).to_pylist()
        low, high = np.searchsorted(bounds, _bytes(raws), side="left"), np.searchsorted(bounds, _bytes([r + b"\xff" for r in raws]), side="right")
        return pa.array([range(a, b + 1) for a, b in zip(low.tolist(), high.tolist(), strict=True)], pa.list_(pa.int32()))

    kind = dict(rows.dtypes)["row"]
    none = F.lit(None).cast("string")
    one = rows.select(place("key", F.xxhash64("row", "url")).alias("part"), F.coalesce("key", F.lit("")).alias("key"), F.lit(1).alias("kind"), "row", "url", none.alias("pattern"), none.alias("action"))
    two = known.select(F.explode(reach("key")).alias("part"), "key", F.lit(0).alias("kind"), F.lit(None).cast(kind).alias("row"), none.alias("url"), F.col("pattern").cast("string").alias("pattern"), F.col("action").cast("string").alias("action"))
    merged = one.unionByName(two).repartitionById(partitions, "part").sortWithinPartitions("key", "kind", F.desc_nulls_last("pattern"), F.desc_nulls_first("action"))
    swept = merged.drop("part").mapInArrow(_sweep, f"row {kind}, url string, n_rules int, rule string, action string")
    return swept.select(F.col("row").alias(key), F.col("url").alias(url), *[F.col(n).alias(f"{n}_" if n in (key, url) else n) for n in ("n_rules", "rule", "action")])


def _sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows by key, a rule before the URLs it covers: each rule is pushed on the stack of active ones and holds for the rows up to
    the end of its interval, inner rules over outer ones. Only rules are handled one by one; the URLs between them as slices."""
    stack: list[tuple[bytes, str, str | None]] = []
    for batch in batches:
        keys, kind = _bytes(batch.column(0).cast(pa.binary()).to_pylist()), batch.column(1).to_numpy()
        patterns, actions = batch.column(4).to_pylist(), batch.column(5).to_pylist()
        n = len(keys)
        opened = [(0, rule) for rule in stack] + [(i + 1, (keys[i], patterns[i], actions[i])) for i in np.flatnonzero(kind == 0).tolist()]
        starts = np.array([s for s, _ in opened], np.int64)
        ends = np.searchsorted(keys, _bytes([rule[0] + b"\xff" for _, rule in opened]), side="left") if opened else starts
        change, best = np.zeros(n + 1, np.int64), np.full(n, -1)
        np.add.at(change, np.minimum(starts, ends), 1)
        np.add.at(change, ends, -1)
        for k, (s, e) in enumerate(zip(starts.tolist(), ends.tolist(), strict=True)):
            best[s:e] = k
        stack = [rule for (_, rule), e in zip(opened, ends.tolist(), strict=True) if e == n]
        at = np.flatnonzero(kind == 1)
        chosen, index = best[at], pa.array(at)
        where = pa.array(chosen, mask=chosen < 0)
        rule, action = (pa.array([r[c] for _, r in opened], pa.string()).take(where) for c in (1, 2))
        yield pa.record_batch({"row": batch.column(2).take(index), "url": batch.column(3).take(index), "n_rules": pa.array(np.cumsum(change)[at].astype(np.int32)), "rule": rule, "action": action})


STATIC_RULES = (
    ("example.net", "block"), ("blog.ththst.example.net", "allow"), ("example.org", "review"), ("com", "allow"),
    ("theres.example.com", "block"), ("ththha.example.com", "review"), ("www.therti.example.org", "allow"),
)
SECTION_RULES = (("/de/", "block"), ("/de/1", "review"), ("/fr/", "allow"), ("/es/9", "block"))


def section_rules(spark: SparkSession, urls: DataFrame, url: str = "url") -> DataFrame:
    """(pattern, action): the static rules, and the section rules for every host that occurs among the URLs."""
    host = F.rtrim(F.lower(F.regexp_extract(url, _URL, 1)), F.lit("."))
    hosts = urls.select(host.alias("host")).where("host <> ''").distinct()
    section = F.explode(F.array(*[F.struct(F.lit(p).alias("path"), F.lit(a).alias("action")) for p, a in SECTION_RULES]))
    own = hosts.select("host", section.alias("s")).select(F.concat("host", "s.path").alias("pattern"), F.col("s.action").alias("action"))
    return own.unionByName(spark.createDataFrame(list(STATIC_RULES), "pattern string, action string"))


def _values(rows: tuple) -> str:
    return ", ".join(f"('{a}', '{b}')" for a, b in rows)


ORACLE = f"""
with u as (
  select page_id, url,
         rtrim(lower(regexp_extract(url, '{_URL}', 1)), '.') as host, regexp_extract(url, '{_URL}', 2) as path
  from pages),
k as (
  select page_id, url, host,
         array_to_string(list_reverse(string_split(host, '.')), '.') || '.' || case when starts_with(path, '/') then path else '/' || path end as k
  from u),
r as (
  select distinct pattern, action,
         array_to_string(list_reverse(string_split(rtrim(lower(split_part(pattern, '/', 1)), '.'), '.')), '.') || '.' || regexp_extract(pattern, '(/.*)$', 1) as prefix
  from (
    select pattern, action from (values {_values(STATIC_RULES)}) s(pattern, action)
    union all
    select host || s.path, s.action from (select distinct host from k where host <> '') h, (values {_values(SECTION_RULES)}) s(path, action))),
m as (
  select k.page_id, k.url, r.pattern, r.action,
         row_number() over (partition by k.page_id, k.url order by length(r.prefix) desc, r.pattern, r.action) as nth,
         count(r.pattern) over (partition by k.page_id, k.url) as n
  from k left join r on k.host <> '' and starts_with(k.k, r.prefix))
select page_id, url, cast(n as integer) as n_rules, pattern as rule, action from m where nth = 1
"""
