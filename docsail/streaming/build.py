"""Continuous building: Structured Streaming merges the log into versioned snapshots."""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from docsail.operators.merge import SCHEMA, buried, merge, typed, with_tokens
from docsail.schema import Mapping
from docsail.sources.files import Lock, delete, names, read_text, write_text


def manifest(spark: SparkSession, folder: str) -> dict:
    """What the collection's last commit says: snapshot, mapping, live rows, log files merged; empty before the first."""
    said = read_text(spark, f"{folder}/manifest.json")
    return json.loads(said) if said else {}


def latest(spark: SparkSession, folder: str) -> DataFrame | None:
    """The stored rows of the collection's last committed snapshot."""
    at = manifest(spark, folder).get("snapshot")
    return spark.read.schema(SCHEMA).parquet(_place(folder, at)) if at else None


def _place(folder: str, snapshot: str) -> str:
    return snapshot if "/" in snapshot else f"{folder}/{snapshot}"


def commit(
    spark: SparkSession, folder: str, rows: DataFrame, mapping: Mapping | None = None, merged: list[str] | None = None,
    filters: dict[str, tuple[dict, int]] | None = None, batch: tuple[str, int] | None = None,
) -> dict:
    """Writes a snapshot, with typed columns and tokens if a mapping is given, then points the manifest at it.

    ``filters``: deletes by filter, by name, which become tombstones here. The manifest says which log files, filters and stream
    batches it holds. The snapshot just replaced stays for its readers, and pinned ones for the clones that share them; older
    ones go. Every snapshot has a folder of its own, whatever run made it.
    """
    said = manifest(spark, folder)
    version = f"v{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"
    if mapping:
        rows = with_tokens(typed(rows, mapping), mapping)
        if filters:
            rows = buried(rows, mapping, list(filters.values()))
    rows.write.mode("overwrite").parquet(f"{folder}/{version}")
    live = spark.read.schema(SCHEMA).parquet(f"{folder}/{version}").where("not _deleted").count()
    streams = said.get("streams", {}) | ({batch[0]: batch[1]} if batch else {})
    new = {"snapshot": version, "mapping": mapping.to_json() if mapping else None, "rows": live, "merged": merged or [], "filters": sorted(filters or {}), "streams": streams}
    write_text(spark, f"{folder}/manifest.json", json.dumps(new))
    kept = {version, said.get("snapshot"), *json.loads(read_text(spark, f"{folder}/pinned.json") or "[]")}
    for name in names(spark, folder):
        if name.startswith("v") and name not in kept:
            delete(spark, f"{folder}/{name}")
    return said


def start(
    spark: SparkSession, wal: str, folder: str, checkpoint: str, files_per_batch: int = 1000, trigger: dict | None = None,
    mapping: Mapping | None = None, filters: Callable[[], dict[str, tuple[dict, int]]] | None = None, cleared: Callable[[dict], None] | None = None,
) -> StreamingQuery:
    """The running query. The manifest knows a batch by the query's id, which lives in the checkpoint, and its number: a batch
    that is run again after a failure is left out, and a new checkpoint starts anew, merging again what it finds, which changes
    nothing. ``cleared`` gets what the manifest said before each commit, to remove the log files it had merged."""

    def apply(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        name = json.loads(read_text(session, f"{checkpoint}/metadata"))["id"]
        with Lock(session, f"{folder}/lock.json", wait=Lock.EXPIRES * 4):
            if manifest(session, folder).get("streams", {}).get(name, -1) >= number:
                return
            batch.persist()
            files = [r[0] for r in batch.select("_file").distinct().collect()]  # at most files_per_batch
            before = commit(session, folder, merge(latest(session, folder), batch), mapping, files, filters() if filters else None, (name, number))
            batch.unpersist()
            if cleared:
                cleared(before)

    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files_per_batch).parquet(wal).select("*", F.col("_metadata.file_name").alias("_file"))
    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": "1 minute"})).start()


def build_available(spark: SparkSession, wal: str, folder: str, checkpoint: str, files_per_batch: int = 1000) -> DataFrame:
    """Merges all that is in the log by now, batch by batch, and returns the collection's stored rows."""
    start(spark, wal, folder, checkpoint, files_per_batch, {"availableNow": True}).awaitTermination()
    found = latest(spark, folder)
    return spark.createDataFrame([], SCHEMA) if found is None else found
