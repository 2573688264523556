"""Session plumbing shared by every query: sessions, tables, workers' import path, durable intermediates."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = str(Path(__file__).resolve().parent.parent)
BATCH_BYTES = 4 << 20


def local_session(cpus: int = 8, partitions: int = 8) -> SparkSession:
    """A local session with the settings that tests and the bench use."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("docsail")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", "6g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def prepare(spark: SparkSession) -> SparkSession:
    """Lets Python workers import this package from the driver's path, when they have no copy installed."""
    known = spark.sparkContext.environment.get("PYTHONPATH", "")
    if ROOT not in known.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, known) if x)
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Rows go to Python workers in Arrow batches of about BATCH_BYTES, where the session has no bound of its own (Spark's is 64 MB).

    A batch is held several times over, in the executor outside of its heap and in the worker. The bound stays in the session,
    because returned DataFrames are evaluated later.
    """
    bound = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(bound, None) is None:
        spark.conf.set(bound, str(BATCH_BYTES))


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir; where that is unset a temporary one, but in local runs only."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not at:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        at = current.get() if current.isDefined() else None
    if not at:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        at = f"file://{tempfile.mkdtemp(prefix='docsail-')}"
        spark.sparkContext.setCheckpointDir(at)
    return at.rstrip("/")


class Workspace:
    """Written intermediate tables in the shared folder: they cut lineage and outlive a lost executor.

    Tables stay until ``drop`` or ``clear``, or until the driver ends, because a returned DataFrame reads them lazily.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.base = f"{shared_dir(spark)}/docsail-{uuid.uuid4().hex}"
        atexit.register(self.clear)

    def path(self, name: str) -> str:
        return f"{self.base}/{name}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        """The table, written and read again; the shuffle files that it was made from are freed at once."""
        free, conf = "spark.sql.classic.shuffleDependency.fileCleanup.enabled", self.spark.conf
        before = conf.get(free)
        conf.set(free, "true")
        try:
            df.write.mode("overwrite").parquet(self.path(name))
        finally:
            conf.set(free, before)
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, name: str) -> None:
        self._delete(self.path(name))

    def clear(self) -> None:
        self._delete(self.base)

    def _delete(self, path: str) -> None:
        jsc = self.spark.sparkContext._jsc
        if jsc is None:
            return
        try:
            hadoop = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            hadoop.getFileSystem(jsc.hadoopConfiguration()).delete(hadoop, True)
        except Exception:  # the JVM may be gone when the driver ends; the folder is scratch either way
            return
