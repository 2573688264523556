"""Small files beside the tables, through Hadoop's file system: local, HDFS or object stores alike."""

from __future__ import annotations

import json
import threading
import time
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession

from docsail.errors import conflict


def _path(spark: SparkSession, path: str):
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop, hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    hadoop, system = _path(spark, path)
    return system.exists(hadoop)


def names(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder, hidden ones left out; none where it doesn't exist."""
    hadoop, system = _path(spark, path)
    if not system.exists(hadoop):
        return []
    return sorted(n for s in system.listStatus(hadoop) if (n := s.getPath().getName())[0] not in "._")


def delete(spark: SparkSession, path: str) -> None:
    hadoop, system = _path(spark, path)
    system.delete(hadoop, True)


def read_text(spark: SparkSession, path: str) -> str | None:
    hadoop, system = _path(spark, path)
    if not system.exists(hadoop):
        return None
    stream = system.open(hadoop)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def claim(spark: SparkSession, path: str, text: str) -> bool:
    """Creates a file unless it exists; of several that try at once one succeeds, where the file system creates atomically."""
    hadoop, system = _path(spark, path)
    system.mkdirs(hadoop.getParent())
    if system.getUri().getScheme() == "file":
        try:
            with open(hadoop.toUri().getPath(), "x") as out:
                out.write(text)
        except FileExistsError:
            return False
        return True
    try:
        stream = system.create(hadoop, False)
    except Py4JJavaError:
        if system.exists(hadoop):
            return False
        raise
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()
    return True


def move(spark: SparkSession, path: str, goal: str) -> bool:
    """Renames a file; of several that try at once one succeeds."""
    (source, system), (target, _) = _path(spark, path), _path(spark, goal)
    try:
        return bool(system.rename(source, target))
    except Py4JJavaError:
        return False


class Lock:
    """A lock file. It is renewed while it is held, and taken over from a holder that hasn't renewed it for EXPIRES seconds."""

    EXPIRES = 300.0

    def __init__(self, spark: SparkSession, path: str, wait: float = 0.0):
        self.spark, self.path, self.wait = spark, path, wait
        self.owner, self.over = uuid.uuid4().hex, threading.Event()

    def _text(self) -> str:
        return json.dumps({"owner": self.owner, "at": time.time()})

    def _said(self) -> dict:
        try:
            return json.loads(read_text(self.spark, self.path) or "{}")
        except (ValueError, Py4JJavaError):
            return {"at": time.time()}  # just being written or removed

    def __enter__(self) -> Lock:
        until = time.time() + self.wait
        while not claim(self.spark, self.path, self._text()):
            if self._said().get("at", time.time()) + self.EXPIRES < time.time():
                if move(self.spark, self.path, f"{self.path}.{self.owner}"):
                    delete(self.spark, f"{self.path}.{self.owner}")
                continue
            if time.time() >= until:
                raise conflict(f"{self.path.rsplit('/', 2)[-2]} is being changed by another")
            time.sleep(0.2)
        threading.Thread(target=self._renew, daemon=True).start()
        return self

    def _renew(self) -> None:
        while not self.over.wait(self.EXPIRES / 5):
            if self._said().get("owner") == self.owner:
                write_text(self.spark, self.path, self._text())

    def __exit__(self, *_) -> None:
        self.over.set()
        if self._said().get("owner") == self.owner:
            delete(self.spark, self.path)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Writes beside the goal, then renames over it: a reader sees the old text or the new one, never a part."""
    jvm = spark.sparkContext._jvm
    goal, system = _path(spark, path)
    draft, _ = _path(spark, f"{path.rpartition('/')[0]}/.{path.rpartition('/')[2]}.{uuid.uuid4().hex}")
    stream = system.create(draft, True)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(goal.toUri(), spark.sparkContext._jsc.hadoopConfiguration()).rename(draft, goal, options)
