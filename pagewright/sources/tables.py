"""Tables that a plan writes once and reads several times, and small files beside them."""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession, name: str) -> str:
    """A folder below the one that ``spark.checkpoint.dir`` names.

    A local session that names none gets a temporary folder, which goes when Python ends; a cluster
    without the setting is refused, as its executors share no local disk.
    """
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    at = os.path.join(root or os.path.join(tempfile.gettempdir(), "pagewright"), name)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        atexit.register(shutil.rmtree, at, ignore_errors=True)
    return at


#: Bytes of rows that go to a Python worker at once.
BATCH_BYTES = 1 << 22
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def small_batches(df: DataFrame) -> DataFrame:
    """``df``, in whose session an Arrow batch now holds BATCH_BYTES at most; a smaller limit stays.

    A worker holds several times a batch. The limit that Spark comes with, 64 MB, is met by the large tasks of a large table only.
    """
    conf = df.sparkSession.conf
    n, unit = re.match("([0-9]+) *([kmg]?)", conf.get(_BATCH).lower()).groups()
    if int(n) << {"": 0, "k": 10, "m": 20, "g": 30}[unit] > BATCH_BYTES:
        conf.set(_BATCH, str(BATCH_BYTES))
    return df


#: Bytes of files that a task reads within ``small_tasks``, and that a file counts besides its own.
TASK_BYTES, FILE_COST = 6 << 20, 1 << 18
_TASK, _COST = "spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"
_lock, _within = threading.Lock(), {}


def _bytes(size: str) -> int:
    n, unit = re.match("([0-9]+) *([kmgt]?)", size.lower()).groups()
    return int(n) << {"": 0, "k": 10, "m": 20, "g": 30, "t": 40}[unit]


@contextmanager
def small_tasks(spark: SparkSession) -> Iterator[None]:
    """What is run within reads at most TASK_BYTES of files a task, or what the session says if that is less; for steps that hold many times what they read.

    The session's limits are as before when the last of several threads has left.
    """
    key = id(spark._jsparkSession)
    with _lock:
        n, before = _within.get(key, (0, None))
        if not n:
            before = {c: spark.conf.get(c) for c in (_TASK, _COST)}
            for c, most in ((_TASK, TASK_BYTES), (_COST, FILE_COST)):
                if _bytes(before[c]) > most:
                    spark.conf.set(c, str(most))
        _within[key] = n + 1, before
    try:
        yield
    finally:
        with _lock:
            n, before = _within.pop(key)
            if n > 1:
                _within[key] = n - 1, before
            else:
                for c, was in before.items():
                    spark.conf.set(c, was)


def kept(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet in a ``shared_folder`` of its own, and read again."""
    at = shared_folder(df.sparkSession, uuid.uuid4().hex)
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def added(df: DataFrame, to: DataFrame) -> DataFrame:
    """The ``kept`` table ``to`` with the rows of ``df`` too."""
    at = to.inputFiles()[0].rsplit("/", 1)[0]
    df.select(*to.columns).write.mode("append").parquet(at)
    return df.sparkSession.read.schema(to.schema).parquet(at)


class Files:
    """Small files and folders at any path that Spark can write to."""

    def __init__(self, spark: SparkSession, at: str):
        self.path = spark._jvm.org.apache.hadoop.fs.Path
        self.at = at
        self.fs = self.path(at).getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())

    def names(self, folder: str) -> list[str]:
        """Names of what is in a folder, in order; none where it is missing."""
        try:
            return sorted(s.getPath().getName() for s in self.fs.listStatus(self.path(f"{self.at}/{folder}")))
        except Py4JJavaError as e:
            if "FileNotFoundException" in e.java_exception.getClass().getName():
                return []
            raise

    def create(self, name: str, text: str) -> bool:
        """Write a file that must not be there yet; false if it is. Of several writers one succeeds."""
        try:
            out = self.fs.create(self.path(f"{self.at}/{name}"), False)
        except Py4JJavaError:
            if self.fs.exists(self.path(f"{self.at}/{name}")):
                return False
            raise
        out.write(bytearray(text.encode()))
        out.close()
        return True

    def read(self, name: str, most: int = 4096) -> str:
        """The first ``most`` bytes of a file."""
        source = self.fs.open(self.path(f"{self.at}/{name}"))
        data = source.readNBytes(most)
        source.close()
        return bytes(data).decode()

    def delete(self, name: str) -> None:
        self.fs.delete(self.path(f"{self.at}/{name}"), True)


def stamp(spark: SparkSession, path: str) -> str:
    """When what is at ``path`` was changed, and how long it is: another text after each change."""
    files = Files(spark, path)
    status, summary = files.fs.getFileStatus(files.path(path)), files.fs.getContentSummary(files.path(path))
    return f"{path} {status.getModificationTime()} {summary.getLength()} {summary.getFileCount()}"
