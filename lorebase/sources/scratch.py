"""Shared folder for intermediate tables, and versioned Parquet snapshots."""

import re
import tempfile
import threading
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


_WRITTEN: list[str] = []
_LOCAL: dict[str, str] = {}  # fallback folder per local-mode application
_OPEN = threading.local()  # lists of paths, one for each ``passing`` that the thread is in


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``.

    Only a local-mode session may fall back to a folder of its own: on a cluster
    executors cannot see each other's disks.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.conf.get("spark.master", "").startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.conf.get("spark.app.id", "app")
    if app not in _LOCAL:
        _LOCAL[app] = tempfile.mkdtemp(prefix="lorebase-")
    return _LOCAL[app]


def scratch_path(spark: SparkSession, label: str) -> str:
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    _WRITTEN.append(path)
    for own in getattr(_OPEN, "lists", []):
        own.append(path)
    return path


def _delete(spark: SparkSession, paths) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path
    conf = spark._jsparkSession.sessionState().newHadoopConf()
    for p in paths:
        path(p).getFileSystem(conf).delete(path(p), True)


@contextmanager
def passing(spark: SparkSession, *stay: str):
    """Scratch tables that this thread writes inside are deleted at the end, but for those of the labels ``stay``.

    What goes on to be read after it must be written under such a label.
    """
    if not hasattr(_OPEN, "lists"):
        _OPEN.lists = []
    own: list[str] = []
    _OPEN.lists.append(own)
    try:
        yield
    finally:
        _OPEN.lists.remove(own)
    gone = [p for p in own if p in _WRITTEN and p.rsplit("/", 1)[1][:-33] not in stay]
    _delete(spark, gone)
    for p in gone:
        _WRITTEN.remove(p)


def kept(df: DataFrame, label: str = "kept") -> DataFrame:
    """Write ``df`` to the shared folder and read it back: a cut in the lineage
    that survives the loss of executors, for results that are used many times.

    Its size is known to the planner, so that a small result is broadcast where an
    estimate through joins and aggregates would shuffle the large side.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> int:
    """Delete the scratch folders of this process; frames that read them end here."""
    _delete(spark, _WRITTEN)
    n = len(_WRITTEN)
    _WRITTEN.clear()
    return n


class Snapshots:
    """Versions of one dataset under ``root``: ``v=1``, ``v=2``, ...

    A version counts once it is marked ready, after it was written and checked.
    Readers take the newest ready one, so a plan that still reads version n is
    not disturbed by the writing of n + 1.  One writer per dataset.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(root).getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())

    def exists(self, path: str) -> bool:
        return self._fs.exists(self._path(path))

    def matching(self, pattern: str) -> list[str]:
        return [s.getPath().toString() for s in self._fs.globStatus(self._path(pattern)) or []]

    def versions(self) -> list[int]:
        ready = self.matching(f"{self.root}/v=*/_READY")
        return sorted(int(re.search(r"/v=(\d+)/", p).group(1)) for p in ready)

    def latest(self) -> int | None:
        found = self.versions()
        return found[-1] if found else None

    def read(self, version: int | None = None) -> DataFrame:
        version = self.latest() if version is None else version
        if version is None:
            raise FileNotFoundError(f"no ready version under {self.root}")
        return self.spark.read.parquet(f"{self.root}/v={version}")

    def write(self, df: DataFrame, partition_by=(), check=None) -> int:
        """Write the next version; ``check`` gets the written rows and may raise."""
        version = (self.latest() or 0) + 1
        folder = f"{self.root}/v={version}"
        # An unfinished attempt at this version may be there: overwrite replaces it.
        df.write.mode("overwrite").partitionBy(*partition_by).parquet(folder)
        if check is not None:
            check(self.spark.read.schema(df.schema).parquet(folder))
        self._fs.create(self._path(f"{folder}/_READY"), True).close()
        return version
