"""Where intermediate tables go."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

_KEY = "spark.checkpoint.dir"


def shared_folder(spark: SparkSession) -> str:
    """The shared folder the cluster names; a fresh local one only if the session names none
    and runs in local mode (tests)."""
    folder = spark.conf.get(_KEY, None) or spark.sparkContext.getConf().get(_KEY)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(f"set {_KEY} to a folder all executors share")
    if not _local:
        _local.append(tempfile.mkdtemp(prefix="tidemark-"))
    return _local[0]


_made: list[str] = []
_local: list[str] = []


def clean(spark: SparkSession) -> None:
    """Remove the intermediate folders of this application and the databases its queries made. Call
    it when no result that reads them is needed any more."""
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for name in [d.name for d in spark.catalog.listDatabases() if d.name.startswith("tidemark_")]:
        spark.sql(f"DROP DATABASE IF EXISTS `{name}` CASCADE")
    while _made:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_made.pop())
        path.getFileSystem(conf).delete(path, True)


def drop(spark: SparkSession, *paths: str) -> None:
    """Remove intermediate folders that nothing reads any more."""
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for name in paths:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(conf).delete(path, True)
        if name in _made:
            _made.remove(name)


def new_path(spark: SparkSession, label: str) -> str:
    """A path below the shared folder that no other run uses."""
    _made.append(f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}")
    return _made[-1]
