"""Working tables in the folder that the driver and all executors share."""

from __future__ import annotations

import os
import tempfile
import threading
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_local_dirs: dict[str, str] = {}
_sent: set[str] = set()
_open = threading.local()


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    Only where that setting is absent in a local run (as in tests) a temporary folder is
    made and registered as the checkpoint folder; on a cluster that is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _local_dirs:
        _local_dirs[app] = tempfile.mkdtemp(prefix="spark-foliomill-")
        spark.sparkContext.setCheckpointDir(_local_dirs[app])
    return _local_dirs[app]


def materialize(df: DataFrame, label: str = "table") -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and return a reader over the files.

    This cuts lineage, so a lost executor costs a re-read and not a recomputation, and
    it fixes the rows that later steps see. Files live under a folder named after the
    application and can be deleted once it has ended, or when a ``working_files`` around ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"
    for written in getattr(_open, "scopes", [])[-1:]:
        written.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def working_files(spark: SparkSession) -> Iterator[None]:
    """Delete at the end what ``materialize`` has written within; frames that read it can't be used any more."""
    _open.scopes = [*getattr(_open, "scopes", []), []]
    try:
        yield
    finally:
        for path in _open.scopes.pop():
            delete_folder(spark, path)


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """Settings of the session that hold within and are as before behind."""
    before = {name: spark.conf.get(name, None) for name in values}
    for name, value in values.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def delete_working_files(spark: SparkSession) -> None:
    """Delete what ``materialize`` wrote for this application; frames that read it can't be used any more."""
    files, folder = _file_system(spark, f"{shared_dir(spark)}/{spark.sparkContext.applicationId}")
    files.delete(folder, True)


def _file_system(spark: SparkSession, path: str):
    """(file system, path) of the storage that a path names, as Spark reaches it."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()), folder


def path_exists(spark: SparkSession, path: str) -> bool:
    files, folder = _file_system(spark, path)
    return files.exists(folder)


def delete_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder with all that it holds; nothing happens where there is none."""
    files, folder = _file_system(spark, path)
    files.delete(folder, True)


def bytes_in(spark: SparkSession, path: str) -> int:
    files, folder = _file_system(spark, path)
    return files.getContentSummary(folder).getLength()


def names_in(spark: SparkSession, path: str) -> list[str]:
    """Names of what a folder holds; none for a folder that isn't there."""
    files, folder = _file_system(spark, path)
    return [s.getPath().getName() for s in files.listStatus(folder)] if files.exists(folder) else []


def spread(table: DataFrame) -> DataFrame:
    """``table`` dealt to as many partitions as there are cores, if its files give fewer than that.

    A file with one row group is one task however large it is; tables of many files or row
    groups are left as they are.
    """
    cores = table.sparkSession.sparkContext.defaultParallelism
    return table.repartition(cores) if table.rdd.getNumPartitions() < cores else table


def ensure_code(spark: SparkSession) -> None:
    """Let the executors' Python import this package.

    Nothing is done where PYTHONPATH already holds it; else the package is sent once per
    application, as ``spark-submit --py-files`` would.
    """
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    app = spark.sparkContext.applicationId
    if root in os.environ.get("PYTHONPATH", "").split(os.pathsep) or app in _sent:
        return
    archive = os.path.join(tempfile.mkdtemp(prefix="spark-foliomill-code-"), "foliomill.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for folder, _, names in os.walk(os.path.join(root, "foliomill")):
            for name in names:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    z.write(path, os.path.relpath(path, root))
    spark.sparkContext.addPyFile(archive)
    _sent.add(app)
