"""Intermediate tables in the shared folder that the cluster names."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_local_root: str | None = None


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path below ``spark.checkpoint.dir``.

    Only a local session without that setting gets a temporary folder; on a
    cluster such a folder would exist on one machine only.
    """
    global _local_root
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        _local_root = _local_root or tempfile.mkdtemp(prefix="chatsieve-")
        root = _local_root
    return f"{root.rstrip('/')}/chatsieve/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, path: str) -> DataFrame:
    """Write ``df`` as parquet to ``path`` and read it back.

    This cuts the lineage and survives the loss of executors, and every reader
    takes only the columns it needs.
    """
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def qualified(spark: SparkSession, path: str) -> str:
    """A path with its file system, as Spark names input files."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    return folder.getFileSystem(conf).makeQualified(folder).toUri().getPath()


def discard(spark: SparkSession, path: str) -> None:
    """Delete a written table through the file system that holds it."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    folder.getFileSystem(conf).delete(folder, True)


def replaced(spark: SparkSession, path: str, write: Callable[[str], None]) -> None:
    """Replace the folder at ``path`` by what ``write`` puts into a new folder beside it.

    Whatever fails before the new folder is whole leaves the old one as it is. The old folder is set
    aside, the new one takes its name, and only then is the old one deleted. A run that ends between
    the two renames leaves both beside ``path``, as ``._old-...`` and ``._new-...``.
    """
    mark = uuid.uuid4().hex
    folder = spark._jvm.org.apache.hadoop.fs.Path(path.rstrip("/"))
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    system = folder.getFileSystem(conf)

    def beside(kind: str):
        name = f"._{kind}-{mark}-{folder.getName()}"
        parent = system.makeQualified(folder).getParent()
        return spark._jvm.org.apache.hadoop.fs.Path(parent, name)

    new, old = beside("new"), beside("old")
    try:
        write(new.toString())
    except BaseException:
        system.delete(new, True)
        raise
    aside = system.exists(folder)
    if aside and not system.rename(folder, old):
        raise OSError(f"{path} could not be set aside")
    if not system.rename(new, folder):
        if aside:
            system.rename(old, folder)
        raise OSError(f"{path} could not be put in place")
    if aside:
        system.delete(old, True)
