"""The folder that driver and executors share, and tables kept in it."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir; where it is unset, a new local one, on a local master only."""
    sc = spark.sparkContext
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        where = sc.getCheckpointDir()
        where = where.rpartition("/")[0] if where else None
    if not where:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="gridlode-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(where)
    return where


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other run uses. What is written there stays until the folder is emptied."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def checkpoint(df: DataFrame) -> DataFrame:
    """df, written to the shared folder, without its lineage.

    The files stay until the folder is emptied, or go with the last use of df where
    spark.cleaner.referenceTracking.cleanCheckpoints is on.
    """
    shared_dir(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """df, written to the shared folder as a table and read again.

    For loops: a checkpoint keeps the size that Spark estimated for its plan, and joins multiply these estimates,
    so that they grow without bound from round to round; a table has the size of its files.
    """
    spark = df.sparkSession
    path = fresh_path(spark, "table")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: A table is broadcast only when it was counted and has at most so many rows.
SMALL_ROWS = 100_000


def small(rows: DataFrame, most: int = SMALL_ROWS) -> DataFrame:
    """rows, marked for broadcast if they are counted to be few; else as they are."""
    return F.broadcast(rows) if rows.limit(most + 1).count() <= most else rows


def _store(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is a file or folder at path, in any store that Spark reads."""
    store, at = _store(spark, path)
    return store.exists(at)


def remove(spark: SparkSession, path: str) -> None:
    store, at = _store(spark, path)
    store.delete(at, True)


def list_names(spark: SparkSession, path: str) -> list[str]:
    """The names in a folder, none if there is no folder."""
    store, at = _store(spark, path)
    return [f.getPath().getName() for f in store.listStatus(at)] if store.exists(at) else []


def read_bytes(spark: SparkSession, path: str) -> bytes:
    """A small file."""
    store, at = _store(spark, path)
    stream = store.open(at)
    try:
        return bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
    finally:
        stream.close()


def write_once(spark: SparkSession, path: str, data: bytes) -> bool:
    """Writes a small file whole or not at all; False if there is a file at path.

    It is written beside its place and moved there by a rename that doesn't replace, which is one step in HDFS and its like.
    Local folders lack such a step: there the name is taken by a folder first, which only one can make.
    """
    store, at = _store(spark, path)
    beside = at.getParent().suffix(f"/.{uuid.uuid4().hex}")
    stream = store.create(beside, True)
    stream.write(data)
    stream.close()
    context = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(at.toUri(), spark._jsc.hadoopConfiguration())
    none = spark.sparkContext._gateway.new_array(spark._jvm.org.apache.hadoop.fs.Options.Rename, 0)
    mine = True
    if store.getScheme() == "file":
        try:
            os.mkdir(at.toUri().getPath() + ".taken")
        except FileExistsError:
            mine = False
    try:
        if mine:
            context.rename(beside, at, none)
        return mine
    except Exception as e:
        if "FileAlreadyExistsException" not in str(e):
            raise
        return False
    finally:
        store.delete(beside, False)


def move_part(spark: SparkSession, folder: str, path: str) -> None:
    """Makes the one part that a folder of a written table holds the file at path; there must be none yet."""
    store, at = _store(spark, folder)
    parts = [f.getPath() for f in store.listStatus(at) if not f.getPath().getName().startswith(("_", "."))]
    if len(parts) != 1 or not store.rename(parts[0], _store(spark, path)[1]):
        raise OSError(f"{folder} can't become {path}")
    store.delete(at, True)


def head_bytes(spark: SparkSession, path: str, most: int = 65536) -> bytes:
    """The first bytes of a file, or of a folder's largest one, of several the first by name: a part of a table may hold no more than headers."""
    store, at = _store(spark, path)
    if store.getFileStatus(at).isDirectory():
        found = [(-f.getLen(), f.getPath().getName(), f.getPath()) for f in store.listStatus(at) if f.isFile()]
        found = [f for f in found if not f[1].startswith(("_", "."))]
        if not found:
            return b""
        at = min(found, key=lambda f: f[:2])[2]
    stream = store.open(at)
    try:
        bounded = spark._jvm.org.apache.commons.io.input.BoundedInputStream(stream, most)
        return bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(bounded))
    finally:
        stream.close()


def parts(df: DataFrame) -> int:
    """The set number of shuffle partitions, for repartition before work in Python: without a number Spark joins small partitions by their bytes, and few tasks are left for much work."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
