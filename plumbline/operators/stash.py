"""Cutting lineage with tables written to the folder that driver and executors share, and clearing them away."""
from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

#: What was written within each `scratch` that this thread or task has open, innermost last.
_SCOPES: ContextVar[tuple[list[str], ...]] = ContextVar("scopes", default=())


def shared_folder(spark: SparkSession) -> str:
    """The cluster's spark.checkpoint.dir. Only a local session without one gets a temporary folder (tests)."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="spark-plumbline-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses; the open `scratch` removes it."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    if scopes := _SCOPES.get():
        scopes[-1].append(path)
    return path


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a path on whatever file system it is."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[list[str]]:
    """Removes on exit what operators wrote to the shared folder meanwhile.

    Results are lazy and read those tables, so a result is written or collected inside. `keep` saves one
    of them for the scope around this one.
    """
    mine: list[str] = []
    before = _SCOPES.get()
    _SCOPES.set((*before, mine))
    try:
        yield mine
    finally:
        _SCOPES.set(before)
        for path in mine:
            remove(spark, path)


def keep(df: DataFrame) -> DataFrame:
    """Hands a stashed table over to the scope around the innermost one."""
    path, scopes = getattr(df, "stashed_at", None), _SCOPES.get()
    if scopes and path in scopes[-1]:
        scopes[-1].remove(path)
        if len(scopes) > 1:
            scopes[-2].append(path)
    return df


def discard(df: DataFrame) -> None:
    """Removes a stashed table that nothing reads any more; other DataFrames are left alone."""
    if path := getattr(df, "stashed_at", None):
        remove(df.sparkSession, path)


def stash(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Write `df` as a table in the shared folder and read it back.

    The written table survives the loss of executors, gives later stages a short lineage and fixes
    values (partition ids, for one) that a recomputation could change. Only committed task attempts
    are part of it.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", codec).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stashed_at = path
    return out


def stash_bucketed(df: DataFrame, name: str, column: str, buckets: int, codec: str = "zstd") -> DataFrame:
    """As `stash`, bucketed by a column, so that joins by it need no shuffle.

    Only the catalog can say that a table is bucketed; its entry goes as soon as the table is resolved,
    its files stay as long as those of `stash`.
    """
    spark = df.sparkSession
    path, entry = new_path(spark, name), f"{name}_{uuid.uuid4().hex}".replace("-", "_")
    df.write.format("parquet").option("compression", codec).option("path", path).bucketBy(buckets, column).saveAsTable(entry)
    out = spark.table(entry)
    spark.sql(f"DROP TABLE {entry}")
    out.stashed_at = path
    return out
