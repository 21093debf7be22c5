"""Write-once sinks, content digests, partitioned and multi-table outputs, label files."""
from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions import centre_box
from plumbline.operators.stash import remove


def content_digest(df: DataFrame) -> dict[str, str | int]:
    """Rows, and a hash of the table's columns and rows that does not depend on their order or files."""
    names = sorted(df.columns)
    row = F.xxhash64(*(F.struct(F.col(c).isNull(), F.to_json(F.struct(c))) for c in names)).cast("decimal(38,0)")
    other = F.xxhash64(F.lit(1), *(F.to_json(F.struct(c)) for c in names)).cast("decimal(38,0)")
    s = df.agg(F.count("*").alias("n"), F.sum(row).alias("a"), F.sum(other).alias("b")).first()
    types = dict(df.dtypes)
    text = json.dumps([[[c, types[c]] for c in names], s.n, str(s.a), str(s.b)])
    return {"rows": s.n, "digest": hashlib.sha256(text.encode()).hexdigest()}


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def _rename(spark: SparkSession, old: str, new: str) -> None:
    source, target = (spark._jvm.org.apache.hadoop.fs.Path(p) for p in (old, new))
    fs = source.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(target.getParent())
    if not fs.rename(source, target):
        raise OSError(f"{old} could not become {new}")


@contextmanager
def _staged(spark: SparkSession, path: str) -> Iterator[str]:
    """A folder beside `path` to write to, which takes its place when all is written and goes when anything fails."""
    beside = f"{path.rstrip('/')}.staged-{uuid.uuid4().hex}"
    try:
        yield beside
        _rename(spark, beside, path)
    finally:
        remove(spark, beside)


def write_once(df: DataFrame, path: str, partition_by: list[str] | None = None) -> dict[str, str | int]:
    """Writes a Parquet table that never changes: a second write of equal content does nothing, another is an error.

    The digest is of content, so file layout and row order do not count. The table is written beside its
    place and moved there whole, so a write that fails leaves nothing in the way of the next.
    """
    spark, told = df.sparkSession, content_digest(df)
    if _exists(spark, path):
        if content_digest(spark.read.parquet(path).select(*df.columns))["digest"] != told["digest"]:
            raise FileExistsError(f"{path} holds other content")
        return told
    with _staged(spark, path) as beside:
        writer = df.write.option("compression", "zstd")
        (writer.partitionBy(*partition_by) if partition_by else writer).parquet(beside)
    return told


def write_many(df: DataFrame, path: str, outputs: dict[str, Column]) -> dict[str, dict]:
    """Rows to a table per condition, all under `path`, in one pass; what stands there is complete, with its `_receipt`.

    A row may go to several outputs or none; outputs without rows are empty tables. Everything is written
    beside its place and moved there whole.
    """
    spark = df.sparkSession
    if _exists(spark, path):
        raise FileExistsError(f"{path} is finished")
    told = F.filter(F.array(*(F.when(c, F.lit(n)) for n, c in outputs.items())), lambda x: x.isNotNull())
    receipts = {}
    with _staged(spark, path) as beside:
        df.withColumn("_output", F.explode(told)).write.option("compression", "zstd").partitionBy("_output").parquet(f"{beside}/_rows")
        for name in outputs:
            mine = f"{beside}/{name}"
            if _exists(spark, f"{beside}/_rows/_output={name}"):
                _rename(spark, f"{beside}/_rows/_output={name}", mine)
            else:
                df.limit(0).write.parquet(mine)
            receipts[name] = content_digest(spark.read.schema(df.schema).parquet(mine))
        remove(spark, f"{beside}/_rows")
        spark.createDataFrame([(json.dumps(receipts, sort_keys=True),)], "value string").coalesce(1).write.text(f"{beside}/_receipt")
    return receipts


def write_csv(df: DataFrame, path: str, order: list[str], files: int = 1) -> None:
    """CSV files with a header, rows in order over `files` ranges, nulls as empty cells; the same rows give the same bytes."""
    spark = df.sparkSession
    if _exists(spark, path):
        raise FileExistsError(f"{path} is finished")
    with _staged(spark, path) as beside:
        df.repartitionByRange(files, *order).sortWithinPartitions(*order).write.option("timestampNTZFormat", "yyyy-MM-dd HH:mm:ss.SSSSSS").csv(beside, header=True, nullValue="", emptyValue="")


def write_label_files(records: DataFrame, path: str, classes: list[str]) -> None:
    """Label files of records (see `label_lines`), a folder record_id=<id> each."""
    label_lines(records, classes).where("content <> ''").write.partitionBy("record_id").text(path)


def write_sensor_blocks(df: DataFrame, path: str) -> None:
    """Sensor rows in a folder per sensor and block; repeated seconds of a sensor are refused, and so is an existing folder."""
    if df.groupBy("sensor", "epoch").count().where("count > 1").limit(1).collect():
        raise ValueError("a sensor has two rows at one second")
    df.repartition("sensor", "block_epoch").sortWithinPartitions("sensor", "block_epoch", "epoch").write.mode("error").partitionBy("sensor", "block_epoch").parquet(path)


def label_lines(records: DataFrame, classes: list[str]) -> DataFrame:
    """(record_id, content): label files of normalised boxes, ten decimals, lines in the order of the boxes."""
    place = F.create_map(*(x for i, c in enumerate(classes) for x in (F.lit(c), F.lit(i))))
    known = F.filter("boxes", lambda b: F.array_contains(F.array(*map(F.lit, classes)), b["source_label"]))
    line = lambda b: F.format_string("%d %.10f %.10f %.10f %.10f", place[b["source_label"]], *centre_box(b["x1"], b["y1"], b["x2"], b["y2"], F.col("width"), F.col("height")))
    return records.select("record_id", F.array_join(F.transform(known, line), "\n").alias("content"))


def seal(spark: SparkSession, tables: dict[str, DataFrame], path: str) -> dict[str, dict]:
    """Binds tables by their digests in a write-once record."""
    told = {n: content_digest(t) for n, t in tables.items()}
    write_once(spark.createDataFrame([(n, d["rows"], d["digest"]) for n, d in sorted(told.items())], "name string, rows long, digest string"), path)
    return told


def drift(spark: SparkSession, tables: dict[str, DataFrame], path: str) -> list[str]:
    """Names of sealed tables whose content is not what was sealed, or that are not given."""
    sealed = {r.name: r.digest for r in spark.read.parquet(path).collect()}
    return sorted(n for n, d in sealed.items() if n not in tables or content_digest(tables[n])["digest"] != d)


def release(spark: SparkSession, df: DataFrame, name: str, seal_path: str) -> DataFrame:
    """`df` for reading only if it is the table that was sealed under `name`."""
    if name in drift(spark, {name: df}, seal_path):
        raise PermissionError(f"{name} is not the sealed table")
    return df
