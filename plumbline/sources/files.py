"""Sensor files, string-typed manifests, bounded inventories, record-id rules, and a registry of readers."""
from __future__ import annotations

import re
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.functions import block_start, file_number
from plumbline.operators.ranges import located
from plumbline.sources import annotations


def read_manifest_csv(spark: SparkSession, path: str, columns: Sequence[str], numbers: Sequence[str] = ()) -> DataFrame:
    """A CSV with a header, every cell as text (empty stays empty); `numbers` are then cast, and a cell that is none is an error."""
    schema = ", ".join(f"`{c}` string" for c in columns)
    raw = spark.read.csv(path, header=True, schema=schema, enforceSchema=False, nullValue="\u0000", emptyValue="")
    return raw.withColumns({c: F.col(c).cast("long") for c in numbers}).fillna("", [c for c in columns if c not in numbers])


def utc_time(local: Column, zone: str) -> Column:
    """A local time as an instant. Times that a change of clocks skips or repeats are null: they name no instant."""
    t = local.cast("timestamp")
    instant = F.to_utc_timestamp(t, zone)
    twin = lambda h: F.from_utc_timestamp(instant + F.expr(f"interval {h} hour"), zone) == t
    return F.when((F.from_utc_timestamp(instant, zone) == t) & ~twin(1) & ~twin(-1), instant)


def _blocks(df: DataFrame, seconds: int) -> DataFrame:
    return df.withColumn("epoch", F.unix_timestamp("ts")).withColumn("block_epoch", block_start(F.col("epoch"), seconds))


def read_sensors_long(spark: SparkSession, path: str, time: str, sensor: str, value: str, zone: str, block: int = 86400) -> DataFrame:
    """CSV files of (time, sensor, value): ts in UTC, sensor, value, source_csv, epoch, block_epoch."""
    raw = spark.read.csv(path, header=True)
    out = raw.select(utc_time(F.to_timestamp_ntz(F.col(time)), zone).alias("ts"), F.col(sensor).alias("sensor"), F.col(value).try_cast("double").alias("value"), F.regexp_extract(F.col("_metadata.file_path"), "[^/]+$", 0).alias("source_csv"))
    return _blocks(out, block)


def read_sensors_wide(spark: SparkSession, path: str, sensors: Sequence[str], zone: str, block: int = 86400, drop_missing: bool = True) -> DataFrame:
    """CSV files with year, month, day, hour, minute, second and a column per sensor, as long rows.

    Missing cells are dropped, or stay as null with drop_missing=False.
    """
    raw = spark.read.csv(path, header=True)
    parts = [F.col(c).cast("int") for c in ("year", "month", "day", "hour", "minute")]
    local = F.make_timestamp_ntz(*parts, F.col("second").cast("decimal(8,6)"))
    wide = raw.select(utc_time(local, zone).alias("ts"), F.regexp_extract(F.col("_metadata.file_path"), "[^/]+$", 0).alias("source_csv"), *(F.col(s).try_cast("double").alias(s) for s in sensors))
    long = wide.unpivot(["ts", "source_csv"], list(sensors), "sensor", "value")
    return _blocks(long.where("value is not null") if drop_missing else long, block)


def inventory(spark: SparkSession, path: str, most: int, pattern: str = "*") -> tuple[DataFrame, bool]:
    """The first `most` files under a folder by path, with length and SHA-256, and whether there are more."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    listed = files.select("path", "length").orderBy("path").limit(most + 1)
    truncated = listed.count() > most
    chosen = listed.limit(most) if not truncated else listed.orderBy("path").limit(most)
    return files.join(chosen.select("path"), "path", "left_semi").select("path", "length", F.sha2("content", 256).alias("sha256")), truncated


def record_id(rule: dict, path: Column, ranges: DataFrame | None = None) -> Column:
    """A record id by rule: {'constant': x}, {'regex': p, 'template': t with $1, $2}, or {'null': True}.

    Exactly one form. The fourth form, {'lookup': p}, needs a join: `looked_up_ids`.
    """
    forms = [k for k in ("constant", "regex", "null") if k in rule]
    if len(forms) != 1:
        raise ValueError("a record-id rule has exactly one form")
    if forms == ["constant"]:
        return F.lit(rule["constant"])
    if forms == ["null"]:
        return F.lit(None).cast("string")
    return F.when(path.rlike(rule["regex"]), F.regexp_replace(F.regexp_extract(path, rule["regex"], 0), rule["regex"], rule["template"]))


def looked_up_ids(df: DataFrame, path: str, pattern: str, ranges: DataFrame, name: str, record: str = "record") -> DataFrame:
    """`df` with column `name`: the value of the one range of file numbers (`value`, `start`, `end`) that holds the path's number.

    `pattern` fits whole paths and has a named group `record` with the file's number (see
    `functions.file_number`). `<name>_status` is ok, no_match (of the pattern), no_number, no_range or
    several_ranges; in all cases but ok the id is null.
    """
    compiled = re.compile(pattern)
    whole = "^(?:" + re.sub(r"\(\?P<", "(?<", pattern) + ")$"
    fits = F.coalesce(F.col(path).rlike(whole), F.lit(False))
    stem = F.when(fits, F.regexp_extract(path, whole, compiled.groupindex[record]))
    keyed = df.withColumn(f"{name}_number", file_number(stem)).withColumn(f"{name}_fits", fits)
    found = located(keyed, F.col(f"{name}_number"), ranges.select(F.col("value").alias(name), "start", "end"), file_number(F.col("start")), file_number(F.col("end")), name)
    status = F.when(~F.col(f"{name}_fits"), "no_match").when(F.col(f"{name}_number").isNull(), "no_number").when(F.col("matches") == 0, "no_range").when(F.col("matches") > 1, "several_ranges").otherwise("ok")
    return found.withColumn(f"{name}_status", status).select(*df.columns, name, f"{name}_status")


def schema_rows(spark: SparkSession, paths: dict[str, str], fmt: str = "parquet") -> DataFrame:
    """(name, column, place, type) of tables, from their files' footers or headers; no row is read."""
    rows = [(name, f.name, k + 1, f.dataType.simpleString()) for name, path in paths.items() for k, f in enumerate(spark.read.format(fmt).option("header", True).load(path).schema)]
    return spark.createDataFrame(rows, "name string, column string, place int, type string")


def unordered_rows(df: DataFrame, unit: Sequence[str], position: str, order: Sequence[str]) -> DataFrame:
    """Per unit that has any: how many rows, in their `order`, do not lie after the one before."""
    before = F.lag(position).over(Window.partitionBy(*unit).orderBy(*order))
    return df.select(*unit, (F.col(position) <= before).alias("_b")).groupBy(*unit).agg(F.count_if("_b").alias("backwards")).where("backwards > 0")


READERS: dict[str, Callable[..., DataFrame]] = {
    "coco": annotations.read_coco, "yolo": annotations.read_yolo, "voc": annotations.read_voc, "sensors_long": read_sensors_long, "sensors_wide": read_sensors_wide,
}


def materialize(spark: SparkSession, kind: str, **options) -> DataFrame:
    """The dataset of a kind of source; unknown kinds are an error."""
    if kind not in READERS:
        raise ValueError(f"no reader of kind {kind!r}; there are {', '.join(sorted(READERS))}")
    return READERS[kind](spark, **options)
