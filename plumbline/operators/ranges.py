"""Joins on ranges: points in ranges, ranges that overlap, ranges without points."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.operators.scans import running
from plumbline.operators.stash import stash


def containing(points: DataFrame, value: str, ranges: DataFrame, low: str, high: str, key: Sequence[str], most: int = 10_000) -> DataFrame:
    """Each point with the inclusive ranges that hold it, and how many do (0: none, a row with nulls).

    The ranges are a dimension; up to `most` of them are broadcast, which is checked. More go through
    `containing_bucketed`.
    """
    if ranges.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} ranges: use containing_bucketed")
    joined = points.join(F.broadcast(ranges), F.col(value).between(F.col(low), F.col(high)), "left")
    return joined.withColumn("matches", F.count(low).over(Window.partitionBy(*key)))


def containing_bucketed(points: DataFrame, value: str, ranges: DataFrame, low: str, high: str, width: int) -> DataFrame:
    """Points with the ranges that hold them, for any number of numeric ranges: both sides by bucket of `width`."""
    cells = ranges.withColumn("_bucket", F.explode(F.sequence(F.floor(F.col(low) / width), F.floor(F.col(high) / width))))
    return points.withColumn("_bucket", F.floor(F.col(value) / width)).join(cells, "_bucket").where(F.col(value).between(F.col(low), F.col(high))).drop("_bucket")


def overlaps(df: DataFrame, key: str, low: str, high: str, group: Sequence[str], width: int) -> DataFrame:
    """Pairs of inclusive ranges of a group that overlap (left key < right key), and by how much.

    Ranges meet in buckets of `width`; a pair is reported in the bucket where its overlap begins, once.
    """
    cut = df.select(*group, key, low, high).withColumn("_b", F.explode(F.sequence(F.floor(F.col(low) / width), F.floor(F.col(high) / width))))
    side = lambda n: cut.select(*group, "_b", F.col(key).alias(f"{n}_id"), F.col(low).alias(f"{n}_low"), F.col(high).alias(f"{n}_high"))
    start = F.greatest("left_low", "right_low")
    met = side("left").join(side("right"), [*group, "_b"]).where(
        (F.col("left_id") < F.col("right_id")) & (F.col("left_low") <= F.col("right_high")) & (F.col("right_low") <= F.col("left_high")) & (F.floor(start / width) == F.col("_b"))
    )
    return met.withColumn("overlap", F.least("left_high", "right_high") - start).drop("_b")


def subtract_points(points: DataFrame, group: str, value: str, low: int, high: int) -> DataFrame:
    """What is left of [low, high] in each group that has points there, as inclusive ranges between the points."""
    inside = points.where(F.col(value).between(low, high)).select(group, value).distinct()
    w = Window.partitionBy(group).orderBy(value)
    after = inside.select(group, (F.col(value) + 1).alias("low"), (F.lead(value, 1, high + 1).over(w) - 1).alias("high"))
    before = inside.groupBy(group).agg(F.min(value).alias("m")).select(group, F.lit(low).cast("long").alias("low"), (F.col("m") - 1).alias("high"))
    return after.unionByName(before).where("low <= high")


def located(points: DataFrame, at: Column, ranges: DataFrame, low: Column, high: Column, value: str, unit: Sequence[str] = ()) -> DataFrame:
    """`points` with `matches`, how many inclusive ranges hold each, and `value`, that of the range if it is just one.

    `at`, `low` and `high` are of one orderable type, composite keys (structs) included. Starts, points
    and ends stand on one ordered line; the number of open ranges, and the sum of their numbers, which
    is the open one's where there is one, are carried along it. So neither side is broadcast and no
    bucket width is needed, however many ranges there are and however they overlap. `unit` columns,
    which both tables have, must agree. A null position matches nothing; ranges with a null end or that
    descend hold nothing.
    """
    held = stash(ranges.select(*unit, low.alias("_low"), high.alias("_high"), F.col(value).alias("_value")).where("_low <= _high").withColumn("_id", F.monotonically_increasing_id()), "numbered-ranges")
    line = points.withColumn("_at", at).withColumn("_kind", F.lit(1))
    columns = [F.col(c) for c in unit]
    starts = held.select(*columns, F.col("_low").alias("_at"), F.lit(0).alias("_kind"), F.col("_id").cast("decimal(38,0)").alias("_open"))
    ends = held.select(*columns, F.col("_high").alias("_at"), F.lit(2).alias("_kind"), (-F.col("_id").cast("decimal(38,0)")).alias("_open"))
    both = line.where("_at is not null").unionByName(starts.unionByName(ends), allowMissingColumns=True)
    step = F.when(F.col("_kind") == 0, 1).when(F.col("_kind") == 2, -1).otherwise(0)
    met = running(both, unit, ["_at", "_kind"], {"_matches": ("sum", step), "_sum": ("sum", F.coalesce("_open", F.lit(0).cast("decimal(38,0)")))}).where("_kind = 1")
    met = met.withColumn("_id", F.when(F.col("_matches") == 1, F.col("_sum")).cast("long"))
    found = met.join(held.select("_id", "_value"), "_id", "left").select(*points.columns, F.col("_matches").alias("matches"), F.col("_value").alias(value))
    none = line.where("_at is null").select(*points.columns, F.lit(0).cast("long").alias("matches"), F.lit(None).cast(ranges.schema[value].dataType).alias(value))
    return found.unionByName(none)


def range_faults(ranges: DataFrame, low: Column, high: Column, value: str, unit: Sequence[str] = ()) -> DataFrame:
    """(unit, value, fault): ranges without an end, that descend, or that begin before an earlier one of their unit ends."""
    keyed = ranges.select(*unit, F.col(value), low.alias("_low"), high.alias("_high"))
    bad = F.when(F.col("_low").isNull() | F.col("_high").isNull(), "missing_end").when(F.col("_low") > F.col("_high"), "descending")
    sound = running(keyed.where("_low <= _high"), unit, ["_low", "_high", value], {"_reach": ("max_before", F.col("_high"))})
    over = sound.where(F.col("_low") <= F.col("_reach")).select(*unit, value, F.lit("overlapping").alias("fault"))
    return keyed.withColumn("fault", bad).where("fault is not null").select(*unit, value, "fault").unionByName(over)
