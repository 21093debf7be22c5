"""Scans in order along units of any size: running values whose state is carried over ranges, and windows with a halo.

A window function sorts a whole unit in one task. Here a table is cut into ranges of a total order by
Spark's range partitioning, which spreads a large unit over many ranges; each range is scanned by itself,
and what a range passes on (a sum, a maximum, a last row) is a row of a small table that is scanned in
the order of ranges and joined back. Where no unit has more than ROWS rows, plain windows do.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.operators.quantiles import null_safe_join
from plumbline.operators.stash import stash

#: Rows of a unit that one task may sort.
ROWS = 1 << 20


def in_ranges(df: DataFrame, unit: Sequence[str], order: Sequence[str], rows: int | None = None) -> tuple[DataFrame, bool]:
    """`df` with `_range`, and whether it was cut: 0 if no unit has more than `rows` rows, else numbers that grow along (unit, order).

    Rows that are equal in unit and order share a range.
    """
    rows = ROWS if rows is None else rows
    counts = df.groupBy(*unit).agg(F.count("*").alias("n")).agg(F.sum("n").alias("n"), F.max("n").alias("most")).first()
    if (counts.most or 0) <= rows:
        return df.withColumn("_range", F.lit(0)), False
    cut = df.repartitionByRange(-(-counts.n // rows), *unit, *order).withColumn("_range", F.spark_partition_id())
    return stash(cut, "ranges"), True  # fixes the ranges: their bounds come of a sample


def _alone(kind: str, value: Column, w: Window) -> Column:
    if kind == "before":
        return F.lag(F.struct(value.alias("x"))).over(w)
    w = w.rowsBetween(Window.unboundedPreceding, -1 if kind.endswith("_before") else 0)
    return {"sum": F.sum, "count": F.count, "max": F.max, "min": F.min, "last": lambda c: F.last(c, ignorenulls=True)}[kind.removesuffix("_before")](value).over(w)


def running(df: DataFrame, unit: Sequence[str], order: Sequence[str], values: dict[str, tuple[str, Column]], reverse: bool = False, cut: bool | None = None) -> DataFrame:
    """`df` with a column for each of `values`: {name: (kind, value)}, over the rows of the unit up to and with this one.

    Kinds: sum, count, max, min, last (the last value that is not null); the same with `_before` leave
    the row itself out; `before` is the value of the row before. As for window functions, nulls do not
    count, a sum of none is null, null units are a unit, and rows that `order` leaves equal come in any
    order. With `reverse` the unit is scanned from its end. `cut` is given for a table of `in_ranges`,
    which is scanned as it is and keeps `_range`.
    """
    given = cut is not None
    if not given:
        df, cut = in_ranges(df, unit, order)
    way = F.desc if reverse else F.asc
    w = Window.partitionBy(*unit, "_range").orderBy(*map(way, order))
    alone = df.select("*", *(_alone(kind, value, w).alias(f"_s_{name}") for name, (kind, value) in values.items()))
    if cut:
        at = F.struct(*order)
        last = F.min_by if reverse else F.max_by
        hold = {"sum": F.sum, "count": F.count, "max": F.max, "min": F.min}
        made = [
            (last(F.struct(value.alias("x")), at) if kind == "before" else last(value, F.when(value.isNotNull(), at)) if kind.startswith("last") else hold[kind.removesuffix("_before")](value)).alias(f"_c_{name}")
            for name, (kind, value) in values.items()
        ]
        upto = Window.partitionBy(*unit).orderBy(way("_range")).rowsBetween(Window.unboundedPreceding, -1)
        over = {"sum": F.sum, "count": F.sum, "max": F.max, "min": F.min}
        held = df.groupBy(*unit, "_range").agg(*made)  # a row a unit and range
        held = held.select(*unit, "_range", *(over.get(kind.removesuffix("_before"), lambda c: F.last(c, ignorenulls=True))(f"_c_{name}").over(upto).alias(f"_p_{name}") for name, (kind, _) in values.items()))
        alone = null_safe_join(alone, held, [*unit, "_range"], "left")
    else:
        alone = alone.select("*", *(F.lit(None).alias(f"_p_{name}") for name in values))

    def both(kind: str, name: str) -> Column:
        s, p = F.col(f"_s_{name}"), F.col(f"_p_{name}")
        if kind.startswith(("sum", "count")):
            return F.coalesce(s + p, s, p)
        if kind.startswith(("max", "min")):
            return (F.greatest if kind.startswith("max") else F.least)(s, p.cast(alone.schema[f"_s_{name}"].dataType))
        kept = F.coalesce(s, p.cast(alone.schema[f"_s_{name}"].dataType))
        return kept["x"] if kind == "before" else kept

    out = alone.select(*df.columns, *(both(kind, name).alias(name) for name, (kind, _) in values.items()))
    return out if given else out.drop("_range")


def with_halo(df: DataFrame, position: str, width: float, behind: float = 0, ahead: float = 0) -> DataFrame:
    """`df` with `_block` of `width` positions and `_own`: rows stand in their block, and as copies in those that see them.

    A window by (unit, _block) over positions from `behind` back to `ahead` on is whole for the rows with
    `_own`, and no task holds more of a unit than a block and its halo.
    """
    place = lambda c: F.floor(c / width)
    seen = F.sequence(place(F.col(position) - ahead), place(F.col(position) + behind))
    return df.withColumn("_block", F.explode(seen)).withColumn("_own", F.col("_block") == place(F.col(position)))
