"""Causal series operators: resampling, history and horizon windows, window statistics, purge gaps."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.operators.scans import running, with_halo


#: Grid points that stand in one array.
BLOCK = 4096


def causal_resample(df: DataFrame, sensor: str, epoch: str, values: Sequence[str], stride: int) -> DataFrame:
    """Each sensor on a grid of `stride` seconds: the last observation in (grid - stride, grid], with masks.

    The whole row is taken, missing cells included. The grid runs from the first observation's grid point
    (rounded up) to the last one's (rounded down). Of observations at one second the greatest row counts.
    """
    bucket = (F.ceil(F.col(epoch) / stride) * stride).cast("long")
    last = df.groupBy(sensor, bucket.alias("grid")).agg(F.max_by(F.struct(*values), F.struct(epoch, *values)).alias("_row"))
    span = df.groupBy(sensor).agg(F.ceil(F.min(epoch) / stride).alias("a"), F.floor(F.max(epoch) / stride).alias("z")).where("a <= z")
    blocks = span.select(sensor, "z", F.explode(F.sequence("a", "z", F.lit(BLOCK).cast("long"))).alias("a"))  # an array of bounded size a row
    grid = blocks.select(sensor, F.explode(F.sequence("a", F.least("z", F.col("a") + BLOCK - 1))).alias("k")).select(sensor, (F.col("k") * stride).alias("grid"))
    joined = grid.join(last, [sensor, "grid"], "left")
    return joined.select(sensor, "grid", *(F.col(f"_row.{v}").alias(v) for v in values), *(F.col(f"_row.{v}").isNotNull().alias(f"{v}_mask") for v in values))


def future_window(df: DataFrame, sensor: str, epoch: str, value: str, horizon: int) -> DataFrame:
    """`df` with future_n and future_max: how many observations lie in (epoch, epoch + horizon], and their greatest value.

    A sensor is cut into blocks of several horizons, with the rows that a block looks ahead to.
    """
    halo = with_halo(df, epoch, 8 * horizon, ahead=horizon)
    w = Window.partitionBy(sensor, "_block").orderBy(epoch).rangeBetween(1, horizon)
    return halo.withColumn("future_n", F.count(value).over(w)).withColumn("future_max", F.max(value).over(w)).where("_own").drop("_block", "_own")


def history_windows(df: DataFrame, dataset: str, sensor: str, epoch: str, value: str, history: int, horizon: int, stride: int, risk: float) -> DataFrame:
    """Forecast windows: every grid point with a full history behind it and an observation ahead.

    Returns window_id (a hash of dataset, sensor and end), history_start, history_end, forecast_end, the
    history as an array in time order (null where the grid has no observation), future_max and
    event_truth (1 if a future value reaches `risk`). Sensors are cut into blocks of time with a halo, so
    that a long one is many tasks; arrays are made once, for ends that have a future.
    """
    steps = history // stride
    grid = causal_resample(df, sensor, epoch, [value], stride)
    # observations and grid points on one time line: a grid point sees what follows it
    line = df.select(sensor, F.col(epoch).cast("long").alias("t"), F.col(value).alias("x"), F.lit(False).alias("is_end"))
    line = line.unionByName(grid.select(sensor, F.col("grid").alias("t"), F.lit(None).cast("double").alias("x"), F.lit(True).alias("is_end")))
    ahead = future_window(line, sensor, "t", "x", horizon).where("is_end and future_max is not null").select(sensor, F.col("t").alias("grid"), "future_max")
    behind = with_halo(grid.select(sensor, "grid", value), "grid", max(64, 8 * steps) * stride, behind=(steps - 1) * stride)
    back = Window.partitionBy(sensor, "_block").orderBy("grid").rowsBetween(-(steps - 1), 0)
    points = behind.withColumn("history", F.collect_list(F.struct("grid", value)).over(back)).where(F.col("_own") & (F.size("history") == steps))
    found = points.join(ahead, [sensor, "grid"])
    return found.select(
        F.sha2(F.concat_ws("|", F.lit(dataset), F.col(sensor).cast("string"), F.col("grid").cast("string")), 256).alias("window_id"), sensor,
        (F.col("grid") - history).alias("history_start"), F.col("grid").alias("history_end"), (F.col("grid") + horizon).alias("forecast_end"), F.transform("history", lambda x: x[value]).alias("history"), "future_max", (F.col("future_max") >= risk).cast("int").alias("event_truth"),
    )


def causal_statistics(windows: DataFrame, key: str, history: str, stride: int, spans: Sequence[int] = (60, 180, 300)) -> DataFrame:
    """Ten statistics of the last `span` seconds of each window's history, a column per span and statistic.

    Missing cells are left out; the slope is per step, 0 with fewer than two values; the other statistics
    are null without a value. Everything is folded inside the row: no shuffle.
    """
    out = []
    for span in spans:
        k = -(-span // stride)
        part = F.slice(history, -k, k)
        kept = F.filter(part, lambda x: x.isNotNull())
        n = F.size(kept)
        total = F.aggregate(kept, F.lit(0.0), lambda a, x: a + x)
        mean = F.try_divide(total, n)
        var = F.try_divide(F.aggregate(kept, F.lit(0.0), lambda a, x: a + (x - mean) * (x - mean)), n)  # noqa: B023
        ordered = F.array_sort(kept)

        def quantile(q: float, ordered=ordered, n=n) -> Column:
            at = (n - 1) * q
            low = F.floor(at).cast("int")
            a, b = F.try_element_at(ordered, low + 1), F.try_element_at(ordered, F.least(low + 2, n))
            return F.when(n > 0, a + (b - a) * (at - low))

        places = F.filter(F.transform(part, lambda x, i: F.struct(i.cast("double").alias("i"), x.alias("x"))), lambda s: s["x"].isNotNull())
        s = F.aggregate(places, F.struct(*(F.lit(0.0).alias(c) for c in ("i", "ii", "ix"))), lambda a, p: F.struct((a["i"] + p["i"]).alias("i"), (a["ii"] + p["i"] * p["i"]).alias("ii"), (a["ix"] + p["i"] * p["x"]).alias("ix")))
        slope = F.when(n < 2, 0.0).otherwise(F.try_divide(n * s["ix"] - s["i"] * total, n * s["ii"] - s["i"] * s["i"]))
        stats = {
            "last": F.try_element_at(kept, F.lit(-1)), "mean": mean, "std": F.sqrt(var), "min": F.array_min(kept), "max": F.array_max(kept), "slope": slope,
            "q25": quantile(0.25), "median": quantile(0.5), "q75": quantile(0.75), "missing": 1 - n / k,
        }
        out += [c.alias(f"{name}_{span}") for name, c in stats.items()]
    return windows.select(key, *out)


def purge_gaps(df: DataFrame, sensor: str, start: str, end: str, pool: str, pools: Sequence, tie: Sequence[str]) -> DataFrame:
    """For each window, the gap between its start and the latest end of any earlier window of another pool."""
    ends = {f"_e{i}": ("max_before", F.when(F.col(pool) == p, F.col(end))) for i, p in enumerate(pools)}
    latest = [F.when(F.col(pool) != p, F.col(f"_e{i}")) for i, p in enumerate(pools)]
    return running(df, [sensor], [start, *tie], ends).withColumn("gap", F.col(start) - F.greatest(*latest)).drop(*ends)


def time_order_faults(df: DataFrame, sensor: str, epoch: str) -> DataFrame:
    """Observations that do not come strictly after the one before them in reading order (`_seq`)."""
    return running(df, [sensor], ["_seq"], {"before": ("before", F.col(epoch))}).where(F.col(epoch) <= F.col("before"))
