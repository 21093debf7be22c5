"""Probability metrics, ranking metrics, paired comparison and decision tables."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions import joined_sha256
from plumbline.operators.quantiles import exact_quantiles, null_safe_join


def calibration_error(df: DataFrame, group: Sequence[str], p: str, y: str, bins: int = 10) -> DataFrame:
    """Expected calibration error over equal bins whose edges are multiples of 1/bins in floating point; the last is closed."""
    edges = [k * (1.0 / bins) for k in range(1, bins)]
    place = sum(((F.col(p) >= e).cast("int") for e in edges), F.lit(0))
    per = df.where(F.col(p).isNotNull() & F.col(y).isNotNull()).groupBy(*group, place.alias("_bin")).agg(F.count("*").alias("n"), F.avg(p).alias("conf"), F.avg(F.col(y).cast("double")).alias("acc"))
    return per.groupBy(*group).agg(F.try_divide(F.sum(F.col("n") * F.abs(F.col("conf") - F.col("acc"))), F.sum("n")).alias("ece"), F.sum("n").alias("n"))


def brier(p: str, y: str) -> Column:
    return F.avg(F.pow(F.col(p) - F.col(y), 2))


def ranked_totals(df: DataFrame, group: Sequence[str], score: str, y: str, buckets: int = 1024) -> DataFrame:
    """For each distinct score of a group, the rows and positives that score at least as much.

    Scores lie in [0, 1]. A score's totals are those of the higher buckets, a table of at most `buckets`
    rows a group, and those above it in its own bucket: no group is ordered in one task.
    """
    tied = df.groupBy(*group, score).agg(F.count("*").alias("n"), F.sum(F.col(y).cast("long")).alias("pos"))
    tied = tied.withColumn("_b", F.floor(F.col(score) * buckets))
    higher = Window.partitionBy(*group).orderBy(F.desc("_b")).rowsBetween(Window.unboundedPreceding, -1)
    base = tied.groupBy(*group, "_b").agg(F.sum("n").alias("bn"), F.sum("pos").alias("bp"))
    base = base.select(*group, "_b", F.coalesce(F.sum("bn").over(higher), F.lit(0)).alias("bn"), F.coalesce(F.sum("bp").over(higher), F.lit(0)).alias("bp"))
    own = Window.partitionBy(*group, "_b").orderBy(F.desc(score)).rowsBetween(Window.unboundedPreceding, 0)
    out = tied.withColumn("cn", F.sum("n").over(own)).withColumn("cp", F.sum("pos").over(own)).join(base, [*group, "_b"])
    return out.select(*group, score, "pos", (F.col("cn") + F.col("bn")).alias("at_least"), (F.col("cp") + F.col("bp")).alias("positives"))


def average_precision(df: DataFrame, group: Sequence[str], score: str, y: str) -> DataFrame:
    """Step-wise average precision, ties counted together: the mean of precision over positives; null without any."""
    ranked = ranked_totals(df, group, score, y)
    return ranked.groupBy(*group).agg(F.try_divide(F.sum(F.col("pos") * F.col("positives") / F.col("at_least")), F.sum("pos")).alias("average_precision"), F.sum("pos").alias("positives"))


def confusion(df: DataFrame, group: Sequence[str], predicted: Column, y: str) -> DataFrame:
    """Counts of a decision against truth, and F1 (1 where there is nothing to find and nothing found)."""
    told, true = F.coalesce(predicted, F.lit(False)), F.col(y) == 1
    out = df.groupBy(*group).agg(F.count_if(told & true).alias("tp"), F.count_if(told & ~true).alias("fp"), F.count_if(~told & true).alias("fn"), F.count_if(~told & ~true).alias("tn"))
    return out.withColumn("f1", F.coalesce(F.try_divide(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")), F.lit(1.0)))


def selective_risk(df: DataFrame, group: Sequence[str], answered: Column, wrong: Column) -> DataFrame:
    """Coverage, and the share of wrong answers among those given (1 where none is)."""
    return df.groupBy(*group).agg(F.avg(answered.cast("double")).alias("coverage"), F.coalesce(F.avg(F.when(answered, wrong.cast("double"))), F.lit(1.0)).alias("risk"))


def relative_drop(clean: Column, other: Column) -> Column:
    """100 * (clean - other) / clean; null where clean is 0."""
    return F.when(clean > 0, 100 * (clean - other) / clean)


def paired_table(df: DataFrame, unit: Sequence[str], family: str, value: str, left: str, right: str) -> DataFrame:
    """Units that have a value of both families, as columns left, right and difference."""
    wide = df.groupBy(*unit).pivot(family, [left, right]).agg(F.first(value, ignorenulls=True))
    wide = wide.select(*unit, F.col(left).alias("left"), F.col(right).alias("right")).where(F.col("left").isNotNull() & F.col("right").isNotNull())
    return wide.withColumn("difference", F.col("left") - F.col("right"))


def paired_bootstrap(pairs: DataFrame, repeat: str, unit: str, difference: str, draws: int, seed: int, contrast: Sequence[str] = ()) -> DataFrame:
    """(contrast, draw, mean): means over repeats of the means of units drawn with replacement inside each repeat.

    Unit k of a draw is the unit whose number is a hash of (seed, contrast, draw, repeat, k), so any engine
    can draw the same; means are rounded to 12 digits, so that one of zero is zero in whatever order it is
    summed. Rows grow with draws times units; units are evaluation groups, not records.
    """
    cell = [*contrast, repeat]
    w = Window.partitionBy(*cell)
    numbered = pairs.select(*cell, unit, difference).withColumn("k", F.row_number().over(w.orderBy(unit)) - 1).withColumn("n", F.count("*").over(w))
    drawn = numbered.select(*cell, "k", "n", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))).alias("draw"))
    pick = F.conv(F.substring(joined_sha256(seed, *contrast, "draw", repeat, "k"), 1, 8), 16, 10).cast("long") % F.col("n")
    chosen = drawn.select(*cell, "draw", pick.alias("k")).join(numbered.select(*cell, F.col("k").cast("long").alias("k"), difference), [*cell, "k"])
    per = chosen.groupBy(*contrast, "draw", repeat).agg(F.avg(difference).alias("m"))
    return per.groupBy(*contrast, "draw").agg(F.round(F.avg("m"), 12).alias("mean"))


def interval(pairs: DataFrame, means: DataFrame, repeat: str, difference: str, contrast: Sequence[str] = ()) -> DataFrame:
    """Per contrast: the effect (mean of the repeats' means in the data), and the percentile interval and two-sided p value of its bootstrap means."""
    share = lambda c: F.avg(c.cast("double"))
    m, key = F.col("mean"), [*contrast, "_one"]
    p = F.least(F.lit(1.0), 2 * F.least(share(m <= 0), share(m >= 0)))
    given = means.withColumn("_one", F.lit(1))
    drawn = null_safe_join(exact_quantiles(given, key, "mean", {"low": 0.025, "high": 0.975}), given.groupBy(*key).agg(p.alias("p_value")), key)
    effect = pairs.withColumn("_one", F.lit(1)).groupBy(*key, repeat).agg(F.avg(difference).alias("_m")).groupBy(*key).agg(F.avg("_m").alias("estimate"))
    return effect.join(drawn, key).drop("_one")


def holm(df: DataFrame, key: str, p: str, family: Sequence[str] = ()) -> DataFrame:
    """Step-down adjusted p values, monotone, ties by key. A family of contrasts is small by nature."""
    w = Window.partitionBy(*(family or [F.lit(1)])).orderBy(p, key)
    n = F.count("*").over(Window.partitionBy(*(family or [F.lit(1)])))
    scaled = F.least(F.lit(1.0), F.col(p) * (n - F.row_number().over(w) + 1))
    return df.withColumn("_s", scaled).withColumn("p_holm", F.max("_s").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_s")


def contrast_decision(estimate: Column, low: Column, high: Column, p: Column, effect: float, alpha: float = 0.05) -> Column:
    """'negative' (the interval lies below 0), 'support' (above it, with an effect that matters and a p value that holds) or 'inconclusive'."""
    return F.when(high < 0, "negative").when((low > 0) & (estimate >= effect) & (p <= alpha), "support").otherwise("inconclusive")


def mean_interval(value: str) -> list[Column]:
    """Mean and its normal 95 % limits from the sample deviation; the mean alone with one value."""
    half = F.coalesce(1.96 * F.stddev_samp(value) / F.sqrt(F.count(value)), F.lit(0.0))
    return [F.avg(value).alias("mean"), (F.avg(value) - half).alias("low"), (F.avg(value) + half).alias("high")]


def latency_summary(df: DataFrame, key: Sequence[str], phase: str, duration_ns: str) -> DataFrame:
    """p50 and p95 (truncated to whole nanoseconds) and throughput over timed iterations."""
    timed = df.where(F.col(phase) == "timed")
    at = exact_quantiles(timed, key, duration_ns, {"latency_p50_ns": 0.5, "latency_p95_ns": 0.95})
    at = at.select(*key, *(F.col(c).cast("long").alias(c) for c in ("latency_p50_ns", "latency_p95_ns")))
    return null_safe_join(at, timed.groupBy(*key).agg(F.try_divide(F.count("*") * F.lit(1e9), F.sum(duration_ns)).alias("throughput_per_second"), F.count("*").alias("n")), key)


def robust_scale(df: DataFrame, group: Sequence[str], features: Sequence[str]) -> DataFrame:
    """Median and interquartile range (1 where it is 0) of each feature and group, nulls left out, as long rows."""
    long = df.select(*group, F.explode(F.array(*(F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("x")) for f in features))).alias("f")).select(*group, "f.*")
    out = exact_quantiles(long, [*group, "feature"], "x", {"center": 0.5, "_a": 0.25, "_b": 0.75})
    out = out.select(*group, "feature", "center", (F.col("_b") - F.col("_a")).alias("scale"))
    return out.withColumn("scale", F.when(F.coalesce(F.col("scale"), F.lit(0.0)) == 0, 1.0).otherwise(F.col("scale")))


def standardizer(df: DataFrame, features: Sequence[str], fit: Column) -> DataFrame:
    """Per feature, from the rows that `fit` marks: median for missing cells, then mean and population deviation (0: 1)."""
    long = df.where(fit).select(F.explode(F.array(*(F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("x")) for f in features))).alias("f")).select("f.*")
    median = exact_quantiles(long, ["feature"], "x", {"median": 0.5}).fillna(0.0, ["median"])
    filled = long.join(F.broadcast(median), "feature").withColumn("x", F.coalesce("x", "median"))  # a row a feature
    out = filled.groupBy("feature").agg(F.first("median").alias("median"), F.avg("x").alias("mean"), F.stddev_pop("x").alias("std"))
    return out.withColumn("std", F.when(F.col("std") == 0, 1.0).otherwise(F.col("std")))
