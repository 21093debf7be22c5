"""Exact quantiles of groups of any size, by refined histograms.

The values that surround a rank are found from counts alone. A first histogram has buckets of a sixteenth
of a power of two; a bucket's smallest and largest value come with its count, and only buckets that hold a
wanted rank are refined, into equal parts between those two, three times over. Counts combine on the map
side, so a group is never together in one task, and all ranks of all groups go through the same passes.
After the first pass only the distinct values of wanted buckets are left, in a written table.
"""
from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.operators.stash import stash

#: Buckets of a power of two; parts of a bucket that is refined.
PER_OCTAVE, PARTS = 16, 1 << 16
ROUNDS = 3
#: So many distinct values, of all wanted buckets together, need no finer histogram: one task may sort them.
FEW = 1 << 20
#: So many wanted buckets go whole to every task. Without that a large bucket's rows would meet its limits in one task.
SENT = 1 << 14


def null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on `keys`, where nulls are equal; the columns of `left`, then the others of `right`."""
    named = right.select(*(F.col(k).alias(f"_r_{k}") for k in keys), *(c for c in right.columns if c not in keys))
    return left.join(named, reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys)), how).drop(*(f"_r_{k}" for k in keys))


def _octave(v: Column) -> Column:
    """A number of the bucket of v that never falls as v grows."""
    most = 1100 * PER_OCTAVE
    place = F.greatest(F.lit(-most), F.least(F.lit(most), F.floor(F.log2(F.abs(v)) * PER_OCTAVE)))
    return (F.signum(v) * (F.coalesce(place, F.lit(-most)) + most + 1)).cast("int")


def _part(v: Column, low: Column, high: Column) -> Column:
    return F.when(high > low, F.least(F.lit(PARTS - 1), F.floor((v / 2 - low / 2) / (high / 2 - low / 2) * PARTS))).otherwise(0).cast("int")


def _wanted(counts: DataFrame, within: Sequence[str], bucket: str, ranks: DataFrame, group: Sequence[str]) -> DataFrame:
    """`ranks` (group, within, _rank, _before) with the bucket that holds each rank, its limits, and the rows before it."""
    w = Window.partitionBy(*within).orderBy(bucket)
    upto = counts.withColumn("_upto", F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    met = null_safe_join(upto, ranks, within).where((F.col("_rank") < F.col("_before") + F.col("_upto")) & (F.col("_rank") >= F.col("_before") + F.col("_upto") - F.col("_n")))
    columns = dict.fromkeys([*within, bucket])
    return met.select(*columns, "_rank", (F.col("_before") + F.col("_upto") - F.col("_n")).alias("_before"), "_low", "_high")


def exact_quantiles(df: DataFrame, group: Sequence[str], value: str, at: dict[str, float]) -> DataFrame:
    """(group, names of `at`): quantiles of `value` in each group, between neighbouring values by linear interpolation.

    As `percentile` gives them: quantile q of n values lies at rank q * (n - 1). Nulls and NaN are left
    out; a group without any other value has nulls. Null groups are a group. An empty table gives no
    rows; without group columns it gives none either.
    """
    keys = [f"_g{i}" for i in range(len(group))] + ["_all"]
    v = F.col(value).cast("double")
    slim = df.select(*(F.col(g).alias(k) for g, k in zip(group, keys, strict=False)), F.lit(1).alias("_all"), F.when(~F.isnan(v), v + F.lit(0.0)).alias("_v")).withColumn("_b0", F.when(F.col("_v").isNotNull(), _octave(F.col("_v"))))
    counted = [F.sum("_m").alias("_n"), F.min("_v").alias("_low"), F.max("_v").alias("_high")]
    coarse = stash(slim.withColumn("_m", F.lit(1).cast("long")).groupBy(*keys, "_b0").agg(*counted), "histogram")
    sizes = coarse.groupBy(*keys).agg(F.coalesce(F.sum(F.when(F.col("_b0").isNotNull(), F.col("_n"))), F.lit(0)).alias("_total"))
    place = lambda q: F.lit(float(q)) * (F.col("_total") - 1)
    every = F.array_distinct(F.flatten(F.array(*(F.array(F.floor(place(q)), F.ceil(place(q))) for q in at.values()))))
    ranks = sizes.where("_total > 0").select(*keys, F.explode(every).alias("_rank"), F.lit(0).cast("long").alias("_before"))
    # distinct values of the wanted buckets, with counts
    wanted = stash(_wanted(coarse.where("_b0 is not null"), keys, "_b0", ranks, keys), "wanted")
    sent = F.broadcast if wanted.count() <= SENT else lambda t: t  # no more of them come later
    found = wanted.where("_low = _high").select(*keys, "_rank", F.col("_low").alias("_x"))
    open_ = wanted.where("_low < _high")
    path = [*keys, "_b0"]
    limits = lambda t, p: sent(t.select(*p, "_low", "_high").distinct())
    left = null_safe_join(slim.where("_b0 is not null"), limits(open_, path), path)
    left = stash(left.groupBy(*path, "_v", "_low", "_high").agg(F.count("*").alias("_m")), "candidates")
    for r in range(1, ROUNDS + 1 if left.count() > FEW else 1):
        bucket = f"_b{r}"
        left = left.withColumn(bucket, _part(F.col("_v"), F.col("_low"), F.col("_high"))).drop("_low", "_high")
        counts = left.groupBy(*path, bucket).agg(*counted)
        wanted = _wanted(counts, path, bucket, open_.drop("_low", "_high"), keys)
        path = [*path, bucket]
        found = found.unionByName(wanted.where("_low = _high").select(*keys, "_rank", F.col("_low").alias("_x")))
        open_ = wanted.where("_low < _high")
        left = null_safe_join(left, limits(open_, path), path)
    # what is still together differs in the last bits only
    last = left.withColumn("_upto", F.sum("_m").over(Window.partitionBy(*path).orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)))
    last = null_safe_join(last.drop("_low", "_high"), sent(open_), path).where((F.col("_rank") < F.col("_before") + F.col("_upto")) & (F.col("_rank") >= F.col("_before") + F.col("_upto") - F.col("_m")))
    found = found.unionByName(last.select(*keys, "_rank", F.col("_v").alias("_x")))
    values = found.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("_rank", "_x"))).alias("_of"))  # two ranks a quantile
    told = null_safe_join(sizes, values, keys, "left")

    def between(q: float) -> Column:
        low, high = F.floor(place(q)), F.ceil(place(q))
        a, b = F.try_element_at("_of", low), F.try_element_at("_of", high)
        return F.when(low == high, a).when(a == b, a).otherwise((high - place(q)) * a + (place(q) - low) * b)

    return told.select(*(F.col(k).alias(g) for g, k in zip(group, keys, strict=False)), *(F.when(F.col("_total") > 0, between(q)).alias(name) for name, q in at.items()))
