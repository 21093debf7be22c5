"""Quantiles by refined histograms against Spark's own percentile."""
import math
import random

import pytest
from pyspark.sql import functions as F

from plumbline.operators import quantiles

AT = {"low": 0.0, "a": 0.025, "b": 0.25, "c": 0.5, "d": 0.75, "e": 0.975, "high": 1.0}


def table(spark, seed):
    rng = random.Random(seed)
    rows = [("near", None, 1.0 + k * 2.0**-52) for k in range(400)] + [("wide", 1, rng.choice([-1, 1]) * 10.0 ** rng.uniform(-300, 300)) for _ in range(500)]
    rows += [("ties", 2, float(rng.choice([0, -0.0, 1, 1, 1, 7]))) for _ in range(300)] + [("tiny", 3, rng.choice([5e-324, 1e-310, -5e-324, 0.0])) for _ in range(50)]
    rows += [("one", 4, 3.5), ("none", 5, None), ("none", 5, math.nan), ("two", 6, 1.0), ("two", 6, 2.0), (None, 7, 4.0), (None, 7, None), (None, 7, 9.0), ("ends", 8, math.inf), ("ends", 8, -math.inf), ("ends", 8, 1.7e308), ("ends", 8, -1.7e308), ("ends", 8, 0.0)]
    rows += [("flat", 9, rng.gauss(100, 1e-9)) for _ in range(3000)] + [("plain", 10, rng.gauss(0, 5)) for _ in range(3000)]
    rng.shuffle(rows)
    return spark.createDataFrame(rows, "g string, _rank int, x double").repartition(3)


@pytest.mark.parametrize(("group", "few"), [(["g"], 0), (["g", "_rank"], 1 << 20), ([], 0), ([], 1 << 20)])
def test_quantiles_are_those_of_percentile(spark, monkeypatch, group, few):
    monkeypatch.setattr(quantiles, "FEW", few)
    df = table(spark, 4)
    found = {tuple(r[: len(group)]): tuple(r[len(group) :]) for r in quantiles.exact_quantiles(df, group, "x", AT).collect()}
    plain = df.withColumn("x", F.when(~F.isnan("x"), F.col("x")))
    want = {tuple(r[: len(group)]): tuple(r[len(group) :]) for r in plain.groupBy(*group).agg(*(F.percentile("x", q).alias(n) for n, q in AT.items())).collect()}
    assert set(found) == set(want)
    for g, values in want.items():
        assert all(a == b or (a is not None and b is not None and math.isnan(a) and math.isnan(b)) for a, b in zip(found[g], values, strict=True)), (g, found[g], values)


def test_quantiles_of_an_empty_table(spark):
    assert quantiles.exact_quantiles(spark.createDataFrame([], "g string, x int"), ["g"], "x", AT).collect() == []


def test_wanted_buckets_go_whole_to_every_task(spark, monkeypatch):
    plans, join = [], quantiles.null_safe_join

    def seen(left, right, keys, how="inner"):
        if "_v" in left.columns:
            plans.append(right._jdf.queryExecution().logical().toString())
        return join(left, right, keys, how)

    monkeypatch.setattr(quantiles, "null_safe_join", seen)
    df = spark.range(2000).selectExpr("id % 3 as g", "sqrt(id) as x")
    assert quantiles.exact_quantiles(df, ["g"], "x", {"m": 0.5}).count() == 3
    assert plans and all("broadcast" in p.lower() for p in plans)
