"""Scans over ranges against plain windows, with one unit that holds most of the table."""
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from plumbline.operators import asof, events, scans, timeseries


@pytest.fixture(scope="module")
def table(spark):
    rng = random.Random(5)
    rows = [("hot", t, rng.choice([None, rng.uniform(-5, 5)]), i) for i, t in enumerate(rng.choices(range(400), k=600))]
    rows += [(rng.choice(["a", "b", None]), rng.randint(0, 50), rng.uniform(0, 9), 1000 + i) for i in range(80)] + [("nulls", 1, None, 5000), ("nulls", 2, None, 5001)]
    return spark.createDataFrame(rows, "u string, t long, x double, i long").repartition(3)


@pytest.mark.parametrize("rows", [25, 1 << 20])
@pytest.mark.parametrize("reverse", [False, True])
def test_running_values(spark, table, monkeypatch, rows, reverse):
    monkeypatch.setattr(scans, "ROWS", rows)
    way = F.desc if reverse else F.asc
    w = Window.partitionBy("u").orderBy(way("t"), way("i"))
    upto, before, x = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, -1), F.col("x")
    want = table.select(
        "i", F.round(F.sum("x").over(upto), 6).alias("sum"), F.count("x").over(upto).alias("count"), F.max("x").over(upto).alias("max"), F.min("x").over(before).alias("min_before"), F.last("x", ignorenulls=True).over(upto).alias("last"),
        F.last("x", ignorenulls=True).over(before).alias("last_before"), F.lag("x").over(w).alias("before"), F.coalesce(F.count("x").over(before), F.lit(0)).alias("count_before"),
    )
    got = scans.running(table, ["u"], ["t", "i"], {k: (k, x) for k in want.columns[1:]}, reverse=reverse)
    got = got.withColumn("sum", F.round("sum", 6)).select(*want.columns)
    assert "_range" not in got.columns
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def plain_events(rows, gap):
    """{unit: [(start, end, positions)]} of flagged positions."""
    out = {}
    for u, t in sorted(rows, key=lambda r: (r[0] is None, r[0] or "", r[1])):
        runs = out.setdefault(u, [])
        if runs and t - runs[-1][1] <= gap:
            runs[-1][1:] = [t, runs[-1][2] + 1]
        else:
            runs.append([t, t, 1])
    return {(u, k + 1, *run) for u, runs in out.items() for k, run in enumerate(runs)}


@pytest.mark.parametrize("rows", [10, 1 << 20])
def test_events_of_a_hot_unit(spark, table, monkeypatch, rows):
    monkeypatch.setattr(scans, "ROWS", rows)
    got = events.extract_events(table, ["u"], "t", F.col("x") > 1, 2)
    want = plain_events([(r.u, r.t) for r in table.where("x > 1").collect()], 2)
    assert {tuple(r[c] for c in ("u", "event_id", "start", "end", "positions")) for r in got.collect()} == want and len(want) > 30
    reach = events.unit_continuity(table, ["u"], "t", 30.0)
    assert {(r.u, r.n) for r in reach.collect()} == {("hot", 600), ("nulls", 2), *((u, table.where(F.col("u").eqNullSafe(u)).count()) for u in ("a", "b", None))}


@pytest.mark.parametrize("rows", [10, 1 << 20])
def test_as_of_join_of_a_hot_group(spark, table, monkeypatch, rows):
    monkeypatch.setattr(scans, "ROWS", rows)
    left, right = table.where("i % 2 = 0 and u is not null"), table.where("i % 2 = 1 and u is not null").select("u", "t", F.col("i").alias("j"))
    got = {(r.i, r.j) for r in asof.as_of_join(left, right, ["u"], "t", ["j"], 20).collect()}
    held = right.collect()
    want = set()
    for r in left.collect():
        near = max(((x.t, x.j) for x in held if x.u == r.u and x.t <= r.t), default=None)
        want.add((r.i, near[1] if near and r.t - near[0] <= 20 else None))
    assert got == want


def test_history_and_future_over_blocks(spark, monkeypatch):
    monkeypatch.setattr(timeseries, "BLOCK", 7)
    rng = random.Random(8)
    points = sorted({("s", rng.randint(0, 40000)): rng.uniform(0, 10) for _ in range(900)}.items()) + [(("r", 5), 1.0), (("r", 700), 2.0)]
    df = spark.createDataFrame([(s, t, v) for (s, t), v in points], "s string, t long, v double").repartition(3)
    got = {(r.s, r.t): (r.future_n, r.future_max) for r in timeseries.future_window(df, "s", "t", "v", 100).collect()}
    ahead = lambda s, t: [v for (u, x), v in points if u == s and t < x <= t + 100]
    assert got == {k: (len(ahead(*k)), max(ahead(*k), default=None)) for k, _ in points}
    grid = {}
    for (s, t), v in points:
        grid[s, -(-t // 10) * 10] = v  # the last one of a cell
    windows = {(r.s, r.history_end): (r.history, r.future_max) for r in timeseries.history_windows(df, "d", "s", "t", "v", 50, 100, 10, 8.0).collect()}
    want = {}
    for s in ("s", "r"):
        times = [t for (u, t), _ in points if u == s]
        first, last = -(-min(times) // 10) * 10, max(times) // 10 * 10
        for g in range(first + 40, last + 1, 10):
            if ahead(s, g):
                want[s, g] = ([grid.get((s, g - 40 + 10 * k)) for k in range(5)], max(ahead(s, g)))
    assert windows == want and len(want) > 1000
