"""Lookups in ranges, table differences, nested rules, confirmed duplicates and calibrations of many keys, against brute force."""
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.functions import file_number
from plumbline.operators import calibration, contracts, dedup, models, ranges, scans
from plumbline.sources import files


@pytest.mark.parametrize("rows", [20, 1 << 20])
def test_points_in_ranges_of_composite_keys(spark, monkeypatch, rows):
    monkeypatch.setattr(scans, "ROWS", rows)
    rng = random.Random(3)
    key = lambda: (rng.randint(0, 1), rng.randint(0, 6), rng.randint(0, 9))
    spans = [(f"r{i}", *sorted((key(), key()))[:: rng.choice([1, 1, 1, -1])]) for i in range(14)] + [("x", None, (1, 1, 1)), ("same", (0, 3, 3), (0, 3, 3))]
    points = [(i, key() if i % 10 else None) for i in range(150)]
    place = "struct<namespace:int,major:int,minor:int>"
    r = spark.createDataFrame(spans, f"value string, a {place}, z {place}")
    p = spark.createDataFrame([(i, k, "kept") for i, k in points], f"id int, k {place}, matches string").drop("matches")
    got = {x.id: (x.matches, x.value) for x in ranges.located(p, F.col("k"), r, F.col("a"), F.col("z"), "value").collect()}
    want = {}
    for i, k in points:
        held = [v for v, a, z in spans if k and a and z and a <= k <= z]
        want[i] = (len(held), held[0] if len(held) == 1 else None)
    assert got == want and {n for n, _ in want.values()} >= {0, 1, 2}
    faults = {(x.value, x.fault) for x in ranges.range_faults(r, F.col("a"), F.col("z"), "value").collect()}
    sound = sorted((a, z, v) for v, a, z in spans if a and z and a <= z)
    over = {(v, "overlapping") for n, (a, _, v) in enumerate(sound) if any(a <= zz for _, zz, _ in sound[:n])}
    assert faults == over | {(v, "descending") for v, a, z in spans if a and z and a > z} | {("x", "missing_end")}


def test_file_numbers_and_lookups(spark):
    stems = {"007": (0, 7, 0), "p12-3": (1, 12, 3), "P1-0": (1, 1, 0), "p12": None, "": None, "12a": None, None: None, "9" * 30: None}
    got = {r.s: r.n and tuple(r.n) for r in spark.createDataFrame([(s,) for s in stems], "s string").select("s", file_number(F.col("s")).alias("n")).collect()}
    assert got == stems
    owned = spark.createDataFrame([("a", "1", "9"), ("b", "10", "20"), ("c", "15", "30"), ("d", "p1-5", "p2-2")], "value string, start string, end string")
    paths = {"v/7.png": ("a", "ok"), "v/12.png": ("b", "ok"), "v/16.png": (None, "several_ranges"), "v/31.png": (None, "no_range"), "v/p2-0.png": ("d", "ok"), "v/p2-3.png": (None, "no_range"), "v/q.png": (None, "no_number"), "w/7.png": (None, "no_match"), "v/7.png2": (None, "no_match"), None: (None, "no_match")}
    df = spark.createDataFrame([(p, "kept") for p in paths], "path string, value string")
    out = files.looked_up_ids(df, "path", r"v/(?P<record>[a-z0-9-]+)\.png", owned, "owner").collect()
    assert {r.path: (r.owner, r.owner_status) for r in out} == paths and all(r.value == "kept" for r in out)


def test_table_differences(spark):
    left = [(1, "a", 1.0), (2, "b", None), (3, "c", math.nan), (4, "d", 4.0), (5, "e", 5.0), (5, "e", 5.0), (None, "n", 1.0), (7, "x", 2.0), (8, None, None), (9, "q", math.nan)]
    right = [(1, "a", 1.0 + 1e-9), (2, "b", 2.0), (3, "c", math.nan), (4, "D", 4.1), (5, "e", 5.0), (None, "n", 1.0), (70, "x", 2.0), (8, None, None), (9, "q", 1.0)]
    schema = "k int, s string, v double"
    got = {(r.kind, r.column): (r.rows, r["first"]) for r in contracts.table_differences(spark.createDataFrame(left, schema), spark.createDataFrame(right, schema), ["k"], {"v": 1e-6}).collect()}
    assert got == {("only_left", None): (1, "7"), ("only_right", None): (1, "70"), ("repeated_left", None): (1, "5"), ("null", "v"): (1, "2"), ("value", "s"): (1, "4"), ("value", "v"): (2, "4,9")}
    same = spark.createDataFrame(left, schema)
    assert {(r.kind, r.rows) for r in contracts.table_differences(same, same, ["k"]).collect()} == {("repeated_left", 1), ("repeated_right", 1)}
    assert contracts.table_differences(same.limit(0), same.limit(0), ["k"]).collect() == []
    many = spark.createDataFrame([(i, "a", 0.0) for i in range(100, 400)], schema)
    assert [(r.rows, r["first"]) for r in contracts.table_differences(many, many.limit(0), ["k"], first=4).collect()] == [(300, "100,101,102,103")]
    with pytest.raises(ValueError, match="columns differ"):
        contracts.table_differences(same, same.drop("v"), ["k"])


def test_nested_rules(spark):
    rows = [(["a", "b"], {"x": 1, "y": 0}), (["b", "a"], {"x": 1}), (["a", "a", " "], {"x": -1, "y": 2, "z": 3}), (None, None), ([], {"x": None, "y": 1}), (["a", None], {"x": 1, "y": 1})]
    df = spark.createDataFrame(rows, "t array<string>, m map<string,int>")
    got = {r.rule: (r.broken, r.elements) for r in contracts.nested_violations(df, ["t"], {"m": ["x", "y"]}, {"count": ("m", lambda v: v >= 0)}, {"size": F.size("t") == F.size("m")}).collect()}
    assert got == {"blank:t": (3, 2), "sorted:t": (3, 3), "keys:m": (3, 2), "element:count": (3, 2), "rule:size": (3, 3)}
    assert {(r.broken, r.elements) for r in contracts.nested_violations(df.limit(0), ["t"], {"m": ["x"]}).collect()} == {(0, 0)}


def metrics(a, b, size_a, size_b):
    """The measures of a pair of pictures in numpy."""
    corr = lambda x, y: -1.0 if np.linalg.norm(x - x.mean()) * np.linalg.norm(y - y.mean()) <= 1e-12 else float((x - x.mean()) @ (y - y.mean()) / np.linalg.norm(x - x.mean()) / np.linalg.norm(y - y.mean()))
    gradient = lambda x: np.concatenate([np.diff(x.reshape(16, 16), axis=k).ravel() for k in (0, 1)])

    def rmse(x, y):
        c = x - x.mean()
        if c @ c <= 1e-12:
            return math.inf
        return float(np.sqrt(np.mean((y - y.mean() - (c @ (y - y.mean())) / (c @ c) * c) ** 2)) / 255)

    ra, rb = size_a[0] / size_a[1], size_b[0] / size_b[1]
    return abs(ra - rb) / max(ra, rb), min(a.std(), b.std()), corr(a, b), corr(gradient(a), gradient(b)), max(rmse(a, b), rmse(b, a))


def test_near_pairs_are_confirmed_by_structure_and_meaning(spark):
    y, x = np.indices((16, 16))
    base = 20 + 4 * x + 3 * y + 20 * ((x // 2 + y // 2) % 2)
    rng = np.random.default_rng(2)
    pictures = {
        1: (base, (64, 64), "visible", "person"), 2: (base + 30, (128, 128), "visible", "person"), 3: (base * 0.5 + 9, (64, 64), "visible", "car"), 4: (base, (64, 40), "visible", "person"),
        5: (base + rng.integers(-40, 40, base.shape), (64, 64), "visible", "person"), 6: (base, (64, 64), "thermal", "person"), 7: (np.full(base.shape, 80), (64, 64), "visible", "person"), 8: (np.full(base.shape, 110), (64, 64), "visible", "person"),
    }
    items = spark.createDataFrame([(k, [int(v) for v in p.ravel()], *s, m, c) for k, (p, s, m, c) in pictures.items()], "id int, t array<int>, w int, h int, m string, c string")
    pairs = [(a, b, 0) for a in pictures for b in pictures if a < b]
    got = {(r.left_id, r.right_id): r for r in dedup.confirm_near(spark.createDataFrame(pairs, "left_id int, right_id int, distance int"), items, "id", "t", 16, "w", "h", "m", "c").collect()}
    for (a, b), r in got.items():
        want = metrics(*(np.array([int(v) for v in pictures[k][0].ravel()], float) for k in (a, b)), pictures[a][1], pictures[b][1])
        assert all(g == w or math.isclose(g, w, rel_tol=1e-9, abs_tol=1e-9) for g, w in zip((r.aspect, r.deviation, r.intensity, r.gradient, r.affine_rmse), want, strict=True)), (a, b)
    status = {k: r.status for k, r in got.items()}
    assert status[1, 2] == "confirmed" and status[1, 3] == "conflict" and status[1, 4] == "rejected" and status[1, 5] == "rejected" and status[1, 6] == "other_kind" and status[7, 8] == "rejected"


def test_difference_bits(spark):
    rng = np.random.default_rng(1)
    v = rng.standard_normal((20, 64))
    got = [r.b for r in spark.createDataFrame([(x.tolist(),) for x in v], "v array<double>").select(dedup.difference_bits("v").alias("b")).collect()]
    ring = np.concatenate([v, v], axis=1)
    want = [sum(1 << i for i in range(64) if ring[k, i : i + 16].sum() > ring[k, i + 16 : i + 32].sum()) for k in range(20)]
    assert [g % (1 << 64) for g in got] == want


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(7)
    rows = []
    for concept, n, bend in (("a", 150, 0.5), ("b", 90, 2.0), (None, 60, 1.0), ("one", 12, 1.0)):
        for i in range(n):
            p = round(rng.random(), 2)
            rows.append((concept, p, 1.0 if concept == "one" else float(rng.random() < p**bend), f"{concept}{i // 5}"))
    rows += [("a", None, 1.0, "a1"), ("a", math.nan, 0.0, "a1"), ("b", 0.4, None, "b1"), ("none", None, None, "z")]
    return rows, spark.createDataFrame(rows, "c string, p double, y double, g string").repartition(3)


def test_fits_of_many_keys_are_those_of_each(spark, labelled):
    rows, df = labelled
    fits, knots = calibration.fit_all(df, ["c"], "p", "y")
    fits, curve = {r.c: r for r in fits.collect()}, {}
    for r in knots.collect():
        curve.setdefault(r.c, []).append((r.x, r.value))
    assert set(fits) == set(curve) == {"a", "b", None, "one"}
    for c, fit in ((c, fits[c]) for c in ("a", None)):
        mine = df.where(F.col("c").eqNullSafe(c) & F.col("p").isNotNull() & ~F.isnan("p") & F.col("y").isNotNull())
        assert math.isclose(fit.temperature, models.fit_temperature(mine, "p", "y"), rel_tol=1e-6)
        assert np.allclose((fit.slope, fit.intercept), models.fit_platt(mine, "p", "y"), atol=1e-6)
        want = models.fit_isotonic(mine, "p", "y")
        assert np.allclose(sorted(curve[c]), want)
    told = calibration.calibrated(df, ["c"], "p", *calibration.fit_all(df, ["c"], "p", "y")).collect()
    assert len(told) == len(rows)
    for r in told:
        if r.c == "none" or r.p is None or math.isnan(r.p):
            assert r.isotonic is None and r.temperature is None and r.platt is None
        else:
            xs, ys = zip(*sorted(curve[r.c]), strict=True)
            assert math.isclose(r.isotonic, np.interp(r.p, xs, ys), abs_tol=1e-9)


def test_calibrators_are_chosen_per_key(spark, labelled):
    rows, df = labelled
    choice, fits, _ = calibration.choose_calibrators(df.where("c is null or c in ('a', 'b')"), ["c"], "p", "y", "g")
    got = {}
    for r in choice.collect():
        got.setdefault(r.c, {})[r.method] = (r.brier, r.selected)
    known = df.where("(c is null or c in ('a', 'b')) and p is not null and not isnan(p) and y is not null")
    fold = {r.g: r.fold for r in models.group_folds(known, "g").collect()}
    for c in (None,):
        mine = [(p, y, fold[g]) for k, p, y, g in rows if k == c and p is not None and not math.isnan(p) and y is not None]
        frame = spark.createDataFrame(mine, "p double, y double, f int")
        for method in models.METHODS:
            losses = []
            for f in range(3):
                fitted = models.fit_calibrator(frame.where(F.col("f") != f), "p", "y", method)
                losses.append(models.calibrate(frame.where(F.col("f") == f), "p", method, fitted, "q").agg(F.avg(F.pow(F.col("q") - F.col("y"), 2))).first()[0])
            assert math.isclose(got[c][method][0], np.mean(losses), abs_tol=1e-6)
        assert [m for m, (_, s) in got[c].items() if s] == [min(models.METHODS, key=lambda m: got[c][m][0])]
    assert fits.count() == 3


def test_fits_without_rows_and_of_one_class(spark):
    none = spark.createDataFrame([], "p double, y int")
    assert models.fit_temperature(none, "p", "y") == 1.0 and models.fit_platt(none, "p", "y") == (1.0, 0.0) and models.fit_isotonic(none, "p", "y") == []
    assert models.fit_platt(spark.createDataFrame([(0.2, 1), (0.9, 1)], "p double, y int"), "p", "y") == (1.0, 0.0)
    lone = spark.createDataFrame([(0.01 * k, int(k == 90)) for k in range(1, 100)] + [(0.999, 0)] * 300, "p double, y int")
    slope, intercept = models.fit_platt(lone, "p", "y")  # whole Newton steps run away here
    z = [math.log(r.p / (1 - r.p)) for r in lone.collect()]
    q = [1 / (1 + math.exp(-(slope * x + intercept))) for x in z]
    assert abs(sum(q) - 1) < 1e-6 and abs(sum((v - r.y) * x for v, r, x in zip(q, lone.collect(), z, strict=True)) + slope) < 1e-6
    knots = models.apply_knots(spark.createDataFrame([(math.nan,), (0.5,), (None,)], "p double"), "p", [(0.2, 0.1), (0.8, 0.7)], "q").collect()
    assert [r.q is None for r in knots] == [True, False, True]
    empty = spark.createDataFrame([], "c string, p double, y double, g string")
    fits, knots = calibration.fit_all(empty, ["c"], "p", "y")
    assert fits.collect() == [] and knots.collect() == []


def test_comparing_pairs_keeps_what_null_and_uneven_pictures_tell(spark):
    pictures = {1: [1.0, 5.0, 2.0, 9.0], 2: [2.0, 10.0, 4.0, 18.0], 3: None, 4: [1.0, None, 2.0, 9.0], 5: [1.0, 5.0, 2.0, 9.0, 3.0, 4.0], 6: [1.0, math.nan, 2.0, 9.0]}
    items = spark.createDataFrame([(k, t, 1, 1, "m", "c") for k, t in pictures.items()], "id int, t array<double>, w int, h int, m string, c string")
    pairs = spark.createDataFrame([(1, k, 0) for k in range(2, 7)], "left_id int, right_id int, distance int")
    got = {r.right_id: (r.intensity, r.gradient, r.affine_rmse) for r in dedup.confirm_near(pairs, items, "id", "t", 2, "w", "h", "m", "c", levels=1.0).collect()}
    assert np.allclose(got[2], (1, 1, 0)) and got[3] == got[4] == (-1.0, -1.0, math.inf) and got[5] == (None, None, 0.0) and all(map(math.isnan, got[6]))
