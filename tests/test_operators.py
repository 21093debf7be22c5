"""Operators against literal expectations and brute force."""
import json
import math
import random
from collections import Counter
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline import functions as fn
from plumbline.operators import asof, components, contracts, dedup, detection, episodes, events, metrics, models, ranges, selection, splits, timeseries


def flagged(spark, flags, unit="u"):
    return spark.createDataFrame([(unit, i, bool(f)) for i, f in enumerate(flags)], "unit string, t long, f boolean")


def rows(df, *names):
    return sorted(tuple(r[n] for n in names) for r in df.collect())


def test_islands_merge_within_the_larger_gap(spark):
    df = flagged(spark, [1, 1, 0, 1, 0, 1])
    assert rows(events.extract_events(df, ["unit"], "t", F.col("f"), 1, 2), "start", "end") == [(0, 5)]
    assert rows(events.extract_events(df, ["unit"], "t", F.col("f"), 1), "start", "end") == [(0, 1), (3, 3), (5, 5)]
    assert events.extract_events(flagged(spark, [0, 0]), ["unit"], "t", F.col("f"), 1).collect() == []


def series(spark, points):
    return spark.createDataFrame([("u", t, v, s) for t, v, s in points], "unit string, t long, v double, s double")


def test_sensor_evaluation(spark):
    args = (["unit"], "t", "v", "s", 1.0, 0.5, 0, 30, 60)
    one = events.sensor_evaluation(series(spark, [(80, 0.0, 1.0), (95, 0.0, 0.0), (100, 2.0, 1.0), (110, 2.0, 0.0)]), *args).first()
    assert (one.matched, one.predictions - one.matched, one.lead_p50, one.lead_p75 - one.lead_p25) == (1, 1, 20.0, 0.0)
    early = events.sensor_evaluation(series(spark, [(60, 0.0, 1.0), (70, 0.0, 1.0), (75, 0.0, 1.0), (100, 2.0, 0.0), (110, 2.0, 0.0)]), *args).first()
    assert (early.matched, early.truths, early.predictions, early.f1) == (0, 1, 1, 0.0)
    assert (one.hours, one.false_alarms_per_hour) == (10 * 4 / 3600, 1 / (10 * 4 / 3600))  # median gap times rows
    silent = events.sensor_evaluation(series(spark, [(80, 2.0, 0.0)]), *args).first()
    assert (silent.precision, silent.recall, silent.f1, silent.hours) == (0.0, 0.0, 0.0, 60 / 3600)
    calm = events.sensor_evaluation(series(spark, [(80, 0.0, 0.0), (90, 0.0, 0.0)]), *args).first()
    assert (calm.precision, calm.recall, calm.f1) == (None, None, None)


def test_threshold_candidates_pool_units(spark):
    rows_ = [("f", u, t, v, s) for u, points in (("a", [(0, 2.0, 0.9), (60, 0.0, 0.1), (120, 0.0, 0.5)]), ("b", [(0, 0.0, 0.3), (60, 2.0, 0.2)])) for t, v, s in points]
    df = spark.createDataFrame(rows_, "fam string, unit string, t long, v double, s double")
    got = {r.candidate_id: r for r in events.threshold_candidates(df, ["unit"], "fam", "t", "v", "s", 1.0, 0, 0, 60).collect()}
    assert len(got) == 17 and set(got) >= {"f@0.10", "f@0.90"}
    high = got["f@0.50"]  # a: a match and a false alarm; b: a miss
    assert np.allclose((high.false_alarms_per_hour, high.event_macro_f1, high.event_miss_rate), (12, 1 / 3, 0.5))


def test_matching_against_brute_force(spark):
    rng = random.Random(6)
    truth, told = [], []
    for u in range(12):
        for k in range(rng.randint(0, 8)):
            a = rng.randint(0, 60)
            truth.append((u, k, a, a + rng.randint(0, 15)))
        for k in range(rng.randint(0, 8)):
            a = rng.randint(0, 60)
            told.append((u, k, a, a + 1))
    want = []
    for u in range(12):
        free = {t[1]: t for t in truth if t[0] == u}
        for p in sorted((p for p in told if p[0] == u), key=lambda p: (p[2], p[1])):
            fits = [t for t in free.values() if t[2] - 5 <= p[2] <= t[3]]
            if fits:
                t = min(fits, key=lambda t: (t[3], t[1]))
                del free[t[1]]
                want.append((u, t[1], p[1]))
    schema = "unit int, event_id int, start int, end int"
    got = events.match_events(spark.createDataFrame(truth, schema), spark.createDataFrame(told, schema), ["unit"], 5)
    assert rows(got, "unit", "truth_id", "pred_id") == sorted(want)


def episode(spark, truth, states, name="e"):
    return spark.createDataFrame([(name, i, t, s) for i, (t, s) in enumerate(zip(truth, states, strict=True))], "e string, step long, truth int, state string")


def test_episode_evaluation(spark):
    r = events.episode_evaluation(episode(spark, [0, 1, 1, 0, 0], ["prewarning", "prewarning", "abstain", "normal", "normal"]), ["e"], "step", "truth", "state").first()
    assert (r.matched, r.coverage, r.flips) == (0, 0.8, 2)
    r = events.episode_evaluation(episode(spark, [1, 1, 1, 0, 1], ["normal", "attention", "alarm", "prewarning", "abstain"]), ["e"], "step", "truth", "state").first()
    assert (r.matched, r.mean_delay, r.delay_total, r.flips, r.precision) == (1, 2.0, 2.0, 4, 1.0)
    r = events.episode_evaluation(episode(spark, [0, 0], ["normal", "normal"]), ["e"], "step", "truth", "state").first()
    assert r.f1 is None and r.miss_rate is None and r.recall is None
    two = episode(spark, [1], ["alarm"], "a").unionByName(episode(spark, [1], ["alarm"], "b"))
    r = events.episode_evaluation(two, ["e"], "step", "truth", "state").agg(F.sum("predictions").alias("n"), F.sum("flips").alias("f")).first()
    assert (r.n, r.f) == (2, 0)


def test_alarm_states_follow_the_rules(spark):
    p, off = [1.0, 1.0, 0.0, 1.0, 1.0, 0.0], [0, 0, 1, 0, 0, 0]
    df = spark.createDataFrame([("e", i, x, bool(a)) for i, (x, a) in enumerate(zip(p, off, strict=True))], "e string, step long, p double, abstain boolean")
    out = episodes.policy_states(df, ["e"], "step", "p", F.col("abstain"), episodes.Policy(0.7, 2, 0.3, 0.6, None)).orderBy("step").collect()
    assert [r.state for r in out] == ["attention", "attention", "abstain", "attention", "prewarning", "prewarning"]


def test_alarm_states_stream_long_episodes(spark):
    rng = random.Random(8)
    rows = [(e, i, rng.choice([None, 0.0, rng.random(), 1.0]), rng.random() < 0.1) for e, n in (("long", 20_000), (None, 50), ("s", 3)) for i in range(n)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "e string, step long, p double, abstain boolean")
    out = episodes.policy_states(df, ["e"], "step", "p", F.col("abstain"), episodes.Policy(0.5, 2, 0.3, 0.6, 0.8))
    assert "collect_list" not in out._jdf.queryExecution().toString()  # no episode is ever one array
    want, m, run, armed, level, now = [], 0.0, 0, 0, 0, 0
    for e, i, p, off in sorted(rows, key=lambda r: (str(r[0]), r[1])):
        if e != now:
            m, run, armed, level, now = 0.0, 0, 0, 0, e
        if off or p is None:
            want.append((e, i, m, "abstain"))
            continue
        m = 0.5 * m + 0.5 * p
        run, armed = (run + 1) * (m >= 0.6), (armed + 1) * (m >= 0.8)
        level = max(level if level >= 2 and m >= 0.3 else 0, 3 if armed >= 2 else 2 if run >= 2 else int(m >= 0.3))
        want.append((e, i, m, ["normal", "attention", "prewarning", "alarm"][level]))
    assert sorted(((r.e, r.step, r.memory, r.state) for r in out.collect()), key=lambda r: (str(r[0]), r[1])) == want


def test_threshold_choice(spark):
    schema = "family_id string, candidate_id string, threshold double, false_alarms_per_hour double, event_macro_f1 double, event_miss_rate double"
    blocked = selection.select_threshold(spark.createDataFrame([("f", "a", 0.1, 2.0, 0.9, 0.1), ("f", "b", 0.2, 1.0, 0.2, 0.5)], schema), ["family_id"], 0.5).first()
    assert (blocked.selected, blocked.diagnostic, blocked.status) == (None, "b", "diagnostic_only_blocked")
    chosen = selection.select_threshold(spark.createDataFrame([("f", "a", 0.1, 0.4, 0.5, 0.2), ("f", "b", 0.2, 0.3, 0.5, 0.2), ("f", "c", 0.3, 9.0, 1.0, 0.0)], schema), ["family_id"], 0.5).first()
    assert (chosen.selected, chosen.diagnostic, chosen.status) == ("b", "b", "pass")


def test_policy_choice(spark):
    schema = "package string, candidate_id string, answer_coverage double, false_alarms_per_100_episodes double, event_miss_rate double, event_macro_f1 double, mean_detection_delay_steps double, mean_state_flips_per_episode double, complexity_rank int"
    rows_ = [("p", "a", 0.5, 1.0, 0.3, 0.9, 1.0, 1.0, 0), ("p", "b", 0.89, 9.0, 0.1, 0.2, 1.0, 1.0, 1), ("p", "c", 0.91, 5.0, 0.1, 0.2, 1.0, 1.0, 2), ("q", "d", 0.5, 1.0, 0.4, 0.9, 1.0, 1.0, 0), ("q", "e", 0.9, 50.0, 0.3, 0.1, 1.0, 1.0, 1)]
    got = {r.package: r for r in selection.select_policy(spark.createDataFrame(rows_, schema), ["package"]).collect()}
    assert (got["p"].status, got["p"].selected, got["p"].diagnostic) == ("pass", "b", "c")  # blocked ones go by miss rate, then false alarms
    assert (got["q"].status, got["q"].selected, got["q"].diagnostic) == ("diagnostic_only_blocked", None, "e")


def test_hash_pools_and_quotas(spark):
    weights = splits.BRANCH
    q = splits.quotas(43, weights, 13007, "d")
    assert sum(q.values()) == 43 and min(q.values()) >= 1
    assert splits.quotas(43, dict(reversed(weights.items())), 13007, "d") == q
    assert min(splits.quotas(4, weights, 1, "d").values()) == 1
    with pytest.raises(splits.QuotaError):
        splits.quotas(3, weights, 1, "d")
    few = splits.quotas(5, {"a": 0.96, "b": 0.01, "c": 0.01, "d": 0.01, "e": 0.01}, 1, "d")
    assert few == dict.fromkeys("abcde", 1)
    groups = [f"g{i}" for i in range(26)]
    df = spark.createDataFrame([(g,) for g in groups], "c string")
    shuffled = spark.createDataFrame([(g,) for g in random.Random(1).sample(groups, 26)] * 2, "c string").repartition(3)
    one, two = (rows(splits.assign_components(d.withColumn("d", F.lit("x")), "c", "d", weights, 13007), "c", "pool") for d in (df, shuffled))
    assert one == two and len(one) == 26
    pool = rows(splits.assign_by_hash(df, ["c"], weights, 5), "c", "pool")
    import hashlib

    names, total = sorted(weights), sum(weights.values())
    for c, p in pool:
        x, run = int(hashlib.sha256(f"5|{c}".encode()).hexdigest(), 16) / 2**256, 0
        want = next((n for n in names if (run := run + weights[n] / total) > x), names[-1])
        assert p == want


def test_time_pools_are_contiguous(spark):
    days = spark.createDataFrame([(f"2024-01-{d:02}", s) for d in range(1, 17) for s in range(3)], "day string, sensor int")
    out = splits.assign_by_time(days, "day", ["tr", "sel", "prob", "te"], splits.BRANCH, 1, "d").orderBy("day").collect()
    runs = [r.pool for i, r in enumerate(out) if not i or out[i - 1].pool != r.pool]
    assert runs == ["tr", "sel", "prob", "te"] and len(out) == 16


def test_few_shot(spark):
    df = spark.createDataFrame([("d", f"g{i}", i % 2) for i in range(20)], "ds string, g string, y int")
    out = splits.few_shot(df, "ds", "g", "y", [1, 2, 3])
    assert rows(out.groupBy("seed").count(), "seed", "count") == [(1, 2), (2, 2), (3, 2)]


def test_few_shot_takes_training_groups_only(spark):
    df = spark.createDataFrame([("d", f"g{i}", i % 2, "tr" if i < 10 else "te") for i in range(20)], "ds string, g string, y int, pool string")
    assert {r.g for r in splits.few_shot(df, "ds", "g", "y", [1, 2, 3], share=0.5, pool="pool").collect()} <= {f"g{i}" for i in range(10)}


def test_cohorts_must_follow_each_other(spark):
    days = spark.createDataFrame([(d and 86400 * d,) for d in (0, 1, 2, 3, 5, 6, 9, 9, None)], "s long")
    assert rows(splits.cohort_gaps(days, "s", 86400), "s", "next", "missing") == [(3 * 86400, 5 * 86400, 1.0), (6 * 86400, 9 * 86400, 2.0)]
    weights = {"a": 1.0, "b": 1.0}
    with pytest.raises(splits.QuotaError, match="continuous"):
        splits.assign_by_time(days.where("s is not null"), "s", ["a", "b"], weights, 1, "d", length=86400)
    whole = splits.assign_by_time(days.where("s < 4 * 86400"), "s", ["a", "b"], weights, 1, "d", length=86400)
    assert rows(whole, "s", "pool") == [(0, "a"), (86400, "a"), (2 * 86400, "b"), (3 * 86400, "b")]


def test_truths_by_whole_name():
    assert contracts.names_of_truth(["F1", "score", "auroc", "p", "truth_x", "map50_95"]) == ["F1", "auroc", "map50_95", "truth_x"]


def test_scopes_of_threads_are_their_own(spark):
    import threading

    from plumbline.operators.stash import new_path, scratch

    with scratch(spark) as mine:
        other = []
        thread = threading.Thread(target=lambda: other.append(new_path(spark, "of-another-thread")))
        thread.start()
        thread.join()
        assert mine == [] and other


def test_hamming_join_equals_brute_force(spark):
    rng = random.Random(13007)
    bits = [rng.getrandbits(64) for _ in range(200)] + [0, 0b1111]
    bits += [b ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for b in bits[:40]]
    bits = sorted(set(bits))
    df = spark.createDataFrame([(i, b - (1 << 64) if b >> 63 else b) for i, b in enumerate(bits)], "id int, bits long")
    got = rows(dedup.hamming_pairs(df, "id", "bits", 4), "left_id", "right_id", "distance")
    assert got == sorted((i, j, d) for i, j in combinations(range(len(bits)), 2) if (d := (bits[i] ^ bits[j]).bit_count()) <= 4)


@pytest.mark.parametrize("kind", ["random", "chain", "star", "empty"])
def test_components(spark, kind):
    rng = random.Random(3)
    edges = {"random": [(rng.randint(0, 150), rng.randint(0, 150)) for _ in range(110)], "chain": [(i + 1, i) for i in range(60)], "star": [(0, i) for i in range(1, 90)], "empty": []}[kind]
    parent = {n: n for e in edges for n in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = rows(components.connected_components(spark.createDataFrame([*edges, (None, 1)], "src int, dst int")), "node", "component")
    linked = {n for a, b in edges if a != b for n in (a, b)}
    assert got == sorted((n, find(n)) for n in linked)


def test_group_components_and_ids(spark):
    df = spark.createDataFrame([("x", "a"), ("x", "c"), ("y", "c"), ("y", "d"), ("z", "e")], "h string, g string")
    out = dedup.group_components(df, "h", "g")
    assert rows(out, "g", "component") == [("a", "a"), ("c", "a"), ("d", "a"), ("e", "e")]
    ids = dedup.component_ids(out, "g")
    assert sorted(r.groups for r in ids.collect()) == [1, 3] and all(r.component_id.startswith("cmp_") for r in ids.collect())


def test_contract_names_every_broken_rule(spark):
    good = "a" * 64
    df = spark.createDataFrame([(1, "x", good, '{"a":1}', ["a", "b"], 0.5), (1, " ", "zz", "[", ["b", "a"], 1.5), (None, None, None, None, None, None)], "k int, s string, h string, j string, arr array<string>, p double")
    c = contracts.TableContract(required=("k",), key=("k",), not_blank=("s",), matches={"h": contracts.SHA256}, json_objects=("j",), sorted_sets=("arr",), between={"p": (0, 1)}, forbidden=("truth",))
    assert rows(c.violations(df), "rule", "broken") == [("blank:s", 2), ("json:j", 2), ("key", 1), ("range:p", 1), ("regex:h", 2), ("set:arr", 2)]
    with pytest.raises(contracts.ContractError, match="key"):
        c.check(df)
    with pytest.raises(contracts.ContractError, match="columns: k"):
        c.check(df.drop("k"))
    assert c.missing(df.withColumn("truth", F.lit(1))) == ["forbidden:truth"]
    assert c.check(df.limit(0)).count() == 0
    with pytest.raises(contracts.ContractError, match="left side repeats"):
        contracts.join_checked(df, df.select("k").distinct(), ["k"], cardinality="1:1")
    with pytest.raises(contracts.ContractError, match="not model features"):
        contracts.model_features(df, ["p", "event_truth"], ["k"])


def test_purge_gaps(spark):
    for start, ok in ((1200, True), (900, False)):
        df = spark.createDataFrame([("s", 0, 600, "a", 1), ("s", start, start + 300, "b", 2)], "s string, a long, z long, pool string, id int")
        worst = timeseries.purge_gaps(df, "s", "a", "z", "pool", ["a", "b"], ["id"]).agg(F.min("gap")).first()[0]
        assert (worst >= 600) is ok


def test_resample_and_windows(spark):
    df = spark.createDataFrame([("s", 30 * k, 0.2 if k < 31 else 1.2) for k in range(41)], "s string, t long, v double")
    out = timeseries.history_windows(df, "d", "s", "t", "v", 300, 300, 30, 1.0).orderBy("history_end").collect()
    assert out[0].history_end == 270 and all(len(r.history) == 10 for r in out) and out[-1].history_end == 1170
    first = next(r for r in out if r.event_truth)
    assert max(first.history) < 1.0 and first.history_end == 630
    gaps = timeseries.causal_resample(spark.createDataFrame([("s", 1, 5.0), ("s", 29, None), ("s", 95, 7.0)], "s string, t long, v double"), "s", "t", ["v"], 30).orderBy("grid").collect()
    assert [(r.grid, r.v, r.v_mask) for r in gaps] == [(30, None, False), (60, None, False), (90, None, False)]


def test_causal_statistics_match_numpy(spark):
    h = [1.0, None, 4.0, 2.0, None, 8.0, 3.0, 5.0, 9.0, 6.0]
    df = spark.createDataFrame([("w", h), ("n", [None] * 10), ("o", [None] * 9 + [2.0])], "id string, h array<double>")
    out = {r.id: r for r in timeseries.causal_statistics(df, "id", "h", 30).collect()}
    part = np.array([np.nan if x is None else x for x in h])
    x, ok = np.arange(10.0), ~np.isnan(part)
    r, v = out["w"], part[ok]
    assert np.allclose([r.last_300, r.mean_300, r.std_300, r.min_300, r.max_300, r.slope_300, r.q25_300, r.median_300, r.q75_300, r.missing_300], [6, v.mean(), v.std(), 1, 9, np.polyfit(x[ok], v, 1)[0], *np.quantile(v, [0.25, 0.5, 0.75]), 0.2])
    assert r.last_60 == 6 and r.mean_60 == 7.5 and out["n"].mean_300 is None and out["n"].missing_300 == 1 and out["n"].slope_300 == 0 and out["o"].slope_60 == 0 and out["o"].q75_60 == 2


def test_as_of_tolerance(spark):
    left = spark.createDataFrame([("a", 10, 1), ("a", 5, 2), ("b", 9, 3)], "k string, t int, id int")
    right = spark.createDataFrame([("a", 4, "x"), ("a", 10, "y"), ("a", 10, "z")], "k string, t int, v string")
    assert rows(asof.as_of_join(left, right, ["k"], "t", ["v"]).fillna("-"), "id", "v") == [(1, "z"), (2, "x"), (3, "-")]
    assert rows(asof.as_of_join(left, right, ["k"], "t", ["v"], tolerance=0).fillna("-"), "id", "v") == [(1, "z"), (2, "-"), (3, "-")]


def test_ranges(spark):
    bands = spark.createDataFrame([(1, 5, "a"), (4, 9, "b")], "low int, high int, band string")
    points = spark.createDataFrame([(0,), (4,), (9,)], "x int")
    assert rows(ranges.containing(points, "x", bands, "low", "high", ["x"]).fillna("-", ["band"]), "x", "band", "matches") == [(0, "-", 0), (4, "a", 2), (4, "b", 2), (9, "b", 1)]
    assert rows(ranges.containing_bucketed(points, "x", bands, "low", "high", 3), "x", "band") == [(4, "a"), (4, "b"), (9, "b")]
    with pytest.raises(ValueError, match="containing_bucketed"):
        ranges.containing(points, "x", bands, "low", "high", ["x"], most=1)
    left = ranges.subtract_points(spark.createDataFrame([("g", 3), ("g", 3), ("g", 10), ("g", 99)], "g string, v long"), "g", "v", 1, 10)
    assert rows(left, "low", "high") == [(1, 2), (4, 9)]


def test_overlaps_equal_brute_force(spark):
    rng = random.Random(2)
    data = [(i, i % 3, a := rng.randint(0, 200), a + rng.randint(0, 60)) for i in range(60)]
    df = spark.createDataFrame(data, "id int, g int, a int, z int")
    want = sorted((x[0], y[0], min(x[3], y[3]) - max(x[2], y[2])) for x, y in combinations(data, 2) if x[1] == y[1] and x[2] <= y[3] and y[2] <= x[3])
    assert rows(ranges.overlaps(df, "id", "a", "z", ["g"], 25), "left_id", "right_id", "overlap") == want


def test_metrics(spark):
    df = spark.createDataFrame([("g", 0.1, 0), ("g", 0.9, 1)], "g string, p double, y int")
    assert abs(metrics.calibration_error(df, ["g"], "p", "y", 2).first().ece - 0.1) < 1e-12
    rng = np.random.default_rng(4)
    p, y = rng.integers(0, 40, 300) / 40, rng.integers(0, 2, 300)
    ap = metrics.average_precision(spark.createDataFrame([("g", float(a), int(b)) for a, b in zip(p, y, strict=True)], "g string, p double, y int"), ["g"], "p", "y").first()
    want = sum((y[p == t].sum() / y.sum()) * (y[p >= t].sum() / (p >= t).sum()) for t in np.unique(p))
    assert abs(ap.average_precision - want) < 1e-12
    h = {r.k: r.p_holm for r in metrics.holm(spark.createDataFrame([("b", 0.03), ("a", 0.01), ("c", 0.2)], "k string, p double"), "k", "p").collect()}
    assert np.allclose([h["a"], h["b"], h["c"]], [0.03, 0.06, 0.2])
    edges = spark.createDataFrame([("g", 0.3, 1), ("g", 0.25, 0)], "g string, p double, y int")
    assert abs(metrics.calibration_error(edges, ["g"], "p", "y").first().ece - 0.225) < 1e-12  # 0.3 lies below the edge 0.30000000000000004


def test_detection_precision(spark):
    truth = spark.createDataFrame([("r", "c", 1, 0.0, 0.0, 10.0, 10.0), ("r", "c", 2, 20.0, 20.0, 30.0, 30.0)], "record string, concept string, box_id int, x1 double, y1 double, x2 double, y2 double")
    perfect = truth.withColumnRenamed("box_id", "detection_id").withColumn("score", F.col("detection_id") / 3)
    marks = [0.5 + 0.05 * k for k in range(10)]
    assert {r.ap for r in detection.detection_precision(truth, perfect, "record", "concept", marks).collect()} == {1.0}


def test_detection_precision_against_brute_force(spark):
    rng = random.Random(11)
    box = lambda: (a := rng.uniform(0, 15), b := rng.uniform(0, 15), a + rng.uniform(3, 12), b + rng.uniform(3, 12))
    truth = [(r, "xy"[k % 2], k, *box()) for r in range(15) for k in range(4)]
    told = [(r, "xyz"[k % 3], k, *box(), round(rng.random(), 2)) for r in range(15) for k in range(6)]

    def overlap(a, b):
        w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
        i = max(0, w) * max(0, h)
        return i / ((a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - i)

    want = {}
    for c in "xyz":
        for t in (0.1, 0.3):
            order, used, hits = sorted((p for p in told if p[1] == c), key=lambda p: (-p[7], p[0], p[2])), set(), []
            for p in order:
                fits = [(-overlap(p[3:7], q[3:7]), q[2]) for q in truth if q[:2] == (p[0], c) and (p[0], q[2]) not in used and overlap(p[3:7], q[3:7]) >= t]
                hits.append(bool(fits))
                if fits:
                    used.add((p[0], min(fits)[1]))
            n, tp = sum(q[1] == c for q in truth), np.cumsum(hits)
            precision = tp / np.arange(1, len(hits) + 1)
            want[c, t] = sum(max(precision[i:]) for i in range(len(hits)) if hits[i]) / n if n else None
    cols = "x1 double, y1 double, x2 double, y2 double"
    got = detection.detection_precision(spark.createDataFrame(truth, f"record int, concept string, box_id int, {cols}"), spark.createDataFrame(told, f"record int, concept string, detection_id int, {cols}, score double"), "record", "concept", [0.1, 0.3])
    for r in got.collect():
        w = want[r.concept, r.threshold]
        assert (r.ap is None and w is None) or abs(r.ap - w) < 1e-9


def test_derangement_has_no_fixed_point(spark):
    df = spark.createDataFrame([(s, i, 0) for s in "ab" for i in range(3)] + [("c", 9, 0)], "s string, conv_id int, turn int")
    out = selection.derangement(df, "s", ["conv_id", "turn"], 9103).collect()
    assert all(r.conv_id != r.from_conv for r in out if r.s != "c") and sorted((r.s, r.from_conv) for r in out) == sorted((r.s, r.conv_id) for r in out)


def test_packing_starts_anew(spark):
    df = spark.createDataFrame([("l", i, n) for i, n in enumerate([20, 12, 1, 40, 5])], "lane string, i int, n long")
    assert rows(episodes.pack_groups(df, ["lane"], ["i"], "n"), "i", "episode", "first_step") == [(0, 0, 0), (1, 0, 20), (2, 1, 0), (3, 2, 0), (4, 3, 0)]


def test_calibrations(spark):
    rng = np.random.default_rng(1)
    z = rng.normal(size=800)
    y = (rng.random(800) < 1 / (1 + np.exp(-z * 0.5))).astype(int)
    p = 1 / (1 + np.exp(-z))
    df = spark.createDataFrame([(float(a), int(b)) for a, b in zip(p, y, strict=True)], "p double, y int").cache()
    t = models.fit_temperature(df, "p", "y")
    loss = lambda t: float(np.mean(np.log1p(np.exp(-np.abs(z / t))) + np.maximum(z / t, 0) - y * z / t))
    assert loss(t) <= min(loss(x) for x in np.exp(np.linspace(-5, 5, 400))) + 1e-6
    a, b = models.fit_platt(df, "p", "y")
    q = 1 / (1 + np.exp(-(a * z + b)))
    assert abs(((q - y) * z).sum() + a) < 1e-3 and abs((q - y).sum()) < 1e-3
    knots = models.fit_isotonic(spark.createDataFrame([(0.1, 0), (0.2, 1), (0.3, 0), (0.4, 1)], "p double, y int"), "p", "y")
    assert knots == [(0.1, 0.0), (0.2, 0.5), (0.3, 0.5), (0.4, 1.0)]
    at = models.apply_knots(spark.createDataFrame([(0.0,), (0.15,), (0.25,), (0.9,), (None,)], "p double"), "p", knots, "v")
    assert [r.v if r.p is None else round(r.v, 9) for r in at.collect()] == [0, 0.25, 0.5, 1, None]
    w = spark.createDataFrame([(1, [0.4, None]), (2, [None, None]), (3, [1.0, 1.0])], "id int, h array<double>")
    s = {r.id: r.score for r in models.persistence_scores(w, "h", 0.7, F.lit(True)).collect()}
    assert abs(s[2] - 0.5) < 1e-12 and s[1] < 0.5 < s[3] and math.isclose(s[3], 1 / (1 + math.exp(-0.3 / 0.3)), rel_tol=1e-9)
    folds = models.group_folds(spark.createDataFrame([(i % 9,) for i in range(90)], "g int"), "g").collect()
    assert sorted(r.fold for r in folds) == [0, 0, 0, 1, 1, 1, 2, 2, 2]


def brute_isotonic(p, y):
    blocks = []
    for q in sorted(set(p)):
        mine = [b for a, b in zip(p, y, strict=True) if a == q]
        blocks.append([sum(mine), len(mine), [q]])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            s, n, qs = blocks.pop()
            blocks[-1] = [blocks[-1][0] + s, blocks[-1][1] + n, blocks[-1][2] + qs]
    return {q: s / n for s, n, qs in blocks for q in qs}


def test_isotonic_fit_is_exact_at_any_size(spark):
    rng = np.random.default_rng(7)
    p = rng.random(9000).tolist() + [0.25] * 50
    y = (rng.random(9050) < np.array(p) ** 2).astype(int).tolist()
    df = spark.createDataFrame(list(zip(p, y, strict=True)), "p double, y int").repartition(5)
    want = brute_isotonic(p, y)
    knots = models.fit_isotonic(df, "p", "y")
    assert all(abs(want[x] - v) < 1e-12 for x, v in knots) and {knots[0][0], knots[-1][0]} == {min(p), max(p)}
    got = models.apply_knots(df, "p", knots, "v").collect()
    assert max(abs(r.v - want[r.p]) for r in got) < 1e-9
    assert models.fit_isotonic(df.limit(0), "p", "y") == []


def test_group_folds_are_balanced(spark):
    rng = random.Random(5)
    sizes = {f"g{i}": rng.choice([1, 1, 2, 3, 5, 40, 41]) for i in range(60)}
    df = spark.createDataFrame([(g,) for g, n in sizes.items() for _ in range(n)], "g string")
    got = models.group_folds(df, "g").collect()
    assert {r.g: r.rows for r in got} == sizes
    loads = [sum(r.rows for r in got if r.fold == f) for f in range(3)]
    want, order = [0, 0, 0], sorted(sizes.values(), reverse=True)
    for n in order:
        want[want.index(min(want))] += n
    assert loads == want and max(loads) - min(loads) <= 1
    assert models.group_folds(df.limit(0), "g").collect() == []


def test_calibrator_choice_against_numpy(spark):
    rng = np.random.default_rng(3)
    z = rng.normal(size=600)
    y = (rng.random(600) < 1 / (1 + np.exp(-(2 * z + 1)))).astype(int)
    p = 1 / (1 + np.exp(-z))
    df = spark.createDataFrame([(float(a), int(b), i % 20) for i, (a, b) in enumerate(zip(p, y, strict=True))], "p double, y int, g int")
    fold = {r.g: r.fold for r in models.group_folds(df, "g").collect()}
    f = np.array([fold[i % 20] for i in range(600)])
    each = []
    for k in range(3):
        fit = brute_isotonic(p[f != k].tolist(), y[f != k].tolist())
        xs = sorted(fit)
        each.append(np.mean((np.interp(p[f == k], xs, [fit[x] for x in xs]) - y[f == k]) ** 2))
    method, fitted, losses = models.select_calibrator(df, "p", "y", "g")
    assert abs(losses["isotonic"] - np.mean(each)) < 1e-9
    assert method == min(losses, key=losses.get) and losses["platt"] < losses["temperature"] and fitted is not None


def test_components_over_several_datasets_keep_every_quota(spark):
    rng = random.Random(2)
    of = {f"c{i}": [d for d in ("x", "y", "z") if rng.random() < 0.6] or ["x"] for i in range(150)}
    rows_ = [(c, d) for c, ds in of.items() for d in ds] * 2
    one = rows(splits.assign_components(spark.createDataFrame(rows_, "c string, d string"), "c", "d", splits.BRANCH, 13007), "c", "pool")
    rng.shuffle(rows_)
    assert one == rows(splits.assign_components(spark.createDataFrame(rows_, "c string, d string").repartition(5), "c", "d", splits.BRANCH, 13007), "c", "pool")
    pool = dict(one)
    assert set(pool) == set(of)
    for d in "xyz":
        mine = [c for c in of if d in of[c]]
        assert {p: sum(pool[c] == p for c in mine) for p in splits.BRANCH} == splits.quotas(len(mine), splits.BRANCH, 13007, d)


def assignment_exists(sizes, each):
    """Whether any counts per set of several datasets and pool stay within the quotas, by trying all."""
    crossing, seen = [(of, n) for of, n in sizes.items() if len(of) > 1], set()
    pools = list(next(iter(each.values())))

    def ways(n, k):
        return [(n,)] if k == 1 else [(v, *rest) for v in range(n + 1) for rest in ways(n - v, k - 1)]

    def go(i, left):
        if i == len(crossing):
            return True
        if (i, left) in seen:
            return False
        seen.add((i, left))
        of, n = crossing[i]
        for part in ways(n, len(pools)):
            new = tuple((d, tuple(a - b for a, b in zip(q, part, strict=True)) if d in of else q) for d, q in left)
            if min(min(q) for _, q in new) >= 0 and go(i + 1, new):
                return True
        return False

    return go(0, tuple((d, tuple(q.values())) for d, q in each.items()))


def test_assignments_are_found_wherever_there_is_one():
    rng, seen = random.Random(11), set()
    for _ in range(1200):
        names = "wxyz"[: rng.choice([2, 3, 3, 4])]
        sizes = {of: rng.randint(0, 3) for k in range(1, len(names) + 1) for of in combinations(names, k)}
        sizes = {of: n for of, n in sizes.items() if n}
        weights = {p: rng.choice([0.5, 0.3, 0.2, 0.1]) for p in "abcd"[: rng.choice([2, 3, 4])]}
        held = {d: sum(n for of, n in sizes.items() if d in of) for of in sizes for d in of}
        if not sizes or min(held.values()) < len(weights) or sum(sizes.values()) > 12:
            continue
        each = {d: splits.quotas(n, weights, 1, d) for d, n in sorted(held.items())}
        try:
            got, dealt = splits.deal_quotas(sizes, weights, 1)
        except splits.QuotaError:
            seen.add("none")
            assert not assignment_exists(sizes, each), (sizes, weights)
            continue
        seen.add("found")
        assert got == each and all(sum(dealt[of].values()) == n and min(dealt[of].values()) >= 0 for of, n in sizes.items())
        assert all(sum(dealt[of][p] for of in sizes if d in of) == each[d][p] for d in each for p in weights)
    assert seen == {"none", "found"}


def test_assignments_of_large_and_hard_sets(spark):
    hard = {("x",): 2, ("z",): 1, ("x", "y"): 2, ("y", "z"): 2, ("x", "y", "z"): 1}
    weights = {"a": 0.5, "b": 0.3, "c": 0.2}
    each, dealt = splits.deal_quotas(hard, weights, 1)
    assert all(sum(dealt[of][p] for of in hard if d in of) == each[d][p] for d in each for p in weights)
    members = [(f"{'+'.join(of)}-{k}", d) for of, n in hard.items() for k in range(n) for d in of]
    pool = dict(rows(splits.assign_components(spark.createDataFrame(members, "c string, d string"), "c", "d", weights, 1), "c", "pool"))
    assert all(sum(pool[c] == p for c, d in members if d == of) == each[of][p] for of in each for p in weights)
    large = {of: 10**9 + 7 * len(of) for k in (1, 2, 3) for of in combinations("uvwx", k)}
    each, dealt = splits.deal_quotas(large, splits.BRANCH, 5)
    assert all(sum(dealt[of][p] for of in large if d in of) == each[d][p] for d in each for p in splits.BRANCH)
    assert rows(splits.numbered_slots(spark, [("x", "a", 7), ("x", "b", 2)], block=3), "pool", "_slot") == [("a", k) for k in range(7)] + [("b", 0), ("b", 1)]


def test_spanning_edges_against_kruskal(spark):
    rng = random.Random(8)
    nodes = list(range(60))
    links = sorted({(min(a, b), max(a, b)) for a, b in ((rng.choice(nodes), rng.choice(nodes)) for _ in range(200)) if a != b})
    near = [(a, b, rng.randint(1, 4)) for a, b in links]
    parts = {n: n - n % 3 for n in nodes}
    parent = {c: c for c in parts.values()}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    want = []
    for a, b, d in sorted(near, key=lambda e: (e[2], e[0], e[1])):
        x, y = find(parts[a]), find(parts[b])
        if x != y:
            parent[max(x, y)] = min(x, y)
            want.append((a, b, d))
    got = dedup.spanning_edges(spark.createDataFrame(near, "left_id int, right_id int, distance int"), spark.createDataFrame(list(parts.items()), "n int, component int"), "n")
    assert rows(got, "left_id", "right_id", "distance") == sorted(want)


def test_contrast_decisions(spark):
    cases = [(-0.2, -0.3, -0.01, 0.2), (0.2, 0.1, 0.3, 0.01), (0.2, 0.1, 0.3, 0.2), (0.02, 0.01, 0.3, 0.01), (0.0, -0.1, 0.1, 0.01)]
    df = spark.createDataFrame(cases, "e double, l double, h double, p double").select(metrics.contrast_decision(*(F.col(c) for c in "elhp"), 0.05).alias("d"))
    assert [r.d for r in df.collect()] == ["negative", "support", "inconclusive", "inconclusive", "inconclusive"]


def test_effect_is_that_of_the_data(spark):
    pairs = spark.createDataFrame([("a", "u", 1.0), ("a", "v", 3.0), ("b", "u", 10.0)], "r string, u string, d double")
    out = metrics.interval(pairs, metrics.paired_bootstrap(pairs, "r", "u", "d", 50, 1), "r", "d").first()
    assert out.estimate == 6.0 and out.low < 6.0 < out.high and out.p_value == 0.0


def test_scalar_functions(spark):
    one = spark.createDataFrame([("a/b.txt", "Wind Speed (m/s)", 0.4)], "p string, n string, x double").select(
        fn.safe_relative_path(F.col("p")).alias("safe"), fn.safe_relative_path(F.lit("../x")).alias("up"), fn.normalised_name("n").alias("name"), fn.on_grid(F.col("x"), [0.1, 0.4]).alias("grid"), fn.on_grid(F.lit(0.41), [0.1, 0.4]).alias("off"),
        fn.gamma(F.array(F.lit(0), F.lit(128), F.lit(255)), 1.7).alias("g"), fn.hash_modulo(F.lit("f" * 64), 97).alias("m"),
    ).first()
    assert (one.safe, one.up, one.name, one.grid, one.off, one.g, one.m) == (True, False, "wind_speed_m_s", True, False, [0, round(255 * (128 / 255) ** 1.7), 255], (2**64 - 1) % 97)
    assert json.dumps(fn.hex_boundaries([0.5, 0.5])) == json.dumps(["8" + "0" * 63])


def test_records(spark):
    import hashlib
    import hmac

    from plumbline.operators import records

    one = spark.createDataFrame([("a", "b")], "x string, y string").select(records.opaque_id(b"k", "x", "y").alias("o")).first()
    assert one.o == hmac.new(b"k", b"a|b", hashlib.sha256).hexdigest()
    with pytest.raises(contracts.ContractError):
        records.result_table([spark.createDataFrame([(1, 2.0)], "k int, v double")] * 2, ["k"])
    claims = spark.createDataFrame([("a", "x", "g", "full"), ("b", "x", "g", "limited"), ("c", "y", "g", "full"), ("d", "x", "h", "full"), ("e", "z", "g", "full")], "claim string, contrast string, gate string, scope string")
    contrasts = spark.createDataFrame([("x", "support"), ("y", "negative"), ("z", "inconclusive")], "contrast string, decision string")
    gates = spark.createDataFrame([("g", True), ("h", False)], "gate string, open boolean")
    assert rows(records.claim_status(claims, contrasts, gates), "claim", "status") == [("a", "supported"), ("b", "limited"), ("c", "negative"), ("d", "removed"), ("e", "limited")]
    parts = spark.createDataFrame([("a", "a"), ("b", "a"), ("c", "c"), ("d", "d")], "g string, component string")
    near = spark.createDataFrame([("a", "b", 1), ("b", "c", 2), ("a", "c", 3), ("c", "d", 4)], "left_id string, right_id string, distance int")
    assert rows(dedup.spanning_edges(near, parts, "g"), "left_id", "right_id", "distance") == [("b", "c", 2), ("c", "d", 4)]


def test_images(spark):
    from plumbline.functions import images

    d = images.dct_matrix(32)
    assert np.allclose(d @ d.T, np.eye(32))
    rng = np.random.default_rng(1)
    picture = np.cumsum(rng.normal(size=(32, 32)), axis=1)
    h = images.perceptual_hash(picture)
    assert h == images.perceptual_hash(picture * 3 + 7) or (h ^ images.perceptual_hash(picture * 3 + 7)).bit_count() <= 1
    got = spark.createDataFrame([(picture.reshape(-1).tolist(),), ([1.0],), (None,)], "p array<double>").select(images.perceptual_hashes("p").alias("h")).collect()
    assert [None if r.h is None else r.h & (1 << 64) - 1 for r in got] == [h, None, None]
    clear = np.full((24, 24), 0.2)
    misty = images.fog(clear, 0.5, seed=3)
    assert np.array_equal(misty, images.fog(clear, 0.5, seed=3)) and abs(misty.mean() - (0.1 + 0.45)) < 0.02 and misty.std() > 0


def test_policy_totals_are_sums_of_evaluated_episodes(spark):
    """A grid in one pass over steps gives what each policy by itself gives; gaps, abstention and null steps among them."""
    from plumbline.operators import episodes, events

    made = [(e, s, None if (e * 7 + s) % 13 == 0 else ((e * 37 + s * 53) % 97) / 97.0, (e + s // 3) % 3 == 0) for e in range(12) for s in range(40) if (e + s) % 11]
    df = spark.createDataFrame(made, "e long, s long, p double, t boolean")
    grid = episodes.policy_grid()[::29]
    got = episodes.policy_totals(df, ["e"], "s", "p", F.col("t"), F.col("e") % 2, grid)
    each = None
    for g in grid:
        policy = episodes.Policy(g["beta"], g["k"], g["low"], g["high"], g["alarm"])
        states = episodes.policy_states(df, ["e"], "s", "p", F.abs(2 * F.col("p") - 1) < g["abstention"], policy)
        one = events.episode_evaluation(states.join(df.select("e", "s", F.col("t").cast("int").alias("t")), ["e", "s"]), ["e"], "s", "t", "state").withColumn("candidate_id", F.lit(g["candidate_id"]))
        each = one if each is None else each.unionByName(one)
    names = [t for t in episodes.TOTALS if t != "episodes"]
    want = each.groupBy("candidate_id", (F.col("e") % 2).alias("concept")).agg(*(F.coalesce(F.sum(t), F.lit(0)).alias(t) for t in names), F.count("*").alias("episodes"))
    rows = lambda d: sorted(tuple(map(float, r[2:])) + (r[0], r[1]) for r in d.select("candidate_id", "concept", *episodes.TOTALS).collect())
    assert rows(got) == rows(want)
    assert sum(r[2] for r in rows(got)) > 0


def test_keys_of_hamming_pairs_tell_ramps_apart():
    rng = random.Random(5)
    bits = {sum(1 << i for i in range(64) if any((i - a) % 64 < n for a, n in arcs)) for arcs in ([(rng.randrange(64), rng.randint(3, 12)) for _ in range(4)] for _ in range(2000))}
    met = sum(n * (n - 1) // 2 for mask in dedup._masks(4) for n in Counter(b & mask for b in bits).values())
    assert met < 0.02 * len(bits) * (len(bits) - 1) / 2  # bands of neighbouring bits let a third and more of all pairs meet


@pytest.mark.parametrize("rows_a_task", [1 << 20, 20])
def test_candidates_equal_an_evaluation_a_threshold(spark, monkeypatch, rows_a_task):
    monkeypatch.setattr("plumbline.operators.scans.ROWS", rows_a_task)
    rng, marks = random.Random(8), [0.5, 0.1]
    points = [("f", u, rng.randint(0, 60), rng.random() * 1.4, round(rng.random(), 1)) for u in ("a", "b", "c") for _ in range(25)] + [("f", "d", 3, 0.0, 0.9), ("f", None, 3, 2.0, 0.9), ("f", "a", 7, 2.0, None)]
    df = spark.createDataFrame(points, "fam string, unit string, t long, v double, s double")
    got = {r.threshold: r for r in events.threshold_candidates(df, ["unit"], "fam", "t", "v", "s", 1.0, 1, 4, 60, thresholds=marks).collect()}
    assert set(got) == set(marks)
    for t in marks:
        per = events.sensor_evaluation(df.where("unit is not null"), ["unit"], "t", "v", "s", 1.0, t, 1, 4, 60).collect()
        f1 = [r.f1 for r in per if r.f1 is not None]
        assert math.isclose(got[t].false_alarms_per_hour, sum(r.predictions - r.matched for r in per) / sum(r.hours for r in per))
        assert math.isclose(got[t].event_macro_f1, sum(f1) / len(f1)) and math.isclose(got[t].event_miss_rate, 1 - sum(r.matched for r in per) / sum(r.truths for r in per))


def test_one_walk_matches_the_events_of_many_rules(spark):
    rng = random.Random(9)
    truth = [(u, k, a, a + rng.randint(0, 6)) for u in range(4) for k, a in enumerate(range(0, 80, 10))]
    told = [(u, t, t, rng.randrange(1, 1 << 5) << 57) for u in range(4) for t in sorted(rng.sample(range(90), 30))]
    schema = "unit int, event_id int, start int, end int"
    true = spark.createDataFrame(truth, schema)
    pairs = events.eligible_pairs(true, spark.createDataFrame(told, "unit int, event_id int, start int, marks long"), ["unit"], 5, also=["marks"])
    got = events._matched(pairs, ["unit"]).collect()
    for i in range(57, 62):
        each = spark.createDataFrame([(u, k, a, a) for u, k, a, m in told if m >> i & 1], schema)
        assert sorted((r.unit, r.truth_id, r.pred_id) for r in got if r.marks >> i & 1) == rows(events.match_events(true, each, ["unit"], 5), "unit", "truth_id", "pred_id")


def test_selection_makes_its_candidates_once(spark):
    made = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            made.add(batch.num_rows)
            yield batch

    given = spark.createDataFrame([("f", f"c{i}", i / 10, float(i), 0.5, 0.1) for i in range(5)], "family_id string, candidate_id string, threshold double, false_alarms_per_hour double, event_macro_f1 double, event_miss_rate double")
    got = selection.select_threshold(given.mapInArrow(counted, given.schema), ["family_id"], 2.0).collect()
    assert [tuple(r) for r in got] == [("f", "pass", "c2", "c0")] and made.value == 5
