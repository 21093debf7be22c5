"""Queries over the events table: series, windows, events and thresholds."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions import rounded
from plumbline.operators import events as ev
from plumbline.operators import selection, timeseries
from plumbline.plans.catalogue import register
from plumbline.plans.oracles import SUMMARY, greedy, islands
from plumbline.sources.tables import finite, table, with_utc

RISK, ALARM, GAP = 113.285, 90.628, 21600
HISTORY, HORIZON, STRIDE = 86400, 21600, 10800


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = with_utc(finite(table(spark, sf_dir, "events")), "ts")
    return e.select("event_id", "user_id", "event_type", "value", F.unix_timestamp("ts").alias("t"), F.unix_micros("ts").alias("us"))


ISLANDS = """
    e AS (SELECT user_id, epoch_us(ts) AS us, value FROM events),
    f AS (SELECT user_id, us, CASE WHEN coalesce(us - lag(us) OVER (PARTITION BY user_id ORDER BY us) > {gap}000000, true) THEN 1 ELSE 0 END AS o FROM e WHERE value >= {mark}),
    n AS (SELECT user_id, us, CAST(sum(o) OVER (PARTITION BY user_id ORDER BY us RANGE UNBOUNDED PRECEDING) AS BIGINT) AS event_id FROM f),
    i AS (SELECT user_id, event_id, min(us) AS "start", max(us) AS "end", count(*) AS positions FROM n GROUP BY user_id, event_id)
"""


@register(f"WITH {ISLANDS.format(gap=GAP, mark=RISK)} SELECT * FROM i")
def e_event_extraction(spark, sf_dir):
    return ev.extract_events(series(spark, sf_dir), ["user_id"], "us", F.col("value") >= RISK, GAP * 1_000_000)


FLAGSHIP = f"""
    WITH {ISLANDS.format(gap=GAP, mark=RISK)}, {ISLANDS.format(gap=GAP, mark=ALARM).replace("e AS (", "e2 AS (", 1).replace("FROM e ", "FROM e2 ").replace("f AS (", "f2 AS (").replace("FROM f)", "FROM f2)").replace("n AS (", "n2 AS (").replace("FROM n ", "FROM n2 ").replace("i AS (", "i2 AS (")},
    p AS (SELECT i.user_id, i.event_id FROM i JOIN i2 ON i.user_id = i2.user_id AND i2."start" BETWEEN i."start" - {GAP}000000 AND i."end" GROUP BY ALL),
    u AS (SELECT user_id FROM events GROUP BY user_id),
    a AS (SELECT user_id, (SELECT count(*) FROM i WHERE i.user_id = u.user_id) AS truths, (SELECT count(*) FROM i2 WHERE i2.user_id = u.user_id) AS alarms, (SELECT count(*) FROM p WHERE p.user_id = u.user_id) AS anticipated FROM u)
    SELECT user_id, truths, alarms, anticipated, CASE WHEN truths > 0 THEN round(anticipated / CAST(truths AS DOUBLE), 6) END AS recall FROM a
"""


@register(FLAGSHIP)
def e_anticipated_events(spark, sf_dir):
    """Per user: how many risk events had an alarm that began in time."""
    s, key = series(spark, sf_dir), ["user_id"]
    truth = ev.extract_events(s, key, "us", F.col("value") >= RISK, GAP * 1_000_000)
    alarms = ev.extract_events(s, key, "us", F.col("value") >= ALARM, GAP * 1_000_000)
    hit = ev.eligible_pairs(truth, alarms, key, GAP * 1_000_000).select("user_id", "truth_id").distinct()
    out = ev.event_summary(s, truth, alarms, hit, key)
    return out.select("user_id", "truths", F.col("predictions").alias("alarms"), F.col("matched").alias("anticipated"), F.when(F.col("truths") > 0, rounded("recall")).alias("recall"))


MICROS = 1_000_000
#: Events with a score in [0, 1], the median gap of each unit's positions, and its rows.
SENSOR = """
        e AS (SELECT {unit} AS u, epoch_us(ts) AS pos, value, least(1.0::DOUBLE, value / 200) AS score, event_type, user_id FROM events),
        g AS (SELECT u, pos - lag(pos) OVER (PARTITION BY u ORDER BY pos) AS gap FROM e), r AS (SELECT u, coalesce(median(gap), {stride}000000.0) AS reach, count(*) AS n FROM g GROUP BY u),
        s AS (SELECT e.*, reach FROM e JOIN r USING (u))"""


def scored_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series(spark, sf_dir).withColumn("score", F.least(F.lit(1.0), F.col("value") / 200))


@register(f"""
    WITH RECURSIVE {SENSOR.format(unit="user_id", stride=STRIDE)}, {islands("t", "s", f"value >= {RISK}")}, {islands("p", "s", "score >= 0.45")}, {greedy(GAP * MICROS)}, units AS (SELECT u FROM r), {SUMMARY},
    q AS (SELECT u, quantile_cont((ts - ps) / 1e6, 0.25) AS a, quantile_cont((ts - ps) / 1e6, 0.5) AS b, quantile_cont((ts - ps) / 1e6, 0.75) AS z FROM x GROUP BY u)
    SELECT u AS user_id, truths, predictions, matched, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, round(miss_rate, 6) AS miss_rate, round(reach * n / 3.6e9, 6) AS hours,
        round(a, 4) + 0.0 AS lead_p25, round(b, 4) + 0.0 AS lead_p50, round(z, 4) + 0.0 AS lead_p75, round(z - a, 4) + 0.0 AS lead_iqr, round((predictions - matched) / (reach * n / 3.6e9), 6) AS false_alarms_per_hour
    FROM c JOIN r USING (u) LEFT JOIN q USING (u)
""")
def e_greedy_event_matching(spark, sf_dir):
    out = ev.sensor_evaluation(scored_series(spark, sf_dir), ["user_id"], "us", "value", "score", RISK, 0.45, 0, GAP * MICROS, STRIDE * MICROS, MICROS)
    shares, leads = ("precision", "recall", "f1", "miss_rate", "hours", "false_alarms_per_hour"), ("lead_p25", "lead_p50", "lead_p75", "lead_iqr")
    return out.select("user_id", "truths", "predictions", "matched", *(rounded(c).alias(c) for c in shares), *(rounded(c, 4).alias(c) for c in leads))


CANDIDATES = f"""
    WITH RECURSIVE {SENSOR.format(unit="event_type || '/' || user_id", stride=STRIDE)}, h AS (SELECT unnest(range(10, 91, 5)) / 100.0::DOUBLE AS threshold),
    base AS (SELECT u AS v, any_value(event_type) AS family, any_value(reach) AS reach, count(*) AS n FROM s GROUP BY u),
    s2 AS (SELECT u || '@' || threshold AS u, pos, reach FROM s JOIN h ON score >= threshold), {islands("t0", "s", f"value >= {RISK}")},
    t AS (SELECT t0.u || '@' || threshold AS u, k, s, e FROM t0, h), {islands("p", "s2", "true")}, {greedy(GAP * MICROS)},
    units AS (SELECT v || '@' || threshold AS u FROM base, h), {SUMMARY},
    y AS (SELECT family, threshold, c.*, reach * n / 3.6e9 AS hours FROM base, h JOIN c ON c.u = base.v || '@' || h.threshold),
    z AS (
        SELECT printf('%s@%.2f', family, threshold) AS candidate_id, family AS family_id, threshold, sum(predictions - matched) / sum(hours) AS false_alarms_per_hour, avg(f1) AS event_macro_f1,
            1 - sum(matched) / nullif(sum(truths), 0)::DOUBLE AS event_miss_rate FROM y GROUP BY family, threshold
    )
"""


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.threshold_candidates(scored_series(spark, sf_dir), ["user_id"], "event_type", "us", "value", "score", RISK, 0, GAP * MICROS, STRIDE * MICROS, MICROS)


@register(CANDIDATES + "SELECT candidate_id, family_id, threshold, round(false_alarms_per_hour, 6) AS false_alarms_per_hour, round(event_macro_f1, 6) AS event_macro_f1, round(event_miss_rate, 6) AS event_miss_rate FROM z")
def e_threshold_candidates(spark, sf_dir):
    """All five families at the 17 thresholds."""
    out = candidates(spark, sf_dir)
    return out.select("candidate_id", "family_id", "threshold", *(rounded(c).alias(c) for c in ("false_alarms_per_hour", "event_macro_f1", "event_miss_rate")))


#: False alarms per hour that some families can keep to and some cannot.
CAP = 0.0006


@register(CANDIDATES + f""",
    o AS (SELECT *, row_number() OVER (PARTITION BY family_id ORDER BY event_macro_f1 DESC NULLS LAST, event_miss_rate NULLS LAST, threshold DESC, candidate_id) AS k FROM z WHERE false_alarms_per_hour <= {CAP}),
    d AS (SELECT *, row_number() OVER (PARTITION BY family_id ORDER BY false_alarms_per_hour, event_miss_rate NULLS LAST, threshold DESC, candidate_id) AS k FROM z)
    SELECT d.family_id, CASE WHEN o.candidate_id IS NULL THEN 'diagnostic_only_blocked' ELSE 'pass' END AS status, o.candidate_id AS selected, d.candidate_id AS diagnostic FROM d LEFT JOIN o ON o.family_id = d.family_id AND o.k = 1 WHERE d.k = 1
""")
def e_selected_threshold(spark, sf_dir):
    return selection.select_threshold(candidates(spark, sf_dir), ["family_id"], CAP)


RESAMPLED = f"""
    e AS (SELECT user_id, (epoch_us(ts) // 1000000) AS t, value FROM events WHERE isfinite(value)),
    b AS (SELECT user_id, CAST(ceil(t / {STRIDE}.0) * {STRIDE} AS BIGINT) AS grid, max_by(value, (t, value)) AS value FROM e GROUP BY ALL),
    s AS (SELECT user_id, CAST(ceil(min(t) / {STRIDE}.0) AS BIGINT) AS a, CAST(floor(max(t) / {STRIDE}.0) AS BIGINT) AS z FROM e GROUP BY user_id),
    g AS (SELECT user_id, unnest(range(a, z + 1)) * {STRIDE} AS grid FROM s),
    r AS (SELECT user_id, grid, value, value IS NOT NULL AS value_mask FROM g LEFT JOIN b USING (user_id, grid))
"""


@register(f"WITH {RESAMPLED} SELECT * FROM r")
def e_causal_resample(spark, sf_dir):
    return timeseries.causal_resample(series(spark, sf_dir), "user_id", "t", ["value"], STRIDE)


WINDOWS = f"""
    WITH {RESAMPLED},
    h AS (SELECT user_id, grid, count(*) OVER w AS n, list(value) OVER w AS history FROM r WINDOW w AS (PARTITION BY user_id ORDER BY grid ROWS BETWEEN {HISTORY // STRIDE - 1} PRECEDING AND CURRENT ROW)),
    x AS (SELECT h.user_id, h.grid, h.history, max(e.value) AS future_max FROM h JOIN e ON e.user_id = h.user_id AND e.t > h.grid AND e.t <= h.grid + {HORIZON} WHERE n = {HISTORY // STRIDE} GROUP BY ALL)
"""


@register(WINDOWS + f"SELECT sha256('events|' || user_id || '|' || grid) AS window_id, user_id, grid - {HISTORY} AS history_start, grid AS history_end, grid + {HORIZON} AS forecast_end, round(list_sum(history), 4) AS history_sum, len(list_filter(history, lambda v: v IS NOT NULL)) AS observed, future_max, CAST(future_max >= {RISK} AS INTEGER) AS event_truth FROM x")
def e_history_windows(spark, sf_dir):
    w = timeseries.history_windows(series(spark, sf_dir), "events", "user_id", "t", "value", HISTORY, HORIZON, STRIDE, RISK)
    kept = F.filter("history", lambda v: v.isNotNull())
    total = F.when(F.size(kept) > 0, F.round(F.aggregate(kept, F.lit(0.0), lambda a, v: a + v), 4))
    return w.select("window_id", "user_id", "history_start", "history_end", "forecast_end", total.alias("history_sum"), F.size(kept).cast("long").alias("observed"), "future_max", "event_truth")


def _slope_sql(k: int) -> str:
    """Least-squares slope of the last k cells over their places, missing ones left out."""
    at = f"list_filter(range(1, {k + 1}), lambda i: history[-{k}:][i] IS NOT NULL)"
    total = lambda x: f"list_sum(list_transform({at}, lambda i: {x}))"
    cell = f"history[-{k}:][i]"
    return f"(len({at}) * {total(f'i * {cell}')} - {total('i')} * {total(cell)}) / (len({at}) * {total('i * i')} - {total('i')} * {total('i')})"


def _statistics_sql(k: int, span: int) -> str:
    part = f"list_filter(history[-{k}:], lambda v: v IS NOT NULL)"
    return ", ".join([
        f"round(list_min({part}), 4) AS min_{span}", f"round(list_max({part}), 4) AS max_{span}", f"round(list_avg({part}), 4) AS mean_{span}", f"round(list_stddev_pop({part}), 3) AS std_{span}",
        f"round(list_aggregate({part}, 'quantile_cont', 0.25), 4) AS q25_{span}", f"round(list_median({part}), 4) AS median_{span}", f"round(list_aggregate({part}, 'quantile_cont', 0.75), 4) AS q75_{span}",
        f"round(CASE WHEN len({part}) < 2 THEN 0.0 ELSE {_slope_sql(k)} END, 4) + 0.0 AS slope_{span}",
        f"round({part}[-1], 4) AS last_{span}", f"round(1 - len({part}) / {k}.0, 6) AS missing_{span}",
    ])


@register(WINDOWS + f"SELECT sha256('events|' || user_id || '|' || grid) AS window_id, {_statistics_sql(2, 2 * STRIDE)}, {_statistics_sql(4, 4 * STRIDE)}, {_statistics_sql(8, 8 * STRIDE)} FROM x")
def e_causal_statistics(spark, sf_dir):
    w = timeseries.history_windows(series(spark, sf_dir), "events", "user_id", "t", "value", HISTORY, HORIZON, STRIDE, RISK)
    out = timeseries.causal_statistics(w, "window_id", "history", STRIDE, (2 * STRIDE, 4 * STRIDE, 8 * STRIDE))
    digits = lambda c: 3 if c.startswith("std") else 6 if c.startswith("missing") else 4
    return out.select("window_id", *((F.round(c, digits(c)) + F.lit(0.0)).alias(c) for c in out.columns if c != "window_id"))


@register(f"SELECT event_id, count(value) OVER w AS future_n, max(value) OVER w AS future_max FROM (SELECT *, (epoch_us(ts) // 1000000) AS t FROM events) WINDOW w AS (PARTITION BY user_id ORDER BY t RANGE BETWEEN 1 FOLLOWING AND {HORIZON} FOLLOWING)")
def j_future_window(spark, sf_dir):
    return timeseries.future_window(series(spark, sf_dir), "user_id", "t", "value", HORIZON).select("event_id", "future_n", "future_max")


@register("""
    WITH a AS (SELECT user_id, (epoch_us(ts) // 1000000) AS t, event_id FROM events WHERE event_type = 'purchase'), b AS (SELECT user_id, (epoch_us(ts) // 1000000) AS t, event_id AS view_id FROM events WHERE event_type = 'view')
    SELECT a.event_id, b.view_id FROM a ASOF LEFT JOIN b ON a.user_id = b.user_id AND a.t >= b.t
""")
def j_as_of(spark, sf_dir):
    from plumbline.operators.asof import as_of_join

    s = series(spark, sf_dir)
    left = s.where("event_type = 'purchase'").select("user_id", "t", "event_id")
    right = s.where("event_type = 'view'").select("user_id", "t", F.col("event_id").alias("view_id"))
    return as_of_join(left, right, ["user_id"], "t", ["view_id"]).select("event_id", "view_id")
