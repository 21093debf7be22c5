"""Event extraction from flagged positions, one-to-one matching, and event metrics."""
from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.operators.quantiles import exact_quantiles, null_safe_join
from plumbline.operators.scans import in_ranges, running
from plumbline.operators.stash import stash


def extract_events(df: DataFrame, unit: Sequence[str], position: str, flag: Column, continuity: float | Column, merge_gap: float = 0) -> DataFrame:
    """Runs of flagged positions as events (unit, event_id from 1, start, end, positions), both ends included.

    A gap over the larger of `continuity` (a number, or a column that is one number a unit) and `merge_gap`
    begins a new event. Units without a flagged position have no event. Repeated positions count each;
    null flags are false.
    """
    reach = F.greatest(continuity if isinstance(continuity, Column) else F.lit(continuity), F.lit(merge_gap))
    hits, cut = in_ranges(df.where(F.coalesce(flag, F.lit(False))).select(*unit, position, reach.alias("_reach")), unit, [position])
    known = running(hits, unit, [position], {"_before": ("before", F.col(position))}, cut=cut)
    opens = F.coalesce(F.col(position) - F.col("_before") > F.col("_reach"), F.lit(True)).cast("int")
    numbered = running(known.withColumn("_open", opens), unit, [position], {"event_id": ("sum", F.col("_open"))}, cut=cut)
    return numbered.groupBy(*unit, "event_id").agg(F.min(position).alias("start"), F.max(position).alias("end"), F.count("*").alias("positions"))


def unit_continuity(df: DataFrame, unit: Sequence[str], position: str, otherwise: float) -> DataFrame:
    """(unit, continuity, n): the median gap between neighbouring positions (`otherwise` with one row), and the rows."""
    rows, cut = in_ranges(df.select(*unit, F.col(position).alias("_at")), unit, ["_at"])
    gaps = running(rows, unit, ["_at"], {"_before": ("before", F.col("_at"))}, cut=cut)
    gaps = gaps.select(*unit, (F.col("_at") - F.col("_before")).cast("double").alias("_gap"))
    if cut:
        middle = exact_quantiles(gaps, unit, "_gap", {"continuity": 0.5}).fillna(float(otherwise), ["continuity"])
        return null_safe_join(middle, gaps.groupBy(*unit).agg(F.count("*").alias("n")), unit)
    # no unit has more rows than a task may sort: its gaps are ranked where its rows are
    gaps = gaps.withColumn("_gap", F.when(~F.isnan("_gap"), F.col("_gap")))
    w = Window.partitionBy(*unit)
    ranked = gaps.select(*unit, "_gap", F.row_number().over(w.orderBy(F.asc_nulls_last("_gap"))).alias("_k"), F.count("_gap").over(w).alias("_m"))
    low, high = (F.max(F.when(F.col("_k") == F.floor((F.col("_m") + k) / 2), F.col("_gap"))) for k in (1, 2))
    return ranked.groupBy(*unit).agg(F.coalesce(F.when(low == high, low).otherwise(0.5 * low + 0.5 * high), F.lit(float(otherwise))).alias("continuity"), F.count("*").alias("n"))


def eligible_pairs(truth: DataFrame, predicted: DataFrame, unit: Sequence[str], lookback: float, width: float | None = None, also: Sequence[str] = ()) -> DataFrame:
    """Pairs of a unit in which the prediction starts within [truth.start - lookback, truth.end], with the columns `also` of the prediction.

    Both sides meet in buckets of `width` along the positions (the lookback, if there is one), so that a
    unit with very many events is not joined all with all.
    """
    width = width or lookback or 32
    place = lambda c: F.floor(c / width)
    spans = F.sequence(place(F.col("start") - lookback), place(F.col("end")))
    t = truth.select(*unit, F.col("event_id").alias("truth_id"), F.col("start").alias("t_start"), F.col("end").alias("t_end"), F.explode(spans).alias("_bucket"))
    p = predicted.select(*unit, F.col("event_id").alias("pred_id"), F.col("start").alias("p_start"), *also, place(F.col("start")).alias("_bucket"))
    return t.join(p, [*unit, "_bucket"]).where((F.col("p_start") >= F.col("t_start") - lookback) & (F.col("p_start") <= F.col("t_end"))).drop("_bucket")


def match_events(truth: DataFrame, predicted: DataFrame, unit: Sequence[str], lookback: float) -> DataFrame:
    """Greedy one-to-one matching: (unit, truth_id, pred_id, lead).

    Predictions by start, then id, each take the eligible unmatched truth that ends first (then the
    smaller id). The choice depends on all before it, so a unit's eligible pairs are walked in order: they
    stream through a sorted partition, and of the open unit only the truths taken that have not ended
    before the current prediction are kept.
    """
    return _matched(eligible_pairs(truth, predicted.withColumn("marks", F.lit(1).cast("long")), unit, lookback, also=["marks"]), unit).drop("marks")


def _matched(pairs: DataFrame, unit: Sequence[str]) -> DataFrame:
    """The walk of `match_events` for many rules at once: (unit, truth_id, pred_id, lead, marks).

    The bits of `marks` tell for which rules there is such a prediction, and in the result those whose
    match it is. The predictions of a rule in a unit have different ids.
    """
    pairs = pairs.select(*unit, "p_start", "pred_id", "t_end", "truth_id", "t_start", "marks")
    n = len(unit)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, last, done, taken = None, None, 0, {}
        for batch in batches:
            keep, marks, columns = [], [], [c.to_pylist() for c in batch.columns]
            for i, now in enumerate(zip(*columns[:n], strict=True)):
                if now != key:
                    key, last, taken = now, None, {}
                pred, true = columns[n + 1][i], columns[n + 3][i]
                if pred != last:  # a prediction's pairs follow each other
                    last, done = pred, 0
                end, by = taken.get(true, (columns[n + 2][i], 0))
                if free := columns[n + 5][i] & ~done & ~by:
                    done |= free
                    taken[true] = end, by | free
                    keep.append(i)
                    marks.append(free)
                    if len(taken) > 1024:
                        taken = {k: held for k, held in taken.items() if held[0] >= columns[n][i]}
            found = batch.take(pa.array(keep, pa.int64()))
            lead = pa.array([float(columns[n + 4][i] - columns[n][i]) for i in keep], pa.float64())
            yield pa.RecordBatch.from_arrays([*(found.column(k) for k in range(n)), found.column(n + 3), found.column(n + 1), lead, pa.array(marks, pa.int64())], names=[*unit, "truth_id", "pred_id", "lead", "marks"])

    kinds = dict(pairs.dtypes)
    schema = ", ".join([*(f"`{u}` {kinds[u]}" for u in unit), f"truth_id {kinds['truth_id']}", f"pred_id {kinds['pred_id']}", "lead double", "marks long"])
    return pairs.repartition(*unit).sortWithinPartitions(*unit, "p_start", "pred_id", "t_end", "truth_id").mapInArrow(walk, schema)


def event_summary(units: DataFrame, truth: DataFrame, predicted: DataFrame, matched: DataFrame, unit: Sequence[str]) -> DataFrame:
    """Per unit: truths, predictions, matches, precision, recall, F1, miss rate.

    Without truths, recall, F1 and miss rate are null, and so is precision without predictions; with
    truths and no prediction, precision and F1 are 0. F1 is 2 * matched / (truths + predictions).
    """
    count = lambda df, name: df.groupBy(*unit).agg(F.count("*").alias(name))
    out = units.select(*unit).distinct()
    for df, name in ((truth, "truths"), (predicted, "predictions"), (matched, "matched")):
        out = out.join(count(df, name), list(unit), "left").fillna(0, [name])
    t, p, m = F.col("truths"), F.col("predictions"), F.col("matched")
    return out.select(
        *unit, "truths", "predictions", "matched", F.coalesce(F.try_divide(m, p), F.when(t > 0, 0.0)).alias("precision"), F.try_divide(m, t).alias("recall"),
        F.when(t > 0, F.try_divide(2 * m, t + p)).alias("f1"), F.when(t > 0, 1 - F.try_divide(m, t)).alias("miss_rate"),
    )


def sensor_evaluation(df: DataFrame, unit: Sequence[str], position: str, value: str, score: str, risk: float, threshold: float, merge_gap: float, horizon: float, stride: float, ticks: float = 1) -> DataFrame:
    """Event metrics of a score against a risk value per unit: lead times in seconds, false alarms per hour.

    A unit's events run on over gaps up to its median gap between positions (`stride` with one position).
    Its exposure is that gap times its positions. `ticks` positions are a second; `merge_gap`, `horizon`
    and `stride` are in positions.
    """
    known = unit_continuity(df, unit, position, stride)
    rows = df.select(*unit, position, F.col(value).alias("_value"), F.col(score).alias("_score")).join(known, list(unit))
    truth = extract_events(rows, unit, position, F.col("_value") >= risk, F.col("continuity"), merge_gap)
    predicted = extract_events(rows, unit, position, F.col("_score") >= threshold, F.col("continuity"), merge_gap)
    matched = match_events(truth, predicted, unit, horizon)
    at = lambda q: F.percentile(F.col("lead") / ticks, q)
    lead = matched.groupBy(*unit).agg(at(0.25).alias("lead_p25"), at(0.5).alias("lead_p50"), at(0.75).alias("lead_p75"))
    hours = known.select(*unit, (F.col("continuity") * F.col("n") / (3600.0 * ticks)).alias("hours"))
    out = event_summary(df, truth, predicted, matched, unit).join(hours, list(unit)).join(lead, list(unit), "left")
    return out.withColumn("lead_iqr", F.col("lead_p75") - F.col("lead_p25")).withColumn("false_alarms_per_hour", F.try_divide(F.col("predictions") - F.col("matched"), F.col("hours")))


POSITIVE = ("prewarning", "alarm")


def episode_evaluation(df: DataFrame, episode: Sequence[str], step: str, truth: str, state: str) -> DataFrame:
    """Event metrics of a state sequence per episode: steps one apart are continuous, nothing looks back.

    Abstention breaks an event and counts against coverage. A flip is any change of state from a row to
    the next. Delays are steps from a truth's start to the prediction's; `delay_total` adds them up.
    """
    positive = F.col(state).isin(*POSITIVE)
    true = extract_events(df, episode, step, F.col(truth) == 1, 1)
    told = extract_events(df, episode, step, positive, 1)
    matched = match_events(true, told, episode, 0)
    before = F.lag(state).over(Window.partitionBy(*episode).orderBy(step))
    marked = df.withColumn("_flip", F.coalesce(before != F.col(state), F.lit(False)))
    shape = marked.groupBy(*episode).agg(F.count_if(F.col(state) != "abstain").alias("answered"), F.count_if("_flip").alias("flips"), F.count("*").alias("steps"))
    delay = matched.groupBy(*episode).agg(F.sum(-F.col("lead")).alias("delay_total"))
    out = event_summary(df, true, told, matched, episode).join(shape, list(episode)).join(delay, list(episode), "left")
    return out.withColumn("coverage", F.col("answered") / F.col("steps")).withColumn("mean_delay", F.try_divide("delay_total", "matched"))


def policy_metrics(episodes: DataFrame, policy: Sequence[str], concept: str, slowest: float = 32.0) -> DataFrame:
    """Per policy, from evaluated episodes: coverage, false alarms, miss rate, delay and flips pooled over all, F1 the mean of concepts'.

    Without truths the miss rate is 0, without an eligible concept F1 is 0, without a match the delay is `slowest`.
    """
    sums = [F.sum(c).alias(c) for c in ("truths", "predictions", "matched", "answered", "steps", "flips", "delay_total")]
    return pooled_metrics(episodes.groupBy(*policy, concept).agg(*sums, F.count("*").alias("episodes")), policy, slowest)


def pooled_metrics(per: DataFrame, policy: Sequence[str], slowest: float = 32.0) -> DataFrame:
    """The metrics of `policy_metrics` from sums by policy and concept (`episodes.TOTALS`)."""
    of = {c: F.sum(c) for c in ("truths", "predictions", "matched", "answered", "steps", "flips", "delay_total", "episodes")}
    f1 = F.when(F.col("truths") > 0, 2 * F.col("matched") / (F.col("truths") + F.col("predictions")))
    return per.groupBy(*policy).agg(
        (of["answered"] / of["steps"]).alias("answer_coverage"), (100 * (of["predictions"] - of["matched"]) / of["episodes"]).alias("false_alarms_per_100_episodes"),
        F.coalesce(1 - F.try_divide(of["matched"], of["truths"]), F.lit(0.0)).alias("event_miss_rate"), F.coalesce(F.avg(f1), F.lit(0.0)).alias("event_macro_f1"),
        F.coalesce(F.try_divide(of["delay_total"], of["matched"]), F.lit(slowest)).alias("mean_detection_delay_steps"), (of["flips"] / of["episodes"]).alias("mean_state_flips_per_episode"),
    )


# The grid of score thresholds, in hundredths.
THRESHOLDS = tuple(k / 100 for k in range(10, 91, 5))


def threshold_candidates(df: DataFrame, unit: Sequence[str], family: str, position: str, value: str, score: str, risk: float, merge_gap: float, horizon: float, stride: float, ticks: float = 1, thresholds: Sequence[float] = THRESHOLDS) -> DataFrame:
    """One row per family and threshold: false alarms per hour, macro F1, miss rate, pooled over units.

    Continuity and exposure are those of `sensor_evaluation`. All thresholds go through the rows at once: one
    scan finds for each row the thresholds at which it begins an event, as the bits of a long, and one walk
    matches the events of all. What a unit has at a threshold is a count.
    """
    if len(thresholds) > 62:  # bits of a long
        parts = (threshold_candidates(df, unit, family, position, value, score, risk, merge_gap, horizon, stride, ticks, thresholds[i : i + 62]) for i in range(0, len(thresholds), 62))
        return reduce(DataFrame.unionByName, parts)
    key = [family, *unit]
    known = stash(unit_continuity(df, key, position, stride).where(reduce(lambda a, b: a & b, (F.col(k).isNotNull() for k in key))), "continuity")
    rows = df.select(*key, position, F.col(value).alias("_value"), F.col(score).alias("_score")).join(known, key)
    truth = extract_events(rows, key, position, F.col("_value") >= risk, F.col("continuity"), merge_gap)
    flagged, cut = in_ranges(rows.where(F.col("_score") >= min(thresholds)).select(*key, position, "_score", F.greatest("continuity", F.lit(merge_gap)).alias("_reach")), key, [position])
    before = running(flagged, key, [position], {f"_before{i}": ("last_before", F.when(F.col("_score") >= t, F.col(position))) for i, t in enumerate(thresholds)}, cut=cut)
    opens = [F.when((F.col("_score") >= t) & F.coalesce(F.col(position) - F.col(f"_before{i}") > F.col("_reach"), F.lit(True)), F.lit(1 << i).cast("long")).otherwise(F.lit(0).cast("long")) for i, t in enumerate(thresholds)]
    told = before.select(*key, F.col(position).alias("event_id"), F.col(position).alias("start"), reduce(lambda a, b: a.bitwiseOR(b), opens).alias("marks")).where("marks <> 0")
    told = stash(told, "openings")
    matched = _matched(eligible_pairs(truth, told, key, horizon, also=["marks"]), key)
    each = lambda name: F.array(*(F.sum(F.shiftright("marks", i).bitwiseAND(F.lit(1).cast("long"))) for i in range(len(thresholds)))).alias(name)
    per = known.join(truth.groupBy(*key).agg(F.count("*").alias("truths")), key, "left").fillna(0, ["truths"])
    none = F.array_repeat(F.lit(0).cast("long"), len(thresholds))
    for rows_, name in ((told, "predictions"), (matched, "matched")):
        per = per.join(rows_.groupBy(*key).agg(each(name)), key, "left").withColumn(name, F.coalesce(name, none))
    per = per.withColumn("hours", F.col("continuity") * F.col("n") / (3600.0 * ticks)).withColumn("threshold", F.array(*map(F.lit, thresholds)))
    per = per.select(family, "truths", "hours", F.inline(F.arrays_zip("threshold", "predictions", "matched")))
    f1 = F.when(F.col("truths") > 0, F.try_divide(2 * F.col("matched"), F.col("truths") + F.col("predictions")))
    return per.groupBy(family, "threshold").agg(
        F.try_divide(F.sum(F.col("predictions") - F.col("matched")), F.sum("hours")).alias("false_alarms_per_hour"), F.avg(f1).alias("event_macro_f1"),
        (1 - F.try_divide(F.sum("matched"), F.sum("truths"))).alias("event_miss_rate"),
    ).select(F.format_string("%s@%.2f", F.col(family), F.col("threshold")).alias("candidate_id"), F.col(family).alias("family_id"), "threshold", "false_alarms_per_hour", "event_macro_f1", "event_miss_rate")
