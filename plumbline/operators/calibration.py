"""Calibrations of many keys at once (a key is a concept, say): every fit of every key in the same few aggregations.

A table of rows (key, p, y) gives a table of parameters, a row a key, or of knots. Grids and Newton
steps are one grouped aggregation a round for all keys; isotonic blocks are pooled by key within ranges,
then across them. Nothing is collected on the driver but whether the fits have settled.
"""
from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions import clipped_logit, logistic
from plumbline.operators.models import METHODS, STRIDE, group_folds
from plumbline.operators.quantiles import null_safe_join
from plumbline.operators.scans import in_ranges, running
from plumbline.operators.stash import stash


#: Newton steps that one job takes.
STEPS = 5


def _rows(df: DataFrame, key: Sequence[str], p: str, y: str) -> DataFrame:
    """(key, _p, _y) of the rows that can be fitted: a score and a label that are there."""
    return df.select(*key, F.col(p).cast("double").alias("_p"), F.col(y).cast("double").alias("_y")).where("_p is not null and not isnan(_p) and _y is not null")


def fit_temperatures(df: DataFrame, key: Sequence[str], p: str, y: str, low: float = -5.0, high: float = 5.0, rounds: int = 6, points: int = 17) -> DataFrame:
    """(key, temperature): per key the temperature of least loss, by a grid of log T that is narrowed around its best point round by round.

    Keys without a row that can be fitted are not there.
    """
    rows = stash(_rows(df, key, p, y).select(*key, clipped_logit(F.col("_p")).alias("_z"), "_y"), "logits")
    held = rows.select(*key).distinct().select(*key, F.lit(low).alias("_a"), F.lit(high).alias("_b"))
    place = lambda i: F.col("_a") + (F.col("_b") - F.col("_a")) * i / (points - 1)
    for _ in range(rounds):
        scaled = null_safe_join(rows, held, key)
        loss = lambda z: F.avg(F.log1p(F.exp(-F.abs(z))) + F.greatest(z, F.lit(0.0)) - F.col("_y") * z)
        losses = scaled.groupBy(*key, "_a", "_b").agg(F.array(*(loss(F.col("_z") / F.exp(place(i))) for i in range(points))).alias("_l"))
        best = F.array_position("_l", F.array_min("_l")).cast("int") - 1
        held = losses.select(*key, place(F.greatest(F.lit(0), best - 1)).alias("_a"), place(F.least(F.lit(points - 1), best + 1)).alias("_b"))
    return held.select(*key, F.exp((F.col("_a") + F.col("_b")) / 2).alias("temperature"))


def fit_platts(df: DataFrame, key: Sequence[str], p: str, y: str, l2: float = 1.0, rounds: int = 25) -> DataFrame:
    """(key, slope, intercept): per key a logistic regression on logits with an L2 penalty of l2 / 2 on the slope, by Newton steps.

    A key with one class only has no best intercept; it keeps slope 1 and intercept 0.
    """
    rows = stash(_rows(df, key, p, y).select(*key, clipped_logit(F.col("_p")).alias("_z"), "_y"), "logits")
    fits = rows.groupBy(*key).agg(F.lit(1.0).alias("slope"), F.lit(0.0).alias("intercept"), (F.min("_y") == F.max("_y")).alias("_done"))

    def step(fits: DataFrame) -> DataFrame:
        """One Newton step of the keys that have not settled."""
        met = null_safe_join(rows, fits, key)
        q = logistic(F.col("slope") * F.col("_z") + F.col("intercept"))
        w = q * (1 - q)
        sums = {"ga": (q - F.col("_y")) * F.col("_z"), "gb": q - F.col("_y"), "haa": w * F.col("_z") * F.col("_z"), "hab": w * F.col("_z"), "hbb": w}
        s = met.groupBy(*key, "slope", "intercept", "_done").agg(*(F.sum(c).alias(n) for n, c in sums.items()))
        ga, haa = F.col("ga") + l2 * F.col("slope"), F.col("haa") + l2
        det = haa * F.col("hbb") - F.col("hab") * F.col("hab")
        da = F.when(F.col("_done"), 0.0).otherwise(F.coalesce(F.try_divide(F.col("hbb") * ga - F.col("hab") * F.col("gb"), det), F.lit(0.0)))
        db = F.when(F.col("_done"), 0.0).otherwise(F.coalesce(F.try_divide(haa * F.col("gb") - F.col("hab") * ga, det), F.lit(0.0)))
        part = F.least(F.lit(1.0), F.lit(STRIDE) / F.greatest(F.abs(da) + F.abs(db), F.lit(1e-300)))
        return s.select(*key, (F.col("slope") - part * da).alias("slope"), (F.col("intercept") - part * db).alias("intercept"), (F.abs(da) + F.abs(db) < 1e-10).alias("_done"))

    for _ in range(-(-rounds // STEPS)):
        for _ in range(STEPS):
            fits = step(fits)
        fits = stash(fits, "platt")
        if fits.where("not _done").isEmpty():
            break
    return fits.drop("_done")


def _pooled(keys: int, schema: pa.Schema):
    """Adjacent violators of blocks (key, total, n, low, high), sorted by key and low, pooled; one key's blocks are held at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, blocks, done = None, [], []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                key, (total, n, low, high) = row[:keys], row[keys:]
                if key != now:
                    done += [(*now, *b) for b in blocks] if now is not None else []
                    now, blocks = key, []
                while blocks and blocks[-1][0] * n >= total * blocks[-1][1]:
                    total, n, low = blocks[-1][0] + total, blocks[-1][1] + n, blocks[-1][2]
                    blocks.pop()
                blocks.append((total, n, low, high))
            if len(done) > 1 << 14:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done, strict=True), schema, strict=True)], schema=schema)
                done = []
        done += [(*now, *b) for b in blocks] if now is not None else []
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done, strict=True), schema, strict=True)], schema=schema)

    return run


def fit_isotonics(df: DataFrame, key: Sequence[str], p: str, y: str) -> DataFrame:
    """(key, x, value): knots of the non-decreasing least-squares fit of each key; equal scores are one point of weight.

    Blocks are pooled within ranges of (key, score), which spread a large key over many tasks, and what is
    left of a key across its ranges; pooling is associative, so the fit is the same.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    names = [f"_k{i}" for i in range(len(key))]
    points = _rows(df, key, p, y).groupBy(*key, "_p").agg(F.sum("_y").alias("total"), F.count("*").alias("n"))
    points = points.select(*(F.col(k).alias(n) for k, n in zip(key, names, strict=True)), "total", "n", F.col("_p").alias("low"), F.col("_p").alias("high"))
    run = _pooled(len(key), to_arrow_schema(points.schema))
    local = points.repartitionByRange(*names, "low").sortWithinPartitions(*names, "low").mapInArrow(run, points.schema)
    blocks = (local.repartition(*names) if names else local.repartition(1)).sortWithinPartitions(*names, "low").mapInArrow(run, points.schema)
    ends = F.explode(F.array_distinct(F.array("low", "high"))).alias("x")
    return blocks.select(*(F.col(n).alias(k) for k, n in zip(key, names, strict=True)), ends, (F.col("total") / F.col("n")).alias("value"))


def interpolated(df: DataFrame, key: Sequence[str], p: str, knots: DataFrame, name: str) -> DataFrame:
    """`df` with `name`: `p` taken through its key's knots (key, x, value), linear between and constant beyond them; null for a null p, NaN or a key without knots.

    Rows and knots stand on one line per key; the knot before and the one after are carried along it both
    ways, so the knots are neither collected nor broadcast.
    """
    at = F.col(p).cast("double")
    rows = df.withColumn("_at", F.when(~F.isnan(at), at)).withColumn("_kind", F.lit(1)).withColumn("_row", F.monotonically_increasing_id())
    marks = knots.select(*key, F.col("x").alias("_at"), F.lit(0).alias("_kind"), F.struct(F.col("x"), F.col("value")).alias("_knot"))
    line, cut = in_ranges(rows.unionByName(marks, allowMissingColumns=True), key, ["_at", "_kind"])
    both = running(line, key, ["_at", "_kind"], {"_below": ("last", F.col("_knot"))}, cut=cut)
    both = running(both, key, ["_at", "_kind"], {"_above": ("last", F.col("_knot"))}, reverse=True, cut=cut).where("_kind = 1")
    x0, y0, x1, y1 = (F.col(c) for c in ("_below.x", "_below.value", "_above.x", "_above.value"))
    inner = F.when(x0.isNull(), y1).when(x1.isNull() | (x0 == F.col("_at")), y0).otherwise(y0 + (y1 - y0) * F.try_divide(F.col("_at") - x0, x1 - x0))
    value = F.when(F.col("_at").isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), inner)))
    return both.withColumn(name, value).select(*df.columns, name)


def calibrated(df: DataFrame, key: Sequence[str], p: str, fits: DataFrame, knots: DataFrame) -> DataFrame:
    """`df` with a column for each of METHODS: p under each calibration of its key; null where the key has no fit."""
    met = null_safe_join(df, fits.select(*key, "temperature", "slope", "intercept"), key, "left")
    there = F.col(p).isNotNull() & ~F.isnan(F.col(p).cast("double"))
    z = F.when(there, clipped_logit(F.col(p)))
    met = met.withColumn("temperature", F.when(there, logistic(z / F.col("temperature")))).withColumn("platt", F.when(there & F.col("slope").isNotNull(), logistic(F.col("slope") * z + F.col("intercept")))).drop("slope", "intercept")
    return interpolated(met, key, p, knots, "isotonic").select(*df.columns, *METHODS)


def fit_all(df: DataFrame, key: Sequence[str], p: str, y: str) -> tuple[DataFrame, DataFrame]:
    """(fits, knots): the parameters of every method for every key, and the isotonic knots, as written tables."""
    fits = null_safe_join(fit_temperatures(df, key, p, y), fit_platts(df, key, p, y), key)
    return stash(fits, "fits"), stash(fit_isotonics(df, key, p, y), "knots")


def choose_calibrators(df: DataFrame, key: Sequence[str], p: str, y: str, group: str, folds: int = 3, seed: int = 13007) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(choice, fits, knots): for each key the method with the least mean Brier score over folds of whole groups, and all methods fitted on all rows.

    choice: (key, method, brier of every method, selected), ties to the earlier method. The folds of all
    keys are those of the whole table's groups; a fold that a key has no rows in does not count for it.
    """
    known = _rows(df.withColumn("_group", F.col(group)), [*key, "_group"], p, y)
    rows = stash(null_safe_join(known, group_folds(known, "_group", folds, seed).select("_group", "fold"), ["_group"]).select(*key, "_p", "_y", "fold"), "fold-rows")
    others = F.explode(F.filter(F.array(*map(F.lit, range(-1, folds))), lambda f: f != F.col("fold"))).alias("_held")  # -1: no fold is held out
    fits, knots = fit_all(rows.select(*key, "_p", "_y", others), [*key, "_held"], "_p", "_y")
    told = calibrated(rows.select(*key, "_p", "_y", F.col("fold").alias("_held")), [*key, "_held"], "_p", fits, knots)
    per = told.groupBy(*key, "_held").agg(*(F.avg(F.pow(F.col(m) - F.col("_y"), 2)).alias(m) for m in METHODS))
    means = per.groupBy(*key).agg(*(F.avg(m).alias(m) for m in METHODS))
    losses = F.array(*(F.col(m) for m in METHODS))
    best = F.element_at(F.array(*map(F.lit, METHODS)), F.array_position(losses, F.array_min(losses)).cast("int"))
    long = means.withColumn("_best", best).select(*key, "_best", F.explode(F.array(*(F.struct(F.lit(m).alias("method"), F.col(m).alias("brier")) for m in METHODS))).alias("m"))
    choice = long.select(*key, "m.method", "m.brier", (F.col("m.method") == F.col("_best")).alias("selected"))
    whole = lambda df: df.where("_held = -1").drop("_held")
    return choice, whole(fits), whole(knots)


def calibration_faults(df: DataFrame, record: Sequence[str], key: Sequence[str], p: str, y: str) -> DataFrame:
    """(key, fault, rows): what keeps rows from being calibrated: repeated (record, key), no score, a score outside [0, 1], no label, a label other than 0 and 1, a key of one class, records that a key lacks."""
    score, label = F.col(p).cast("double"), F.col(y).cast("double")
    none = score.isNull() | F.isnan(score)
    marks = {"no_score": none, "score_range": ~none & ((score < 0) | (score > 1)), "no_label": label.isNull(), "label_value": label.isNotNull() & ~label.isin(0.0, 1.0)}
    pairs = df.groupBy(*key, *record).agg(F.count("*").alias("_n"))
    records = df.select(*record).distinct().agg(F.count("*").alias("_records"))
    held = pairs.groupBy(*key).agg(F.sum(F.col("_n") - 1).alias("repeated"), F.count("*").alias("_have")).crossJoin(F.broadcast(records))  # one row
    each = df.groupBy(*key).agg(*(F.count_if(c).alias(n) for n, c in marks.items()), F.when(F.min(label) == F.max(label), F.count("*")).otherwise(0).alias("one_class"))
    met = null_safe_join(held, each, key).withColumn("missing_records", F.col("_records") - F.col("_have"))
    faults = ["repeated", *marks, "one_class", "missing_records"]
    long = met.select(*key, F.explode(F.array(*(F.struct(F.lit(f).alias("fault"), F.col(f).cast("long").alias("rows")) for f in faults))).alias("f"))
    return long.select(*key, "f.fault", "f.rows").where("rows > 0")
