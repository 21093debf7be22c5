"""Small fitted models: persistence rule, calibrations, group folds, fusion losses. Fits are aggregations."""
from __future__ import annotations

import bisect
import math
from collections.abc import Iterator, Sequence
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions import clipped_logit, joined_sha256, logistic
from plumbline.operators.selection import ranked_by_hash
from plumbline.operators.stash import stash


def persistence_scores(windows: DataFrame, history: str, threshold: float, fit: Column) -> DataFrame:
    """`windows` with score = logistic((last value - threshold) / scale).

    The last value is the last one present; without any, the median of the last values of the rows that
    `fit` marks. scale is those values' population deviation, at least 0.001.
    """
    last = F.try_element_at(F.filter(history, lambda x: x.isNotNull()), F.lit(-1))
    stats = windows.where(fit).select(last.alias("x")).agg(F.percentile("x", 0.5).alias("m"), F.stddev_pop("x").alias("s")).first()
    middle, scale = stats.m if stats.m is not None else threshold, max(stats.s or 0.0, 1e-3)
    return windows.withColumn("score", logistic((F.coalesce(last, F.lit(middle)) - threshold) / scale))


def negative_log_likelihood(df: DataFrame, p: str, y: str, temperatures: Sequence[float]) -> list[float]:
    """Mean loss of logit(p) / T for each T, in one pass."""
    z = clipped_logit(F.col(p))
    loss = lambda t: F.avg(F.log1p(F.exp(-F.abs(z / t))) + F.greatest(z / t, F.lit(0.0)) - F.col(y) * z / t)
    row = df.agg(*(loss(t).alias(f"l{i}") for i, t in enumerate(temperatures))).first()
    return [row[i] for i in range(len(temperatures))]


def fit_temperature(df: DataFrame, p: str, y: str, low: float = -5.0, high: float = 5.0, rounds: int = 6, points: int = 17) -> float:
    """The temperature of least loss, log T in [low, high]: a grid in one pass a round, narrowed around its best; 1 without rows."""
    a, z = low, high
    for _ in range(rounds):
        grid = [a + (z - a) * i / (points - 1) for i in range(points)]
        losses = negative_log_likelihood(df, p, y, [math.exp(g) for g in grid])
        if losses[0] is None:
            return 1.0
        best = min(range(points), key=losses.__getitem__)
        a, z = grid[max(0, best - 1)], grid[min(points - 1, best + 1)]
    return math.exp((a + z) / 2)


#: How far a Newton step may go: where nearly all labels are of one class, whole steps overshoot for good.
STRIDE = 2.0


def fit_platt(df: DataFrame, p: str, y: str, l2: float = 1.0, rounds: int = 25) -> tuple[float, float]:
    """(slope, intercept) of a logistic regression on logits: Newton steps, each one aggregation of six sums.

    The slope carries an L2 penalty of l2 / 2; the intercept none, so one class alone has no best
    intercept: then, and without rows, the fit is (1, 0).
    """
    z, a, b = clipped_logit(F.col(p)), 1.0, 0.0
    ends = df.where(F.col(p).isNotNull()).agg(F.min(y).alias("low"), F.max(y).alias("high")).first()
    if ends.low == ends.high:
        return a, b
    for _ in range(rounds):
        q = logistic(F.lit(a) * z + b)
        w = q * (1 - q)
        s = df.agg(F.sum((q - F.col(y)) * z).alias("ga"), F.sum(q - F.col(y)).alias("gb"), F.sum(w * z * z).alias("haa"), F.sum(w * z).alias("hab"), F.sum(w).alias("hbb")).first()
        ga, haa = s.ga + l2 * a, s.haa + l2
        det = haa * s.hbb - s.hab * s.hab
        if not det:
            break
        da, db = (s.hbb * ga - s.hab * s.gb) / det, (haa * s.gb - s.hab * ga) / det
        part = min(1.0, STRIDE / max(abs(da) + abs(db), 1e-300))
        a, b = a - part * da, b - part * db
        if abs(da) + abs(db) < 1e-10:
            break
    return a, b


def _pooled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adjacent violators of blocks (total, n, low, high), which come in order, pooled; the blocks that are left are held."""
    blocks: list[list] = []
    for batch in batches:
        for total, n, low, high in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            while blocks and blocks[-1][0] * n >= total * blocks[-1][1]:
                total, n, low = blocks[-1][0] + total, blocks[-1][1] + n, blocks[-1][2]
                blocks.pop()
            blocks.append([total, n, low, high])
    kinds = (pa.float64(), pa.int64(), pa.float64(), pa.float64())
    yield pa.RecordBatch.from_arrays([pa.array([b[i] for b in blocks], k) for i, k in enumerate(kinds)], names=["total", "n", "low", "high"])


def fit_isotonic(df: DataFrame, p: str, y: str) -> list[tuple[float, float]]:
    """(p, value) knots of the non-decreasing least-squares fit to 0 and 1; equal p first become one point of weight.

    Violators are pooled within ranges of p, then what is left across ranges, which gives the same fit:
    pooling is associative. Blocks have increasing shares of whole numbers of rows, so N rows leave at
    most about N ** (2/3) of them. Rows with a null are left out.
    """
    points = df.where(F.col(p).isNotNull() & F.col(y).isNotNull()).groupBy(F.col(p).cast("double").alias("p")).agg(F.sum(F.col(y).cast("double")).alias("total"), F.count("*").alias("n"))
    points = points.select("total", "n", F.col("p").alias("low"), F.col("p").alias("high"))
    schema = "total double, n long, low double, high double"
    local = points.repartitionByRange("low").sortWithinPartitions("low").mapInArrow(_pooled, schema)
    blocks = local.repartition(1).sortWithinPartitions("low").mapInArrow(_pooled, schema).collect()
    return [(q, b.total / b.n) for b in blocks for q in ((b.low,) if b.low == b.high else (b.low, b.high))]


def apply_knots(df: DataFrame, p: str, knots: Sequence[tuple[float, float]], name: str, cells: int = 4096) -> DataFrame:
    """`df` with a column of linear interpolation of `p` between knots, constant beyond them, kept in [0, 1]; null for a null p or NaN.

    A row joins the cell of [0, 1] that its p lies in, which has the knots there and one on either side.
    """
    if not knots:
        return df.withColumn(name, F.lit(None).cast("double"))
    xs = [float(x) for x, _ in knots]
    cell = lambda x: min(cells - 1, max(0, math.floor(x * cells)))
    rows = []
    for c in range(cells):
        a, z = bisect.bisect_left(xs, c, key=cell), bisect.bisect_right(xs, c, key=cell)
        mine = knots[max(0, a - 1) : z + 1]
        rows.append((c, [float(x) for x, _ in mine], [float(v) for _, v in mine]))
    table = df.sparkSession.createDataFrame(rows, "_cell long, _x array<double>, _y array<double>")
    at = F.size(F.filter("_x", lambda x: x <= F.col(p)))
    x0, x1, y0, y1 = (F.try_element_at(c, k) for c in ("_x", "_y") for k in (at, at + 1))
    inner = F.when(at == 0, F.element_at("_y", 1)).when(at == F.size("_x"), F.element_at("_y", -1)).otherwise(y0 + (y1 - y0) * F.coalesce(F.try_divide(F.col(p) - x0, x1 - x0), F.lit(0.0)))
    value = F.when(F.col(p).isNotNull() & ~F.isnan(F.col(p).cast("double")), F.greatest(F.lit(0.0), F.least(F.lit(1.0), inner)))
    place = F.greatest(F.lit(0), F.least(F.lit(cells - 1), F.floor(F.col(p) * cells)))
    return df.withColumn("_cell", place).join(F.broadcast(table), "_cell", "left").withColumn(name, value).drop("_cell", "_x", "_y")


def deal_folds(sizes: dict[int, int], folds: int) -> list[tuple[int, int, int, int]]:
    """(size, fold, load before, groups) when groups go, largest first, to the fold with the fewest rows (then the lower one).

    `sizes` says how many groups have each size. Groups of one size are dealt at once: fold f would take
    its j-th at a load of load + j * size, and the smallest of these numbers go first.
    """
    loads, out = [0] * folds, []
    for size in sorted(sizes, reverse=True):
        n = sizes[size]
        upto = lambda v: [max(0, (v - load) // size + 1) for load in loads]  # noqa: B023,E731
        low, high = min(loads), max(loads) + n * size
        while low < high:
            middle = (low + high) // 2
            low, high = (low, middle) if sum(upto(middle)) >= n else (middle + 1, high)
        take, now = upto(low - 1), upto(low)
        for f in range(folds):
            take[f] += min(now[f] - take[f], n - sum(take))
        out += [(size, f, loads[f], k) for f, k in enumerate(take)]
        loads = [load + k * size for load, k in zip(loads, take, strict=True)]
    return out


#: Slots that are made by one row of a table of slots.
SLOTS = 100_000


def group_folds(df: DataFrame, group: str, folds: int = 3, seed: int = 13007) -> DataFrame:
    """(group, rows, fold): groups dealt by size, largest first, each to the fold with the fewest rows; ties by hash, then the lower fold.

    The driver gets how many groups have each size. Of one size, the group in the r-th place of hash order
    takes the r-th slot, whose place follows from the loads; no size is sorted in one task.
    """
    sizes = df.groupBy(group).agg(F.count("*").alias("rows"))
    dealt = deal_folds({r.rows: r.n for r in sizes.groupBy("rows").agg(F.count("*").alias("n")).collect()}, folds)
    by: dict[int, list] = {}
    for size, _, load, k in dealt:
        by.setdefault(size, []).append((load, k))
    table = df.sparkSession.createDataFrame([(size, f, [x for x, _ in by[size]], [k for _, k in by[size]]) for size, f, _, _ in dealt] or [(0, 0, [0], [0])], "rows long, fold int, loads array<long>, many array<long>")
    mine = F.element_at("many", F.col("fold") + 1)
    blocks = table.where(mine > 0).withColumn("low", F.explode(F.sequence(F.lit(0).cast("long"), mine - 1, F.lit(SLOTS).cast("long"))))
    if len(dealt) > 1 or (dealt and dealt[0][3] > SLOTS):  # spread, as a size may have any number of slots
        blocks = blocks.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    slots = blocks.withColumn("j", F.explode(F.sequence("low", F.least(F.col("low") + SLOTS, mine) - 1)))
    at = F.element_at("loads", F.col("fold") + 1) + F.col("j") * F.col("rows")
    # slots of every fold that come before this one: those with a smaller load, or the same load in a lower fold
    before = F.lit(1).cast("long")
    for g in range(folds):
        load, most = F.element_at("loads", g + 1), F.element_at("many", g + 1)
        reach = F.floor((at - load - F.when(F.col("fold") > g, 0).otherwise(1)) / F.col("rows")) + 1
        before = before + F.greatest(F.lit(0), F.least(most, reach))
    slots = slots.select("rows", "fold", before.alias("_rank"))
    ranked = ranked_by_hash(sizes, ["rows"], [group], joined_sha256(seed, group))
    return ranked.join(slots, ["rows", "_rank"]).select(group, "rows", "fold")


METHODS = ("temperature", "platt", "isotonic")


def fit_calibrator(df: DataFrame, p: str, y: str, method: str):
    """The parameters of one of METHODS."""
    return {"temperature": fit_temperature, "platt": fit_platt, "isotonic": fit_isotonic}[method](df, p, y)


def calibrate(df: DataFrame, p: str, method: str, fitted, name: str) -> DataFrame:
    """`df` with the calibrated probability as column `name`."""
    if method == "isotonic":
        return apply_knots(df, p, fitted, name)
    z = clipped_logit(F.col(p))
    return df.withColumn(name, logistic(z / fitted) if method == "temperature" else logistic(fitted[0] * z + fitted[1]))


def select_calibrator(df: DataFrame, p: str, y: str, group: str, folds: int = 3, seed: int = 13007, methods: Sequence[str] = METHODS) -> tuple[str, object, dict[str, float]]:
    """(method, parameters, mean Brier score by method): the method that does best on folds of whole groups, refitted on all rows.

    Ties go to the earlier method. The rows are written once and read for every fit.
    """
    parts = stash(df.select(F.col(p).alias("p"), F.col(y).cast("double").alias("y"), F.col(group).alias("g")).join(group_folds(df, group, folds, seed).select(F.col(group).alias("g"), "fold"), "g").select("p", "y", "fold"), "folds")
    losses = {}
    for method in dict.fromkeys(methods):
        each = []
        for f in range(folds):
            fitted = fit_calibrator(parts.where(F.col("fold") != f), "p", "y", method)
            each.append(calibrate(parts.where(F.col("fold") == f), "p", method, fitted, "q").agg(F.avg(F.pow(F.col("q") - F.col("y"), 2)).alias("b")))
        losses[method] = reduce(DataFrame.unionByName, each).agg(F.avg("b").alias("b")).first().b
    best = min(losses, key=losses.__getitem__)
    return best, fit_calibrator(parts, "p", "y", best), losses


def reliability_target(y: str, p: str, available: str) -> Column:
    """1 - |y - p| where the node is there, else null."""
    return F.when(F.col(available), 1 - F.abs(F.col(y) - F.col(p)))


def reliability_loss(reliability: str, y: str, p: str, available: str) -> Column:
    """Mean squared distance of a predicted reliability from its target, over nodes that are there; null without any."""
    return F.avg(F.when(F.col(available), F.pow(F.col(reliability) - reliability_target(y, p, available), 2)))


def logit_fusion(df: DataFrame, key: Sequence[str], node: str, p: str, available: str, weights: dict[str, float], bias: float = 0.0) -> DataFrame:
    """(key, fused, nodes, abstained): nodes' logits added with softplus weights that sum to one over the available ones.

    Steps without an available node have 0.5 and abstain. `weights` has a raw weight a node (0 where it has none).
    """
    raw = F.lit(0.0)
    for name, w in weights.items():
        raw = F.when(F.col(node) == name, F.lit(float(w))).otherwise(raw)
    here = F.coalesce(F.col(available), F.lit(False)) & F.col(p).isNotNull()
    w = F.when(here, F.log1p(F.exp(raw)))
    fused = logistic(F.try_divide(F.sum(w * clipped_logit(F.col(p))), F.sum(w)) + bias)
    out = df.groupBy(*key).agg(F.coalesce(fused, F.lit(0.5)).alias("fused"), F.count_if(here).alias("nodes"))
    return out.withColumn("abstained", F.col("nodes") == 0)
