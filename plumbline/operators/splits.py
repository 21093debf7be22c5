"""Leakage-safe assignment of groups to pools: by hash, by quota, by time; samples and audits."""
from __future__ import annotations

import hashlib
import math
from collections.abc import Iterable, Iterator, Sequence
from fractions import Fraction

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.functions import hash_pool, hex_boundaries, joined_sha256
from plumbline.operators.selection import hash_sample, ranked_by_hash

# The pools and their weights.
BRANCH = {"tr": 0.6, "sel": 0.15, "prob": 0.1, "te": 0.15}
EPISODE = {"tr": 0.5, "sel": 0.15, "pol": 0.15, "te": 0.2}


def assign_by_hash(df: DataFrame, group: Sequence[str], weights: dict[str, float], seed: int) -> DataFrame:
    """`df` with the pool of each row's group: the share of the unit interval its hash falls into. No shuffle."""
    names = sorted(weights)
    return df.withColumn("pool", hash_pool(joined_sha256(seed, *group), names, [weights[n] for n in names]))


class QuotaError(ValueError):
    """There are fewer components than pools, or no assignment meets all quotas."""


def quotas(n: int, weights: dict[str, float], seed: int, dataset: str) -> dict[str, int]:
    """How many of n components of a dataset go to each pool: largest remainders, ties by hash, at least one each.

    An empty pool takes one from the pool that exceeds its share most, then from the larger one, then by
    hash. Fewer components than pools are an error.
    """
    if n < len(weights):
        raise QuotaError(f"{dataset} has {n} components for {len(weights)} pools")
    by = lambda purpose: lambda p: hashlib.sha256(f"{seed}|{dataset}|quota-{purpose}|{p}".encode()).hexdigest()
    exact = {p: Fraction(str(w)) for p, w in weights.items()}
    total = sum(exact.values())
    share = {p: n * w / total for p, w in exact.items()}
    out = {p: int(s) for p, s in share.items()}
    for p in sorted(share, key=lambda p: (out[p] - share[p], by("remainder")(p)))[: n - sum(out.values())]:
        out[p] += 1
    for empty in sorted((p for p in out if not out[p]), key=by("empty")):
        donor = min((p for p in out if out[p] > 1), key=lambda p: (share[p] - out[p], -out[p], by("donor")(p)))
        out[donor] -= 1
        out[empty] += 1
    return out


def hash_rank(df: DataFrame, key: Sequence[str], seed: int) -> DataFrame:
    """`df` with its rows' ranks (from 1) in the order of sha256(seed|key), ties by key; nothing is sorted in one task."""
    return ranked_by_hash(df, [], key, joined_sha256(seed, *key)).withColumnRenamed("_rank", "rank").drop("_n")


def _parts(n: int, low: list[int], high: list[int], share: list[float]) -> Iterator[tuple[int, ...]]:
    """All ways to write n as a sum with each part within its bounds, those nearest to the shares first at every place."""
    if len(low) == 1:
        if low[0] <= n <= high[0]:
            yield (n,)
        return
    first, last = max(low[0], n - sum(high[1:])), min(high[0], n - sum(low[1:]))
    want = n * share[0] / sum(share) if sum(share) else 0.0
    near = min(max(round(want), first), last)
    for step in range(max(near - first, last - near) + 1 if first <= last else 0):
        for v in {near + step, near - step} if want > near else {near - step, near + step}:
            if first <= v <= last:
                for rest in _parts(n - v, low[1:], high[1:], share[1:]):
                    yield (v, *rest)


def _search(sizes: dict[tuple[str, ...], int], left: dict[str, list[int]], share: list[float], reach: float, nodes: list[int]) -> dict[tuple[str, ...], tuple[int, ...]] | None:
    """Counts of each set of datasets per pool, none farther than `reach` from its share, within what the datasets have left.

    The set with the least room goes first, and what was found not to work is not tried twice. None if there is no way.
    """
    dead: set = set()

    def bounds(of: tuple[str, ...]) -> tuple[list[int], list[int]]:
        exact = [sizes[of] * w / sum(share) for w in share]
        return [max(0, math.ceil(x - reach)) for x in exact], [min(*(left[d][p] for d in of), math.floor(x + reach)) for p, x in enumerate(exact)]

    def solve(open_: tuple[tuple[str, ...], ...]) -> dict | None:
        if not open_:
            return {}
        state = (open_, tuple(map(tuple, left.values())))
        if state in dead:
            return None
        room = {of: sum(bounds(of)[1]) - sizes[of] for of in open_}
        of = min(open_, key=lambda of: (room[of], of))
        if room[of] >= 0:
            rest = tuple(o for o in open_ if o != of)
            for part in _parts(sizes[of], *bounds(of), share):
                nodes[0] -= 1
                if nodes[0] < 0:
                    raise QuotaError("the search for an assignment took too many steps")
                for d in of:
                    left[d] = [a - b for a, b in zip(left[d], part, strict=True)]
                found = solve(rest)
                if found is not None:
                    return found | {of: part}
                for d in of:
                    left[d] = [a + b for a, b in zip(left[d], part, strict=True)]
        dead.add(state)
        return None

    return solve(tuple(sorted(sizes)))


def deal_quotas(sizes: dict[tuple[str, ...], int], weights: dict[str, float], seed: int, max_steps: int = 200_000) -> tuple[dict[str, dict[str, int]], dict[tuple[str, ...], dict[str, int]]]:
    """Quotas of every dataset, and how many components of each set of datasets go to each pool so that all quotas hold.

    Sets of several datasets are searched for exactly: near their shares at first, where large ones always
    fit, then ever farther, at last everywhere. A set of one dataset takes what its dataset has left. It
    is an error (QuotaError) if no assignment exists, or if `max_steps` steps did not decide it.
    """
    datasets, pools = sorted({d for of in sizes for d in of}), sorted(weights)
    each = {d: quotas(sum(n for of, n in sizes.items() if d in of), weights, seed, d) for d in datasets}
    crossing = {of: n for of, n in sizes.items() if len(of) > 1}
    share, reach, nodes = [float(weights[p]) for p in pools], 1.0, [max_steps]
    while True:
        left = {d: [q[p] for p in pools] for d, q in each.items()}
        widest = reach >= max(crossing.values(), default=0)
        part = [nodes[0] if widest else min(nodes[0], max_steps // 8)]
        before = part[0]
        try:
            found = _search(crossing, left, share, reach, part)
        except QuotaError:
            if widest:
                raise
            found = None
        nodes[0] -= before - max(0, part[0])
        if found is not None:
            break
        if widest:
            raise QuotaError("components of several datasets cannot meet the quotas of all of them")
        reach *= 4
    dealt = {of: dict(zip(pools, part, strict=True)) for of, part in found.items()}
    return each, dealt | {of: dict(zip(pools, left[of[0]], strict=True)) for of in sizes if len(of) == 1}


def numbered_slots(spark: SparkSession, counts: Iterable[tuple[str, str, int]], block: int = 100_000) -> DataFrame:
    """(_of, pool, _slot): slots 0 to k - 1 of every (set, pool, k), made in blocks that Spark spreads over tasks."""
    rows = [(of, pool, at, min(k, at + block) - 1) for of, pool, k in counts for at in range(0, k, block)]
    table = spark.createDataFrame(rows, "_of string, pool string, _low long, _high long")
    if len(rows) > 1:
        table = table.repartition(min(len(rows), int(spark.conf.get("spark.sql.shuffle.partitions"))))
    return table.select("_of", "pool", F.explode(F.sequence("_low", "_high")).alias("_slot"))


def assign_components(membership: DataFrame, component: str, dataset: str, weights: dict[str, float], seed: int) -> DataFrame:
    """(component, pool): components, each in one dataset or more, so that every dataset's quotas hold.

    Components of one set of datasets stand in hash order and take that set's slots in hash order. The
    driver gets how many components each set of datasets has; datasets are few. Order and repeats of
    rows do not matter; null components are left out. It fails only where no assignment meets all quotas
    (or none was found in a bounded number of steps).
    """
    sets = membership.where(F.col(component).isNotNull()).groupBy(component).agg(F.array_join(F.array_sort(F.collect_set(dataset)), "+").alias("_of"), F.array_sort(F.collect_set(dataset)).alias("_sets"))
    sizes = {tuple(r._sets): r.n for r in sets.groupBy("_sets").agg(F.count("*").alias("n")).collect()}
    _, dealt = deal_quotas(sizes, weights, seed)
    slots = numbered_slots(membership.sparkSession, (("+".join(of), p, k) for of, q in dealt.items() for p, k in q.items() if k))
    slots = ranked_by_hash(slots, ["_of"], ["pool", "_slot"], joined_sha256(seed, "_of", F.lit("slot"), "pool", "_slot")).select("_of", "_rank", "pool")
    ranked = ranked_by_hash(sets.select(component, "_of"), ["_of"], [component], joined_sha256(seed, "_of", F.lit("component"), component))
    return ranked.join(slots, ["_of", "_rank"]).select(component, "pool")


def assign_by_time(df: DataFrame, cohort: str, order: Sequence[str], weights: dict[str, float], seed: int, dataset: str, length: float | None = None) -> DataFrame:
    """(cohort, place, pool): cohorts in time order, in contiguous blocks, pools in the given order.

    Cohorts are periods, of which there are few; their ranks come of one small table. With `length`
    cohorts are first seconds of periods that long, and a period that is missing between two is an error.
    """
    if length is not None and not cohort_gaps(df, cohort, length).isEmpty():
        raise QuotaError(f"the cohorts of {dataset} are not one continuous series")
    places = df.select(cohort).distinct().withColumn("place", F.dense_rank().over(Window.orderBy(cohort)).cast("long"))
    given = quotas(places.count(), weights, seed, f"{dataset}:temporal_cohorts")
    pool, run = None, 0
    for p in order:
        run += given[p]
        pool = F.when(F.col("place") <= run, p) if pool is None else pool.when(F.col("place") <= run, p)
    return places.withColumn("pool", pool)


def cohort_gaps(df: DataFrame, start: str, length: float) -> DataFrame:
    """(start, next, missing): cohorts that the next one does not follow at once, and how many are missing between; none if they are one continuous series.

    `start` is a cohort's first second and `length` its duration; cohorts are periods, of which there are few.
    """
    after = F.lead(start).over(Window.orderBy(start))
    gaps = df.select(start).where(F.col(start).isNotNull()).distinct().withColumn("next", after).where(F.col("next") - F.col(start) != length)
    return gaps.withColumn("missing", ((F.col("next") - F.col(start)) / length - 1).cast("double"))


def pool_blocks(assigned: DataFrame, start: str, length: float, family: dict[str, Sequence[str]], purge: float) -> DataFrame:
    """Per family and pool, in the family's order: first and last cohort, the gap to the pool before, and whether it reaches `purge`.

    `start` is a cohort's first second and `length` its duration.
    """
    spark = assigned.sparkSession
    rows = [(f, p, k) for f, pools in family.items() for k, p in enumerate(pools)]
    blocks = assigned.groupBy("pool").agg(F.min(start).alias("first"), F.max(start).alias("last"), F.count("*").alias("cohorts"))
    joined = spark.createDataFrame(rows, "family string, pool string, ordinal int").join(blocks, "pool")
    gap = F.col("first") - (F.lag("last").over(Window.partitionBy("family").orderBy("ordinal")) + length)
    return joined.withColumn("gap", gap).withColumn("purged", F.coalesce(F.col("gap") >= purge, F.lit(True)))


def few_shot(df: DataFrame, dataset: str, group: str, label: str, seeds: Sequence[int], share: float = 0.1, pool: str | None = None, train: str = "tr") -> DataFrame:
    """Per dataset and seed, the first share of groups by hash (one at least), with the classes of each; with `pool`, of the groups in the pool `train` alone."""
    per = (df if pool is None else df.where(F.col(pool) == train)).groupBy(dataset, group).agg(F.count_if(F.col(label) == 1).alias("positives"), F.count("*").alias("rows"))
    seeded = per.withColumn("seed", F.explode(F.array(*map(F.lit, seeds))))
    keyed = seeded.withColumn("_k", F.concat_ws("|", "seed", dataset, group))
    return hash_sample(keyed, [dataset, "seed"], ["_k"], 0, share=share).drop("_k")


def holdout(df: DataFrame, group: Sequence[str], seed: int, fraction: float) -> DataFrame:
    """`df` with split 'val' for groups whose hash lies in the first `fraction` of the unit interval, else 'train'."""
    bound = hex_boundaries([fraction, 1 - fraction])[0]
    return df.withColumn("split", F.when(joined_sha256(seed, *group) < bound, "val").otherwise("train"))


def pair_audit(df: DataFrame, pair: str, member: str, kinds: tuple[str, str], group: str, pool: str) -> DataFrame:
    """Per pair: rows, whether it has exactly one row of either kind, one group and one pool."""
    one = lambda k: F.count_if(F.col(member) == k) == 1
    return df.groupBy(pair).agg(
        F.count("*").alias("rows"), ((F.count("*") == 2) & one(kinds[0]) & one(kinds[1])).alias("complete"), (F.countDistinct(group) == 1).alias("one_group"), (F.countDistinct(pool) == 1).alias("one_pool")
    )
