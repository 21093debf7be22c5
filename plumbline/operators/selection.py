"""Ranked picks: per group, by hash, by constrained order, by median rank; shifts within strata."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions import joined_sha256
from plumbline.operators.stash import stash


def first_per_group(df: DataFrame, group: Sequence[str], order: Sequence[Column | str], n: int | Column) -> DataFrame:
    """The first n rows of each group; `order` must break every tie."""
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col("_rn") <= n).drop("_rn")


def ranked_by_hash(df: DataFrame, group: Sequence[str], key: Sequence[str], digest: Column) -> DataFrame:
    """`df` with _rank (from 1) of each row in its group by digest, then key, and the group's size _n.

    Digests are uniform: a rank is the offset of one of 4,096 prefixes of the group, from a table of counts,
    plus a place among the rows of that prefix. No group is sorted in one task, however large.
    """
    hashed = df.withColumn("_h", digest).withColumn("_p", F.substring("_h", 1, 3))
    w = Window.partitionBy(*group)
    before = w.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    counts = hashed.groupBy(*group, "_p").agg(F.count("*").alias("_c"))
    counts = counts.select(*group, "_p", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_before"), F.sum("_c").over(w).alias("_n"))
    placed = hashed.withColumn("_rn", F.row_number().over(Window.partitionBy(*group, "_p").orderBy("_h", *key)))
    return placed.join(counts, [*group, "_p"]).withColumn("_rank", F.col("_before") + F.col("_rn")).drop("_h", "_p", "_rn", "_before")


def hash_sample(df: DataFrame, group: Sequence[str], key: Sequence[str], seed: int, share: float | None = None, n: int | None = None) -> DataFrame:
    """A budget of each group in the order of sha256(seed|key): n rows, or a share rounded up (one at least)."""
    budget = F.lit(n) if n is not None else F.greatest(F.lit(1), F.ceil(F.col("_n") * share))
    return ranked_by_hash(df, group, key, joined_sha256(seed, *key)).where(F.col("_rank") <= budget).select(*df.columns)


def median_rank(df: DataFrame, group: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """The row in the middle of each group's order (the later one of two)."""
    w = Window.partitionBy(*group)
    ranked = df.withColumn("_rn", F.row_number().over(w.orderBy(*order))).withColumn("_n", F.count("*").over(w))
    return ranked.where(F.col("_rn") == F.floor(F.col("_n") / 2) + 1).drop("_rn", "_n")


def _choose(candidates: DataFrame, group: Sequence[str], ok: Column, order: Sequence[Column], blocked: Sequence[Column]) -> DataFrame:
    """(group, status, selected, diagnostic): the best allowed candidate, and the least bad of all.

    Status is 'pass', or 'diagnostic_only_blocked' where no candidate is allowed (selected is then null).
    """
    marked = stash(candidates.withColumn("_ok", F.coalesce(ok, F.lit(False))), "candidates")  # read twice, and few
    best = first_per_group(marked.where("_ok"), group, order, 1).select(*group, F.col("candidate_id").alias("selected"))
    least = first_per_group(marked, group, blocked, 1).select(*group, F.col("candidate_id").alias("diagnostic"))
    status = F.when(F.col("selected").isNull(), "diagnostic_only_blocked").otherwise("pass")
    return least.join(best, list(group), "left").select(*group, status.alias("status"), "selected", "diagnostic")


def select_threshold(candidates: DataFrame, group: Sequence[str], max_false_alarms: float) -> DataFrame:
    """The chosen threshold of each group, beside its diagnostic candidate (see `_choose`).

    Allowed: false alarms per hour within the cap; these go by macro F1, then miss rate, then the higher
    threshold, then id. The diagnostic one goes by false alarms, miss rate, higher threshold, id.
    """
    last = [F.col("event_miss_rate").asc_nulls_last(), F.desc("threshold"), F.asc("candidate_id")]
    fa = F.col("false_alarms_per_hour")
    return _choose(candidates, group, fa <= max_false_alarms, [F.col("event_macro_f1").desc_nulls_last(), *last], [fa.asc_nulls_last(), *last])


def select_policy(candidates: DataFrame, group: Sequence[str], coverage: float = 0.9, tolerance: float = 0.02, max_false_alarms: float = 10.0, max_miss: float = 0.2) -> DataFrame:
    """As `select_threshold` for alarm policies: coverage band, false alarms per 100 episodes and miss rate must hold.

    Allowed ones go by macro F1, delay, flips, complexity, id; the diagnostic one by miss rate, false alarms, id.
    """
    fa, miss = F.col("false_alarms_per_100_episodes"), F.col("event_miss_rate")
    ok = (F.abs(F.col("answer_coverage") - coverage) <= tolerance) & (fa <= max_false_alarms) & (miss <= max_miss)
    order = [F.col("event_macro_f1").desc_nulls_last(), F.col("mean_detection_delay_steps").asc_nulls_last(), F.col("mean_state_flips_per_episode").asc_nulls_last(), F.asc("complexity_rank"), F.asc("candidate_id")]
    return _choose(candidates, group, ok, order, [miss.asc_nulls_last(), fa.asc_nulls_last(), F.asc("candidate_id")])


def derangement(df: DataFrame, stratum: str, key: Sequence[str], seed: int) -> DataFrame:
    """For each row, the row of its stratum whose place is taken: a hash-seeded circular shift, no fixed point.

    Rows stand in the order of sha256(seed|key); a stratum of one row keeps it.
    """
    ranked = ranked_by_hash(df, [stratum], key, joined_sha256(seed, *key)).withColumn("_rn", F.col("_rank") - 1).drop("_rank")
    draw = F.conv(F.substring(joined_sha256(seed, stratum), 1, 8), 16, 10).cast("long")
    shift = F.when(F.col("_n") > 1, 1 + draw % (F.col("_n") - 1)).otherwise(0)
    moved = ranked.withColumn("_src", (F.col("_rn") + shift) % F.col("_n")).drop("_rn", "_n")
    names = {"conv_id": "from_conv", "turn": "from_turn"}
    source = ranked.select(stratum, F.col("_rn").alias("_src"), *(F.col(k).alias(names.get(k, f"from_{k}")) for k in key))
    return moved.join(source, [stratum, "_src"]).drop("_src")


def observed_order(df: DataFrame, group: Sequence[str], position: str, value: str) -> DataFrame:
    """The sequence of values along a position with runs of equal ones as one, and how many runs there are."""
    before = F.lag(value).over(Window.partitionBy(*group).orderBy(position))
    runs = df.withColumn("_before", before).where(F.col("_before").isNull() | (F.col("_before") != F.col(value)))
    ordered = F.array_sort(F.collect_list(F.struct(position, value)))
    return runs.groupBy(*group).agg(F.concat_ws(">", F.transform(ordered, lambda x: x[value])).alias("observed"), F.count("*").alias("runs"))


def first_groups(df: DataFrame, dataset: Sequence[str], group: str, position: str, n: int) -> DataFrame:
    """Rows of the first n groups of each dataset, groups in the order of their first position, then by name."""
    first = df.groupBy(*dataset, group).agg(F.min(position).alias("_at"))
    chosen = first_per_group(first, dataset, ["_at", group], n).select(*dataset, group)
    return df.join(chosen, [*dataset, group], "left_semi").select(*df.columns)


def source_budgets(sources: DataFrame, source: str, budget: int) -> DataFrame:
    """(source, budget): the total budget in equal whole parts, what is left going to the last source by name. Sources are few."""
    w = Window.partitionBy(F.lit(1))
    ranked = sources.select(source).distinct().withColumn("_n", F.count("*").over(w)).withColumn("_k", F.row_number().over(w.orderBy(source)))
    share = F.floor(F.lit(budget) / F.col("_n"))
    return ranked.select(source, F.when(F.col("_k") == F.col("_n"), F.lit(budget) - share * (F.col("_n") - 1)).otherwise(share).cast("long").alias("budget"))


def alternated(left: DataFrame, right: DataFrame, group: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Rows of two tables in turn within each group, left first, with their place from 0; when one ends the other goes on."""
    number = lambda df, side: df.withColumn("_k", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).withColumn("side", F.lit(side))
    both = number(left, 0).unionByName(number(right, 1))
    return both.withColumn("place", (F.row_number().over(Window.partitionBy(*group).orderBy("_k", "side")) - 1).cast("long")).drop("_k")
