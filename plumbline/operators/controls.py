"""Controls of fusion: what a score keeps when order, scores or pairing are broken; and steps that lose a node."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions import joined_sha256
from plumbline.operators.selection import ranked_by_hash


def _shift(digest: Column, n: Column) -> Column:
    """A number from 1 to n - 1 by the first 16 hex digits of a digest; 0 where n is 1."""
    draw = F.conv(F.substring(digest, 1, 16), 16, 10).cast("decimal(20,0)")
    return F.when(n > 1, 1 + F.pmod(draw, (n - 1).cast("decimal(20,0)")).cast("long")).otherwise(0)


def mask_only(train: DataFrame, test: DataFrame, concept: str, y: str, p: str, available: str) -> DataFrame:
    """`test` with the concept's share of positives in `train` as `p` where available, null elsewhere and for concepts without training rows."""
    prior = train.groupBy(concept).agg(F.avg(F.col(y).cast("double")).alias("_prior"))
    return test.join(prior, concept, "left").withColumn(p, F.when(F.col(available), F.col("_prior"))).select(*test.columns)


def temporal_shuffle(df: DataFrame, unit: Sequence[str], step: str, values: Sequence[str], seed: int) -> DataFrame:
    """`df` (a row per unit and step) with each step's values from another step of its unit.

    A unit's steps move round by an offset that follows from the seed and their number, so none stays; a unit of
    one step keeps it.
    """
    w = Window.partitionBy(*unit)
    ranked = df.withColumn("_k", (F.row_number().over(w.orderBy(step)) - 1).cast("long")).withColumn("_n", F.count("*").over(w))
    shift = _shift(joined_sha256(F.lit("temporal"), seed, F.col("_n").cast("string")), F.col("_n"))
    place = ranked.withColumn("_k", (F.col("_k") + shift) % F.col("_n")).drop(*values, "_n")
    return place.join(ranked.select(*unit, "_k", *values), [*unit, "_k"]).select(*df.columns)


def score_shuffle(df: DataFrame, strata: Sequence[str], key: Sequence[str], value: str, seed: int, moves: Column | None = None) -> DataFrame:
    """`df` with `value` of another row of its stratum: a hash-seeded shift, no fixed point; strata of one row keep it.

    Rows stand in the order of sha256(seed|key), and `key` tells all rows apart. Rows for which `moves` does
    not hold keep their value and lend it to none.
    """
    moving = F.coalesce(moves, F.lit(False)) if moves is not None else F.lit(True)
    ranked = ranked_by_hash(df.where(moving), strata, key, joined_sha256(seed, *key)).withColumn("_k", F.col("_rank") - 1)
    place = ranked.withColumn("_k", (F.col("_k") + _shift(joined_sha256(seed, *strata), F.col("_n"))) % F.col("_n")).drop(value, "_rank", "_n")
    moved = place.join(ranked.select(*strata, "_k", value), [*strata, "_k"]).select(*df.columns)
    return moved.unionByName(df.where(~moving))


def pair_alignment_shuffle(df: DataFrame, concept: str, node: str, key: Sequence[str], value: str, available: str, seed: int) -> DataFrame:
    """Breaks the pairing of nodes and keeps each node's scores: all nodes but one move theirs among their own.

    The one that stays is the most available (the first by name of several).
    """
    counts = df.groupBy(node).agg(F.count_if(available).alias("_c"))
    anchor = F.broadcast(counts.orderBy(F.desc("_c"), node).limit(1).select(F.col(node).alias("_anchor")))  # one row
    marked = df.join(anchor, F.col(node) == F.col("_anchor"), "left")
    moves = F.col("_anchor").isNull() & F.col(available)
    return score_shuffle(marked, [concept, node], key, value, seed, moves).select(*df.columns)


def drop_masked_nodes(df: DataFrame, episode: str, concept: str, step: str, node: str, family: str, positive: Column, seed: int) -> DataFrame:
    """A skeleton without the nodes that its template families take away.

    'modality_missingness' touches every fourth step of an episode and concept, from the second on;
    'evidence_delay' the first two positive ones. A touched step with two nodes or more loses the node with
    the largest sha256(seed|episode|concept|step|node).
    """
    unit = Window.partitionBy(episode, concept)
    steps = df.groupBy(episode, concept, step).agg(F.first(family).alias("_f"), F.max(positive.cast("int")).alias("_y"), F.countDistinct(node).alias("_nodes"))
    numbered = steps.withColumn("_k", F.row_number().over(unit.orderBy(step)) - 1).withColumn("_pos", F.sum("_y").over(unit.orderBy(step).rowsBetween(Window.unboundedPreceding, 0)))
    touched = ((F.col("_f") == "modality_missingness") & (F.col("_k") % 4 == 1)) | ((F.col("_f") == "evidence_delay") & (F.col("_y") == 1) & (F.col("_pos") <= 2))
    hit = numbered.where(touched & (F.col("_nodes") > 1)).select(episode, concept, step)
    last = df.join(hit, [episode, concept, step]).groupBy(episode, concept, step).agg(F.max_by(node, joined_sha256(seed, episode, concept, step, node)).alias(node))
    return df.join(last, [episode, concept, step, node], "left_anti").select(*df.columns)
