"""Tables about records and runs: summaries, eligibility, roles, result tables, claims, budgets, opaque ids, grids."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.operators.contracts import ContractError, surplus_keys


def dataset_summary(df: DataFrame, dataset: str, group: str, concept: str) -> DataFrame:
    """Per dataset: records, groups, and how many rows have each concept, as a map in the order of concepts."""
    per = df.groupBy(dataset, concept).agg(F.count("*").alias("n"))
    counts = per.groupBy(dataset).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(concept, "n")))).alias("concepts"))
    return df.groupBy(dataset).agg(F.count("*").alias("records"), F.countDistinct(group).alias("groups")).join(counts, dataset)


def present_everywhere(df: DataFrame, item: str, place: str, places: Sequence[str]) -> DataFrame:
    """Items that occur in every one of the given places."""
    found = df.where(F.col(place).isin(*places)).groupBy(item).agg(F.countDistinct(place).alias("places"))
    return found.where(F.col("places") == len(places)).select(item)


def eligible_groups(df: DataFrame, group: str, member: str, kind: str, floor: int, kinds: Sequence[str]) -> DataFrame:
    """Per group: members, kinds present, and whether it has enough members and at least two compatible kinds."""
    out = df.groupBy(group).agg(F.countDistinct(member).alias("members"), F.countDistinct(F.when(F.col(kind).isin(*kinds), F.col(kind))).alias("kinds"))
    return out.withColumn("eligible", (F.col("members") >= floor) & (F.col("kinds") >= 2))


def role_bounds(df: DataFrame, unit: Sequence[str], epoch: str, role: str) -> DataFrame:
    """Runs of one role along time: order, role, first and last second, and the gap to the run before."""
    w = Window.partitionBy(*unit).orderBy(epoch)
    new = F.coalesce(F.lag(role).over(w) != F.col(role), F.lit(True)).cast("int")
    runs = df.withColumn("_new", new).withColumn("run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    bounds = runs.groupBy(*unit, "run").agg(F.first(role).alias(role), F.min(epoch).alias("first"), F.max(epoch).alias("last"))
    return bounds.withColumn("gap", F.col("first") - F.lag("last").over(Window.partitionBy(*unit).orderBy("run")))


def result_table(tables: Sequence[DataFrame], key: Sequence[str]) -> DataFrame:
    """Long results of several packages as one table; a repeated key is an error. Absent columns are null."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    if surplus_keys(out, key).limit(1).collect():
        raise ContractError(f"results repeat a key of {list(key)}")
    return out


def claim_status(claims: DataFrame, contrasts: DataFrame, gates: DataFrame) -> DataFrame:
    """claim, status: removed where a gate is closed or the contrast is absent, else what the contrast decided.

    Support counts as limited where the claim's scope is.
    """
    joined = claims.join(contrasts, "contrast", "left").join(gates, "gate", "left")
    status = F.when(~F.coalesce("open", F.lit(False)) | F.col("decision").isNull(), "removed").when(F.col("decision") == "negative", "negative").when(F.col("decision") == "inconclusive", "limited")
    return joined.select("claim", status.when(F.col("scope") == "limited", "limited").otherwise("supported").alias("status"))


def budget_roll_up(used: DataFrame, caps: DataFrame, key: str, amount: str, cap: str) -> DataFrame:
    """Per key with a cap: what is used, what is left, and whether the cap holds; unused caps count as 0 used."""
    total = used.groupBy(key).agg(F.sum(amount).alias("used"))
    return caps.join(total, key, "left").select(key, cap, F.coalesce("used", F.lit(0.0)).alias("used"), (F.col(cap) - F.coalesce("used", F.lit(0.0))).alias("left"), (F.coalesce("used", F.lit(0.0)) <= F.col(cap)).alias("within"))


def population_hash(df: DataFrame, key: str, digits: int) -> DataFrame:
    """(population_hash, n) of a column's distinct values: a hash over the hashes of buckets of sorted values.

    A value's bucket is the first `digits` hex digits of its hash, so 16 ** digits buckets share the values
    evenly; only the buckets' hashes come together.
    """
    ids = df.select(F.col(key).cast("string").alias("k")).distinct()
    per = ids.groupBy(F.substring(F.sha2("k", 256), 1, digits).alias("b")).agg(F.sha2(F.array_join(F.array_sort(F.collect_list("k")), "\n"), 256).alias("h"), F.count("*").alias("n"))
    rows = F.transform(F.array_sort(F.collect_list(F.struct("b", "h"))), lambda x: F.concat_ws(":", x["b"], x["h"]))
    return per.agg(F.sha2(F.array_join(rows, "\n"), 256).alias("population_hash"), F.sum("n").alias("n"))


def part_set_hash(df: DataFrame, unit: str, part: str, digest: str, size: str) -> DataFrame:
    """Per archive: parts, bytes, and a hash of its parts in order; archives have few parts."""
    parts = F.array_sort(F.collect_list(F.struct(F.col(part).cast("string").alias("p"), F.col(digest).alias("d"), F.col(size).cast("string").alias("s"))))
    text = F.array_join(F.transform(parts, lambda x: F.concat_ws(":", x["p"], x["d"], x["s"])), "\n")
    return df.groupBy(unit).agg(F.count("*").alias("parts"), F.sum(size).alias("bytes"), F.sha2(text, 256).alias("set_hash"))


def opaque_id(secret: bytes, *parts: Column | str) -> Column:
    """HMAC-SHA-256 (hex) of the parts, joined by |, under a secret. Two nested hashes; no Python on the executors."""
    if len(secret) > 64:
        raise ValueError("a secret has at most 64 bytes")
    padded = secret.ljust(64, b"\0")
    inner, outer = (F.lit(bytes(b ^ x for b in padded)) for x in (0x36, 0x5C))
    message = F.concat_ws("|", *parts).cast("binary")
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, message), 256))), 256)


def corruption_grid(records: DataFrame, record: str, kinds: dict[str, Sequence[float]]) -> DataFrame:
    """Every record with every kind and severity (from 1) and its parameter: the grid is a fixed list."""
    cells = [F.struct(F.lit(k).alias("corruption_type"), F.lit(i + 1).alias("severity"), F.lit(float(v)).alias("parameter")) for k, vs in sorted(kinds.items()) for i, v in enumerate(vs)]
    return records.select(record, F.explode(F.array(*cells)).alias("c")).select(record, "c.*")


def vector_correlation(a: Column, b: Column) -> Column:
    """Pearson correlation of two arrays of one length; null where one is constant."""
    n = F.size(a)
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda s, v: s + v)
    ma, mb = total(a) / n, total(b) / n
    dot = total(F.zip_with(a, b, lambda x, y: (x - ma) * (y - mb)))
    va, vb = total(F.transform(a, lambda x: (x - ma) * (x - ma))), total(F.transform(b, lambda y: (y - mb) * (y - mb)))
    return F.try_divide(dot, F.sqrt(va * vb))


def template_family(df: DataFrame, conflict: Column, families: Sequence[str], conflict_families: Sequence[str], digest: Column) -> DataFrame:
    """`df` with a template family: groups with a natural conflict draw from their own list, by hash."""
    from plumbline.functions import hash_modulo

    pick = lambda names: F.element_at(F.array(*map(F.lit, names)), (hash_modulo(digest, len(names)) + 1).cast("int"))
    return df.withColumn("template_family", F.when(conflict, pick(list(conflict_families))).otherwise(pick(list(families))))


# What is wrong with a box.
BOX_FAULTS = ("missing_image", "nonfinite_or_invalid_shape", "nonpositive", "negative_origin", "exceeds_image_bounds")


def box_faults(annotations: DataFrame, images: DataFrame, image: str, box: str, width: str, height: str) -> DataFrame:
    """`annotations` with the image's size and an array `reasons`: what is wrong with each box (x, y, width, height); empty for sound ones.

    `images` holds each image once. A box of another shape or with numbers that are not finite is asked nothing else.
    """
    joined = annotations.join(images.withColumn("_there", F.lit(True)), image, "left")
    finite = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))
    shaped = F.coalesce((F.size(box) == 4) & F.forall(box, finite), F.lit(False))
    at = lambda i: F.get(box, F.lit(i))
    over = (at(0) + at(2) > F.col(width) + 1e-9) | (at(1) + at(3) > F.col(height) + 1e-9)
    tests = (F.col("_there").isNull(), ~shaped, shaped & ((at(2) <= 0) | (at(3) <= 0)), shaped & ((at(0) < 0) | (at(1) < 0)), shaped & over)
    named = [F.when(F.coalesce(t, F.lit(False)), F.lit(n)) for n, t in zip(BOX_FAULTS, tests, strict=True)]
    return joined.withColumn("reasons", F.array_compact(F.array(*named))).drop("_there")


def fault_counts(audited: DataFrame) -> DataFrame:
    """(reason, annotations) of every kind of fault, and of all annotations under 'selected_annotations'; from one aggregation."""
    counts = audited.agg(F.count("*").alias("selected_annotations"), *(F.count_if(F.array_contains("reasons", n)).alias(n) for n in BOX_FAULTS))
    return counts.select(F.explode(F.array(*(F.struct(F.lit(n).alias("reason"), F.col(n).alias("annotations")) for n in ("selected_annotations", *BOX_FAULTS)))).alias("c")).select("c.*")


def license_boundary(audited: DataFrame, image: str, license: str, crowd: str, allowed: Sequence[int]) -> DataFrame:
    """Per license (-1: none): images with annotations, whether the license is allowed, and images with a sound box that is no crowd."""
    sound = (F.size("reasons") == 0) & (F.coalesce(F.col(crowd).cast("int"), F.lit(0)) == 0)
    images = audited.groupBy(image, F.coalesce(license, F.lit(-1)).alias(license)).agg(F.max(sound).alias("_sound"))
    eligible = F.col(license).isin(*allowed) if allowed else F.lit(True)
    return images.groupBy(license).agg(F.count("*").alias("images"), F.count_if("_sound").alias("usable_images")).withColumn("eligible", eligible)


def scaling_summary(trials: DataFrame, module: str, workers: str, rate: str, wall: str, memory: str, digest: str) -> DataFrame:
    """Per module and number of workers: repeats, mean rate and time, peak memory, whether all repeats gave one digest, and the gain over the fewest workers."""
    means = trials.groupBy(module, workers).agg(
        F.count("*").alias("repeats"), F.avg(rate).alias("mean_rate"), F.avg(wall).alias("mean_wall"), F.max(memory).alias("peak_memory"), ((F.countDistinct(digest) == 1) & (F.count(digest) == F.count("*"))).alias("deterministic")
    )
    base = means.groupBy(module).agg(F.min_by("mean_rate", workers).alias("_rate"), F.min(workers).alias("_workers"))
    gain = F.try_divide(F.col("mean_rate"), F.col("_rate"))
    return means.join(base, module).withColumn("speedup", gain).withColumn("efficiency", gain / (F.col(workers) / F.col("_workers"))).drop("_rate", "_workers")


def reuse_decision(archives: DataFrame, receipts: DataFrame, dataset: str, digest: str, count: str) -> DataFrame:
    """What to do about each dataset's manifest: 'build' without a receipt, 'reuse' where digest and count still hold, else 'drift'."""
    known = receipts.select(dataset, F.col(digest).alias("_digest"), F.col(count).alias("_count"), F.lit(True).alias("_known"))
    same = F.col(digest).eqNullSafe(F.col("_digest")) & F.col(count).eqNullSafe(F.col("_count"))
    return archives.join(known, dataset, "left").withColumn("decision", F.when(F.col("_known").isNull(), "build").when(same, "reuse").otherwise("drift")).drop("_digest", "_count", "_known")
