"""Exact and near duplicates of records, their links, and the components of groups that they join."""
from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions import hamming
from plumbline.operators.components import connected_components
from plumbline.operators.stash import stash


def sign_bits(vector: str, bits: int = 64) -> Column:
    """The signs of a vector's first components as bits of a long (lowest bit first)."""
    marks = F.transform(F.slice(vector, 1, bits), lambda x, i: F.when(x > 0, F.expr("1L")).otherwise(F.expr("0L")) * F.pow(F.lit(2.0), F.least(i, F.lit(62))).cast("long"))
    top = F.when(F.try_element_at(vector, F.lit(64)) > 0, F.lit(-(1 << 63))).otherwise(F.lit(0).cast("long"))
    return F.aggregate(F.slice(marks, 1, 63), F.lit(0).cast("long"), lambda a, x: a.bitwiseOR(x)).bitwiseOR(top)


def coarse_bits(vector: str, groups: int = 16, each: int = 4) -> Column:
    """The signs of sums of neighbouring components, as every `each`-th bit of a long: vectors that are alike get near fingerprints."""
    total = lambda i: F.aggregate(F.slice(F.col(vector).cast("array<double>"), each * i + 1, each), F.lit(0.0), lambda a, x: a + x)
    marks = [F.when(total(i) > 0, F.lit(1 << (each * i)).cast("long")).otherwise(F.lit(0).cast("long")) for i in range(groups)]
    return reduce(lambda a, b: a.bitwiseOR(b), marks)


def difference_bits(vector: str, width: int = 16, bits: int = 64) -> Column:
    """Bit i (lowest first) of a long: whether `width` components from place i on sum to more than the `width` after them, the vector as a ring.

    Sums that hold a null are never more, NaN is more than any number; null vectors have no bit set.
    """
    reach = bits + 2 * width

    def sums(ring: np.ndarray) -> np.ndarray:
        out = np.zeros((len(ring), bits + width))
        for j in range(width):  # in the order of components, as other engines add
            out += ring[:, j : j + bits + width]
        return out

    def marked(vectors: pa.Array) -> pa.Array:
        out = np.zeros(len(vectors), np.uint64)
        sizes = pc.fill_null(pc.list_value_length(vectors), 0).to_numpy(zero_copy_only=False)
        for size in np.unique(sizes[sizes > 0]):
            at = np.flatnonzero(sizes == size)
            flat = vectors.take(pa.array(at)).flatten()
            ringed = lambda a: np.pad(np.tile(a.reshape(-1, size), 1 + -(-2 * width // bits)), ((0, 0), (0, reach)))[:, :reach]  # noqa: B023, E731
            with np.errstate(invalid="ignore"):
                total = sums(ringed(pc.cast(flat, pa.float64()).to_numpy(zero_copy_only=False)))
            holes = sums(ringed(flat.is_null().to_numpy(zero_copy_only=False).astype(float))) > 0 if flat.null_count else np.zeros(total.shape, bool)
            (a, z), (no_a, no_z) = ((x[:, :bits], x[:, width : width + bits]) for x in (total, holes))
            more = ((a > z) | (np.isnan(a) & ~np.isnan(z))) & ~no_a & ~no_z
            out[at] = (more.astype(np.uint64) << np.arange(bits, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)
        return pa.array(out.view(np.int64))

    @F.arrow_udf("long")
    def told(vectors: pa.Array) -> pa.Array:
        parts = [marked(vectors.slice(i, 1024)) for i in range(0, len(vectors), 1024)]
        return pa.concat_arrays(parts) if parts else pa.array([], pa.int64())

    return told(F.col(vector))


def exact_classes(df: DataFrame, digest: str, key: str) -> DataFrame:
    """(digest, representative, copies) of every content; membership is the join on the digest."""
    return df.groupBy(digest).agg(F.min(key).alias("representative"), F.count("*").alias("copies"))


def _masks(radius: int) -> list[int]:
    """Two masks of bits for each of radius + 1 bands: the band, and one half or the other of the next on the ring of bands.

    A band takes every (radius + 1)-th bit, as neighbouring bits often tell much the same.
    """
    bands = [[1 << bit for bit in range(i, 64, radius + 1)] for i in range(radius + 1)]
    masks = [sum(band) + sum(half) for band, after in zip(bands, bands[1:] + bands[:1], strict=True) for half in (after[: len(after) // 2], after[len(after) // 2 :])]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def hamming_pairs(df: DataFrame, key: str, bits: str, radius: int, same: Sequence[str] = (), block: int = 1024) -> DataFrame:
    """Pairs (left < right) of rows whose 64-bit fingerprints differ in 1 to `radius` bits.

    Rows are classes of equal fingerprints. On a ring of radius + 1 bands some band is equal and the two
    from there on differ in one bit at most, so one half of the next band is equal too: such a band and
    half are a key, for which both sides meet. Keys with many rows are split into blocks, which meet block
    by block. A pair is reported under its first common key. `same` columns must agree.
    """
    values = lambda c: [c.bitwiseAND(F.lit(mask).cast("long")) for mask in _masks(radius)]
    rows = stash(df.select(*same, key, bits), "fingerprints")  # read by both sides and the counts
    keys = rows.select(*same, F.col(key), F.col(bits), F.posexplode(F.array(*values(F.col(bits)))).alias("_i", "_v"))
    counted = keys.groupBy(*same, "_i", "_v").agg(F.count("*").alias("_n")).where("_n > 1")
    met = keys.join(counted, [*same, "_i", "_v"]).withColumn("_blocks", F.ceil(F.col("_n") / block).cast("long"))
    met = met.withColumn("_block", F.pmod(F.xxhash64(key), F.col("_blocks")))
    dealt = met.withColumn("_other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_blocks") - 1)))
    dealt = dealt.withColumn("_low", F.least("_block", "_other")).withColumn("_high", F.greatest("_block", "_other"))
    side = lambda s: dealt.select(*same, "_i", "_v", "_low", "_high", F.col("_block").alias(f"{s}_block"), F.col(key).alias(f"{s}_id"), F.col(bits).alias(f"{s}_bits"))
    pairs = side("left").join(side("right"), [*same, "_i", "_v", "_low", "_high"]).where((F.col("left_id") < F.col("right_id")) & ((F.col("_low") == F.col("_high")) | (F.col("left_block") != F.col("right_block"))))
    near = pairs.withColumn("distance", hamming(F.col("left_bits"), F.col("right_bits"))).where(f"distance between 1 and {radius}")
    equal = F.array(*(a == b for a, b in zip(values(F.col("left_bits")), values(F.col("right_bits")), strict=True)))
    return near.where(F.col("_i") == F.array_position(equal, True) - 1).select(*same, "left_id", "right_id", "distance")


def duplicate_audit(df: DataFrame, key: str, digest: Sequence[str], near: DataFrame) -> DataFrame:
    """(kind, left_id, right_id, distance): every exact copy linked to its class's first row, and the near pairs given.

    A class of n copies gives n - 1 links, not all its pairs.
    """
    classes = df.groupBy(*digest).agg(F.min(key).alias("_low"), F.count("*").alias("_n")).where("_n > 1")
    exact = df.join(classes, list(digest)).where(F.col(key) != F.col("_low")).select(F.lit("exact").alias("kind"), F.col("_low").alias("left_id"), F.col(key).alias("right_id"), F.lit(0).alias("distance"))
    return exact.unionByName(near.select(F.lit("near").alias("kind"), "left_id", "right_id", F.col("distance").cast("int").alias("distance")))


def spanning_edges(near: DataFrame, components: DataFrame, node: str) -> DataFrame:
    """(left_id, right_id, distance): the links, in the order (distance, left_id, right_id), that each join two components not yet joined.

    `near` has left_id, right_id, distance; `components` says where each node is to begin with. The order
    is total, so these links are those that some component has as its first to another one, round by
    round; components at least halve in number each round, and nothing is gathered on the driver.
    """
    side = lambda s: components.select(F.col(node).alias(f"{s}_id"), F.col("component").alias(f"{s}_c"))
    across = F.col("left_c") != F.col("right_c")
    links = stash(near.select("left_id", "right_id", "distance").join(side("left"), "left_id").join(side("right"), "right_id").where(across), "links")
    link = F.struct("distance", "left_id", "right_id", "left_c", "right_c").alias("e")
    kept = links.limit(0).select("left_id", "right_id", "distance")
    while not links.isEmpty():
        ends = links.select(F.col("left_c").alias("c"), link).unionByName(links.select(F.col("right_c").alias("c"), link))
        first = stash(ends.groupBy("c").agg(F.min("e").alias("e")).select("e.*").distinct(), "first-links")
        kept = kept.unionByName(first.select("left_id", "right_id", "distance"))
        moved = connected_components(first.select(F.col("left_c").alias("src"), F.col("right_c").alias("dst")))
        for c in ("left_c", "right_c"):
            links = links.join(moved.select(F.col("node").alias(c), F.col("component").alias("_to")), c, "left").withColumn(c, F.coalesce("_to", c)).drop("_to")
        links = stash(links.where(across), "links")
    return kept


def group_components(records: DataFrame, digest: str, group: str, near: DataFrame | None = None) -> DataFrame:
    """(group, component) of every group: groups that share a content, or that a near link joins, are one.

    Records of one content are linked to its smallest group, a star instead of all pairs. `near` has
    columns src and dst of groups.
    """
    pairs = records.select(digest, group).distinct()
    star = pairs.join(pairs.groupBy(digest).agg(F.min(group).alias("low"), F.count("*").alias("n")).where("n > 1"), digest)
    edges = star.select(F.col(group).alias("src"), F.col("low").alias("dst")).where("src <> dst")
    if near is not None:
        edges = edges.unionByName(near.select("src", "dst"))
    found = connected_components(edges).withColumnRenamed("node", group)
    return records.select(group).distinct().join(found, group, "left").select(group, F.coalesce("component", group).alias("component"))


def component_ids(components: DataFrame, group: str) -> DataFrame:
    """(component, component_id, groups): an id from the hash of each component's size and ends.

    A component's members are never gathered: its id hashes its smallest and largest member, their
    number and the sum of the members' hashes.
    """
    h = F.sum(F.xxhash64(group).cast("decimal(38,0)"))
    agg = components.groupBy("component").agg(F.count("*").alias("groups"), F.min(group).alias("a"), F.max(group).alias("z"), h.alias("h"))
    return agg.select("component", F.concat(F.lit("cmp_"), F.substring(F.sha2(F.concat_ws("|", "a", "z", F.col("groups").cast("string"), F.col("h").cast("string")), 256), 1, 24)).alias("component_id"), "groups")


# What a near pair of thumbnails must reach to be confirmed.
CONFIRMED = {"aspect_max": 0.02, "deviation_min": 5.0, "intensity_min": 0.995, "gradient_min": 0.990, "affine_rmse_max": 0.030}


def _pixels(a: np.ndarray) -> np.ndarray:
    """Centred pixels of thumbnails, one a row."""
    return a - a.mean(axis=1, keepdims=True)


def _steps(a: np.ndarray, width: int) -> np.ndarray:
    """Centred differences of neighbouring pixels, down and across."""
    n = a.shape[1]
    across = (a[:, 1:] - a[:, :-1])[:, np.arange(n - 1) % width != width - 1]
    out = np.concatenate([a[:, width:] - a[:, : max(n - width, 0)], across], axis=1)
    return out - out.mean(axis=1, keepdims=True) if out.shape[1] else out


def _rest(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The mean square that the best multiple of x leaves of y."""
    return ((y - ((x * y).sum(axis=1) / (x * x).sum(axis=1))[:, None] * x) ** 2).mean(axis=1)


def _by_size(columns: Sequence[pa.Array], names: Sequence[str], measure: Callable[..., list[np.ndarray]]) -> list[pa.Array]:
    """`measure` of the thumbnails of each size as matrices, one a column; null where they are null or empty, hold nulls or differ in size."""
    out, unknown = np.zeros((len(columns[0]), len(names))), np.ones(len(columns[0]), bool)
    sizes = np.stack([pc.fill_null(pc.list_value_length(t), -1).to_numpy(zero_copy_only=False) for t in columns])
    for size in np.unique(sizes[0, (sizes == sizes[0]).all(axis=0) & (sizes[0] > 0)]):
        at = np.flatnonzero((sizes == size).all(axis=0))
        flat = [t.take(pa.array(at)).flatten() for t in columns]
        with np.errstate(all="ignore"):  # flat sides; their rests are not used
            out[at] = np.stack(measure(*(pc.cast(t, pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, size) for t in flat)), axis=1)
        unknown[at] = np.any([t.is_null().to_numpy(zero_copy_only=False).reshape(-1, size).any(axis=1) for t in flat], axis=0)
    return [pa.array(c, mask=unknown) for c in np.ascontiguousarray(out.T)]


def _measured(df: DataFrame, thumbnails: Sequence[str], names: Sequence[str], measure: Callable[..., list[np.ndarray]], drop: Sequence[str] = ()) -> DataFrame:
    """`df` without `drop`, with what `measure` tells of its thumbnails as doubles called `names`."""
    kept, kinds = [c for c in df.columns if c not in drop], dict(df.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, whole.num_rows, 1024):
                batch = whole.slice(i, 1024)
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *_by_size([batch.column(t) for t in thumbnails], names, measure)], names=[*kept, *names])

    return df.mapInArrow(run, ", ".join([*(f"`{c}` {kinds[c]}" for c in kept), *(f"{c} double" for c in names)]))


def confirm_near(pairs: DataFrame, items: DataFrame, key: str, thumbnail: str, width: int, wide: str, high: str, same: str, semantics: str, levels: float = 255.0, bounds: dict[str, float] | None = None) -> DataFrame:
    """`pairs` (left_id, right_id, distance) with how alike their pictures are, and a `status`.

    An item has a grey `thumbnail` of `width` columns as an array row by row, the size of its picture
    (`wide`, `high`), a column that must agree (`same`) and one that says what its labels mean. Per pair:
    deviation (the smaller one of both thumbnails), intensity and gradient (correlations of pixels, and of
    differences of neighbouring ones; -1 where a side is flat), affine_rmse (of the best affine map of
    one onto the other, the worse way, in shares of `levels`; infinite from a flat side), aspect (relative
    difference). status: other_kind, rejected, conflict (confirmed, but with other semantics) or
    confirmed. Items meet pairs by two joins, which carry the thumbnails; they are compared in Arrow batches.
    """
    b = CONFIRMED | (bounds or {})
    square = lambda x: (x * x).sum(axis=1)
    named = items.select(F.col(key).alias("id"), F.col(same).alias("same"), F.col(semantics).alias("semantics"), (F.col(wide) / F.col(high)).alias("ratio"), F.size(thumbnail).alias("n"), F.col(thumbnail).alias("t"))
    derived = stash(_measured(named, ["t"], ["vv", "gg"], lambda t: [square(_pixels(t)), square(_steps(t, width))]), "pictures")
    side = lambda s: derived.select(*(F.col(c).alias(f"{s}_{c}") for c in derived.columns))

    def both(a: np.ndarray, z: np.ndarray) -> list[np.ndarray]:
        steps = (_steps(a, width) * _steps(z, width)).sum(axis=1)
        a, z = _pixels(a), _pixels(z)
        return [(a * z).sum(axis=1), steps, _rest(a, z), _rest(z, a)]

    sides = ["left_t", "right_t"]
    met = _measured(pairs.join(side("left"), "left_id").join(side("right"), "right_id"), sides, ["_pixels", "_steps", "_left_rest", "_right_rest"], both, drop=sides)
    col = lambda c: (F.col(f"left_{c}"), F.col(f"right_{c}"))

    def correlation(dot: str, vv: str) -> Column:
        norm = F.sqrt(col(vv)[0]) * F.sqrt(col(vv)[1])
        return F.when(norm > 1e-12, F.col(dot) / norm).otherwise(-1.0)

    def rmse(a: str) -> Column:
        return F.when(F.col(f"{a}_vv") > 1e-12, F.sqrt(F.greatest(f"_{a}_rest", F.lit(0.0))) / levels).otherwise(float("inf"))

    ratio = F.abs(F.col("left_ratio") - F.col("right_ratio")) / F.greatest("left_ratio", "right_ratio")
    told = met.select(
        *pairs.columns, (F.col("left_same") == F.col("right_same")).alias("_same"), (F.col("left_semantics") == F.col("right_semantics")).alias("_means"), ratio.alias("aspect"),
        F.sqrt(F.least("left_vv", "right_vv") / F.col("left_n")).alias("deviation"), correlation("_pixels", "vv").alias("intensity"), correlation("_steps", "gg").alias("gradient"),
        F.greatest(rmse("left"), rmse("right")).alias("affine_rmse"),
    )
    alike = (F.col("aspect") <= b["aspect_max"]) & (F.col("deviation") >= b["deviation_min"]) & (F.col("intensity") >= b["intensity_min"]) & (F.col("gradient") >= b["gradient_min"]) & (F.col("affine_rmse") <= b["affine_rmse_max"])
    status = F.when(~F.coalesce("_same", F.lit(False)), "other_kind").when(~F.coalesce(alike, F.lit(False)), "rejected").when(~F.coalesce("_means", F.lit(False)), "conflict").otherwise("confirmed")
    return told.withColumn("status", status).drop("_same", "_means")
