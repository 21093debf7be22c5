"""Operator 4: SimHash fingerprints and near-duplicate groups by pigeonring filtering.

A fingerprint of 64 bits is a ring of t + 1 segments, t being the number of bits in which linked
fingerprints may differ. If two differ in at most t bits, then from some segment of the ring on every
chain of l consecutive segments differs in at most l * t / (t + 1) bits: the first segment in none, the
first two in at most one, and so on. The index follows the first two steps of that chain: a key is a
segment and one half of the next, of which at least one half must be equal too. Candidates that meet
under a key go through the whole chain's budgets before the full Hamming check.

Equal fingerprints count once. Fingerprints under one key are compared in blocks of bounded size, block
against block, and what leaves a task is a spanning forest of the links found there, never the pairs.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.arrays import local_components, ragged_index, slices, small_batches, string_bytes, text_column
from plumbline.operators.components import connected_components
from plumbline.operators.stash import stash

SEED = 42
BITS = 64


def text_fingerprints(texts: pa.Array, shingle: int = 4) -> np.ndarray:
    """The unsigned fingerprint of each text: zero without words."""
    data, off = string_bytes(texts)
    lower = np.arange(256, dtype=np.uint8)
    lower[65:91] += 32
    space = np.zeros(256, bool)
    space[[9, 10, 11, 12, 13, 32]] = True
    inside = ~space[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    starts = off[:-1][np.diff(off) > 0]
    first[starts] = inside[starts]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    ends = off[1:][np.diff(off) > 0] - 1
    last[ends] = inside[ends]
    begin, size = np.flatnonzero(first), 0
    size = np.flatnonzero(last) + 1 - begin
    # words, each with one space after it
    joined = lower[data[np.minimum(ragged_index(begin, size + 1), max(0, len(data) - 1))]] if len(begin) else np.zeros(0, np.uint8)
    at = np.concatenate([[0], np.cumsum(size + 1)])
    joined[at[1:] - 1] = 32
    words = np.diff(np.searchsorted(begin, off))
    count = np.where(words > 0, np.maximum(words - shingle + 1, 1), 0)
    index = ragged_index(np.cumsum(words) - words, count)
    final = np.minimum(index + shingle - 1, np.repeat(np.cumsum(words), count) - 1)
    view, h64 = memoryview(joined.tobytes()), xxhash.xxh64_intdigest
    hashes = np.fromiter((h64(view[a:b], SEED) for a, b in zip(at[index].tolist(), (at[final + 1] - 1).tolist(), strict=True)), np.uint64, len(index))
    out = np.zeros(len(words), np.uint64)
    full = np.flatnonzero(count)
    if len(full):
        ones = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        sums = np.add.reduceat(ones, (np.cumsum(count) - count)[full], axis=0, dtype=np.int32)
        out[full] = np.packbits(2 * sums > count[full, None], axis=1, bitorder="little").view("<u8")[:, 0]
    return out


def fingerprints(docs: DataFrame, shingle: int = 4) -> DataFrame:
    """(doc_id, fp) of every whole text of `docs`; fp holds the 64 bits as a signed long."""
    return with_fingerprints(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), "fp", shingle).select("doc_id", "fp")


def with_fingerprints(docs: DataFrame, name: str, shingle: int = 4) -> DataFrame:
    """`docs` with the fingerprints of its texts in a column `name`, which it does not have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 2 << 20):
            fp = text_fingerprints(text_column(batch, "text"), shingle)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(fp.view(np.int64))], names=[*batch.schema.names, name])

    small_batches(docs.sparkSession)
    return docs.mapInArrow(run, ", ".join(f"`{c}` {t}" for c, t in docs.dtypes) + f", `{name}` long")


def segments(bits: int, t: int) -> list[tuple[int, int]]:
    """(lowest bit, width) of t + 1 segments of nearly equal width."""
    cuts = [bits * i // (t + 1) for i in range(t + 2)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]


def ring_keys(fp: Column, t: int, bits: int = BITS) -> Column:
    """The keys of a fingerprint: for each segment, it and either half of the next."""
    ring = segments(bits, t)
    take = lambda low, width: F.shiftrightunsigned(fp, low).bitwiseAND(F.lit((1 << width) - 1).cast("long"))
    keys = []
    for i, (low, width) in enumerate(ring):
        nlow, nwidth = ring[(i + 1) % len(ring)]
        for k, (a, w) in enumerate(((nlow, nwidth // 2), (nlow + nwidth // 2, nwidth - nwidth // 2))):
            keys.append(F.shiftleft(F.shiftleft(take(low, width), w).bitwiseOR(take(a, w)), 8).bitwiseOR(F.lit(2 * i + k).cast("long")))
    return F.array(*keys)


def chained(x: np.ndarray, y: np.ndarray, start: np.ndarray, t: int, bits: int = BITS) -> np.ndarray:
    """Whether every chain from segment `start` of x and y stays within its budget; the last is the Hamming check."""
    ring = segments(bits, t)
    diff = x ^ y
    each = np.stack([np.bitwise_count((diff >> np.uint64(low)) & np.uint64((1 << width) - 1)) for low, width in ring]).astype(np.int64)
    total, good = np.zeros(len(x), np.int64), np.ones(len(x), bool)
    for step in range(t + 1):
        total += each[(start + step) % (t + 1), np.arange(len(x))]
        good &= total <= (step + 1) * t // (t + 1)
    return good


def _compare(t: int):
    """Links among rows sorted by (key, low, high), as a spanning forest of each batch's links."""
    names = ("key", "low", "high", "block", "fp", "rep")

    def links(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        key, low, high, block, fp, rep = rows
        group = np.cumsum(np.concatenate([[0], (np.diff(key) != 0) | (np.diff(low) != 0) | (np.diff(high) != 0)]))
        fp = fp.view(np.uint64)
        found = []
        active, shift = np.arange(len(key)), 0
        while len(active):
            shift += 1
            active = active[active < len(key) - shift]
            active = active[group[active] == group[active + shift]]
            pair = active[(block[active] != block[active + shift]) | (low[active] == high[active])]
            if len(pair):
                pair = pair[chained(fp[pair], fp[pair + shift], (key[pair] & 255) // 2, t)]
                found.append((rep[pair], rep[pair + shift]))
        return tuple(np.concatenate(x) if found else np.zeros(0, np.int64) for x in (zip(*found, strict=True) if found else ((), ())))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carry = [np.zeros(0, np.int64)] * len(names)

        def forest(rows: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            u, v = links(rows) if len(rows[0]) > 1 else (carry[0][:0],) * 2
            if len(u):
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in local_components(u, v)], names=["src", "dst"])

        for batch in batches:
            rows = [np.concatenate([c, np.asarray(batch.column(batch.schema.get_field_index(n)))]) for c, n in zip(carry, names, strict=True)]
            if not len(rows[0]):
                continue
            open_ = np.flatnonzero((rows[0] != rows[0][-1]) | (rows[1] != rows[1][-1]) | (rows[2] != rows[2][-1]))
            cut = int(open_[-1]) + 1 if len(open_) else 0
            yield from forest([r[:cut] for r in rows])
            carry = [r[cut:] for r in rows]
        yield from forest(carry)

    return run


def fingerprint_links(classes: DataFrame, t: int = 4, block: int = 512) -> DataFrame:
    """(src, dst) links that connect all `classes` (fp, rep; one row a fingerprint) within t bits of each other.

    `rep` names a class and must not be null; classes that nothing is near, and an empty table, give no
    links. A link may come more than once, from different keys.
    """
    keyed = classes.select("fp", "rep", F.explode(ring_keys(F.col("fp"), t)).alias("key"))
    shared = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    met = keyed.join(shared, "key").withColumn("blocks", F.ceil(F.col("n") / block).cast("long"))
    met = met.withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")))
    pairs = met.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    dealt = pairs.select("key", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "fp", "rep")
    n = int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return dealt.repartition(n, "key", "low", "high").sortWithinPartitions("key", "low", "high").mapInArrow(_compare(t), "src long, dst long")


def simhash_groups(docs: DataFrame, t: int = 4, shingle: int = 4, block: int = 512) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row of `docs` (`doc_id`, `text`).

    fingerprint: 16 lowercase hex digits. component_id: the smallest doc_id that is reached over links
    of at most t differing bits, the row's own included. Texts without words (null, empty, white space)
    have fingerprint zero and link like any other. A row belongs to its own text's group, whatever other
    rows have its doc_id. A null doc_id is never a group's smallest; a group that only such rows have
    has none (component_id null). An empty table gives no rows; extra columns are ignored.
    """
    made = stash(fingerprints(docs, shingle), "simhash")
    named = _components(made, t, block)
    return made.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _components(made: DataFrame, t: int, block: int = 512) -> DataFrame:
    """(fp, of, component_id) of every fingerprint of a table of doc_id and fp; `of` is its group, named by a fingerprint."""
    classes = stash(made.groupBy("fp").agg(F.min("doc_id").alias("low")), "simhash-classes")
    found = connected_components(fingerprint_links(classes.select("fp", F.col("fp").alias("rep")), t, block))
    grouped = classes.join(found.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "low", F.coalesce("component", "fp").alias("of"))
    named = grouped.join(grouped.groupBy("of").agg(F.min("low").alias("component_id")), "of")
    return stash(named.select("fp", "of", "component_id"), "simhash-groups")


def keep_one_of_each(docs: DataFrame, t: int = 4, shingle: int = 4) -> DataFrame:
    """One row of each near-duplicate group of `docs`, with all of its columns as they are.

    It is the row of the smallest doc_id; of rows that share that id, and of equal rows, the one that
    stands first in the table this writes. A row is judged by its own text: another row of its doc_id in
    another group is kept or dropped by itself. A null doc_id comes after all others. An empty table
    gives no rows.
    """
    fp, row = (next(c for c in (name, *(f"{name}_{k}" for k in range(len(docs.columns)))) if c not in docs.columns) for name in ("fp", "row"))
    made = stash(with_fingerprints(docs, fp, shingle).withColumn(row, F.monotonically_increasing_id()), "simhash-docs")
    slim = made.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(fp).alias("fp"), F.col(row).alias("row"))
    grouped = slim.join(_components(slim, t), "fp").select("row", "doc_id", "of")
    first = grouped.groupBy("of").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("first"))
    dropped = stash(grouped.join(first, "of").where(F.col("row") != F.col("first.row")).select(F.col("row").alias(row)), "simhash-dropped")
    return made.join(dropped, row, "left_anti").select(*docs.columns)
