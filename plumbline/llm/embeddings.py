"""Operator 3: exact near-duplicate join of embeddings in metric space, by pivots.

Unit vectors with cosine >= c lie within r = sqrt(2 - 2c) of each other. Pivots partition the vectors:
each has its home in the cell of its nearest pivot. A pair with homes i and j meets in one of the two
cells, which one depends on i and j alone; there the other vector is a copy, if it may lie within r of
any member at all. By the triangle inequality a member of cell j that is within r of a vector of cell i
is at most r farther from both pivots than that vector, which gives the tests below; nothing within r
is ever missed. How many pivots there are is decided by the products they save and the copies they cost, as
a sample shows, but there are some at every size. Cells join independently: natives in blocks of bounded size, block against block, and
copies against each block. Both sides of a job come in the order of their distance from the cell's
pivot, so that only vectors whose distances differ by at most r are compared.

Every pair is decided once, for both of its vectors, and pairs at the bound by an exactly rounded
sum. What leaves a job is counts and a spanning forest of its links. Equal vectors are one class with a
weight, so copies meet nothing twice.
"""
from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.arrays import local_components
from plumbline.operators.components import connected_components
from plumbline.operators.stash import stash

#: More than rounding adds to a distance, which is the root of a difference near zero.
SLACK = 1e-7
#: Cosines this near to the bound are summed again without rounding between.
CLOSE = 1e-12
ROWS = 512
#: Copies that one job takes, in blocks.
RUN = 8
#: Rough costs of a product per dimension and of a copy, and the vectors that an estimate takes; they only decide how many cells there are.
PAIR_SECONDS, COPY_SECONDS, PROBE = 2e-10, 2e-6, 512


def unit_vectors(df: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(vec_id, v): v is the unit vector as little-endian doubles, null if it can link with nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for x in batch.column(1).to_pylist():
                u = None
                if x and None not in x:
                    a = np.array(x, np.float64)
                    top = np.abs(a).max()
                    if np.isfinite(top) and top > 0:
                        a = a / top
                        u = (a / math.sqrt(float(a @ a)) + 0.0).tobytes()
                out.append(u)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["vec_id", "v"])

    return df.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("e")).mapInArrow(run, "vec_id long, v binary")


def choose_pivots(sample: np.ndarray, k: int) -> np.ndarray:
    """k vectors of the sample, each the farthest from those before it."""
    chosen = [0]
    near = 2 - 2 * sample @ sample[0]
    while len(chosen) < min(k, len(sample)):
        chosen.append(int(near.argmax()))
        near = np.minimum(near, 2 - 2 * sample @ sample[chosen[-1]])
    return sample[chosen]


def _meets(d: np.ndarray, home: np.ndarray, far: np.ndarray, between: np.ndarray, r: float) -> np.ndarray:
    """Which cells each vector has to visit, from its distances to the pivots, the cells' radii and the pivots' own distances.

    A neighbour y of x in cell j: d(y, pj) >= d(x, pj) - r, and pj is nearer to y than x's pivot.
    """
    own = d[np.arange(len(d)), home][:, None]
    meets = (d <= far + r + SLACK) & (d <= own + 2 * r + SLACK) & (d**2 - own**2 <= 2 * r * between[home] + SLACK)
    other = np.arange(d.shape[1])
    return meets & np.where((home[:, None] + other) % 2 == 0, other < home[:, None], other > home[:, None])


def expected_cost(probe: np.ndarray, pivots: np.ndarray, r: float, total: int) -> float:
    """Seconds that cells around these pivots would take, from what a few vectors show: products of pairs, and copies."""
    d = _distances(probe, pivots)
    home = d.argmin(1)
    natives = np.bincount(home, minlength=len(pivots))
    far = np.full(len(pivots), -10.0)
    np.maximum.at(far, home, d.min(1))
    far = np.where(far < 0, -10.0, far + r / 2)  # a few vectors do not reach the edge of a cell
    visits = _meets(d, home, far, _distances(pivots, pivots), r).sum(0)
    pairs = float((natives * visits + natives * natives / 2).sum()) * (total / len(probe)) ** 2
    return pairs * probe.shape[1] * PAIR_SECONDS + float(visits.sum()) * total / len(probe) * COPY_SECONDS


def cells_for(sample: np.ndarray, r: float, total: int) -> np.ndarray:
    """The pivots: at least four from a hundred vectors on, growing with the root of their number, more where they save more than their copies cost."""
    least = max(1, min(4, total // 25), math.isqrt(total) // 12)
    sizes = [k for k in (least, 4 * least, 16 * least) if k == least or (k <= math.isqrt(total) and k <= len(sample))]
    pivots = choose_pivots(sample, sizes[-1])  # fewer pivots are the first of them
    probe = sample[:: max(1, len(sample) // PROBE)][:PROBE]
    return min((pivots[:k] for k in sizes), key=lambda p: expected_cost(probe, p, r, total))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    column = column.cast(pa.large_binary())
    return np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(-1, dim)


def _distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, 2 - 2 * x @ pivots.T))


def _linked(x: np.ndarray, y: np.ndarray, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (row of x, row of y) with a cosine of at least `cosine`, alike whichever side a vector is on."""
    dots = x @ y.T
    i, j = np.nonzero(dots >= cosine - CLOSE)
    for k in np.flatnonzero(dots[i, j] < cosine + CLOSE).tolist():
        if math.fsum((x[i[k]] * y[j[k]]).tolist()) < cosine:
            j[k] = -1
    return i[j >= 0], j[j >= 0]


class _Job:
    """One block of natives against what is streamed past it: counts of both sides and a forest of the links."""

    def __init__(self, cosine: float, reach: float):
        self.cosine, self.reach = cosine, reach
        self.parts: list[tuple] = []
        self.pairs: list[tuple[np.ndarray, np.ndarray]] = []

    def add(self, *left: np.ndarray) -> None:
        self.parts.append(left)

    def close(self, own: bool) -> Iterator[pa.RecordBatch]:
        """The block is complete; with `own`, its pairs among themselves."""
        self.d, self.key, self.n, self.x = (np.concatenate(c) for c in zip(*self.parts, strict=True))
        self.links = np.zeros(len(self.d), np.int64)
        for at in range(0, len(self.d) if own else 0, ROWS):
            to = min(len(self.d), at + ROWS)
            low = int(np.searchsorted(self.d, self.d[at] - self.reach))
            i, j = _linked(self.x[low:to], self.x[at:to], self.cosine)
            i, j = i + low, j + at
            i, j = i[i < j], j[i < j]
            self.links += np.bincount(i, self.n[j], len(self.d)).astype(np.int64) + np.bincount(j, self.n[i], len(self.d)).astype(np.int64)
            yield from self._keep(self.key[i], self.key[j])

    def meet(self, d: np.ndarray, key: np.ndarray, n: np.ndarray, x: np.ndarray) -> Iterator[pa.RecordBatch]:
        for at in range(0, len(d), ROWS):
            to = min(len(d), at + ROWS)
            low, high = np.searchsorted(self.d, d[at] - self.reach), np.searchsorted(self.d, d[to - 1] + self.reach, "right")
            i, j = _linked(self.x[low:high], x[at:to], self.cosine)
            if len(i):
                i, j = i + low, j + at
                self.links += np.bincount(i, n[j], len(self.d)).astype(np.int64)
                yield from _counts(key, np.bincount(j, self.n[i], len(d)).astype(np.int64))
                yield from self._keep(self.key[i], key[j])

    def _keep(self, u: np.ndarray, v: np.ndarray) -> Iterator[pa.RecordBatch]:
        if len(u):
            self.pairs.append(local_components(u, v))
            if sum(len(p[0]) for p in self.pairs) > 1 << 18:
                yield from self._forest()

    def _forest(self) -> Iterator[pa.RecordBatch]:
        if self.pairs:
            a, b = local_components(*(np.concatenate(x) for x in zip(*self.pairs, strict=True)))
            self.pairs = []
            yield _found([None] * len(a), [None] * len(a), a, b)

    def end(self) -> Iterator[pa.RecordBatch]:
        yield from _counts(self.key, self.links)
        yield from self._forest()


def _found(*columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["key", "n_links", "src", "dst"])


def _counts(key: np.ndarray, links: np.ndarray) -> Iterator[pa.RecordBatch]:
    some = np.flatnonzero(links)
    if len(some):
        yield _found(key[some], links[some], [None] * len(some), [None] * len(some))


#: What a row is in its job: a native of a block that also meets itself, one of a block that does not, or what meets them.
OWN, LEFT, RIGHT = range(3)


def _one_dimension(classes: DataFrame, dim: int, cosine: float, block: int, sample_rows: int) -> DataFrame:
    """(key, n_links, src, dst): rows with links of classes, to be added up, and rows with links of forests."""
    spark = classes.sparkSession
    total = classes.count()
    most = max(sample_rows, 2 * math.isqrt(total))
    r = math.sqrt(max(0.0, 2 - 2 * cosine)) + SLACK
    sample = classes.sample(False, min(1.0, 2 * most / total), 17).limit(most).collect() or classes.limit(1).collect()  # bounded by its parameter
    pivots = cells_for(np.array([np.frombuffer(x.v, np.float64) for x in sample]), r, total)
    between = _distances(pivots, pivots)

    def homes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                d = _distances(_matrix(batch.column(0), dim), pivots)
                yield pa.RecordBatch.from_arrays([pa.array(d.argmin(1), pa.int32()), pa.array(d.min(1))], names=["cell", "d"])

    # one row a pivot: how many vectors live in its cell, and how far out
    cells = {c.cell: (c.n, c.far) for c in classes.select("v").mapInArrow(homes, "cell int, d double").groupBy("cell").agg(F.count("*").alias("n"), F.max("d").alias("far")).collect()}
    blocks = np.array([-(-cells.get(c, (0, 0))[0] // block) for c in range(len(pivots))])
    far = np.array([cells.get(c, (0, -10.0))[1] for c in range(len(pivots))])

    def places(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Distances from the pivots, homes, and (row, cell) of the copies."""
        d = _distances(x, pivots)
        home = d.argmin(1)
        return d, home, *np.nonzero(_meets(d, home, far, between, r))

    def visits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            count = sum((np.bincount(places(_matrix(batch.column(0).slice(at, ROWS), dim))[3], minlength=len(pivots)) for at in range(0, batch.num_rows, ROWS)), np.zeros(len(pivots), int))
            some = np.flatnonzero(count)
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(count[some], pa.int64())], names=["cell", "n"])

    # one row a pivot: how many copies come to its cell, which are cut into runs of a few blocks' size
    copies = {c.cell: c.n for c in classes.select("v").mapInArrow(visits, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()}
    runs = np.array([max(1, math.ceil(copies.get(c, 0) / (RUN * block))) for c in range(len(pivots))])
    # jobs are numbered cell by cell: one a pair of blocks, the first run of copies with each block's own, then one a block and further run
    first = np.concatenate([[0], np.cumsum(blocks * (blocks + runs - 1))])

    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                d, home, who, cell = places(_matrix(part.column(0), dim))
                hashed = (np.asarray(part.column(1)).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64)
                # natives: one row for each block of their cell, and one for each further run of copies
                b, more = blocks[home], runs[home] - 1
                row = np.repeat(np.arange(len(d)), b + more)
                with_ = np.arange((b + more).sum()) - np.repeat(np.cumsum(b + more) - b - more, b + more)
                mine, size = (hashed % b)[row], b[row]
                low, high = np.minimum(mine, with_), np.maximum(mine, with_)
                job = first[home[row]] + np.where(with_ < size, low * size + high, size * size + mine * more[row] + with_ - size)
                side = np.where(with_ == mine, OWN, np.where((low == mine) | (with_ >= size), LEFT, RIGHT))
                # copies: one row for each block of the other cell
                many = blocks[cell]
                who, cell, c = np.repeat(who, many), np.repeat(cell, many), np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
                run, size = hashed[who] // 7 % runs[cell], blocks[cell]
                visit = first[cell] + np.where(run == 0, c * size + c, size * size + c * (runs[cell] - 1) + run - 1)
                take = np.concatenate([row, who])
                columns = [
                    pa.array(np.concatenate([job, visit]), pa.int64()), pa.array(np.concatenate([side, np.full(len(who), RIGHT)]), pa.int32()),
                    pa.array(np.concatenate([d[row, home[row]], d[who, cell]])), *(part.column(i).take(pa.array(take)) for i in (1, 2, 0)),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["job", "side", "d", "key", "n", "v"])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, at, work = None, None, None
        for batch in batches:
            job, side, d, key, n = (np.asarray(batch.column(i)) for i in range(5))
            cuts = np.flatnonzero((np.diff(job) != 0) | (np.diff(side) != 0)) + 1
            for s, e in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows], strict=True):
                if s == e:
                    continue
                if job[s] != now:
                    if work:
                        yield from () if at == RIGHT else work.close(at == OWN)
                        yield from work.end()
                    now, at, work = job[s], None, _Job(cosine, r + SLACK)
                rows = (d[s:e], key[s:e], n[s:e], _matrix(batch.column(5).slice(s, e - s), dim))
                if side[s] != RIGHT:
                    at = side[s]
                    work.add(*rows)
                    continue
                if at != RIGHT:
                    yield from work.close(at == OWN)
                    at = RIGHT
                yield from work.meet(*rows)
        if work:
            yield from () if at == RIGHT else work.close(at == OWN)
            yield from work.end()

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = classes.select("v", "key", "n").mapInArrow(members, "job long, side int, d double, key long, n long, v binary")
    placed = dealt.repartitionById(n, F.pmod("job", F.lit(n)).cast("int")).sortWithinPartitions("job", "side", "d", "key")
    return placed.mapInArrow(join, "key long, n_links long, src long, dst long")


def embedding_groups(df: DataFrame, cosine: float = 0.9, block: int = 8192, sample_rows: int = 1024) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row of `df` (`vec_id`, `embedding`).

    Two rows are linked if their cosine in double precision is at least `cosine`. Vectors that are null,
    empty, zero or hold null or non-finite components link with nothing; vectors of different length do
    not link. Repeated rows are vectors of their own, with the same id and vector or with one of the two. A null vec_id is never a component's smallest. An
    empty table gives no rows; extra columns are ignored. Only pivots come from a bounded sample; they
    decide where vectors meet, not which.
    """
    vectors = stash(unit_vectors(df), "vectors")
    grouped = vectors.where("v is not null").groupBy("v").agg(F.min("vec_id").alias("low"), F.count("*").alias("n"))
    classes = stash(grouped.withColumn("dim", F.length("v") / 8).withColumn("key", F.monotonically_increasing_id()), "vector-classes")
    dims = [int(x.dim) for x in classes.select("dim").distinct().collect()]  # a row a length of vector
    found = None
    for dim in dims:
        one = _one_dimension(classes.where(F.col("dim") == dim), dim, cosine, block, sample_rows)
        found = one if found is None else found.unionByName(one)
    if found is None:
        return vectors.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.col("vec_id").isNotNull().alias("kept"))
    found = stash(found, "vector-links")
    groups = connected_components(found.where("src is not null").select("src", "dst")).withColumnRenamed("node", "key")
    smallest = groups.join(classes.select("key", "low"), "key").groupBy("component").agg(F.min("low").alias("smallest"))
    groups = groups.join(smallest, "component").select("key", F.col("smallest").alias("component"))
    counted = found.where("key is not null").groupBy("key").agg(F.sum("n_links").alias("n_links"))
    named = classes.join(counted, "key", "left").join(groups, "key", "left")
    named = stash(named.select("v", (F.col("n") - 1 + F.coalesce("n_links", F.lit(0))).alias("links"), F.coalesce("component", "low").alias("component")), "vector-groups")
    joined = vectors.join(named, "v", "left")
    component = F.coalesce("component", "vec_id")
    return joined.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))
