"""Operator 5: packing documents into sequences by a linear grouping scheme.

A document's ids are cut only where it is longer than a sequence. What has to be packed is then a
histogram of at most `capacity` lengths, whatever the corpus, and the whole plan is made on it:

1. Large lengths, in descending order, fall into groups of equal cardinality, each rounded up to its
   longest member, which leaves few sizes.
2. Configurations of those sizes are chosen one after another: the largest size left and the fullest
   completion that a bounded subset-sum finds, as often as the counts allow.
3. Actual lengths take the places of rounded ones, group by group in descending order; equal sequences
   stay together as runs, so that the plan's size follows the number of lengths, not of documents.
4. Small lengths go, longest first, where they leave the least room (best fit), again run by run.

The plan is a bounded table of runs (length, rank of the first document, how many, first sequence,
offset). A document finds its run by its rank among documents of its length, which Spark counts in
salted buckets.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.arrays import crc32, slices, small_batches, text_column
from plumbline.llm.tokens import WORDS_KEPT, SubwordEncoder, with_end
from plumbline.operators.stash import stash


class Plan:
    """Runs of places for documents of each length; `sequences` is how many sequences they fill."""

    def __init__(self, counts: dict[int, int], capacity: int, groups: int = 256, small: int | None = None):
        self.capacity, self.sequences = capacity, 0
        self.runs: list[tuple[int, int, int, int, int]] = []
        self.rank: dict[int, int] = dict.fromkeys(counts, 0)
        self.room: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]
        small = small or max(1, capacity // 3)
        self._large(sorted(((x, n) for x, n in counts.items() if n and x > small), reverse=True), groups)
        for x, n in sorted(((x, n) for x, n in counts.items() if n and x <= small), reverse=True):
            self._small(x, n)

    def _place(self, length: int, n: int, sequence: int, offset: int) -> None:
        """n documents of a length, one into each of n sequences from the given one, all at one offset."""
        self.runs.append((length, self.rank[length], n, sequence, offset))
        self.rank[length] += n

    def _large(self, lengths: list[tuple[int, int]], groups: int) -> None:
        total = sum(n for _, n in lengths)
        if not total:
            return
        each = -(-total // groups)
        queues: list[list[list[int]]] = []  # of each group: [length, count] in descending order
        free = 0
        for x, n in lengths:
            while n:
                if not free:
                    queues.append([])
                    free = each
                queues[-1].append([x, took := min(n, free)])
                n, free = n - took, free - took
        size = np.array([q[0][0] for q in queues])
        left = np.array([sum(n for _, n in q) for q in queues])
        while left.any():
            chosen = self._configuration(size, left)
            times = int((left // np.maximum(chosen, 1))[chosen > 0].min())
            left -= chosen * times
            runs = [(self.sequences, times, 0)]
            self.sequences += times
            for g in np.flatnonzero(chosen):
                for _ in range(chosen[g]):
                    runs = self._substitute(queues[g], runs)
            for start, n, used in runs:
                self.room[self.capacity - used].append((start, n))

    def _configuration(self, size: np.ndarray, left: np.ndarray) -> np.ndarray:
        """How many of each size: the largest that is left, and what fills the rest most."""
        chosen = np.zeros(len(size), np.int64)
        first = int(np.flatnonzero(left)[0])
        chosen[first] = 1
        space = self.capacity - int(size[first])
        by = np.full(space + 1, -1)  # the size that first reached a sum
        reach = np.zeros(space + 1, bool)
        reach[0] = True
        for g in np.flatnonzero((left > 0) & (size <= space)):
            s = int(size[g])
            for _ in range(min(int(left[g] - chosen[g]), space // s)):
                new = np.zeros_like(reach)
                new[s:] = reach[:-s]
                new &= ~reach
                if not new.any():
                    break
                by[new] = g
                reach |= new
            if reach[space]:
                break
        at = int(np.flatnonzero(reach)[-1])
        while at:
            g = by[at]
            chosen[g] += 1
            at -= int(size[g])
        # a sum may have been reached through a larger sum of the same size than the count allows
        return np.minimum(chosen, left)

    def _substitute(self, queue: list[list[int]], runs: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
        out = []
        for start, n, used in runs:
            while n:
                x, have = queue[0]
                took = min(n, have)
                self._place(x, took, start, used)
                out.append((start, took, used + x))
                start, n = start + took, n - took
                queue[0][1] -= took
                if not queue[0][1]:
                    queue.pop(0)
        return out

    def _small(self, x: int, n: int) -> None:
        for r in range(x, self.capacity + 1):
            while n and self.room[r]:
                n = self._fill(x, n, r, *self.room[r].pop())
            if not n:
                return
        new = -(-n // (self.capacity // x))
        self.sequences += new
        self._fill(x, n, self.capacity, self.sequences - new, new)

    def _fill(self, x: int, n: int, room: int, start: int, sequences: int) -> int:
        """As many of n documents as have room in a run of equal sequences; what is left of n."""
        fit = room // x
        full = min(sequences, n // fit)
        used = self.capacity - room
        for j in range(fit if full else 0):
            self._place(x, full, start, used + j * x)
        if full:
            self.room[room - fit * x].append((start, full))
        n -= full * fit
        if full < sequences:
            for j in range(n):
                self._place(x, 1, start + full, used + j * x)
            if n:
                self.room[room - n * x].append((start + full, 1))
            if sequences - full - bool(n):
                self.room[room].append((start + full + bool(n), sequences - full - bool(n)))
            n = 0
        return n

    def table(self) -> np.ndarray:
        """Runs ordered by length and rank, as int64 columns."""
        a = np.array(self.runs, np.int64).reshape(-1, 5)
        return a[np.lexsort((a[:, 1], a[:, 0]))]


def best_plan(counts: dict[int, int], capacity: int, groups: int = 256) -> Plan:
    """The plan of fewest sequences among a few bounds between small and large; stops at the least there can be."""
    least = -(-sum(x * n for x, n in counts.items()) // capacity)
    best = None
    for part in (3, 2, 6, 12):
        plan = Plan(counts, capacity, groups, max(1, capacity // part))
        if best is None or plan.sequences < best.sequences:
            best = plan
        if best.sequences <= least:
            break
    return best


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int, end_id: int | None, with_ids: bool) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]): every document's ids, cut only at multiples of capacity.

    A null text is its end id alone, or no piece without one; a null doc_id stays null; rows that share
    an id have their own pieces. An empty table gives no rows.
    """

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = SubwordEncoder.of(tokenizer, most=WORDS_KEPT)
        for batch in slices(batches, "text"):
            ids, off = encoder.encode(text_column(batch, "text"))
            if end_id is not None:
                ids, off = with_end(ids, off, end_id)
            lens = np.diff(off)
            many = -(-lens // capacity)
            row = np.repeat(np.arange(len(lens)), many)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
            start = piece * capacity
            length = np.minimum(capacity, lens[row] - start)
            at = (off[row] + start).tolist()
            cut = [ids[a : a + n] for a, n in zip(at, length.tolist(), strict=True)]
            columns = [batch.column(0).take(pa.array(row)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(map(crc32, cut), pa.int64())]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                columns, names = [*columns, pa.array([x.astype("<u4").tobytes() for x in cut], pa.binary())], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(pieces, "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids)


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = 4096, end_id: int | None = 1, groups: int = 256, with_ids: bool = False, bucket_rows: int = 100_000_000) -> DataFrame:
    """One row per piece of a document (`doc_id`, `text`) with its sequence and its place there.

    Returns doc_id, piece, start, length, ids_crc32, sequence_id, offset, and the piece's ids if asked.
    Null text is the empty document, which still has its end id; without an end id, empty documents
    have no piece. Repeated rows are packed each. An empty table gives no rows. Extra columns are
    ignored. Nothing is dropped, and only documents over `capacity` are cut.
    """
    pieces = stash(token_pieces(docs, tokenizer, capacity, end_id, with_ids), "pieces")
    # at most `capacity` rows, whatever the corpus
    counts = {r.length: r.n for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    plan = best_plan(counts, capacity, groups)
    spark = pieces.sparkSession
    runs = spark.sparkContext.broadcast(plan.table())  # its size follows the number of lengths
    buckets = 256 * max(1, -(-sum(counts.values()) // bucket_rows))
    keyed = pieces.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(buckets)).cast("int"))
    sizes = keyed.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    within = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32")
    ranked = keyed.withColumn("rn", F.row_number().over(within)).join(sizes, ["length", "bucket"])
    ranked = ranked.select(*pieces.columns, (F.col("before") + F.col("rn") - 1).alias("rank"))
    names = [c for c in pieces.columns if c != "ids"] + ["sequence_id", "offset"] + ["ids"] * with_ids

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = runs.value
        key = (table[:, 0].astype(np.uint64) << np.uint64(44)) + table[:, 1].astype(np.uint64)
        for batch in batches:
            rank, length = (np.asarray(batch.column(batch.schema.get_field_index(c))) for c in ("rank", "length"))
            run = table[np.searchsorted(key, (length.astype(np.uint64) << np.uint64(44)) + rank.astype(np.uint64), "right") - 1]
            found = {"sequence_id": pa.array(run[:, 3] + rank - run[:, 1], pa.int64()), "offset": pa.array(run[:, 4], pa.int64())}
            yield pa.RecordBatch.from_arrays([found[c] if c in found else batch.column(batch.schema.get_field_index(c)) for c in names], names=names)

    return ranked.mapInArrow(places, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long" + ", ids binary" * with_ids)
