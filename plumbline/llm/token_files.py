"""Operator 2: token ids in binary blocks whose document boundaries are Elias-Fano coded.

Documents are range-partitioned by id and sorted, so a partition is a run of consecutive documents.
A task encodes its run slice by slice; a slice becomes one block: the concatenated ids (16 bits each
where the vocabulary allows, else 32) and two Elias-Fano sequences, the document boundaries in the id
array and the document ids. Blocks are rows of a Parquet table, so Spark's commit protocol decides
which attempts count and any store that Spark writes will do. Offsets and document ids come back from
select, a batch of places at a time; the place of a block in the whole is its partition's base, one
number a partition.
"""
from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.arrays import crc32, slices, small_batches, text_column
from plumbline.llm.tokens import WORDS_KEPT, SubwordEncoder, with_end
from plumbline.operators.stash import new_path


class EliasFano:
    """A non-decreasing sequence of n integers below u in about n * (2 + log2(u / n)) bits.

    The low bits stand packed one after another; the high bits are unary in a bit vector, in which the
    i-th one stands at high(i) + i. Every SAMPLE-th one's place is kept in 32 bits, from which select
    counts on through at most a few words; nothing is a table of 64-bit offsets.
    """

    SAMPLE = 128
    HEAD = struct.Struct("<4sIQBI")

    def __init__(self, blob: bytes):
        magic, self.n, self.base, self.low, samples = self.HEAD.unpack_from(blob)
        if magic != b"EFv1":
            raise ValueError("not an Elias-Fano block")
        at = self.HEAD.size
        self.samples = np.frombuffer(blob, "<u4", samples, at)
        at += 4 * samples
        size = (self.n * self.low + 7) // 8
        self.lows = np.frombuffer(blob, np.uint8, size, at)
        self.highs = np.frombuffer(blob, np.uint8, len(blob) - at - size, at + size)
        self.words: np.ndarray | None = None

    @classmethod
    def encode(cls, values: np.ndarray) -> bytes:
        v = np.asarray(values)
        base = int(v[0]) if len(v) else 0
        v = (v.astype(np.int64) - base).astype(np.uint64)
        n = len(v)
        low = max(0, (int(v[-1]) // n).bit_length() - 1) if n else 0
        high = (v >> np.uint64(low)).astype(np.int64) + np.arange(n)
        bits = np.zeros(int(high[-1]) + 1 if n else 0, np.uint8)
        bits[high] = 1
        lows = ((v[:, None] >> np.arange(low, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8).reshape(-1)
        samples = high[:: cls.SAMPLE].astype("<u4")
        head = cls.HEAD.pack(b"EFv1", n, base & (2**64 - 1), low, len(samples))
        return head + samples.tobytes() + np.packbits(lows, bitorder="little").tobytes() + np.packbits(bits, bitorder="little").tobytes()

    def _signed(self, v: np.ndarray) -> np.ndarray:
        return (v + np.uint64(self.base)).astype(np.int64)

    def _lows(self, i: np.ndarray) -> np.ndarray:
        at = (i[:, None] * self.low + np.arange(self.low)).astype(np.int64)
        return (((self.lows[at >> 3] >> (at & 7).astype(np.uint8)) & 1).astype(np.uint64) << np.arange(self.low, dtype=np.uint64)).sum(1, dtype=np.uint64)

    def select(self, i: np.ndarray | int) -> np.ndarray:
        """The values at places i: each counts on from the sample before it, word by word, until its one is reached."""
        i = np.atleast_1d(np.asarray(i, np.int64))
        if len(i) and not (0 <= i.min() and i.max() < self.n):
            raise IndexError("no such place")
        if self.words is None:
            self.words = np.frombuffer(self.highs.tobytes() + bytes(-len(self.highs) % 8), "<u8")
        at, left = self.samples[i // self.SAMPLE].astype(np.int64), i % self.SAMPLE
        word = at >> 6
        seen = self.words[word] & ~((np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)) if len(i) else np.zeros(0, np.uint64)
        open_ = np.arange(len(i))
        while len(open_):
            ones = np.bitwise_count(seen[open_]).astype(np.int64)
            on = ones <= left[open_]
            open_, ones = open_[on], ones[on]
            left[open_] -= ones
            word[open_] += 1
            seen[open_] = self.words[word[open_]]
        bits = np.unpackbits(seen.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        place = word * 64 + (np.cumsum(bits, axis=1) > left[:, None]).argmax(1)
        return self._signed(((place - i).astype(np.uint64) << np.uint64(self.low)) + self._lows(i))


BLOCKS = "part int, block int, base long, n_docs int, n_null int, n_tokens long, width int, ids binary, bounds binary, docs binary"


#: Documents whose offsets are selected at once.
READ = 4096


def write_token_files(docs: DataFrame, path: str, tokenizer: str, end_id: int | None = 1, partitions: int | None = None, slice_bytes: int = 8 << 20) -> str:
    """Writes the ids of every document (`doc_id`, `text`) to blocks under `path`, in ascending doc_id order.

    Null text is the empty document; `end_id` follows each document (None: nothing does). Rows with one
    doc_id stand together, ordered by their text's hash; null doc_ids come first. An empty table writes
    no block. Extra columns are ignored.
    """
    small_batches(docs.sparkSession)
    n = partitions or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, base = SubwordEncoder.of(tokenizer, most=WORDS_KEPT), TaskContext.get().partitionId(), 0
        width = 2 if encoder.size <= 1 << 16 and (end_id or 0) < 1 << 16 else 4
        for k, batch in enumerate(slices(batches, "text", slice_bytes)):
            ids, off = encoder.encode(text_column(batch, "text"))
            if end_id is not None:
                ids, off = with_end(ids, off, end_id)
            key = batch.column(0)
            known = np.asarray(key.drop_null(), dtype=np.int64)
            row = [part, k, base, len(key), key.null_count, len(ids), width, ids.astype(f"<u{width}").tobytes(), EliasFano.encode(off), EliasFano.encode(known)]
            base += len(ids)
            yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, schema, strict=True)], schema=schema)

    types = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    schema = pa.schema([(c.split()[0], types[c.split()[1]]) for c in BLOCKS.split(", ")])
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("tie", F.xxhash64("text"))
    ordered = rows.repartitionByRange(n, F.col("doc_id").asc_nulls_first(), "tie").sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "tie")
    ordered.mapInArrow(blocks, BLOCKS).write.option("compression", "zstd").parquet(path)
    return path


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of every document in the blocks under `path`; ids: little-endian unsigned 32 bits.

    A null text was written as its end id alone; a null doc_id comes back null; rows that shared an id
    come back each. Files of an empty table give no rows.
    """
    out = "doc_id long, start long, n_tokens long, ids binary"
    return _read(spark, path, out, lambda ids: ids.astype("<u4").tobytes(), pa.binary())


def token_file_digest(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document in the blocks under `path`; nulls and repeats as in `read_token_files`."""
    return _read(spark, path, "doc_id long, start long, n_tokens long, ids_crc32 long", crc32, pa.int64())


def _read(spark: SparkSession, path: str, out: str, value, kind: pa.DataType) -> DataFrame:
    blocks = spark.read.schema(BLOCKS).parquet(path)
    # one row a partition of the writing job
    totals = sorted((r.part, r.n) for r in blocks.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect())
    before = dict(zip([p for p, _ in totals], np.concatenate([[0], np.cumsum([n for _, n in totals])]).tolist(), strict=False))

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids, bounds, docs = np.frombuffer(row["ids"], f"<u{row['width']}"), EliasFano(row["bounds"]), EliasFano(row["docs"])
                for at in range(0, row["n_docs"], READ):
                    to = min(row["n_docs"], at + READ)
                    off, null = bounds.select(np.arange(at, to + 1)), max(0, min(row["n_null"], to) - at)
                    keys = [None] * null + docs.select(np.arange(at + null, to) - row["n_null"]).tolist()
                    start = before[row["part"]] + row["base"] + off[:-1]
                    yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(start, pa.int64()), pa.array(np.diff(off), pa.int64()), pa.array([value(ids[a:b]) for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)], kind)], names=[c.split()[0] for c in out.split(", ")])

    return blocks.mapInArrow(documents, out)


def new_token_folder(spark: SparkSession) -> str:
    return new_path(spark, "token-files")
