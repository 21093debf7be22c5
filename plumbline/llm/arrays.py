"""Small numpy and Arrow helpers shared by the operators of this subpackage."""
from __future__ import annotations

import ctypes
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession


def text_column(batch: pa.RecordBatch, name: str) -> pa.Array:
    """A text column as one plain string array, null as empty."""
    col = batch.column(batch.schema.get_field_index(name))
    return col.cast(pa.large_string()).fill_null("")


def string_bytes(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a large_string or large_binary array and its len+1 offsets from 0."""
    off = np.frombuffer(arr.buffers()[1], dtype=np.int64)[arr.offset : arr.offset + len(arr) + 1]
    data = np.frombuffer(arr.buffers()[2], dtype=np.uint8) if arr.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data[off[0] : off[-1]], off - off[0]


def ragged_index(starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """Positions start, start+1, ... start+len-1 of every (start, len), one after another."""
    lens = np.asarray(lens, dtype=np.int64)
    ends = np.cumsum(lens)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total, dtype=np.int64) + np.repeat(np.asarray(starts, dtype=np.int64) - (ends - lens), lens)


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def byte_set(outside: bytes) -> np.ndarray:
    """Which byte values belong to words, given those that do not."""
    inside = np.ones(256, bool)
    inside[list(outside)] = False
    return inside


def word_codes(data: np.ndarray, off: np.ndarray, inside: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct words (runs of `inside` bytes within a text), every word's code, its first byte, and words per text."""
    flags = inside[data]
    some = np.diff(off) > 0
    first, last = flags.copy(), flags.copy()
    first[1:] &= ~flags[:-1]
    last[:-1] &= ~flags[1:]
    opens, shuts = off[:-1][some], off[1:][some] - 1
    first[opens], last[shuts] = flags[opens], flags[shuts]
    begin = np.flatnonzero(first)
    ends = np.concatenate([[0], np.cumsum(np.flatnonzero(last) + 1 - begin)])
    words = pa.LargeStringArray.from_buffers(len(begin), pa.py_buffer(ends), pa.py_buffer(data[flags]))
    coded = words.dictionary_encode()
    return coded.dictionary, np.asarray(coded.indices), begin, np.diff(np.searchsorted(begin, off))


def gathered(batches: Iterator[pa.RecordBatch], name: str, most: int) -> Iterator[pa.RecordBatch]:
    """The same rows in batches whose texts in column `name` hold at least half of `most` bytes, the last one aside, and about `most` (one row at least)."""
    held, size = [], 0
    for part in slices(batches, name, most // 2):
        held.append(part)
        size += part.nbytes
        if size >= most // 2:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, size = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def small_batches(spark: SparkSession, rows: int = 2000) -> None:
    """Arrow batches of at most `rows` rows for this session, where nothing else than Spark's default is set.

    A batch of texts is held by the JVM and by Python at once, and its size is only bounded by rows.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, str(rows))


def give_back() -> None:
    """Returns freed memory to the system: workers live on between tasks, and an executor's limit counts it."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def slices(batches: Iterator[pa.RecordBatch], name: str, most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches whose texts in column `name` hold about `most` bytes (one row at least)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, off = string_bytes(text_column(batch, name))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(off, off[at] + most, "right")) - 1)
            yield batch.slice(at, to - at)
            at = to
    give_back()


def local_components(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, root) of every node other than its root in the graph of edges u-v; root = smallest node."""
    nodes, inv = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = inv[: len(u)], inv[len(u) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        for side in (a, b, label[a], label[b]):
            np.minimum.at(new, side, low)
        while not np.array_equal(new[new], new):
            new = new[new]
        if np.array_equal(new, label):
            break
        label = new
    moved = label != np.arange(len(nodes))
    return nodes[moved], nodes[label[moved]]


def crc32(a: np.ndarray) -> int:
    return zlib.crc32(np.ascontiguousarray(a, dtype="<u4"))
