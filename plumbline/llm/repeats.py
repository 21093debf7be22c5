"""Operator 8: removal of repeated byte strings by prefix-free parsing.

A byte goes if a string of `length` bytes that covers it also starts earlier in the corpus (smaller
doc_id, or earlier in the document). The corpus is never sorted suffix by suffix. As in prefix-free
parsing, a rolling hash marks trigger positions, which depend on the bytes around them alone, so equal
text is cut alike wherever it stands; a phrase is what belongs to one trigger, and the dictionary is
the set of distinct phrases, each with its first place.

* The trigger of a string is the place of the least hash among its k-byte grams, so every string has
  one, and a run of consecutive string starts with one trigger is a phrase. A phrase carries the bytes
  up to the end of its last string: all strings that start in it lie whole in it, and the order of
  suffixes to the depth that matters is the dictionary's alone.
* Phrases are hashed and dealt by their trigger's gram. Of equal phrases all but the first are repeats
  as a whole: highly repetitive text ends here, one row a phrase and batch.
* Distinct phrases with a common trigger gram (where a copied passage begins, ends or was edited) are
  entered in the dictionary with their bytes. The dictionary's suffixes are ranked to depth `length` by
  prefix doubling, which gives its suffix array to that depth; suffixes of one rank stand in the order
  of the parse, the places of their phrases in the corpus, and all but the first are repeats. Phrases
  whose trigger no other has hold nothing repeated and are never expanded.

A string lies whole in its phrase, so ranks never look beyond a phrase and the parse orders what the
dictionary leaves equal by place alone: deeper ranks of the parse decide nothing. Two steps go by hash:
phrases are equal if 128 bits of hashes are, and the strings of a trigger gram with so many phrases
that they would not fit a task (`hot`) are dealt singly, by gram and a 64-bit hash of the string.

Texts stand in bucketed chunks of rows in the shared folder, which every later step joins by chunk
without moving them again.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.arrays import give_back, ragged_index, slices, small_batches, string_bytes, text_column
from plumbline.operators.stash import stash, stash_bucketed

BASE = 0x9E3779B97F4A7C15 | 1
SLICE = 1 << 20
NO_ID = -(1 << 63)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xA24BAED4963EE407)
    return x ^ (x >> np.uint64(32))


BYTES = _mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x2545F4914F6CDD1D))


class Rolling:
    """Hashes of any substrings of a byte array, from prefix sums of byte * BASE ** place modulo 2 ** 64."""

    _powers: tuple[np.ndarray, np.ndarray] = (np.ones(1, np.uint64), np.ones(1, np.uint64))

    def __init__(self, data: np.ndarray):
        n = len(data) + 1
        if len(Rolling._powers[0]) < n:
            up, down = np.full(n, BASE, np.uint64), np.full(n, pow(BASE, -1, 1 << 64), np.uint64)
            up[0] = down[0] = 1
            Rolling._powers = (np.multiply.accumulate(up), np.multiply.accumulate(down))
        self.sums = np.zeros(n, np.uint64)
        np.cumsum(BYTES[data] * Rolling._powers[0][: n - 1], out=self.sums[1:])

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return _mix((self.sums[ends] - self.sums[starts]) * Rolling._powers[1][starts])

    def grams(self, k: int) -> np.ndarray:
        n = len(self.sums) - k
        return _mix((self.sums[k:] - self.sums[:n]) * Rolling._powers[1][:n])


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """min(x[j : j + width]) for every j, from running minima of blocks in both directions."""
    n = len(x) - width + 1
    full = np.full(-(-len(x) // width) * width, np.iinfo(x.dtype).max, x.dtype)
    full[: len(x)] = x
    ahead = np.minimum.accumulate(full.reshape(-1, width), axis=1).reshape(-1)
    back = np.minimum.accumulate(full.reshape(-1, width)[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(back[:n], ahead[width - 1 : width - 1 + n])


def phrases(data: np.ndarray, off: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """Phrases of a chunk of documents: (trigger hash, phrase hash, first start, number of starts, trigger - first start).

    Only strings inside a document count. A long chunk is worked in slices; a phrase that a slice cuts
    becomes two, which costs an expansion and never a match.
    """
    width, out = length - gram + 1, []
    for begin in range(0, max(0, len(data) - length + 1), SLICE):
        part = data[begin : begin + SLICE + length - 1]
        rolling = Rolling(part)
        hashes = rolling.grams(gram)
        key = (hashes & ~np.uint64(0xFFFFFF)) | np.arange(len(hashes), dtype=np.uint64)
        trigger = (sliding_min(key, width) & np.uint64(0xFFFFFF)).astype(np.int64)
        # string starts within one document
        a, b = np.clip(off[:-1] - begin, 0, len(trigger)), np.clip(off[1:] - length + 1 - begin, 0, len(trigger))
        some = b > a
        edge = np.zeros(len(trigger) + 1, np.int8)
        edge[a[some]] += 1
        edge[b[some]] -= 1
        inside = np.cumsum(edge[:-1], dtype=np.int8) > 0
        first = inside.copy()
        first[1:] &= ~inside[:-1] | (trigger[1:] != trigger[:-1])
        lo = np.flatnonzero(first)
        if not len(lo):
            continue
        stop = np.flatnonzero(inside & np.concatenate([~inside[1:] | (trigger[1:] != trigger[:-1]), [True]]))
        at = trigger[lo]
        whole = rolling.of(lo, stop + length) ^ _mix((at - lo + 1).astype(np.uint64) << np.uint64(32) | (stop - lo + 1).astype(np.uint64))
        out.append((hashes[at], whole, lo + begin, stop - lo + 1, at - lo))
    if not out:
        return tuple(np.zeros(0, t) for t in (np.uint64, np.uint64, np.int64, np.int64, np.int64))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _first_flags(*keys: np.ndarray) -> np.ndarray:
    """Which rows of sorted keys open a new group."""
    flags = np.zeros(len(keys[0]), bool)
    flags[:1] = True
    for k in keys:
        flags[1:] |= k[1:] != k[:-1]
    return flags


def _bytes(row: dict, name: str, dtype: str) -> np.ndarray:
    return np.frombuffer(row[name] or b"", dtype)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """Rows one at a time: a row is a chunk or a blob, and no two are needed together."""
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.slice(i, 1).to_pylist()[0]
    give_back()


class Chunk:
    """A chunk of documents: its rows, their texts' bytes, offsets and ids (null as the least id)."""

    def __init__(self, blob: bytes):
        self.rows = pa.ipc.open_stream(blob).read_all().combine_chunks().to_batches()[0]
        self.data, self.off = string_bytes(text_column(self.rows, "text"))
        ids = self.rows.column(self.rows.schema.get_field_index("doc_id")).cast(pa.int64())
        self.ids = np.asarray(ids.fill_null(NO_ID))


def write_chunks(docs: DataFrame, chunk_bytes: int) -> DataFrame:
    """`docs` as (chunk, rows) with about `chunk_bytes` of text each, in a table that is bucketed by chunk.

    Rows keep all columns, nulls and repeats as they are; a row longer than a chunk is one. An empty
    table gives no chunk.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        for k, batch in enumerate(slices(batches, "text", chunk_bytes)):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
                writer.write_batch(batch)
            yield pa.RecordBatch.from_arrays([pa.array([(part << 32) | k], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["chunk", "rows"])

    small_batches(docs.sparkSession)
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return stash_bucketed(docs.mapInArrow(run, "chunk long, rows binary"), "chunks", "chunk", n, codec="none")


DEALT = "bucket int, kind int, chunk long, trigger binary, phrase binary, doc binary, lo binary, many binary, at binary, data binary"
DEALT_SCHEMA = pa.schema([("bucket", pa.int32()), ("kind", pa.int32()), ("chunk", pa.int64()), *((c, pa.binary()) for c in ("trigger", "phrase", "doc", "lo", "many", "at", "data"))])
#: Kinds of dealt rows: phrases by hash; ranges that repeat for certain; phrases with their bytes; single strings.
HASHED, REPEATED, SPELLED, STRINGS = range(4)


def _dealt(bucket: int, kind: int, chunk: int, **columns: np.ndarray) -> dict:
    return {"bucket": bucket, "kind": kind, "chunk": chunk} | {k: np.ascontiguousarray(v).tobytes() for k, v in columns.items()}


def _batch(rows: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema=schema)


def _by_bucket(trigger: np.ndarray, buckets: int) -> Iterator[tuple[int, np.ndarray]]:
    bucket = ((trigger >> np.uint64(20)) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
    for b in np.unique(bucket).tolist():
        yield b, order[cuts[b] : cuts[b + 1]]


def _deal_phrases(length: int, gram: int, buckets: int):
    """Chunks to dealt rows: one a distinct phrase of the chunk; later equals repeat for certain."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            number, chunk = row["chunk"], Chunk(row["rows"])
            trigger, whole, lo, many, at = phrases(chunk.data, chunk.off, length, gram)
            doc = chunk.ids[np.searchsorted(chunk.off, lo, "right") - 1]
            order = np.lexsort((lo, doc, whole, trigger))
            first = _first_flags(trigger[order], whole[order])
            again, keep = order[~first], np.sort(order[first])
            rows = []
            if len(again):
                ranges = {"lo": lo[again].astype("<u4"), "many": (many[again] + length - 1).astype("<u4")}
                rows.append(_dealt(number % buckets, REPEATED, number, **ranges))
            for b, mine in _by_bucket(trigger[keep], buckets):
                k = keep[mine]
                rows.append(_dealt(b, HASHED, number, trigger=trigger[k], phrase=whole[k], doc=doc[k], lo=lo[k].astype("<u4"), many=many[k].astype("u1"), at=at[k].astype("u1")))
            if rows:
                yield _batch(rows, DEALT_SCHEMA)

    return run


FOUND = "chunk long, lo binary, many binary, trigger binary, ask_lo binary, ask_many binary, ask_at binary, ask_hot binary"
FOUND_SCHEMA = pa.schema([("chunk", pa.int64()), *((c, pa.binary()) for c in ("lo", "many", "trigger", "ask_lo", "ask_many", "ask_at", "ask_hot"))])


def _by_chunk(chunk: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(chunk, kind="stable")
    numbers, starts = np.unique(chunk[order], return_index=True)
    ends = np.append(starts, len(order))[1:]
    for c, s, e in zip(numbers.tolist(), starts.tolist(), ends.tolist(), strict=False):
        yield c, order[s:e]


def _resolve_phrases(length: int, hot: int):
    """Dealt rows of a bucket to what repeats in each chunk, and to which phrases have to be spelled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = []
        for row in _rows(batches):
            if row["kind"] == REPEATED:
                yield _batch([{"chunk": row["chunk"], "lo": row["lo"], "many": row["many"]}], FOUND_SCHEMA)
            else:
                lo = _bytes(row, "lo", "<u4")
                parts.append((_bytes(row, "trigger", "<u8"), _bytes(row, "phrase", "<u8"), _bytes(row, "doc", "<i8"), np.full(len(lo), row["chunk"]), lo, _bytes(row, "many", "u1"), _bytes(row, "at", "u1")))
        if not parts:
            return
        trigger, whole, doc, chunk, lo, many, at = (np.concatenate(x) for x in zip(*parts, strict=True))
        del parts
        order = np.lexsort((lo, chunk, doc, whole, trigger))
        first = _first_flags(trigger[order], whole[order])
        again, keep = order[~first], order[first]
        group = np.cumsum(_first_flags(trigger[keep])) - 1
        members = np.bincount(group)[group] if len(group) else group
        ask, is_hot = keep[members > 1], (members > hot)[members > 1]
        told = dict(_by_chunk(chunk[again]))
        asked = dict(_by_chunk(chunk[ask]))
        for c in sorted({*told, *asked}):
            m, k = again[told.get(c, np.zeros(0, int))], ask[asked.get(c, np.zeros(0, int))]
            row = {"lo": lo[m], "many": many[m].astype("<u4") + np.uint32(length - 1), "trigger": trigger[k], "ask_lo": lo[k], "ask_many": many[k], "ask_at": at[k], "ask_hot": is_hot[asked.get(c, np.zeros(0, int))]}
            yield _batch([{"chunk": c} | {n: np.ascontiguousarray(v).tobytes() for n, v in row.items()}], FOUND_SCHEMA)

    return run


def _spell(length: int, buckets: int):
    """Chunks joined with the phrases asked for, to dealt rows with their bytes (of hot triggers: string by string)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            chunk = Chunk(row["rows"])
            trigger, lo, many, at, is_hot = (np.concatenate([_bytes(x, n, t) for x in row["asked"]]) for n, t in (("trigger", "<u8"), ("ask_lo", "<u4"), ("ask_many", "u1"), ("ask_at", "u1"), ("ask_hot", "?")))
            doc = chunk.ids[np.searchsorted(chunk.off, lo.astype(np.int64), "right") - 1]
            rows = []
            cold = np.flatnonzero(~is_hot)
            for b, mine in _by_bucket(trigger[cold], buckets):
                k = cold[mine]
                spelled = chunk.data[ragged_index(lo[k], many[k].astype(np.int64) + length - 1)]
                rows.append(_dealt(b, SPELLED, row["chunk"], trigger=trigger[k], doc=doc[k], lo=lo[k], many=many[k], at=at[k], data=spelled))
            heat = np.flatnonzero(is_hot)
            if len(heat):
                start = ragged_index(lo[heat], many[heat])
                which = np.repeat(heat, many[heat])
                text = _windows(chunk.data, start, length)
                key, ids = trigger[which], doc[which]
                order = np.lexsort((start, ids, text, key))
                first = _first_flags(key[order], text[order])
                late, keep = order[~first], order[first]
                if len(late):
                    rows.append(_dealt(row["chunk"] % buckets, REPEATED, row["chunk"], lo=start[late].astype("<u4"), many=np.full(len(late), length, "<u4")))
                for b, mine in _by_bucket(text[keep], buckets):
                    k = keep[mine]
                    rows.append(_dealt(b, STRINGS, row["chunk"], trigger=key[k], phrase=text[k], doc=ids[k], lo=start[k].astype("<u4")))
            if rows:
                yield _batch(rows, DEALT_SCHEMA)

    return run


def _windows(data: np.ndarray, start: np.ndarray, length: int) -> np.ndarray:
    """Hashes of the strings of `length` bytes at the given places."""
    out = np.zeros(len(start), np.uint64)
    order = np.argsort(start, kind="stable")
    at = 0
    while at < len(order):
        begin = int(start[order[at]])
        to = int(np.searchsorted(start, begin + SLICE, "left", sorter=order))
        rolling = Rolling(data[begin : begin + SLICE + length])
        mine = order[at:to]
        out[mine] = rolling.of(start[mine] - begin, start[mine] - begin + length)
        at = to
    return out


#: Bytes of the dictionary that are ranked at once; phrases with one trigger stay together.
RANKED = 4 << 20


def suffix_ranks(data: np.ndarray, length: int) -> np.ndarray:
    """The rank of the first `length` bytes from every place of `data`, equal for equal bytes; zeros follow the end."""
    n = len(data)
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    depth = min(8, length)
    key = np.zeros(n, np.uint64)
    for k in range(depth):
        key = key << np.uint64(8) | padded[k : k + n]
    rank = np.unique(key, return_inverse=True)[1]
    while depth < length:
        step = min(depth, length - depth)  # the last step overlaps
        rest = np.zeros(n, np.int64)
        rest[: n - step] = rank[step:] + 1
        rank = np.unique(rank.astype(np.int64) * (n + 1) + rest, return_inverse=True)[1]
        depth += step
    return rank


def _late(rank: np.ndarray, doc: np.ndarray, chunk: np.ndarray, lo: np.ndarray, *more: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(chunk, starts) of all strings but the first in the corpus of each rank."""
    order = np.lexsort((lo, chunk, doc, rank, *more))
    late = order[~_first_flags(*(x[order] for x in (rank, *more)))]
    for c, mine in _by_chunk(chunk[late]):
        yield c, np.unique(lo[late[mine]])


def _resolve_suffixes(length: int):
    """Dealt rows of a bucket to the strings that repeat in each chunk."""

    def ranges(found: Iterator[tuple[int, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        for c, start in found:
            opens = np.flatnonzero(np.concatenate([[True], np.diff(start) > 1]))
            many = np.diff(np.concatenate([opens, [len(start)]])) + length - 1
            yield _batch([{"chunk": c, "lo": start[opens].astype("<u4").tobytes(), "many": many.astype("<u4").tobytes()}], FOUND_SCHEMA)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        strings, spelled, data = [], [], []
        for row in _rows(batches):
            if row["kind"] == REPEATED:
                yield _batch([{"chunk": row["chunk"], "lo": row["lo"], "many": row["many"]}], FOUND_SCHEMA)
                continue
            trigger, doc, lo = _bytes(row, "trigger", "<u8"), _bytes(row, "doc", "<i8"), _bytes(row, "lo", "<u4").astype(np.int64)
            chunk = np.full(len(lo), row["chunk"])
            if row["kind"] == STRINGS:
                strings.append((_bytes(row, "phrase", "<u8"), doc, chunk, lo, trigger))
            else:
                spelled.append((trigger, doc, chunk, lo, _bytes(row, "many", "u1").astype(np.int64)))
                data.append(_bytes(row, "data", "u1"))
        if strings:
            yield from ranges(_late(*(np.concatenate(x) for x in zip(*strings, strict=True))))
        if not spelled:
            return
        trigger, doc, chunk, lo, many = (np.concatenate(x) for x in zip(*spelled, strict=True))
        data = np.concatenate(data)
        del strings, spelled
        size = many + length - 1
        begin = np.cumsum(size) - size
        for _, part in _by_bucket(trigger, -(-len(data) // RANKED)):
            rank = suffix_ranks(data[ragged_index(begin[part], size[part])], length)
            starts = ragged_index(np.cumsum(size[part]) - size[part], many[part])
            which, step = np.repeat(part, many[part]), ragged_index(np.zeros(len(part), np.int64), many[part])
            yield from ranges(_late(rank[starts], doc[which], chunk[which], lo[which] + step))

    return run


def repeated_ranges(docs: DataFrame, length: int = 100, gram: int = 36, chunk_bytes: int = 2 << 20, hot: int = 2000) -> tuple[DataFrame, DataFrame]:
    """The chunks of `docs`, and (chunk, lo, many) of byte ranges there that repeat something earlier.

    Starts and triggers within a phrase are bytes in what is dealt, so length - gram is at most 254.
    """
    if not 0 < gram <= length or length - gram > 254:
        raise ValueError("0 < gram <= length <= gram + 254")
    chunks = write_chunks(docs, chunk_bytes)
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    buckets = 2 * n
    dealt = chunks.mapInArrow(_deal_phrases(length, gram, buckets), DEALT).repartitionById(buckets, F.col("bucket"))
    found = stash(dealt.mapInArrow(_resolve_phrases(length, hot), FOUND), "phrases")
    asked = found.where(F.length("trigger") > 0).select("chunk", F.struct("trigger", "ask_lo", "ask_many", "ask_at", "ask_hot").alias("q"))
    asked = asked.groupBy("chunk").agg(F.collect_list("q").alias("asked"))
    spelled = chunks.join(asked, "chunk").select("chunk", "rows", "asked").mapInArrow(_spell(length, buckets), DEALT)
    late = stash(spelled.repartitionById(buckets, F.col("bucket")).mapInArrow(_resolve_suffixes(length), FOUND), "suffixes")
    told = found.where(F.length("lo") > 0).unionByName(late).select("chunk", F.struct("lo", "many").alias("m"))
    return chunks, told.groupBy("chunk").agg(F.collect_list("m").alias("marks"))


def removed_mask(marks: list[dict] | None, n: int) -> np.ndarray:
    """Which of a chunk's n bytes are covered by ranges."""
    edge = np.zeros(n + 1, np.int64)
    for m in marks or []:
        lo, many = _bytes(m, "lo", "<u4").astype(np.int64), _bytes(m, "many", "<u4")
        np.add.at(edge, lo, 1)
        np.add.at(edge, lo + many, -1)
    return np.cumsum(edge[:-1]) > 0


def repeat_digest(docs: DataFrame, length: int = 100, **options) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of every row of `docs` (`doc_id`, `text`).

    A byte is removed if a string of `length` bytes over it also starts earlier: in a smaller doc_id, or
    earlier in the same document. Null text is empty; a null doc_id comes before all others; of rows
    that share a doc_id, the one read first is the earlier. An empty table gives no rows; extra columns
    are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            chunk = Chunk(row["rows"])
            gone = removed_mask(row["marks"], len(chunk.data))
            opens = gone.copy()
            opens[1:] &= ~gone[:-1]
            starts = chunk.off[:-1][np.diff(chunk.off) > 0]
            opens[starts] = gone[starts]
            count = lambda flags: np.diff(np.concatenate([[0], np.cumsum(flags)])[chunk.off])  # noqa: B023,E731
            sums = [hashlib.sha256(chunk.data[a:b][~gone[a:b]].tobytes()).hexdigest() for a, b in zip(chunk.off[:-1].tolist(), chunk.off[1:].tolist(), strict=True)]
            ids = chunk.rows.column(chunk.rows.schema.get_field_index("doc_id"))
            yield pa.RecordBatch.from_arrays([ids.cast(pa.int64()), pa.array(np.diff(chunk.off), pa.int64()), pa.array(count(gone), pa.int64()), pa.array(count(opens), pa.int64()), pa.array(sums)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    chunks, marks = repeated_ranges(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), length, **options)
    return chunks.join(marks, "chunk", "left").select("rows", "marks").mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def remove_repeats(docs: DataFrame, length: int = 100, **options) -> DataFrame:
    """`docs` (`doc_id`, `text`, other columns) with repeated bytes cut out of the texts.

    A code point of which some bytes are removed goes whole. Null texts stay null; other columns, and
    columns named like this operator's own (`chunk`, `rows`, `marks`), stay as they are. Of equal rows
    the one read first stays whole, the others lose their text. An empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            chunk = Chunk(row["rows"])
            keep = ~removed_mask(row["marks"], len(chunk.data))
            at = chunk.rows.schema.get_field_index("text")
            null = chunk.rows.column(at).is_null().to_pylist()
            new = [None if none else chunk.data[a:b][keep[a:b]].tobytes().decode("utf-8", "ignore") for none, a, b in zip(null, chunk.off[:-1].tolist(), chunk.off[1:].tolist(), strict=True)]
            yield chunk.rows.set_column(at, chunk.rows.schema.field(at), pa.array(new, chunk.rows.schema.field(at).type))

    chunks, marks = repeated_ranges(docs, length, **options)
    return chunks.join(marks, "chunk", "left").select("rows", "marks").mapInArrow(run, docs.schema)
