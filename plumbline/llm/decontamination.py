"""Operator 13: passages of test items in training texts, by a distributed positional inverted index.

The index. Training texts are cut into shards, whole documents each, of a bounded size. A shard is a row
of a table in the shared folder: its terms, and for each term its postings, the places of its words in
ascending order. Spark spreads the shards; a search meets every shard once for each block of test items.

A search. A window is a run of consecutive words of an item. Within a shard, the window's terms are
ordered by the length of their lists; a window with a term that the shard lacks is out. The rarest
term's places, less its offset in the window, are the candidate starts, and the list of the next rarest
term, less its own offset, is intersected with them, and so on to the most frequent. Neighbouring
windows mostly share their rarest term, so they go together at first: the words that all windows of such
a group hold are intersected once, and only what is left is told apart by window. All lists are one
sorted array of (term, place), so an intersection is a batch of binary searches.

A proximity search asks for a place of each term within some words of the rarest one's, in any order,
instead of the place at the term's offset.
"""
from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.arrays import LOWER, byte_set, gathered, give_back, ragged_index, small_batches, string_bytes, text_column, word_codes
from plumbline.operators.stash import stash

#: Bytes that do not belong to words: ASCII but for digits and letters.
INSIDE = byte_set(bytes(b for b in range(128) if not chr(b).isalnum()))
SHARD_BYTES = 16 << 20
BLOCK_BYTES = 4 << 20
#: Windows that are ordered at once, neighbours that go together, and candidates that are intersected at once.
WINDOWS, TOGETHER, CANDIDATES = 1 << 16, 6, 1 << 20


def text_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(distinct words, codes of all words, words per text), A-Z in lower case."""
    data, off = string_bytes(texts)
    terms, codes, _, counts = word_codes(LOWER[data], off, INSIDE)
    return terms, codes, counts


INDEX = "shard long, ids array<bigint>, counts binary, terms binary, lengths binary, gaps binary"


def build_index(docs: DataFrame, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """The positional inverted index of `docs` (`doc_id`, `text`) as a written table, a row a shard.

    A null text has no words; a null doc_id stays null; rows that share an id stay apart. An empty table
    gives no shard; extra columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        for k, batch in enumerate(gathered(batches, "text", shard_bytes)):
            terms, codes, counts = text_words(text_column(batch, "text"))
            small = codes.astype(np.uint16) if len(terms) < 1 << 16 else codes  # 16 bits are sorted by radix
            places = np.argsort(small, kind="stable").astype(np.int64)
            lengths = np.bincount(codes, minlength=len(terms))
            gaps = np.diff(places, prepend=0).astype("<i4" if len(codes) < 1 << 30 else "<i8")
            ids = batch.column(0).cast(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([(part << 32) | k], pa.int64()), pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids),
                    *(pa.array([x], pa.binary()) for x in (counts.astype("<i8").tobytes(), b"\n".join(terms.cast(pa.large_binary()).to_pylist()), lengths.astype("<i8").tobytes(), gaps.tobytes())),
                ],
                names=["shard", "ids", "counts", "terms", "lengths", "gaps"],
            )
        give_back()

    small_batches(docs.sparkSession)
    made = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, INDEX)
    return stash(made, "postings")


class Shard:
    """A shard read back: its documents' bounds, terms, and the sorted array of (term, place)."""

    def __init__(self, row: dict):
        self.number, self.ids = row["shard"], row["ids"]
        self.bounds = np.concatenate([[0], np.cumsum(np.frombuffer(row["counts"], "<i8"))])
        self.size = int(self.bounds[-1])
        self.lengths = np.frombuffer(row["lengths"], "<i8")
        self.terms = pa.array(row["terms"].split(b"\n") if len(self.lengths) else [], pa.large_binary()).cast(pa.large_string())
        gaps = np.frombuffer(row["gaps"], "<i4" if 4 * self.size == len(row["gaps"]) else "<i8")
        self.places = np.cumsum(gaps, dtype=np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.postings = np.repeat(np.arange(len(self.lengths)) * self.size, self.lengths) + self.places

    def between(self, term: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Whether the term's list has a place in [low, high]."""
        at = np.searchsorted(self.postings, term * self.size + np.maximum(low, 0))
        return (high >= low) & (at < self.size) & (self.postings[np.minimum(at, self.size - 1)] <= term * self.size + np.minimum(high, self.size - 1))

    def document(self, place: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.bounds, place, "right") - 1


@dataclass(frozen=True)
class Block:
    """Some test items: ids as strings, distinct terms, all words' codes, and the windows as (item, first word, words)."""

    ids: list[str | None]
    terms: pa.Array
    codes: np.ndarray
    firsts: np.ndarray
    item: np.ndarray
    start: np.ndarray
    size: np.ndarray

    @classmethod
    def of(cls, ids: list[str | None], texts: list[str | None], width: int) -> Block:
        terms, codes, counts = text_words(pa.array(texts, pa.large_string()).fill_null(""))
        firsts = np.cumsum(counts) - counts
        many = np.where(counts > 0, np.maximum(counts - width + 1, 1), 0)
        item = np.repeat(np.arange(len(counts)), many)
        return cls(ids, terms, codes, firsts, item, ragged_index(firsts, many), np.minimum(counts, width)[item])


def item_blocks(items: DataFrame, width: int, block_bytes: int = BLOCK_BYTES) -> Iterator[Block]:
    """The items (`item_id`, `text`) in blocks of about `block_bytes` of text, an item whole in one."""
    held = stash(items.select(F.col("item_id").cast("string").alias("item_id"), "text"), "items")
    total = held.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks = max(1, math.ceil(total / block_bytes))
    dealt = held.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)))
    for b in range(blocks):
        rows = dealt.where(F.col("block") == b).distinct().collect()  # bounded: equal rows count once
        if rows:
            yield Block.of([r.item_id for r in rows], [r.text for r in rows], width)


def _ordered(block: Block, local: np.ndarray, rank: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Words of each span [start, start + size) as places in the block's codes, rarest first; -1 past a span's end."""
    width = int(size.max())
    at = start[:, None] + np.arange(width)
    inside = np.arange(width) < size[:, None]
    freq = np.where(inside, rank[local[np.minimum(at, len(local) - 1)]], np.iinfo(np.int64).max)
    order = np.argsort(freq, axis=1, kind="stable")
    return np.where(np.take_along_axis(inside, order, 1), start[:, None] + order, -1)


def _intersect(shard: Shard, local: np.ndarray, words: np.ndarray, row: np.ndarray, anchor: np.ndarray, place: np.ndarray, near: int | None) -> np.ndarray:
    """Candidates (row of `words`, anchor word, its place) for which every word of the row has a fitting place; indices of those."""
    left = np.arange(len(row))
    first, last = (shard.bounds[shard.document(place) + k] for k in (0, 1))
    for step in range(words.shape[1]):
        word = words[row[left], step]
        asked = word >= 0
        asked &= word != anchor[left]
        i, w = left[asked], word[asked]
        low = high = place[i] + w - anchor[i]
        if near is not None:
            low, high = place[i] - near, place[i] + near
        good = np.ones(len(left), bool)
        good[asked] = shard.between(local[w], np.maximum(low, first[i]), np.minimum(high, last[i] - 1))
        left = left[good]
        if not len(left):
            break
    return left


def search(shard: Shard, block: Block, near: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(window of the block, place in the shard) of every match: where the window begins, or with `near` its rarest word."""
    if not shard.size or not len(block.start):
        return
    local = np.asarray(pc.index_in(block.terms, value_set=shard.terms).fill_null(-1)).astype(np.int64)[block.codes]
    missing = np.concatenate([[0], np.cumsum(local < 0)])
    alive = np.flatnonzero(missing[block.start + block.size] == missing[block.start])
    for at in range(0, len(alive), WINDOWS):
        mine = alive[at : at + WINDOWS]
        start, size = block.start[mine], block.size[mine]
        words = _ordered(block, local, shard.lengths, start, size)
        anchor = words[:, 0]
        # neighbouring windows with one anchor, a few at a time
        opens = np.concatenate([[True], (np.diff(anchor) != 0) | (np.diff(start) != 1) | (np.diff(block.item[mine]) != 0)])
        run = np.flatnonzero(opens)
        opens |= (np.arange(len(mine)) - np.repeat(run, np.diff(np.append(run, len(mine))))) % TOGETHER == 0
        head = np.flatnonzero(opens)
        tail = np.append(head[1:], len(mine)) - 1
        core = _ordered(block, local, shard.lengths, start[tail], start[head] + size[head] - start[tail])
        lengths = shard.lengths[local[anchor[head]]]
        cut = np.searchsorted(np.cumsum(lengths), np.arange(0, int(lengths.sum()), CANDIDATES), "left") if len(lengths) else []
        for a, b in zip(cut, [*cut[1:], len(head)], strict=True):
            if a == b:
                continue
            group = np.repeat(np.arange(a, b), lengths[a:b])
            place = shard.places[ragged_index(shard.starts[local[anchor[head[a:b]]]], lengths[a:b])]
            left = _intersect(shard, local, core, group, anchor[head[group]], place, near)
            many = (tail - head + 1)[group[left]]
            window = ragged_index(head[group[left]], many)
            place = np.repeat(place[left], many)
            left = _intersect(shard, local, words, window, anchor[window], place, near)
            window, place = window[left], place[left]
            yield mine[window], place if near is not None else place + start[window] - anchor[window]


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[Shard]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield Shard(batch.slice(i, 1).to_pylist()[0])
    give_back()


def passage_matches(docs: DataFrame, items: DataFrame, width: int = 10, near: int | None = None) -> DataFrame:
    """(doc_id, item_id, item_word, doc_word), a row a window of an item and a place where a text of `docs` has it.

    Windows are `width` consecutive words of an item, or all its words if it has fewer; item_word is
    the first one's number in the item. Exact search (`near` None): doc_word is the number of the
    window's first word in the document. Proximity search: every word of the window has an occurrence
    within `near` words of the rarest one's, in any order, and doc_word is that one's place; words that
    a window has twice need one place only, and which word is rarest is by shard. Nulls have no words;
    equal items count once; empty tables give no rows.
    """
    index, out = build_index(docs), None
    for block in item_blocks(items, width):

        def run(batches: Iterator[pa.RecordBatch], block: Block = block) -> Iterator[pa.RecordBatch]:
            for shard in _shards(batches):
                for window, place in search(shard, block, near):
                    doc = shard.document(place)
                    item = block.item[window]
                    columns = [pa.array([shard.ids[d] for d in doc], pa.int64()), pa.array([block.ids[i] for i in item], pa.string()), pa.array(block.start[window] - block.firsts[item]), pa.array(place - shard.bounds[doc])]
                    yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "item_id", "item_word", "doc_word"])

        one = index.mapInArrow(run, "doc_id long, item_id string, item_word long, doc_word long")
        out = one if out is None else out.unionByName(one)
    if out is None:
        return docs.sparkSession.createDataFrame([], "doc_id long, item_id string, item_word long, doc_word long")
    return out


HITS = "shard long, lo binary, many binary, doc binary, items array<string>"


def _hits(shard: Shard, block: Block) -> pa.RecordBatch | None:
    """What a block hits in a shard: runs of hit words, and the (document, item) pairs."""
    edge, pairs = np.zeros(shard.size + 1, np.int64), []
    for window, place in search(shard, block):
        np.add.at(edge, place, 1)
        np.add.at(edge, place + block.size[window], -1)
        pairs.append(np.unique(shard.document(place) * len(block.ids) + block.item[window]))
    if not any(map(len, pairs)):
        return None
    hit = np.concatenate([[False], np.cumsum(edge[:-1]) > 0, [False]])
    turns = np.flatnonzero(hit[1:] != hit[:-1])
    both = np.unique(np.concatenate(pairs))
    doc, item = both // len(block.ids), both % len(block.ids)
    blobs = (pa.array([x.astype("<i8").tobytes()], pa.binary()) for x in (turns[::2], turns[1::2] - turns[::2], doc))
    return pa.RecordBatch.from_arrays([pa.array([shard.number], pa.int64()), *blobs, pa.array([[block.ids[i] for i in item]], pa.list_(pa.string()))], names=["shard", "lo", "many", "doc", "items"])


def _digest(row: dict) -> pa.RecordBatch:
    counts = np.frombuffer(row["counts"], "<i8")
    bounds = np.concatenate([[0], np.cumsum(counts)])
    edge, found = np.zeros(int(bounds[-1]) + 1, np.int64), {}
    for h in row["hits"] or []:
        lo, many, doc = (np.frombuffer(h[c], "<i8") for c in ("lo", "many", "doc"))
        np.add.at(edge, lo, 1)
        np.add.at(edge, lo + many, -1)
        for d, i in zip(doc.tolist(), h["items"], strict=True):
            found.setdefault(d, set()).add(i)
    before = np.concatenate([[0], np.cumsum(np.cumsum(edge[:-1]) > 0)])
    hits = before[bounds[1:]] - before[bounds[:-1]]
    listed = [sorted(found.get(d, ()), key=lambda i: (i is not None, (i or "").encode())) for d in range(len(counts))]
    none, memo = hashlib.sha256(b"").hexdigest(), {}
    sums = [memo.setdefault(tuple(x), hashlib.sha256(",".join(i or "" for i in x).encode()).hexdigest()) if x else none for x in listed]
    return pa.RecordBatch.from_arrays(
        [pa.array(row["ids"], pa.int64()), pa.array(counts, pa.int64()), pa.array(hits, pa.int64()), pa.array([len(x) for x in listed], pa.int64()), pa.array(sums), pa.array(hits > 0)],
        names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"],
    )


def contamination(docs: DataFrame, items: DataFrame, width: int = 10, shard_bytes: int = SHARD_BYTES, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated) of every row of `docs` (`doc_id`, `text`).

    n_hit: words inside any occurrence of a window of `items` (`item_id`, `text`), as in
    `passage_matches`. n_items: ids with such windows; rows that share an id are one item, and a null id
    is one that is written as nothing. items_sha256: of those ids, sorted as strings, joined by commas.
    Nulls have no words. Without items nothing is hit; an empty table of documents gives no rows; extra
    columns are ignored.
    """
    index = build_index(docs, shard_bytes)
    found = None
    for block in item_blocks(items, width, block_bytes):

        def run(batches: Iterator[pa.RecordBatch], block: Block = block) -> Iterator[pa.RecordBatch]:
            for shard in _shards(batches):
                if (hits := _hits(shard, block)) is not None:
                    yield hits

        one = stash(index.mapInArrow(run, HITS), "hits")  # one block at a time stands in a task
        found = one if found is None else found.unionByName(one)
    slim = index.select("shard", "ids", "counts")
    if found is None:
        joined = slim.withColumn("hits", F.array().cast("array<struct<lo:binary,many:binary,doc:binary,items:array<string>>>"))
    else:
        joined = slim.join(found.groupBy("shard").agg(F.collect_list(F.struct("lo", "many", "doc", "items")).alias("hits")), "shard", "left").drop("shard")

    def run_digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                yield _digest(batch.slice(i, 1).to_pylist()[0])

    return joined.select("ids", "counts", "hits").mapInArrow(run_digest, "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean")


def keep_clean(docs: DataFrame, items: DataFrame, width: int = 10) -> DataFrame:
    """Rows of `docs` without any hit, with all their columns. A row is judged by its own text, whatever others share its id."""
    row = next(c for c in ("row", *(f"row_{k}" for k in range(len(docs.columns)))) if c not in docs.columns)
    held = stash(docs.withColumn(row, F.monotonically_increasing_id()), "decontaminated")
    hit = contamination(held.select(F.col(row).alias("doc_id"), "text"), items, width).where("contaminated").select(F.col("doc_id").alias(row))
    return held.join(hit, row, "left_anti").select(*docs.columns)
