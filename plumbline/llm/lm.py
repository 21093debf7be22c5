"""Operator 7: language-model scores of whole texts.

Two scores come of the training documents (those whose crc32 of the doc_id's digits is not divisible
by ten): a base score from word counts, and the log-probability under a causal self-attention model of
subword ids.

Word counts. A task counts the distinct words of a slice of text and sends a hash of each, with its
count, to the word's bucket; buckets add up and answer each slice with its words' counts, in the order
asked. A slice's words travel once and nothing grows with the number of documents that hold a word.

Model. Subwords fall into classes: frequent ids alone, the others by equal shares of the corpus. A
token's probability is its class's in context times its share of the class after the id before it, from
counts of all training tokens (pairs of frequent ids, a table of the model's size). The class comes from a layer of self-attention over the preceding ids: embeddings are the
leading directions of the table of next classes (counted over all training tokens), whose logarithms
also enter the logits directly, and attention, learned by gradient steps in numpy, corrects them. Every
task trains on its own share from the same start, and parameters are averaged by Spark. Long texts are
scored in overlapping windows: the first half is context only, so each token is scored once.
"""
from __future__ import annotations

import copy
import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.arrays import gathered, give_back, small_batches, text_column
from plumbline.llm.tokens import WORDS_KEPT, SubwordEncoder, split_chunks, with_end
from plumbline.operators.stash import stash, stash_bucketed

#: Scores and logits stay within bounds that a float's exponential can take.
BOUND = np.float32(30.0)


@dataclass(frozen=True)
class Shape:
    """Sizes of the model; all are parameters, none follows the corpus."""

    classes: int = 32
    alone: int = 20
    rows: int = 2048
    width: int = 16
    stride: int = 16
    train_every: int = 1
    batch: int = 256
    rate: float = 0.01
    prior: float = 3.0
    smooth: float = 4.0


def is_held_out(doc_id: int | None) -> bool:
    """A null doc_id counts as having no digits."""
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 10 == 0


PARTS = "slice long, bucket int, hashes binary, counts binary"


def _slice_docs(tokenizer: str, end_id: int, slice_bytes: int, buckets: int):
    """Documents to a row a slice: ids, word places, the slice's distinct words by bucket and hash, and counts of the training documents' ids with the number of these documents."""
    kinds = pa.schema([("slice", pa.int64()), *((c.split()[0], pa.binary()) for c in SLICE_ROW.split(", ")[1:])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part = SubwordEncoder.of(tokenizer, most=WORDS_KEPT), TaskContext.get().partitionId()
        for k, batch in enumerate(gathered(batches, "text", slice_bytes)):
            texts = text_column(batch, "text")
            chunks, bounds = split_chunks(texts)
            coded = pc.ascii_lower(chunks.dictionary).dictionary_encode()  # each distinct chunk is lower-cased once
            which = np.asarray(coded.indices)[np.asarray(chunks.indices)]
            lowered = pa.DictionaryArray.from_arrays(pa.array(which), coded.dictionary)
            ids, off = with_end(*encoder.encode_chunks(lowered, bounds), end_id)
            keys = batch.column(0).to_pylist()
            held = np.fromiter(map(is_held_out, keys), bool, len(keys))
            full = np.asarray(pc.greater(pc.binary_length(coded.dictionary), 0))[which]  # words: chunks that are not empty
            bounds = np.concatenate([[0], np.cumsum(full)])[bounds]
            place = which[full].astype(np.int64)
            digests = b"".join(map(xxhash.xxh3_128_digest, coded.dictionary.cast(pa.large_binary()).to_pylist()))
            pairs = np.frombuffer(digests, "<u8").reshape(-1, 2)
            bucket = (pairs[:, 1] % np.uint64(buckets)).astype(np.int64)
            order = np.lexsort((pairs[:, 0], bucket))
            new = np.empty(len(order), np.int64)
            new[order] = np.arange(len(order))
            place = new[place]
            counts = np.bincount(place, np.repeat(~held, np.diff(bounds)), len(order))
            seen = np.append(np.bincount(ids[np.repeat(~held, np.diff(off))], minlength=encoder.size), np.count_nonzero(~held))
            row = [
                (part << 32) | k, np.array([-1 if i is None else i for i in keys], "<i8"), ids.astype("<u4" if encoder.size > 1 << 16 else "<u2"), off.astype("<i8"), held,
                np.array([i is None for i in keys], bool), place.astype("<u4"), np.diff(bounds).astype("<i8"), pairs[order, 0], counts.astype("<u4"), bucket[order].astype("<u4"),
                np.frombuffer(zlib.compress(seen.astype("<i8").tobytes(), 1), np.uint8),
            ]
            out = pa.RecordBatch.from_arrays([pa.array([row[0]], pa.int64()), *(pa.array([np.ascontiguousarray(v).tobytes()], pa.binary()) for v in row[1:])], schema=kinds)
            del batch, texts, chunks, coded, lowered, which, place, ids, order, new, pairs, row
            give_back()
            yield out

    return run


SLICE_ROW = "slice long, doc_ids binary, ids binary, bounds binary, held_out binary, no_id binary, words binary, n_words binary, hashes binary, counts binary, buckets binary, unigrams binary"


def _array(row: dict, name: str, dtype: str) -> np.ndarray:
    return np.frombuffer(row[name] or b"", dtype)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """Rows one at a time: a row is a slice of the corpus, and no two are needed together."""
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.slice(i, 1).to_pylist()[0]
    give_back()


def _deal_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for row in _rows(batches):
        bucket, hashes, counts = _array(row, "buckets", "<u4"), _array(row, "hashes", "<u8"), _array(row, "counts", "<u4")
        used, at = np.unique(bucket, return_index=True)
        ends = np.append(at, len(bucket))[1:]
        out = [(row["slice"], int(b), hashes[s:e].tobytes(), counts[s:e].tobytes()) for b, s, e in zip(used, at, ends, strict=False)]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int32(), pa.binary(), pa.binary()), strict=True)], names=["slice", "bucket", "hashes", "counts"])


ANSWER = "slice long, bucket int, total binary, n long, v long"


def _add_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of a bucket to each slice's answer; the bucket's own totals go with one of them."""
    asked: dict[int, list[tuple[int, np.ndarray, np.ndarray]]] = {}
    for batch in batches:
        for row in batch.to_pylist():
            asked.setdefault(row["bucket"], []).append((row["slice"], _array(row, "hashes", "<u8"), _array(row, "counts", "<u4")))
    for bucket, rows in asked.items():
        hashes = np.concatenate([h for _, h, _ in rows])
        known, inverse = np.unique(hashes, return_inverse=True)
        total = np.bincount(inverse, np.concatenate([c for _, _, c in rows]), len(known)).astype("<i8")
        at = 0
        for k, (number, h, _) in enumerate(rows):
            answer = total[inverse[at : at + len(h)]]
            at += len(h)
            yield pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([bucket], pa.int32()), pa.array([zlib.compress(answer.tobytes(), 1)], pa.binary()), pa.array([0 if k else int(total.sum())], pa.int64()), pa.array([0 if k else int((total > 0).sum())], pa.int64())], names=["slice", "bucket", "total", "n", "v"])


class Model:
    """Class map, counts and attention parameters; `score` gives log-probabilities of id sequences."""

    def __init__(self, counts: np.ndarray, shape: Shape):
        self.shape = shape
        order = np.argsort(-counts, kind="stable")
        share = np.cumsum(counts[order][shape.alone :]) / max(1, counts[order][shape.alone :].sum())
        rest = shape.classes - shape.alone
        self.class_of = np.empty(len(counts), np.int64)
        self.class_of[order] = np.concatenate([np.arange(shape.alone), shape.alone + np.minimum((share * rest).astype(int), rest - 1)])[: len(counts)]
        mass = np.bincount(self.class_of, counts + 0.1, shape.classes)
        #: Each id's share of its class.
        self.share = (counts + 0.1) / mass[self.class_of]
        #: Row of the embedding table: frequent ids have their own, the others their class's, the start its own.
        self.row_of = shape.rows + self.class_of
        self.row_of[order[: shape.rows]] = np.arange(min(shape.rows, len(order)))
        self.frequent_class = np.full(shape.rows, -1)
        self.frequent_class[: len(order)] = self.class_of[order[: shape.rows]]
        self.start = shape.rows + shape.classes
        self.n_rows = self.start + 1

    def start_from(self, follows: np.ndarray) -> None:
        """Embeddings, direct logits and shares from the counts of (row, next class) and (row, next frequent id)."""
        s = self.shape
        follows, pairs = follows[: self.n_rows * s.classes].reshape(-1, s.classes), follows[self.n_rows * s.classes :].reshape(self.n_rows, s.rows)
        self.pairs = pairs.astype(np.float32)
        self.pairs_of_class = np.zeros((self.n_rows, s.classes), np.float32)
        for c in range(s.classes):
            self.pairs_of_class[:, c] = pairs[:, np.flatnonzero(self.frequent_class == c)].sum(1)
        prior = (follows.sum(0) + 0.5) / (follows.sum() + 0.5 * s.classes)
        table = np.log((follows + s.smooth * prior) / (follows.sum(1, keepdims=True) + s.smooth))
        self.direct = table.astype(np.float32)
        lift = table - np.log(prior)
        weight = np.sqrt(follows.sum(1, keepdims=True) + 1)
        _, _, right = np.linalg.svd(lift * weight, full_matrices=False)
        e = lift @ right[: s.width].T
        self.embedding = (e / max(1e-6, e.std())).astype(np.float32)
        rng = np.random.default_rng(12011)
        w = lambda a, b, scale: (rng.standard_normal((a, b)) * scale).astype(np.float32)
        self.parameters = {"q": w(s.width, s.width, 0.25), "k": w(s.width, s.width, 0.25), "v": w(s.width, s.width, 0.25), "o": np.zeros((s.width, s.classes), np.float32), "p": np.zeros(2 * s.stride, np.float32)}

    def inputs(self, ids: np.ndarray, off: np.ndarray) -> np.ndarray:
        """The embedding row that precedes each token."""
        rows = np.empty(len(ids), np.int64)
        rows[1:] = self.row_of[ids[:-1]]
        rows[off[:-1][np.diff(off) > 0]] = self.start
        return rows

    def windows(self, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first scored token, whether it opens its document, tokens scored) of every window."""
        n, s = np.diff(off), self.shape.stride
        many = -(-n // s)
        step = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        first = np.repeat(off[:-1], many) + step * s
        return first, step == 0, np.minimum(s, np.repeat(off[1:], many) - first)

    def _forward(self, rows: np.ndarray, first: np.ndarray, opens: np.ndarray, asks: np.ndarray):
        """Keys and values are products of the embeddings, so their matrices are applied once a query, not once a key."""
        s = self.shape.stride
        index = np.clip(first[:, None] + np.arange(-s, s), 0, len(rows) - 1)
        near = rows.take(index)
        en = self.embedding.take(near, 0)
        distance = np.arange(s)[:, None] + s - np.arange(2 * s)  # query - key
        bias = np.exp(np.clip(self.parameters["p"], -BOUND, BOUND))[np.clip(distance, 0, 2 * s - 1)] * (distance >= 0)
        a = asks.take(near[:, s:], 0) @ en.transpose(0, 2, 1)
        np.clip(a, -BOUND, BOUND, out=a)
        np.exp(a, out=a)
        a *= bias.astype(np.float32)
        a[opens, :, :s] = 0  # a document's first window has no context
        a /= a @ np.ones((2 * s, 1), np.float32)
        z = (a @ en).reshape(-1, en.shape[2])
        h = z @ self.parameters["v"]
        logits = h @ self.parameters["o"]
        logits += self.direct.take(near[:, s:].reshape(-1), 0)
        np.clip(logits, -2 * BOUND, 2 * BOUND, out=logits)
        return en, distance, a, z, h, logits.reshape(len(near), s, -1)

    def _tables(self) -> np.ndarray:
        """What each row asks of the embeddings before a token: its query, taken through the keys' matrix."""
        p = self.parameters
        return self.embedding @ (p["q"] @ p["k"].T / np.float32(math.sqrt(self.shape.width)))

    def score(self, ids: np.ndarray, off: np.ndarray, at_once: int = 512, most: int = 1 << 20) -> np.ndarray:
        """Natural log-probability of each document's ids (an end id included), some documents at a time."""
        out, a = [np.zeros(0)], 0
        while a < len(off) - 1:
            b = max(a + 1, int(np.searchsorted(off, off[a] + most, "right")) - 1)
            out.append(self._score(ids[off[a] : off[b]].astype(np.int64), off[a : b + 1] - off[a], at_once))
            a = b
        return np.concatenate(out)

    def _score(self, ids: np.ndarray, off: np.ndarray, at_once: int) -> np.ndarray:
        rows, target = self.inputs(ids, off), self.class_of[ids]
        first, opens, many = self.windows(off)
        each, asks, s = np.zeros(len(ids)), self._tables(), self.shape.stride
        for at in range(0, len(first), at_once):
            f, m = first[at : at + at_once], many[at : at + at_once]
            logits = self._forward(rows, f, opens[at : at + at_once], asks)[-1]
            place = np.minimum(f[:, None] + np.arange(s), len(ids) - 1)
            chosen = np.take_along_axis(logits, target[place][:, :, None], 2)[:, :, 0]
            np.exp(logits, out=logits)
            logp = chosen - np.log(logits @ np.ones(logits.shape[2], np.float32))
            real = np.arange(s) < m[:, None]
            each[place[real]] = logp[real]
        row, slot = rows, self.row_of[ids]
        seen = np.where(slot < self.shape.rows, self.pairs[row, np.minimum(slot, self.shape.rows - 1)], 0)
        each += np.log((seen + self.shape.prior * self.share[ids]) / (self.pairs_of_class[row, target] + self.shape.prior))
        return np.diff(np.concatenate([[0.0], np.cumsum(each)])[off])

    def gradients(self, rows: np.ndarray, target: np.ndarray, first: np.ndarray, opens: np.ndarray, many: np.ndarray) -> dict[str, np.ndarray]:
        """Mean gradients of the windows' negative log-likelihood of classes."""
        s, p = self.shape.stride, self.parameters
        en, distance, a, z, h, logits = self._forward(rows, first, opens, self._tables())
        g = np.exp(logits, out=logits).reshape(-1, logits.shape[2])
        place = np.minimum(first[:, None] + np.arange(s), len(target) - 1)
        weight = ((np.arange(s) < many[:, None]) / np.float32(many.sum())).reshape(-1, 1)
        g *= weight / (g @ np.ones((g.shape[1], 1), np.float32))
        g.reshape(-1)[np.arange(place.size) * g.shape[1] + target[place].reshape(-1)] -= weight[:, 0]
        gh = g @ p["o"].T
        gs = (gh @ p["v"].T).reshape(len(en), s, -1) @ en.transpose(0, 2, 1)
        gs -= ((gh * h) @ np.ones((h.shape[1], 1), np.float32)).reshape(len(en), s, 1)  # h is the weighted sum of the values
        gs *= a
        y = (gs @ en).reshape(-1, en.shape[2])
        eq = en[:, s:].reshape(y.shape)
        root = np.float32(math.sqrt(self.shape.width))
        both = eq.T @ y
        return {
            "q": both @ p["k"] / root,
            "k": both.T @ p["q"] / root,
            "v": z.T @ gh,
            "o": h.T @ g,
            "p": np.bincount(np.clip(distance, 0, None).reshape(-1), (gs.sum(0) * (distance >= 0)).reshape(-1), 2 * s).astype(np.float32),
        }

    def train(self, ids: np.ndarray, off: np.ndarray, moments: dict[str, list], phase: int) -> int:
        """Adam steps over one window in `train_every` of these documents; the number of windows used."""
        s = self.shape
        ids = ids.astype(np.int64)
        rows, target = self.inputs(ids, off), self.class_of[ids]
        first, opens, many = self.windows(off)
        chosen = np.flatnonzero(np.arange(len(first)) % s.train_every == phase % s.train_every)
        chosen = np.random.default_rng(phase).permutation(chosen)
        for at in range(0, len(chosen), s.batch):
            c = chosen[at : at + s.batch]
            moments["n"] = moments.get("n", 0) + 1
            n = moments["n"]
            for name, g in self.gradients(rows, target, first[c], opens[c], many[c]).items():
                m = moments.setdefault(name, [np.zeros_like(g), np.zeros_like(g)])
                m[0] = 0.9 * m[0] + 0.1 * g
                m[1] = 0.99 * m[1] + 0.01 * g * g
                self.parameters[name] = self.parameters[name] - np.float32(s.rate / math.sqrt(1 + n / 100)) * (m[0] / (1 - 0.9**n)) / (np.sqrt(m[1] / (1 - 0.99**n)) + 1e-8)
                self.parameters[name] = self.parameters[name].astype(np.float32)
        return len(chosen)

    def flat(self) -> np.ndarray:
        return np.concatenate([self.parameters[k].reshape(-1) for k in sorted(self.parameters)]).astype(np.float64)

    def set_flat(self, x: np.ndarray) -> None:
        at = 0
        for k in sorted(self.parameters):
            n = self.parameters[k].size
            self.parameters[k] = x[at : at + n].reshape(self.parameters[k].shape).astype(np.float32)
            at += n


def _training_docs(row: dict, id_type: str) -> tuple[np.ndarray, np.ndarray]:
    """The ids of a slice's training documents, and their offsets."""
    ids, off, held = _array(row, "ids", id_type), _array(row, "bounds", "<i8"), _array(row, "held_out", "?")
    keep = np.repeat(~held, np.diff(off))
    return ids[keep], np.concatenate([[0], np.cumsum(np.diff(off)[~held])])


#: Cells of a table that travel and are added up as one blob.
BLOCK = 1 << 14


def _summed(cells: np.ndarray) -> Iterator[pa.RecordBatch]:
    """A task's table as its blocks that are not all zero, compressed."""
    for at in range(0, len(cells), BLOCK):
        part = cells[at : at + BLOCK]
        if part.any():
            kind = "<f8" if part.dtype.kind == "f" else np.min_scalar_type(part.max()).newbyteorder("<").str  # the narrowest that holds it
            blob = zlib.compress(part.astype(kind).tobytes(), 1)
            yield pa.RecordBatch.from_arrays([pa.array([at // BLOCK], pa.int32()), pa.array([kind]), pa.array([blob], pa.binary())], names=["block", "kind", "cells"])


BLOBS = "block int, kind string, cells binary"


def _add_blobs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blobs sorted by block and kind to one blob a block; one block's sum is held at a time."""
    now, total = None, None
    for batch in batches:
        for row in batch.to_pylist():
            part = np.frombuffer(zlib.decompress(row["cells"]), row["kind"])
            if row["block"] != now:
                if now is not None:
                    yield _blob(now, total)
                now, total = row["block"], np.zeros(len(part))
            total += part
    if now is not None:
        yield _blob(now, total)


def _blob(block: int, total: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array(["<f8"]), pa.array([zlib.compress(total.tobytes(), 1)], pa.binary())], names=["block", "kind", "cells"])


def _gather(sliced: DataFrame, run, size: int, columns: tuple[str, ...] = ("ids", "bounds", "held_out", "slice")) -> np.ndarray:
    """Sums over all slices of a table of `size` cells: tasks add up their own, buckets those of all tasks.

    What travels is a blob a task and block, and the driver gets the table's blocks, once each.
    """
    n = int(sliced.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = sliced.select(*columns).coalesce(n).mapInArrow(run, BLOBS)  # a task emits a whole table, so there are no more tasks than partitions
    added = found.repartition("block").sortWithinPartitions("block").mapInArrow(_add_blobs, BLOBS)
    out = np.zeros(size)
    for row in added.collect():  # the table's blocks, whose size the model's shape sets
        part = np.frombuffer(zlib.decompress(row.cells), row.kind)
        out[row.block * BLOCK : row.block * BLOCK + len(part)] = part
    return out


def fit(sliced: DataFrame, vocabulary: int, id_type: str, shape: Shape) -> tuple[Model, int]:
    """The model of all training documents in a sliced table, and their number; tables on the driver have the model's size."""

    def unigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.zeros(vocabulary + 1, np.int64)
        for row in _rows(batches):
            cells += np.frombuffer(zlib.decompress(row["unigrams"]), "<i8")
        yield from _summed(cells)

    seen = _gather(sliced, unigrams, vocabulary + 1, ("unigrams",))
    model = Model(seen[:-1], shape)

    def follows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes, pairs = np.zeros(model.n_rows * shape.classes, np.int64), np.zeros(model.n_rows * shape.rows, np.int64)
        for row in _rows(batches):
            ids, off = _training_docs(row, id_type)
            if len(ids):
                before, slot = model.inputs(ids, off), model.row_of[ids]
                classes += np.bincount(before * shape.classes + model.class_of[ids], minlength=len(classes))
                often = slot < shape.rows
                pairs += np.bincount(before[often] * shape.rows + slot[often], minlength=len(pairs))
        yield from _summed(np.concatenate([classes, pairs]))

    model.start_from(_gather(sliced, follows, model.n_rows * (shape.classes + shape.rows)))

    learner = copy.copy(model)  # travels to every task without the tables that only scores need
    learner.pairs = learner.pairs_of_class = learner.share = None

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        moments, used, start = {}, 0, learner.flat()
        for row in _rows(batches):
            ids, off = _training_docs(row, id_type)
            if len(ids):
                used += learner.train(ids, off, moments, row["slice"] & 0xFFFF)
        cells = np.concatenate([learner.flat() * used, [used]])
        learner.set_flat(start)
        yield from _summed(cells)

    size = len(model.flat())
    sums = _gather(sliced, train, size + 1)
    if sums[-1]:
        model.set_flat(sums[:-1] / sums[-1])
    return model, int(seen[-1])


def score_texts(docs: DataFrame, tokenizer: str, end_id: int = 49407, shape: Shape | None = None, slice_bytes: int = 16 << 20) -> DataFrame:
    """Base and model scores of every whole text of `docs` (`doc_id`, `text`; null: empty), a row per row.

    Returns doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score; scores are base-10 log
    probabilities, the base one of words and an end, the model's of subword ids and an end. Words are
    told apart by hash (64 bits within a bucket that other bits of a 128-bit hash choose). With nothing
    to learn from, every unseen token counts by the smoothing alone. Equal texts get equal scores in one
    run. `score` depends on how the table is cut into tasks, as each trains on its share and parameters
    are averaged; all other columns do not. An empty table gives no rows; extra columns are ignored.
    """
    shape, spark = shape or Shape(), docs.sparkSession
    small_batches(spark)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    size = SubwordEncoder.of(tokenizer).size
    id_type = "<u4" if size > 1 << 16 else "<u2"
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_slice_docs(tokenizer, end_id, slice_bytes, n), SLICE_ROW)
    sliced = stash_bucketed(rows, "slices", "slice", n)
    dealt = sliced.select("slice", "hashes", "counts", "buckets").mapInArrow(_deal_words, PARTS).repartitionById(n, F.col("bucket"))
    answers = stash(dealt.mapInArrow(_add_words, ANSWER), "word-counts")
    total = answers.agg(F.sum("n").alias("n"), F.sum("v").alias("v")).first()
    fitted, ends = fit(sliced, size, id_type, shape)
    model = spark.sparkContext.broadcast(fitted)
    tokens, distinct = int(total.n or 0) + ends, int(total.v or 0) + bool(ends)
    log = lambda c: np.log10((c + 0.1) / (tokens + 0.1 * (distinct + 1)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        SubwordEncoder.forget()
        for row in _rows(batches):
            answers = sorted(row["answers"] or [], key=lambda a: a["bucket"])
            count = np.concatenate([np.frombuffer(zlib.decompress(a["total"]), "<i8") for a in answers] or [np.zeros(0, np.int64)])
            place, many = _array(row, "words", "<u4"), _array(row, "n_words", "<i8")
            off = np.concatenate([[0], np.cumsum(many)])
            sums = lambda x: np.diff(np.concatenate([[0], np.cumsum(x[place])])[off])  # noqa: B023,E731
            held, none = _array(row, "held_out", "?"), _array(row, "no_id", "?")
            score = model.value.score(_array(row, "ids", id_type), _array(row, "bounds", "<i8"))
            columns = [
                pa.array(_array(row, "doc_ids", "<i8"), pa.int64(), mask=none), pa.array(held), pa.array(many + 1, pa.int64()), pa.array(sums((count > 0).astype(np.int64)) + bool(ends), pa.int64()),
                pa.array(np.full(len(held), tokens), pa.int64()), pa.array(sums(log(count)) + log(ends)), pa.array(score / math.log(10)),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    grouped = answers.groupBy("slice").agg(F.collect_list(F.struct("bucket", "total")).alias("answers"))
    joined = sliced.select("slice", "doc_ids", "ids", "bounds", "held_out", "no_id", "words", "n_words").join(grouped, "slice", "left")
    return joined.drop("slice").mapInArrow(run, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
