"""Operator 11: phrases whose words belong together, by vertically partitioned suffix trees of words.

Counts of all phrases up to `longest` words are node totals of the suffix tree of the word sequence, cut
off at that depth. It never stands in one place. As in ERA, word prefixes are grouped by a budget of
memory: the occurrences of a prefix are known before its subtree is built, prefixes are put into groups
of about `budget` suffixes, and a prefix that is more frequent than that is extended by one more word
(round by round, up to the full depth, where a count is all there is). Each group's subtree is then
built by itself from sorted suffixes; leaves carry totals, and a node's count is the sum over its leaves.

* Texts are encoded once, in slices of one language. A slice asks for the ids of its distinct words and
  the answer names only words of at least `least` occurrences, as no other can be part of a candidate;
  any other ends the suffixes before it, as the end of a piece does.
* A slice's equal suffixes travel as one with a count, in blobs, a blob a slice and group.
* Scores, phrases inside longer ones and ranks are joins and aggregates over the nodes that are frequent
  enough.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from plumbline.llm.arrays import LOWER, byte_set, gathered, give_back, small_batches, string_bytes, text_column, word_codes
from plumbline.operators.stash import stash, stash_bucketed

DEPTH = 4
ENDS = np.zeros(256, bool)
ENDS[list(b".,;:!?\n\x0b\x0c\r")] = True
INSIDE = byte_set(b" \t.,;:!?\n\x0b\x0c\r")
SALTS = 64
WORDS = [f"w{k}" for k in range(1, DEPTH + 1)]
#: Stands for "no word" in the columns w1 to w4.
NONE = -1


def encoded_texts(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(distinct words, codes of all words, which words open a piece) of texts, A-Z in lower case."""
    data, off = string_bytes(texts)
    words, codes, begin, counts = word_codes(LOWER[data], off, INSIDE)
    ends = np.cumsum(ENDS[data], dtype=np.int64)[begin] if len(begin) else np.zeros(0, np.int64)
    opens = np.ones(len(begin), bool)
    opens[1:] = ends[1:] != ends[:-1]
    first = np.cumsum(counts) - counts
    opens[first[counts > 0]] = True
    return words, codes, opens


SLICE = "slice long, lang string, words binary, counts binary, codes binary, opens binary"


def write_slices(docs: DataFrame, slice_bytes: int) -> DataFrame:
    """`docs` (`lang`, `text`) as encoded slices of one language each, in a table that is bucketed by slice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in gathered(batches, "text", slice_bytes):
            langs = batch.column(0).dictionary_encode()
            which, texts = np.asarray(langs.indices), text_column(batch, "text")
            for k, lang in enumerate(langs.dictionary.to_pylist()):
                words, codes, opens = encoded_texts(texts.filter(pa.array(which == k)))
                if len(codes):
                    counts = np.bincount(codes, minlength=len(words))
                    blobs = (b"\n".join(words.cast(pa.large_binary()).to_pylist()), counts.astype("<i8").tobytes(), codes.astype("<i4").tobytes(), np.packbits(opens).tobytes())
                    yield pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([lang], pa.string()), *(pa.array([b], pa.binary()) for b in blobs)], names=["slice", "lang", "words", "counts", "codes", "opens"])
                    number += 1
        give_back()

    small_batches(docs.sparkSession)
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    named = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), "text")
    return stash_bucketed(named.mapInArrow(run, SLICE), "word-slices", "slice", n)


def _word_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Slices to a row a distinct word: its place in the slice's list, and its count."""
    for batch in batches:
        for slice_, lang, words, counts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            n = np.frombuffer(counts, "<i8")
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(n), slice_)), pa.array([lang], pa.string()).take(pa.array(np.zeros(len(n), np.int64))), pa.array(words.split(b"\n"), pa.binary()).cast(pa.string()), pa.array(np.arange(len(n)), pa.int32()), pa.array(n)],
                names=["slice", "lang", "word", "at", "n"],
            )


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield {name: column[i] for name, column in zip(batch.schema.names, batch.columns, strict=True)}
    give_back()


def _fields(cell: pa.Scalar | None, *names: str) -> list[np.ndarray]:
    """Fields of a cell that holds an array of structs, as arrays."""
    if cell is None or not cell.is_valid:
        return [np.zeros(0, np.int64) for _ in names]
    return [np.asarray(cell.values.field(n)).astype(np.int64) for n in names]


def tree_leaves(columns: list[np.ndarray], base: int, counts: np.ndarray | None = None) -> tuple[list[np.ndarray], np.ndarray]:
    """Distinct suffixes in lexicographic order, and their totals. A column holds codes under `base`, 0 past the end."""
    lists = None
    if base**DEPTH < 1 << 63:
        key = columns[0].astype(np.int64)
        for c in columns[1:]:
            key = key * base + c
    else:  # ranks of halves keep the order
        halves = [np.unique(a.astype(np.int64) * base + b, return_inverse=True) for a, b in (columns[:2], columns[2:])]
        lists = [h[0] for h in halves]
        key = halves[0][1].astype(np.int64) * len(lists[1]) + halves[1][1]
    if counts is None:
        key, totals = np.unique(key, return_counts=True)
    else:
        order = np.argsort(key, kind="stable")
        key = key[order]
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
        totals, key = (np.add.reduceat(counts[order], first), key[first]) if len(key) else (counts, key)
    if lists is None:
        out = []
        for _ in range(DEPTH):
            key, c = np.divmod(key, base)
            out.append(c)
        return out[::-1], totals
    a, b = lists[0][key // len(lists[1])], lists[1][key % len(lists[1])]
    return [a // base, a % base, b // base, b % base], totals


class Slice:
    """Distinct suffixes of a slice with counts, and where each goes after the rounds that were answered."""

    def __init__(self, row: dict):
        self.lang = row["lang"].as_py()
        at, ids, group, heavy = _fields(row["a0"], "at", "id", "grp", "heavy")
        order = np.argsort(ids)
        at, self.ids, group, heavy = at[order], ids[order], group[order], heavy[order]
        codes, opens = np.frombuffer(row["codes"].as_py(), "<i4"), row["opens"].as_py()
        opens = np.unpackbits(np.frombuffer(opens, np.uint8))[: len(codes)].astype(bool)
        code = np.zeros(len(row["counts"].as_py()) // 8, np.int64)
        code[at] = np.arange(1, len(at) + 1)
        word = code[codes]
        follows, columns = word > 0, [word]
        for k in range(1, DEPTH):
            follows[: len(word) - k] &= ~opens[k:] & (word[k:] > 0)
            follows[max(0, len(word) - k) :] = False
            column = np.zeros(len(word), np.int64)
            column[: len(word) - k] = np.where(follows[: len(word) - k], word[k:], 0)
            columns.append(column)
        self.columns, self.counts = tree_leaves([c[word > 0] for c in columns], len(at) + 1)
        first = self.columns[0] - 1
        self.group, self.prefix, self.root = group[first], np.where(heavy[first] > 0, self.ids[first], NONE), np.ones(len(first), np.int64)
        for r in range(1, DEPTH - 1):
            if row.get(f"a{r}") is None:
                break
            parent, child, prefix, group, heavy = _fields(row[f"a{r}"], "parent", "word", "id", "grp", "heavy")
            self._extend(r, parent, child, np.where(heavy > 0, prefix, NONE), group)

    def _extend(self, r: int, parent: np.ndarray, child: np.ndarray, prefix: np.ndarray, group: np.ndarray) -> None:
        """Suffixes under a prefix that is too frequent follow its extensions; those of too rare ones are left out."""
        open_ = np.flatnonzero(self.prefix >= 0)
        parents = np.unique(parent)
        key = np.searchsorted(parents, parent) * (len(self.ids) + 1) + np.searchsorted(self.ids, child) + 1
        order = np.argsort(key)
        word = self.columns[r][open_]
        rank = np.minimum(np.searchsorted(parents, self.prefix[open_]), max(0, len(parents) - 1))
        asked = rank * (len(self.ids) + 1) + word
        at = np.minimum(np.searchsorted(key[order], asked), max(0, len(key) - 1))
        good = np.zeros(len(open_), bool)
        if len(key):
            good = (key[order][at] == asked) & (word > 0) & (parents[rank] == self.prefix[open_])
        found = order[at[good]] if len(key) else at[:0]
        keep = np.ones(len(self.counts), bool)
        keep[open_[~good]] = False
        self.group[open_[good]], self.prefix[open_[good]], self.root[open_[good]] = group[found], prefix[found], r + 1
        self.columns = [c[keep] for c in self.columns]
        self.counts, self.group, self.prefix, self.root = self.counts[keep], self.group[keep], self.prefix[keep], self.root[keep]


def _children(r: int):
    """Slices to counts of the extensions, by one word, of prefixes of r words that are too frequent."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            s = Slice(row)
            mine = np.flatnonzero((s.prefix >= 0) & (s.columns[r] > 0))
            if len(mine):
                parents, rank = np.unique(s.prefix[mine], return_inverse=True)
                pairs, where = np.unique(rank * (len(s.ids) + 1) + s.columns[r][mine], return_inverse=True)
                n = np.bincount(where, s.counts[mine]).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), row["slice"].as_py())), pa.array(parents[pairs // (len(s.ids) + 1)]), pa.array(s.ids[pairs % (len(s.ids) + 1) - 1]), pa.array(n)], names=["slice", "parent", "word", "n"])

    return run


DEALT = "lang string, grp long, root int, leaves int, many int, blob binary"


def _deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Slices to blobs of suffixes, one a group: ids of its words, four columns of codes, counts."""
    for row in _rows(batches):
        s = Slice(row)
        order = np.argsort(s.group, kind="stable")
        order = order[s.prefix[order] < 0]
        cuts = np.flatnonzero(np.diff(s.group[order])) + 1
        out, code = [], np.zeros(len(s.ids) + 1, np.int64)
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(order)], strict=True):
            mine = order[a:b]
            if not len(mine):
                continue
            columns = [c[mine] for c in s.columns]
            used = np.zeros(len(s.ids) + 1, bool)
            for c in columns:
                used[c] = True
            used[0] = False
            words = np.flatnonzero(used)
            code[words] = np.arange(1, len(words) + 1)
            kind = "<u2" if len(words) < 1 << 16 else "<u4"
            data = b"".join([s.ids[words - 1].astype("<i8").tobytes(), *(code[c].astype(kind).tobytes() for c in columns), s.counts[mine].astype("<u4").tobytes()])
            out.append((s.lang, int(s.group[mine[0]]), int(s.root[mine[0]]), len(mine), len(words), pa.compress(data, codec="zstd", asbytes=True)))
        if out:
            types = (pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=["lang", "grp", "root", "leaves", "many", "blob"])


NODE = "lang string, w1 long, w2 long, w3 long, w4 long, depth int, f long"


def _subtree(lang: str, parts: list[tuple], least: int) -> Iterator[pa.RecordBatch]:
    """The subtree of a group, from its blobs: nodes from the group's prefixes down with at least `least` occurrences."""
    ids = np.unique(np.concatenate([p[1] for p in parts]))
    for root in sorted({p[0] for p in parts}):
        mine = [p for p in parts if p[0] == root]
        codes = [np.concatenate([[0], np.searchsorted(ids, p[1]) + 1]) for p in mine]
        columns = [np.concatenate([c[p[2][k]] for c, p in zip(codes, mine, strict=True)]) for k in range(DEPTH)]
        columns, totals = tree_leaves(columns, len(ids) + 1, np.concatenate([p[3] for p in mine]).astype(np.int64))
        new = np.zeros(len(totals), bool)
        new[0] = True
        named = np.concatenate([[NONE], ids])
        for depth in range(1, DEPTH + 1):
            c = columns[depth - 1]
            new[1:] |= c[1:] != c[:-1]
            if depth < root:
                continue
            first = np.flatnonzero(new)
            f = np.add.reduceat(totals, first)
            keep = (f >= least) & (c[first] > 0)
            at = first[keep]
            w = [pa.array(named[columns[k][at]] if k < depth else np.full(len(at), NONE)) for k in range(DEPTH)]
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), *w, pa.array(np.full(len(at), depth), pa.int32()), pa.array(f[keep])], names=["lang", *WORDS, "depth", "f"])


def _grow(least: int):
    """Blobs sorted by group to the nodes of all groups, one group at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts = None, []
        for row in _rows(batches):
            lang, group, root, leaves, many, blob = (row[c].as_py() for c in ("lang", "grp", "root", "leaves", "many", "blob"))
            if (lang, group) != now:
                if parts:
                    yield from _subtree(now[0], parts, least)
                now, parts = (lang, group), []
            kind = np.dtype("<u2" if many < 1 << 16 else "<u4")
            sizes = [8 * many, *[kind.itemsize * leaves] * DEPTH, 4 * leaves]
            data = pa.decompress(blob, decompressed_size=sum(sizes), codec="zstd", asbytes=True)
            ends = np.cumsum(sizes).tolist()
            cut = [data[a:b] for a, b in zip([0, *ends], ends, strict=False)]
            parts.append((root, np.frombuffer(cut[0], "<i8"), [np.frombuffer(c, kind) for c in cut[1 : 1 + DEPTH]], np.frombuffer(cut[-1], "<u4")))
        if parts:
            yield from _subtree(now[0], parts, least)

    return run


def _with_groups(prefixes: DataFrame, budget: int, round_: int) -> DataFrame:
    """A written table of prefixes (`lang`, `id`, `f`) with `heavy`, and for the others `grp`: runs of about `budget` suffixes."""
    part = F.shiftright("id", 33)  # the task that numbered the prefix
    light = F.when(F.col("f") <= budget, F.col("f")).otherwise(0)
    before = F.sum(light).over(W.partitionBy("lang", part).orderBy("id").rowsBetween(W.unboundedPreceding, 0))
    return prefixes.withColumn("heavy", (F.col("f") > budget).cast("int")).withColumn("grp", F.xxhash64(F.lit(round_), part, F.floor(before / budget)))


def phrase_counts(docs: DataFrame, least: int = 30, budget: int = 1 << 20, slice_bytes: int = 16 << 20) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, vocabulary, totals): counts of phrases of 1 to 4 words with at least `least` occurrences, by language.

    nodes: (lang, w1 to w4, depth, f), words by id, -1 past the phrase's end. vocabulary: (lang, word, id,
    f) of words with `least` occurrences. totals: (lang, n) of all word occurrences. `budget` is the
    number of suffixes that a group of prefixes may have, `slice_bytes` the text that a task encodes at once.
    """
    slices = write_slices(docs, slice_bytes)
    words = slices.select("slice", "lang", "words", "counts").mapInArrow(_word_rows, "slice long, lang string, word string, at int, n long")
    numbered = words.groupBy("lang", "word").agg(F.sum("n").alias("f")).where(F.col("f") >= least)
    vocabulary = stash(numbered.withColumn("id", F.monotonically_increasing_id()), "vocabulary")
    grouped = _with_groups(vocabulary, budget, 0)
    told = words.join(grouped.select("lang", "word", "id", "grp", "heavy"), ["lang", "word"])
    told = told.groupBy("slice").agg(F.collect_list(F.struct("at", "id", "grp", "heavy")).alias("a0"))
    rounds = [stash(told, "words-of-slices")]
    no_words = [F.lit(NONE).cast("long").alias(w) for w in WORDS]
    prefixes = grouped.where("heavy = 1").select("lang", F.col("id").alias("w1"), *no_words[1:], F.lit(1).alias("depth"), "f", "id")
    nodes = []
    for r in range(1, DEPTH):
        prefixes = stash(prefixes, "frequent-prefixes")
        if prefixes.isEmpty():
            break
        nodes.append(prefixes.drop("id"))
        asked = stash(_joined(slices, rounds).mapInArrow(_children(r), "slice long, parent long, word long, n long"), "extensions")
        counted = asked.groupBy("parent", "word").agg(F.sum("n").alias("f")).where(F.col("f") >= least)
        counted = counted.join(prefixes.drop("f").withColumnRenamed("id", "parent"), "parent")
        counted = counted.withColumn(WORDS[r], F.col("word")).withColumn("depth", F.lit(r + 1))
        numbered = stash(counted.withColumn("id", F.monotonically_increasing_id()), "prefixes")
        if r == DEPTH - 1:
            nodes.append(numbered.select("lang", *WORDS, "depth", "f"))
            break
        grouped = _with_groups(numbered, budget, r)
        told = asked.join(grouped.select("parent", "word", "id", "grp", "heavy"), ["parent", "word"])
        rounds.append(stash(told.groupBy("slice").agg(F.collect_list(F.struct("parent", "word", "id", "grp", "heavy")).alias(f"a{r}")), "extensions-of-slices"))
        prefixes = grouped.where("heavy = 1").select("lang", *WORDS, "depth", "f", "id")
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = _joined(slices, rounds).mapInArrow(_deal, DEALT).repartition(n, "lang", "grp").sortWithinPartitions("lang", "grp")
    found = dealt.mapInArrow(_grow(least), NODE)
    for more in nodes:
        found = found.unionByName(more)
    return stash(found, "phrases"), vocabulary, words.groupBy("lang").agg(F.sum("n").alias("n"))


def _joined(slices: DataFrame, rounds: list[DataFrame]) -> DataFrame:
    out = slices.drop("words")
    for k, told in enumerate(rounds):
        out = out.join(told, "slice", "left" if k else "inner")
    return out


def _span(first: int, last: int) -> list[Column]:
    """The phrase of words first to last (from 1), as the columns p1 to p4."""
    return [F.col(WORDS[first - 1 + k]).alias(f"p{k + 1}") if first + k <= last else F.lit(NONE).cast("long").alias(f"p{k + 1}") for k in range(DEPTH)]


def _by_depth(parts: dict[int, list[Column]]) -> Column:
    """An array of structs for each depth of the node."""
    out = None
    for depth, structs in parts.items():
        out = F.when(F.col("depth") == depth, F.array(*structs)) if out is None else out.when(F.col("depth") == depth, F.array(*structs))
    return out


def scored_phrases(nodes: DataFrame) -> DataFrame:
    """Nodes of two words or more with (a, l, r, score): of all cuts the one of the lowest score, the first of equal ones."""
    parts = {d: [F.struct(F.lit(k).alias("k"), F.lit(side).alias("side"), *_span(*span)) for k in range(1, d) for side, span in (("l", (1, k)), ("r", (k + 1, d)))] for d in range(2, DEPTH + 1)}
    asked = nodes.where("depth > 1").withColumn("part", F.explode(_by_depth(parts)))
    asked = asked.select("lang", *WORDS, "depth", F.col("f").alias("a"), "part.*")
    whole = nodes.select(*(F.col(w).alias(f"p{k + 1}") for k, w in enumerate(WORDS)), F.col("f").alias("of"))
    told = asked.join(whole, [f"p{k + 1}" for k in range(DEPTH)])
    value = lambda k, side: F.max(F.when((F.col("k") == k) & (F.col("side") == side), F.col("of")))
    grouped = told.groupBy("lang", *WORDS, "depth", "a").agg(*(value(k, side).alias(f"{side}{k}") for k in range(1, DEPTH) for side in "lr"))
    cuts = [
        F.when(F.col(f"l{k}").isNotNull(), F.struct(F.expr(f"(cast(2000000 as decimal(18,0)) * cast(a as decimal(20,0))) div (cast(l{k} as decimal(20,0)) + cast(r{k} as decimal(20,0)))").alias("score"), F.lit(k).alias("k"), F.col(f"l{k}").alias("l"), F.col(f"r{k}").alias("r")))
        for k in range(1, DEPTH)
    ]
    return grouped.withColumn("cut", F.array_min(F.array(*cuts))).select("lang", *WORDS, "depth", "a", "cut.l", "cut.r", F.col("cut.score").cast("long").alias("score"))


def _inside(nodes: DataFrame) -> DataFrame:
    """(p1 to p4, within): for phrases of two words or more that a longer phrase holds, the most occurrences of such a one."""
    parts = {d: [F.struct(*_span(i, i + size - 1)) for size in range(2, d) for i in range(1, d - size + 2)] for d in range(3, DEPTH + 1)}
    held = nodes.where("depth > 2").select("f", F.explode(_by_depth(parts)).alias("part")).select("f", "part.*")
    return held.groupBy("p1", "p2", "p3", "p4").agg(F.max("f").alias("within"))


def _first(df: DataFrame, top: int, number: Column, *order: Column, salted: bool) -> DataFrame:
    """The first `top` rows of each language; with `salted`, of each language and salt."""
    by = ["lang", "salt"] if salted else ["lang"]
    return df.withColumn("rank", number.over(W.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= top)


def collocations(docs: DataFrame, least: int = 30, top: int = 2000, **options) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's first `top` phrases of 2 to 4 words.

    Texts of `docs` (`lang`, `text`) are lower-cased (A-Z) and split into pieces at `.,;:!?` and line
    ends, and those at spaces and tabs into words. a is the number of a phrase's occurrences, overlaps
    included; phrases with fewer than `least` do not count. A cut after its first k words gives l and r,
    the occurrences of both parts, and floor(2000000 a / (l + r)); the lowest-scoring cut counts, of
    equal ones the first. Phrases inside a longer one that has 80 % of their occurrences are dropped,
    whether or not that one is. Order: score and a falling, phrase rising by its UTF-8 bytes; n is the
    language's words. A null text is empty, a null language is `und`; repeated rows count each time. An
    empty table gives no rows; extra columns are ignored.
    """
    nodes, vocabulary, totals = phrase_counts(docs, least, **options)
    exact = lambda c, by: F.col(c).cast("decimal(20,0)") * F.lit(by)
    held = _inside(nodes)
    scored = scored_phrases(nodes)
    kept = scored.join(held, [F.col(w) == F.col(f"p{k + 1}") for k, w in enumerate(WORDS)], "left").where(F.col("within").isNull() | (exact("within", 5) < exact("a", 4)))
    kept = kept.select("lang", *WORDS, "a", "l", "r", "score").withColumn("salt", F.pmod(F.xxhash64(*WORDS), F.lit(SALTS)))
    falling = (F.desc("score"), F.desc("a"))
    near = stash(_first(kept, top, F.rank(), *falling, salted=True), "near-first")
    spelled = near.select("lang", *WORDS, F.posexplode(F.array(*WORDS)).alias("at", "id")).where(F.col("id") >= 0).join(vocabulary.select("id", "word"), "id")
    spelled = spelled.groupBy("lang", *WORDS).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "word"))), lambda x: x["word"]), " ").alias("phrase"))
    named = near.join(spelled, ["lang", *WORDS])
    named = _first(named, top, F.row_number(), *falling, F.asc("phrase"), salted=True)
    named = _first(named, top, F.row_number(), *falling, F.asc("phrase"), salted=False)
    return named.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
