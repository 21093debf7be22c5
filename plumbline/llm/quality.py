"""Operator 1: quality rules as a short-circuit cascade.

A rule is a condition on a few measures of a text, made over Arrow's buffers without per-word Python.
Rules are evaluated one after another, each only on the documents that all earlier ones let pass, and a
measure is made when a rule first asks for it. Their order is found on a bounded sample: how long each
measure takes there, and which rules reject which texts. The next rule is always the one that rejects
the most of what is left for the time of the measures that are not made yet, so rules that share a
measure pay for it once. A document is kept if no rule rejects it: the order changes the work and
never the verdict.
"""
from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.arrays import ragged_index, slices, small_batches, string_bytes, text_column

SYMBOLS = b"#*$%&|<>"
BULLET = r"^[ \t]*[-*•][ \t]"
ELLIPSIS = r"(\.\.\.|…)[ \t\r]*$"


class Texts:
    """The texts of a batch and what rules measure on them, each measured when first asked for.

    `spent` has the seconds that each measure took by itself, without those that it asked for.
    """

    def __init__(self, texts: pa.Array, keep: np.ndarray | None = None):
        self.texts = texts if keep is None else texts.take(pa.array(keep))
        self.spent: dict[str, float] = {}
        self._made: dict[str, np.ndarray] = {}
        self._inner = 0.0

    def __getattr__(self, name: str) -> np.ndarray:
        if name.startswith("_"):
            raise AttributeError(name)
        if name not in self._made:
            outer, self._inner, began = self._inner, 0.0, time.perf_counter()
            self._made[name] = getattr(self, f"_{name}")()
            took = time.perf_counter() - began
            self.spent[name] = took - self._inner
            self._inner = outer + took
        return self._made[name]

    def only(self, keep: np.ndarray) -> Texts:
        out = Texts(self.texts, keep)
        out._made = {k: v[keep] for k, v in self._made.items() if k not in ("words", "lines")}
        if "words" in self._made:
            values, off = self.words
            size = np.diff(off)[keep]
            out._made["words"] = values.take(pa.array(ragged_index(off[keep], size))), np.concatenate([[0], np.cumsum(size)])
        return out

    def _each(self, flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        return np.diff(np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])[offsets])

    def _words(self) -> tuple[pa.Array, np.ndarray]:
        """All non-empty words one after another, and len+1 offsets."""
        lists = pc.ascii_split_whitespace(self.texts)
        off = np.asarray(lists.offsets, dtype=np.int64)
        values = lists.values.slice(off[0], off[-1] - off[0])
        full = np.asarray(pc.greater(pc.binary_length(values), 0))
        return values.filter(pa.array(full)), np.concatenate([[0], np.cumsum(full)])[off - off[0]]

    def _n_words(self) -> np.ndarray:
        return np.diff(self.words[1])

    def _word_chars(self) -> np.ndarray:
        data, off = string_bytes(self.texts)
        table = np.ones(256, bool)
        table[[9, 10, 11, 12, 13, 32, *range(128, 192)]] = False  # white space, and bytes within a code point
        return self._each(table[data], off)

    def _n_symbols(self) -> np.ndarray:
        data, off = string_bytes(self.texts)
        table = np.zeros(256, bool)
        table[list(SYMBOLS)] = True
        return self._each(table[data], off)

    def _n_letters(self) -> np.ndarray:
        """Letters, taking every code point beyond ASCII for one."""
        data, off = string_bytes(self.texts)
        table = np.zeros(256, bool)
        table[[*range(65, 91), *range(97, 123), *range(192, 256)]] = True
        return self._each(table[data], off)

    def _bytes_in(self, wanted: list[int]) -> np.ndarray:
        data, off = string_bytes(self.texts)
        table = np.zeros(256, bool)
        table[wanted] = True
        return self._each(table[data], off)

    def _n_digits(self) -> np.ndarray:
        return self._bytes_in(list(range(48, 58)))

    def _n_upper(self) -> np.ndarray:
        return self._bytes_in(list(range(65, 91)))

    def _n_braces(self) -> np.ndarray:
        return self._bytes_in(list(b"{}"))

    def _lines(self) -> tuple[pa.Array, np.ndarray]:
        """The lines that hold a word, and the text of each."""
        lists = pc.split_pattern(self.texts, "\n")
        off = np.asarray(lists.offsets, dtype=np.int64)
        lines = lists.values.slice(off[0], off[-1] - off[0])
        row = np.repeat(np.arange(len(self.texts)), np.diff(off))
        full = pc.match_substring_regex(lines, r"[^ \t-\r]")
        return lines.filter(full), row[np.asarray(full)]

    def _lines_like(self, pattern: str) -> np.ndarray:
        lines, row = self.lines
        return np.bincount(row[np.asarray(pc.match_substring_regex(lines, pattern))], minlength=len(self.texts))

    def _n_bullet_lines(self) -> np.ndarray:
        return self._lines_like(BULLET)

    def _n_ellipsis_lines(self) -> np.ndarray:
        return self._lines_like(ELLIPSIS)

    def _n_lines(self) -> np.ndarray:
        return np.bincount(self.lines[1], minlength=len(self.texts))

    def _n_dup_lines(self) -> np.ndarray:
        lines, row = self.lines
        codes = np.asarray(lines.dictionary_encode().indices, dtype=np.int64)
        again = pd.Series(codes * len(self.texts) + row).duplicated().to_numpy()
        return np.bincount(row[again], minlength=len(self.texts))

    def _n_repeat_words(self) -> np.ndarray:
        words, off = self.words
        n = len(words)
        if n < 3:
            return np.zeros(len(self.texts), np.int64)
        row = np.repeat(np.arange(len(self.texts)), np.diff(off))
        code = np.asarray(words.dictionary_encode().indices, dtype=np.int64)
        inside = row[:-2] == row[2:]
        pair, _ = pd.factorize(code[:-2] * (code.max() + 1) + code[1:-1])
        window, _ = pd.factorize(pair.astype(np.int64) * (code.max() + 1) + code[2:])
        key, _ = pd.factorize(window.astype(np.int64) * len(self.texts) + row[:-2])
        again = inside & (np.bincount(key[inside], minlength=int(key.max()) + 1)[key] > 1)
        covered = np.zeros(n, bool)
        for k in range(3):
            covered[k : n - 2 + k] |= again
        return np.bincount(row[covered], minlength=len(self.texts))


@dataclass(frozen=True)
class Rule:
    """`rejects` gives a flag per text of a Texts; `sql` says the same over the counts."""

    name: str
    rejects: Callable[[Texts], np.ndarray]
    sql: str


def base_rules(min_words: int = 50, max_repeat_percent: int = 50) -> tuple[Rule, ...]:
    """The base conditions as rules."""
    return (
        Rule("few_words", lambda t: t.n_words < min_words, f"n_words < {min_words}"),
        Rule("repeat_words", lambda t: 100 * t.n_repeat_words > max_repeat_percent * t.n_words, f"100 * n_repeat_words > {max_repeat_percent} * n_words"),
    )


#: Junk that the base conditions leave: texts of symbols, of repeated lines, of non-words, lists, teasers, tables of numbers, code.
RULES = (
    Rule("symbols", lambda t: 100 * t.n_symbols > 20 * t.word_chars, "100 * n_symbols > 20 * word_chars"),
    Rule("dup_lines", lambda t: 2 * t.n_dup_lines > t.n_lines, "2 * n_dup_lines > n_lines"),
    Rule("long_words", lambda t: t.word_chars > 100 * t.n_words, "word_chars > 100 * n_words"),
    Rule("short_words", lambda t: t.word_chars < 2 * t.n_words, "word_chars < 2 * n_words"),
    Rule("few_letters", lambda t: 2 * t.n_letters < t.word_chars, "2 * n_letters < word_chars"),
    Rule("bullets", lambda t: 10 * t.n_bullet_lines > 9 * t.n_lines, "10 * n_bullet_lines > 9 * n_lines"),
    Rule("ellipses", lambda t: 10 * t.n_ellipsis_lines > 3 * t.n_lines, "10 * n_ellipsis_lines > 3 * n_lines"),
    Rule("digits", lambda t: 2 * t.n_digits > t.word_chars, "2 * n_digits > word_chars"),
    Rule("capitals", lambda t: 2 * t.n_upper > t.word_chars, "2 * n_upper > word_chars"),
    Rule("braces", lambda t: 20 * t.n_braces > t.word_chars, "20 * n_braces > word_chars"),
)


@dataclass(frozen=True)
class Measured:
    """What a sample says: seconds a text of each measure, the measures each rule asks for, and how many texts each set of rules rejects."""

    seconds: dict[str, float]
    needs: dict[str, frozenset[str]]
    rejected: dict[frozenset[str], int]


def measured(docs: DataFrame, rules: Sequence[Rule], sample_rows: int = 400, repeats: int = 3) -> Measured:
    """Costs and rejections of rules on a random sample of about `sample_rows` texts.

    The sample is the only thing that is bounded: it sets the order in which rules run. Its rows stay
    on the executor that measures; a row a measure, a rule and a set of rules comes to the driver.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple[str, str, float]] = []
        for batch in batches:
            texts, spent = text_column(batch, "text"), []
            for _ in range(repeats):
                all_ = Texts(texts)
                flags = np.array([rule.rejects(all_) for rule in rules])
                spent.append(all_.spent)
            out += [("seconds", m, min(s[m] for s in spent)) for m in spent[0]]
            out += [("rejected", " ".join(rules[k].name for k in np.flatnonzero(f)), 1.0) for f in flags.T]
            for rule in rules:
                one = Texts(texts)
                rule.rejects(one)
                out += [("needs", f"{rule.name} {m}", 1.0) for m in one.spent]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], names=["kind", "name", "x"])

    n = max(1, docs.count())
    rows = docs.select("text").sample(False, min(1.0, sample_rows / n), 17).repartition(1).mapInArrow(run, "kind string, name string, x double").groupBy("kind", "name").agg(F.sum("x").alias("x")).collect()
    of = {kind: {r.name: r.x for r in rows if r.kind == kind} for kind in ("seconds", "needs", "rejected")}
    texts = max(1.0, sum(of["rejected"].values()))
    needs = {r.name: frozenset(x.split()[1] for x in of["needs"] if x.split()[0] == r.name) for r in rules}
    return Measured({m: s / texts for m, s in of["seconds"].items()}, needs, {frozenset(k.split()): int(x) for k, x in of["rejected"].items()})


def cascade_order(seen: Measured, rules: Sequence[Rule], made: Sequence[str] = ()) -> list[Rule]:
    """Rules by what each rejects of the texts left, per second of the measures not yet made.

    `made` are measures that are there anyway. Rules that reject nothing come last, by cost, then by name.
    """
    done, left, order = set(made), dict(seen.rejected), []
    while len(order) < len(rules):

        def place(rule: Rule) -> tuple[float, float, str]:
            cost = sum(seen.seconds.get(m, 0.0) for m in seen.needs.get(rule.name, frozenset()) - done)  # noqa: B023
            return -sum(n for names, n in left.items() if rule.name in names) / max(cost, 1e-12), cost, rule.name  # noqa: B023

        best = min((r for r in rules if r not in order), key=place)
        order.append(best)
        done |= seen.needs.get(best.name, frozenset())
        left = {names: n for names, n in left.items() if best.name not in names}
    return order


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def quality_rules(docs: DataFrame, rules: Sequence[Rule] = RULES, min_words: int = 50, max_repeat_percent: int = 50, keep_columns: bool = False, sample_rows: int = 400, kept_only: bool = False) -> DataFrame:
    """The counts of every whole text of `docs` (`doc_id`, `text`) and whether it is kept.

    Returns doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept. With
    `keep_columns` it returns all of the input's columns and `kept`, which takes the place of one of that
    name; then the base conditions are rules of the cascade like the others, and no text is measured
    beyond its first rejection. With `kept_only` it returns the rows that are kept, with the input's
    columns alone, one named `kept` among them as it is. Null text has no words, so it fails the base conditions. A row per row:
    repeated rows are judged each. An empty table gives no rows. No shuffle: a document is judged where
    it is read.
    """
    small_batches(docs.sparkSession)
    keep_columns = keep_columns or kept_only
    base = base_rules(min_words, max_repeat_percent)
    every = [*base, *rules] if keep_columns else list(rules)
    order = cascade_order(measured(docs, every, sample_rows), every, () if keep_columns else COUNTS)
    rows = docs if keep_columns else docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    schema = docs.schema if kept_only else f"{', '.join(f'`{c}` {t}' for c, t in docs.dtypes if c != 'kept')}, kept boolean" if keep_columns else f"doc_id long, {', '.join(f'{c} long' for c in COUNTS)}, base_failed boolean, kept boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            t = Texts(text_column(batch, "text"))
            failed = np.zeros(batch.num_rows, bool) if keep_columns else base[0].rejects(t) | base[1].rejects(t)
            counts = [] if keep_columns else [pa.array(getattr(t, c), pa.int64()) for c in COUNTS]
            alive = np.flatnonzero(~failed)
            left = t.only(alive) if failed.any() else t
            for rule in order:
                if not len(alive):
                    break
                passed = np.flatnonzero(~rule.rejects(left))
                if len(passed) < len(alive):
                    alive, left = alive[passed], left.only(passed)
            kept = np.zeros(len(failed), bool)
            kept[alive] = True
            if kept_only:
                yield batch.filter(pa.array(kept))
            elif keep_columns:
                names = [c for c in batch.schema.names if c != "kept"]
                yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in names), pa.array(kept)], names=[*names, "kept"])
            else:
                yield pa.RecordBatch.from_arrays([batch.column(0), *counts, pa.array(failed), pa.array(kept)], names=["doc_id", *COUNTS, "base_failed", "kept"])

    return rows.mapInArrow(run, schema)
