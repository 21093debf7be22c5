"""Operator 9: byte-pair encoding by backtracking over Aho-Corasick matches, and decoding by offsets.

The merges of a word are not replayed. Two tokens may stand side by side exactly if no merge across
their border would have come before both were whole, which a walk down their merge trees decides. A
word's ids are then the one chain of compatible tokens over it: the encoder takes the longest match at
each position and backs up when no match there is compatible; a position that failed once is never
tried again, so the work is linear in the word.
"""
from __future__ import annotations

import hashlib
import json
import sys
import unicodedata
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from plumbline.llm.arrays import ragged_index, slices, small_batches, text_column

#: The character that stands after a word's last byte; bytes stand as the code points 0 to 255.
END = "\u0100"
#: White space as the tokenizer's own patterns see it.
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def byte_letters() -> dict[str, str]:
    """The printable letter of each byte in a byte-level vocabulary, as letter -> code point of the byte."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): chr(b) for b in shown} | {chr(256 + i): chr(b) for i, b in enumerate(hidden)}


def unassigned() -> list[tuple[int, int]]:
    """The ranges of code points that Python's Unicode tables do not know; surrogates are not text."""
    known = [cp for cp in range(0x80, sys.maxunicode + 1) if unicodedata.category(chr(cp)) != "Cn"]
    return [(a + 1, b - 1) for a, b in zip([0x7F, *known], [*known, sys.maxunicode + 1], strict=True) if b - a > 1]


class BacktrackingBPE:
    """Encoder and decoder for a byte-level BPE file with an end-of-word suffix and a word pattern."""

    _known: dict[str, BacktrackingBPE] = {}

    def __init__(self, path: str, most: int = 400_000):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        suffix, letters = model["end_of_word_suffix"], byte_letters()
        plain = lambda t: "".join(letters[c] for c in t.removesuffix(suffix)) + END * t.endswith(suffix)
        vocab = model["vocab"]
        self.most = most
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.rank: dict[int, int] = {}
        self.halves: dict[int, tuple[int, int]] = {}
        self.merged: dict[tuple[int, int], int] = {}
        for rank, (a, b) in enumerate(model["merges"]):
            a, b, whole = vocab[a], vocab[b], vocab[a + b]
            if (a, b) not in self.merged:
                self.merged[a, b] = whole
            if whole not in self.halves:
                self.halves[whole], self.rank[whole] = (a, b), rank
        self.first = ahocorasick.Automaton()
        usable: dict[int, bool] = {}
        for text, token in sorted(vocab.items(), key=lambda x: self.rank.get(x[1], -1)):
            a, b = self.halves.get(token, (None, None))
            usable[token] = a is None or usable[a] and usable[b] and self.compatible(a, b, self.rank[token])
            if usable[token]:
                self.first.add_word(plain(text), (token, len(plain(text))))
        self.first.make_automaton()
        self.word = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[\p{{L}}]+|[\p{{N}}]|[^{SPACE}\p{{L}}\p{{N}}]+")
        self.cut = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")")
        #: Characters that were seen and that Python's Unicode tables know.
        self.assigned: set[str] = set()
        self.library, self.letters = Tokenizer.from_file(path), letters
        self._pairs: dict[tuple[int, int], bool] = {}
        self._clear()
        # decoding: every token's text and a space, in one array, and where each begins
        shown = {i: t for t, i in vocab.items()} | {i: t for t, i in self.special.items()}
        pieces = [(shown.get(i, "") + " ").encode() for i in range(max(shown) + 1)]
        self.pieces = np.frombuffer(b"".join(pieces), np.uint8)
        self.offset = np.concatenate([[0], np.cumsum([len(p) for p in pieces])])

    @classmethod
    def of(cls, path: str) -> BacktrackingBPE:
        if path not in cls._known:
            cls._known[path] = cls(path)
        return cls._known[path]

    def _clear(self) -> None:
        self._words: dict[str, tuple[int, ...]] = {}
        self._chunks: dict[str, tuple[int, ...]] = {}
        self._pairs.clear()

    def compatible(self, a: int, b: int, limit: int = 1 << 60) -> bool:
        """Whether tokens a, b can be neighbours: no merge across their border ranks below `limit`.

        The border's two tokens of an earlier time are found by undoing the later of the two merges;
        a merge across the border at that time would have had to come before the undone one.
        """
        rank, merged, halves = self.rank, self.merged, self.halves
        while True:
            whole = merged.get((a, b))
            if whole is not None and rank[whole] < limit:
                return False
            ra, rb = rank.get(a, -1), rank.get(b, -1)
            if ra > rb:
                limit, a = ra, halves[a][1]
            elif rb >= 0:
                limit, b = rb + 1, halves[b][0]  # of equal merges the left one comes first
            else:
                return True

    def _fits(self, a: int, b: int) -> bool:
        found = self._pairs.get((a, b))
        if found is None:
            found = self._pairs[a, b] = self.compatible(a, b)
        return found

    def encode_word(self, word: str) -> tuple[int, ...]:
        """The ids of one word (bytes as code points, END last)."""
        at: list[list[tuple[int, int]]] = [[] for _ in word]
        for last, match in self.first.iter(word):
            at[last - match[1] + 1].append(match)
        out: list[int] = []
        ends: list[int] = [0]
        tried = [len(x) for x in at]
        dead = set()
        n = len(word)
        while (pos := ends[-1]) < n:
            k = tried[pos]
            while k:
                k -= 1
                token, size = at[pos][k]
                if pos + size not in dead and (not out or self._fits(out[-1], token)):
                    out.append(token)
                    ends.append(pos + size)
                    break
            else:
                if not out:
                    raise ValueError("no chain of tokens covers the word")
                dead.add(pos)
                out.pop()
                ends.pop()
                tried[pos] = len(at[pos])
                continue
            tried[pos] = k
        return tuple(out)

    def newer(self, part: str) -> bool:
        """Whether a character is one that Python's Unicode tables do not know: it may be a letter, or have a lower case, in the library's newer ones."""
        if self.assigned.issuperset(part):
            return False
        known = {c for c in part if unicodedata.category(c) != "Cn"}
        self.assigned |= known
        return not known.issuperset(part)

    def encode_chunk(self, chunk: str) -> tuple[int, ...]:
        """The ids of a text without white space in it (or any text: white space only separates)."""
        ids: list[int] = []
        for k, part in enumerate(self.cut.split(chunk)):
            if k % 2:
                ids.append(self.special[part])
                continue
            if not part.isascii() and self.newer(part):  # the library normalises and splits, by its own tables
                split = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(part))
                for word, _ in split:
                    ids += self.encode_word("".join(self.letters[c] for c in word) + END)
                continue
            if not part.isascii():
                part = unicodedata.normalize("NFC", part).replace("Σ", "σ")
            for word in self.word.findall(part.lower()):
                found = self._words.get(word)
                if found is None:
                    found = self._words[word] = self.encode_word((word if word.isascii() else word.encode().decode("latin-1")) + END)
                ids += found
        return tuple(ids)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after another, len+1 offsets)."""
        if not len(texts):
            return np.zeros(0, np.int64), np.zeros(1, np.int64)
        chunks = pc.ascii_split_whitespace(texts.cast(pa.large_string()).fill_null(""))
        bounds = np.asarray(chunks.offsets, dtype=np.int64)
        coded = chunks.values.slice(bounds[0], bounds[-1] - bounds[0]).dictionary_encode()
        if len(self._chunks) > self.most or len(self._words) > self.most or len(self._pairs) > 4 * self.most:
            self._clear()
        known, found = self._chunks, []
        for c in coded.dictionary.to_pylist():
            ids = known.get(c)
            if ids is None:
                ids = known[c] = self.encode_chunk(c)
            found.append(ids)
        lens = np.fromiter(map(len, found), np.int64, len(found))
        flat = np.fromiter((i for x in found for i in x), np.int64, int(lens.sum()))
        which = np.asarray(coded.indices)
        ids = flat[ragged_index((np.cumsum(lens) - lens)[which], lens[which])]
        return ids, np.concatenate([[0], np.cumsum(lens[which])])[bounds - bounds[0]]

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """UTF-8 bytes of all decoded texts and their len+1 offsets: tokens, each with a space after it.

        The space after a text's last token is not part of the decoded text.
        """
        start = self.offset[ids]
        lens = self.offset[ids + 1] - start
        return self.pieces[ragged_index(start, lens)], np.concatenate([[0], np.cumsum(lens)])[offsets]


def encode_decode(docs: DataFrame, tokenizer: str, with_ids: bool = False) -> DataFrame:
    """Encodes and decodes every whole text of `docs` (`doc_id`, `text`; null: empty).

    Returns doc_id, n_tokens, ids_sha256 (of the decimal ids joined by a space), decoded_sha256 (of the
    decoded text), and with `with_ids` the ids and the decoded text. A row per row, whatever its
    doc_id; an empty table gives no rows; extra columns are ignored. No shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = BacktrackingBPE.of(tokenizer)
        decimal = np.array([str(i) for i in range(len(bpe.offset))], dtype=object)
        for batch in slices(batches, "text", 4 << 20):
            ids, off = bpe.encode(text_column(batch, "text"))
            out, ends = bpe.decode(ids, off)
            shown, raw = decimal[ids].tolist(), out.tobytes()
            cuts = list(zip(off[:-1].tolist(), off[1:].tolist(), ends[:-1].tolist(), ends[1:].tolist(), strict=True))
            columns = [
                batch.column(0),
                pa.array(np.diff(off), pa.int64()),
                pa.array([hashlib.sha256(" ".join(shown[a:b]).encode()).hexdigest() for a, b, _, _ in cuts], pa.string()),
                pa.array([hashlib.sha256(raw[a : max(a, b - 1)]).hexdigest() for _, _, a, b in cuts], pa.string()),
            ]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                columns += [pa.array([ids[a:b].tolist() for a, b, _, _ in cuts], pa.list_(pa.int64())), pa.array([raw[a : max(a, b - 1)].decode() for _, _, a, b in cuts], pa.string())]
                names += ["ids", "decoded"]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    small_batches(docs.sparkSession)
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<long>, decoded string" * with_ids
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)
