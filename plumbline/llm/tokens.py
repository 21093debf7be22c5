"""Subword ids of whole texts, made by the tokenizers library on each distinct chunk of text once."""
from __future__ import annotations

import os
import unicodedata
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from plumbline.llm.arrays import ragged_index

#: One of these at the end of a word of letters is a token of its own.
TAIL = tuple(".,;:!?")
#: Words that an encoder keeps where a worker's memory has to serve other stages too.
WORDS_KEPT = 250_000


class SubwordEncoder:
    """Encodes arrays of texts with a tokenizer file whose pre-tokenizer drops white space.

    Such a tokenizer never looks across white space, so a text's ids are those of its chunks between
    ASCII white space, in order. Arrow finds a batch's distinct chunks. A chunk that is one word of
    letters, or one with a mark after it, goes to the library's BPE model as the normalised word; any
    other chunk goes through the library's whole chain. Words stay known for later batches of the same
    Python worker, up to `most` of them. With `whole=True` (tokenizers that keep white space, or that
    normalise otherwise) the library gets whole texts.
    """

    _known: dict[tuple, SubwordEncoder] = {}

    def __init__(self, path: str, most: int = 400_000, whole: bool = False):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.most, self.whole = most, whole
        self.known: dict[str, bytes] = {}
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in shown]
        self.letters = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}

    @classmethod
    def of(cls, path: str, **options) -> SubwordEncoder:
        """The worker's own encoder for this file."""
        key = (path, *sorted(options.items()))
        if key not in cls._known:
            cls._known[key] = cls(path, **options)
        return cls._known[key]

    @classmethod
    def forget(cls) -> None:
        """Frees the worker's encoders; a later `of` makes them anew."""
        cls._known.clear()

    @property
    def size(self) -> int:
        return self.library.get_vocab_size()

    def _library_ids(self, texts: list[str]) -> list[bytes]:
        return [array("I", x.ids).tobytes() for x in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _word(self, word: str) -> bytes:
        """The ids of one normalised word of letters."""
        if not word.isascii():
            word = word.encode().decode("latin-1").translate(self.letters)
        return array("I", [t.id for t in self.library.model.tokenize(word)]).tobytes()

    def _chunks(self, chunks: list[str]) -> list[bytes]:
        """The ids of each chunk, as unsigned 32-bit integers."""
        known, out, odd = self.known, [], []
        if len(known) > self.most:
            known.clear()
        marks = dict(zip(TAIL, self._library_ids(TAIL), strict=True))
        for c in chunks:
            word, tail = (c[:-1], marks[c[-1]]) if len(c) > 1 and c[-1] in marks else (c, b"")
            word = word.lower() if word.isascii() else unicodedata.normalize("NFC", word).replace("\u03a3", "\u03c3").lower()
            ids = known.get(word)
            if ids is None:
                if not word.isalpha():
                    odd.append(len(out))
                    out.append(b"")
                    continue
                ids = known[word] = self._word(word)
            out.append(ids + tail)
        for at, ids in zip(odd, self._library_ids([chunks[i] for i in odd]), strict=True):
            out[at] = ids
        return out

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after another, len+1 offsets). Null counts as the empty text."""
        texts = texts.cast(pa.large_string()).fill_null("")
        if not len(texts):
            return np.zeros(0, np.uint32), np.zeros(1, np.int64)
        if self.whole:
            each = self._library_ids(texts.to_pylist())
            return np.frombuffer(b"".join(each), np.uint32), np.concatenate([[0], np.cumsum([len(x) // 4 for x in each])])
        return self.encode_chunks(*split_chunks(texts))

    def encode_chunks(self, coded: pa.DictionaryArray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """As `encode`, for texts that `split_chunks` has split."""
        found = self._chunks(coded.dictionary.to_pylist())
        size = np.fromiter(map(len, found), np.int64, len(found)) // 4
        which = np.asarray(coded.indices)
        lens = size[which]
        flat = np.frombuffer(b"".join(found), np.uint32)
        return flat[ragged_index((np.cumsum(size) - size)[which], lens)], np.concatenate([[0], np.cumsum(lens)])[bounds]


def split_chunks(texts: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray]:
    """The chunks of texts between ASCII white space, dictionary-coded, and each text's len+1 bounds among them.

    White space at a text's ends leaves empty chunks.
    """
    chunks = pc.ascii_split_whitespace(texts)
    bounds = np.asarray(chunks.offsets, dtype=np.int64)
    return chunks.values.slice(bounds[0], bounds[-1] - bounds[0]).dictionary_encode(), bounds - bounds[0]


def with_end(ids: np.ndarray, offsets: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """The same ids with `end_id` after each document's."""
    n = len(offsets) - 1
    out = np.full(len(ids) + n, end_id, np.uint32)
    keep = np.ones(len(out), bool)
    new = offsets + np.arange(n + 1)
    keep[new[1:] - 1] = False
    out[keep] = ids
    return out, new
