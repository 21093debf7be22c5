"""Operator 6: secret scans by patterns and by sliding-window entropy.

Patterns of assignments, access ids and hex strings are matched on the UTF-8 bytes (they are ASCII, so
matches are those of the text). Beyond them, every run of token characters is a candidate: a window
slides over it, the counts of its characters change by one in and one out, and the window's Shannon
entropy follows from those counts. Consecutive windows that reach the bound of their character class are
a secret, unless the allow list knows the run's form; windows of letters must also look unlike words.
"""
from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.arrays import slices, small_batches, text_column

KINDS = ("assign", "access", "hex", "entropy")
# The base patterns and their least lengths.
ASSIGN = re.compile(rb"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(rb"AKIA[A-Z0-9]{14,}")
HEX = re.compile(rb"[0-9a-f]{16,}")
LEAST_ASSIGNED = 12
#: One of these stands in any text that ASSIGN matches.
WORDS = (b"passw", b"secret", b"token", b"apikey", b"api_key")
CANDIDATE = re.compile(rb"[A-Za-z0-9+/_=-]{20,}")

#: Window of characters, and by class of characters the least bits a character over it.
WINDOW = 20
BOUNDS = {"hex": 2.7, "digits": 2.7, "lower": 3.4, "upper": 3.4, "letters": 3.4, "alnum": 3.4, "base64": 3.6}
#: Forms of token runs that are no secrets: ids with dashes in their fixed places, dates, marks alone, numbers joined by marks, paths of short parts with digits. No alternative can split a run in two ways, so a match takes linear time.
ALLOWED = re.compile(
    rb"(?i:[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12})|\d{4}-\d\d-\d\d[\dTZ:+-]*|[-_=+/]+|[-+/_=]*\d+(?:[-+/_=]+\d+)*[-+/_=]*|/?[a-z0-9_-]{1,15}(?:/[a-z0-9_-]{1,15})+/?"
)

#: Letter pairs that are common in words of European languages: half or more of a word's pairs, about a quarter of a random key's.
COMMON = frozenset(
    b"th he in er an re on at en nd ti es or te of ed is it al ar st to nt ng se ha as ou io le ve co me de hi ri ro ic ne ea ra ce li ch ll be ma si om ur ca el ta la ns di fo ho pe ec pr no "
    b"ct us ac ot il tr ly nc et ut ss so rs un lo wa ge ie wh ee wi em ad ol rt po we na ul ni ts mo ow pa im mi ai sh ir su id os iv ia am fi ci vi pl ig tu ev ld ry mp fe bl ab gh ty op wo sa "
    b"ay ex ke fr oo av ag if ap gr od bo sp rd do uc bu ei ov rm ep tt oc fa cu sc gi da cr cl du ga qu ue ba ls va um au eu ck ew br iz za".split()
)


def char_class(run: bytes) -> str:
    """The narrowest class that holds every character of a run."""
    if run.isdigit():
        return "digits"
    if not run.translate(None, b"0123456789abcdef") or not run.translate(None, b"0123456789ABCDEF"):
        return "hex"
    if run.isalpha():
        return "lower" if run.islower() else "upper" if run.isupper() else "letters"
    return "alnum" if run.isalnum() else "base64"


def window_entropies(run: bytes, window: int = WINDOW) -> list[float]:
    """Bits a character of every window over a run, from counts that change by one in and one out."""
    window = min(window, len(run))
    if not window:
        return []
    term = [0.0] + [c * math.log2(c) for c in range(1, window + 2)]
    counts = [0] * 256
    total = 0.0  # sum of c log2 c
    out = []
    for i, c in enumerate(run):
        total += term[counts[c] + 1] - term[counts[c]]
        counts[c] += 1
        if i >= window:
            old = run[i - window]
            counts[old] -= 1
            total += term[counts[old]] - term[counts[old] + 1]
        if i >= window - 1:
            out.append(math.log2(window) - total / window)
    return out


def over_bound(run: bytes, window: int = WINDOW) -> list[bool]:
    """Whether each window of a run reaches the bound of its own class and, where it has no digit, is not made of words."""
    window, low, each = min(window, len(run)), run.lower(), window_entropies(run, window)
    is_pair = [low[i : i + 2].isalpha() for i in range(len(run) - 1)]
    pairs = [0, *accumulate(is_pair)]
    common = [0, *accumulate(p and low[i : i + 2] in COMMON for i, p in enumerate(is_pair))]
    digits = [0, *accumulate(48 <= c < 58 for c in run)]
    least, out = min(BOUNDS.values()), []
    for i, h in enumerate(each):
        if h < least:
            out.append(False)
        elif digits[i + window] > digits[i]:
            out.append(h >= BOUNDS[char_class(run[i : i + window])])
        else:
            end = i + window - 1
            out.append(h >= BOUNDS["letters"] and (common[end] - common[i]) * 2 < pairs[end] - pairs[i])
    return out


def entropy_spans(text: bytes) -> list[tuple[int, int]]:
    """Byte spans of consecutive windows over their bounds, in candidates whose form nothing allows."""
    found = []
    for m in CANDIDATE.finditer(text):
        run = m[0]
        if any(c in b"0123456789" for c in run) and ALLOWED.fullmatch(run):
            continue
        last = None
        for i, over in enumerate(over_bound(run)):
            if over and last == i - 1:
                found[-1] = (found[-1][0], m.start() + i + WINDOW)
            elif over:
                start = m.start() + i
                if last is not None:  # windows that overlap the span before them add what lies beyond it
                    start = max(start, found[-1][1])
                found.append((start, m.start() + i + WINDOW))
            last = i if over else last
    return found


def uncovered(a: int, b: int, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The parts of [a, b) that no span (in order of start) covers."""
    out = []
    for x, y in spans:
        if a < x < b:
            out.append((a, x))
        if x < b:
            a = max(a, y)
    return out + [(a, b)] if a < b else out


def scan(text: bytes) -> list[tuple[str, int, int]]:
    """(kind, start, end) of every secret in UTF-8 text, in code points, by start and then kind as listed."""
    spans = []
    low = text.lower()
    if any(w in low for w in WORDS):
        spans += [("assign", *m.span()) for m in ASSIGN.finditer(text) if m.end(1) - m.start(1) >= LEAST_ASSIGNED]
    if b"AKIA" in text:
        spans += [("access", *m.span()) for m in ACCESS.finditer(text)]
    spans += [("hex", *m.span()) for m in HEX.finditer(text)]
    base = sorted((a, b) for _, a, b in spans)
    starts, ends = [a for a, _ in base], list(accumulate((b for _, b in base), max))
    for a, b in entropy_spans(text):
        spans += [("entropy", *part) for part in uncovered(a, b, base[bisect_right(ends, a) : bisect_left(starts, b)])]
    spans.sort(key=lambda s: (s[1], KINDS.index(s[0]), s[2]))
    if spans and not text.isascii():
        starts = (np.frombuffer(text, np.uint8) & 0xC0) != 0x80
        points = np.concatenate([[0], np.cumsum(starts)]).tolist()
        spans = [(k, points[a], points[b]) for k, a, b in spans]
    return spans


def join_spans(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def find_secrets(docs: DataFrame) -> DataFrame:
    """Secrets in every whole text of `docs` (`doc_id`, `text`; null: empty), a row per row.

    Returns doc_id, n_assign, n_access, n_hex, base_sha256 (of the pattern spans, joined), spans (all
    spans as kind:start:end, joined by commas). Equal rows get equal results; an empty table gives no
    rows; extra columns are ignored. No shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            each = [scan(t) for t in text_column(batch, "text").cast(pa.large_binary()).to_pylist()]
            base = [[s for s in spans if s[0] != "entropy"] for spans in each]
            columns = [batch.column(0)]
            columns += [pa.array([sum(s[0] == k for s in spans) for spans in base], pa.int64()) for k in KINDS[:3]]
            columns += [pa.array([hashlib.sha256(join_spans(s).encode()).hexdigest() for s in base], pa.string()), pa.array(map(join_spans, each), pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def redact(text: bytes, mask: bytes = b"[SECRET]") -> bytes:
    """The text with every secret (overlapping ones together) replaced by `mask`."""
    spans = sorted((a, b) for _, a, b in scan(text))
    if not spans:
        return text
    shown, out, at = text.decode("utf-8", "replace"), [], 0
    for a, b in spans:
        if a >= at:
            out += [shown[at:a], mask.decode()]
        at = max(at, b)
    return "".join([*out, shown[at:]]).encode()


def redact_secrets(docs: DataFrame, mask: str = "[SECRET]", text: str = "text") -> DataFrame:
    """`docs` with the secrets in column `text` replaced; null texts stay null, other columns as they are.

    A row per row: equal rows stay equal. An empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text):
            at = batch.schema.get_field_index(text)
            new = [None if t is None else redact(t.encode(), mask.encode()).decode() for t in batch.column(at).to_pylist()]
            yield batch.set_column(at, batch.schema.field(at), pa.array(new, batch.schema.field(at).type))

    small_batches(docs.sparkSession)
    return docs.mapInArrow(run, docs.schema)
