"""Operator 10: chat formatting of typed content parts with a reversible template and a loss mask.

A turn's content is a list of typed parts. A visitor flattens them in order: text goes through
escaped, an image, audio clip or document becomes a numbered placeholder, and its reference and the
number of tokens that it expands to are recorded. Each turn is formatted by itself, so formatting
needs no shuffle; reading back streams the turns of a conversation in order, in a sorted partition,
and keeps only running digests, whatever a conversation's length.
"""
from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
PLACEHOLDER = re.compile(r"<\|(image|audio|document|other):(\d+)\|>")
TURN = re.compile(r"\A<\|im_start\|>([^\n]*)\n(.*)<\|im_end\|>\n\Z", re.S)

PART = "struct<type:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"


def escape(text: str) -> str:
    """No control string, and no part of one, is left: every < gets a backslash after it."""
    return text.replace("<", "<\\")


def unescape(text: str) -> str:
    return text.replace("<\\", "<")


def escape_role(role: str) -> str:
    """A role fits on the opening line."""
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


@dataclass
class Flattener:
    """Visits typed parts in order; `visit_<type>` turns one into text and records what it refers to."""

    patch: int = 14
    patches_a_token: int = 4
    tokens_a_second: float = 25.0
    tokens_a_page: int = 768
    attachments: list[dict[str, Any]] = field(default_factory=list)

    def flatten(self, parts: list[dict[str, Any]]) -> str:
        return "".join(getattr(self, f"visit_{p.get('type')}", self.visit_other)(p) for p in parts)

    def visit_text(self, part: dict[str, Any]) -> str:
        return escape(part.get("text") or "")

    def visit_image(self, part: dict[str, Any]) -> str:
        across = [-(-(part.get(k) or self.patch) // self.patch) for k in ("width", "height")]
        return self._attach("image", part, -(-across[0] * across[1] // self.patches_a_token))

    def visit_audio(self, part: dict[str, Any]) -> str:
        return self._attach("audio", part, max(1, round((part.get("seconds") or 0) * self.tokens_a_second)))

    def visit_document(self, part: dict[str, Any]) -> str:
        return self._attach("document", part, max(1, part.get("pages") or 1) * self.tokens_a_page)

    def visit_other(self, part: dict[str, Any]) -> str:
        """A part of no known type (or none) keeps its place and reference, and expands to nothing."""
        return self._attach("other", part, 0)

    def _attach(self, kind: str, part: dict[str, Any], tokens: int) -> str:
        self.attachments.append({"n": len(self.attachments) + 1, "kind": kind, "ref": part.get("ref"), "tokens": tokens})
        return f"<|{kind}:{len(self.attachments)}|>"


def format_turn(role: str, parts: list[dict[str, Any]], visitor: Flattener | None = None) -> tuple[str, int, int, list[dict[str, Any]]]:
    """A turn's formatted text, the span of its content there, and its attachments."""
    visitor = visitor or Flattener()
    head = f"{OPEN}{escape_role(role)}\n"
    body = visitor.flatten(parts)
    return f"{head}{body}{CLOSE}\n", len(head), len(head) + len(body), visitor.attachments


FORMATTED = "conv_id long, turn long, formatted string, loss array<struct<start:long,end:long>>, attachments array<struct<n:int,kind:string,ref:string,tokens:long>>"


def format_conversations(turns: DataFrame, content: str = "text", trained: str = "assistant") -> DataFrame:
    """Formats each turn (conv_id, turn, role, and content as text or as an array of typed parts).

    Returns conv_id, turn, formatted, loss (the spans, in code points of `formatted`, of turns whose role
    is `trained`) and attachments. Null content or parts' text are empty, a null role is the empty
    role, a part of unknown type is an attachment without tokens. A row per row, so equal rows stay;
    an empty table gives no rows; extra columns are ignored. A conversation's text is its rows'
    `formatted` by turn.
    """
    typed = turns.schema[content].dataType.typeName() == "array"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for conv, turn, role, body in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                parts = [p for p in body or [] if p] if typed else [{"type": "text", "text": body}]
                text, a, b, attached = format_turn(role or "", parts)
                rows.append({"conv_id": conv, "turn": turn, "formatted": text, "loss": [{"start": a, "end": b}] if role == trained else [], "attachments": attached})
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    schema = pa.schema([
        ("conv_id", pa.int64()), ("turn", pa.int64()), ("formatted", pa.string()), ("loss", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
        ("attachments", pa.list_(pa.struct([("n", pa.int32()), ("kind", pa.string()), ("ref", pa.string()), ("tokens", pa.int64())]))),
    ])
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", F.col(content).alias("content"))
    return rows.mapInArrow(run, FORMATTED)


def read_parts(body: str, attachments: list[dict[str, Any]] | None = None) -> list[dict[str, Any]]:
    """The typed parts of a turn's formatted content, in order.

    Placeholders are told from text that looks like one before anything is unescaped. Neighbouring text
    parts come back as one, empty ones not at all.
    """
    known = {a["n"]: a for a in attachments or []}
    out, at = [], 0
    for m in PLACEHOLDER.finditer(body):
        out += [{"type": "text", "text": unescape(body[at : m.start()])}] if m.start() > at else []
        out.append({"type": m[1], "n": int(m[2])} | {k: known[int(m[2])][k] for k in ("ref", "tokens") if int(m[2]) in known})
        at = m.end()
    return out + ([{"type": "text", "text": unescape(body[at:])}] if at < len(body) else [])


def read_turn(formatted: str, attachments: list[dict[str, Any]] | None = None) -> tuple[str, list[dict[str, Any]]]:
    """(role, typed parts) of a formatted turn."""
    m = TURN.match(formatted)
    if not m:
        raise ValueError("not a formatted turn")
    return unescape_role(m[1]), read_parts(m[2], attachments)


def text_of(parts: list[dict[str, Any]]) -> str:
    """All text of typed parts, attachments left out."""
    return "".join(p["text"] for p in parts if p["type"] == "text")


DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_parts long, attachment_tokens long"


def conversation_digest(formatted: DataFrame) -> DataFrame:
    """Per conversation, read back from formatted turns: turns and loss-masked text as digests.

    n_parts counts the typed parts read back, attachment_tokens what attachments expand to. Turns of one
    number are taken in the order of their formatted text, equal rows each; null numbers come first.
    Null conv_ids are one conversation. An empty table gives no rows; extra columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state, done = None, None, []
        end = lambda: (key, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), *state[4:])
        for batch in batches:
            for conv, formatted, loss, attached in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3, 4)), strict=True):
                if state is None or conv != key:
                    if state is not None:
                        done.append(end())
                    key, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0, 0]
                role, parts = read_turn(formatted, attached)
                state[0] += 1
                state[1].update(f"{role}\n{text_of(parts)}\n".encode())
                for span in loss:
                    masked = text_of(read_parts(formatted[span["start"] : span["end"]]))
                    state[2] += len(masked)
                    state[3].update(masked.encode())
                state[4] += len(formatted)
                state[5] += len(parts)
                state[6] += sum(p.get("tokens") or 0 for p in parts)
            if done:
                yield rows(done)
                done = []
        if state is not None:
            yield rows([end()])

    names = [c.split()[0] for c in DIGEST.split(", ")]
    kinds = [pa.string() if "sha256" in c else pa.int64() for c in names]
    rows = lambda found: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found, strict=True), kinds, strict=True)], names=names)
    return formatted.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "formatted").select("conv_id", "turn", "formatted", "loss", "attachments").mapInArrow(run, DIGEST)
