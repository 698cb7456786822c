"""Chat formatting with typed content parts.

A conversation's content is a string or a list of parts (text, image, audio, document).  A
visitor flattens the parts of a turn into one string: texts are escaped, every other part
becomes an ordered placeholder, and its reference and the number of tokens that it expands
to are recorded.  Turns are marked with <|im_start|> and <|im_end|>.

Escaping: a backslash becomes two, and "<|" becomes "<\\|"; so no text can hold a control
string, and `unescape` gives every text back.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

LONGEST = 1e12  # seconds; longer ones count as this, and others that are no number as none
OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"

PART = T.StructType(
    [
        T.StructField("type", T.StringType()),
        T.StructField("text", T.StringType()),
        T.StructField("ref", T.StringType()),
        T.StructField("width", T.LongType()),
        T.StructField("height", T.LongType()),
        T.StructField("seconds", T.DoubleType()),
        T.StructField("pages", T.LongType()),
    ]
)

FORMATTED = "formatted string, loss_start long, loss_end long, attachments array<struct<kind:string,ref:string,at:long,tokens:long>>, expanded_tokens long"


def escape(text: str | None) -> str:
    return (text or "").replace("\\", "\\\\").replace("<|", "<\\|")


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


def escape_role(role: str | None) -> str:
    """A role stands on one line, so its newlines are escaped too."""
    return escape(role).replace("\n", "\\n")


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], role, flags=re.S)


@dataclass
class Flattened:
    """What the visitor has made of a turn so far."""

    pieces: list[str] = field(default_factory=list)
    length: int = 0
    attachments: list[dict] = field(default_factory=list)
    tokens: int = 0

    def put(self, piece: str) -> None:
        self.pieces.append(piece)
        self.length += len(piece)

    def attach(self, kind: str, ref: str | None, tokens: int) -> None:
        self.attachments.append({"kind": kind, "ref": ref or "", "at": self.length, "tokens": tokens})
        self.tokens += tokens
        self.put(f"<|{kind}_{len(self.attachments)}|>")


class PartVisitor:
    """One method for each kind of part; an unknown kind is treated as text."""

    def __init__(self, patch: int = 28, audio_rate: float = 25.0, page_tokens: int = 512):
        self.patch, self.audio_rate, self.page_tokens = patch, audio_rate, page_tokens

    def visit(self, parts: list[dict], out: Flattened) -> Flattened:
        for part in parts:
            getattr(self, f"visit_{(part or {}).get('type') or 'text'}", self.visit_text)(part or {}, out)
        return out

    def visit_text(self, part: dict, out: Flattened) -> None:
        out.put(escape(part.get("text")))

    def visit_image(self, part: dict, out: Flattened) -> None:
        across, down = (math.ceil(max(0, part.get(k) or 0) / self.patch) for k in ("width", "height"))
        out.attach("image", part.get("ref"), max(1, across * down))

    def visit_audio(self, part: dict, out: Flattened) -> None:
        seconds = part.get("seconds") or 0.0
        out.attach("audio", part.get("ref"), max(1, math.ceil(min(seconds, LONGEST) * self.audio_rate)) if math.isfinite(seconds) else 1)

    def visit_document(self, part: dict, out: Flattened) -> None:
        out.attach("document", part.get("ref"), max(1, (part.get("pages") or 0) * self.page_tokens))


def format_turn(role: str | None, content: str | list[dict] | None, visitor: PartVisitor) -> dict:
    """One turn: its string, the span under the loss mask (empty unless the role is assistant)."""
    parts = content if isinstance(content, list) else [{"type": "text", "text": content}]
    body = visitor.visit(parts, Flattened())
    head = f"{OPEN}{escape_role(role)}\n"
    begin, end = len(head), len(head) + body.length
    for x in body.attachments:
        x["at"] += begin
    masked = role == "assistant"
    return {"formatted": "".join([head, *body.pieces, CLOSE]), "loss_start": begin if masked else end, "loss_end": end, "attachments": body.attachments, "expanded_tokens": body.tokens}


def format_turns(rows: DataFrame, content: str = "text", **visitor) -> DataFrame:
    """conv_id, turn, formatted, loss_start, loss_end, attachments and expanded_tokens of every row.

    `content` names a string column or one of array<PART>.  A null text or role is empty; a null
    list has no parts; equal rows each give a turn; other columns are left out.  Row by row: no
    shuffle, and a conversation of any length needs the memory of one turn."""
    kind = rows.schema[content].dataType
    typed = rows.select("conv_id", "turn", F.col("role").cast("string").alias("role"), (F.col(content) if isinstance(kind, T.ArrayType) else F.col(content).cast("string")).alias("content"))
    id_kind, turn_kind = rows.schema["conv_id"].dataType.simpleString(), rows.schema["turn"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = PartVisitor(**visitor)
        for batch in batches:
            made = [format_turn(r, c, own) for r, c in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            if not made:
                continue
            shape = pa.list_(pa.struct([("kind", pa.string()), ("ref", pa.string()), ("at", pa.int64()), ("tokens", pa.int64())]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([x["formatted"] for x in made]), *(pa.array([x[k] for x in made], pa.int64()) for k in ("loss_start", "loss_end")), pa.array([x["attachments"] for x in made], shape), pa.array([x["expanded_tokens"] for x in made], pa.int64())],
                ["conv_id", "turn", "formatted", "loss_start", "loss_end", "attachments", "expanded_tokens"],
            )

    return typed.mapInArrow(run, f"conv_id {id_kind}, turn {turn_kind}, {FORMATTED}")


def read_turn(formatted: str) -> tuple[str, str]:
    """Role and text of a formatted turn that holds text only."""
    role, _, text = formatted[len(OPEN) : -len(CLOSE)].partition("\n")
    return unescape_role(role), unescape(text)


class _Digest:
    def __init__(self, conv_id):
        self.conv_id, self.turns, self.loss, self.n, self.loss_n, self.chars, self.attached, self.tokens = conv_id, hashlib.sha256(), hashlib.sha256(), 0, 0, 0, 0, 0

    def add(self, formatted: str, begin: int, end: int, attached: int, tokens: int) -> None:
        role, text = read_turn(formatted)
        self.turns.update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
        masked = unescape(formatted[begin:end])
        self.loss.update(masked.encode("utf-8", "surrogatepass"))
        self.n, self.loss_n, self.chars = self.n + 1, self.loss_n + len(masked), self.chars + len(formatted)
        self.attached, self.tokens = self.attached + attached, self.tokens + tokens

    def row(self) -> tuple:
        return self.conv_id, self.n, self.turns.hexdigest(), self.loss_n, self.loss.hexdigest(), self.chars, self.attached, self.tokens


def digests(turns: DataFrame) -> DataFrame:
    """One row for each conversation, read back from its formatted turns in order of turn.

    Equal turn numbers are ordered by their formatted text; null turns come first; rows of a null
    conv_id are one conversation.  Turns stream through in sorted order and only running digests
    are held, so that a conversation with a third of all rows takes no more memory than others."""
    id_kind = turns.schema["conv_id"].dataType.simpleString()
    ordered = turns.select("conv_id", "turn", "formatted", "loss_start", "loss_end", F.size("attachments").cast("long").alias("attached"), "expanded_tokens").repartition("conv_id").sortWithinPartitions("conv_id", "turn", "formatted")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, done, kind = None, [], None

        def out():
            cols = list(zip(*done, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(cols[0], kind), pa.array(cols[1], pa.int64()), pa.array(cols[2]), pa.array(cols[3], pa.int64()), pa.array(cols[4]), *(pa.array(c, pa.int64()) for c in cols[5:])], ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_attachments", "expanded_tokens"])

        for batch in batches:
            kind = batch.schema.field(0).type
            for conv, text, *rest in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3, 4, 5, 6)), strict=True):
                if now is None or conv != now.conv_id:
                    if now is not None:
                        done.append(now.row())
                    now = _Digest(conv)
                now.add(text, *rest)
            if len(done) > 5000:
                yield out()
                done = []
        if now is not None:
            done.append(now.row())
            yield out()

    return ordered.mapInArrow(run, f"conv_id {id_kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_attachments long, expanded_tokens long")
