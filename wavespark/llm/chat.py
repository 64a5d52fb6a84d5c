"""Chat formatting: turns to one training text with a loss mask.

A declarative template says what opens and closes a turn; a finite-state machine over the roles says which order of
turns is valid. Each conversation becomes text segments with a loss flag each: only what an assistant says counts.
Control strings inside texts get one more mark (``<|`` becomes ``<\\|``, ``<\\|`` becomes ``<\\\\|`` ...), so that no text can
end its turn, and reading back takes one mark away.

Defined cases: a null text or role is empty; turns are ordered by turn (null first), then role, then text, and repeated
rows are turns of their own; a null conversation id is a conversation; an order that the machine rejects is formatted
all the same and marked ``valid = false``; an empty table gives an empty table; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class ChatTemplate:
    """What stands around a turn, who is learned from, and which role may follow which (None: start and end)."""

    open: str = "<|im_start|>"
    after_role: str = "\n"
    close: str = "<|im_end|>\n"
    learned: tuple[str, ...] = ("assistant",)
    moves: tuple[tuple[str | None, str | None], ...] = field(
        default=((None, "system"), (None, "user"), ("system", "user"), ("user", "assistant"), ("assistant", "user"), ("assistant", None))
    )

    def valid(self, roles: list[str]) -> bool:
        state: str | None = None
        for role in [*roles, None]:
            if (state, role) not in self.moves:
                return False
            state = role
        return True

    @staticmethod
    def escape(text: str) -> str:
        return re.sub(r"<(\\*)\|", r"<\\\1|", text)

    @staticmethod
    def unescape(text: str) -> str:
        return re.sub(r"<\\(\\*)\|", r"<\1|", text)

    def role_out(self, role: str) -> str:
        """A role is one line: line ends and the mark itself are written with a mark."""
        return self.escape(role.replace("\\", "\\\\").replace("\n", "\\n"))

    def role_in(self, role: str) -> str:
        return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], self.unescape(role))

    def segments(self, turns: list[tuple[str, str]]) -> list[tuple[str, bool]]:
        out: list[tuple[str, bool]] = []
        for role, text in turns:
            out += [(self.open + self.role_out(role) + self.after_role, False), (self.escape(text), role in self.learned), (self.close, False)]
        return out

    def turns(self, formatted: str) -> list[tuple[str, str]]:
        """The turns of a formatted text; the inverse of joining ``segments``."""
        out = []
        for turn in formatted.split(self.close)[:-1]:
            role, _, text = turn.removeprefix(self.open).partition(self.after_role)
            out.append((self.role_in(role), self.unescape(text)))
        return out


SEGMENTS = "array<struct<text:string,loss:boolean>>"


def format_chats(rows: DataFrame, template: ChatTemplate = ChatTemplate(), conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per conversation: ``conv_id``, ``valid``, ``segments`` (text and loss flag each, in order)."""
    one = F.struct(F.col(f"`{turn}`").alias("turn"), F.coalesce(F.col(f"`{role}`"), F.lit("")).alias("role"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    grouped = rows.groupBy(F.col(f"`{conv}`").alias("conv_id")).agg(F.sort_array(F.collect_list(one)).alias("turns"))
    typed = grouped.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                valid, parts = [], []
                for turns in batch.column(1).to_pylist():
                    pairs = [(t["role"], t["text"]) for t in turns]
                    valid.append(template.valid([r for r, _ in pairs]))
                    parts.append([{"text": t, "loss": x} for t, x in template.segments(pairs)])
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(valid, pa.bool_()), pa.array(parts, pa.list_(pa.struct([("text", pa.string()), ("loss", pa.bool_())])))], names=["conv_id", "valid", "segments"])

    return grouped.select("conv_id", "turns").mapInArrow(run, f"conv_id {typed}, valid boolean, segments {SEGMENTS}")


def read_back(formatted: DataFrame, template: ChatTemplate = ChatTemplate()) -> DataFrame:
    """What the formatted text says again: numbers and digests of its turns and of what is under the loss mask."""
    typed = formatted.schema["conv_id"].dataType.simpleString()
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "valid"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                rows: list[tuple] = []
                for parts in batch.column(2).to_pylist():
                    text = "".join(p["text"] for p in parts)
                    turns = template.turns(text)
                    loss = "".join(template.unescape(p["text"]) for p in parts if p["loss"])
                    rows.append((len(turns), _sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(loss), _sha(loss), len(text)))
                n, turns_sha, chars, loss_sha, size = ([*x] for x in zip(*rows, strict=True)) if rows else ([], [], [], [], [])
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(turns_sha, pa.string()), pa.array(chars, pa.int64()), pa.array(loss_sha, pa.string()), pa.array(size, pa.int64()), batch.column(1)], names=names)

    return formatted.mapInArrow(run, f"conv_id {typed}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint, valid boolean")


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()
