"""Chat formatting with typed content parts.

A visitor flattens the parts of a turn: texts are escaped, images, audio and
documents become ordered placeholders, with a reference and a token count for
each. A turn is one formatted piece, so that formatting is a narrow job and a
conversation may have any number of turns; the formatted conversation is its
pieces in order. Reading back needs nothing but the pieces.
"""

from __future__ import annotations

import hashlib
import json
import math
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, functions as F

from .packing import Tokenizer
from .tables import with_type_of
from .words import once

PART = "struct<type:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"
#: Fixed values of the template: marks of a turn, and control strings that a text may not hold unescaped.
TURN, END = "<|turn|>", "<|end|>"
_CONTROL = re.compile(r"<\|[a-z_]+(?::[0-9]+)?\|>|</?s>|\[/?INST\]|<</?SYS>>")
_PLACE = re.compile(r"<\|(image|audio|document):([0-9]+)\|>")
_ESCAPED = re.compile(r"\\(\\?)")
_PLAIN_ROLE = re.compile(r"[A-Za-z_]*")


def escape(text: str) -> str:
    """Doubles backslashes and puts one after the first character of each control string."""
    return _CONTROL.sub(lambda m: m[0][0] + "\\" + m[0][1:], text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


class PartVisitor:
    """Flattens the parts of one turn. Sizes that are unknown count as one unit."""

    def __init__(self, count, patch: int = 14, per_second: float = 25.0, per_page: int = 256):
        self.count, self.patch, self.per_second, self.per_page = count, patch, per_second, per_page
        self.out: list[str] = []
        self.attachments: list[dict] = []
        self.tokens = 0

    def visit(self, part: dict) -> None:
        getattr(self, f"visit_{part.get('type') or 'text'}", self.visit_other)(part)

    def visit_text(self, part: dict) -> None:
        text = part.get("text") or ""
        self.out.append(escape(text))
        self.tokens += self.count(text)

    def visit_image(self, part: dict) -> None:
        side = lambda n: math.ceil(max(n or 1, 1) / self.patch)
        self._attach("image", part, side(part.get("width")) * side(part.get("height")))

    def visit_audio(self, part: dict) -> None:
        self._attach("audio", part, math.ceil(max(part.get("seconds") or 0.0, 0.0) * self.per_second) or 1)

    def visit_document(self, part: dict) -> None:
        self._attach("document", part, max(part.get("pages") or 1, 1) * self.per_page)

    def visit_other(self, part: dict) -> None:
        """A part of unknown type is kept as the text that it has."""
        self.visit_text(part)

    def _attach(self, kind: str, part: dict, tokens: int) -> None:
        self.attachments.append({"kind": kind, "at": len(self.attachments) + 1, "ref": part.get("ref"), "tokens": tokens})
        self.out.append(f"<|{kind}:{len(self.attachments)}|>")
        self.tokens += tokens


def read_piece(piece: str) -> tuple[str, list[str | tuple[str, int]]]:
    """(role, parts) of a formatted turn: texts unescaped, placeholders as (kind, number)."""
    head, _, body = piece.removeprefix(TURN).removesuffix(END).partition("\n")
    parts: list[str | tuple[str, int]] = []
    at = 0
    for m in _PLACE.finditer(body):
        if m.start() > at:
            parts.append(unescape(body[at : m.start()]))
        parts.append((m[1], int(m[2])))
        at = m.end()
    if at < len(body):
        parts.append(unescape(body[at:]))
    return (json.loads(head) if head.startswith('"') else head), parts


def _formatter(path: str, learned: tuple[str, ...]):
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        attachment = pa.struct([("kind", pa.string()), ("at", pa.int64()), ("ref", pa.string()), ("tokens", pa.int64())])
        tokenizer = once(path, lambda: Tokenizer(path))
        for batch in batches:
            pieces, first, last, held, tokens = [], [], [], [], []
            for role, parts in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                visitor = PartVisitor(lambda text: len(tokenizer.ids(text)) // 4)
                for part in parts or []:
                    visitor.visit(part or {})
                name = role or ""
                head = TURN + (name if _PLAIN_ROLE.fullmatch(name) else json.dumps(name)) + "\n"
                body = "".join(visitor.out)
                pieces.append(head + body + END)
                first.append(len(head))
                last.append(len(head) + (len(body) if role in learned else 0))
                held.append(visitor.attachments)
                tokens.append(visitor.tokens)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), batch.column(1), pa.array(pieces, pa.string()), pa.array(first, pa.int64()),
                    pa.array(last, pa.int64()), pa.array(held, pa.list_(attachment)), pa.array(tokens, pa.int64()),
                ],
                ["conv", "turn", "formatted", "loss_start", "loss_end", "attachments", "n_tokens"],
            )

    return run


def format_turns(
    turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", parts: str | None = None,
    path: str | None = None, learned: tuple[str, ...] = ("assistant",),
) -> DataFrame:
    """One row per turn: conversation, turn, formatted, loss_start, loss_end, attachments, n_tokens.

    `parts` names a column of typed parts; without it the text is the one
    part. The loss mask [loss_start, loss_end) covers the body of turns of
    the `learned` roles, in code points of `formatted`. Null text is empty,
    null role is the empty role, null parts are none.
    """
    if path is None:
        from public_tokenizers import path as path_of

        path = path_of("byte_bpe_50k.json")
    one = F.array(F.struct(F.lit("text").alias("type"), F.col(text).alias("text")))
    if parts is None:
        body = F.transform(one, lambda p: F.struct(
            p["type"].alias("type"), p["text"].alias("text"), F.lit(None).cast("string").alias("ref"), F.lit(None).cast("int").alias("width"),
            F.lit(None).cast("int").alias("height"), F.lit(None).cast("double").alias("seconds"), F.lit(None).cast("int").alias("pages"),
        ))
    else:
        body = F.col(parts).cast(f"array<{PART}>")
    frame = turns.select(F.col(conv).alias("conv"), F.col(turn).alias("turn"), F.col(role).alias("role"), body.alias("parts"))
    return frame.mapInArrow(
        _formatter(path, learned),
        with_type_of(
            frame, {"conv": "conv", "turn": "turn"}, "formatted string, loss_start long, loss_end long, "
            "attachments array<struct<kind:string,at:long,ref:string,tokens:long>>, n_tokens long",
        ),
    )


def _digests(batches: Iterator) -> Iterator:
    """Folds sorted pieces, a conversation after the other; keeps two hash states, never a conversation."""
    import pyarrow as pa

    schema, now, state = None, object(), None
    done: list[dict] = []

    def close() -> None:
        if state:
            done.append(state | {"turns_sha256": state["turns_sha256"].hexdigest(), "loss_sha256": state["loss_sha256"].hexdigest()})

    for batch in batches:
        schema = schema or pa.schema([
            ("conv", batch.schema.field(0).type), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()),
            ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()), ("n_attachments", pa.int64()), ("n_tokens", pa.int64()),
        ])
        for row in batch.to_pylist():
            if row["conv"] != now:
                close()
                now, state = row["conv"], {
                    "conv": row["conv"], "n_turns": 0, "turns_sha256": hashlib.sha256(), "loss_chars": 0, "loss_sha256": hashlib.sha256(),
                    "formatted_chars": 0, "n_attachments": 0, "n_tokens": 0,
                }
            role, parts = read_piece(row["formatted"])
            body = "".join(p for p in parts if isinstance(p, str))
            loss = unescape(_PLACE.sub("", row["formatted"][row["loss_start"] : row["loss_end"]]))
            state["n_turns"] += 1
            state["turns_sha256"].update(f"{role}\n{body}\n".encode())
            state["loss_sha256"].update(loss.encode())
            state["loss_chars"] += len(loss)
            state["formatted_chars"] += len(row["formatted"])
            state["n_attachments"] += len(row["attachments"])
            state["n_tokens"] += row["n_tokens"]
        if done:
            yield pa.RecordBatch.from_pylist(done, schema)
            done = []
    close()
    if done:
        yield pa.RecordBatch.from_pylist(done, schema)


def conversation_digests(pieces: DataFrame, conv: str = "conv_id") -> DataFrame:
    """One row per conversation, read back from its formatted pieces in order of turn.

    Equal turns are ordered by their formatted text. Rows without a
    conversation id form one conversation with a null id.
    """
    dealt = pieces.repartition("conv").sortWithinPartitions("conv", "turn", "formatted")
    return dealt.mapInArrow(
        _digests,
        with_type_of(
            pieces, {"conv": "conv"}, "n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, "
            "n_attachments long, n_tokens long",
        ),
    ).withColumnRenamed("conv", conv)
