"""Packing of token sequences: first-fit decreasing inside randomised groups of documents.

Each document is tokenized where it lies. Its full sequences need no packing;
the rest of it goes to a group drawn by a hash of its id and text. A group is
packed by first-fit decreasing: a tournament tree over the free room of all
bins finds the first bin with room in logarithmic time. Room that is left over
is filled by cutting pieces of the emptiest bins, and what remains of the last
bin is cut into sequences whose lengths are powers of two, so that nothing is
padded.
"""

from __future__ import annotations

import json
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, functions as F

from .tables import with_type_of
from .words import once, some_rows

END_ID = 0
_BEFORE_WORD = re.compile(r"(?= \S)").split
_CACHE_MOST = 200_000


def _byte_of_char() -> dict[str, int]:
    """Byte-level BPE files write a byte as a printable character; those without one follow from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Tokenizer:
    """Ids of a byte-level BPE file, as the tokenizers library gives them without special tokens added.

    Merging runs in tiktoken over the same vocabulary, once per run of
    characters up to the next blank before a word, where pre-tokenizing always
    cuts. Texts that hold a special token's string go to the library itself.
    """

    def __init__(self, path: str):
        import tiktoken
        from public_tokenizers import PATTERN

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        chars = _byte_of_char()
        self.path = path
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        ranks = {
            bytes(chars[c] for c in token): k for token, k in spec["model"]["vocab"].items() if token not in self.special
        }
        self.encoding = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.whole = None
        self.known: dict[str, bytes] = {}

    def _part(self, part: str) -> bytes:
        ids = self.known.get(part)
        if ids is None:
            if len(self.known) >= _CACHE_MOST:
                self.known.clear()
            ids = array("I", self.encoding.encode_ordinary(part)).tobytes()
            if len(part) < 40:
                self.known[part] = ids
        return ids

    def ids(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids."""
        if any(s in text for s in self.special):
            if self.whole is None:
                import tokenizers

                self.whole = tokenizers.Tokenizer.from_file(self.path)
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        return b"".join(map(self._part, _BEFORE_WORD(text)))


class Tournament:
    """Free room of bins; each inner node holds the most of its two children."""

    def __init__(self, bins: int, room: int):
        self.leaves = 1 << max(0, (bins - 1).bit_length())
        self.most = [room] * (2 * self.leaves)

    def first(self, need: int) -> int:
        """The first bin with that much room; there is one for each item."""
        at = 1
        while at < self.leaves:
            at *= 2
            if self.most[at] < need:
                at += 1
        return at - self.leaves

    def take(self, which: int, need: int) -> None:
        at = which + self.leaves
        self.most[at] -= need
        while at > 1:
            at //= 2
            self.most[at] = max(self.most[2 * at], self.most[2 * at + 1])


def first_fit_decreasing(lengths: list[int], room: int) -> list[list[tuple[int, int, int]]]:
    """Bins of (item, start, length), by falling length; equal lengths keep their order."""
    bins: list[list[tuple[int, int, int]]] = []
    tree = Tournament(len(lengths), room)
    for item in sorted(range(len(lengths)), key=lambda k: -lengths[k]):
        which = tree.first(lengths[item])
        tree.take(which, lengths[item])
        if which == len(bins):
            bins.append([])
        bins[which].append((item, 0, lengths[item]))
    return bins


def close_gaps(bins: list[list[tuple[int, int, int]]], room: int) -> list[list[tuple[int, int, int]]]:
    """Fills the fullest bins from the emptiest; the last one is cut into powers of two."""
    bins = sorted((b[:] for b in bins), key=lambda b: -sum(p[2] for p in b))
    fill = [sum(p[2] for p in b) for b in bins]
    i, j = 0, len(bins) - 1
    while i < j:
        if fill[i] == room:
            i += 1
            continue
        item, start, length = bins[j].pop()
        cut = min(room - fill[i], length)
        bins[i].append((item, start + length - cut, cut))
        fill[i], fill[j] = fill[i] + cut, fill[j] - cut
        if cut < length:
            bins[j].append((item, start, length - cut))
        if not fill[j]:
            j -= 1
    out, rest = bins[:i], bins[i][:] if i < len(bins) else []
    left = sum(p[2] for p in rest)
    while left:
        size = room if left >= room else 1 << (left.bit_length() - 1)
        part, need = [], size
        while need:
            item, start, length = rest.pop()
            cut = min(need, length)
            part.append((item, start, cut))
            if cut < length:
                rest.append((item, start + cut, length - cut))
            need -= cut
        out.append(part)
        left -= size
    return out


def _cutter(path: str, room: int, groups: int, with_ids: bool):
    def cut(batches: Iterator) -> Iterator:
        import pyarrow as pa

        tokenizer = once(path, lambda: Tokenizer(path))
        names = ["id", "start", "length", "ids", "crc", "doc_tokens", "grp", "mixed"]
        kinds = [None, pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
        for batch in some_rows(batches):
            rows: list[list] = [[] for _ in names]
            for k, (text, key) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                ids = tokenizer.ids(text or "") + END_ID.to_bytes(4, "little")
                total = len(ids) // 4
                for start in range(0, total, room):
                    part = ids[4 * start : 4 * (start + room)]
                    size = len(part) // 4
                    keep = with_ids or size < room
                    row = (k, start, size, part if keep else b"", zlib.crc32(part), total, key % groups, key)
                    for column, value in zip(rows, row, strict=True):
                        column.append(value)
                if sum(map(len, rows[3][-64:])) and len(rows[0]) >= 2000:
                    yield _table(batch, rows, names, kinds)
                    rows = [[] for _ in names]
            if rows[0]:
                yield _table(batch, rows, names, kinds)

    return cut


def _table(batch, rows: list[list], names: list[str], kinds: list):
    import pyarrow as pa

    first = batch.column(0).take(pa.array(rows[0], pa.int64()))
    return pa.RecordBatch.from_arrays([first, *(pa.array(r, k) for r, k in zip(rows[1:], kinds[1:], strict=True))], names)


def _packer(room: int, most: int, with_ids: bool):
    def flush(held: list[dict], group: int, used: int) -> tuple[list[dict], int]:
        bins = close_gaps(first_fit_decreasing([r["length"] for r in held], room), room)
        out = []
        for k, pieces in enumerate(bins):
            offset = 0
            for item, start, length in pieces:
                row = held[item]
                ids = row["ids"][4 * start : 4 * (start + length)]
                out.append({
                    "id": row["id"], "start": row["start"] + start, "length": length, "ids": ids if with_ids else b"",
                    "ids_crc32": zlib.crc32(ids), "doc_tokens": row["doc_tokens"], "sequence_id": (group << 32) + used + k,
                    "offset": offset,
                })
                offset += length
        return out, used + len(bins)

    def pack(batches: Iterator) -> Iterator:
        import pyarrow as pa

        schema, group, used, held = None, None, 0, []
        for batch in batches:
            schema = schema or pa.schema([
                ("id", batch.schema.field(0).type), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()),
                ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()),
            ])
            out: list[dict] = []
            for row in batch.to_pylist():
                if row["grp"] != group or len(held) >= most:
                    more, used = flush(held, group, used) if held else ([], used)
                    out, held = out + more, []
                    if row["grp"] != group:
                        group, used = row["grp"], 0
                if row["length"] == room:
                    out.append({
                        "id": row["id"], "start": row["start"], "length": room, "ids": row["ids"], "ids_crc32": row["crc"],
                        "doc_tokens": row["doc_tokens"], "sequence_id": (group << 32) + used, "offset": 0,
                    })
                    used += 1
                else:
                    held.append(row)
            yield pa.RecordBatch.from_pylist(out, schema)
        if held:
            yield pa.RecordBatch.from_pylist(flush(held, group, used)[0], schema)

    return pack


def packed(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", path: str | None = None, room: int = 1024,
    group_docs: int = 2048, with_ids: bool = True,
) -> DataFrame:
    """One row per piece: id, start, length, ids, ids_crc32, doc_tokens, sequence_id, offset.

    A document's ids are those of its text, then id 0; null text counts as
    empty, so each row has at least one piece. Each id lies in one piece.
    Sequences have `room` ids or a power of two below it. `ids` are
    little-endian unsigned 32-bit numbers, left empty without `with_ids`.

    Groups have about `group_docs` documents and are packed in runs of at most
    twice as many, so that rows that repeat one id and text can't fill a task.
    Repeated ids and null ids are documents of their own.
    """
    if path is None:
        from public_tokenizers import path as path_of

        path = path_of("byte_bpe_50k.json")
    frame = docs.select(
        F.col(doc_id).alias("id"), F.col(text).alias("text"),
        F.xxhash64(F.col(doc_id), F.col(text)).bitwiseAND((1 << 62) - 1).alias("key"),
    )
    groups = -(-docs.count() // group_docs) or 1
    pieces = frame.mapInArrow(
        _cutter(path, room, groups, with_ids),
        with_type_of(frame, {"id": "id"}, "start long, length long, ids binary, crc long, doc_tokens long, grp long, mixed long"),
    )
    dealt = pieces.repartition("grp").sortWithinPartitions("grp", "mixed", "id", "start")
    out = dealt.mapInArrow(
        _packer(room, 2 * group_docs, with_ids),
        with_type_of(
            frame, {"id": "id"}, "start long, length long, ids binary, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
        ),
    )
    return out.withColumnRenamed("id", doc_id)
