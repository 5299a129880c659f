"""Helpers that run inside tasks: words of many texts as arrays of 64-bit hashes.

Texts are UTF-8 bytes. A table maps each byte to the byte that is read for
it, 0 for bytes between words. Hashes depend on the word alone, so that all
tasks and runs agree.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

_BLANK = re.compile(rb"[\x09-\x0D\x20]")
_MADE: dict[str, object] = {}


def once(token: str, make):
    """What `make` returns, kept by the worker process until another token is asked for."""
    if token not in _MADE:
        _MADE.clear()
        _MADE[token] = make()
    return _MADE[token]


def byte_table(between: str) -> np.ndarray:
    """Table in which A-Z become a-z and the bytes of the class `between` are 0; byte 0 is always between words."""
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    stop = re.compile(between.encode("latin-1"))
    table[[k for k in range(256) if stop.fullmatch(bytes([k]))] + [0]] = 0
    return table


#: Words are runs of anything but white space.
BLANKS = byte_table(r"[\x09-\x0D\x20]")
#: Words are runs of digits, ASCII letters and all that is not ASCII.
ALNUM = byte_table(r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]")
#: Words are runs of ASCII letters and all that is not ASCII.
LETTERS = byte_table(r"[\x00-\x40\x5B-\x60\x7B-\x7F]")

_rng = np.random.default_rng(20_240_501)
_VALUES = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_TOGETHER = 1 << 18  # bytes of words that are hashed at once


def mix(x: np.ndarray) -> np.ndarray:
    """The finishing step of splitmix64: a bijection of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@dataclass
class Block:
    """Words of some texts: row of the text, place in `data`, length in bytes."""

    data: np.ndarray
    row: np.ndarray
    start: np.ndarray
    length: np.ndarray

    def hashes(self, most: int | None = None) -> np.ndarray:
        """A hash per word, or of its first `most` bytes."""
        if not len(self.start):
            return np.zeros(0, np.uint64)
        lengths = self.length if most is None else np.minimum(self.length, most)
        powers = np.cumprod(np.full(int(lengths.max()), _BASE))
        out = np.empty(len(lengths), np.uint64)
        ends = np.cumsum(lengths)
        at = 0
        while at < len(lengths):  # several arrays of 8 bytes a byte are held, so some words at a time
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + _TOGETHER, "right")))
            length = lengths[at:to]
            first = np.cumsum(length) - length
            pos = np.arange(int(length.sum())) - np.repeat(first, length)
            values = _VALUES[self.data[np.repeat(self.start[at:to], length) + pos]] * powers[pos]
            out[at:to] = mix(np.add.reduceat(values, first) + length.astype(np.uint64))
            at = to
        return out


def blocks(texts: list[bytes | None], table: np.ndarray, size: int = 1 << 21) -> Iterator[Block]:
    """Words of all texts, about `size` bytes at a time; a longer text is cut at white space only."""
    rows: list[int] = []
    parts: list[bytes] = []
    held = 0
    for row, text in enumerate(texts):
        at, end = 0, len(text) if text else 0
        while at < end:
            cut = end
            if end - at > size and (blank := _BLANK.search(text, at + size)):
                cut = blank.end()
            rows.append(row)
            parts.append(text[at:cut])
            held, at = held + cut - at, cut
            if held >= size:
                yield _block(rows, parts, table)
                rows, parts, held = [], [], 0
    if parts:
        yield _block(rows, parts, table)


def _block(rows: list[int], parts: list[bytes], table: np.ndarray) -> Block:
    data = table[np.frombuffer(b"\0".join(parts) + b"\0", np.uint8)]
    inside = np.zeros(len(data) + 1, np.int8)
    inside[1:] = data > 0
    steps = np.diff(inside)
    start = np.flatnonzero(steps == 1)
    length = np.flatnonzero(steps == -1) - start
    begins = np.cumsum([0] + [len(p) + 1 for p in parts[:-1]])
    return Block(data, np.asarray(rows)[np.searchsorted(begins, start, "right") - 1], start, length)


def hashed_words(texts: list[bytes | None], table: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(row, hashes of its words in order) for every text, in order; none for null."""
    none = np.zeros(0, np.uint64)
    at, kept = 0, []
    for block in blocks(texts, table):
        hashes = block.hashes()
        cuts = np.flatnonzero(np.diff(block.row)) + 1
        for rows, part in zip(np.split(block.row, cuts), np.split(hashes, cuts), strict=True):
            if not len(rows):
                continue
            while at < rows[0]:
                yield at, np.concatenate(kept) if kept else none
                at, kept = at + 1, []
            kept.append(part)
    while at < len(texts):
        yield at, np.concatenate(kept) if kept else none
        at, kept = at + 1, []


def shingles(words: np.ndarray, width: int) -> np.ndarray:
    """Sorted distinct hashes of all runs of `width` words; of the whole if it has fewer, none if it has none."""
    if not len(words):
        return words
    width = min(width, len(words))
    out = np.full(len(words) - width + 1, np.uint64(width))
    for k in range(width):
        out = mix(out * _BASE + words[k : len(words) - width + 1 + k])
    return np.unique(out)


def as_bytes(column) -> list[bytes | None]:
    """UTF-8 bytes of an Arrow string column."""
    import pyarrow as pa

    return column.cast(pa.binary()).to_pylist()


def some_rows(batches: Iterator, most: int = 2000) -> Iterator:
    """Arrow batches cut to at most `most` rows, so that a worker holds the texts and results of a few thousand rows only."""
    for batch in batches:
        for at in range(0, batch.num_rows, most):
            yield batch.slice(at, most)
