"""Byte stretches that occur more than once in a corpus, by suffix arrays of small groups of text.

A corpus has no one suffix array that a task could hold. Its windows, all
strings of `length` bytes, are therefore dealt by content: a window belongs to
its least-hashed gram of k bytes (winnowing, Schleimer et al., 2003), so that
equal windows belong to equal grams. Windows of a text that share one gram make
a segment. Segments of a gram that occurs once hold nothing repeated; the
others are reduced to distinct texts with a count, and a text that occurs
again is repeated whole. The unlike texts of a gram form one string, in whose
suffix array (`suffix_groups`) equal windows are neighbours.

A gram may stand in any number of different texts, as the heart of a common
passage does. Texts of such a gram are dealt again by longer grams, of which
fewer windows can share one; the last grams are the windows themselves, whose
count needs no task of its own. So no task sees more than `most` texts of a
gram, and nothing is left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, functions as F

from ..session import spread_out
from .suffix_groups import suffix_arrays
from .tables import stored, with_type_of
from .words import mix

_BLOCK = 1 << 18  # window starts that are read at once
_FACTOR = 0x9E3779B97F4A7C15
_VALUES = np.random.default_rng(11).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash's factor and of its inverse."""
    if not _POWERS or len(_POWERS[0]) < n:
        _POWERS[:] = []
        for base in (_FACTOR, pow(_FACTOR, -1, 2**64)):
            steps = np.full(max(n, _BLOCK + 4096), np.uint64(base))
            steps[0] = 1
            _POWERS.append(np.cumprod(steps))
    return _POWERS[0], _POWERS[1]


def segments(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, length: int, k: int) -> tuple[np.ndarray, ...]:
    """(row, first window, end of windows, key) of each segment of the texts data[starts:ends], in places of `data`."""
    n, width = len(data), length - k + 1
    none = np.zeros(0, np.int64)
    if n < length:
        return none, none, none, none
    up, down = _powers(n)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_VALUES[data] * up[:n], out=sums[1:])
    keys = mix((sums[k:] - sums[:-k]) * down[: n - k + 1])
    low = np.uint64(24)
    marked = (keys >> low << low) | np.arange(len(keys), dtype=np.uint64)  # the first of equal grams wins
    rows = np.concatenate([marked, np.full(-len(marked) % width, np.uint64(2**64 - 1))]).reshape(-1, width)
    ahead = np.minimum.accumulate(rows[:, ::-1], 1)[:, ::-1].ravel()
    behind = np.minimum.accumulate(rows, 1).ravel()
    count = n - length + 1
    least = np.minimum(ahead[:count], behind[width - 1 : width - 1 + count])
    long = ends - starts >= length
    steps = np.zeros(count + 1, np.int32)
    steps[starts[long]] += 1
    steps[ends[long] - length + 1] -= 1
    real = np.cumsum(steps)[:count] > 0
    fresh = np.concatenate([[True], least[1:] != least[:-1]])
    fresh[starts[long]] = True
    first = np.flatnonzero(real & fresh)
    last = np.flatnonzero(real & np.concatenate([fresh[1:] | ~real[1:], [True]]))
    at = (least[first] & np.uint64((1 << 24) - 1)).astype(np.int64)
    return np.searchsorted(starts, first, "right") - 1, first, last + 1, keys[at].astype(np.int64)


def _parts(texts: list[bytes], length: int) -> Iterator[tuple[np.ndarray, bytes, np.ndarray, np.ndarray]]:
    """(row of each text, data, starts, offsets within the texts): some texts, or a part of a long one, at a time."""
    rows, parts, offsets, held = [], [], [], 0
    for row, text in enumerate(texts):
        for at in range(0, max(len(text) - length + 1, 0), _BLOCK):
            part = text[at : at + _BLOCK + length - 1]
            if held and held + len(part) > _BLOCK:
                yield np.asarray(rows), b"".join(parts), np.cumsum([0] + [len(p) for p in parts[:-1]]), np.asarray(offsets)
                rows, parts, offsets, held = [], [], [], 0
            rows.append(row)
            parts.append(part)
            offsets.append(at)
            held += len(part)
    if rows:
        yield np.asarray(rows), b"".join(parts), np.cumsum([0] + [len(p) for p in parts[:-1]]), np.asarray(offsets)


def _segmenter(length: int, k: int):
    """Rows (a, b, n, bytes) to rows (a, b, n, lo, hi, key, f1, f2): windows lo to hi of a text share a gram."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            own = [batch.column(c).to_numpy() for c in range(3)]
            for rows, data, starts, offsets in _parts(batch.column(3).to_pylist(), length):
                view = memoryview(data)
                ends = np.append(starts[1:], len(data))
                row, lo, hi, key = segments(np.frombuffer(data, np.uint8), starts, ends, length, k)
                print_ = np.frombuffer(
                    b"".join(hashlib.blake2b(view[s:e], digest_size=16).digest() for s, e in zip(lo.tolist(), (hi + length - 1).tolist(), strict=True)),
                    np.int64,
                ).reshape(-1, 2)
                shift = offsets[row] - starts[row]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c[rows[row]]) for c in own] + [pa.array(x) for x in (lo + shift, hi + shift, key, print_[:, 0], print_[:, 1])],
                    ["a", "b", "n", "lo", "hi", "key", "f1", "f2"],
                )

    return run


def repeated_windows(texts: list[bytes], groups: np.ndarray, length: int) -> np.ndarray:
    """Places, in the joined texts, of the windows that start more than once among the texts of their group.

    Texts of a group stand together. The texts of a group make one string,
    each closed by a symbol of its own.
    """
    sizes = np.asarray([len(t) for t in texts], np.int64)
    data = b"\0".join([*texts, b""])  # a byte after each text, for its closing symbol
    starts = np.cumsum(sizes + 1) - sizes - 1
    symbols = np.frombuffer(data, np.uint8).astype(np.int64)
    begins = np.flatnonzero(np.concatenate([[True], groups[1:] != groups[:-1]]))
    member = np.arange(len(texts)) - np.repeat(begins, np.diff(np.append(begins, len(texts))))
    symbols[starts + sizes] = 256 + member
    whole = np.add.reduceat(sizes + 1, begins)
    ranked = suffix_arrays(symbols, whole)
    text = np.searchsorted(starts, ranked, "right") - 1
    window = ranked + length <= starts[text] + sizes[text]
    ranked, owner = ranked[window], np.cumsum(np.isin(np.arange(len(texts)), begins))[text[window]]
    words = np.ndarray((len(data),), "<u8", data + bytes(8), 0, (1,))
    open_ = np.flatnonzero(owner[1:] == owner[:-1])
    for at in [*range(0, length - 8, 8), length - 8]:
        open_ = open_[words[ranked[open_] + at] == words[ranked[open_ + 1] + at]]
    again = np.zeros(len(ranked), bool)
    again[open_] = again[open_ + 1] = True
    found = np.sort(ranked[again])
    return found - (np.searchsorted(starts, found, "right") - 1)


def _finder(length: int, batch_bytes: int = 1 << 19):
    """Rows (key, f1, f2, n, bytes), sorted by key, to rows (f1, f2, lo, hi): windows of each text with n = 1 that others of its key hold."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        def flush(keys: list, rows: list, texts: list) -> pa.RecordBatch:
            spots = repeated_windows(texts, np.asarray(keys), length)
            sizes = np.asarray([len(t) for t in texts], np.int64)
            starts = np.cumsum(sizes) - sizes
            flag = np.zeros(int(sizes.sum()) + 1, bool)
            flag[spots] = True
            f1, f2, n = (np.asarray(x, np.int64) for x in zip(*rows, strict=True))
            for t in np.flatnonzero(n > 1).tolist():
                flag[starts[t] : starts[t] + sizes[t]] = False
            steps = np.diff(np.concatenate([[0], flag.view(np.int8)]))
            lo, hi = np.flatnonzero(steps == 1), np.flatnonzero(steps == -1)
            row = np.searchsorted(starts, lo, "right") - 1
            return pa.RecordBatch.from_arrays([pa.array(x) for x in (f1[row], f2[row], lo - starts[row], hi - starts[row])], ["f1", "f2", "lo", "hi"])

        keys, rows, texts, held = [], [], [], 0
        for batch in batches:
            for key, f1, f2, n, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if rows and rows[-1][:2] == (f1, f2) and keys[-1] == key:
                    continue  # rows that are alike in id and text
                if held > batch_bytes and keys[-1] != key:
                    yield flush(keys, rows, texts)
                    keys, rows, texts, held = [], [], [], 0
                keys.append(key)
                rows.append((f1, f2, n))
                texts.append(text)
                held += len(text)
        if rows:
            yield flush(keys, rows, texts)

    return run


def _repeats(texts: DataFrame, length: int, grams: tuple[int, ...], most: int) -> DataFrame:
    """Rows (a, b, lo, hi): window starts lo to hi of text (a, b) occur again among all (a, b, n, bytes)."""
    dealt = stored(texts.mapInArrow(_segmenter(length, grams[0]), "a long, b long, n long, lo long, hi long, key long, f1 long, f2 long"), "segments")
    # written first: a join of two plain shuffles lets Spark split the rows of a key that very many segments share
    again = stored(dealt.groupBy("key").agg(F.sum("n").alias("of_key")).filter("of_key > 1").select("key"), "again")
    shared = stored(dealt.join(again, "key"), "shared")
    unlike = shared.groupBy("key", "f1", "f2").agg(F.sum("n").alias("n"), F.min(F.struct("a", "b", "lo", "hi")).alias("at"))
    counts = unlike.groupBy("key").agg(F.count("*").alias("texts"))
    part = F.struct("key", "f1", "f2", "n", "texts", "at.lo", "at.hi")
    placed = stored(unlike.join(counts, "key").select("key", "f1", "f2", "n", "texts", "at"), "unlike")
    copied = placed.filter("n > 1").select("f1", "f2", F.lit(0).cast("long").alias("lo"), (F.col("at.hi") - F.col("at.lo")).alias("hi"))
    wanted = placed.filter("texts > 1").groupBy("at.a", "at.b").agg(F.collect_list(part).alias("parts"))  # at most a document's segments
    cut = F.expr(f"substring(bytes, cast(part.lo + 1 as int), cast(part.hi - part.lo + {length - 1} as int))")
    each = texts.join(wanted, ["a", "b"]).select("bytes", F.explode("parts").alias("part"))
    pieces = stored(each.select("part.key", "part.f1", "part.f2", "part.n", "part.texts", cut.alias("bytes")), "pieces")
    small = spread_out(pieces.filter(F.col("texts") <= most).select("key", "f1", "f2", "n", "bytes"), "key").sortWithinPartitions("key", "f1", "f2")
    found = copied.unionByName(small.mapInArrow(_finder(length), "f1 long, f2 long, lo long, hi long"))
    hot = pieces.filter(F.col("texts") > most).select(F.col("f1").alias("a"), F.col("f2").alias("b"), "n", "bytes")
    if len(grams) > 1 and not hot.isEmpty():
        finer = _repeats(stored(hot.dropDuplicates(["a", "b"]), "hot"), length, grams[1:], most)
        finer = finer.join(hot.filter("n = 1").select("a", "b"), ["a", "b"], "left_semi")  # copied texts are found whole, in one stretch
        found = found.unionByName(finer.select(F.col("a").alias("f1"), F.col("b").alias("f2"), "lo", "hi"))
    found = stored(found, "found").withColumnsRenamed({"lo": "from", "hi": "to"})
    return shared.join(found, ["f1", "f2"]).select("a", "b", (F.col("lo") + F.col("from")).alias("lo"), (F.col("lo") + F.col("to")).alias("hi"))


def _merger(length: int):
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        span = pa.struct([("start", pa.int64()), ("end", pa.int64())])
        for batch in batches:
            spans, kept, sizes = [], [], []
            for text, parts in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                own: list[dict] = []
                for lo, hi in sorted((p["lo"], p["hi"] + length - 1) for p in parts or []):
                    if own and lo <= own[-1]["end"]:
                        own[-1]["end"] = max(own[-1]["end"], hi)
                    else:
                        own.append({"start": lo, "end": hi})
                edges = [0, *(x for s in own for x in (s["start"], s["end"])), len(text)]
                spans.append(own)
                kept.append(b"".join(text[s:e] for s, e in zip(edges[::2], edges[1::2], strict=True)))
                sizes.append(len(text))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(spans, pa.list_(span)), pa.array(kept, pa.binary())],
                ["id", "n_bytes", "spans", "kept"],
            )

    return run


def without_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = 400, most: int = 48) -> DataFrame:
    """One row per row of `docs`: id, n_bytes, spans, kept.

    A byte of a UTF-8 text is repeated if some `length` bytes of one text
    that cover it also start anywhere else, in any row or in the same one;
    texts are judged as given, and all occurrences count. `spans` lists the
    maximal stretches [start, end) of repeated bytes, `kept` is the text
    without them (bytes: a cut may fall inside a character). Null text is
    empty; empty and short texts have no span. Rows that share an id, or have
    none, are texts of their own; equal rows repeat each other. Other columns
    are ignored.

    `most` bounds the texts of one gram that a task compares; a gram of more
    is dealt again by longer grams. `length` is 16 at least.
    """
    if length < 16:
        raise ValueError("length must be 16 at least")
    frame = docs.select(F.col(doc_id).alias("id"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("bytes"))
    frame = frame.withColumns({"a": F.xxhash64("id", "bytes"), "b": F.xxhash64(F.lit(1), "bytes", "id")})
    grams = tuple(sorted({max(8, length * share // 100) for share in (40, 70, 90, 100)}))
    found = _repeats(frame.filter(F.length("bytes") >= length).select("a", "b", F.lit(1).cast("long").alias("n"), "bytes"), length, grams, most)
    held = found.groupBy("a", "b").agg(F.collect_set(F.struct("lo", "hi")).alias("parts"))
    joined = frame.join(held, ["a", "b"], "left").select("id", "bytes", "parts")
    schema = with_type_of(frame, {"id": "id"}, "n_bytes long, spans array<struct<start:long,end:long>>, kept binary")
    return joined.mapInArrow(_merger(length), schema).withColumnRenamed("id", doc_id)
