"""Maximal periodic stretches of the words of a text.

A stretch with period q and at least four times its length agrees with itself,
q words on, at three multiples of q in a row. For each q the words at the
multiples of q, a harmonic number of them in all, give the candidates; their
exact extensions to both sides are common extensions of two places q words
apart, which a recompressed grammar of the words answers. No suffix array is
built.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, functions as F

from .recompression import Grammar
from .tables import with_type_of
from .words import as_bytes

_BATCH = 1 << 18  # words that are searched together; a longer text stands alone


def runs_of(texts: list[np.ndarray], least: int = 6, times: int = 4) -> list[np.ndarray]:
    """For each sequence of symbols from 0: rows (start, length, period) of its runs, by start, then period.

    A run is a stretch of length max(least, times * period) or more whose
    smallest period is `period` and that no neighbour extends. `times` is 4 at
    least.
    """
    sizes = np.asarray([len(t) for t in texts], np.int64)
    order = np.argsort(-sizes, kind="stable")  # the texts that are long enough for a period come first
    sizes = sizes[order]
    starts = np.cumsum(sizes + 1) - sizes  # a mark before each text and one at the end
    top = 1 + max((int(t.max()) for t in texts if len(t)), default=0)
    symbols = np.empty(int(sizes.sum()) + len(texts) + 1, np.int64)
    symbols[starts - 1] = top + np.arange(len(texts))
    symbols[-1] = top + len(texts)
    for k, at in zip(order.tolist(), starts.tolist(), strict=True):
        symbols[at : at + len(texts[k])] = texts[k]
    found = _runs(symbols, starts, sizes, least, times)
    owner = np.searchsorted(starts, found[:, 0], "right") - 1
    found[:, 0] -= starts[owner]
    rank = np.lexsort((found[:, 2], found[:, 0], owner))
    found, owner = found[rank], owner[rank]
    cuts = np.searchsorted(owner, np.arange(len(texts) + 1))
    out: list[np.ndarray] = [found[:0]] * len(texts)
    for i, k in enumerate(order.tolist()):
        out[k] = found[cuts[i] : cuts[i + 1]]
    return out


def _candidates(symbols: np.ndarray, starts: np.ndarray, sizes: np.ndarray, least: int, times: int) -> tuple[np.ndarray, ...]:
    """Chains (period, first multiple, last multiple): at each of them a word and the two next multiples agree with those one period on."""
    periods, firsts, lasts = [], [], []
    for q in range(1, int(sizes.max(initial=0)) // times + 1):
        some = int(np.searchsorted(-sizes, -max(least, times * q), "right"))
        if not some:
            break
        end = int(starts[some - 1] + sizes[some - 1])
        agree = symbols[: end - q : q] == symbols[q:end:q]
        hit = np.flatnonzero(agree[:-2] & agree[1:-1] & agree[2:])
        if len(hit):
            breaks = np.flatnonzero(np.diff(hit) > 1)
            firsts.append(hit[np.concatenate([[0], breaks + 1])])
            lasts.append(hit[np.concatenate([breaks, [len(hit) - 1]])])
            periods.append(np.full(len(firsts[-1]), q))
    none = np.zeros(0, np.int64)
    return tuple(np.concatenate(x) if x else none for x in (periods, firsts, lasts))


def _runs(symbols: np.ndarray, starts: np.ndarray, sizes: np.ndarray, least: int, times: int) -> np.ndarray:
    period, now, last = _candidates(symbols, starts, sizes, least, times)
    if not len(period):
        return np.zeros((0, 3), np.int64)
    grammar = Grammar(symbols)
    found = []
    while len(period):
        at = now * period
        right = grammar.extensions(at, at + period)
        left = grammar.extensions(at - 1, at + period - 1, back=True)
        found.append(np.stack([at - left, left + right + period, period], 1))
        now = -(-(at + right) // period)  # the chain's next multiple beyond this stretch
        more = now <= last
        period, now, last = period[more], now[more], last[more]
    rows = np.concatenate(found)
    rows = rows[rows[:, 1] >= np.maximum(least, times * rows[:, 2])]
    rows = rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))]
    # a stretch that shows several periods has the smallest of them, which divides the others
    fresh = np.concatenate([[True], (rows[1:, :2] != rows[:-1, :2]).any(1)])[: len(rows)]
    return rows[fresh]


def collapsed(n: int, runs: np.ndarray) -> np.ndarray:
    """Which of n words stay: all but those inside a run after its first period."""
    steps = np.zeros(n + 1, np.int64)
    np.add.at(steps, runs[:, 0] + runs[:, 2], 1)
    np.add.at(steps, runs[:, 0] + runs[:, 1], -1)
    return np.cumsum(steps)[:n] == 0


def _scanner(least: int, times: int):
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        shape = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

        def flush(ids, rows: list[list[bytes]], seen: list[np.ndarray]) -> pa.RecordBatch:
            found = runs_of(seen, least, times)
            texts = [
                b" ".join(words if not len(runs) else [words[k] for k in np.flatnonzero(collapsed(len(words), runs)).tolist()])
                for words, runs in zip(rows, found, strict=True)
            ]
            every = np.concatenate([*found, np.zeros((0, 3), np.int64)])
            offsets = np.cumsum([0] + [len(x) for x in found])
            spans = pa.StructArray.from_arrays([pa.array(every[:, k]) for k in range(3)], ["start", "length", "period"])
            return pa.RecordBatch.from_arrays(
                [
                    ids, pa.array([len(w) for w in rows], pa.int64()), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), spans).cast(shape),
                    pa.array(texts, pa.binary()).cast(pa.string()),
                ],
                ["id", "n_words", "runs", "collapsed"],
            )

        for batch in batches:
            names: dict[bytes, int] = {}
            rows, seen, held, done = [], [], 0, 0
            for k, text in enumerate(as_bytes(batch.column(1))):
                words = (text or b"").split()  # at 09-0D and 20, as bytes split
                if held and held + len(words) > _BATCH:
                    yield flush(batch.column(0).slice(done, len(rows)), rows, seen)
                    names, rows, seen, held, done = {}, [], [], 0, k
                rows.append(words)
                seen.append(np.fromiter((names.setdefault(w, len(names)) for w in words), np.int64, len(words)))
                held += len(words)
            if rows:
                yield flush(batch.column(0).slice(done, len(rows)), rows, seen)

    return run


def periodic_runs(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: int = 6, times: int = 4) -> DataFrame:
    """One row per row of `docs`: id, n_words, runs, collapsed.

    Words are runs of anything but ASCII white space, numbered from 0. `runs`
    holds (start, length, period) of every maximal periodic stretch of at
    least `least` words and `times` (4 or more) periods, by start, then period.
    `collapsed` joins by one blank the words that stay when each run is cut to
    its first period. Null, empty and blank texts have no words, no runs and
    an empty rest. Rows are judged one by one, so ids may be null or repeat.
    Other columns are ignored. A task holds the words of one text at least,
    and about a quarter million of them otherwise.
    """
    if times < 4:
        raise ValueError("times must be 4 at least")
    frame = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"))
    schema = with_type_of(frame, {"id": "id"}, "n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string")
    return frame.mapInArrow(_scanner(least, times), schema).withColumnRenamed("id", doc_id)
