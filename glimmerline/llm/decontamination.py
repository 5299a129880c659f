"""Benchmark decontamination: one Aho-Corasick automaton over the words of all benchmark items.

A pattern is a window of words of an item. The automaton runs over word
numbers instead of characters, so that it grows with the items' words, and
every text is read once. Offsets of the hits are those of the given text:
folding A-Z keeps every position.
"""

from __future__ import annotations

import re
import uuid
from collections import defaultdict
from collections.abc import Iterable, Iterator
from itertools import repeat

from pyspark.sql import DataFrame, functions as F, types as T

from .words import once, some_rows

_WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
HITS = T.ArrayType(T.LongType())


def fold(text: str) -> str:
    """A-Z as a-z; every other character and every position stays."""
    return text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")


def words_of(text: str | None) -> list[str]:
    return _WORD.findall(fold(text)) if text else []


def windows_of(words: list[str], size: int) -> set[tuple[str, ...]]:
    """All runs of `size` words; a shorter, non-empty text is one run."""
    size = min(size, len(words))
    return {tuple(words[k : k + size]) for k in range(len(words) - size + 1)} if size else set()


def build_automaton(items: list[tuple[str, str]], size: int):
    """(word numbers, automaton) of (item id, text) rows; a pattern's value is its length and its items."""
    import ahocorasick

    owners: dict[tuple[str, ...], set[str]] = defaultdict(set)
    for item, text in items:
        for window in windows_of(words_of(text), size):
            owners[window].add(item)
    numbers: dict[str, int] = {}
    automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
    for window in sorted(owners):
        key = tuple(numbers.setdefault(w, len(numbers) + 1) for w in window)
        automaton.add_word(key, (len(window), tuple(sorted(owners[window]))))
    if owners:
        automaton.make_automaton()
    return numbers, automaton if owners else None


def find(text: str | None, numbers: dict[str, int], automaton) -> tuple[int, list[tuple[int, int]], set[str]]:
    """Words of the text, runs [first, end) of hit words, items with a window in it."""
    words = words_of(text)
    runs: list[tuple[int, int]] = []
    items: set[str] = set()
    if automaton is not None and words:
        for last, (size, owners) in automaton.iter(tuple(map(numbers.get, words, repeat(0)))):
            first = last + 1 - size
            items.update(owners)
            while runs and runs[-1][1] >= first:
                first = min(first, runs.pop()[0])
            runs.append((first, last + 1))
    return len(words), runs, items


def spans_of(text: str, runs: Iterable[tuple[int, int]]) -> list[int]:
    """Start and end characters of runs of words, flat."""
    edges = [(m.start(), m.end()) for m in _WORD.finditer(fold(text))]
    return [x for first, end in runs for x in (edges[first][0], edges[end - 1][1])]


def _scanner(shared, token: str, size: int, last: bool):
    def scan(batches: Iterator) -> Iterator:
        import pyarrow as pa

        numbers, automaton = once(token, lambda: build_automaton(shared.value, size))
        for batch in some_rows(batches):
            texts = batch.column(1).to_pylist()
            counts, n_hit, hits, items, spans = [], [], [], [], []
            for text, before, had in zip(texts, batch.column(4).to_pylist(), batch.column(5).to_pylist(), strict=True):
                n, runs, found = find(text, numbers, automaton)
                runs = _merged([*zip(before[::2], before[1::2], strict=True), *runs])
                counts.append(n)
                n_hit.append(sum(end - first for first, end in runs))
                hits.append([x for run in runs for x in run])
                items.append(sorted({*had, *found}))
                spans.append(spans_of(text, runs) if last and runs else [])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), pa.nulls(len(texts), pa.string()) if last else batch.column(1), pa.array(counts, pa.int64()),
                    pa.array(n_hit, pa.int64()), pa.array(hits, pa.list_(pa.int64())), pa.array(items, pa.list_(pa.string())),
                    pa.array(spans, pa.list_(pa.int64())),
                ],
                ["id", "text", "n_words", "n_hit", "hits", "items", "spans"],
            )

    return scan


def _merged(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for first, end in sorted(runs):
        if out and first <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((first, end))
    return out


def contaminated_words(
    docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id",
    item_text: str = "text", window: int = 10, shard_bytes: int = 32 << 20,
) -> DataFrame:
    """One row per document: id, n_words, n_hit, items, spans, contaminated.

    `items` are the ids, as sorted strings, of the items of which a window
    occurs; `spans` are [start, end) characters of runs of hit words in the
    given text. Null and empty texts have no words. Items with null or empty
    text have no windows; items with null id are named `null`; items that
    share an id count once. Repeated documents give repeated rows.

    The automaton is broadcast. If the benchmark has more than `shard_bytes`
    bytes of text, it is split into shards below that size, and the documents
    pass one automaton after the other; each pass is narrow.
    """
    items = benchmark.select(F.coalesce(F.col(item_id).cast("string"), F.lit("null")).alias("item"), F.col(item_text).alias("text"))
    items = items.filter("text is not null")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = -(-size // shard_bytes) or 1
    at = docs.select(
        F.col(doc_id).alias("id"), F.col(text).alias("text"), F.lit(0).cast("long").alias("n_words"), F.lit(0).cast("long").alias("n_hit"),
        F.array().cast(HITS).alias("hits"), F.array().cast("array<string>").alias("items"), F.array().cast(HITS).alias("spans"),
    )
    schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in at.schema])
    for k in range(shards):
        part = items if shards == 1 else items.filter(F.pmod(F.xxhash64("item", "text"), F.lit(shards)) == k)
        rows = [(r.item, r.text) for r in part.collect()]  # below shard_bytes, or one item
        shared = docs.sparkSession.sparkContext.broadcast(rows)
        at = at.mapInArrow(_scanner(shared, uuid.uuid4().hex, window, k == shards - 1), schema)
    return at.select(F.col("id").alias(doc_id), "n_words", "n_hit", "items", "spans", (F.col("n_hit") > 0).alias("contaminated"))
