"""Array, hash and label columns."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, functions as F

EMPTY = "CAST(array() AS ARRAY<STRING>)"


def strings(values: Iterable[str]) -> Column:
    """A literal array of strings."""
    return F.array(*[F.lit(v) for v in values])


def empty_strings() -> Column:
    return F.expr(EMPTY)


def ordered_distinct(a: Column) -> Column:
    """Drop null and empty values, keep the first of each."""
    return F.array_distinct(F.filter(F.coalesce(a, empty_strings()), lambda x: x.isNotNull() & (x != "")))


def label(values: dict[str, str], key: Column, default: str) -> Column:
    """Lookup in a small fixed table."""
    out = None
    for k, v in values.items():
        out = F.when(key == k, v) if out is None else out.when(key == k, v)
    return out.otherwise(default)


def has_any(text: Column, words: Iterable[str]) -> Column:
    """True if any word is a substring of `text` (already lower case)."""
    out = F.lit(False)
    for w in words:
        out = out | text.contains(w)
    return out


def keyword_hits(text: Column, words: Iterable[str]) -> Column:
    """F8: sorted words that occur as substrings of the lower text."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.array_compact(F.array(*[F.when(low.contains(w), F.lit(w)) for w in sorted(set(words))]))


def overlap_size(a: Column, b: Column) -> Column:
    """Distinct values in both arrays."""
    return F.size(F.array_intersect(a, b))


def union_size(a: Column, b: Column) -> Column:
    """Distinct values in either array."""
    return F.size(F.array_union(a, b))


def jaccard(a: Column, b: Column) -> Column:
    """Intersection over union; 0 when either is empty."""
    both = (F.size(a) > 0) & (F.size(b) > 0)
    return F.when(both, overlap_size(a, b) / union_size(a, b)).otherwise(F.lit(0.0))


def hash_id(prefix: str, ids: Column) -> Column:
    """prefix and the first ten hex digits over the sorted ids."""
    basis = F.concat_ws("|", F.array_sort(ids))
    return F.concat(F.lit(prefix + "_"), F.substring(F.sha2(basis, 256), 1, 10))


def short_hash(text: Column, length: int) -> Column:
    return F.substring(F.sha2(text, 256), 1, length)


def document_id(provider: Column, external_id: Column, url: Column) -> Column:
    """id of a main-flow document."""
    return short_hash(F.concat(provider, F.lit(":"), external_id, F.lit(":"), F.coalesce(url, F.lit(""))), 24)


def overlay(base: Column, top: Column) -> Column:
    """merge two maps, the right side wins."""
    kept = F.map_filter(base, lambda k, _: ~F.array_contains(F.map_keys(top), k))
    return F.map_concat(kept, top)


def fill_missing(base: Column, extra: Column) -> Column:
    """add only keys that `base` lacks."""
    new = F.map_filter(extra, lambda k, _: ~F.array_contains(F.map_keys(base), k))
    return F.map_concat(base, new)


def lower_headers(headers: Column, keep: Iterable[str] | None = None) -> Column:
    """lower-case header names; optionally keep only some.

    Names that differ only by case meet after lower-casing: the last one wins.
    """
    pairs = F.map_entries(headers)
    low = F.transform(pairs, lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value")))
    last = F.filter(
        low,
        lambda e, i: ~F.exists(F.slice(low, i + 2, F.size(low)), lambda later: later["key"] == e["key"]),
    )
    if keep is not None:
        names = strings(keep)
        last = F.filter(last, lambda e: F.array_contains(names, e["key"]))
    return F.map_from_entries(last)


def nonempty(c: Column) -> Column:
    """The text, or null when it is empty."""
    return F.when(c != "", c)


def first_nonempty(*cols: Column) -> Column:
    """The first text that is neither null nor empty."""
    return F.coalesce(*[nonempty(c) for c in cols])


def clamp(c: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), c))
