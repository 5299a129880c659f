"""URL columns."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, functions as F

from .arrays import has_any, strings
from .text import strip_ends
from .vocab import (
    BLOCKED_SUFFIXES,
    DETAIL_PATH_HINTS,
    LISTING_NOISE_PARTS,
    PLAIN_PATH_HINTS,
    TRACKING_KEYS,
)

# generic URI split (RFC 3986, appendix B)
_URI = r"(?s)^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"
# a url that is its own canonical form: lower-case scheme and authority, a path without parameters or closing slash, nothing behind
_CANONICAL = r"\A[a-z][a-z0-9+.\-]*://[a-z0-9.\-_:@]+/(?:[!-~&&[^?#;]]*[!-~&&[^?#;/]])?\z"


def _part(url: Column, group: int) -> Column:
    return F.regexp_extract(url, _URI, group)


def _text(url: Column) -> Column:
    return strip_ends(F.coalesce(url, F.lit("")))


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use(value)`, with the value computed once however often it is used; a plain column would be computed at each use."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _no_slash(c: Column) -> Column:
    return F.regexp_replace(c, "/+$", "")


def scheme(url: Column) -> Column:
    return F.lower(_part(_text(url), 1))


def netloc(url: Column) -> Column:
    """authority part, lower case."""
    return F.lower(_part(_text(url), 2))


def host(url: Column) -> Column:
    """authority without user info and port, lower case."""
    return F.regexp_replace(F.regexp_replace(netloc(url), r"^[^@]*@", ""), r":\d*$", "")


def raw_path(url: Column) -> Column:
    """Path without the parameters of its last segment."""
    return F.regexp_replace(_part(_text(url), 3), r";[^/]*$", "")


def path(url: Column) -> Column:
    """lower-case path without trailing slashes."""
    return F.lower(_no_slash(raw_path(url)))


def slug(url: Column) -> Column:
    """last path segment; empty without a path."""
    return F.element_at(F.split(path(url), "/"), -1)


def _decode(c: Column) -> Column:
    # a percent sign that starts no escape stays as it is
    return F.url_decode(F.regexp_replace(c, r"%(?![0-9A-Fa-f]{2})", "%25"))


def _encode(c: Column) -> Column:
    return F.replace(F.replace(F.url_encode(c), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def _query(arguments: Column) -> Column:
    pairs = F.filter(F.split(arguments, "&"), lambda p: p.rlike(r"(?s)^[^=]*=."))
    decoded = F.transform(
        pairs,
        lambda p: F.struct(
            _decode(F.substring_index(p, "=", 1)).alias("k"),
            _decode(F.regexp_replace(p, r"(?s)^[^=]*=", "")).alias("v"),
        ),
    )
    kept = F.filter(decoded, lambda e: ~F.array_contains(strings(TRACKING_KEYS), e["k"]))
    return F.array_join(
        F.transform(F.array_sort(kept), lambda e: F.concat(_encode(e["k"]), F.lit("="), _encode(e["v"]))), "&"
    )


def canonical_url(url: Column) -> Column:
    """stable form of a url, tracking arguments removed."""

    def build(u: Column) -> Column:
        s, n, p, q = u["scheme"], u["netloc"], u["path"], u["query"]
        rooted = F.when(p.startswith("/"), p).otherwise(F.concat(F.lit("/"), p))
        body = (
            F.when(n != "", F.concat(F.lit("//"), n, rooted))
            .when(p.startswith("//"), F.concat(F.lit("//"), p))
            .when(s.isin("http", "https") & p.startswith("/"), F.concat(F.lit("//"), p))
            .otherwise(p)
        )
        head = F.when(s != "", F.concat(s, F.lit(":"))).otherwise(F.lit(""))
        return F.concat(head, body, F.when(q != "", F.concat(F.lit("?"), q)).otherwise(F.lit("")))

    def split(t: Column) -> Column:
        p = _no_slash(F.regexp_replace(_part(t, 3), r";[^/]*$", ""))
        return F.struct(
            F.lower(_part(t, 1)).alias("scheme"), F.lower(_part(t, 2)).alias("netloc"),
            _once(p, lambda x: F.when(x == "", F.lit("/")).otherwise(x)).alias("path"),
            _once(_part(t, 4), lambda a: F.when(a == "", F.lit("")).otherwise(_query(a))).alias("query"),
        )

    full = _once(_text(url), lambda t: _once(split(t), build))
    return F.when(url.rlike(_CANONICAL), url).otherwise(full)


def _collapse_dots(p: Column) -> Column:
    segments = F.split(p, "/")
    n = F.size(segments)
    last = F.element_at(segments, -1)
    inner = F.filter(segments, lambda s, i: (i == 0) | (i == n - 1) | (s != ""))
    folded = F.aggregate(
        F.filter(inner, lambda s, i: i > 0),
        F.expr("CAST(array() AS ARRAY<STRING>)"),
        lambda acc, s: F.when(s == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))))
        .when(s == ".", acc)
        .otherwise(F.concat(acc, F.array(s))),
    )
    tail = F.when(last.isin(".", ".."), F.lit("/")).otherwise(F.lit(""))
    joined = F.array_join(folded, "/")
    tail = F.when(joined == "", F.lit("")).otherwise(tail)
    return F.concat(F.lit("/"), joined, tail)


def base_parts(base: Column) -> Column:
    """The pieces of a page url that resolving its links needs; compute once per page."""
    b = F.substring_index(_text(base), "#", 1)
    return F.struct(
        b.alias("url"), _part(b, 1).alias("scheme"), _part(b, 2).alias("netloc"), _part(b, 3).alias("path"),
        _no_slash(F.lower(base)).alias("low"), _no_slash(raw_path(base)).alias("folder"), netloc(base).alias("site"),
    )


def resolve(base: Column, href: Column) -> Column:
    """absolute form of a link found on `base`, cut at `#`."""
    return resolve_from(base_parts(base), href)


def resolve_from(base: Column, href: Column) -> Column:
    """F3 with the pieces of `base_parts`."""
    h = F.substring_index(_text(href), "#", 1)
    hs, hn, hp, hq = _part(h, 1), _part(h, 2), _part(h, 3), _part(h, 4)
    b, bs, bn, bp = base["url"], base["scheme"], base["netloc"], base["path"]
    merged = (
        F.when(hp.startswith("/"), hp)
        .when(bp == "", F.concat(F.lit("/"), hp))
        .otherwise(F.concat(F.regexp_replace(bp, r"[^/]*$", ""), hp))
    )
    merged = F.when(merged.rlike(r"//|(^|/)\.{1,2}(/|$)"), _collapse_dots(merged)).otherwise(merged)
    query = F.when(hq != "", F.concat(F.lit("?"), hq)).otherwise(F.lit(""))
    return (
        F.when(h == "", b)
        .when((hs != "") & (F.lower(hs) != F.lower(bs)), h)
        .when(hn != "", F.when(hs != "", h).otherwise(F.concat(bs, F.lit(":"), h)))
        .when(hp == "", F.concat(F.regexp_replace(b, r"\?.*$", ""), query))
        .otherwise(F.concat(bs, F.lit("://"), bn, merged, query))
    )


def url_priority(url: Column, priority: Column) -> Column:
    """F32: fetch priority from the source rank and the words in the url."""
    low = F.lower(url)
    base = F.when(priority == "high", 90).when(priority == "medium", 60).when(priority == "low", 30).otherwise(50)
    score = base + F.when(has_any(low, ("changelog", "release")), 10).otherwise(0)
    score = score + F.when(has_any(low, ("news", "blog")), 6).otherwise(0)
    return F.greatest(F.lit(1), F.least(F.lit(100), score))


def is_allowed(url: Column) -> Column:
    """Not a file that holds no page text."""
    return ~F.lower(url).rlike(r"\.(" + "|".join(BLOCKED_SUFFIXES) + r")$")


def same_site(a: Column, b: Column) -> Column:
    """Equal, non-empty authorities."""
    return (netloc(a) != "") & (netloc(a) == netloc(b))


def path_excluded(url: Column, parts: Column) -> Column:
    """Any configured part inside the lower path."""
    p = F.lower(raw_path(url))
    return F.exists(F.coalesce(parts, F.expr("CAST(array() AS ARRAY<STRING>)")), lambda x: p.contains(F.lower(x)))


def is_aggregate(url: Column) -> Column:
    """Category, tag or pager pages."""
    return has_any(F.lower(url), LISTING_NOISE_PARTS)


def is_detail(listing: Column, child: Column, extra_hints: Column | None = None, *, plain: bool = False) -> Column:
    """P5: the child looks like an item page of the listing.

    `plain` is the fallback rule: fewer hints, longer tail.
    """
    return is_detail_from(base_parts(listing), child, F.lower(raw_path(child)), extra_hints, plain=plain)


def is_detail_from(base: Column, child: Column, p: Column, extra_hints: Column | None = None, *, plain: bool = False) -> Column:
    """P5 with the pieces of `base_parts` and the lower path of the child."""
    hints = PLAIN_PATH_HINTS if plain else DETAIL_PATH_HINTS
    lu, lp = base["low"], base["folder"]
    cu = F.lower(_no_slash(child))
    hinted = has_any(p, hints)
    if extra_hints is not None:
        hinted = hinted | F.exists(
            F.coalesce(extra_hints, F.expr("CAST(array() AS ARRAY<STRING>)")), lambda h: p.contains(h)
        )
    raw_tail = F.substr(p, F.length(lp) + 2)
    tail = F.regexp_replace(raw_tail, "^/+|/+$", "")
    below = F.startswith(p, F.concat(lp, F.lit("/"))) & (F.length(p) > F.length(lp) + 1)
    if plain:
        tail_ok = tail.contains("/") | (
            (F.length(raw_tail) > 12) & ~raw_tail.rlike(r"\.(xml|json|rss)$")
        )
    else:
        tail_ok = ~tail.isin("", "page", "feed", "rss") & (
            tail.contains("/") | ((F.length(tail) > 10) & ~tail.rlike(r"\.(xml|json|rss|pdf)$"))
        )
    itself = (cu == lu) | F.startswith(cu, F.concat(lu, F.lit("#")))
    return ~itself & (hinted | (below & tail_ok))


def with_any_hint(url: Column, parts: Iterable[str]) -> Column:
    return has_any(F.lower(F.coalesce(url, F.lit(""))), parts)
