"""HTML character references to characters, in built-in functions only, so that they work inside arrays as well."""

from __future__ import annotations

import json
from html.entities import html5

from pyspark.sql import Column, functions as F

# fixed values: entities resolved by plain replacement (`&amp;` comes last)
COMMON_ENTITIES = (
    ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&nbsp;", "\u00a0"),
    ("&copy;", "\u00a9"), ("&reg;", "\u00ae"), ("&middot;", "\u00b7"), ("&bull;", "\u2022"),
    ("&ndash;", "\u2013"), ("&mdash;", "\u2014"), ("&hellip;", "\u2026"), ("&lsquo;", "\u2018"),
    ("&rsquo;", "\u2019"), ("&ldquo;", "\u201c"), ("&rdquo;", "\u201d"), ("&laquo;", "\u00ab"),
    ("&raquo;", "\u00bb"), ("&amp;", "&"),
)
_RARE = r"&(?!(?:" + "|".join(e[1:-1] for e, _ in COMMON_ENTITIES) + r");)[^\t\n\f <&;]"
_REFERENCE = r"^&(#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\f <&#;]{1,32};?)"
#: Names that HTML resolves without a semicolon, even before further letters; the longest wins.
_OPEN_NAMES = "^(" + "|".join(sorted((n for n in html5 if not n.endswith(";")), key=len, reverse=True)) + ")"
_REPLACEMENT, _LAST = "\ufffd", 0x10FFFF


def _windows(code: int) -> str:
    """Numeric references to the C1 range mean Windows-1252, where that has a character."""
    try:
        return bytes([code]).decode("cp1252")
    except UnicodeDecodeError:
        return chr(code)


def _names() -> Column:
    """Characters by name, and by `#` and number for the numbers that do not mean themselves; a constant map."""
    numbers = {0: _REPLACEMENT, 0x0D: "\r"} | {n: _windows(n) for n in range(0x80, 0xA0)}
    return F.from_json(F.lit(json.dumps(html5 | {f"#{n}": c for n, c in numbers.items()})), "map<string,string>")


def _let(value: Column, body) -> Column:
    """`body` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _character(code: Column) -> Column:
    digits = F.hex(code)
    control = code.between(0x1, 0x8) | (code == 0xB) | code.between(0xE, 0x1F) | (code == 0x7F)
    never = code.between(0xFDD0, 0xFDEF) | (code.bitwiseAND(0xFFFE) == 0xFFFE)
    return (
        F.when((code > _LAST) | code.between(0xD800, 0xDFFF), F.lit(_REPLACEMENT)).when(control | never, F.lit(""))
        .when(code > 0xFFFF, F.decode(F.unhex(F.lpad(digits, 8, "0")), "UTF-32"))
        .otherwise(F.decode(F.unhex(F.lpad(digits, 4, "0")), "UTF-16BE"))
    )


def _number(ref: Column, names: Column) -> Column:
    digits = F.regexp_extract(ref, "^#[xX]?0*([0-9a-fA-F]*)", 1)
    value = F.when(ref.rlike("^#[xX]"), F.conv(digits, 16, 10)).otherwise(F.conv(digits, 10, 10))
    code = F.when(digits == "", F.lit(0)).when(F.length(digits) > 7, F.lit(_LAST + 1)).otherwise(value.cast("int"))
    return _let(code, lambda n: F.when(n < 0xA0, F.coalesce(F.try_element_at(names, F.concat(F.lit("#"), n)), _character(n))).otherwise(_character(n)))


def _piece(piece: Column, names: Column) -> Column:
    """A text without `&` but at its start, with a reference there resolved."""

    def named(ref: Column) -> Column:
        return _let(
            F.regexp_extract(ref, _OPEN_NAMES, 1),
            lambda name: F.when(name != "", F.concat(F.try_element_at(names, name), F.substr(piece, F.length(name) + 2))).otherwise(piece),
        )

    def resolved(ref: Column) -> Column:
        rest = F.substr(piece, F.length(ref) + 2)
        whole = F.when(ref.startswith("#"), _number(ref, names)).otherwise(F.try_element_at(names, ref))
        return F.when(ref == "", piece).otherwise(F.coalesce(F.concat(whole, rest), named(ref)))

    return _let(F.regexp_extract(piece, _REFERENCE, 1), resolved)


def unescape(c: Column) -> Column:
    """Character references to characters, each once; texts with common ones only take plain replacements."""

    def resolved(text: Column) -> Column:
        plain = text
        for entity, char in COMMON_ENTITIES:
            plain = F.replace(plain, F.lit(entity), F.lit(char))
        names = _names()
        pieces = F.regexp_extract_all(text, F.lit("([^&]+|&[^&]*)"), F.lit(1))
        return F.when(text.rlike(_RARE), F.array_join(F.transform(pieces, lambda p: _piece(p, names)), "")).otherwise(plain)

    return _let(c, resolved)
