"""Date and time columns (T-D1, T-D2, T-D5 to T-D8, F30)."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .arrays import first_nonempty
from .text import strip_ends
from .vocab import MONTHS

_ISO = (
    r"^(\d{4}-\d{2}-\d{2})(?:[T ](\d{2})(?::(\d{2})(?::(\d{2})(?:[.,](\d{1,6})\d*)?)?)?"
    r"(Z|[+-]\d{2}(?::?\d{2})?)?)?$"
)
_RFC = (
    r"(?i)^\s*(?:[a-z]+,?\s+)?(\d{1,2})\s+(" + MONTHS + r")[a-z]*\s+(\d{4})"
    r"(?:\s+(\d{1,2}):(\d{2})(?::(\d{2}))?)?\s*([+-]\d{4}|[a-z]{1,5})?\s*(?:\(.*\))?$"
)
# named zones of RFC 2822
_ZONES = {"EST": "-05:00", "EDT": "-04:00", "CST": "-06:00", "CDT": "-05:00", "MST": "-07:00",
          "MDT": "-06:00", "PST": "-08:00", "PDT": "-07:00"}
_MONTH_DAY = r"(?i)\b(?:" + MONTHS + r")[a-z]*\s+\d{1,2},\s+\d{4}\b"


def _stamp(day: Column, hour: Column, minute: Column, second: Column, fraction: Column, zone: Column) -> Column:
    text = F.concat(
        day, F.lit("T"), first_nonempty(hour, F.lit("00")), F.lit(":"), first_nonempty(minute, F.lit("00")),
        F.lit(":"), first_nonempty(second, F.lit("00")), F.lit("."), first_nonempty(fraction, F.lit("0")), zone,
    )
    return text.try_cast("timestamp")


def parse_iso(raw: Column) -> Column:
    """T-D1: strict ISO 8601 to UTC; no offset means UTC; anything else is null."""
    s = strip_ends(F.coalesce(raw, F.lit("")))
    s = F.regexp_replace(s, r"^(\d{4})(\d{2})(\d{2})$", "$1-$2-$3")
    # complete the text so that the cast never depends on the session zone
    full = F.regexp_replace(s, r"^(.{10})$", "$1T00:00:00Z")
    full = F.regexp_replace(full, r"^(.{13})(Z|[+-].*)?$", "$1:00$2")
    full = F.regexp_replace(full, r"^(.{16})(Z|[+-].*)?$", "$1:00$2")
    full = F.regexp_replace(full, r"^(.{11}[\d:.,]+)$", "$1Z")
    return F.when(s.rlike(_ISO), F.replace(full, F.lit(","), F.lit(".")).try_cast("timestamp"))


def parse_rfc2822(raw: Column) -> Column:
    """RFC 2822 dates as feeds write them."""
    s = F.coalesce(raw, F.lit(""))
    part = [F.regexp_extract(s, _RFC, g) for g in range(8)]
    month = F.lower(F.substring(part[2], 1, 3))
    number = None
    for i, name in enumerate(MONTHS.lower().split("|"), start=1):
        number = F.when(month == name, f"{i:02d}") if number is None else number.when(month == name, f"{i:02d}")
    day = F.concat(part[3], F.lit("-"), number, F.lit("-"), F.lpad(part[1], 2, "0"))
    zone = F.when(part[7].rlike(r"^[+-]\d{4}$"), F.regexp_replace(part[7], r"^(...)(..)$", "$1:$2"))
    for name, offset in _ZONES.items():
        zone = zone.when(F.upper(part[7]) == name, offset)
    zone = zone.otherwise("+00:00")
    hour = F.when(part[4] != "", F.lpad(part[4], 2, "0")).otherwise("00")
    # the mail form needs a time; a bare date is no feed date
    return F.when(
        s.rlike(_RFC) & (part[4] != ""), _stamp(day, hour, part[5], part[6], F.lit("0"), zone)
    )


def parse_feed_date(raw: Column) -> Column:
    """T-D2: ISO, else RFC 2822."""
    return F.when(F.coalesce(raw, F.lit("")) != "", F.coalesce(parse_iso(raw), parse_rfc2822(raw)))


def _month_day(raw: Column) -> Column:
    clean = F.replace(raw, F.lit(","), F.lit(""))
    word = F.regexp_extract(clean, r"^([A-Za-z]+)", 1)
    rest = F.regexp_extract(clean, r"\s+(\d{1,2})\s+(\d{4})", 0)
    text = F.concat(F.initcap(F.lower(F.substring(word, 1, 3))), F.regexp_replace(rest, r"\s+", " "))
    return F.try_to_timestamp(text, F.lit("MMM d yyyy"))


def parse_title_date(title: Column) -> Column:
    """T-D5: `Mon d, yyyy` inside a title, taken as noon UTC."""
    hit = F.regexp_extract(F.coalesce(title, F.lit("")), _MONTH_DAY, 0)
    return F.when(hit != "", _month_day(hit) + F.expr("INTERVAL 12 HOURS"))


def parse_changelog_date(text: Column, one_line: bool = False) -> Column:
    """T-D6: date of the first dated line; `one_line` tells that the text has no line breaks, as squeezed text has none."""
    line = r"(?isU)^\s*((?:" + MONTHS + r")[a-z]*\s+\d{1,2},\s+\d{4}|\d{4}-\d{2}-\d{2})\s*[:\-–]?\s*(.+)$"
    lines = F.array(F.coalesce(text, F.lit(""))) if one_line else F.split(F.coalesce(text, F.lit("")), r"\r\n|[\n\r\x0B\f\x1C-\x1E\x85  ]")
    dates = F.filter(
        F.transform(F.filter(lines, lambda x: x.rlike(line)), lambda x: _any_date(F.regexp_extract(x, line, 1))),
        lambda d: d.isNotNull(),
    )
    return F.get(dates, F.lit(0))


def _any_date(raw: Column) -> Column:
    word = F.lower(F.regexp_extract(raw, r"^([A-Za-z]+)", 1))
    full = ("january", "february", "march", "april", "may", "june", "july", "august", "september",
            "october", "november", "december")
    known = word.isin(*full) | word.isin(*MONTHS.lower().split("|"))
    return F.coalesce(parse_iso(raw), F.when(known, _month_day(raw)))


def from_epoch(value: Column) -> Column:
    """T-D7: epoch seconds, or milliseconds when above 1e12; bad input is null."""
    v = value.try_cast("double")
    seconds = F.when(v > 1e12, v / 1000.0).otherwise(v)
    ok = F.abs(seconds) < 253402300800.0
    return F.when(ok, F.timestamp_micros((seconds * 1000000).cast("bigint")))


def day_bucket(ts: Column) -> Column:
    """T-D8: the UTC day as text."""
    return F.date_format(ts, "yyyy-MM-dd")


def window_cutoff(window: Column, now: Column) -> Column:
    """`now` minus `Nd` or `Nh`; null for any other form."""
    w = F.lower(strip_ends(F.coalesce(window, F.lit(""))))
    n = F.regexp_extract(w, r"^\s*([+-]?\d{1,7})\s*[dh]$", 1)
    amount = F.nullif(n, F.lit("")).try_cast("int")
    return (
        F.when(w.endswith("d"), now - F.make_dt_interval(amount))
        .when(w.endswith("h"), now - F.make_dt_interval(F.lit(0), amount))
    )
