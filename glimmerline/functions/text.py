"""Text columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .arrays import first_nonempty, strings
from .entities import unescape
from .vocab import TOKEN_STOPWORDS

WS = r"(?U)[\s\x1C-\x1F]+"
TAG = r"<[^>]+>"


def squeeze(c: Column) -> Column:
    """one space for each run of white space, ends trimmed."""
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), WS, " "))


def strip_ends(c: Column) -> Column:
    """Remove white space at both ends only."""
    return F.regexp_replace(c, r"(?U)^[\s\x1C-\x1F]+|[\s\x1C-\x1F]+$", "")


def drop_tags(c: Column) -> Column:
    """Tags become spaces, runs collapse; entities stay."""
    return squeeze(F.regexp_replace(F.coalesce(c, F.lit("")), TAG, " "))


def clean_text(c: Column) -> Column:
    """tags out, entities resolved, white space collapsed."""
    return squeeze(unescape(F.regexp_replace(F.coalesce(c, F.lit("")), TAG, " ")))


def tokens(c: Column) -> Column:
    """distinct lower-case ASCII words without stop words."""
    # the separators the rule names are outside [a-z0-9] already, so one match does it
    words = F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit("([a-z0-9]+)"), F.lit(1))
    return F.array_except(words, strings(TOKEN_STOPWORDS))


def is_url_like(c: Column) -> Column:
    """trimmed text starts with http:// or https://."""
    return F.coalesce(c, F.lit("")).rlike(r"(?iU)^\s*https?://")


def evidence_text(c: Column, limit: int | None = None) -> Column:
    """the text, cut to its first `limit` characters only if a limit is given."""
    text = F.coalesce(c, F.lit(""))
    return text if limit is None else F.substring(text, 1, limit)


def event_title(text: Column, doc_id: Column) -> Column:
    """first 80 characters of the evidence, else the document id."""
    return first_nonempty(F.substring(text, 1, 80), doc_id)


def language_guess(title: Column) -> Column:
    """`en` when the title has an ASCII letter."""
    return F.when(F.coalesce(title, F.lit("")).rlike("[a-zA-Z]"), F.lit("en"))
