"""Secret scans through a trigram inverted index, in DataFrame functions only.

Each rule's pattern is turned into a Boolean query over trigrams that every
match must hold. The index lists, per trigram that some rule asks for, the
documents with it. Lists are intersected per document, and only candidates run
the pattern. Rules without a mandatory trigram run on every text.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from re import _constants as kinds, _parser as patterns

from pyspark.sql import Column, DataFrame, functions as F

_MOST = 64  # strings that a part of a pattern may stand for before it counts as open
SPANS = "array<struct<start:int,rank:int,end:int,kind:string>>"


@dataclass(frozen=True)
class Rule:
    """`pattern` holds for Java and Python; matches whose `group` has fewer than `least` characters are dropped.

    `sql` is a form of it without possessive repeats and look-around, whose groups 1 to 3 hold the span, where `pattern` has these.
    """

    kind: str
    pattern: str
    group: int = 0
    least: int = 0
    sql: str = ""


#: Kinds and patterns of the base rules, in the order that ties follow.
BASE_RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 16),
    Rule("hex", r"[0-9a-f]{32,}"),  # runs are maximal, so the bound may stand in the pattern
)
#: What may stand between the runs of a key's body: white space, also as escapes, quotes and marks at the start of a line.
_GAP = r"""(?:\\+[nrt]|[\x09-\x0D\x20"'`+>#*|,;/\\])*+"""
_BEGIN, _END = r"-----BEGIN [A-Z ]*PRIVATE KEY-----", r"-----END [A-Z ]*PRIVATE KEY-----"
_HEADS = rf"(?:{_GAP}(?:Proc-Type:\x20*+[0-9]++,[A-Z]++|DEK-Info:\x20*+[A-Z0-9-]++,[0-9A-Fa-f]++))*+"
_RUN, _REST = rf"{_GAP}[A-Za-z0-9+/]{{20,}}+={{0,2}}+", r"[A-Za-z0-9+/]++={0,2}+"
_BREAK = r"(?:\\+[nrt]|[\x09-\x0D\x20\"'`+>#*|,;/\\])"
#: A key is BEGIN, headers of encrypted keys, long runs of base64 and a shorter rest before END. Without END the rest must close its line.
#: Anything else, as prose that only names BEGIN and END, is no body and stays out. All repeats are possessive, so a text is read once and
#: Java's matcher doesn't recurse.
_KEY = rf"{_BEGIN}{_HEADS}(?:(?:{_RUN})++(?:(?:{_GAP}{_REST})?+{_GAP}{_END}|{_BREAK}{_GAP}{_REST}(?![^\x09-\x0D\"'`\\]))?+|{_GAP}{_END})?+"


def _plain(pattern: str) -> str:
    """Greedy repeats for possessive ones."""
    return re.sub(r"(?<!\\)([*+?}])\+", r"\1", pattern)


#: The same spans for a matcher without possessive repeats and look-around, as group 1, 2 or 3.
_KEY_SQL = _plain(
    rf"({_BEGIN}{_HEADS}(?:(?:{_RUN})++(?:{_GAP}{_REST})?+)?+{_GAP}{_END})"
    rf"|({_BEGIN}{_HEADS}(?:{_RUN})++{_BREAK}{_GAP}{_REST})(?:[\x09-\x0D\"'`\\]|$)|({_BEGIN}{_HEADS}(?:{_RUN})*+)"
)
#: Further kinds, by the published forms of such keys.
MORE_RULES = (
    Rule("private_key", _KEY, sql=_KEY_SQL),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
)
RULES = (*BASE_RULES, *MORE_RULES)


def _strings(item) -> set[str] | None:
    """All strings that a node can stand for, lower-cased; None if they are too many."""
    op, value = item
    if op is kinds.LITERAL:
        return {chr(value).lower()}
    if op is kinds.IN:
        if all(o is kinds.LITERAL for o, _ in value):
            return {chr(v).lower() for _, v in value} if len(value) <= 8 else None
        return None
    if op is kinds.SUBPATTERN:
        return _product(value[3])
    if op is kinds.BRANCH:
        parts = [_product(p) for p in value[1]]
        return None if None in parts else _few(set().union(*parts))
    if op in (kinds.MAX_REPEAT, kinds.MIN_REPEAT) and value[1] is not kinds.MAXREPEAT and value[1] <= 4:
        one = _product(value[2])
        if one is None:
            return None
        out, grown = set(), {""}
        for k in range(value[1] + 1):
            if k >= value[0]:
                out |= grown
            grown = {a + b for a in grown for b in one}
            if len(out) + len(grown) > 4 * _MOST:
                return None
        return _few(out)
    return {""} if op is kinds.AT else None


def _few(strings: set[str]) -> set[str] | None:
    return strings if len(strings) <= _MOST else None


def _product(sequence) -> set[str] | None:
    out: set[str] | None = {""}
    for item in sequence:
        part = _strings(item)
        out = None if part is None or out is None else _few({a + b for a in out for b in part})
        if out is None:
            return None
    return out


def _clause(strings: set[str]) -> set[frozenset[str]] | None:
    """One set of trigrams per string, without those that another set implies; None if a string has none."""
    sets = {frozenset(s[k : k + 3] for k in range(len(s) - 2)) for s in strings}
    return None if frozenset() in sets else {s for s in sets if not any(o < s for o in sets)}


def trigram_query(pattern: str) -> list[set[frozenset[str]]]:
    """Clauses that all hold for every match, lower-cased: of each, one set of trigrams is there whole."""
    clauses: list[set[frozenset[str]]] = []

    def close(strings: set[str]) -> None:
        clause = _clause(strings)
        if clause and clause not in clauses:
            clauses.append(clause)

    def walk(sequence) -> None:
        run = {""}
        for item in sequence:
            part = _strings(item)
            joined = None if part is None else _few({a + b for a in run for b in part})
            if joined is not None:
                run = joined
                continue
            close(run)
            run = {""} if part is None else part
            if item[0] is kinds.SUBPATTERN:
                walk(item[1][3])
            elif item[0] in (kinds.MAX_REPEAT, kinds.MIN_REPEAT) and item[1][0]:
                walk(item[1][2])
        close(run)

    walk(patterns.parse(pattern))
    return clauses


def _index(frame: DataFrame, trigrams: list[str]) -> DataFrame:
    """Postings (trigram number, id): a document is listed under each asked trigram that its lower-cased text holds."""
    listed = F.transform(  # inside the lambda the lower-cased text is made once, not once per trigram
        F.array(F.lower("text")), lambda low: F.array_compact(F.array(*[F.when(low.contains(t), F.lit(k)) for k, t in enumerate(trigrams)]))
    )
    return frame.filter("text is not null").select(F.explode(F.flatten(listed)).alias("trigram"), "id")


def _candidates(frame: DataFrame, queries: dict[int, list[set[frozenset[str]]]]) -> DataFrame:
    """(id, rules): rules whose trigram query the postings of the document meet."""
    trigrams = sorted({t for clauses in queries.values() for clause in clauses for s in clause for t in s})
    words = range(-(-len(trigrams) // 60))
    bit = F.expr("shiftleft(1L, trigram % 60)")
    lists = _index(frame, trigrams).groupBy("id").agg(
        *[F.bit_or(F.when(F.floor(F.col("trigram") / 60) == w, bit).otherwise(F.lit(0).cast("long"))).alias(f"w{w}") for w in words]
    )

    def whole(some: frozenset[str]) -> Column:
        need = [sum(1 << (trigrams.index(t) % 60) for t in some if trigrams.index(t) // 60 == w) for w in words]
        tests = [F.col(f"w{w}").bitwiseAND(F.lit(n).cast("long")) == n for w, n in zip(words, need, strict=True) if n]
        return _all(tests)

    met = [F.when(_all([_any([whole(s) for s in clause]) for clause in clauses]), F.lit(k)) for k, clauses in queries.items()]
    return lists.select("id", F.array_compact(F.array(*met)).alias("rules")).filter(F.size("rules") > 0)


def _all(tests: list[Column]) -> Column:
    out = tests[0]
    for t in tests[1:]:
        out = out & t
    return out


def _any(tests: list[Column]) -> Column:
    out = tests[0]
    for t in tests[1:]:
        out = out | t
    return out


def _matches(text: Column, rule: Rule, rank: int) -> Column:
    """Spans of a rule in code points: lengths of matches and of what lies between them, summed up."""
    found = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    kept = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group))
    parts = F.arrays_zip(F.split(text, rule.pattern, -1).alias("gap"), found.alias("hit"), kept.alias("part"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast(SPANS).alias("spans"))

    def add(state: Column, one: Column) -> Column:
        begin = state["at"] + F.length(one["gap"])
        end = begin + F.coalesce(F.length(one["hit"]), F.lit(0))
        span = F.struct(begin.alias("start"), F.lit(rank).alias("rank"), end.alias("end"), F.lit(rule.kind).alias("kind"))
        real = one["hit"].isNotNull() & (F.length(one["part"]) >= rule.least)
        return F.struct(end.alias("at"), F.when(real, F.concat(state["spans"], F.array(span))).otherwise(state["spans"]).alias("spans"))

    return F.when(text.rlike(rule.pattern), F.aggregate(parts, start, add)["spans"]).otherwise(F.array().cast(SPANS))


def secret_spans(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", rules: tuple[Rule, ...] = RULES, out: str = "secret_spans") -> DataFrame:
    """The rows and columns of `docs` and `out`: (start, rank, end, kind) by start, then rank of the rule.

    Spans are code points, end exclusive; a rule's own spans don't overlap.
    Null and empty texts have none. Rows that share an id are candidates if
    any of them is, and each is searched by itself; null ids are one id here.
    A column of `docs` that is named as `out` is replaced; others stay, whatever
    their names.
    """
    docs = docs.drop(out)
    asked_rules, candidate = (f"{out} {name} {len(docs.columns)}" for name in ("rules", "candidate"))  # a free name
    while any(c.lower() in (asked_rules.lower(), candidate.lower()) for c in docs.columns):
        asked_rules, candidate = f"{asked_rules}_", f"{candidate}_"
    frame = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"))
    queries = {k: q for k, r in enumerate(rules) if (q := trigram_query(r.pattern))}
    if queries:
        found = _candidates(frame, queries).select(F.col("id").alias(candidate), F.col("rules").alias(asked_rules))
        docs = docs.join(found, docs[doc_id].eqNullSafe(found[candidate]), "left").drop(candidate)
    else:
        docs = docs.withColumn(asked_rules, F.array().cast("array<int>"))
    body = F.coalesce(F.col(text), F.lit(""))
    asked = F.coalesce(F.col(f"`{asked_rules}`"), F.array().cast("array<int>"))
    each = [
        F.when(F.array_contains(asked, k), _matches(body, r, k)).otherwise(F.array().cast(SPANS)) if k in queries else _matches(body, r, k)
        for k, r in enumerate(rules)
    ]
    return docs.withColumn(out, F.array_sort(F.concat(*each))).drop(asked_rules)


def listed(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def masked(text: Column, spans: Column) -> Column:
    """The text with each run of spans replaced by the kind of its first, in brackets."""
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def add(state: Column, s: Column) -> Column:
        before = F.substring(text, state["at"] + 1, s["start"] - state["at"])
        grown = F.concat(state["out"], before, F.lit("["), s["kind"], F.lit("]"))
        return F.struct(F.greatest(state["at"], s["end"]).alias("at"), F.when(s["start"] >= state["at"], grown).otherwise(state["out"]).alias("out"))

    done = F.aggregate(spans, start, add)
    return F.concat(done["out"], F.substring(text, done["at"] + 1, F.length(text)))


def pattern_of(kind: str) -> str:
    return next(r.pattern for r in RULES if r.kind == kind)


def python_spans(text: str | None, rules: tuple[Rule, ...] = RULES) -> list[tuple[int, int, int, str]]:
    """The same spans by Python's own matcher, without an index; the tests hold the job against it."""
    return sorted(
        (m.start(), rank, m.end(), r.kind) for rank, r in enumerate(rules) for m in re.finditer(r.pattern, text or "")
        if len(m.group(r.group)) >= r.least
    )
