"""Toxicity by weak supervision.

Voters are lexicons and patterns. Lexicons are fixed lists and terms that
labelled documents point to: words, word beginnings, and terms that a document
repeats. A generative model with a hidden class estimates each voter's
accuracies and, as a forest over the voters, which of them go together within
a class; labels play no part in it. Its posterior labels train a linear
classifier on the terms, and the labelled rows set the scale of its score.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, functions as F

from .language import held_out
from .tables import with_type_of
from .words import LETTERS, Block, blocks, mix, once

#: Common English insults, in three lists.
INSULTS = (
    ("idiot", "moron", "stupid", "dumb", "fool", "imbecile", "clown"),
    ("scum", "trash", "vermin", "filth", "garbage", "parasite"),
    ("loser", "pathetic", "worthless", "disgusting", "useless", "hateful"),
)
BEGINNINGS = (4, 5, 6, 7)  # bytes of a word's beginning that count as a term
REPEATED = np.uint64(0xD6E8FEB86659FD93)
PATTERNS = ("shouting", "exclaiming", "long runs of symbols")
_EXCLAIM, _SYMBOLS = re.compile(r"!!"), re.compile(r"[#$%&*]{3}")


def terms_of(block: Block) -> tuple[np.ndarray, np.ndarray]:
    """(word number, term) pairs of the block: the word itself and its beginnings."""
    every = np.arange(len(block.start))
    words, terms = [every], [block.hashes()]
    for size in BEGINNINGS:
        longer = np.flatnonzero(block.length > size)
        some = Block(block.data, block.row[longer], block.start[longer], block.length[longer])
        words.append(longer)
        terms.append(mix(some.hashes(size) + np.uint64(size)))
    return np.concatenate(words), np.concatenate(terms)


def term_of(word: str) -> int:
    from .words import hashed_words

    return int(next(hashed_words([word.encode()], LETTERS))[1][0])


@dataclass
class Counted:
    """Terms of some texts: row, term, and the number of words and the pattern votes of each row."""

    row: np.ndarray
    term: np.ndarray
    words: np.ndarray
    patterns: np.ndarray


def _among(terms: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Which terms are in the sorted array."""
    if not len(wanted):
        return np.zeros(len(terms), bool)
    return wanted[np.searchsorted(wanted, terms).clip(max=len(wanted) - 1)] == terms


def _shouts(text: str | None) -> bool:
    """Whether more than half of the ASCII letters are capitals."""
    data = np.frombuffer((text or "").encode("utf-8", "replace"), np.uint8)
    capitals, small = ((data >= 65) & (data <= 90)).sum(), ((data >= 97) & (data <= 122)).sum()
    return bool(capitals > small)


def count_terms(texts: list[str | None], wanted: np.ndarray | None = None) -> Counted:
    """Distinct terms per text; a term that is at least one word in a hundred, and not alone, counts a second time as repeated.

    `wanted` (sorted) limits the terms.
    """
    n = len(texts)
    low = [t.lower().encode("utf-8", "replace") if t else None for t in texts]
    words = np.zeros(n)
    rows, terms, counts = [], [], []
    for block in blocks(low, LETTERS):
        words += np.bincount(block.row, minlength=n)
        _, first, at = np.unique(block.hashes(), return_index=True, return_inverse=True)
        seen = Block(block.data, block.row[first], block.start[first], block.length[first])
        word, term = terms_of(seen)
        if wanted is not None:
            keep = _among(term, wanted) | _among(mix(term ^ REPEATED), wanted)
            word, term = word[keep], term[keep]
        order = np.argsort(word, kind="stable")
        word, term = word[order], term[order]
        begin, end = np.searchsorted(word, at, "left"), np.searchsorted(word, at, "right")
        size = end - begin
        index = np.repeat(begin, size) + np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
        rows.append(np.repeat(block.row, size))
        terms.append(term[index])
        counts.append(np.ones(len(index)))
    row = np.concatenate(rows) if rows else np.zeros(0, np.int64)
    term = np.concatenate(terms) if terms else np.zeros(0, np.uint64)
    order = np.lexsort((term, row))
    row, term = row[order], term[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (term[1:] != term[:-1])
    begin = np.flatnonzero(new)
    count = np.diff(np.append(begin, len(row)))
    row, term = row[begin], term[begin]
    often = (count >= 2) & (100 * count >= words[row])
    row, term = np.concatenate([row, row[often]]), np.concatenate([term, mix(term[often] ^ REPEATED)])
    if wanted is not None:
        keep = _among(term, wanted)
        row, term = row[keep], term[keep]
    shout = [_shouts(t) for t in texts]
    calls = [bool(t) and len(_EXCLAIM.findall(t)) >= 3 for t in texts]
    noise = [bool(t) and len(_SYMBOLS.findall(t)) >= 3 for t in texts]
    return Counted(row, term, words, np.array([shout, calls, noise], np.int8).T.reshape(n, 3))


@dataclass
class LabelModel:
    """P(class) and, per voter, P(vote | class, vote of its parent); votes are -1, 0, 1 as 0, 1, 2.

    `accuracies` are the shares of a voter's votes that meet the class, `edges` the correlations in the forest.
    """

    prior: np.ndarray
    parents: list[int]
    tables: list[np.ndarray]
    edges: list[tuple[int, int, float]]
    accuracies: list[float]

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        """P(class 1) per row."""
        score = np.log(self.prior) + np.zeros((len(votes), 2))
        for j, (parent, table) in enumerate(zip(self.parents, self.tables, strict=True)):
            given = votes[:, parent] if parent >= 0 else np.zeros(len(votes), int)
            score += np.log(table[:, given, votes[:, j]]).T
        score -= score.max(axis=1, keepdims=True)
        p = np.exp(score)
        return p[:, 1] / p.sum(1)


def _tables(votes: np.ndarray, q: np.ndarray, parents: list[int], smooth: float = 1.0) -> list[np.ndarray]:
    out = []
    for j, parent in enumerate(parents):
        table = np.full((2, 3, 3), smooth / 3)
        given = votes[:, parent] if parent >= 0 else np.zeros(len(votes), int)
        np.add.at(table[0], (given, votes[:, j]), 1 - q)
        np.add.at(table[1], (given, votes[:, j]), q)
        out.append(table / table.sum(2, keepdims=True))
    return out


def _accuracies(votes: np.ndarray, q: np.ndarray) -> list[float]:
    right = (votes == 2) * q[:, None] + (votes == 0) * (1 - q)[:, None]
    return [float(x) for x in right.sum(0) / np.maximum((votes != 1).sum(0), 1)]


def _fit(votes: np.ndarray, q: np.ndarray, parents: list[int], edges: list, rounds: int) -> tuple[LabelModel, np.ndarray]:
    for _ in range(rounds):
        prior = np.array([1 - q.mean(), q.mean()]).clip(1e-3, 1 - 1e-3)
        model = LabelModel(prior, parents, _tables(votes, q, parents), edges, _accuracies(votes, q))
        q = model.posterior(votes)
    return model, q


def correlations(votes: np.ndarray, q: np.ndarray, least: float = 0.01) -> list[tuple[int, int, float]]:
    """Pairs of voters with at least that much mutual information within the classes, strongest first."""
    weights = np.stack([1 - q, q])
    found = []
    for j in range(votes.shape[1]):
        for k in range(j):
            joint = np.zeros((2, 3, 3))
            for c in (0, 1):
                np.add.at(joint[c], (votes[:, j], votes[:, k]), weights[c])
            joint = (joint + 1e-6) / (joint + 1e-6).sum()
            apart = joint.sum(2, keepdims=True) * joint.sum(1, keepdims=True) / joint.sum((1, 2), keepdims=True)
            info = float((joint * np.log(joint / apart)).sum())
            if info >= least:
                found.append((j, k, info))
    return sorted(found, key=lambda e: (-e[2], e[:2]))


def fit_label_model(votes: np.ndarray, start: np.ndarray, rounds: int = 15) -> tuple[LabelModel, np.ndarray]:
    """Expectation-maximisation for independent voters, then again with the strongest forest of correlations."""
    m = votes.shape[1]
    _, q = _fit(votes, start, [-1] * m, [], rounds)
    edges = correlations(votes, q)
    group = list(range(m))
    near: dict[int, list[int]] = {j: [] for j in range(m)}
    kept = []
    for j, k, info in edges:
        if group[j] != group[k]:
            old, new = group[j], group[k]
            group = [new if g == old else g for g in group]
            near[j].append(k)
            near[k].append(j)
            kept.append((j, k, info))
    parents, seen = [-1] * m, set()
    for root in range(m):
        stack = [root] if root not in seen else []
        while stack:
            at = stack.pop()
            seen.add(at)
            for other in near[at]:
                if other not in seen:
                    parents[other] = at
                    stack.append(other)
    return _fit(votes, q, parents, kept, rounds)


@dataclass
class Model:
    """Terms (sorted) with their weights, weights of the patterns, and the scale of the score."""

    terms: np.ndarray
    weights: np.ndarray
    patterns: np.ndarray
    bias: float
    scale: tuple[float, float]
    label_model: LabelModel | None = None

    def score(self, texts: list[str | None]) -> np.ndarray:
        found = count_terms(texts, self.terms)
        at = np.full(len(texts), self.bias) + found.patterns @ self.patterns
        if len(found.row):
            at += np.bincount(found.row, self.weights[np.searchsorted(self.terms, found.term)], len(texts))
        return 1 / (1 + np.exp(-(self.scale[0] * at + self.scale[1]).clip(-30, 30)))


def pick_terms(pos: dict[int, int], neg: dict[int, int], n_pos: float, n_neg: float, most: int = 1500) -> np.ndarray:
    """Terms that documents labelled toxic hold far more often, by a two-sample test of shares."""
    terms = np.array(sorted(pos), np.uint64)
    a = np.array([pos[int(t)] for t in terms], float)
    b = np.array([neg.get(int(t), 0) for t in terms], float)
    pa, pb, p = (a + 0.5) / (n_pos + 1), (b + 0.5) / (n_neg + 1), (a + b + 1) / (n_pos + n_neg + 2)
    z = (pa - pb) / np.sqrt(p * (1 - p) * (1 / (n_pos + 1) + 1 / (n_neg + 1)))
    good = np.flatnonzero((z >= 4) & (pa >= 20 * pb))
    return np.sort(terms[good[np.argsort(-z[good], kind="stable")][:most]])


def make_votes(found: Counted, terms: np.ndarray, lexicons: int = 12) -> np.ndarray:
    """Votes (rows x voters) as 0, 1, 2 for no, abstain, yes."""
    n = len(found.words)
    columns = []

    def yes(where: np.ndarray) -> None:
        columns.append(1 + (np.bincount(found.row[where], minlength=n) > 0).astype(int))

    shard = mix(found.term + np.uint64(99)) % np.uint64(lexicons)
    for k in range(lexicons):
        yes(shard == k)
    for words in INSULTS:
        yes(np.isin(found.term, np.array([term_of(w) for w in words], np.uint64)))
    hits = np.bincount(found.row, minlength=n)
    columns.append(1 + (hits >= 3).astype(int))
    columns += [1 + found.patterns[:, k] for k in range(found.patterns.shape[1])]
    columns.append((hits > 0).astype(int))  # a text without any term is voted clean
    columns.append(((200 * hits >= found.words) | (found.words < 50)).astype(int))
    columns.append((hits > 1).astype(int))
    return np.stack(columns, 1)


def _logistic(rows: np.ndarray, columns: np.ndarray, n: int, width: int, target: np.ndarray, weight: np.ndarray, rounds: int = 300, l2: float = 2e-3):
    """Weights and bias of a logistic regression on sparse 0/1 features, by Adam on the whole sample."""
    w, b = np.zeros(width), float(np.log(target.mean().clip(1e-3, 0.999) / (1 - target.mean().clip(1e-3, 0.999))))
    m, v = np.zeros(width + 1), np.zeros(width + 1)
    weight = weight / weight.sum()
    for t in range(1, rounds + 1):
        p = 1 / (1 + np.exp(-(np.bincount(rows, w[columns], n) + b).clip(-30, 30)))
        d = (p - target) * weight
        g = np.append(np.bincount(columns, d[rows], width) + l2 * w / max(width, 1), d.sum())
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        step = 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-10)
        w, b = w - step[:-1], b - step[-1]
    return w, b


def _scale(raw: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and offset that fit raw scores to labels (Platt), by damped Newton steps with targets off 0 and 1."""
    pos, neg = y.sum(), len(y) - y.sum()
    target = np.where(y == 1, (pos + 1) / (pos + 2), 1 / (neg + 2))
    weight = weight / weight.mean()
    a, c = 1.0, 0.0
    for _ in range(30):
        p = 1 / (1 + np.exp(-(a * raw + c).clip(-30, 30)))
        d, h = weight * (p - target), weight * (p * (1 - p)).clip(1e-6)
        hess = np.array([[(h * raw * raw).sum(), (h * raw).sum()], [(h * raw).sum(), h.sum()]]) + 1e-3 * np.eye(2)
        step = np.linalg.solve(hess, np.array([(d * raw).sum(), d.sum()]) + 1e-3 * np.array([a - 1, c]))
        a, c = a - step[0].clip(-1, 1), c - step[1].clip(-2, 2)
    return float(max(a, 0.05)), float(c)


def _term_counts(wanted=None):
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            found = count_terms(batch.column(0).to_pylist(), None if wanted is None else wanted.value)
            terms, counts = np.unique(found.term, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(terms.view(np.int64)), pa.array(counts.astype(np.int64))], ["term", "n"])

    return run


def _hits(wanted):
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            found = count_terms(batch.column(2).to_pylist(), wanted.value)
            lists: list[list[int]] = [[] for _ in range(batch.num_rows)]
            for r, t in zip(found.row, found.term.view(np.int64), strict=True):
                lists[r].append(int(t))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(lists, pa.list_(pa.int64())), pa.array(found.words), pa.array(found.patterns.tolist(), pa.list_(pa.int8()))],
                ["at", "toxic", "terms", "words", "patterns"],
            )

    return run


def learn(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", most_per_class: int = 4000) -> Model:
    """A model from labelled documents that are not held out.

    About `most_per_class` documents of each label are drawn by a hash of
    their id; a label of fewer is used whole. Of an id that has several labels
    the highest counts. Without labelled rows the fixed lists alone are used.
    Of the sample's terms the 50,000 most frequent of each label are looked at,
    and `pick_terms` keeps 1,500 of them at most; both bound what the driver holds.
    """
    spark = docs.sparkSession
    fixed = np.unique(np.array([term_of(w) for words in INSULTS for w in words], np.uint64))
    known = (
        labels.filter(F.col(label).isNotNull() & F.col(doc_id).isNotNull()).filter(~held_out(doc_id, 5, 0))
        .groupBy(F.col(doc_id).alias("id")).agg((F.max(label) > 0).cast("int").alias("toxic"))
    )
    sizes = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    plain = Model(fixed, np.full(len(fixed), 2.0), np.zeros(len(PATTERNS)), -3.0, (1.0, 0.0))
    if len(sizes) < 2:
        return plain
    rate = {y: min(1.0, most_per_class / n) for y, n in sizes.items()}
    at = F.xxhash64("id", F.lit("toxic"))
    drawn = known.withColumn("at", at).filter(
        (F.col("at") / 2.0**64 + 0.5) < F.when(F.col("toxic") == 1, rate[1]).otherwise(rate[0])
    ).orderBy("at").limit(4 * most_per_class)
    drawn = F.broadcast(spark.createDataFrame([tuple(r) for r in drawn.collect()], drawn.schema))  # at most 4 * most_per_class rows
    sample = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text")).join(drawn, "id")

    def counts(y: int, wanted=None) -> dict[int, int]:
        some = sample.filter(F.col("toxic") == y).select("text").mapInArrow(_term_counts(wanted), "term long, n long")
        total = some.groupBy("term").agg(F.sum("n").alias("n")).filter("n >= 3" if wanted is None else "n > 0")
        rows = total.orderBy(F.desc("n"), "term").limit(50_000).collect()
        return {r.term % 2**64: r.n for r in rows}

    pos = counts(1)
    wanted = spark.sparkContext.broadcast(np.array(sorted(pos), np.uint64))
    terms = pick_terms(pos, counts(0, wanted), sizes[1] * rate[1], sizes[0] * rate[0])
    terms = np.unique(np.concatenate([terms, fixed]))
    wanted = spark.sparkContext.broadcast(terms)
    rows = (
        sample.select("at", "toxic", "text").mapInArrow(_hits(wanted), "at long, toxic int, terms array<long>, words double, patterns array<tinyint>")
        .orderBy("at", F.hash("terms")).limit(8 * most_per_class).collect()
    )
    if not rows or len({r.toxic for r in rows}) < 2:
        return plain
    n = len(rows)
    found = Counted(
        np.repeat(np.arange(n), [len(r.terms) for r in rows]), np.array([t for r in rows for t in r.terms], np.int64).view(np.uint64),
        np.array([r.words for r in rows]), np.array([r.patterns for r in rows], np.int8).reshape(n, len(PATTERNS)),
    )
    y = np.array([r.toxic for r in rows])
    weight = np.where(y == 1, 1 / rate[1], 1 / rate[0])
    votes = make_votes(found, terms)
    yes = (votes == 2).sum(1)
    label_model, q = fit_label_model(votes, np.where(yes >= 2, 0.95, np.where(yes == 1, 0.4, 0.02)))
    shown = np.argwhere(found.patterns > 0)
    features = np.concatenate([np.searchsorted(terms, found.term), len(terms) + shown[:, 1]])
    lines = np.concatenate([found.row, shown[:, 0]])
    w, bias = _logistic(lines, features, n, len(terms) + len(PATTERNS), q, weight)
    raw = np.bincount(lines, w[features], n) + bias
    return Model(terms, w[: len(terms)], w[len(terms) :], bias, _scale(raw, y, weight), label_model)


def _scoring(shared, token: str):
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        model = once(token, lambda: Model(*shared.value))
        for batch in batches:
            score = np.concatenate([np.zeros(0), *(model.score(batch.column(1).slice(k, 1000).to_pylist()) for k in range(0, batch.num_rows, 1000))])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score)], ["id", "score"])

    return run


def scored(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: id, score, predicted. Null and empty texts get the score of a text without any term."""
    shared = docs.sparkSession.sparkContext.broadcast((model.terms, model.weights, model.patterns, model.bias, model.scale))
    frame = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"))
    out = frame.mapInArrow(_scoring(shared, uuid.uuid4().hex), with_type_of(frame, {"id": "id"}, "score double"))
    return out.select(F.col("id").alias(doc_id), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def learn_and_score(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (id, held_out, score, predicted)."""
    out = scored(docs, learn(docs, labels, doc_id, text), doc_id, text)
    return out.select(doc_id, held_out(doc_id, 5, 0).alias("held_out"), "score", "predicted")
