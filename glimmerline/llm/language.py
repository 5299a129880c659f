"""Language of texts by a bidirectional gated recurrent network over bytes.

The network reads a word at a time, between two boundary bytes, labels every
position, and a document's probabilities are the mean over all its positions.
State does not cross words, so equal words of a block are run once and count
as often as they occur. Words are runs of letters (ASCII letters and all that
is not ASCII); blanks, digits and punctuation only part them, are not read by
the network and get no label, and runs above 40 bytes are cut. Training is
backpropagation through time in numpy, on a bounded sample of words; it takes
1,000 languages at most and refuses more.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, functions as F

from .tables import with_type_of
from .words import LETTERS, Block, as_bytes, blocks, once, some_rows

LONGEST = 40  # longer runs of letters are cut; each piece is a word of its own
UNDETERMINED = "und"
_KNOWN_MOST = 300_000


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


@dataclass
class Gru:
    """One direction: input rows per byte for the reset, update and new gates, and the recurrent matrix."""

    inputs: np.ndarray
    recurrent: np.ndarray
    steps: list = field(default_factory=list)

    def forward(self, data: np.ndarray, keep: bool = False) -> np.ndarray:
        """States after each column of `data` (words x positions): positions x words x hidden."""
        n, size = data.shape[0], self.recurrent.shape[0]
        state = np.zeros((n, size), np.float32)
        out = np.empty((data.shape[1], n, size), np.float32)
        self.steps = []
        for t in range(data.shape[1]):
            x, g = self.inputs[data[:, t]], state @ self.recurrent
            gates = _sigmoid(x[:, : 2 * size] + g[:, : 2 * size])
            reset, update, inner = gates[:, :size], gates[:, size:], g[:, 2 * size :]
            new = np.tanh(x[:, 2 * size :] + reset * inner)
            if keep:
                self.steps.append((state, reset, update, inner, new))
            state = new + update * (state - new)
            out[t] = state
        return out

    def backward(self, data: np.ndarray, grad: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Gradients of inputs and recurrent matrix, from those of the states."""
        by_byte, by_state = np.zeros_like(self.inputs), np.zeros_like(self.recurrent)
        carried = np.zeros_like(grad[0])
        for t in reversed(range(data.shape[1])):
            state, reset, update, inner, new = self.steps[t]
            d = grad[t] + carried
            d_new = d * (1 - update) * (1 - new * new)
            d_update = d * (state - new) * update * (1 - update)
            d_reset = d_new * inner * reset * (1 - reset)
            np.add.at(by_byte, data[:, t], np.hstack([d_reset, d_update, d_new]))
            d_gates = np.hstack([d_reset, d_update, d_new * reset])
            by_state += state.T @ d_gates
            carried = d * update + d_gates @ self.recurrent.T
        return by_byte, by_state


@dataclass
class Tagger:
    """Both directions and the layer that labels a position."""

    classes: list[str]
    ahead: Gru
    back: Gru
    weights: np.ndarray
    bias: np.ndarray

    @staticmethod
    def fresh(classes: list[str], hidden: int, seed: int) -> Tagger:
        rng = np.random.default_rng(seed)
        draw = lambda *shape: rng.normal(0, 0.3, shape).astype(np.float32)
        gru = lambda: Gru(draw(256, 3 * hidden), draw(hidden, 3 * hidden))
        return Tagger(classes, gru(), gru(), draw(2 * hidden, len(classes)), np.zeros(len(classes), np.float32))

    @staticmethod
    def of(classes: list[str], parameters: list[np.ndarray]) -> Tagger:
        a, b, c, d, weights, bias = parameters
        return Tagger(classes, Gru(a, b), Gru(c, d), weights, bias)

    def label(self, data: np.ndarray, keep: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """(states, class probabilities) of every position: positions x words x classes."""
        states = np.concatenate([self.ahead.forward(data, keep), self.back.forward(data[:, ::-1], keep)[::-1]], axis=2)
        logits = states @ self.weights + self.bias
        logits -= logits.max(axis=2, keepdims=True)
        np.exp(logits, out=logits)
        return states, logits / logits.sum(axis=2, keepdims=True)

    def step(self, data: np.ndarray, target: np.ndarray) -> list[np.ndarray]:
        """Gradients of the mean cross entropy over all positions, in the order of `parameters`."""
        states, probs = self.label(data, keep=True)
        probs[:, np.arange(len(target)), target] -= 1
        probs /= data.size
        hidden = self.ahead.recurrent.shape[0]
        d_states = probs @ self.weights.T
        flat = probs.reshape(-1, probs.shape[2])
        ahead = self.ahead.backward(data, d_states[:, :, :hidden])
        back = self.back.backward(data[:, ::-1], d_states[::-1, :, hidden:])
        return [*ahead, *back, states.reshape(-1, 2 * hidden).T @ flat, flat.sum(0)]

    def parameters(self) -> list[np.ndarray]:
        return [self.ahead.inputs, self.ahead.recurrent, self.back.inputs, self.back.recurrent, self.weights, self.bias]


def train(words: list[bytes], labels: list[int], classes: list[str], hidden: int = 16, rounds: int = 3, batch: int = 384, seed: int = 7) -> Tagger:
    """Adam over batches of words of equal length."""
    tagger, rng = Tagger.fresh(classes, hidden, seed), np.random.default_rng(seed)
    y = np.asarray(labels)
    lengths = np.array([len(w) for w in words])
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in tagger.parameters()]
    count = 0
    for _ in range(rounds):
        order = rng.permutation(len(words))
        order = order[np.argsort(lengths[order], kind="stable")]
        cuts = np.flatnonzero(np.diff(lengths[order])) + 1
        parts = [part for same in np.split(order, cuts) for part in np.array_split(same, -(-len(same) // batch))]
        for at in rng.permutation(len(parts)):
            part = parts[at]
            data = np.array([list(b"\0" + words[k] + b"\0") for k in part], np.uint8)
            count += 1
            for p, g, (m, v) in zip(tagger.parameters(), tagger.step(data, y[part]), moments, strict=True):
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                p -= 0.02 * (m / (1 - 0.9**count)) / (np.sqrt(v / (1 - 0.99**count)) + 1e-8)
    return tagger


def cut_words(block: Block) -> Block:
    """The block with words above LONGEST bytes cut into pieces."""
    pieces = -(-block.length // LONGEST)
    if not len(pieces) or pieces.max() == 1:
        return block
    at = np.arange(int(pieces.sum())) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    start = np.repeat(block.start, pieces) + at * LONGEST
    length = np.minimum(np.repeat(block.length, pieces) - at * LONGEST, LONGEST)
    return Block(block.data, np.repeat(block.row, pieces), start, length)


class Pool:
    """Sums of position probabilities per word, kept for words that were seen."""

    def __init__(self, tagger: Tagger):
        self.tagger = tagger
        self.keys, self.sums = np.zeros(0, np.uint64), np.zeros((0, len(tagger.classes)))

    def _run(self, block: Block, some: np.ndarray) -> np.ndarray:
        out = np.zeros((len(some), len(self.tagger.classes)))
        length = block.length[some]
        for size in np.unique(length):
            where = np.flatnonzero(length == size)
            for part in np.array_split(where, -(-len(where) // 1024)):
                data = np.zeros((len(part), size + 2), np.uint8)
                data[:, 1:-1] = block.data[block.start[some[part]][:, None] + np.arange(size)]
                out[part] = self.tagger.label(data)[1].sum(0)
        return out

    def documents(self, texts: list[bytes | None]) -> np.ndarray:
        """Mean class probabilities over all positions, a row per text; zeros without positions."""
        total, positions = np.zeros((len(texts), len(self.tagger.classes))), np.zeros(len(texts))
        for block in map(cut_words, blocks(texts, LETTERS)):
            keys, first, at = np.unique(block.hashes(), return_index=True, return_inverse=True)
            new = np.flatnonzero(~np.isin(keys, self.keys, assume_unique=True))
            if len(self.keys) + len(new) > _KNOWN_MOST:
                self.keys, self.sums, new = self.keys[:0], self.sums[:0], np.arange(len(keys))
            both = np.concatenate([self.keys, keys[new]])
            order = np.argsort(both)
            self.keys, self.sums = both[order], np.concatenate([self.sums, self._run(block, first[new])])[order]
            sums = self.sums[np.searchsorted(self.keys, keys)][at]
            for c in range(sums.shape[1]):
                total[:, c] += np.bincount(block.row, sums[:, c], len(texts))
            positions += np.bincount(block.row, block.length + 2.0, len(texts))
        return total / np.maximum(positions, 1)[:, None]


def _tagging(shared, token: str):
    def tag(batches: Iterator) -> Iterator:
        import pyarrow as pa

        pool = once(token, lambda: Pool(Tagger.of(*shared.value)))
        for batch in some_rows(batches):
            probs = pool.documents(as_bytes(batch.column(1)))
            lettered = np.asarray(batch.column(2).to_pylist(), bool) & (probs.sum(1) > 0)
            best = probs.argmax(1)
            names = np.array([*pool.tagger.classes, UNDETERMINED], object)[np.where(lettered, best, len(pool.tagger.classes))]
            score = np.where(lettered, probs[np.arange(len(best)), best], 0.0).clip(0, 1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(score)], ["id", "lang", "score"])

    return tag


def _some_words(most: int):
    def pick(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            found: list[list[bytes]] = [[] for _ in range(batch.num_rows)]
            for block in map(cut_words, blocks(as_bytes(batch.column(2)), LETTERS)):
                for row in np.unique(block.row):
                    where = np.flatnonzero(block.row == row)
                    found[row] += [block.data[block.start[k] : block.start[k] + block.length[k]].tobytes() for k in where[:: -(-len(where) // most)]]
            picked = [words[:: -(-len(words) // most) or 1] for words in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(picked, pa.list_(pa.binary()))], ["at", "lang", "words"])

    return pick


def learn(labelled: DataFrame, docs_per_language: int = 160, words_per_doc: int = 48, most_languages: int = 1000, **settings) -> Tagger | None:
    """A tagger from rows (id, text, lang); None if no row has both a text and a language.

    The sample is bounded: about `docs_per_language` documents of each
    language, drawn by a hash of the id, and `words_per_doc` words spread over
    the whole of each. A language of fewer documents is used whole.
    """
    usable = labelled.filter("lang is not null and text is not null and id is not null")
    counts = usable.groupBy("lang").count().orderBy("lang").limit(most_languages + 1).collect()
    if len(counts) > most_languages:
        raise ValueError(f"more than {most_languages} languages")
    if not counts:
        return None
    share = F.element_at(F.create_map(*[F.lit(x) for r in counts for x in (r["lang"], docs_per_language / r["count"])]), F.col("lang"))
    at = F.xxhash64("id", F.lit("language"))
    drawn = usable.withColumn("at", at).filter((F.col("at") / 2.0**64 + 0.5) < share).select("at", "lang", "text")
    picked = drawn.mapInArrow(_some_words(words_per_doc), "at long, lang string, words array<binary>")
    most = 2 * docs_per_language * len(counts)
    rows = picked.orderBy("at", "lang", F.hash("words")).limit(most).collect()
    classes = sorted({r.lang for r in rows if r.words})
    pairs = [(bytes(w), classes.index(r.lang)) for r in rows if r.words for w in r.words]
    return train([w for w, _ in pairs], [y for _, y in pairs], classes, **settings) if pairs else None


def identify(docs: DataFrame, tagger: Tagger | None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: id, lang_pred, score.

    `und` with score 0 for null texts, texts without a letter, and everything
    if there is no tagger. Repeated rows give repeated rows, a null id stays.
    """
    frame = docs.select(
        F.col(doc_id).alias("id"), F.col(text).alias("text"), F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False)).alias("letters")
    )
    if tagger is None:
        return frame.select(F.col("id").alias(doc_id), F.lit(UNDETERMINED).alias("lang_pred"), F.lit(0.0).alias("score"))
    shared = docs.sparkSession.sparkContext.broadcast((tagger.classes, tagger.parameters()))  # a few hundred kB
    schema = with_type_of(frame, {"id": "id"}, "lang string, score double")
    tagged = frame.mapInArrow(_tagging(shared, uuid.uuid4().hex), schema)
    return tagged.select(F.col("id").alias(doc_id), F.col("lang").alias("lang_pred"), "score")


def least_scores(labelled: DataFrame, tagger: Tagger, quantile: float = 0.005, fewest: int = 20) -> dict[str, float]:
    """Per class the score that all but `quantile` of the documents reach that are tagged as labelled.

    Rows are (id, text, lang), not among those trained on; all of them count. A class
    with fewer than 1 / `quantile` such documents has the value of all classes
    together. If those are fewer too, the lowest score stands for a larger share
    than asked, so its distance from 1 is widened by the root of the ratio;
    with less than `fewest` no score is too low.
    """
    usable = labelled.filter("lang is not null and text is not null and id is not null").filter(F.col("lang").isin(tagger.classes))
    right = identify(usable.select(F.struct("lang").alias("id"), "text"), tagger, "id").filter("lang_pred = id.lang")
    rows = right.rollup("lang_pred").agg(F.count("*").alias("n"), F.percentile_approx("score", F.lit(quantile), F.lit(100_000)).alias("least")).collect()
    found = {r.lang_pred: (r.n, r.least) for r in rows}
    n, least = found.get(None, (0, None))
    pooled = 0.0 if n < fewest else 1 - (1 - least) * max(1.0, 1 / (n * quantile)) ** 0.5
    return {c: found[c][1] if c in found and found[c][0] * quantile >= 1 else pooled for c in tagger.classes}


def held_out(doc_id: str = "doc_id", parts: int = 3, part: int = 1):
    """Whether the crc32 of the id as text falls into the part kept for tests; false for null ids."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % parts == part, F.lit(False))


def learn_and_identify(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """Rows (id, held_out, lang_pred, score); learns from the rows of `docs` that are not held out."""
    labelled = docs.filter(~held_out(doc_id)).select(F.col(doc_id).alias("id"), F.col(text).alias("text"), F.col(lang).alias("lang"))
    found = identify(docs, learn(labelled), doc_id, text)
    return found.select(doc_id, held_out(doc_id).alias("held_out"), "lang_pred", "score")
