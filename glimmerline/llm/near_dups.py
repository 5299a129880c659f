"""Near-duplicate documents by HyperMinHash registers, banding and exact verification.

A document is its set of word shingles, as 64-bit hashes. Its sketch has one
register per bucket of hashes: the leading zeros of the bucket's least hash
and the mantissa bits after its leading one (Yu and Weber, 2017). Bands of
registers give candidates, equal registers an estimate of the similarity that
is corrected for chance collisions, and the full sets decide.

No bucket is expanded into its pairs. In the first round one hub of each
bucket meets the other members, which settles buckets of copies. Documents of
buckets that still hold several components then get finer buckets: sets that
are similar enough share one of their rarest shingles, early in the order of
rarity (prefix and position filter of Xiao et al., 2008), so that heavily
edited versions of one text, which are alike but not linked, fall apart. There
some hubs of a bucket meet the members of other components and leave it, more
of them in each round, until one component is left. A candidate pair is so
either compared or already in one component.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Window, functions as F

from ..operators.components import connected_components
from .tables import stored, with_type_of
from .words import BLANKS, as_bytes, hashed_words, mix, shingles, some_rows

HASH_BITS = 48
ZERO_BITS, MANTISSA_BITS = 6, 10
EMPTY = np.uint16(0xFFFF)
_TOGETHER = 256  # members of a bucket that meet its hubs in one task
#: Chance of a collision of unequal minima, times 2 to the mantissa bits (fixed value of the paper).
COLLISION = 0.16991948715973909


def registers(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """The sketch: 6 bits of leading zeros and 10 of mantissa per bucket, EMPTY for buckets without hash."""
    least = np.full(buckets, np.uint64(1) << np.uint64(HASH_BITS))
    values = mix(hashes ^ np.uint64(0x5851F42D4C957F2D)) >> np.uint64(64 - HASH_BITS)
    np.minimum.at(least, (hashes % np.uint64(buckets)).astype(np.int64), values)
    top = np.frexp(np.maximum(least, 1).astype(np.float64))[1]  # exact below 2**53
    zeros = (HASH_BITS - top).astype(np.int64)
    rest = (least << (zeros + 1).clip(0, HASH_BITS).astype(np.uint64)) & np.uint64((1 << HASH_BITS) - 1)
    packed = (zeros.clip(0).astype(np.uint64) << np.uint64(MANTISSA_BITS)) | (rest >> np.uint64(HASH_BITS - MANTISSA_BITS))
    return np.where(least >> np.uint64(HASH_BITS), EMPTY, packed.astype(np.uint16))


_DONORS: dict[int, np.ndarray] = {}


def filled(sketch: np.ndarray) -> np.ndarray:
    """Empty registers borrow from the first full one of a fixed random sequence (optimal densification, Shrivastava, 2017).

    Two sketches then agree in any register with the similarity's probability,
    for small sets too; a band of nearly empty registers would say little.
    """
    size = len(sketch)
    if size not in _DONORS:
        _DONORS[size] = np.random.default_rng(size).integers(0, size, (size, 512))
    out = sketch.copy()
    full = sketch != EMPTY
    if not full.any():
        return out
    for tries in (16, 512):
        open_ = np.flatnonzero(out == EMPTY)
        if not len(open_):
            break
        donors = _DONORS[size][open_, :tries]
        good = full[donors]
        first = good.argmax(1)
        out[open_] = sketch[donors[np.arange(len(open_)), first]]
    places = np.flatnonzero(full)
    open_ = np.flatnonzero(out == EMPTY)
    out[open_] = sketch[places[np.searchsorted(places, open_) % len(places)]]
    return out


def band_keys(sketch: np.ndarray, bands: int) -> np.ndarray:
    """A key per band; none for a sketch without a full register."""
    if (sketch == EMPTY).all():
        return np.zeros(0, np.uint64)
    rows = filled(sketch).reshape(bands, -1).astype(np.uint64)
    keys = np.arange(bands, dtype=np.uint64)
    for k in range(rows.shape[1]):
        keys = mix(keys * np.uint64(0x9E3779B97F4A7C15) + rows[:, k])
    return keys


def estimate(a: np.ndarray, b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Similarities of rows of sketches, corrected for chance collisions, and the registers that they rest on."""
    used = ((a != EMPTY) | (b != EMPTY)).sum(1)
    equal = ((a == b) & (a != EMPTY)).sum(1)
    ratio = size_a / np.maximum(size_b, 1)
    chance = COLLISION / (1 << MANTISSA_BITS) * used * 4 * ratio / (1 + ratio) ** 2
    return np.where(used > 0, (equal - chance) / np.maximum(used, 1), 0.0), used


def _sketcher(width: int, rows: int, bands: int):
    def sketch(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in some_rows(batches):
            sizes, one, two, sketches, keys = [], [], [], [], []
            for _, words in hashed_words(as_bytes(batch.column(1)), BLANKS):
                hashes = shingles(words, width)
                sizes.append(len(hashes))
                one.append(int(mix(hashes).sum(dtype=np.uint64).astype(np.int64)))
                two.append(int(mix(hashes + np.uint64(1)).sum(dtype=np.uint64).astype(np.int64)))
                made = registers(hashes, rows * bands)
                sketches.append(made.tobytes())
                keys.append(band_keys(made, bands).astype(np.int64))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), pa.array(sizes, pa.int64()), pa.array(one, pa.int64()), pa.array(two, pa.int64()),
                    pa.array(sketches, pa.binary()), pa.array(keys, pa.list_(pa.int64())),
                ],
                ["id", "n", "one", "two", "sketch", "keys"],
            )

    return sketch


def _likely(threshold: int):
    """Keeps pairs whose estimate is at most seven standard errors below the threshold, and whose sizes allow it.

    A pair at the default threshold is dropped with probability below 1e-9 (binomial, 160 registers), a twentieth of that of sharing no band.
    """

    def keep(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            if not batch.num_rows:
                continue
            n_a, n_b = (batch.column(k).to_numpy() for k in (2, 3))
            a, b = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint16).reshape(batch.num_rows, -1) for k in (4, 5))
            at, used = estimate(a, b, n_a, n_b)
            t = threshold / 100
            sure = at >= t - 7 * np.sqrt(t * (1 - t) / np.maximum(used, 1))
            sure &= 100 * np.minimum(n_a, n_b) >= threshold * np.maximum(n_a, n_b)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(at)], ["a", "b", "likeness"]
            ).filter(pa.array(sure))

    return keep


def _linked(width: int, threshold: int):
    """Keeps pairs whose full shingle sets are similar enough."""

    def keep(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in some_rows(batches):
            texts = [t for pair in zip(as_bytes(batch.column(2)), as_bytes(batch.column(3)), strict=True) for t in pair]
            sets = (shingles(words, width) for _, words in hashed_words(texts, BLANKS))
            sure = []
            for a in sets:
                b = next(sets)
                both = len(np.intersect1d(a, b, assume_unique=True))
                sure.append(both > 0 and 100 * both >= threshold * (len(a) + len(b) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(sure, pa.bool_()))

    return keep


def near_duplicates(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 5, threshold: int = 85, rows: int = 5, bands: int = 32
) -> DataFrame:
    """One row per document: id, n_shingles, component_id, kept.

    Documents are linked if 100 * |A and B| >= threshold * |A or B| over the
    sets of their `width`-word shingles; words are runs of anything but ASCII
    white space, A-Z folded. `component_id` is the smallest id reachable,
    `kept` marks the document that bears it. Null, empty and blank texts have
    no shingles and link with nothing. Rows that share an id are one node with
    several texts. Rows with null id link with nothing, have a null component
    and are kept. Other columns are ignored.

    At the default 32 bands of 5 registers a pair at the threshold shares no
    band with probability (1 - 0.85**5)**32, below 1e-8.
    """
    frame = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"))
    sketches = stored(
        frame.mapInArrow(_sketcher(width, rows, bands), with_type_of(frame, {"id": "id"}, "n long, one long, two long, sketch binary, keys array<long>")),
        "sketches",
    )
    real = sketches.filter("id is not null and n > 0")
    copies = real.groupBy("one", "two").agg(F.min("id").alias("rep"))  # equal sets, by 128 bits
    firsts = copies.select(F.col("rep").alias("id")).distinct()
    members = real.join(firsts, "id", "left_semi").select("id", F.explode("keys").alias("key"))
    shared = members.groupBy("key").agg(F.count("*").alias("size")).filter("size > 1").select("key")
    members = stored(members.join(shared, "key"), "members")
    ids = members.select("id").distinct()
    faces = stored(real.join(ids, "id", "left_semi").select("id", "n", "sketch"), "faces")
    texts = stored(frame.join(ids, "id", "left_semi"), "texts")
    labels = stored(ids.withColumn("comp", F.col("id")), "labels")
    members = members.withColumns({"n": F.lit(1).cast("long"), "at": F.lit(0).cast("long")})
    hubs = 1
    while True:
        active, chosen = _open_buckets(members, labels, hubs, threshold)
        if active.isEmpty():
            break
        pairs = (
            chosen.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts").join(active, ["key", "part"]).filter("comp <> hub_comp")
            .filter((100 + threshold) * F.least(F.col("hub_n") - F.col("hub_at"), F.col("n") - F.col("at")) >= threshold * (F.col("hub_n") + F.col("n")))
            .select(F.least("hub", "id").alias("a"), F.greatest("hub", "id").alias("b")).distinct()
        )
        links = _verified(pairs, faces, texts, width, threshold)
        if not links.isEmpty():
            name = labels.select(F.col("id").alias("a"), F.col("comp").alias("comp_a"))
            other = labels.select(F.col("id").alias("b"), F.col("comp").alias("comp_b"))
            moved = connected_components(links.join(name, "a").join(other, "b"), "comp_a", "comp_b")
            moved = moved.select(F.col("node").alias("comp"), "component")
            labels = stored(
                labels.join(moved, "comp", "left").select("id", F.coalesce("component", "comp").alias("comp")), "labels"
            )
        if hubs == 1:
            left, _ = _open_buckets(members, labels, hubs, threshold)
            members = _rare_shingles(texts.join(left.select("id").distinct(), "id", "left_semi"), width, threshold)
        else:
            gone = chosen.select("key", F.col("hub").alias("id"))
            members = active.select("key", "id", "n", "at").join(gone, ["key", "id"], "left_anti")
        hubs *= 8
    return _with_components(sketches, copies, labels, doc_id)


def _open_buckets(members: DataFrame, labels: DataFrame, hubs: int, threshold: int) -> tuple[DataFrame, DataFrame]:
    """(members of buckets that hold several components, hubs of those buckets).

    Hubs are taken from outside the largest component of the bucket. Of a pair
    that can be linked, the smaller set has the shared shingle early; buckets
    without such a member are settled. The members of a large bucket are dealt
    to parts, and each part meets a copy of the hubs, which are few.
    """
    now = members.join(labels, "id").withColumn("early", (100 + threshold) * (F.col("n") - F.col("at")) >= 2 * threshold * F.col("n"))
    counts = now.groupBy("key", "comp").agg(F.count("*").alias("size"), F.max("early").alias("early"))
    open_keys = counts.groupBy("key").agg(
        F.count("*").alias("comps"), F.max("early").alias("early"), F.max_by("comp", F.struct("size", -F.hash("comp"), "comp")).alias("main"),
        F.ceil(F.sum("size") / _TOGETHER).cast("int").alias("parts"),
    ).filter("comps > 1 and early").select("key", "main", "parts")
    dealt = now.drop("early").join(open_keys, "key").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    active = stored(dealt, "active")
    order = Window.partitionBy("key").orderBy("id", "n", "at")
    ranked = active.filter("comp <> main").withColumn("place", F.row_number().over(order)).filter(F.col("place") <= hubs)
    return active, ranked.select(
        "key", "parts", F.col("id").alias("hub"), F.col("comp").alias("hub_comp"), F.col("n").alias("hub_n"), F.col("at").alias("hub_at")
    )


def _set_rows(width: int):
    def make(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in some_rows(batches):
            sets = [shingles(words, width).astype(np.int64) for _, words in hashed_words(as_bytes(batch.column(1)), BLANKS)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(x) for x in sets], pa.int64()), pa.array(sets, pa.list_(pa.int64()))], ["id", "n", "keys"]
            )

    return make


def _rare_shingles(texts: DataFrame, width: int, threshold: int) -> DataFrame:
    """Rows (key, id, n, at): shingles of a document that are shared, and come so early by rarity that a link must share one."""
    schema = with_type_of(texts, {"id": "id"}, "n long, keys array<long>")
    every = stored(texts.select("id", "text").mapInArrow(_set_rows(width), schema), "sets").select("id", "n", F.explode("keys").alias("key"))
    shared = every.groupBy("key").agg(F.count("*").alias("rows")).filter("rows > 1")
    kept = every.join(shared, "key").groupBy("id", "n").agg(F.array_sort(F.collect_list(F.struct("rows", "key"))).alias("keys"))
    placed = kept.select("id", "n", F.size("keys").alias("some"), F.posexplode("keys").alias("k", "s"))
    at = F.col("n") - F.col("some") + F.col("k")
    return placed.select("s.key", "id", "n", at.cast("long").alias("at")).filter(100 * (F.col("n") - F.col("at")) >= threshold * F.col("n"))


def _verified(pairs: DataFrame, faces: DataFrame, texts: DataFrame, width: int, threshold: int) -> DataFrame:
    """Links among the pairs. Each document first meets its likeliest partner; other pairs only if that left them apart."""

    def side(table: DataFrame, end: str) -> DataFrame:
        return table.select(*[F.col(c).alias(end if c == "id" else f"{c}_{end}") for c in table.columns])

    faced = pairs.join(side(faces, "a"), "a").join(side(faces, "b"), "b")
    likely = stored(
        faced.select("a", "b", "n_a", "n_b", "sketch_a", "sketch_b").mapInArrow(
            _likely(threshold), with_type_of(pairs, {"a": "a", "b": "b"}, "likeness double")
        ), "likely",
    )
    order = Window.partitionBy("b").orderBy(F.desc("likeness"), "a")
    best = likely.withColumn("at", F.row_number().over(order)).filter("at = 1").select("a", "b")

    def checked(some: DataFrame) -> DataFrame:
        both = some.join(side(texts, "a"), "a").join(side(texts, "b"), "b").select("a", "b", "text_a", "text_b")
        return both.mapInArrow(_linked(width, threshold), some.select("a", "b").schema)

    first = stored(checked(best).distinct(), "links")
    root = first.select(F.col("b").alias("id"), F.col("a").alias("root"))
    rest = (
        likely.select("a", "b").distinct().join(best, ["a", "b"], "left_anti")
        .join(side(root, "a"), "a", "left").join(side(root, "b"), "b", "left")
        .filter(F.coalesce("root_a", "a") != F.coalesce("root_b", "b")).select("a", "b")
    )
    return first.unionByName(stored(checked(rest).distinct(), "links"))


def _with_components(sketches: DataFrame, copies: DataFrame, labels: DataFrame, doc_id: str) -> DataFrame:
    """Labels of the firsts of each set of copies, carried to all rows of the table."""
    kept = sketches.select("id", "n", "one", "two")
    roots = copies.join(labels, F.col("rep") == F.col("id"), "left").select("one", "two", F.coalesce("comp", "rep").alias("root"))
    found = kept.join(roots, ["one", "two"], "left").select("id", "n", F.when(F.col("n") > 0, F.col("root")).alias("root"))
    component = F.when(F.col("id").isNull(), F.col("id")).otherwise(F.coalesce("root", "id"))
    return found.select(
        F.col("id").alias(doc_id), F.col("n").alias("n_shingles"), component.alias("component_id"),
        F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"),
    )
