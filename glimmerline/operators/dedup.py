"""First-wins and last-wins rules over explicit order columns."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from ..session import cut_lineage, spread_out
from .components import connected_components


def keep_first(df: DataFrame, keys: Sequence[str | Column], order: Sequence[str | Column]) -> DataFrame:
    """One row per key: the first by `order`.

    Written as `row_number() <= 1`, which Spark prunes inside every map task
    before the shuffle, so a hot key sends one row per task.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter("_rn <= 1").drop("_rn")


def keep_last(df: DataFrame, keys: Sequence[str | Column], order: Sequence[str]) -> DataFrame:
    """One row per key: the last by `order`."""
    return keep_first(df, keys, [F.col(c).desc() for c in order])


def drop_seen(df: DataFrame, seen: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not stored yet."""
    return df.join(seen.select(key), key, "left_anti")


def idempotency_key(salt: Column, provider: Column, external_id: Column) -> Column:
    """Salt, provider and external id joined by colons."""
    return F.concat_ws(":", salt, provider, external_id)


def _walk(batches: Iterator) -> Iterator:
    """Sorted rows (component, pos, keys) to the positions that the sequential rule keeps; holds the keys of one component."""
    import pyarrow as pa

    now, claimed = None, set()
    for batch in batches:
        kept = []
        for component, pos, own in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if component != now:
                now, claimed = component, set()
            if claimed.isdisjoint(own):
                claimed.update(own)
                kept.append(pos)
        yield pa.RecordBatch.from_arrays([pa.array(kept, batch.schema.field(1).type)], ["pos"])


def _walked(open_keys: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """(kept positions of the components with at most `most` keys, the keys of larger ones)."""
    heads = open_keys.groupBy("key").agg(F.min("pos").alias("head"))
    edges = open_keys.join(heads, "key").select(F.col("head").alias("a"), F.col("pos").alias("b"))
    found = connected_components(edges).withColumnRenamed("node", "pos")
    named = cut_lineage(open_keys.join(found, "pos", "left").withColumn("component", F.coalesce("component", "pos")))
    sizes = named.groupBy("component").agg(F.count("*").alias("n"))
    judged = named.join(sizes, "component")
    rows = judged.filter(F.col("n") <= most).groupBy("component", "pos").agg(F.collect_set("key").alias("keys"))
    sorted_ = spread_out(rows, "component").sortWithinPartitions("component", "pos")
    kept = cut_lineage(sorted_.mapInArrow(_walk, T.StructType([open_keys.schema["pos"]])))
    return kept, cut_lineage(judged.filter(F.col("n") > most).select(*open_keys.columns))


def greedy_dedup(df: DataFrame, pos: str, keys: dict[str, Column], rounds: int = 3, most: int = 100_000) -> DataFrame:
    """Walk in `pos` order, drop a row that shares a key with a *kept* earlier row.

    `keys` maps a name to a text column; null claims nothing. The rule is not
    transitive, so it runs as rounds: a row that is first in all its key groups
    is kept, its neighbours are dropped, and both leave with their keys. Only
    keys held by more than one row take part, and groups are only ever reduced
    to their minimum. A chain of rows that share keys pairwise would cost a round
    per two links, so after each `rounds` rounds what is left is cut into
    components, and those of at most `most` keys are walked as they are, in
    order, one component at a time.
    """
    tagged = F.array_compact(
        F.array(*[F.when(c.isNotNull(), F.concat(F.lit(name + "="), c)) for name, c in keys.items()])
    )
    held = df.select(F.col(pos).alias("pos"), F.explode(tagged).alias("key"))
    shared = held.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").select("key")
    open_keys = cut_lineage(held.join(shared, "key"))
    contested = open_keys.select("pos").distinct()
    kept_parts: list[DataFrame] = []
    done = 0
    while not open_keys.isEmpty():
        if done and done % rounds == 0:
            walked, open_keys = _walked(open_keys, most)
            kept_parts.append(walked)
        done += 1
        first = open_keys.groupBy("key").agg(F.min("pos").alias("first"))
        judged = open_keys.join(first, "key")
        kept = cut_lineage(
            judged.groupBy("pos").agg(F.bool_and(F.col("pos") == F.col("first")).alias("win"))
            .filter("win").select("pos")
        )
        kept_parts.append(kept)
        claimed = open_keys.join(kept, "pos", "left_semi").select("key")
        # a claimed key decides every holder of it: the winner and the dropped ones
        decided = open_keys.join(claimed, "key", "left_semi").select("pos").distinct()
        open_keys = cut_lineage(open_keys.join(decided, "pos", "left_anti"))
    if not kept_parts:
        return df
    kept_all = reduce(DataFrame.unionByName, kept_parts)
    dropped = contested.join(kept_all, "pos", "left_anti")
    return df.join(dropped.withColumnRenamed("pos", pos), pos, "left_anti")


def document_keys(url: Column, content_hash: Column, title: Column, published: Column) -> dict[str, Column]:
    """The three keys of D2; empty url and title never match."""
    u = F.lower(F.trim(F.coalesce(url, F.lit(""))))
    t = F.lower(F.trim(F.coalesce(title, F.lit(""))))
    when = F.coalesce(published.cast("string"), F.lit(""))
    return {
        "url": F.when(u != "", u),
        "hash": content_hash,
        "title": F.when(t != "", F.concat(t, F.lit("\u0001"), when)),
    }
