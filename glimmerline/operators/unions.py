"""Ordered distinct unions of array columns per group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def explode_computed(df: DataFrame, keep: list[str], array: str, at: str, value: str) -> DataFrame:
    """Rows of an array column that is costly to compute.

    A plain explode of a column makes the optimizer add a size test and push it
    down, which computes the array again, nested steps included. The outer form
    with a test on its own output computes it once.
    """
    rows = df.select(*keep, F.posexplode_outer(array).alias(at, value))
    return rows.filter(F.col(at).isNotNull())


def _tags(lists: dict[str, Column]) -> Column:
    """All values with the number of their list (a name would be shuffled with each value) and their place."""
    tag = lambda no, values: F.transform(
        F.coalesce(values, F.expr("CAST(array() AS ARRAY<STRING>)")),
        lambda v, i: F.struct(F.lit(no).cast("tinyint").alias("list"), i.alias("at"), v.alias("value")),
    )
    return F.concat(*[tag(no, values) for no, values in enumerate(lists.values())])


def ordered_unions(
    df: DataFrame,
    key: list[str],
    order: Column,
    lists: dict[str, Column],
    modes: tuple[str, ...] = (),
) -> DataFrame:
    """Per key, the distinct values of each list in order of first appearance.

    Values are reduced to one row per (key, list, value) with map-side combine
    before anything is collected, so a group with many repeats stays small.
    Names in `modes` come back as the most common value instead (A5).
    """
    tagged = _tags(lists)
    rows = df.select(*key, order.alias("_order"), F.explode(tagged).alias("t")).filter(
        F.col("t.value").isNotNull() & (F.col("t.value") != "")
    )
    values = rows.groupBy(*key, F.col("t.list").alias("list"), F.col("t.value").alias("value")).agg(
        F.min(F.struct("_order", "t.at")).alias("first"), F.count("*").alias("n")
    )
    picks = []
    for no, name in enumerate(lists):
        mine = F.col("list") == no
        if name in modes:
            best = F.min(F.when(mine, F.struct((-F.col("n")).alias("n"), "first", "value")))
            picks.append(best["value"].alias(name))
        else:
            seen = F.array_sort(F.collect_list(F.when(mine, F.struct("first", "value"))))
            picks.append(F.transform(seen, lambda s: s["value"]).alias(name))
    return values.groupBy(*key).agg(*picks)


def first_values(df: DataFrame, key: list[str], order: Column, lists: dict[str, tuple[Column, int]]) -> DataFrame:
    """Like `ordered_unions`, but only the first k values of each list are kept.

    The cut happens as a pruned `row_number`, so no full list is ever collected.
    """
    from .ordering import top_n_per

    tagged = _tags({name: values for name, (values, _) in lists.items()})
    rows = df.select(*key, order.alias("_order"), F.explode(tagged).alias("t")).filter(
        F.col("t.value").isNotNull() & (F.col("t.value") != "")
    )
    values = rows.groupBy(*key, F.col("t.list").alias("list"), F.col("t.value").alias("value")).agg(
        F.min(F.struct("_order", "t.at")).alias("first")
    )
    most = max(k for _, k in lists.values())
    top = top_n_per(values, [*key, "list"], ["first"], most)
    picks = []
    for no, (name, (_, k)) in enumerate(lists.items()):
        seen = F.array_sort(F.collect_list(F.when(F.col("list") == no, F.struct("first", "value"))))
        picks.append(F.slice(F.transform(seen, lambda s: s["value"]), 1, k).alias(name))
    return top.groupBy(*key).agg(*picks)
