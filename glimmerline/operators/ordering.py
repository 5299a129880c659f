"""Positions and ranks without a single-task window."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..session import written

_ROW_BITS = 33  # monotonically_increasing_id keeps the row number in the low 33 bits


def with_positions(df: DataFrame, order: Sequence[Column | str], name: str = "rank") -> DataFrame:
    """Adds the 0-based global position by `order`.

    Range-partition and sort, number the rows of each partition, write them once
    as Parquet, which takes a fraction of a checkpoint, count the rows of each
    partition, and add the offset of its partition to each row. The only table
    that sees one task has a row per partition.
    """
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    tagged = written(ranged.withColumn("_mid", F.monotonically_increasing_id()), "positions")
    part = F.shiftright("_mid", _ROW_BITS)
    sizes = tagged.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    row = F.col("_mid").bitwiseAND((1 << _ROW_BITS) - 1)
    return (
        tagged.withColumn("_part", part)
        .join(F.broadcast(offsets), "_part")  # a row per partition
        .withColumn(name, F.col("_off") + row)
        .drop("_mid", "_part", "_off")
    )


def sequential_ids(df: DataFrame, order: Sequence[Column | str], prefix: str, name: str) -> DataFrame:
    """`prefix` + 1-based position."""
    return (
        with_positions(df, order, "_p")
        .withColumn(name, F.concat(F.lit(prefix), (F.col("_p") + 1).cast("string")))
        .drop("_p")
    )


def top_n(df: DataFrame, order: Sequence[Column], n: int | None) -> DataFrame:
    """Planned as TakeOrderedAndProject; without n all rows stay, unsorted.

    The plan reserves room for n rows, so "everything" must not be a huge n.
    """
    return df if n is None else df.orderBy(*order).limit(n)


def top_n_per(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], n: int | Column, most: int | None = None) -> DataFrame:
    """First n rows per key.

    A number is pruned map-side, so a hot key sends n rows per task. For an n
    that differs by row, `most` is its bound and is pruned first.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    ranked = df.withColumn("_rn", F.row_number().over(w))
    if most is not None:
        ranked = ranked.filter(F.col("_rn") <= most)
    return ranked.filter(F.col("_rn") <= n).drop("_rn")


def page(df: DataFrame, order: Sequence[Column], page_no: int = 1, page_size: int = 20) -> DataFrame:
    """One page of an ordered table."""
    return df.orderBy(*order).offset((page_no - 1) * page_size).limit(page_size)


def page_info(df: DataFrame, page_size: int = 20) -> DataFrame:
    """Total rows and pages; at least one page."""
    total = F.count("*")
    return df.agg(
        total.alias("total"),
        F.greatest(F.lit(1), F.ceil(total / F.lit(page_size))).cast("bigint").alias("total_pages"),
    )


def one_row(spark: SparkSession, **values: DataFrame) -> DataFrame:
    """A single row from one-row, one-column tables, as scalar subqueries."""
    return spark.range(1).select(*[df.scalar().alias(name) for name, df in values.items()])


def row_count(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("n"))


def first_seen_mode(df: DataFrame, keys: Sequence[str], value: str, order: Column) -> DataFrame:
    """A5: most common value per key, ties by first occurrence."""
    counted = df.groupBy(*keys, value).agg(F.count("*").alias("_n"), F.min(order).alias("_first"))
    return counted.groupBy(*keys).agg(
        F.min(F.struct((-F.col("_n")).alias("n"), F.col("_first"), F.col(value).alias("v")))["v"].alias(value)
    )
