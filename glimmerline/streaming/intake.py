"""Incremental intake with Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..operators.dedup import keep_first
from ..operators.health import source_health
from ..sources.store import numbers, upsert_table


def read_landing(spark: SparkSession, path: str, schema: str, name_glob: str | None = None, per_trigger: int | None = None) -> DataFrame:
    """A landing folder as a stream; the checkpoint is the cursor."""
    reader = spark.readStream.schema(schema)
    if name_glob:
        reader = reader.option("pathGlobFilter", name_glob)
    if per_trigger:
        reader = reader.option("maxFilesPerTrigger", per_trigger)
    return reader.parquet(path)


def append_new(
    stream: DataFrame, path: str, checkpoint: str, key: str = "idempotency_key", order: Sequence[str] = ("fetched_at",), compact: int = 50
) -> StreamingQuery:
    """The first row of each key, once and for all, to `path`/rows; `read_new` reads them.

    The keys of all earlier micro-batches are a stored table, so a key is
    refused however late it returns, also after a restart or with a new
    checkpoint of the same numbering. A batch first meets the stored keys by a
    semi-join whose right side is the batch, so that the key table is read but
    not shuffled while batches are small. A batch writes folders of its own
    number, rows before keys, and looks only at smaller numbers: run again, it
    writes the same rows. After each `compact` batches the keys are folded into
    one base. Rows with a null key are dropped, as they can't be told apart.
    """

    def add(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        first = keep_first(batch.filter(F.col(key).isNotNull()), [key], list(order))
        known = _keys(spark, path, key, number)
        if known is not None:
            hit = known.join(first.select(key), key, "left_semi")
            first = first.join(hit, key, "left_anti")
        rows = f"{path}/rows/change-{number:08d}"
        first.write.mode("overwrite").parquet(rows)
        spark.read.schema(first.schema).parquet(rows).select(key).write.mode("overwrite").parquet(f"{path}/keys/change-{number:08d}")
        if number and number % compact == 0:
            _keys(spark, path, key, number + 1).write.mode("overwrite").parquet(f"{path}/keys/base-{number:08d}")

    return for_each(stream, add, checkpoint)


def _keys(spark: SparkSession, path: str, key: str, number: int) -> DataFrame | None:
    """Keys of the batches below `number`: the newest base, and the changes after it."""
    base = max((n for n in numbers(spark, f"{path}/keys", "base") if n < number), default=-1)
    folders = [f"{path}/keys/change-{n:08d}" for n in numbers(spark, f"{path}/keys", "change") if base < n < number]
    folders += [f"{path}/keys/base-{base:08d}"] if base >= 0 else []
    return spark.read.parquet(*folders).select(key) if folders else None


def read_new(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    """The rows that `append_new` has stored, of complete batches; none if there is none."""
    folders = [f"{path}/rows/change-{n:08d}" for n in numbers(spark, f"{path}/rows", "change")]
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)


def health_each(stream: DataFrame, table: str, checkpoint: str) -> StreamingQuery:
    """Source health carried over micro-batches of (source_id, ts, pos, block_type, success).

    A micro-batch is folded by the batch job, which splits a hot source over
    tasks, on top of the rows of the previous version. The version is the batch
    number, so a repeated batch writes the same table again.
    """

    def fold(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        start = spark.read.parquet(f"{table}/base-{number:08d}") if number else None
        source_health(batch, start).write.mode("overwrite").parquet(f"{table}/base-{number + 1:08d}")

    return for_each(stream, fold, checkpoint)


def upsert_each(stream: DataFrame, table: str, checkpoint: str, key: str, version: str) -> StreamingQuery:
    """T4: every micro-batch replaces documents by key."""

    def merge(batch: DataFrame, number: int) -> None:
        upsert_table(batch.sparkSession, table, batch, key, version, number + 1)

    return for_each(stream, merge, checkpoint)


def for_each(stream: DataFrame, action: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> StreamingQuery:
    return (
        stream.writeStream.foreachBatch(action).option("checkpointLocation", checkpoint).outputMode(mode)
        .trigger(availableNow=True).start()
    )
