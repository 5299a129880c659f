"""Layer tables on parquet."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.arrays import first_nonempty
from ..operators.dedup import keep_last
from ..session import scratch_path

# table name -> id column
LAYERS = {
    "documents": "document_id", "evidence_items": "evidence_id", "events": "event_id", "event_evidence_links": "link_id",
    "trend_signals": "trend_id", "intelligence_findings": "finding_id", "alert_items": "alert_id",
    "briefing_items": "briefing_id", "decision_signals": "signal_id", "recommendation_items": "recommendation_id",
    "decision_briefs": "brief_id",
}


def row_json(df: DataFrame) -> Column:
    """the whole row as JSON."""
    return F.to_json(F.struct(*[F.col(c) for c in df.columns]))


def json_value(doc: Column, path: str) -> Column:
    """a scalar by JSON path."""
    return F.get_json_object(doc, path)


def layer_rows(df: DataFrame, run_id: str | Column, created_at: Column, id_col: str, order: list[str]) -> DataFrame:
    """Rows of one save: run, creation time, and the last row per id."""
    run = F.lit(run_id) if isinstance(run_id, str) else run_id
    tagged = df.withColumns({"run_id": run, "created_at": created_at})
    return keep_last(tagged, ["run_id", id_col], order)


def document_rows(docs: DataFrame) -> DataFrame:
    """Documents with their stored columns; the preview is 500 characters."""
    return docs.withColumns(
        {
            "document_id": F.col("doc_id"), "content_hash": F.col("fingerprint"),
            "body_preview": F.substring(F.coalesce("body_text", F.lit("")), 1, 500),
        }
    )


def save_layer(df: DataFrame, root: str, table: str) -> None:
    """Replaces only the run partitions that `df` holds.

    The rebalance lets AQE cut a big run into files of the advisory size and
    merge small ones.
    """
    (
        df.hint("rebalance", "run_id")
        .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_id")
        .parquet(os.path.join(root, table))
    )


def read_layer(spark: SparkSession, root: str, table: str) -> DataFrame:
    """A layer; files with older columns are widened."""
    return spark.read.option("mergeSchema", "true").parquet(os.path.join(root, table))


def widen(old: DataFrame, new: DataFrame) -> DataFrame:
    """Old and new rows under the union of their columns."""
    return old.unionByName(new, allowMissingColumns=True)


def upsert(current: DataFrame | None, incoming: DataFrame, key: str, version: str) -> DataFrame:
    """Replace by key, the highest version stays."""
    both = incoming if current is None else current.unionByName(incoming, allowMissingColumns=True)
    return keep_last(both, [key], [version])


def upsert_table(spark: SparkSession, path: str, incoming: DataFrame, key: str, version: str, number: int | None = None) -> None:
    """Stores the incoming rows as change folder `number` (the next one if unset).

    Only the changes are written; `read_table` lets the last row per key win,
    and `compact_table` folds the changes into a base. Writing a number again
    replaces it, so a repeated micro-batch does no harm.
    """
    if number is None:
        number = max([*numbers(spark, path, "change"), *numbers(spark, path, "base"), 0]) + 1
    keep_last(incoming, [key], [version]).write.mode("overwrite").parquet(os.path.join(path, f"change-{number:08d}"))


def read_table(spark: SparkSession, path: str, key: str, version: str) -> DataFrame:
    """The current rows: newest base and the changes after it."""
    bases = numbers(spark, path, "base")
    base = max(bases, default=0)
    folders = [f"base-{base:08d}"] if bases else []
    folders += [f"change-{n:08d}" for n in numbers(spark, path, "change") if n > base]
    rows = spark.read.option("mergeSchema", "true").parquet(*[os.path.join(path, f) for f in folders])
    return keep_last(rows, [key], [version])


def compact_table(spark: SparkSession, path: str, key: str, version: str) -> None:
    """Writes base n, which holds all changes up to n."""
    number = max(numbers(spark, path, "change"), default=0)
    read_table(spark, path, key, version).write.mode("overwrite").parquet(os.path.join(path, f"base-{number:08d}"))


def numbers(spark: SparkSession, path: str, kind: str) -> list[int]:
    """Numbers of the complete folders of one kind; reads folder names only."""
    paths = spark._jvm.org.apache.hadoop.fs
    fs = paths.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    done = fs.globStatus(paths.Path(path, f"{kind}-*/_SUCCESS")) or []
    return sorted(int(s.getPath().getParent().getName().rsplit("-", 1)[1]) for s in done)


def append_attempts(results: DataFrame, path: str, created_at: Column) -> None:
    """Append-only log of fetch attempts."""
    attempt_rows(results, created_at).write.mode("append").parquet(path)


def attempt_rows(results: DataFrame, created_at: Column) -> DataFrame:
    """The logged columns of a fetch result."""
    return results.select(
        "source_id", "url", "status_code", "block_type", "fetch_mode", F.col("retryable").cast("int").alias("retryable"),
        "error", created_at.alias("created_at"),
    )


# --- S20 -----------------------------------------------------------------------------------
def run_event(spark: SparkSession, run_id: str, status: str, at: Column, metadata: str = "{}") -> DataFrame:
    """One start or finish event."""
    return spark.range(1).select(
        F.lit(run_id).alias("run_id"), F.lit(status).alias("status"), at.alias("at"), F.lit(metadata).alias("metadata_json"),
        F.lit(None).cast("string").alias("topic_query"),
    )


def current_runs(run_events: DataFrame) -> DataFrame:
    """State of every run from its events."""
    started = F.col("status") == "running"
    return run_events.groupBy("run_id").agg(
        F.max_by("status", F.struct("at", ~started)).alias("status"), F.max(F.when(started, F.col("at"))).alias("started_at"),
        F.max(F.when(~started, F.col("at"))).alias("finished_at"),
        F.max_by(F.when(started, F.col("metadata_json")), F.when(started, F.col("at"))).alias("metadata_json"),
        F.max("topic_query").alias("topic_query"),
    )


def shown_title(*names: str) -> Column:
    """The first title column that is filled."""
    return first_nonempty(*[F.col(n) for n in names])


def fresh_root(spark: SparkSession) -> str:
    """A new store folder under the shared folder."""
    return scratch_path(spark, "store")
