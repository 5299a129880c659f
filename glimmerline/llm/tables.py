"""Tables that a job writes for itself under the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, types as T

from ..session import scratch_path


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows, written once as Parquet where all executors can read them; cuts lineage."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def with_type_of(frame: DataFrame, columns: dict[str, str], rest: str) -> T.StructType:
    """A schema: columns that have the type of a column of `frame`, then those of a DDL string."""
    own = [T.StructField(name, frame.schema[of].dataType) for name, of in columns.items()]
    return T.StructType([*own, *T.StructType.fromDDL(rest).fields])
