"""Scratch tables in the folder that all executors share.

A written table cuts the lineage, survives a lost executor (unlike a local
checkpoint) and, being columnar and compressed, is smaller than what
``DataFrame.checkpoint`` writes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.sources.scratch import clear, scratch_path, shared_dir

__all__ = ["BROADCAST_ROWS", "bounded", "clear", "materialize", "scratch_path", "shared_dir", "with_default"]

#: A side of a join is broadcast only up to so many rows of narrow columns.
BROADCAST_ROWS = 500_000


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df to a scratch table and read it back with the same columns."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bounded(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if it has at most `rows` rows, else as it is.

    df must be cheap to count (a scratch table). Without the hint the join is a
    shuffled one, whose hot keys adaptive execution splits.
    """
    return F.broadcast(df) if df.count() <= rows else df


def with_default(df: DataFrame, column: str, default: str = "") -> DataFrame:
    return df.withColumn(column, F.coalesce(F.col(column), F.lit(default)))
