"""The evidence tables as Parquet, one path per table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """Table ``name`` of ``folder``; a file or a directory of part files."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def latest(df: DataFrame, key: str, by: str = "loaded_at") -> DataFrame:
    """One row for each ``key``: the last delivery. Rows of null key are kept apart from none.

    max_by over a struct keeps the aggregation partial on the map side; ties on ``by`` are
    resolved by Spark's ordering of the whole struct, which makes the choice irrelevant for
    deliveries that are equal in all else.
    """
    others = [c for c in df.columns if c != key]
    if by in df.columns:
        return df.groupBy(key).agg(F.max_by(F.struct(*others), by).alias("_row")).select(key, "_row.*")
    return df.dropDuplicates([key])
