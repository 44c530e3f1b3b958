"""The list of source roots: listing, adding, removing."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class SourceError(ValueError):
    def __init__(self, status: int, message: str):
        super().__init__(message)
        self.status = status


def listed(roots: DataFrame) -> DataFrame:
    return roots.orderBy("path")


def added(roots: DataFrame, path: str) -> DataFrame:
    """``roots`` with one more; it must be a directory that is not listed yet."""
    whole = os.path.realpath(path)
    if not os.path.isdir(whole):
        raise SourceError(400, f"{path} is not a directory")
    if not roots.filter(F.col("path") == whole).isEmpty():
        raise SourceError(409, f"{path} is listed already")
    new = roots.agg((F.coalesce(F.max("root_id"), F.lit(0)) + 1).alias("root_id")).select("root_id", F.lit(whole).alias("path"), F.current_timestamp().alias("created_at"))
    return roots.unionByName(new, allowMissingColumns=True)


def removed(roots: DataFrame, root_id: int) -> DataFrame:
    """``roots`` without one. Its documents are withdrawn by the next scan, not here."""
    if roots.filter(F.col("root_id") == root_id).isEmpty():
        raise SourceError(404, f"no source {root_id}")
    return roots.filter(F.col("root_id") != root_id)
