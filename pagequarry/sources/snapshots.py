"""Tables as whole snapshots on any file system that Spark reaches.

A commit writes new directories for the tables that it changes and then one small file with the versions of all. Readers take the newest such file, so that
they see all tables of a commit or none of them.
"""

from __future__ import annotations

import json
import time

from pyspark.sql import DataFrame, SparkSession


def publish(spark: SparkSession, folder: str, version: int, value: dict) -> None:
    """Makes ``value`` the newest entry of ``folder``; Spark's commit moves it to its place whole. An entry of the same version is an error."""
    spark.createDataFrame([(json.dumps(value | {"version": version}),)], "value string").coalesce(1).write.text(f"{folder}/{version:06d}")


def newest(spark: SparkSession, folder: str) -> dict | None:
    try:
        rows = spark.read.text(f"{folder}/*").collect()  # one row a version
    except Exception as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return None
    return max((json.loads(r["value"]) for r in rows), key=lambda v: v["version"], default=None)


def save(folder: str, **tables: DataFrame) -> int:
    """Writes the given tables and makes them current together; the others stay as they are. Two writers of one version: the second fails."""
    spark = next(iter(tables.values())).sparkSession
    last = newest(spark, f"{folder}/_commits") or {"version": 0, "tables": {}}
    stamp, current = time.time_ns(), dict(last["tables"])
    for name, df in tables.items():
        current[name] = f"{name}-{stamp}"
        df.write.parquet(f"{folder}/{current[name]}")
    publish(spark, f"{folder}/_commits", last["version"] + 1, {"tables": current})
    return last["version"] + 1


def stored(spark: SparkSession, folder: str) -> set[str]:
    return set((newest(spark, f"{folder}/_commits") or {"tables": {}})["tables"])


def load(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{(newest(spark, f'{folder}/_commits') or {'tables': {}})['tables'][name]}")
