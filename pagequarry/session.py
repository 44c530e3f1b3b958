"""Session helpers shared by the operators."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def checkpoint_folder(spark: SparkSession) -> str:
    """This application's folder on the storage that the cluster names in ``spark.checkpoint.dir``.

    Only a local master, where driver and tasks are one process, gets a folder of its own where none is named (tests).
    """
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
        if not folder:
            if not sc.master.startswith("local[") and sc.master != "local":
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="pagequarry-")
        sc.setCheckpointDir(folder)
    return sc._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """``df``, computed once and written to the shared checkpoint folder; survives lost executors."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def partitions_for(spark: SparkSession, rows: int, each: int) -> int:
    """Partitions for ``rows`` of which a task takes about ``each``: they grow with the data, but are no fewer than the session's shuffle partitions."""
    return max(shuffle_partitions(spark), -(-rows // each))


def broadcast_if_small(df: DataFrame, most_rows: int = 200_000) -> DataFrame:
    """``df`` (a checkpoint or another cheap plan of narrow rows), marked for broadcast only if it has at most ``most_rows``; else Spark shuffles it."""
    return F.broadcast(df) if df.limit(most_rows + 1).count() <= most_rows else df


def smallest_hashes(df: DataFrame, key: str, want: int, n: int) -> DataFrame:
    """A uniform sample of ``want`` of the ``n`` rows of ``df``: those whose keys have the smallest hashes. Rows far beyond are left out first, so that few reach the one task that sorts."""
    share = min(1.0, 3.0 * max(want, 100) / max(1, n))
    h = F.xxhash64(key)
    near = df if share >= 1 else df.filter(h <= F.lit(int(-(2**63) + 2**64 * share)))
    return near.orderBy(h, key).limit(want)


def among(df: DataFrame, column: str, keys: DataFrame, most: int = 1_000) -> DataFrame:
    """The rows of a stored table whose ``column`` is one of ``keys`` (a checkpoint). Up to ``most`` keys are named in the filter, which reaches the files' statistics; more are joined."""
    wanted = keys.select(column).filter(F.col(column).isNotNull()).distinct()
    few = wanted.limit(most + 1).collect()
    if len(few) <= most:
        return df.filter(F.col(column).isin([r[0] for r in few]))
    return df.join(broadcast_if_small(wanted), column, "left_semi")


def ship_package(spark: SparkSession) -> None:
    """Hands this package to the executors, once for each Spark context; they need no copy of their own."""
    sc = spark.sparkContext
    if getattr(sc, "_pagequarry_shipped", False):
        return
    package = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="pagequarry-"), "pagequarry.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(package):
            for n in sorted(names):
                if n.endswith(".py"):
                    whole = os.path.join(folder, n)
                    z.write(whole, os.path.join("pagequarry", os.path.relpath(whole, package)))
    sc.addPyFile(path)  # the driver serves it; executors read nothing from the driver's folders
    sc._pagequarry_shipped = True
