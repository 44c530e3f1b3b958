"""Problem 8: items of varying length into containers of fixed capacity.

Method: bound-certified repacking. Items go to partitions by hash; each partition packs its items by
best-fit decreasing and certifies its number of containers by a lower bound from dual-feasible
functions. Partitions whose count exceeds the bound give up the documents of their loose containers;
these are exchanged: they are spread anew over as many partitions as they need, and packed again, for ``rounds`` rounds. Only ids
and sizes move; a partition holds about ``per_partition`` items whatever the input. ``certificate`` holds the result against a bound for all items together.

Defined results: null and empty texts have size 0 and go into container null with piece 0, as they
need no room; a text over the capacity is divided into full pieces and a rest, all others stay whole; repeated
keys and null ones are packed as separate items; an empty table gives an empty table.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagequarry.llm.encoding import VOCABULARY, count_tokens
from pagequarry.session import cut


def best_fit_decreasing(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Container number of each item. ``rooms`` holds the distinct free rooms, at most ``capacity`` of them."""
    out = np.empty(len(sizes), dtype=np.int64)
    rooms: list[int] = []
    open_: dict[int, list[int]] = {}
    n = 0
    for i in np.argsort(-sizes, kind="stable"):
        s = int(sizes[i])
        k = bisect_left(rooms, s)
        if k == len(rooms):
            c, room, n = n, capacity, n + 1
        else:
            room = rooms[k]
            c = open_[room].pop()
            if not open_[room]:
                del open_[room]
                rooms.pop(k)
        out[i] = c
        left = room - s
        if left:
            if left not in open_:
                open_[left] = []
                insort(rooms, left)
            open_[left].append(c)
    return out


def lower_bound(sizes: np.ndarray, capacity: int) -> int:
    return bound_of_counts(np.bincount(sizes, minlength=capacity + 1), capacity) if len(sizes) else 0


def bound_of_counts(counts: np.ndarray, capacity: int) -> int:
    """Containers that any packing of ``counts[s]`` items of each size s needs: the best of the plain sum and of the step functions with threshold e.

    For 0 < e <= capacity / 2 the function maps sizes over capacity - e to the capacity, sizes under e to 0
    and keeps the others; it is dual feasible, so the mapped sum over the capacity bounds the count.
    """
    h = counts[: capacity + 1].astype(np.int64)
    x = np.arange(capacity + 1)
    count, total = np.cumsum(h), np.cumsum(h * x)
    e = np.arange(1, capacity // 2 + 1)
    large = count[-1] - count[capacity - e]
    middle = total[capacity - e] - total[e - 1]
    best = max(int(total[-1]), int((large * capacity + middle).max()) if len(e) else 0)
    return -(-best // capacity)


def _pack(pdf: pd.DataFrame, capacity: int, slack: int) -> pd.DataFrame:
    """One partition: packs, certifies, and marks as loose the items of containers with over ``slack`` room if there is a gap."""
    sizes = pdf["size"].to_numpy(np.int64)
    c = best_fit_decreasing(sizes, capacity)
    n = int(c.max()) + 1 if len(c) else 0
    fill = np.bincount(c, weights=sizes, minlength=n)
    gap = n - lower_bound(sizes, capacity)
    loose = (capacity - fill[c] > slack) if gap > 0 else np.zeros(len(c), bool)
    return pdf.assign(container=c, loose=loose)


def pack_sizes(items: DataFrame, capacity: int, per_partition: int = 5_000, rounds: int = 2, slack_share: float = 0.002) -> DataFrame:
    """items: (key, piece int, size int). Adds ``container``, a string that is unique over all rounds."""
    key = items.columns[0]
    kind = items.schema[key].dataType.simpleString()
    slack = int(capacity * slack_share)
    schema = f"{key} string, piece int, size int, part long, container long, loose boolean"
    left, done = items.withColumn(key, F.col(key).cast("string")), None  # pandas would make whole numbers with nulls floats
    for r in range(rounds + 1):
        parts = max(1, -(-left.count() // per_partition))
        # repeated keys are told apart by nothing, so that they may share a partition; that does no harm
        placed = left.withColumn("part", F.pmod(F.xxhash64(key, "piece", F.lit(r)), F.lit(parts)))
        packed = cut(placed.groupBy("part").applyInPandas(lambda pdf: _pack(pdf, capacity, slack), schema))
        last = r == rounds
        kept = packed if last else packed.filter(~F.col("loose"))
        kept = kept.select(key, "piece", "size", F.concat_ws("-", F.lit(r), "part", "container").alias("container"))
        done = kept if done is None else done.unionByName(kept)
        left = packed.filter("loose").select(key, "piece", "size")
    return done.withColumn(key, F.col(key).cast(kind))


def certificate(packed: DataFrame, capacity: int = 2048, size: str = "n_tokens") -> DataFrame:
    """(containers, bound): how many containers were filled, and how many any packing of the same pieces needs. One row."""
    rows = packed.filter(F.col("container").isNotNull())
    counts = np.zeros(capacity + 1, np.int64)
    for r in rows.groupBy(size).agg(F.count("*").alias("n")).collect():  # at most one row a size
        counts[r[size]] = r["n"]
    return rows.agg(F.count_distinct("container").alias("containers")).withColumn("bound", F.lit(bound_of_counts(counts, capacity)).cast("long"))


def pack_documents(df: DataFrame, key: str = "doc_id", text: str = "text", capacity: int = 2048, path: str = VOCABULARY, **options) -> DataFrame:
    """(key, piece, token_start, n_tokens, container) of each document, or of each piece of one over the capacity."""
    sizes = count_tokens(df, key, text, path)
    pieces = F.greatest(F.lit(1), F.ceil(F.col("n_tokens") / capacity)).cast("int")
    items = cut(
        sizes.select(key, "n_tokens", F.explode(F.sequence(F.lit(0), pieces - 1)).alias("piece")).select(
            key, "piece", F.least(F.lit(capacity), F.col("n_tokens") - F.col("piece") * capacity).cast("int").alias("size")
        )
    )
    packed = pack_sizes(items.filter("size > 0"), capacity, **options)
    empty = items.filter("size = 0").withColumn("container", F.lit(None).cast("string"))
    return packed.unionByName(empty).select(key, "piece", (F.col("piece") * capacity).cast("long").alias("token_start"), F.col("size").alias("n_tokens"), "container")
