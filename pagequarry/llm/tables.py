"""Tables of fixed size over a whole corpus: each task adds up its own, the parts are added up block by block as they stream in.

Tables travel compressed, to the driver and to the tasks, where a worker opens them once.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from pagequarry.frames import objects
from pagequarry.session import shuffle_partitions

BLOCKS = 64
PART = "block int, part binary"
_open: dict[str, np.ndarray] = {}


def parts_of(table: np.ndarray) -> pd.DataFrame:
    """(block, part) rows of a task's table; blocks without an entry are left out."""
    width = len(table) // BLOCKS
    blocks = [(i, table[i * width : (i + 1) * width]) for i in range(BLOCKS)]
    full = [(i, x) for i, x in blocks if x.any()]
    return objects({"block": [i for i, _ in full], "part": [zlib.compress(x.tobytes(), 1) for _, x in full]})


def added_up(parts: DataFrame, kind: type, add: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> list[bytes | None]:
    """The blocks of all tasks' tables added up, still compressed. A task holds the blocks that it was given once, however many parts there are."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for block, part in zip(b["block"], b["part"]):
                x = np.frombuffer(zlib.decompress(part), kind)
                total[block] = add(total[block], x) if block in total else x
        yield objects({"block": total.keys(), "part": [zlib.compress(x.tobytes(), 1) for x in total.values()]})

    one = parts.repartition(min(BLOCKS, shuffle_partitions(parts.sparkSession)), "block").mapInPandas(run, PART)
    out: list[bytes | None] = [None] * BLOCKS
    for r in one.collect():  # of fixed size
        out[r["block"]] = bytes(r["part"])
    return out


class Shared:
    """A table that tasks read: the broadcast holds its compressed blocks, a worker opens them once."""

    def __init__(self, spark: SparkSession, blocks: list[bytes | None], size: int, kind: type):
        self.blocks, self.size, self.kind = spark.sparkContext.broadcast(blocks), size, kind  # of fixed size
        self.name = uuid.uuid4().hex

    def table(self) -> np.ndarray:
        if self.name not in _open:
            _open.clear()
            _open[self.name] = opened(self.blocks.value, self.size, self.kind)
        return _open[self.name]


def opened(blocks: list[bytes | None], size: int, kind: type) -> np.ndarray:
    out, width = np.zeros(size, kind), size // BLOCKS
    for i, x in enumerate(blocks):
        if x is not None:
            out[i * width : (i + 1) * width] = np.frombuffer(zlib.decompress(x), kind)
    return out
