"""Counts of words over a whole corpus."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagequarry.frames import objects

_OUTER = re.compile(r"^[\W_]+|[\W_]+$")


def core(token: str) -> str:
    """A token without the punctuation around it."""
    return _OUTER.sub("", token)


def count_words(df: DataFrame, *columns: str) -> DataFrame:
    """(word, f): occurrences of each word in the columns, its outer punctuation removed. Tasks add up their own words first."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: Counter[str] = Counter()

        def flush() -> pd.DataFrame:
            cores: Counter[str] = Counter()
            for t, n in seen.items():
                if c := t if t.isalpha() else core(t):
                    cores[c] += n
            seen.clear()
            return objects({"word": cores.keys(), "f": cores.values()})

        for b in batches:
            for column in b.columns:
                for x in b[column]:
                    if x:
                        seen.update(x.split())
            if len(seen) > 500_000:
                yield flush()
        yield flush()

    return df.select(*columns).mapInPandas(run, "word string, f long").groupBy("word").agg(F.sum("f").alias("f"))
