"""Small helpers for data frames inside tasks."""

from __future__ import annotations

import pandas as pd


def objects(columns: dict) -> pd.DataFrame:
    """A frame of object columns, whose empty columns Arrow also takes for the declared type."""
    return pd.DataFrame({k: pd.Series(list(v), dtype=object) for k, v in columns.items()})


def records(rows: list[tuple], names: list[str]) -> pd.DataFrame:
    return objects({n: [r[i] for r in rows] for i, n in enumerate(names)})
