"""Page layouts: words with their places, packed and unpacked."""

from __future__ import annotations

import json
import zlib

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

WORD = "struct<i:int,t:string,s:int,e:int,x:double,y:double,w:double,h:double,b:int,l:int,o:int>"


@F.pandas_udf(T.StringType())
def _inflate(blobs: pd.Series) -> pd.Series:
    def one(x):
        try:
            return None if x is None else zlib.decompress(x).decode("utf-8")
        except (zlib.error, UnicodeDecodeError):
            return None

    return pd.Series([one(x) for x in blobs], dtype=object)


def unpack_layout(blob: Column) -> Column:
    """The words of a stored layout; null where it is null or damaged."""
    return F.from_json(_inflate(blob), f"array<{WORD}>")


def pack_layout(words: list[dict]) -> bytes:
    return zlib.compress(json.dumps(words, ensure_ascii=False).encode(), 6)


def layout_of(words: list[dict], width: float, height: float) -> list[dict]:
    """The stored form of words (t, x0, y0, x1, y1 and block, line and order): places in the text of words joined by single spaces, boxes relative to the page to six places."""
    out, at = [], 0
    for i, w in enumerate(words):
        box = {"x": w["x0"] / width, "y": w["y0"] / height, "w": (w["x1"] - w["x0"]) / width, "h": (w["y1"] - w["y0"]) / height}
        out.append({"i": i, "t": w["t"], "s": at, "e": at + len(w["t"])} | {k: round(v, 6) for k, v in box.items()} | {"b": w.get("b", 0), "l": w.get("l", 0), "o": w.get("o", i)})
        at += len(w["t"]) + 1
    return out


def too_little_text(normal_length: int, n_words: int, coverage: float) -> bool:
    """``needs_ocr`` for one page."""
    return normal_length < 50 or (n_words < 10 and coverage >= 0.5)


def word_offsets(words: Column) -> Column:
    """[{t, s, e}] of words that are joined by single spaces: start and end character of each.

    One pass with an accumulator; the running offset is the end of the word before, plus one.
    """
    empty = F.array().cast("array<struct<t:string,s:int,e:int>>")

    def step(done: Column, w: Column) -> Column:
        s = F.when(F.size(done) == 0, F.lit(0)).otherwise(F.try_element_at(done, F.lit(-1))["e"] + 1)
        return F.concat(done, F.array(F.struct(w.alias("t"), s.cast("int").alias("s"), (s + F.length(w)).cast("int").alias("e"))))

    return F.aggregate(words, empty, step)


def relative_box(x0: Column, y0: Column, x1: Column, y1: Column, width: Column, height: Column) -> Column:
    """A box relative to the page, to six places."""
    return F.struct(F.round(x0 / width, 6).alias("x"), F.round(y0 / height, 6).alias("y"), F.round((x1 - x0) / width, 6).alias("w"), F.round((y1 - y0) / height, 6).alias("h"))


def image_coverage(rects: Column, page_area: Column) -> Column:
    """The share of a page that images cover; rects is an array of {x0, y0, x1, y1}."""
    area = F.aggregate(rects, F.lit(0.0), lambda a, r: a + (r["x1"] - r["x0"]) * (r["y1"] - r["y0"]))
    return area / F.greatest(page_area, F.lit(1.0))


def needs_ocr(normal_length: Column, n_words: Column, coverage: Column) -> Column:
    """Whether a page has too little text of its own."""
    return (normal_length < 50) | ((n_words < 10) & (coverage >= 0.5))


def full_ocr(normal_length: Column) -> Column:
    return normal_length < 10
