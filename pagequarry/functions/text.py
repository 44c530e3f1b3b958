"""Text functions: normalisation, index terms, words."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_SPACE = re.compile(r"\s+")


def normalize(value: str | None) -> str | None:
    """NFKC, case-folded, runs of white space as one space, none at the ends. Null stays null."""
    if value is None:
        return None
    return _SPACE.sub(" ", unicodedata.normalize("NFKC", value).casefold()).strip()


@F.pandas_udf(T.StringType())
def normalize_text(values: pd.Series) -> pd.Series:
    """``normalize`` for a column; Spark has no built-in for NFKC or case folding."""
    return values.map(normalize, na_action="ignore").astype(object).where(values.notna(), None)


def _accents() -> tuple[str, str]:
    """Small Latin letters with marks, and their letters; made from the Unicode decompositions."""
    pairs = []
    for c in map(chr, [*range(0xDF, 0x250), *range(0x1E00, 0x1F00)]):
        base = unicodedata.normalize("NFD", c)
        if len(base) > 1 and base[0].isascii() and base[0].islower():
            pairs.append((c, base[0]))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


ACCENTED, PLAIN = _accents()
MARKS = r"[\u0300-\u036f]"
TERM = r"[\p{L}\p{N}]+"


def fold(text: Column) -> Column:
    """Lower case without the marks of Latin letters: the form in which terms are indexed. Other scripts keep their marks."""
    return F.translate(F.regexp_replace(F.lower(text), MARKS, ""), ACCENTED, PLAIN)


def terms(text: Column) -> Column:
    """The index terms of a text: runs of letters and digits of its folded form. Null gives an empty array."""
    return F.coalesce(F.regexp_extract_all(fold(text), F.lit(TERM), F.lit(0)), F.array().cast("array<string>"))


def fold_query(query: str) -> str:
    plain = re.sub(MARKS, "", query.lower())
    return plain.translate(str.maketrans(ACCENTED, PLAIN))


def query_tokens(query: str) -> list[list[str]]:
    """The query's tokens, all of which must match; an underscore within one makes it a phrase of several index terms."""
    out = []
    for token in re.findall(r"\w+", query):
        phrase = [t for t in re.split(r"[\W_]+", fold_query(token)) if t]
        if phrase:
            out.append(phrase)
    return out


def words(text: Column) -> Column:
    """The maximal runs of characters without space and line feed, in order. Null gives an empty array."""
    return F.coalesce(F.filter(F.split(text, "[ \n]+"), lambda w: w != ""), F.array().cast("array<string>"))
