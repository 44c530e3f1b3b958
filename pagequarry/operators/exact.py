"""Exact search: a literal substring of the normalised text, exhaustive."""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagequarry.frames import records
from pagequarry.functions.text import normalize
from pagequarry.operators.index import PageIndex
from pagequarry.session import among, cut

SHORTEST = 3


def _possible(index: PageIndex | None, pages: DataFrame, needles: list[str]) -> DataFrame:
    """The pages in which a needle can occur, by the stored trigrams; without an index, all."""
    if index is None:
        return pages
    return among(pages, "page_id", cut(index.pages_with({n: [] for n in needles}).select("page_id").distinct()))


def exact_matches(pages: DataFrame, documents: DataFrame, query: str, index: PageIndex | None = None) -> DataFrame:
    """(page_id, document_id, title, page_number, score) of every match in active documents. Needles under three characters match nothing."""
    needle = normalize(query) or ""
    narrow = pages.select("page_id", "document_id", "page_number", "normalized_text")
    found = _possible(index, narrow, [needle]).filter(F.col("normalized_text").contains(needle)) if len(needle) >= SHORTEST else narrow.filter(F.lit(False))
    docs = documents.filter("active").select(F.col("doc_id").alias("document_id"), "title")
    return found.select("page_id", "document_id", "page_number").distinct().join(docs, "document_id").select("page_id", "document_id", "title", "page_number", F.lit(1.0).alias("score"))


def exact_page(pages: DataFrame, documents: DataFrame, query: str, page: int = 1, size: int = 10, index: PageIndex | None = None) -> DataFrame:
    """One page of the matches, by title and page number."""
    return exact_matches(pages, documents, query, index).orderBy("title", "page_number", "page_id").offset((page - 1) * size).limit(size)


def exact_counts(pages: DataFrame, documents: DataFrame, needles: DataFrame, key: str = "term_id", needle: str = "term", most: int = 100_000, shortest: int = SHORTEST) -> DataFrame:
    """(key, total) of a small table of needles, by one automaton in one pass over the pages; needles under three characters and those without a match give no row."""
    rows = needles.select(key, needle).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} needles")
    wanted: dict[str, list] = {}
    for r in rows:
        n = normalize(r[needle]) or ""
        if len(n) >= shortest:
            wanted.setdefault(n, []).append(r[key])
    kind = needles.schema[key].dataType.simpleString()

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        a = ahocorasick.Automaton()
        for n, keys in wanted.items():
            a.add_word(n, keys)
        if wanted:
            a.make_automaton()
        for b in batches:
            found = [(k, p, d) for p, d, x in zip(b["page_id"], b["document_id"], b["normalized_text"]) for k in {k for _, keys in a.iter(x) for k in keys}] if wanted else []
            yield records(found, [key, "page_id", "document_id"])

    active = documents.filter("active and doc_id is not null").select(F.col("doc_id").alias("document_id"))
    some = pages.filter("normalized_text is not null and page_id is not null and document_id is not null").select("page_id", "document_id", "normalized_text")
    found = some.mapInPandas(search, f"{key} {kind}, page_id long, document_id long")
    return found.distinct().join(active, "document_id", "left_semi").groupBy(key).agg(F.count("*").alias("total"))
