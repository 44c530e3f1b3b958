"""Result rows: provenance, snippet and highlight boxes, for the few rows that are shown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagequarry.functions.layout import unpack_layout
from pagequarry.functions.text import normalize, normalize_text, words
from pagequarry.session import among, cut


def snippet(ws: Column, start: Column, end: Column) -> Column:
    """Twelve words before the hit to twelve after it, at least fifty from its start."""
    lo = F.greatest(F.lit(0), start - 12)
    hi = F.least(F.size(ws), F.greatest(end, start + 50) + 12)
    return F.array_join(F.slice(ws, lo + 1, F.greatest(F.lit(0), hi - lo)), " ")


def query_terms(query: str) -> list[str]:
    return sorted(set((normalize(query) or "").split()))


def highlights(layout: Column, normal: Column, terms: list[str], start: Column, end: Column) -> Column:
    """Boxes of every word of the page that equals a query term; where there is none, those of the words from start to end."""
    box = lambda w: F.struct(w["x"].alias("x"), w["y"].alias("y"), w["w"].alias("w"), w["h"].alias("h"))
    wanted = F.array(*[F.lit(t) for t in terms]).cast("array<string>")
    pairs = F.arrays_zip(layout.alias("w"), normal.alias("n"))
    hit = F.transform(F.filter(pairs, lambda p: F.array_contains(wanted, p["n"])), lambda p: box(p["w"]))
    rest = F.transform(F.slice(layout, start + 1, F.greatest(F.lit(0), end - start)), box)
    return F.when((F.size(hit) == 0) & (end > start), rest).otherwise(hit)


def normal_words(layout: Column) -> Column:
    """The normalised words of a layout, in its order."""
    return F.split(normalize_text(F.array_join(F.transform(layout, lambda w: F.regexp_replace(w["t"], r"\s+", "")), "\n")), " ")


def hydrate(ranked: DataFrame, pages: DataFrame, documents: DataFrame, query: str) -> DataFrame:
    """The shown rows with document, path, snippet, boxes and warning. ``ranked``: page_id, score, word_start, word_end (null end: up to 60 words), pos."""
    few = cut(ranked)  # one page of results
    page = among(pages, "page_id", few).join(F.broadcast(few), "page_id").dropDuplicates(["page_id"])
    doc = documents.select(F.col("doc_id").alias("document_id"), "title", "path", "error")
    rows = page.join(doc, "document_id")
    ws = words(F.col("text"))
    rows = rows.withColumn("_words", ws).withColumn("_layout", unpack_layout(F.col("layout_json")))
    start = F.coalesce("word_start", F.lit(0))
    end = F.coalesce("word_end", F.least(F.size("_words"), F.lit(60)))
    return rows.select(
        "page_id", "document_id", "title", "path", "page_number", F.round("score", 6).alias("score"),
        snippet(F.col("_words"), start, end).alias("snippet"),
        F.coalesce(highlights(F.col("_layout"), normal_words(F.col("_layout")), query_terms(query), start, end), F.array().cast("array<struct<x:double,y:double,w:double,h:double>>")).alias("highlights"),
        "extraction_method", F.coalesce(F.nullif("warning", F.lit("")), "error").alias("warning"),
        F.format_string("/api/documents/%d/pdf#page=%d", "document_id", "page_number").alias("pdf_url"), "pos",
    )


def title_of_path(path: Column) -> Column:
    """A file's name without its suffix."""
    return F.regexp_extract(path, r"([^/]+?)(\.[^./]*)?$", 1)
