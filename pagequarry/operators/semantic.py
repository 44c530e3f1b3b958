"""Dense search: exact inner products, pages by their best passage."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pagequarry.session import among, cut


def usable(vectors: DataFrame, dim: int) -> DataFrame:
    v = F.col("embedding")
    return vectors.filter(v.isNotNull() & (F.size(v) == dim) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x)))


def top_passages(vectors: DataFrame, query: list[float], limit: int = 400, among: DataFrame | None = None) -> DataFrame:
    """(embedding_id, score) of the vectors with the largest inner products; no usable vector, no row. ``among`` restricts them to its embedding_id."""
    v = usable(vectors, len(query))
    if among is not None:
        v = v.join(among.select("embedding_id").distinct(), "embedding_id", "left_semi")
    q = np.array(query, np.float64)

    def best(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """The best of each batch, by one matrix product."""
        for b in batches:
            if len(b):
                s = np.stack(b["embedding"].to_numpy()).astype(np.float64) @ q
                order = np.lexsort((b["embedding_id"].to_numpy(), -np.round(s, 9)))[:limit]
                yield pd.DataFrame({"embedding_id": b["embedding_id"].to_numpy()[order], "score": s[order]})

    v = v.filter("embedding_id is not null").select("embedding_id", F.col("embedding").cast("array<float>").alias("embedding"))
    return v.mapInPandas(best, "embedding_id long, score double").orderBy(F.desc(F.round("score", 9)), "embedding_id").limit(limit)


def add_vectors(stored: DataFrame, new: DataFrame, dim: int | None) -> DataFrame:
    """stored and new vectors together. An empty addition changes nothing; another dimension than ``dim`` is an error when rows are computed."""
    if dim is None:
        return stored.unionByName(new)
    right = F.when(F.size("embedding") == dim, F.col("embedding")).otherwise(F.raise_error(F.lit(f"vector dimension is not {dim}")).cast("array<float>"))
    return stored.unionByName(new.withColumn("embedding", right))


def semantic_pages(vectors: DataFrame, passages: DataFrame, pages: DataFrame, documents: DataFrame, query: list[float], limit: int = 200, prefilter: bool = False) -> DataFrame:
    """(page_id, score, passage, word_start, word_end): pages by their best passage.

    The top 2 * limit vectors are taken first and inactive passages and documents left out after that, which may shrink the result;
    ``prefilter`` takes them from active passages only.
    """
    alive = passages.filter("active and embedding_id is not null")
    hits = cut(top_passages(vectors, query, 2 * limit, alive if prefilter else None))
    p = among(alive, "embedding_id", hits).select("passage_id", "page_id", "embedding_id", F.col("text").alias("passage"), "word_start", "word_end")
    near = F.broadcast(hits).join(p, "embedding_id").dropDuplicates(["passage_id"])  # at most 2 * limit hits
    near = cut(near)
    owner = among(pages.select("page_id", "document_id"), "page_id", near).join(F.broadcast(near), "page_id").dropDuplicates(["passage_id"])
    active = documents.filter("active").select(F.col("doc_id").alias("document_id"))
    live = owner.join(active, "document_id", "left_semi")
    first = F.row_number().over(W.partitionBy("page_id").orderBy(F.desc(F.round("score", 9)), "embedding_id"))
    best = live.withColumn("_n", first).filter("_n = 1").select("page_id", "score", "passage", "word_start", "word_end")
    return best.orderBy(F.desc(F.round("score", 9)), "page_id").limit(limit)


def coverage(passages: DataFrame) -> DataFrame:
    """(total, embedded, ready) of the active passages, each counted once."""
    one = passages.filter("active").groupBy("passage_id").agg(F.max("embedding_id").alias("embedding_id"))
    c = one.agg(F.count("*").alias("total"), F.count("embedding_id").alias("embedded"))
    return c.withColumn("ready", (F.col("total") > 0) & (F.col("total") == F.col("embedded")))


def coverage_error(total: int, embedded: int) -> str | None:
    """Why there is no semantic result, if the index is incomplete."""
    return f"Semantic index is being built ({embedded} of {total} passages ready)." if total and embedded < total else None
