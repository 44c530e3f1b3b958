"""Fusion of ranked lists, reranking and the blended score."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pagequarry.functions.models import Reranker, rerank_column
from pagequarry.functions.scores import rrf_term, sigmoid
from pagequarry.session import among, cut


def ranked(df: DataFrame, name: str) -> DataFrame:
    """The rows with their rank from 1. For lists that a limit has made small: the window has one partition."""
    return df.withColumn(name, F.row_number().over(W.orderBy(F.desc(F.round("score", 9)), "page_id")))


def rrf(lexical: DataFrame, semantic: DataFrame, limit: int = 40) -> DataFrame:
    """(page_id, lex_rank, sem_rank, rrf, passage, word_start, word_end, fused_rank): reciprocal ranks with k = 60 and equal weights.

    Lexical hits carry no passage; the semantic one supplies it. Ties keep the order of first appearance: the lexical list, then the semantic one.
    """
    l = ranked(lexical, "lex_rank").select("page_id", "lex_rank")  # noqa: E741
    s = ranked(semantic, "sem_rank").select("page_id", "sem_rank", "passage", "word_start", "word_end")
    both = l.join(s, "page_id", "full_outer").withColumn("rrf", rrf_term(F.col("lex_rank")) + rrf_term(F.col("sem_rank")))
    order = [F.desc(F.round("rrf", 12)), F.asc_nulls_last("lex_rank"), F.asc_nulls_last("sem_rank")]
    top = both.orderBy(*order).limit(limit)
    return top.withColumn("fused_rank", F.row_number().over(W.orderBy(*order))).select(
        "page_id", "lex_rank", "sem_rank", "rrf", "passage", F.coalesce("word_start", F.lit(0)).alias("word_start"), F.coalesce("word_end", F.lit(0)).alias("word_end"), "fused_rank"
    )


def with_rerank_text(candidates: DataFrame, pages: DataFrame) -> DataFrame:
    """Adds ``rerank_text``: the passage, or the page's text where it is null or empty, or ''. The candidates are few; only the texts of theirs without a passage are read."""
    candidates = cut(candidates)
    bare = candidates.filter(F.coalesce("passage", F.lit("")) == "")
    texts = among(pages.select("page_id", "text"), "page_id", bare).groupBy("page_id").agg(F.max("text").alias("_text"))
    return candidates.join(texts, "page_id", "left").withColumn("rerank_text", F.coalesce(F.nullif("passage", F.lit("")), "_text", F.lit(""))).drop("_text")


def blend(candidates: DataFrame, reranker: Reranker | None, query: str) -> DataFrame:
    """Adds ``score``, three quarters from the reranker's logit and one quarter from the fused rank, and sorts by it. Without a reranker all logits are 0."""
    logit = F.lit(0.0) if reranker is None else rerank_column(reranker, query, F.col("rerank_text"))
    most = F.max("rrf").over(W.partitionBy())
    share = F.col("rrf") / F.when(most == 0, F.lit(1.0)).otherwise(most)
    out = candidates.withColumn("logit", logit).withColumn("score", 0.75 * sigmoid(F.col("logit")) + 0.25 * share)
    return out.orderBy(F.desc(F.round("score", 9)), "fused_rank")
