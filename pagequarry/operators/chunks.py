"""Overlapping passages of fixed length."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagequarry.functions.text import words


def chunk_passages(pages: DataFrame, max_words: int = 260, overlap: int = 40, key: str = "page_id", text: str = "text") -> DataFrame:
    """(key, ordinal, word_start, word_end, text): windows of at most max_words words; the last one ends with the page. No word, no passage."""
    step = max(1, max_words - overlap)
    w = pages.select(key, words(F.col(text)).alias("w")).withColumn("n", F.size("w")).filter("n > 0")
    more = F.greatest(F.lit(0), F.ceil((F.col("n") - max_words) / step)).cast("int")
    at = w.select(key, "w", "n", F.explode(F.sequence(F.lit(0), more)).alias("ordinal")).withColumn("word_start", F.col("ordinal") * step)
    at = at.withColumn("word_end", F.least(F.col("word_start") + max_words, F.col("n")))
    return at.select(key, "ordinal", "word_start", "word_end", F.array_join(F.slice("w", F.col("word_start") + 1, F.col("word_end") - F.col("word_start")), " ").alias("text"))
