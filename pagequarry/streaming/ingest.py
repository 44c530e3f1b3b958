"""Append-only ingestion as a stream. Rewritten and deleted files need the snapshot comparison of ``operators.incremental``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from pagequarry.operators.chunks import chunk_passages


def new_passages(pages: DataFrame, max_words: int = 260, overlap: int = 40) -> DataFrame:
    """Passages of a stream of pages; stateless, so it holds for streams as for tables."""
    return chunk_passages(pages, max_words, overlap)


def ingest_available(spark: SparkSession, source: str, schema: StructType, target: str, checkpoint: str) -> None:
    """Cuts all page files that are there and were not read before into passages and appends them to ``target``. The checkpoint makes it exactly once."""
    stream = spark.readStream.schema(schema).parquet(source)
    query = new_passages(stream).writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()


def pages_by_day(pages: DataFrame, late: str = "2 days") -> DataFrame:
    """(day, extraction_method, pages): counts by day of loading, for streams with a watermark as for tables."""
    return (
        pages.withWatermark("loaded_at", late)
        .groupBy(F.window("loaded_at", "1 day").alias("w"), "extraction_method")
        .agg(F.count("*").alias("pages"))
        .select(F.col("w.start").alias("day"), "extraction_method", "pages")
    )
