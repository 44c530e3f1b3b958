"""Incremental maintenance as snapshots: change detection, tombstones, replacement, backfill."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagequarry.functions.models import Embedder, embed


def classify_changes(existing: DataFrame, discovered: DataFrame) -> DataFrame:
    """(path, doc_id, change): new, changed, unchanged, gone (active but not discovered) or absent (already withdrawn and not discovered).

    A known file is unchanged if its size and mtime are equal and it is indexed; comparisons are null-safe. Paths found twice count once.
    """
    e = existing.select("path", "doc_id", F.col("size").alias("_size"), F.col("mtime_ns").alias("_mtime"), "state", "active")
    d = discovered.select("path", "size", "mtime_ns").dropDuplicates(["path"]).withColumn("_found", F.lit(True))
    same = F.col("size").eqNullSafe(F.col("_size")) & F.col("mtime_ns").eqNullSafe(F.col("_mtime")) & (F.col("state") == "indexed")
    change = (
        F.when(F.col("_found").isNull(), F.when(F.col("active"), "gone").otherwise("absent"))
        .when(F.col("doc_id").isNull(), "new")
        .when(F.coalesce(same, F.lit(False)), "unchanged")
        .otherwise("changed")
    )
    return d.join(e, "path", "full_outer").select("path", "doc_id", change.alias("change"))


def tombstone(documents: DataFrame, passages: DataFrame, pages: DataFrame, changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Documents and passages with their new flags: gone documents are withdrawn, found ones active again, with their passages."""
    flag = changes.filter("doc_id is not null").select("doc_id", F.col("change").isin("unchanged", "changed").alias("_alive")).dropDuplicates(["doc_id"])
    docs = documents.join(flag, "doc_id", "left").withColumn("active", F.coalesce("_alive", "active")).drop("_alive")
    owner = pages.select("page_id", F.col("document_id").alias("doc_id")).dropDuplicates(["page_id"]).join(flag, "doc_id").select("page_id", "_alive")
    parts = passages.join(owner, "page_id", "left").withColumn("active", F.coalesce("_alive", "active")).drop("_alive")
    return docs, parts.select(*passages.columns)


def replace_children(children: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """The children of replaced parents left out, the new ones added: what a cascading delete and an insert do."""
    return children.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def missing_passages(passages: DataFrame, vectors: DataFrame) -> DataFrame:
    """(passage_id, page_id): active passages without an embedding id, or whose id has no stored vector."""
    have = vectors.filter("embedding is not null").select("embedding_id").distinct()
    return passages.filter("active").join(have, "embedding_id", "left_anti").select("passage_id", "page_id").distinct()


def missing_documents(passages: DataFrame, pages: DataFrame, documents: DataFrame, vectors: DataFrame) -> DataFrame:
    """(doc_id, missing) of active documents that have such passages."""
    m = missing_passages(passages, vectors)
    per_page = m.groupBy("page_id").agg(F.count("*").alias("missing"))
    owner = pages.select("page_id", "document_id").distinct()
    active = documents.filter("active").select(F.col("doc_id").alias("document_id"))
    return per_page.join(owner, "page_id").join(active, "document_id", "left_semi").groupBy(F.col("document_id").alias("doc_id")).agg(F.sum("missing").alias("missing"))


def backfill(passages: DataFrame, vectors: DataFrame, embedder: Embedder) -> DataFrame:
    """(embedding_id, embedding, error) of the passages that lack a vector; the passage's id becomes its embedding id."""
    todo = passages.select("passage_id", "text").join(missing_passages(passages, vectors).select("passage_id"), "passage_id", "left_semi").dropDuplicates(["passage_id"])
    return embed(todo, embedder, "passage_id", "text", batch=128).withColumnRenamed("passage_id", "embedding_id")


def requeue_failed_ocr(documents: DataFrame, pages: DataFrame) -> DataFrame:
    """(doc_id, state): documents with a page whose OCR was unavailable go back to pending."""
    failed = pages.filter(F.col("warning").ilike("OCR unavailable:%")).select(F.col("document_id").alias("doc_id")).distinct().withColumn("_failed", F.lit(True))
    return documents.select("doc_id", "state").join(failed, "doc_id", "left").select("doc_id", F.when(F.col("_failed"), "pending").otherwise(F.col("state")).alias("state"))


def document(documents: DataFrame, doc_id: int) -> DataFrame:
    """The document of an id; there being none is an error."""
    found = documents.filter(F.col("doc_id") == doc_id)
    if found.isEmpty():
        raise LookupError(f"no document {doc_id}")
    return found


def job_counters(outcomes: DataFrame) -> DataFrame:
    """(processed, indexed, failed) of per-file outcomes in a column ``outcome``: indexed, unchanged or failed."""
    return outcomes.agg(F.count("*").alias("processed"), F.count_if(F.col("outcome") == "indexed").alias("indexed"), F.count_if(F.col("outcome") == "failed").alias("failed"))


def stamp_scan(roots: DataFrame) -> DataFrame:
    return roots.withColumn("last_scanned_at", F.current_timestamp())
