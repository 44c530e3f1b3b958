"""The scan of the source roots as one operation on stored snapshots: discover, compare, extract, cut, embed, withdraw, count."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagequarry.functions.models import Embedder, embed
from pagequarry.operators import incremental
from pagequarry.operators.chunks import chunk_passages
from pagequarry.session import cut, partitions_for
from pagequarry.sources import files, snapshots

SCHEMAS = {
    "documents": "doc_id long, path string, title string, size long, mtime_ns long, sha256 string, page_count int, state string, error string, indexed_at timestamp, active boolean",
    "pages": "page_id long, document_id long, page_number int, text string, normalized_text string, width double, height double, extraction_method string, layout_json binary, warning string, loaded_at timestamp",
    "passages": "passage_id long, page_id long, ordinal int, text string, word_start int, word_end int, embedding_id long, active boolean, loaded_at timestamp",
    "passage_vectors": "embedding_id long, embedding array<float>",
    "source_roots": "root_id long, path string, created_at timestamp, last_scanned_at timestamp",
    "index_jobs": "job_id long, state string, total_files long, processed_files long, indexed_files long, failed_files long, error string, created_at timestamp, finished_at timestamp",
}
BUSY = "another scan is running"


class Cancelled(Exception):
    pass


def stored_tables(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The current snapshot of every table; those never written are empty."""
    have = snapshots.stored(spark, folder)
    return {n: snapshots.load(spark, folder, n) if n in have else spark.createDataFrame([], s) for n, s in SCHEMAS.items()}


def _id(*parts: str) -> F.Column:
    """An id that a path, or a page of it, has in every scan."""
    return F.shiftrightunsigned(F.xxhash64(*parts), 1)


def scan(spark: SparkSession, folder: str, extractor, embedder: Embedder | None = None, ocr: Callable | None = None, force: bool = False, cancelled: Callable[[], bool] = lambda: False, pattern: str = "*.pdf") -> dict:
    """Brings the tables in ``folder`` up to date with the files under its source roots; gives the job's row.

    Unchanged files are left alone (``force`` reads them again); those that lack vectors are embedded, and count as indexed then. A file that fails has state ``failed`` and keeps its
    old pages; a failing embedder leaves a document indexed, with the error. Files that are gone are withdrawn. One scan runs at a time: a second one ends at once as failed. ``cancelled`` is asked between
    the stages; nothing of a cancelled or failed scan is stored but its job. All tables change in one commit.
    """
    t = stored_tables(spark, folder)
    jobs = t["index_jobs"]
    job_id = (jobs.agg(F.max("job_id")).first()[0] or 0) + 1
    busy = not jobs.filter("state = 'running'").isEmpty()

    def job(state: str, error: str | None = None, total: int = 0, processed: int = 0, indexed: int = 0, failed: int = 0) -> DataFrame:
        row = spark.createDataFrame([(job_id, state, total, processed, indexed, failed, error)], "job_id long, state string, total_files long, processed_files long, indexed_files long, failed_files long, error string")
        others = jobs.filter(F.col("job_id") != job_id)
        return others.unionByName(row.withColumn("created_at", F.current_timestamp()).withColumn("finished_at", F.when(F.lit(state != "running"), F.current_timestamp())))

    def end(table: DataFrame, **more: DataFrame) -> dict:
        snapshots.save(folder, index_jobs=table, **more)
        return snapshots.load(spark, folder, "index_jobs").filter(F.col("job_id") == job_id).first().asDict()

    if busy:
        return end(job("failed", BUSY))
    end(job("running"))
    try:
        changed, counts = _scanned(spark, t, extractor, embedder, ocr, force, cancelled, pattern)
    except Cancelled:
        return end(job("cancelled"))
    except Exception as error:
        end(job("failed", str(error)[:2_000]))
        raise
    return end(job("completed", **counts), **changed)


def _scanned(spark, t, extractor, embedder, ocr, force, cancelled, pattern) -> tuple[dict[str, DataFrame], dict[str, int]]:
    def ask() -> None:
        if cancelled():
            raise Cancelled

    now = F.current_timestamp()
    docs = t["documents"]
    ask()
    found = cut(files.discover(spark, [r["path"] for r in t["source_roots"].select("path").collect()], pattern))  # a short list of roots
    changes = incremental.classify_changes(docs, found)
    if force:
        changes = changes.withColumn("change", F.when(F.col("change") == "unchanged", "changed").otherwise(F.col("change")))
    changes = cut(changes)
    ask()
    todo = cut(changes.filter("change in ('new', 'changed')").join(found, "path").select("path", "size", "mtime_ns", F.coalesce("doc_id", _id("path")).alias("doc_id")))
    read = files.contents(todo.repartition(partitions_for(spark, todo.count(), 16)))
    got = cut(files.extract(read, extractor, ocr).join(todo.select("path", "doc_id"), "path"))
    ask()
    good = got.filter("error is null")
    new_pages = cut(good.select(_id("path", "page_number").alias("page_id"), F.col("doc_id").alias("document_id"), "page_number", "text", "normalized_text", "width", "height", "extraction_method", "layout_json", "warning", now.alias("loaded_at")))
    new_parts = chunk_passages(new_pages).select(_id("page_id", "ordinal").alias("passage_id"), "page_id", "ordinal", "text", "word_start", "word_end")
    done = good.select("doc_id").distinct()
    old_pages = t["pages"].join(done.withColumnRenamed("doc_id", "document_id"), "document_id", "left_anti").select(*new_pages.columns)
    gone_pages = t["pages"].join(done.withColumnRenamed("doc_id", "document_id"), "document_id", "left_semi").select("page_id").distinct()
    parts = t["passages"].join(gone_pages, "page_id", "left_anti").unionByName(new_parts.withColumn("active", F.lit(True)).withColumn("embedding_id", F.lit(None).cast("long")).withColumn("loaded_at", now))
    pages = old_pages.unionByName(new_pages)
    # documents as they are now
    per_file = got.groupBy("doc_id").agg(F.max("error").alias("_error"), F.count("page_number").cast("int").alias("_pages"), F.max("sha256").alias("_sha"))
    fresh = todo.join(per_file, "doc_id").withColumnRenamed("size", "_size").withColumnRenamed("mtime_ns", "_mtime").withColumnRenamed("path", "_path")
    merged = docs.join(fresh, "doc_id", "full_outer")
    ok, seen = F.col("_path").isNotNull() & F.col("_error").isNull(), F.col("_path").isNotNull()
    new_docs = merged.select(
        "doc_id", F.coalesce("path", "_path").alias("path"), F.coalesce("title", F.regexp_extract("_path", r"([^/]+?)(\.[^./]*)?$", 1)).alias("title"),
        F.when(seen, F.col("_size")).otherwise(F.col("size")).alias("size"), F.when(seen, F.col("_mtime")).otherwise(F.col("mtime_ns")).alias("mtime_ns"),
        F.when(ok, F.col("_sha")).otherwise(F.col("sha256")).alias("sha256"), F.when(ok, F.col("_pages")).otherwise(F.coalesce("page_count", F.lit(0))).alias("page_count"),
        F.when(ok, "indexed").when(seen, "failed").otherwise(F.col("state")).alias("state"), F.when(ok, None).when(seen, F.col("_error")).otherwise(F.col("error")).alias("error"),
        F.when(ok, now).otherwise(F.col("indexed_at")).alias("indexed_at"), F.coalesce("active", F.lit(True)).alias("active"),
    )
    new_docs, parts = incremental.tombstone(new_docs, parts, pages, changes.unionByName(todo.select("path", "doc_id", F.lit("changed").alias("change"))).filter("doc_id is not null"))
    new_docs, parts = cut(new_docs), cut(parts)
    vectors = t["passage_vectors"].join(parts.select("embedding_id").distinct(), "embedding_id", "left_semi")
    repaired = spark.createDataFrame([], "doc_id long, error string")
    if embedder is not None:
        ask()
        made = cut(incremental.backfill(parts, vectors, embedder))
        owner = parts.select("passage_id", "page_id").join(pages.select("page_id", F.col("document_id").alias("doc_id")), "page_id").select(F.col("passage_id").alias("embedding_id"), "doc_id").distinct()
        repaired = cut(made.join(owner, "embedding_id").groupBy("doc_id").agg(F.max("error").alias("error")))
        whole = made.filter("error is null").select("embedding_id", "embedding")
        vectors = vectors.join(whole.select("embedding_id"), "embedding_id", "left_anti").unionByName(whole)
        parts = parts.join(whole.select(F.col("embedding_id").alias("passage_id"), F.lit(True).alias("_new")), "passage_id", "left").withColumn("embedding_id", F.when(F.col("_new"), F.col("passage_id")).otherwise(F.col("embedding_id"))).drop("_new")
        new_docs = new_docs.join(repaired.withColumnRenamed("error", "_error").withColumn("_asked", F.lit(True)), "doc_id", "left").withColumn("error", F.when(F.col("_asked") & (F.col("state") == "indexed"), F.col("_error")).otherwise(F.col("error"))).drop("_error", "_asked")
    ask()
    # outcomes: read files, and unchanged ones, which count as indexed if vectors were added to them
    filled = repaired.filter("error is null").select("doc_id", F.lit(True).alias("_filled"))
    read_now = new_docs.join(todo.select("doc_id"), "doc_id", "left_semi").select("doc_id", F.col("state").alias("outcome"))
    kept = changes.filter("change = 'unchanged'").join(filled, "doc_id", "left").select("doc_id", F.when(F.col("_filled"), "indexed").otherwise("unchanged").alias("outcome"))
    c = incremental.job_counters(read_now.unionByName(kept)).first()
    roots = incremental.stamp_scan(t["source_roots"])
    return {"documents": new_docs, "pages": pages, "passages": parts, "passage_vectors": vectors, "source_roots": roots}, {"total": found.count(), "processed": c["processed"], "indexed": c["indexed"], "failed": c["failed"]}
