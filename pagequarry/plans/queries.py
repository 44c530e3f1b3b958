"""The registered queries of the retrieval engine, each over its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pagequarry.functions import layout, scores
from pagequarry.functions import text as tx
from pagequarry.functions.models import HashEmbedder, OverlapReranker, PerWorker, embed
from pagequarry.operators import chunks, exact, fusion, incremental, lexical, results, semantic
from pagequarry.operators.index import PageIndex, index_of
from pagequarry.plans import sql
from pagequarry.sources.tables import latest, table

#: the query strings of the single-query runs; sql.py has the same ones
SINGLE, BOTH, MARKED, NEEDLE = sql.SINGLE, sql.BOTH, sql.MARKED, sql.NEEDLE
EMBEDDER = PerWorker("hash", HashEmbedder)
Query = Callable[[SparkSession, str], DataFrame]
REGISTERED: dict[str, Query] = {}


def query(f: Query) -> Query:
    REGISTERED[f.__name__] = f
    return f


def _pages(s: SparkSession, d: str, *columns: str) -> DataFrame:
    """Every page once; repeated deliveries are equal but for the time of loading."""
    return table(s, d, "pages").select("page_id", *columns).dropDuplicates(["page_id"])


def _delivered(s: SparkSession, d: str, *columns: str) -> DataFrame:
    """Every delivered row, for functions of single rows: they need no shuffle."""
    return table(s, d, "pages").select("page_id", *columns)


def _index(s: SparkSession, d: str) -> PageIndex:
    return index_of(s, table(s, d, "pages"), "pages")


def _query_vector(s: SparkSession, d: str) -> list[float]:
    first = semantic.usable(table(s, d, "passage_vectors"), 64).filter(F.exists("embedding", lambda x: x != 0)).orderBy("embedding_id").select("embedding").first()
    return [float(x) for x in first[0]]


# ---- text

@query
def normalize_text(s, d):
    return _delivered(s, d, "text").select("page_id", tx.normalize_text("text").alias("normalized"))


@query
def stale_normalized(s, d):
    """Pages whose stored normalised text differs from today's normalisation."""
    p = _delivered(s, d, "text", "normalized_text")
    return p.filter(~tx.normalize_text("text").eqNullSafe(F.col("normalized_text"))).select("page_id").distinct()


@query
def tokenize_terms(s, d):
    return _delivered(s, d, "text").select("page_id", F.array_join(tx.terms(F.col("text")), " ").alias("terms"))


@query
def content_sha256(s, d):
    return table(s, d, "documents").select("doc_id", F.sha2("text", 256).alias("sha256"))


@query
def page_words(s, d):
    """Words, characters and layout sums of each page: running offsets of words joined by single spaces."""
    w = _delivered(s, d, "text").select("page_id", tx.words(F.col("text")).alias("w"))
    n = F.size("w")
    ends = F.when(n > 0, F.aggregate("w", F.lit(0), lambda a, x: a + F.length(x)) + n - 1).otherwise(0)
    starts = F.aggregate("w", F.struct(F.lit(0).cast("long").alias("at"), F.lit(0).cast("long").alias("sum")), lambda a, x: F.struct((a["at"] + F.length(x) + 1).alias("at"), (a["sum"] + a["at"]).alias("sum")))["sum"]
    return w.select("page_id", n.cast("long").alias("n_words"), ends.cast("long").alias("n_chars"), starts.alias("sum_starts"))


@query
def layout_words(s, d):
    """The stored layouts, unpacked: words, their last end and whether they agree with the page's text."""
    p = _delivered(s, d, "text", "layout_json").filter("layout_json is not null").withColumn("l", layout.unpack_layout(F.col("layout_json")))
    same = F.array_join(F.transform("l", lambda w: w["t"]), " ") == F.array_join(tx.words(F.col("text")), " ")
    return p.select("page_id", F.size("l").alias("n_words"), F.try_element_at("l", F.lit(-1))["e"].alias("n_chars"), same.alias("agrees"))


@query
def chunk_passages(s, d):
    return chunks.chunk_passages(_delivered(s, d, "text"))


# ---- aggregates and listings

@query
def corpus_counts(s, d):
    return table(s, d, "documents").filter("active").agg(F.count("*").alias("documents"), F.coalesce(F.sum("page_count"), F.lit(0)).alias("pages"))


@query
def document_list(s, d):
    return table(s, d, "documents").orderBy("title", "doc_id").limit(100).select("doc_id", "title", "path", "page_count", "state", "error", "indexed_at")


@query
def document_titles(s, d):
    """The title that a file's path gives, for every document."""
    return table(s, d, "documents").select("doc_id", results.title_of_path(F.col("path")).alias("stem"))


@query
def latest_job(s, d):
    return table(s, d, "index_jobs").distinct().orderBy(F.desc("job_id")).limit(1).select("job_id", "state", "total_files", "processed_files", "indexed_files", "failed_files")


@query
def job_counters(s, d):
    j = table(s, d, "index_jobs").dropDuplicates(["job_id"])
    return j.groupBy("state").agg(*[F.sum(c).alias(c) for c in ("total_files", "processed_files", "indexed_files", "failed_files")], F.count("*").alias("jobs"), F.count_if(F.col("finished_at").isNull()).alias("open"))


@query
def document_states(s, d):
    """Outcomes per source: files, indexed and failed ones."""
    return table(s, d, "documents").groupBy("source").agg(F.count("*").alias("processed"), F.count_if(F.col("state") == "indexed").alias("indexed"), F.count_if(F.col("state") == "failed").alias("failed"))


@query
def source_list(s, d):
    docs = table(s, d, "documents").groupBy("source").agg(F.count("*").alias("documents"))
    return table(s, d, "source_roots").join(docs, "source", "left").select("root_id", "path", F.coalesce("documents", F.lit(0)).alias("documents"), F.col("last_scanned_at").isNotNull().alias("scanned")).orderBy("path")


@query
def semantic_coverage(s, d):
    return semantic.coverage(table(s, d, "passages"))


@query
def ocr_gate(s, d):
    p = _delivered(s, d, "normalized_text", "text").withColumn("n", F.length(F.coalesce("normalized_text", F.lit("")))).withColumn("w", F.size(tx.words(F.col("text"))))
    return p.select("page_id", layout.needs_ocr(F.col("n"), F.col("w"), F.lit(0.0)).alias("needs_ocr"), layout.full_ocr(F.col("n")).alias("full_ocr"))


@query
def ocr_failed_docs(s, d):
    return table(s, d, "pages").filter(F.col("warning").ilike("OCR unavailable:%")).agg(F.count_distinct("document_id").alias("documents"))


@query
def ocr_requeue(s, d):
    return incremental.requeue_failed_ocr(table(s, d, "documents"), table(s, d, "pages"))


# ---- lexical and exact search

@query
def postings_stats(s, d):
    """Document and corpus frequency of every stored term."""
    return _index(s, d).term_stats()


@query
def corpus_stats(s, d):
    return lexical.corpus_stats(table(s, d, "pages")).select("n", "total", F.round(F.col("total") / F.col("n"), 6).alias("avgdl"))


def _bm25(s, d, q):
    return lexical.bm25(_index(s, d), table(s, d, "pages"), table(s, d, "documents"), q).select("page_id", F.round("score", 6).alias("score"))


@query
def lexical_bm25_single(s, d):
    return _bm25(s, d, SINGLE)


@query
def lexical_bm25_and(s, d):
    return _bm25(s, d, BOTH)


@query
def lexical_diacritics(s, d):
    return _bm25(s, d, MARKED)


@query
def lexical_all_terms(s, d):
    """BM25 of every search term, by one reading of their postings."""
    return lexical.bm25_many(_index(s, d), table(s, d, "pages"), table(s, d, "documents"), table(s, d, "search_terms")).select("term_id", "page_id", F.round("score", 6).alias("score"), "rank")


@query
def exact_match(s, d):
    return exact.exact_page(table(s, d, "pages"), table(s, d, "documents"), NEEDLE, index=_index(s, d))


@query
def exact_match_page2(s, d):
    return exact.exact_page(table(s, d, "pages"), table(s, d, "documents"), NEEDLE, page=2, index=_index(s, d))


@query
def exact_total(s, d):
    return exact.exact_matches(table(s, d, "pages"), table(s, d, "documents"), NEEDLE, _index(s, d)).agg(F.count("*").alias("total"))


@query
def exact_short_needles(s, d):
    """Which needles the exact search refuses for their length: the two-letter words of the pages, with the pages that a search for them would miss."""
    w = _delivered(s, d, "normalized_text").select("page_id", F.explode(F.array_distinct(F.split("normalized_text", " "))).alias("needle")).filter("length(needle) between 1 and 2")
    return w.distinct().groupBy("needle").agg(F.count("*").alias("pages"))


@query
def exact_all_terms(s, d):
    return exact.exact_counts(table(s, d, "pages"), table(s, d, "documents"), table(s, d, "search_terms"))


# ---- vectors, fusion, results

@query
def vector_topk(s, d):
    return semantic.top_passages(table(s, d, "passage_vectors"), _query_vector(s, d)).select("embedding_id", F.round("score", 6).alias("score"))


@query
def vector_norms(s, d):
    v = semantic.usable(table(s, d, "passage_vectors"), 64)
    unit = scores.l2_normalized(F.col("embedding"))
    return v.select("embedding_id", F.round(scores.inner_product(unit, unit), 4).alias("length"))


def _semantic_hits(s, d):
    return semantic.semantic_pages(table(s, d, "passage_vectors"), table(s, d, "passages"), table(s, d, "pages"), table(s, d, "documents"), _query_vector(s, d))


@query
def semantic_pages(s, d):
    return _semantic_hits(s, d).select("page_id", F.round("score", 6).alias("score"), "word_start", "word_end")


def _fused(s, d):
    return fusion.rrf(lexical.bm25(_index(s, d), table(s, d, "pages"), table(s, d, "documents"), SINGLE), _semantic_hits(s, d))


@query
def rrf_fusion(s, d):
    return _fused(s, d).select("page_id", "lex_rank", "sem_rank", F.round("rrf", 8).alias("rrf"), "word_start", "word_end", "fused_rank")


def _blended(s, d, reranker):
    return fusion.blend(fusion.with_rerank_text(_fused(s, d), table(s, d, "pages")), reranker, SINGLE)


@query
def rerank_blend(s, d):
    return _blended(s, d, OverlapReranker()).select("page_id", "logit", F.round("score", 6).alias("score"))


@query
def hybrid_rerank_offline(s, d):
    return _blended(s, d, None).select("page_id", F.round("score", 6).alias("score"))


def _shown(s, d):
    top = _blended(s, d, OverlapReranker()).limit(10)
    return top.withColumn("pos", F.row_number().over(W.orderBy(F.desc(F.round("score", 9)), "fused_rank")))


@query
def hybrid_search(s, d):
    """The flagship: one page of hybrid results with provenance, snippet and the number of highlighted boxes."""
    rows = results.hydrate(_shown(s, d).select("page_id", "score", "word_start", "word_end", "pos"), table(s, d, "pages"), table(s, d, "documents"), SINGLE)
    return rows.select("pos", "page_id", "document_id", "title", "path", "page_number", "score", "snippet", F.size("highlights").alias("boxes"), "extraction_method", "warning", "pdf_url")


@query
def semantic_search(s, d):
    """Semantic mode: fusion of the one list, blended with a reranker, best page of results."""
    empty = s.createDataFrame([], "page_id long, score double")
    fused = fusion.with_rerank_text(fusion.rrf(empty, _semantic_hits(s, d)), table(s, d, "pages"))
    return fusion.blend(fused, OverlapReranker(), SINGLE).limit(10).select("page_id", F.round("score", 6).alias("score"))


@query
def snippets(s, d):
    """The snippet of an exact hit for every page: its first words."""
    p = _delivered(s, d, "text").withColumn("w", tx.words(F.col("text")))
    return p.select("page_id", results.snippet(F.col("w"), F.lit(0), F.least(F.size("w"), F.lit(60))).alias("snippet"))


@query
def highlights(s, d):
    """Words of each page that equal a word of any search term: their places in the normalised text."""
    wanted = F.broadcast(table(s, d, "search_terms").select(F.explode(F.split(tx.normalize_text("term"), " ")).alias("word")).distinct())  # the words of a fixed table
    p = _delivered(s, d, "normalized_text").select("page_id", F.posexplode(F.split("normalized_text", " ")).alias("word_no", "word"))
    return p.join(wanted, "word", "left_semi").select("page_id", "word_no", "word").distinct()


@query
def highlight_boxes(s, d):
    """Boxes of the words of a query on every page with a stored layout; where no word hits, those of the first sixty words."""
    p = _delivered(s, d, "layout_json").filter("layout_json is not null").withColumn("l", layout.unpack_layout(F.col("layout_json")))
    boxes = results.highlights(F.col("l"), results.normal_words(F.col("l")), results.query_terms(BOTH), F.lit(0), F.least(F.size("l"), F.lit(60)))
    return p.select("page_id", F.size(boxes).alias("boxes"))


@query
def result_hydrate(s, d):
    """Provenance of every page: document, warning or the document's error, link."""
    doc = table(s, d, "documents").select(F.col("doc_id").alias("document_id"), "title", "error")
    p = _pages(s, d, "document_id", "page_number", "warning").join(doc, "document_id")
    return p.select("page_id", "title", F.coalesce(F.nullif("warning", F.lit("")), "error").alias("warning"), F.format_string("/api/documents/%d/pdf#page=%d", "document_id", "page_number").alias("pdf_url"))


# ---- incremental maintenance

def _changes(s, d):
    """The indexed snapshot against the files that are there now (active documents)."""
    docs = table(s, d, "documents")
    stored = docs.filter("indexed_at is not null").select("path", "doc_id", "size", F.when(F.unix_millis("indexed_at") * 1000000 >= F.col("mtime_ns"), F.col("mtime_ns")).alias("mtime_ns"), "state", F.lit(True).alias("active"))
    return incremental.classify_changes(stored, docs.filter("active").select("path", "size", "mtime_ns"))


@query
def change_classify(s, d):
    return _changes(s, d)


@query
def deleted_docs(s, d):
    return _changes(s, d).filter("change = 'gone'").select("doc_id")


@query
def tombstone_passages(s, d):
    docs, passages = incremental.tombstone(table(s, d, "documents"), table(s, d, "passages"), table(s, d, "pages"), _changes(s, d))
    return passages.select("passage_id", "active").distinct()


@query
def replace_merge(s, d):
    """Stored passages of native pages replaced by freshly cut ones: (page_id, passages)."""
    p = table(s, d, "pages").filter("extraction_method = 'native'").select("page_id", "text")
    fresh = chunks.chunk_passages(p).select("page_id", "ordinal", "word_start", "word_end").distinct()  # numbers are shuffled, texts are not
    stored = table(s, d, "passages").select("page_id", "ordinal", "word_start", "word_end").distinct()
    return incremental.replace_children(stored, fresh, "page_id").groupBy("page_id").agg(F.count("*").alias("passages"), F.max("word_end").alias("words"))


@query
def missing_embeddings(s, d):
    return incremental.missing_passages(table(s, d, "passages"), table(s, d, "passage_vectors")).select("passage_id")


@query
def missing_docs(s, d):
    return incremental.missing_documents(table(s, d, "passages"), table(s, d, "pages"), table(s, d, "documents"), table(s, d, "passage_vectors"))


@query
def backfill_batch(s, d):
    got = incremental.backfill(table(s, d, "passages"), table(s, d, "passage_vectors"), EMBEDDER)
    return got.select("embedding_id", F.size("embedding").alias("dim"), "error")


@query
def embed_udf(s, d):
    got = embed(latest(table(s, d, "passages"), "passage_id").filter("active"), EMBEDDER, "passage_id", "text")
    return got.select("passage_id", F.size("embedding").alias("dim"), "error")


@query
def latest_pages(s, d):
    """The last delivery of each page."""
    return latest(table(s, d, "pages").select("page_id", "document_id", "page_number", "loaded_at"), "page_id").withColumn("loaded_at", F.unix_micros("loaded_at"))


@query
def document_lookup(s, d):
    return incremental.document(table(s, d, "documents"), 42).select("doc_id", "path", "title", "state", "page_count")


def queries() -> dict[str, Query]:
    return dict(REGISTERED)


def oracle_sql() -> dict[str, str]:
    return sql.oracle_sql()
