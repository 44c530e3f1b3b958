"""The search façade: exact, semantic and hybrid queries over one corpus of tables."""

from __future__ import annotations

import time
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pagequarry.functions.models import Embedder, OverlapReranker, Reranker
from pagequarry.operators import exact, fusion, lexical, results, semantic
from pagequarry.operators.index import PageIndex
from pagequarry.session import checkpoint_folder
from pagequarry.sources.tables import table

NO_HITS = "page_id long, score double, passage string, word_start int, word_end int"


@dataclass
class SearchResult:
    results: DataFrame
    total: int | None
    took_ms: float
    warning: str | None


@dataclass
class Corpus:
    pages: DataFrame
    documents: DataFrame
    passages: DataFrame
    vectors: DataFrame

    @classmethod
    def load(cls, spark: SparkSession, folder: str) -> Corpus:
        return cls(*(table(spark, folder, n) for n in ("pages", "documents", "passages", "passage_vectors")))


class SearchEngine:
    """Queries a corpus. Plans are lazy; only counts, the query vector and the shown rows are ever computed for the driver."""

    def __init__(self, corpus: Corpus, embedder: Embedder | None = None, reranker: Reranker | None = None, prefilter: bool = False, index: PageIndex | None = None):
        self._index = index
        self.corpus, self.embedder, self.reranker, self.prefilter = corpus, embedder, reranker or OverlapReranker(), prefilter
        self.spark = corpus.pages.sparkSession

    @property
    def index(self) -> PageIndex:
        """The given index of the corpus's pages, or one that is built at the first search that needs it."""
        if self._index is None:
            self._index = PageIndex.build(self.spark, self.corpus.pages, f"{checkpoint_folder(self.spark)}/index-{uuid.uuid4().hex}")
        return self._index

    def search(self, query: str, mode: str = "hybrid", page: int = 1, page_size: int = 10, query_vector: list[float] | None = None) -> SearchResult:
        began = time.perf_counter()
        if not 1 <= len(query) <= 2000 or mode not in ("hybrid", "exact", "semantic") or page < 1 or not 1 <= page_size <= 100:
            raise ValueError("query of 1 to 2000 characters, mode hybrid, exact or semantic, page from 1, page_size 1 to 100")
        c, warning, total = self.corpus, None, None
        if mode == "exact":
            total = exact.exact_matches(c.pages, c.documents, query, self.index).count()
            rows = exact.exact_page(c.pages, c.documents, query, page, page_size, self.index)
            rows = rows.withColumn("pos", F.row_number().over(W.orderBy("title", "page_number", "page_id")))  # one page of rows
            rows = rows.select("page_id", "score", F.lit(0).alias("word_start"), F.lit(None).cast("int").alias("word_end"), "pos")
        else:
            hits, warning = self._semantic(query, query_vector, mode)
            found = lexical.bm25(self.index, c.pages, c.documents, query) if mode == "hybrid" else self.spark.createDataFrame([], "page_id long, score double")
            candidates = fusion.with_rerank_text(fusion.rrf(found, hits), c.pages)
            try:
                self.reranker.rerank(query, [""])
                scored = fusion.blend(candidates, self.reranker, query)
            except RuntimeError as error:
                scored, warning = fusion.blend(candidates, None, query), str(error)
            shown = scored.offset((page - 1) * page_size).limit(page_size)
            rows = shown.withColumn("pos", F.row_number().over(W.orderBy(F.desc(F.round("score", 9)), "fused_rank"))).select("page_id", "score", "word_start", "word_end", "pos")
        out = results.hydrate(rows, c.pages, c.documents, query).orderBy("pos").drop("pos")
        return SearchResult(out, total, round((time.perf_counter() - began) * 1000, 2), warning)

    def _semantic(self, query: str, vector: list[float] | None, mode: str) -> tuple[DataFrame, str | None]:
        """The semantic hits; in hybrid mode a failure gives none and its message."""
        c = self.corpus
        try:
            if vector is None:
                if self.embedder is None:
                    raise RuntimeError("models offline")
                vector = [float(x) for x in self.embedder.encode([query])[0]]
            if semantic.usable(c.vectors, len(vector)).isEmpty():
                r = semantic.coverage(c.passages).first()
                message = semantic.coverage_error(r["total"], r["embedded"])
                if message:
                    raise RuntimeError(message)
                return self.spark.createDataFrame([], NO_HITS), None
            return semantic.semantic_pages(c.vectors, c.passages, c.pages, c.documents, vector, prefilter=self.prefilter), None
        except RuntimeError as error:
            if mode == "semantic":
                raise
            return self.spark.createDataFrame([], NO_HITS), str(error)
