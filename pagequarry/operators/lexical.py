"""Lexical search: BM25 over the stored index of pages, all query tokens required."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pagequarry.functions.text import query_tokens, terms
from pagequarry.operators.index import PageIndex

K1, B = 1.2, 0.75


def corpus_stats(pages: DataFrame) -> DataFrame:
    """(n, total): pages and their terms, from the texts; lengths alone are shuffled. An index keeps these sums."""
    lengths = pages.select("page_id", F.size(terms(F.col("text"))).alias("dl")).dropDuplicates(["page_id"])
    return lengths.agg(F.count("*").alias("n"), F.coalesce(F.sum("dl"), F.lit(0)).alias("total"))


def _count(phrase: list[str]) -> Column:
    """Occurrences of a phrase of several terms in the page's terms."""
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("terms") - (len(phrase) - 1)))
    want = F.array(*[F.lit(p) for p in phrase])
    return F.size(F.filter(starts, lambda i: F.slice("terms", i, len(phrase)) == want))


def idf(n: Column, df: Column) -> Column:
    v = F.log((n - df + 0.5) / (df + 0.5))
    return F.when(v <= 0, F.lit(1e-6)).otherwise(v)


def _phrase_counts(index: PageIndex, pages: DataFrame, phrases: list[list[str]]) -> DataFrame:
    """(term, page_id, document_id, tf, dl) of phrases, joined by spaces; only the pages that have all terms of one are read."""
    out = None
    for phrase in phrases:
        every = index.postings(phrase).groupBy("page_id").agg(F.count("*").alias("have"), F.max("document_id").alias("document_id"), F.max("dl").alias("dl")).filter(F.col("have") == len(set(phrase)))
        found = pages.select("page_id", "text").join(every, "page_id").select("page_id", "document_id", "dl", terms(F.col("text")).alias("terms"))
        one = found.select(F.lit(" ".join(phrase)).alias("term"), "page_id", "document_id", _count(phrase).cast("int").alias("tf"), "dl").filter("tf > 0").distinct()
        out = one if out is None else out.unionByName(one)
    return out


def token_counts(index: PageIndex, pages: DataFrame, tokens: list[list[str]]) -> DataFrame:
    """(term, page_id, document_id, tf, dl) of query tokens: stored postings, and phrases where a token is one."""
    single, phrases = sorted({t[0] for t in tokens if len(t) == 1}), sorted({tuple(t) for t in tokens if len(t) > 1})
    out = index.postings(single)
    return out.unionByName(_phrase_counts(index, pages, [list(p) for p in phrases])) if phrases else out


def bm25(index: PageIndex, pages: DataFrame, documents: DataFrame, query: str, limit: int | None = 200) -> DataFrame:
    """(page_id, score) of the best pages of active documents. Repeated query tokens count twice; no token, no result.

    Only the postings of the query's terms are read; pages of withdrawn documents stay in the index and its statistics.
    """
    spark = pages.sparkSession
    tokens = [" ".join(t) for t in query_tokens(query)]
    if not tokens:
        return spark.createDataFrame([], "page_id long, score double")
    asked = spark.createDataFrame([(1, t) for t in tokens], "q int, term string")
    got = _scored(token_counts(index, pages, query_tokens(query)), asked, index.stats(), "q")
    active = documents.filter("active").select(F.col("doc_id").alias("document_id"))
    out = got.join(active, "document_id", "left_semi").select("page_id", "score")
    return out if limit is None else out.orderBy(F.desc(F.round("score", 9)), "page_id").limit(limit)


def _scored(counts: DataFrame, asked: DataFrame, stats: DataFrame, key: str) -> DataFrame:
    """(key, page_id, document_id, score) of the pages that have all terms of a query; asked: (key, term), a bounded list of queries."""
    q = asked.groupBy(key, "term").agg(F.count("*").alias("times"))
    need = q.groupBy(key).agg(F.count("*").alias("need"))
    df = counts.groupBy("term").agg(F.count("*").alias("df"))
    weight = q.join(df, "term").crossJoin(F.broadcast(stats)).select(key, "term", "times", idf(F.col("n"), F.col("df")).alias("idf"), (F.col("total") / F.col("n")).alias("avgdl"))  # stats is one row
    part = F.col("times") * F.col("idf") * (F.col("tf") * (K1 + 1)) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    hits = counts.join(F.broadcast(weight), "term").groupBy(key, "page_id").agg(F.sum(part).alias("score"), F.count("*").alias("have"), F.max("document_id").alias("document_id"))
    return hits.join(F.broadcast(need), key).filter("have = need").select(key, "page_id", "document_id", "score")


def bm25_many(index: PageIndex, pages: DataFrame, documents: DataFrame, queries: DataFrame, key: str = "term_id", query: str = "term", limit: int = 200, most_queries: int = 10_000) -> DataFrame:
    """(key, page_id, score, rank) for a small table of queries: the postings of all their terms are read once."""
    rows = queries.select(key, query).limit(most_queries + 1).collect()
    if len(rows) > most_queries:
        raise ValueError(f"more than {most_queries} queries")
    tokens = [(r[key], t) for r in rows for t in query_tokens(r[query] or "")]
    asked = pages.sparkSession.createDataFrame([(k, " ".join(t)) for k, t in tokens], f"{key} {queries.schema[key].dataType.simpleString()}, term string")
    got = _scored(token_counts(index, pages, [t for _, t in tokens]), asked, index.stats(), key)
    active = documents.filter("active").select(F.col("doc_id").alias("document_id"))
    rank = F.row_number().over(W.partitionBy(key).orderBy(F.desc(F.round("score", 9)), "page_id"))
    return got.join(active, "document_id", "left_semi").withColumn("rank", rank).filter(F.col("rank") <= limit).select(key, "page_id", "score", "rank")
