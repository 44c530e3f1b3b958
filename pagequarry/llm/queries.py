"""The registered queries of the numbered problems, each over its whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagequarry.llm import encoding, lines, lookalikes, mojibake, neardup, packing, scans, splitting, vectors
from pagequarry.operators.components import connected_components
from pagequarry.session import cut
from pagequarry.sources.tables import table

# Problem 5 as TESTDATA.md states it: three words, 0.6 of the union, 30 words.
PAGES = {"k": 3, "t": 0.6, "min_words": 30}


def _neighbours(spark: SparkSession, d: str) -> DataFrame:
    return vectors.similar_vectors(table(spark, d, "passage_vectors"), among=table(spark, d, "passages").select("embedding_id"))


def p1_neighbours(spark: SparkSession, d: str) -> DataFrame:
    return _neighbours(spark, d).select(F.col("id").alias("embedding_id"), "neighbour", F.round("similarity", 3).alias("similarity"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return _neighbours(spark, d).select(F.least("id", "neighbour").alias("embedding_id_a"), F.greatest("id", "neighbour").alias("embedding_id_b")).distinct()


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return lines.repeated_lines(table(spark, d, "pages"), table(spark, d, "documents")).select("page_id", "line_no")


def p2_clean_pages(spark: SparkSession, d: str) -> DataFrame:
    pages = table(spark, d, "pages")
    return lines.without_lines(pages, lines.repeated_lines(pages, table(spark, d, "documents")))


def p2_templates(spark: SparkSession, d: str) -> DataFrame:
    """Lines whose whole template repeats, such as bylines with changing names."""
    return lines.repeated_templates(table(spark, d, "pages"), table(spark, d, "documents"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return scans.scan_noise(table(spark, d, "pages"), table(spark, d, "documents")).select("page_id", "line_no", "kind", "word").distinct()


def p3_repaired_pages(spark: SparkSession, d: str) -> DataFrame:
    pages = table(spark, d, "pages")
    return scans.repaired_pages(pages, scans.scan_noise(pages, table(spark, d, "documents")))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return lookalikes.find_terms(table(spark, d, "pages"), table(spark, d, "search_terms"))


def p4_canonical(spark: SparkSession, d: str) -> DataFrame:
    return lookalikes.canonical_text(table(spark, d, "pages")).distinct()


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    got = neardup.near_duplicate_pages(table(spark, d, "pages"), **PAGES)
    return got.select(F.col("id_a").alias("page_id_a"), F.col("id_b").alias("page_id_b"))


def p5_groups(spark: SparkSession, d: str) -> DataFrame:
    """(page_id, class_id, n_links): pages that have a near-duplicate, by class; links count the different sets next to the page's own."""
    pairs, copies = neardup.similar_pairs(table(spark, d, "pages"), **PAGES)
    edges = cut(pairs.select(F.col("set_a").alias("a"), F.col("set_b").alias("b")))
    links = edges.select(F.explode(F.array("a", "b")).alias("set_id")).groupBy("set_id").agg(F.count("*").alias("n_links"))
    linked = links.join(connected_components(edges).withColumnRenamed("node", "set_id"), "set_id")
    rows = linked.join(copies, "set_id", "full_outer")
    return rows.select(F.coalesce("id", "set_id").alias("page_id"), F.coalesce("component", "set_id").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))


def _native(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").filter("extraction_method = 'native'").select("page_id", "text")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return splitting.item_boundaries(_native(spark, d)).select("page_id", F.col("word_end").cast("int").alias("word_end"))


def p6_passages(spark: SparkSession, d: str) -> DataFrame:
    return splitting.split_items(_native(spark, d))


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return encoding.encode(table(spark, d, "documents"))


def p7_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """(doc_id, n_bytes, equal): every document encoded and decoded again, with the byte at which its last token ends."""
    docs = table(spark, d, "documents")
    ids = cut(encoding.encode(docs))
    ends = encoding.offsets(ids).select("doc_id", F.coalesce(F.try_element_at("ends", F.lit(-1)), F.lit(0)).alias("n_bytes"))
    same = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("was")).join(encoding.decode(ids), "doc_id").select("doc_id", (F.col("was") == F.col("text")).alias("equal"))
    return ends.join(same, "doc_id")


def p8_containers(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack_documents(table(spark, d, "documents"))


def p8_fill(spark: SparkSession, d: str) -> DataFrame:
    """(n_documents, fill, containers): how many containers hold so many tokens."""
    got = packing.pack_documents(table(spark, d, "documents")).filter("container is not null").groupBy("container").agg(F.sum("n_tokens").alias("fill"), F.count("*").alias("n_pieces"))
    return got.groupBy("fill", "n_pieces").agg(F.count("*").alias("containers"))


def p8_certificate(spark: SparkSession, d: str) -> DataFrame:
    return packing.certificate(cut(packing.pack_documents(table(spark, d, "documents"))))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return mojibake.damaged_tokens(table(spark, d, "documents")).select("doc_id").distinct()


def p9_restored(spark: SparkSession, d: str) -> DataFrame:
    return mojibake.restore(table(spark, d, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p1_found, p1_neighbours, p2_found, p2_clean_pages, p2_templates, p3_found, p3_repaired_pages, p4_found, p4_canonical, p5_found, p5_groups, p6_found, p6_passages, p7_ids, p7_round_trip, p8_containers, p8_fill, p8_certificate, p9_found, p9_restored)}
