import datetime
import shutil
import sqlite3

import pytest
from pyspark.sql import functions as F

from pagequarry.functions.layout import pack_layout
from pagequarry.functions.models import HashEmbedder, OfflineModels
from pagequarry.functions.text import normalize
from pagequarry.operators import exact, fusion, lexical, results, semantic
from pagequarry.operators.index import PageIndex, index_of
from pagequarry.plans.search import Corpus, SearchEngine

TEXTS = ["Marine fastener ISO 4762 A4-80 corrosion resistance", "Unrelated carbon steel bolt", "Über corrosion: corrosion again, corrosion resistance of bolts", "", None, "a bolt_nut assembly", "bolt nut, steel bolt", "is it steel"]
DOCS = "doc_id long, title string, path string, error string, active boolean, state string, size long, mtime_ns long"
PAGES = "page_id long, document_id long, page_number int, text string, normalized_text string, width double, height double, extraction_method string, layout_json binary, warning string, loaded_at timestamp"
PASSAGES = "passage_id long, page_id long, ordinal int, text string, word_start int, word_end int, embedding_id long, active boolean, loaded_at timestamp"


def words_of(text):
    return [{"i": i, "t": t, "s": 0, "e": 0, "x": i / 20, "y": 0.1, "w": 0.04, "h": 0.02, "b": 0, "l": 0, "o": i} for i, t in enumerate((text or "").split())]


@pytest.fixture(scope="module")
def corpus(spark):
    day = datetime.datetime(2024, 1, 1)
    docs = spark.createDataFrame([(1, "Fastener Catalogue", "/tmp/a.pdf", None, True, "indexed", 1, 1), (2, "Other", "/tmp/b.c.pdf", "models unavailable", True, "indexed", 2, 2), (3, "Gone", "/tmp/c.pdf", None, False, "indexed", 3, 3)], DOCS)
    rows = [(i + 1, 1 if i < 3 else 2 if i < 7 else 3, 182 + i, t, normalize(t), 100.0, 100.0, "native", bytearray(pack_layout(words_of(t))), "", day) for i, t in enumerate(TEXTS)]
    rows += [rows[0][:-1] + (day + datetime.timedelta(days=1),)]  # delivered twice
    pages = spark.createDataFrame(rows, PAGES)
    parts = [(10 * r[0], r[0], 0, r[3], 0, len(r[3].split()), 10 * r[0], r[0] != 2, day) for r in rows[:-1] if r[3]]
    passages = spark.createDataFrame(parts + parts[:1], PASSAGES)
    vectors = [(p[6], [float(x) for x in HashEmbedder(8).encode([p[3]])[0]]) for p in parts] + [(999, None), (998, [1.0] * 3), (997, [float("nan")] * 8)]
    return Corpus(pages, docs, passages, spark.createDataFrame(vectors, "embedding_id long, embedding array<float>"))


@pytest.fixture(scope="module")
def index(spark, corpus, tmp_path_factory):
    return PageIndex.build(spark, corpus.pages, str(tmp_path_factory.mktemp("index")))


@pytest.mark.parametrize("query", ["corrosion", "corrosion resistance", "uber", "bolt_nut", "bolt bolt", "steel bolt", "missing", "--"])
def test_bm25_equals_the_full_text_index(corpus, index, query):
    db = sqlite3.connect(":memory:")
    db.execute("CREATE VIRTUAL TABLE f USING fts5(t, tokenize='unicode61 remove_diacritics 2')")
    db.executemany("INSERT INTO f(rowid, t) VALUES (?, ?)", [(i + 1, t or "") for i, t in enumerate(TEXTS)])
    import re

    match = " AND ".join(f'"{t}"' for t in re.findall(r"\w+", query))
    want = {r[0]: -r[1] for r in db.execute("SELECT rowid, bm25(f) FROM f WHERE f MATCH ?", (match,))} if match else {}
    want.pop(8, None)  # the page of a withdrawn document: counted, not shown
    got = {r["page_id"]: r["score"] for r in lexical.bm25(index, corpus.pages, corpus.documents, query).collect()}
    assert got.keys() == want.keys()
    assert all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_bm25_many_equals_bm25(corpus, index, spark):
    queries = spark.createDataFrame([(1, "corrosion"), (2, "steel bolt"), (3, "bolt bolt"), (4, "--"), (5, None), (6, "nothing")], "term_id long, term string")
    got = {(r["term_id"], r["page_id"]): round(r["score"], 9) for r in lexical.bm25_many(index, corpus.pages, corpus.documents, queries).collect()}
    want = {(k, r["page_id"]): round(r["score"], 9) for k, q in ((1, "corrosion"), (2, "steel bolt"), (3, "bolt bolt")) for r in lexical.bm25(index, corpus.pages, corpus.documents, q).collect()}
    assert got == want


def test_postings_and_stats(corpus, index):
    p = {(r["term"], r["page_id"]): (r["tf"], r["dl"]) for r in index.postings(["corrosion", "bolt", "absent"]).collect()}
    assert p["corrosion", 3] == (3, 8) and p["bolt", 7] == (2, 4) and len(p) == 5
    s = {r["term"]: (r["df"], r["cf"]) for r in index.term_stats().collect()}
    assert s["corrosion"] == (2, 4)
    assert tuple(lexical.corpus_stats(corpus.pages).first()) == tuple(index.stats().first()) and index.stats().first()["n"] == 8
    read = index._live("terms", where=index._among(["corrosion"], "term"))
    plan = read._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [bucket" in plan and "PushedFilters: [In(term" in plan or "EqualTo(term,corrosion)" in plan


def test_index_follows_changed_pages(spark, corpus, tmp_path):
    index = PageIndex.build(spark, corpus.pages, str(tmp_path / "i"))
    new = spark.createDataFrame([(2, 1, "Copper washer, corrosion free", None), (50, 2, "Brand new corrosion", None)], "page_id long, document_id long, text string, normalized_text string").withColumn("normalized_text", F.lower("text"))
    big = 2**62 + 1  # beyond what a float holds
    new = new.unionByName(spark.createDataFrame([(big, big, "washer of a large id", "washer of a large id"), (51, None, "washer of no document", "washer of no document"), (None, 1, "washer of no page", "washer of no page")], new.schema))
    index.update(new, spark.createDataFrame([(3,)], "page_id long"))
    now = corpus.pages.filter("page_id not in (2, 3)").select(new.columns).unionByName(new)
    whole = PageIndex.build(spark, now, str(tmp_path / "whole"))
    again = PageIndex(spark, str(tmp_path / "i"))
    again.compact()
    assert {(r["page_id"], r["document_id"]) for r in index.postings(["washer"]).collect()} == {(2, 1), (51, None), (big, big)}
    for other in (index, again, PageIndex(spark, str(tmp_path / "i"))):
        assert tuple(other.stats().first()) == tuple(whole.stats().first())
        assert sorted(other.term_stats().collect()) == sorted(whole.term_stats().collect())
        for needle in ("corrosion", "washer, co", "carbon", "uber corr"):
            assert sorted(other.pages_with({needle: []}).collect()) == sorted(whole.pages_with({needle: []}).collect())
        assert sorted(lexical.bm25(other, now, corpus.documents, "corrosion").collect()) == sorted(lexical.bm25(whole, now, corpus.documents, "corrosion").collect())
    assert PageIndex.build(spark, corpus.pages.limit(0), str(tmp_path / "empty")).postings(["x"]).count() == 0


def test_exact_is_exhaustive_and_provenanced(corpus):
    engine = SearchEngine(corpus)
    out = engine.search("ISO 4762", "exact")
    rows = out.results.collect()
    assert out.total == 1 and rows[0]["page_number"] == 182 and rows[0]["title"] == "Fastener Catalogue" and rows[0]["highlights"] and rows[0]["score"] == 1.0
    assert rows[0]["pdf_url"] == "/api/documents/1/pdf#page=182" and rows[0]["snippet"] == TEXTS[0]
    assert engine.search("is", "exact").total == 0 and engine.search(" ", "exact").total == 0
    assert engine.search("steel", "exact").total == 2  # the withdrawn document's page does not count
    assert [r["page_number"] for r in engine.search("steel", "exact", page=2, page_size=1).results.collect()] == [188]


def test_index_of_a_table_is_built_again_when_it_is_gone_or_the_table_changes(spark, corpus, tmp_path):
    path = str(tmp_path / "pages.parquet")
    corpus.pages.write.parquet(path)
    first = index_of(spark, spark.read.parquet(path), "pages")
    assert index_of(spark, spark.read.parquet(path), "pages") is first
    shutil.rmtree(first.folder.removeprefix("file:"))
    second = index_of(spark, spark.read.parquet(path), "pages")
    assert second.stats().first() == index_of(spark, spark.read.parquet(path), "pages").stats().first() and second is not first
    corpus.pages.limit(1).write.mode("append").parquet(path)
    assert index_of(spark, spark.read.parquet(path), "pages") is not second


def test_exact_with_index_equals_the_plain_search(corpus, index):
    for q in ("steel", "ISO 4762", "olt nu", "absent text", "bolt, ", "is "):
        with_index = exact.exact_matches(corpus.pages, corpus.documents, q, index).select("page_id").collect()
        assert sorted(with_index) == sorted(exact.exact_matches(corpus.pages, corpus.documents, q).select("page_id").collect())


def test_exact_counts(corpus, spark):
    needles = spark.createDataFrame([(1, "STEEL"), (2, "is"), (3, None), (4, "corrosion")], "term_id long, term string")
    assert dict(exact.exact_counts(corpus.pages, corpus.documents, needles).collect()) == {1: 2, 4: 2}


def test_hybrid_falls_back_to_lexical(corpus):
    out = SearchEngine(corpus, OfflineModels(), OfflineModels()).search("corrosion resistance", "hybrid")
    rows = out.results.collect()
    assert {r["page_id"] for r in rows} == {1, 3} and out.warning == "models offline" and out.total is None
    assert all(abs(r["score"] - x) < 1e-6 for r, x in zip(rows, [0.625, 0.375 + 0.25 * 61 / 62]))
    with pytest.raises(RuntimeError):
        SearchEngine(corpus, OfflineModels()).search("corrosion", "semantic")


def test_semantic(corpus):
    v = [float(x) for x in HashEmbedder(8).encode([TEXTS[2]])[0]]
    top = semantic.top_passages(corpus.vectors, v).collect()
    assert top[0]["embedding_id"] == 30 and len(top) == 6  # null, short and NaN vectors are left out
    hits = semantic.semantic_pages(corpus.vectors, corpus.passages, corpus.pages, corpus.documents, v).collect()
    assert hits[0]["page_id"] == 3 and {r["page_id"] for r in hits} == {1, 3, 6, 7}  # inactive passage 2 and document 3 are left out
    few = semantic.semantic_pages(corpus.vectors, corpus.passages, corpus.pages, corpus.documents, v, limit=1).count()
    assert few <= 1
    out = SearchEngine(corpus, HashEmbedder(8)).search(TEXTS[2], "semantic").results.collect()
    assert out[0]["page_id"] == 3


def test_incomplete_index(corpus, spark):
    empty = Corpus(corpus.pages, corpus.documents, corpus.passages.withColumn("embedding_id", F.lit(None).cast("long")), corpus.vectors.limit(0))
    with pytest.raises(RuntimeError, match="0 of 5 passages ready"):
        SearchEngine(empty, HashEmbedder(8)).search("x", "semantic")
    assert "being built" in SearchEngine(empty, HashEmbedder(8)).search("corrosion", "hybrid").warning
    assert tuple(semantic.coverage(corpus.passages).first()) == (5, 5, True)
    assert semantic.coverage(corpus.passages.limit(0)).first()["ready"] is False


def test_add_vectors(corpus, spark):
    assert semantic.add_vectors(corpus.vectors, corpus.vectors.limit(0), 8).count() == corpus.vectors.count()
    with pytest.raises(Exception, match="dimension"):
        semantic.add_vectors(corpus.vectors, spark.createDataFrame([(5, [1.0])], corpus.vectors.schema), 8).collect()


def test_fusion(spark):
    lex = spark.createDataFrame([(i, 10.0 - i) for i in range(1, 4)], "page_id long, score double")
    sem = spark.createDataFrame([(3, 0.9, "p3", 5, 9), (4, 0.8, "", 0, 4)], "page_id long, score double, passage string, word_start int, word_end int")
    rows = fusion.rrf(lex, sem).orderBy("fused_rank").collect()
    assert [r["page_id"] for r in rows] == [3, 1, 2, 4]
    assert abs(rows[0]["rrf"] - (1 / 63 + 1 / 61)) < 1e-12 and rows[0]["passage"] == "p3" and rows[1]["passage"] is None and rows[1]["word_end"] == 0
    pages = spark.createDataFrame([(i, f"text {i}") for i in range(1, 5)], "page_id long, text string")
    texts = {r["page_id"]: r["rerank_text"] for r in fusion.with_rerank_text(fusion.rrf(lex, sem), pages).collect()}
    assert texts == {3: "p3", 1: "text 1", 2: "text 2", 4: "text 4"}
    assert fusion.rrf(lex.limit(0), sem.limit(0)).count() == 0
    assert fusion.blend(fusion.with_rerank_text(fusion.rrf(lex.limit(0), sem.limit(0)), pages), None, "q").count() == 0


def test_snippet_and_highlights(spark):
    df = spark.createDataFrame([([f"w{i}" for i in range(200)],)], "w array<string>")
    got = lambda s, e: df.select(results.snippet(F.col("w"), F.lit(s), F.lit(e))).first()[0].split()
    assert got(0, 0) == [f"w{i}" for i in range(62)] and got(100, 180) == [f"w{i}" for i in range(88, 192)] and got(190, 195)[0] == "w178" and got(190, 195)[-1] == "w199"
    boxes = "array<struct<x:double,y:double,w:double,h:double>>"
    lay = spark.createDataFrame([([(0.1, 0.0, 0.0, 0.0), (0.2, 0.0, 0.0, 0.0)], ["a", "b"])], f"l {boxes}, n array<string>")
    hl = lambda terms, s, e: [b["x"] for b in lay.select(results.highlights(F.col("l"), F.col("n"), terms, F.lit(s), F.lit(e))).first()[0]]
    assert hl(["b"], 0, 1) == [0.2] and hl(["z"], 0, 1) == [0.1] and hl(["z"], 0, 0) == [] and hl([], 0, 2) == [0.1, 0.2]


def test_titles(spark):
    df = spark.createDataFrame([("/a/b.c.pdf",), ("x",), ("/a/.hidden",), (None,)], "p string")
    assert [r[0] for r in df.select(results.title_of_path(F.col("p"))).collect()][:2] == ["b.c", "x"]


def test_request_is_checked(corpus):
    for bad in ({"query": ""}, {"query": "x", "mode": "fuzzy"}, {"query": "x", "page": 0}, {"query": "x", "page_size": 101}):
        with pytest.raises(ValueError):
            SearchEngine(corpus).search(**bad)
