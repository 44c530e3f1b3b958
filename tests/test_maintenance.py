import os

import pytest
from pyspark.sql import functions as F

from pagequarry.functions import layout, models
from pagequarry.operators import chunks, incremental
from pagequarry.operators.components import connected_components
from pagequarry.plans import scan
from pagequarry.sources import files, roots, snapshots
from pagequarry.sources.tables import latest
from pagequarry.streaming import ingest

DOCS = "path string, doc_id long, size long, mtime_ns long, state string, active boolean"


def closed_chunks(n, most, overlap):
    """The k-th window begins at k steps; there are as many as it takes to reach the last word."""
    step = max(1, most - overlap)
    return [(k * step, min(n, k * step + most)) for k in range(1 + max(0, -(-(n - most) // step)))]


@pytest.mark.parametrize("most,overlap", [(260, 40), (5, 2), (3, 3), (4, 0)])
def test_chunks(spark, most, overlap):
    sizes = [0, 1, 2, 3, 4, 5, 6, 7, 8, 11, 260, 261, 480, 481, 900]
    df = spark.createDataFrame([(n, " ".join(f"w{i}" for i in range(n))) for n in sizes] + [(-1, None)], "page_id long, text string")
    got = {}
    for r in chunks.chunk_passages(df, most, overlap).orderBy("page_id", "ordinal").collect():
        got.setdefault(r["page_id"], []).append((r["word_start"], r["word_end"]))
        assert r["text"].split() == [f"w{i}" for i in range(r["word_start"], r["word_end"])]
    assert got == {n: closed_chunks(n, most, overlap) for n in sizes if n}


def test_changes(spark):
    existing = spark.createDataFrame([("/a", 1, 10, 100, "indexed", True), ("/b", 2, 10, 100, "indexed", True), ("/c", 3, 10, 100, "failed", True), ("/d", 4, 10, 100, "indexed", True), ("/e", 5, 10, None, "indexed", False), ("/f", 6, 1, 1, "indexed", False)], DOCS)
    found = spark.createDataFrame([("/a", 10, 100), ("/a", 10, 100), ("/b", 10, 101), ("/c", 10, 100), ("/n", 1, 1), ("/e", 10, None)], "path string, size long, mtime_ns long")
    got = {r["path"]: r["change"] for r in incremental.classify_changes(existing, found).collect()}
    assert got == {"/a": "unchanged", "/b": "changed", "/c": "changed", "/d": "gone", "/e": "unchanged", "/f": "absent", "/n": "new"}
    pages = spark.createDataFrame([(10, 4), (11, 5), (11, 5), (12, 1)], "page_id long, document_id long")
    passages = spark.createDataFrame([(1, 10, True), (2, 11, False), (3, 12, True), (4, 99, True)], "passage_id long, page_id long, active boolean")
    docs, parts = incremental.tombstone(existing, passages, pages, incremental.classify_changes(existing, found))
    assert {r["doc_id"]: r["active"] for r in docs.collect()} == {1: True, 2: True, 3: True, 4: False, 5: True, 6: False}
    assert {r["passage_id"]: r["active"] for r in parts.collect()} == {1: False, 2: True, 3: True, 4: True}
    assert incremental.classify_changes(existing.limit(0), found.limit(0)).count() == 0


def test_replace(spark):
    old = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (None, "n")], "k long, v string")
    new = spark.createDataFrame([(1, "x"), (3, "y")], "k long, v string")
    assert sorted(incremental.replace_children(old, new, "k").collect(), key=str) == sorted([(1, "x"), (2, "c"), (3, "y"), (None, "n")], key=str)


def test_backfill(spark):
    passages = spark.createDataFrame([(1, 1, "marine steel", None, True), (2, 1, "bolt", 2, True), (3, 1, "x", 3, True), (4, 1, "off", None, False), (1, 1, "marine steel", None, True)], "passage_id long, page_id long, text string, embedding_id long, active boolean")
    vectors = spark.createDataFrame([(2, [1.0]), (3, None)], "embedding_id long, embedding array<float>")
    assert {r["passage_id"] for r in incremental.missing_passages(passages, vectors).collect()} == {1, 3}
    got = incremental.backfill(passages, vectors, models.HashEmbedder(4)).collect()
    assert {r["embedding_id"] for r in got} == {1, 3} and all(len(r["embedding"]) == 4 and r["error"] is None for r in got)
    assert {r["error"] for r in incremental.backfill(passages, vectors, models.OfflineModels()).collect()} == {"models offline"}
    pages = spark.createDataFrame([(1, 7)], "page_id long, document_id long")
    docs = spark.createDataFrame([(7, True)], "doc_id long, active boolean")
    assert incremental.missing_documents(passages, pages, docs, vectors).collect() == [(7, 2)]


def test_requeue_and_counters(spark):
    docs = spark.createDataFrame([(1, "indexed"), (2, "failed")], "doc_id long, state string")
    pages = spark.createDataFrame([(1, "ocr unavailable: no engine"), (1, None), (2, "other")], "document_id long, warning string")
    assert dict(incremental.requeue_failed_ocr(docs, pages).collect()) == {1: "pending", 2: "failed"}
    outcomes = spark.createDataFrame([("indexed",), ("failed",), ("unchanged",), ("indexed",)], "outcome string")
    assert tuple(incremental.job_counters(outcomes).first()) == (4, 2, 1)


def test_latest(spark):
    df = spark.sql("SELECT * FROM VALUES (1, 'a', timestamp'2024-01-01'), (1, 'b', timestamp'2024-01-02'), (2, 'c', null) AS t(id, v, loaded_at)")
    assert {r["id"]: r["v"] for r in latest(df, "id").collect()}[1] == "b"


def test_adaptive_batches():
    def run(limit):
        def f(batch, device):
            if len(batch) > limit:
                raise RuntimeError("CUDA out of memory")
            return list(batch)

        return f

    assert models.adaptive_batches(list(range(8)), run(2), 8) == (list(range(8)), [8, 4, 2, 2, 2, 2])
    with pytest.raises(models.ModelOutOfMemoryError):
        models.adaptive_batches([1, 2, 3, 4], run(0), 4, ("cuda", "cpu"))
    tried = []

    def only_cpu(batch, device):
        tried.append((len(batch), device))
        if device == "cuda":
            raise MemoryError()
        return batch

    assert models.adaptive_batches([1, 2], only_cpu, 2, ("cuda", "cpu"))[0] == [1, 2] and tried == [(2, "cuda"), (1, "cuda"), (1, "cpu"), (1, "cpu")]
    with pytest.raises(ValueError):
        models.adaptive_batches([1], lambda b, d: (_ for _ in ()).throw(ValueError("shape")), 1)
    assert models.device_order({"cuda": 2.0}, 3.0) == ("cpu",) and models.device_order({"cuda": 4.0, "mps": 1.0}, 3.0) == ("cuda", "mps", "cpu")
    assert models.models_of_profile("exact") is None and models.models_of_profile("any")[2] == 1.5


def test_files(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.pdf").write_text("Marine steel fasteners with a corrosion resistant coating, in one text of over fifty characters.\fshort")
    (tmp_path / "sub" / "b.pdf").write_bytes(b"%PDF-1.4 /Encrypt")
    (tmp_path / "C.PDF").write_text("x")
    found = files.discover(spark, [str(tmp_path), str(tmp_path / "sub"), str(tmp_path / "missing")]).collect()
    assert sorted(os.path.basename(r["path"]) for r in found) == ["a.pdf", "b.pdf"]
    assert files.discover(spark, [str(tmp_path / "missing")]).count() == 0
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.pdf").load(str(tmp_path))
    rows = {(os.path.basename(r["path"]), r["page_number"]): r for r in files.extract(raw, files.PlainTextExtractor()).collect()}
    assert rows["a.pdf", 1]["extraction_method"] == "native" and rows["a.pdf", 2]["warning"].startswith("OCR unavailable:")
    assert rows["b.pdf", None]["error"] == "PDF is password protected"
    seen = files.extract(raw.filter(F.col("path").endswith("a.pdf")), files.PlainTextExtractor(), ocr=lambda content, n: "read by eye").orderBy("page_number").collect()
    assert [r["extraction_method"] for r in seen] == ["native", "ocr"] and seen[1]["text"] == "read by eye"
    assert len(files.with_sha256(spark, [str(tmp_path)]).first()["sha256"]) == 64


def test_scan(spark, tmp_path):
    files_, store = tmp_path / "files", str(tmp_path / "store")
    files_.mkdir()
    (files_ / "a.pdf").write_text("Marine steel fasteners with a corrosion resistant coating, in one text of over fifty characters.\fA second page that tells of other bolts and nuts, long enough to stand on its own.")
    (files_ / "b.pdf").write_bytes(b"%PDF-1.4 /Encrypt")
    (files_ / "c.pdf").write_text("Carbon steel bolts of many sizes and their tightening torques, which stand in the table below.")
    root = spark.createDataFrame([(1, str(files_))], "root_id long, path string").selectExpr("root_id", "path", "current_timestamp() AS created_at", "cast(null AS timestamp) AS last_scanned_at")
    snapshots.save(store, source_roots=root)
    load = lambda n: snapshots.load(spark, store, n)
    states = lambda: {r["title"]: (r["state"], r["active"], r["error"], r["page_count"]) for r in load("documents").collect()}
    run = lambda embedder=None, **more: scan.scan(spark, store, files.PlainTextExtractor(), embedder, **more)
    counters = lambda j: (j["state"], j["total_files"], j["processed_files"], j["indexed_files"], j["failed_files"])

    # models are offline: documents are indexed with the error
    assert counters(run(models.OfflineModels())) == ("completed", 3, 3, 2, 1)
    assert states() == {"a": ("indexed", True, "models offline", 2), "b": ("failed", True, "PDF is password protected", 0), "c": ("indexed", True, "models offline", 1)}
    assert load("passages").filter("embedding_id is null").count() == 3 and load("source_roots").first()["last_scanned_at"]
    page = load("pages").filter("text like 'Marine%'").withColumn("words", layout.unpack_layout(F.col("layout_json"))).first()
    assert [w["t"] for w in page["words"]] == page["text"].split() and all(page["text"][w["s"] : w["e"]] == w["t"] for w in page["words"]) and page["words"][1]["x"] == round(71 / 595, 6)
    # unchanged, but backfilled: counts as indexed, the error goes; the failed file is tried again
    assert counters(run(models.PerWorker("four", lambda: models.HashEmbedder(4)))) == ("completed", 3, 3, 2, 1)
    assert states()["a"] == ("indexed", True, None, 2) and load("passage_vectors").count() == 3 == load("passages").filter("embedding_id = passage_id").count()
    before = {r["page_id"] for r in load("pages").collect()}
    assert counters(run(models.HashEmbedder(4))) == ("completed", 3, 3, 0, 1)
    # one changed, one new, one gone
    (files_ / "c.pdf").unlink()
    (files_ / "a.pdf").write_text("Only one page is left of this text, which had two of them, about marine steel fasteners.")
    os.utime(files_ / "a.pdf", (1, 1))
    (files_ / "d.pdf").write_text("A new text about spindles and valves that is longer than fifty characters, as it should be.")
    assert counters(run(models.HashEmbedder(4))) == ("completed", 3, 3, 2, 1)
    assert {k: v[:2] for k, v in states().items()} == {"a": ("indexed", True), "b": ("failed", True), "c": ("indexed", False), "d": ("indexed", True)}
    assert load("passages").filter("active").count() == 2 and load("passages").count() == 3 and load("passage_vectors").count() == 3
    assert len({r["page_id"] for r in load("pages").collect()} & before) == 2
    # cancelled and single flight
    asked = iter([False, False, True])
    have = load("documents").collect()
    assert run(cancelled=lambda: next(asked))["state"] == "cancelled" and load("documents").collect() == have
    snapshots.save(store, index_jobs=load("index_jobs").withColumn("state", F.when(F.col("job_id") == 1, "running").otherwise(F.col("state"))))
    second = run()
    assert (second["state"], second["error"]) == ("failed", scan.BUSY)
    assert incremental.document(load("documents"), have[0]["doc_id"]).count() == 1
    with pytest.raises(LookupError):
        incremental.document(load("documents"), -1)


def test_roots_and_snapshots(spark, tmp_path):
    have = spark.createDataFrame([(1, "/x", None)], "root_id long, path string, created_at timestamp")
    more = roots.added(have, str(tmp_path))
    assert more.count() == 2
    for path, status in ((str(tmp_path / "no"), 400), (str(tmp_path), 409)):
        with pytest.raises(roots.SourceError) as e:
            roots.added(more, path)
        assert e.value.status == status
    assert roots.removed(more, 1).count() == 1
    with pytest.raises(roots.SourceError):
        roots.removed(more, 5)
    store = str(tmp_path / "store")
    snapshots.save(store, roots=have, other=more)
    snapshots.save(store, roots=more)
    assert snapshots.load(spark, store, "roots").count() == 2 and snapshots.load(spark, store, "other").count() == 2 and snapshots.stored(spark, store) == {"roots", "other"}
    with pytest.raises(Exception, match="(?i)exists"):
        snapshots.publish(spark, f"{store}/_commits", 2, {})


def test_stream(spark, tmp_path):
    schema = "page_id long, text string"
    source, target, check = (str(tmp_path / x) for x in ("in", "out", "check"))
    spark.createDataFrame([(1, "a b c")], schema).write.parquet(source)
    df = spark.read.parquet(source)
    ingest.ingest_available(spark, source, df.schema, target, check)
    spark.createDataFrame([(2, "d")], schema).write.mode("append").parquet(source)
    ingest.ingest_available(spark, source, df.schema, target, check)
    assert sorted((r["page_id"], r["text"]) for r in spark.read.parquet(target).collect()) == [(1, "a b c"), (2, "d")]


def test_components(spark):
    edges = [(1, 2), (2, 3), (10, 11), (5, 5)] + [(i, i + 1) for i in range(100, 140)]
    got = dict(connected_components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {1: 1, 2: 1, 3: 1, 10: 10, 11: 10} | {i: 100 for i in range(100, 141)}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_pages_by_day_as_stream_and_table(spark, tmp_path):
    source, check = str(tmp_path / "in"), str(tmp_path / "check")
    spark.sql("SELECT * FROM VALUES (timestamp'2024-01-01 10:00:00', 'ocr'), (timestamp'2024-01-01 11:00:00', 'ocr'), (timestamp'2024-01-09 11:00:00', 'native') AS t(loaded_at, extraction_method)").write.parquet(source)
    df = spark.read.parquet(source)
    want = {(str(r["day"]), r["extraction_method"], r["pages"]) for r in ingest.pages_by_day(df).collect()}
    assert want == {("2024-01-01 00:00:00", "ocr", 2), ("2024-01-09 00:00:00", "native", 1)}
    query = ingest.pages_by_day(spark.readStream.schema(df.schema).parquet(source)).writeStream.format("memory").queryName("days").outputMode("complete").option("checkpointLocation", check).trigger(availableNow=True).start()
    query.awaitTermination()
    assert {(str(r["day"]), r["extraction_method"], r["pages"]) for r in spark.table("days").collect()} == want


def test_entry_lists_every_query_with_its_sql():
    import __spark_entry__ as entry

    names, sql = entry.queries(), entry.oracle_sql()
    assert sql.keys() <= names.keys() and all(callable(q) for q in names.values()) and "hybrid_search" in names
