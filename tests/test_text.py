import sqlite3
import unicodedata
import zlib

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pagequarry.functions import layout, scores
from pagequarry.functions import text as tx


def test_normalize():
    assert tx.normalize("  ISO ４７６２  ") == "iso 4762"
    assert tx.normalize("STRAßE") == "strasse"
    assert tx.normalize(None) is None


def test_normalize_column(spark):
    df = spark.createDataFrame([(1, " ＡＢ\n c "), (2, None), (3, "")], "id int, t string")
    assert dict(df.select("id", tx.normalize_text("t")).collect()) == {1: "ab c", 2: None, 3: ""}


@settings(max_examples=200, deadline=None)
@given(st.text())
def test_normalize_is_stable_on_its_words(s):
    n = tx.normalize(s)
    assert n == n.strip() and "\n" not in n and "  " not in n


TEXTS = ["Über die Straße, naïve ÇA-12", "foo_bar foo bar", "Pièce d’arrêt TPC-6480", "Привет, ёлка Й", "x² ½ A4-80", "", "Pièce café", "ＡＢ"]


def test_terms_equal_those_of_the_full_text_index(spark):
    """The index of SQLite uses the same rules; its vocabulary table shows the terms."""
    db = sqlite3.connect(":memory:")
    db.execute("CREATE VIRTUAL TABLE f USING fts5(t, tokenize='unicode61 remove_diacritics 2')")
    db.executemany("INSERT INTO f(rowid, t) VALUES (?, ?)", [(i, t) for i, t in enumerate(TEXTS)])
    db.execute("CREATE VIRTUAL TABLE v USING fts5vocab(f, 'instance')")
    want = {i: [] for i in range(len(TEXTS))}
    for term, doc, _col, off in db.execute("SELECT term, doc, col, offset FROM v ORDER BY doc, offset"):
        want[doc].append(term)
    df = spark.createDataFrame(list(enumerate(TEXTS)), "i int, t string")
    got = {r[0]: list(r[1]) for r in df.select("i", tx.terms(F.col("t"))).collect()}
    assert got == want


def test_query_tokens():
    assert tx.query_tokens('Ölfilter "foo_bar" 12') == [["olfilter"], ["foo", "bar"], ["12"]]
    assert tx.query_tokens(" -- ") == []


def test_words_and_offsets(spark):
    df = spark.createDataFrame([(1, "ab  c\nde"), (2, None), (3, " \n ")], "i int, t string")
    got = {r["i"]: r for r in df.select("i", tx.words(F.col("t")).alias("w")).select("i", "w", layout.word_offsets(F.col("w")).alias("o")).collect()}
    assert got[1]["w"] == ["ab", "c", "de"] and got[2]["w"] == [] and got[3]["w"] == []
    assert [(x["t"], x["s"], x["e"]) for x in got[1]["o"]] == [("ab", 0, 2), ("c", 3, 4), ("de", 5, 7)]
    assert got[2]["o"] == []


def test_layout_round_trip(spark):
    word = {"i": 0, "t": "Öl", "s": 0, "e": 2, "x": 0.1, "y": 0.2, "w": 0.3, "h": 0.4, "b": 0, "l": 1, "o": 2}
    df = spark.createDataFrame([(1, bytearray(layout.pack_layout([word]))), (2, None), (3, bytearray(b"no layout")), (4, bytearray(zlib.compress(b"[]")))], "i int, b binary")
    got = dict(df.select("i", layout.unpack_layout(F.col("b"))).collect())
    assert got[1][0].asDict() == word and got[2] is None and got[3] is None and got[4] == []


def test_ocr_gate(spark):
    df = spark.createDataFrame([(49, 30, 0.0), (50, 9, 0.5), (50, 9, 0.4), (9, 1, 0.0), (80, 20, 1.0)], "n int, w int, c double")
    assert [tuple(r) for r in df.select(layout.needs_ocr(F.col("n"), F.col("w"), F.col("c")), layout.full_ocr(F.col("n"))).collect()] == [(True, False), (True, False), (False, False), (True, True), (False, False)]
    rects = spark.sql("SELECT array(named_struct('x0', 0.0D, 'y0', 0.0D, 'x1', 2.0D, 'y1', 3.0D), named_struct('x0', 1.0D, 'y0', 1.0D, 'x1', 2.0D, 'y1', 2.0D)) AS r")
    assert rects.select(layout.image_coverage(F.col("r"), F.lit(14.0))).first()[0] == 0.5


def test_scores(spark):
    df = spark.createDataFrame([([3.0, 4.0], [1.0, 2.0]), ([0.0, 0.0], [1.0, 1.0])], "a array<float>, b array<float>")
    rows = df.select(scores.inner_product(F.col("a"), F.col("b")), scores.l2_normalized(F.col("a"))).collect()
    assert rows[0][0] == 11.0 and [round(x, 5) for x in rows[0][1]] == [0.6, 0.8] and rows[1][1] == [0.0, 0.0]
    one = spark.range(1).select(scores.sigmoid(F.lit(0.0)), scores.sigmoid(F.lit(-1e9)), scores.rrf_term(F.lit(1)), scores.rrf_term(F.lit(None).cast("int"))).first()
    assert one[0] == 0.5 and 0 < one[1] < 1e-12 and one[2] == 1 / 61 and one[3] == 0.0


def test_accent_table_is_from_unicode():
    for a, b in zip(tx.ACCENTED, tx.PLAIN):
        assert unicodedata.normalize("NFD", a)[0] == b
