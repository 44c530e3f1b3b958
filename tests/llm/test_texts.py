"""Repeated lines, scanned pages, look-alikes, token ids, encodings."""

import random

import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pagequarry.llm import encoding, lines, lookalikes, mojibake, scans, words
from pagequarry.llm.perceptron import AveragedPerceptron

PAGES = "page_id long, document_id long, page_number int, text string, extraction_method string"


def test_repeated_lines(spark):
    notice = ["Rate this sheet number {} with one to five stars", "  RATE this   sheet number {} with one to five STARS ", "Rate this sheet number {}, with one to five stars"]
    rows = [(i, i, 1, f"Body text {i} of its own with many letters {'x' * i}\n{notice[i % 2].format(i)}\nshort 1", "native") for i in range(8)]
    rows += [(20, 20, 1, notice[2].format(1), "native"), (21, 21, 1, notice[0].format(5), "native"), (22, None, 1, notice[0].format(5), "native"), (23, 0, 1, None, "native"), (24, 0, 1, "", "native"), rows[0]]
    docs = [(i, "one") for i in range(8)] + [(20, "one"), (21, None), (0, "one")]
    pages = spark.createDataFrame(rows, PAGES).withColumn("source", F.lit("clash")).withColumn("norm", F.lit(1))
    documents = spark.createDataFrame(docs, "doc_id long, source string")
    got = {(r["page_id"], r["line_no"]) for r in lines.repeated_lines(pages, documents).collect()}
    assert got == {(i, 2) for i in range(8)}
    found = lines.repeated_lines(pages, documents)
    clean = {r["page_id"]: r["text"] for r in lines.without_lines(pages, found).collect()}
    assert clean[1] == "Body text 1 of its own with many letters x\nshort 1" and clean[23] is None and clean[24] == "" and clean[20] == notice[2].format(1)
    assert lines.repeated_lines(pages.limit(0), documents).count() == 0
    assert lines.repeated_lines(pages, documents.limit(0)).count() == 0
    assert lines.repeated_lines(pages, documents, min_documents=9).count() == 0


def test_documents_are_counted_once_over_all_partitions(spark, tmp_path):
    """A document of many pages in many partitions is one document of its lines; a small documents file is broadcast, so pages stay where they are."""
    line = "please keep this sheet for later use"
    pages = spark.createDataFrame([(i, i % 5 if i < 60 else 1, 1, line if i < 60 else line.replace("later", "other"), "native") for i in range(120)], PAGES).repartition(16, "page_id")
    spark.createDataFrame([(i, "one") for i in range(6)], "doc_id long, source string").write.parquet(str(tmp_path / "documents"))
    documents = spark.read.parquet(str(tmp_path / "documents"))
    assert lines.repeated_lines(pages, documents).count() == 0
    more = pages.unionByName(spark.createDataFrame([(200, 5, 1, line, "native")], PAGES))
    assert {r["page_id"] for r in lines.repeated_lines(more, documents).collect()} == {*range(60), 200}


def test_merged_templates_lose_no_line(spark):
    """The trees of many partitions merge to templates of many slots; every line of enough documents is still found, and no other."""
    rng = random.Random(2)
    rows = []
    for c in range(48):
        for v in range(6):
            words_ = [f"start{c % 8}", "beta", "gamma", *(rng.choice("abcdefgh") + rng.choice(["x", f"q{c}"]) for _ in range(7))]
            rows += [(len(rows) + i, len(rows) + i, 1, " ".join(words_) + " of the lines", "native") for i in range(rng.choice([2, 5, 6, 9]))]
    pages = spark.createDataFrame(rows, PAGES).repartition(16, "page_id")
    documents = spark.createDataFrame([(r[0], "one") for r in rows], "doc_id long, source string")
    count = {}
    for r in rows:
        count.setdefault(r[3], set()).add(r[0])
    want = {i for x, ids in count.items() if len(ids) >= 6 and sum(map(str.isalpha, x)) >= 20 for i in ids}
    for broadcast in ("-1", "10485760"):
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
        try:
            assert {r["page_id"] for r in lines.repeated_lines(pages, documents).collect()} == want
        finally:
            spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_whole_templates(spark):
    names = "anna bert carla dora emil fritz gerda hans".split()
    rows = [(i, i, 1, f"Written and checked by our colleague {n} in the workshop\nA line of its own that is number {n * 9}", "native") for i, n in enumerate(names)]
    pages = spark.createDataFrame(rows, PAGES)
    documents = spark.createDataFrame([(i, "one") for i in range(8)], "doc_id long, source string")
    got = lines.repeated_templates(pages, documents).collect()
    assert {(r["page_id"], r["line_no"], r["template"]) for r in got if r["line_no"] == 1} == {(i, 1, "written and checked by our colleague <*> in the workshop") for i in range(8)}
    assert lines.repeated_lines(pages, documents).count() == 0


def test_templates_have_slots():
    leaf = lines.Leaf(0.6)
    for x in ("copy 0 of the sheet", "copy 0 of that sheet", "other words are not here"):
        leaf.add(x.split(), 1)
    assert leaf.templates == [["copy", "0", "of", lines.SLOT, "sheet"], ["other", "words", "are", "not", "here"]]
    assert leaf.match("copy 0 of every sheet".split()) == 0 and leaf.match("a b c d e".split()) is None
    assert leaf.match(["copy", "of", lines.SLOT, lines.SLOT, lines.SLOT]) is None  # slots do not raise a match
    assert leaf.covering("copy 0 of any sheet".split()) == 0 and leaf.covering("copy 1 of any sheet".split()) is None


@pytest.mark.parametrize("parts", [1, 8])
def test_weighted_edits_do_not_depend_on_partitions(spark, parts):
    texts = ["bearing bearing bearing", "gasket gasket", "beаrng gаskett gаskеt", "zеbra", "bering bering", "Ꭺcid acid"]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "page_id long, text string").repartition(parts)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        got = {r["token"]: r["canonical"] for r in lookalikes.canonical_tokens(df, max_cost=1).collect()}
        none = {r["token"]: r["canonical"] for r in lookalikes.canonical_tokens(df).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert got == {"beаrng": "bearing", "gаskett": "gasket", "gаskеt": "gasket", "zеbra": "zebra", "Ꭺcid": "acid"}
    assert none == got | {"beаrng": "bearng", "gаskett": "gaskett"}


def noisy(text, rng):
    swaps = {"l": "1", "o": "0", "m": "rn", "d": "cl", "e": "c"}
    out = []
    for w in text.split():
        if rng.random() < 0.15 and any(c in w for c in swaps):
            c = rng.choice([c for c in w if c in swaps])
            w = w.replace(c, swaps[c], 1)
        out.append(w)
    return " ".join(out)


@pytest.fixture(scope="module")
def scanned(spark):
    rng = random.Random(4)
    vocabulary = "the valve housing model clamp module needle spindle bottle handle middle panel modern metal model old cold meadow lemon melon domed dental medal model remodel".split()
    documents, pages, truth = [], [], set()
    for d in range(150):
        body = [rng.choice(vocabulary) for _ in range(60)]
        clean = " ".join(body)
        title = f"Maker {chr(65 + d % 20)}B-{d} data sheet"
        seen, k = [], 0
        while k < 60:
            part = body[k : k + 8]
            k += 8
            line = [part[0], *noisy(" ".join(part[1:]), rng).split()]  # the rest of a broken word stays as it is
            for a, b in zip(line, part):
                if a != b:
                    truth.add((d, len(seen) + 2, "misread", b))
            if k < 60 and len(body[k]) > 5 and rng.random() < 0.5:
                w = body[k]
                line.append(w[:3] + "-")
                truth.add((d, len(seen) + 2, "hyphen", w))
                seen.append(" ".join(line))
                body[k] = w[3:]
                continue
            seen.append(" ".join(line))
        text = "\n".join([title, *seen, f"- {d} -"])
        truth |= {(d, 1, "header", ""), (d, len(seen) + 2, "page_number", "")}
        documents.append((d, title, clean))
        pages.append((d, d, d, text, "ocr"))
    pages += [(900, 1, 1, None, "ocr"), (901, 1, 1, "", "ocr"), (902, 1, 1, pages[0][3], "native"), (903, None, 1, "lone text of no document", "ocr"), pages[0], (904, 1, 1, pages[1][3], None)]
    return spark.createDataFrame(pages, PAGES).withColumn("word", F.lit("clash")), spark.createDataFrame(documents, "doc_id long, title string, text string"), truth


def test_scan_noise(scanned):
    pages, documents, truth = scanned
    got = {tuple(r) for r in scans.scan_noise(pages, documents).select("page_id", "line_no", "kind", "word").collect()}
    for kind, recall, precision in (("header", 1.0, 1.0), ("page_number", 1.0, 1.0), ("hyphen", 0.9, 0.9), ("misread", 0.6, 0.8)):
        g, t = ({x for x in s if x[2] == kind} for s in (got, truth))
        assert len(g & t) >= recall * len(t), kind
        assert len(g & t) >= precision * len(g), kind
    assert scans.scan_noise(pages.limit(0), documents).count() == 0
    assert {r["kind"] for r in scans.scan_noise(pages, documents.limit(0)).collect()} <= {"page_number", "hyphen"}


def test_repair():
    text = "Maker data sheet\nThe va1ve of one va1ue, hou-\n\nsing is cold.\n\nLow-\nfriction parts - and\nso on\n- 3 -"
    marks = [(1, "header", "", None), (2, "hyphen", "housing", None), (2, "misread", "valve", "va1ve"), (2, "misread", "value", "va1ue"), (9, "page_number", "", None)]
    assert scans.repair(text, marks) == "The valve of one value, housing is cold.\n\nLow-friction parts - and so on"
    assert scans.repair("", []) == ""


def test_edits_round_trip():
    for seen, right in (("turnbuck1e", "turnbuckle"), ("titariium", "titanium"), ("acljusted", "adjusted"), ("morn", "mom"), ("same", "same"), ("h0ld", "hold")):
        assert "".join(c if e == "=" else e for c, e in zip(seen, scans.edits(seen, right))) == right


def test_perceptron_learns():
    data = [([f"c{i % 3}", "bias"], "abc"[i % 3]) for i in range(60)]
    model = AveragedPerceptron().train(data, epochs=20)
    assert all(model.predict(f) == c for f, c in data)


def test_numbers_and_titles():
    for x in ("- 2 -", "Page 5", "3 / 3", "[206]", "262", "Seite 3 von 7", "стр. 4"):
        assert scans._NUMBER.match(x), x
    for x in ("12 mm", "No. 7 valve", "2 parts", ""):
        assert not scans._NUMBER.match(x), x
    assert scans.title_share("5  MOUNTING · N0kit Werke AB-1 data sheet", scans.title_words("Nokit_Werke_AB-1_data_sheet")) == (1.0, 1)


TERMS = [(1, "Größenprofil RPB-7988 B2"), (2, "Pièce d'arrêt TPC-6480 XC"), (3, "короб насоса kisat 6439"), (4, "Hex cap TJA-8882"), (5, None), (6, " ")]
SHOWN = {
    1: ["GRÖSSENPROFIL RPB-7988 B2", "Größеnprоfіl RРВ‐7988 В2", "Größen­profil RPB-‍7988\nB2"],
    2: ["Piеcè x", "Ріèсe d’аrrêt TРС-6480 ХС", "ＰＩÈＣＥ d'arrêt tpc-6480 xc9"],
    3: ["КОРОБ НАСОСА KISAT 6439", "кopоб нaсoca　kisat​ 643⁠9"],
    4: ["hex  cap tja－8882", "Hex cap TJA-8882"],
}


def test_terms_are_found_in_any_dress(spark):
    rows, want, n = [], set(), 0
    for t, texts in SHOWN.items():
        for x in texts:
            rows.append((n, f"before {x} after"))
            if x != "Piеcè x":
                want.add((t, n))
            n += 1
    rows += [(90, "Größenprofil RPB-7988 B0"), (91, "Piece d'arret TPC-6480 XC"), (92, None), (93, ""), (94, "Hex cap TJA-888Z"), (0, rows[0][1])]
    pages = spark.createDataFrame(rows, "page_id long, text string").withColumn("token", F.lit("clash")).withColumn("canonical", F.lit(1))
    terms = spark.createDataFrame(TERMS, "term_id long, term string")
    assert {tuple(r) for r in lookalikes.find_terms(pages, terms).collect()} == want
    assert lookalikes.find_terms(pages, terms.limit(0)).count() == 0
    assert lookalikes.find_terms(pages.limit(0), terms).count() == 0
    large = pages.unionByName(spark.createDataFrame([(2**62 + 1, "Hex cap TJA-8882", "x", 1), (None, "Hex cap TJA-8882", "x", 1)], pages.schema))
    assert {tuple(r) for r in lookalikes.find_terms(large, terms).collect()} == want | {(4, 2**62 + 1)}
    canon = {r["page_id"]: r["canonical"] for r in lookalikes.canonical_text(large).collect()}
    assert canon[None] == canon[2**62 + 1] == "hex cap tja-8882"
    assert canon[92] is None and canon[93] == "" and canon[90] == "größenprofil rpb-7988 b0".replace("ß", "ss")


def test_trie():
    t = lookalikes.Trie()
    t.add("xc", 5)
    t.add("pièce", 1)
    t.add("хс", 1)
    best = lambda token, cost=0: (t.nearest(token, cost) or [None])[-1]
    assert best("ХС") == "xc" and best("Pіèс​e") == "pièce" and best("xb") is None
    assert best("xb", 1) == "xc" and best("pice", 1) is None and best("pièc", 1) == "pièce" and best("xxc", 1) == "xc"


def test_rare_spelling_goes_to_the_vocabulary(spark):
    pages = spark.createDataFrame([(i, "plain axle") for i in range(5)] + [(9, "plain аxlе")], "page_id long, text string")
    forms = dict(lookalikes.canonical_tokens(pages).collect())
    assert forms == {"аxlе": "axle"}


def test_token_ids(spark):
    path = encoding.VOCABULARY
    texts = ["Hello world", "", None, "naïve “Ångström” 東京 🙂", "<|endoftext|> is text", " " * 3000 + "x", "word " * 20_000]
    df = spark.createDataFrame(list(enumerate(texts)) + [(0, texts[0])], "doc_id long, text string").withColumn("key", F.lit(1)).withColumn("ids", F.lit(2))
    rows = encoding.encode(df).collect()
    got = {r["doc_id"]: r["ids"] for r in rows}
    assert len(rows) == len(texts) + 1 and got[1] == [] and got[2] == []
    import base64
    import os

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(os.path.join(os.path.dirname(path), "byte_bpe_50k.tiktoken"), "rb"))}
    pattern = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
    other = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    for i, t in enumerate(texts):
        assert got[i] == (other.encode_ordinary(t) if t else []), i
        if t:
            assert encoding.decode_ids(got[i]) == t
            cuts = encoding.byte_offsets(t, got[i])
            assert b"".join(t.encode()[a:b] for a, b in cuts) == t.encode() and cuts[-1][1] == len(t.encode())
    assert encoding.encode(df.limit(0)).count() == 0
    assert {r["doc_id"]: r["n_tokens"] for r in encoding.count_tokens(df).collect()} == {i: len(g) for i, g in got.items()}
    with pytest.raises(ValueError):
        encoding.byte_offsets("other", got[0])
    made = encoding.encode(df).withColumn("text", F.lit("clash")).withColumn("ends", F.lit(0)).unionByName(spark.createDataFrame([(50, None, "", 0)], "doc_id long, ids array<int>, text string, ends int"))
    assert {r["doc_id"]: r["text"] for r in encoding.decode(made).collect()} == {i: t or "" for i, t in enumerate(texts)} | {50: ""}
    ends = {r["doc_id"]: r["ends"] for r in encoding.offsets(made).collect()}
    assert all(ends[i] == [b for _, b in encoding.byte_offsets(t or "", got[i])] for i, t in enumerate(texts)) and ends[50] == []
    assert encoding.decode(made.limit(0)).count() == 0 == encoding.offsets(made.limit(0)).count()


CLEAN = ["Für die Führung gilt 5 °C über den Kühler", "Le réglage près de la pièce vérifié", "Если насос не проверен, следует заменить резьба", "Ø 5 mm – the operator’s “valve”"]


def test_encodings_are_repaired(spark):
    broken = {
        100: CLEAN[0].encode().decode("cp1252", "replace"),
        101: CLEAN[1].encode().decode("latin-1"),
        102: CLEAN[2].encode("cp1251").decode("cp1252"),
        103: CLEAN[2].encode("cp1251").decode("koi8_r"),
        104: CLEAN[0].encode("cp1252").decode("cp437"),
        105: CLEAN[1].encode().decode("cp1252").encode().decode("cp1252"),
        106: "Le r�glage fin",
        107: CLEAN[2].encode().decode("cp866"),
    }
    whole = {100: CLEAN[0], 101: CLEAN[1], 102: CLEAN[2], 103: CLEAN[2], 104: CLEAN[0], 105: CLEAN[1], 106: "Le réglage fin", 107: CLEAN[2]}
    rows = [(i, CLEAN[i % 4]) for i in range(60)] + list(broken.items()) + [(200, None), (201, ""), (202, "Modelo SÃO, RAÇÃO «Ã» ¶ § ¤ ├──┤ √2"), (203, "CHÂSSIS BÂTI Ðelta"), (204, "lost ��qx")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("word", F.lit("clash")).withColumn("pos", F.lit(1))
    found = {r["doc_id"] for r in mojibake.damaged_tokens(df).collect()}
    assert found == set(broken) | {204}
    fixed = {r["doc_id"]: r for r in mojibake.restore(df).collect()}
    for i, t in whole.items():
        assert fixed[i]["text"] == t, i
    assert fixed[200]["text"] is None and fixed[201]["text"] == "" and fixed[204]["text"] == "lost ��qx" and fixed[204]["n_damaged"] == 1 and fixed[204]["n_restored"] == 0
    assert all(fixed[i]["text"] == t and fixed[i]["n_damaged"] == 0 for i, t in rows[:60])
    assert mojibake.damaged_tokens(df.limit(0)).count() == 0


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="aéüñßиж “”–", min_size=1, max_size=12))
def test_channels_undo_wrong_decoding(t):
    for wrong in ("latin-1", "cp437", "cp866"):
        seen = t.encode().decode(wrong)
        if seen != t:
            assert mojibake.decode(seen, f"{wrong}>utf-8", {}) == t


def test_viterbi_keeps_to_one_channel():
    assert mojibake.viterbi([[("a", 5.0)], [("a", 1.5), ("b", 2.0)], []]) == ["a", "a", ""]
    assert mojibake.viterbi([[("a", 0.5)], []]) == ["", ""]


def test_word_counts(spark):
    df = spark.createDataFrame([("“One, two” two", "x"), (None, None), ("", "two")], "a string, b string")
    assert dict(words.count_words(df, "a", "b").collect()) == {"One": 1, "two": 3, "x": 1}


def test_all_that_the_table_changes_takes_the_slow_path(spark):
    """Each page has one such character and no other that would send it there."""
    marks = ["Piece d\u02bcarret", "Piece d\u00b4arret", "Piece d`arret", "Piece d\u2032arret", "Pi\u3164ece d'arret", "Piece\u061c d'arret", "Pie\u115fce d'arret", "Piece d'ar\U000e0041ret", "\U0001d40fiece d'arret"]
    rows = [*marks, "piece d'arret", "piece darret", "set to 5 \u00b5A", None]
    pages = spark.createDataFrame(list(enumerate(rows)), "page_id long, text string")
    terms = spark.createDataFrame([(1, "Piece d'arret"), (2, "5 \u00b5A")], "term_id long, term string")
    got = {tuple(r) for r in lookalikes.find_terms(pages, terms).collect()}
    assert got == {(1, i) for i in range(len(marks) + 1)} | {(2, len(marks) + 2)}
