"""Problem 3: noise in the text of scanned pages.

Method: an averaged-perceptron character editor. For every character of a token it predicts what is put in
its place: the character itself (keep), another (replace), none (delete) or two (insert); for the break at a line's end a second
perceptron predicts joining with or without the hyphen; a third one tells running lines from text by their place on the page.
All three are trained on a bounded sample of pages (``sample_pages``) that is aligned with the clean reading text of their documents.
The editor's best edits are held against the corpus vocabulary, which counts all documents and native pages; an unknown token is
replaced by the known word that scores best, if that is at least twice as frequent.

Kinds found: header (a line with the document's running title at top or bottom), page_number, hyphen (a word broken at the line's end, with the whole
word), misread (with the right word). ``seen`` has the word as it was read, for the repair. A token of one character, a part number by its shape, and one of
over ``LONGEST`` characters, which is no word of these languages, is never a misread; a word is given one edit for each three characters, and three at least. Confusions that training
shows for under 3 % of a character's edits are left out. Defined results: null and empty texts, null methods and pages of other methods give nothing; rows
delivered twice count once; a document without a title has no headers; without clean text to learn from (an empty sample) the editor keeps everything.
"""

from __future__ import annotations

import difflib
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagequarry.frames import objects, records
from pagequarry.llm.perceptron import AveragedPerceptron
from pagequarry.llm.words import core, count_words
from pagequarry.session import broadcast_if_small, cut, smallest_hashes

HYPHENS = "-‐‑¬­"
_NUMBER = re.compile(r"^\W*(?:(?:page|seite|página|pág\.?|стр\.?|страница|blatt|p\.|s\.)\s*)?(\d{1,5})\W*(?:(?:/|of|von|sur|de|из)\s*\d{1,5}\W*)?$", re.I)
CODE = r"^[A-ZА-Я]{2,}[- ]?[0-9]+$"  # part numbers are no words
LONGEST = 100
_ALNUM = re.compile(r"[^\W_]+")
_FOLD = str.maketrans("015689", "olsbbg")


# ---- lines

def title_words(title: str) -> list[str]:
    return [w.translate(_FOLD) for w in _ALNUM.findall(title.lower())]


def title_share(line: str, title: list[str]) -> tuple[float, int]:
    """The share of the title's words that the line has, and the number of its words that are neither of the title nor a number."""
    words = _ALNUM.findall(line.lower())
    folded = [w.translate(_FOLD) for w in words]
    have, wanted = set(folded), set(title)
    return (len(have & wanted) / len(wanted) if wanted else 0.0), sum(f not in wanted and not w.isdigit() for w, f in zip(words, folded))


def line_features(lines: list[str], i: int, filled: list[int], title: list[str]) -> list[str]:
    """Place on the page, likeness to the title and form of a line."""
    at = filled.index(i)
    x = lines[i].strip()
    top, bottom = min(at, 3), min(len(filled) - 1 - at, 6)
    share, others = title_share(x, title)
    edge = at < 3 or len(filled) - 1 - at < 8
    out = ["bias", f"edge{edge}", f"edge{edge} title{int(share * 5)} others{min(others, 3)}", f"edge{edge} number{bool(_NUMBER.match(x))}", f"top{top}", f"bottom{bottom}", f"title{int(share * 5)}", f"title{int(share * 5)}/{min(others, 3)}", f"others{min(others, 6)}", f"end{x[-1:] in '.!?:;,'}", f"length{min(len(x) // 10, 8)}"]
    if _NUMBER.match(x):
        out += ["number", f"number{top}/{bottom}", f"number bottom{bottom > 5 and top > 2}"]
    return out


# ---- characters

def edit_features(token: str, i: int) -> list[str]:
    p = f"  {token}  "
    a, b, c, d, e = p[i], p[i + 1], p[i + 2], p[i + 3], p[i + 4]
    kind = "9" if c.isdigit() else "A" if c.isupper() else "a"
    around = "".join("9" if x.isdigit() else "A" if x.isupper() else "a" if x.isalpha() else "." for x in (b, d))
    return [c, f"{kind}{around}", f"{b}{c}", f"{c}{d}", f"<{b}{c}{d}>", f"{a}{b}|{c}", f"{c}|{d}{e}", f"{a}{b}{c}{d}", f"{b}{c}{d}{e}"]


def edits(seen: str, right: str) -> list[str]:
    """What stands in the place of each character: '=' for itself, else the string put there."""
    out = []
    for op, i1, i2, j1, j2 in difflib.SequenceMatcher(None, seen, right, autojunk=False).get_opcodes():
        if op == "equal":
            out += ["="] * (i2 - i1)
        elif op == "insert":
            if out:
                out[-1] = (seen[i1 - 1] if out[-1] == "=" else out[-1]) + right[j1:j2]
        elif i2 - i1 == j2 - j1:
            out += list(right[j1:j2])
        else:
            out += [right[j1:j2]] + [""] * (i2 - i1 - 1)
    return out


class Confusions:
    """What the editor may put for a character: what training showed for it; a deletion goes with an edit of the character before."""

    def __init__(self, pairs: list[tuple[str, str]], least: int = 2, share: float = 0.03):
        put: Counter[tuple[str, str]] = Counter()
        gone: Counter[tuple[str, str]] = Counter()
        for seen, right in pairs:
            for i, e in enumerate(edits(seen, right)):
                if e == "":
                    gone[seen[i - 1 : i], seen[i]] += 1
                elif e != "=":
                    put[seen[i], e] += 1
        self.put: dict[str, list[str]] = {}
        total: Counter[str] = Counter()
        for (c, _), n in put.items():
            total[c] += n
        for (c, e), n in sorted(put.items()):
            if n >= max(least, share * total[c]):
                self.put.setdefault(c, []).append(e)
        self.gone = {k for k, n in gone.items() if n >= least}


def best_edits(model: AveragedPerceptron, confusions: Confusions, token: str, width: int = 16, least: int = 3) -> list[tuple[str, float]]:
    """The best outputs of the editor by a beam over characters, unchanged text left out; at most an edit for each three characters, or ``least``."""
    most = max(least, len(token) // 3)
    beam: list[tuple[float, str, int, bool]] = [(0.0, "", 0, False)]
    for i, c in enumerate(token):
        s = model.scores(edit_features(token, i))
        keep = s.get("=", 0.0)
        options = [(s.get(o, 0.0) - keep, o) for o in confusions.put.get(c, ())]
        drop = s.get("", 0.0) - keep if (token[i - 1 : i], c) in confusions.gone else None
        step = []
        for b, t, n, edited in beam:
            step.append((b, t + c, n, False))
            if n < most:
                step.extend((b + g, t + o, n + 1, True) for g, o in options)
            if drop is not None and edited:
                step.append((b + drop, t, n, True))
        beam = sorted(step, reverse=True)[:width]
    return [(t, b) for b, t, n, _ in beam if n and t != token]


def hyphen_features(left: str, mark: str, right: str, whole: int, compound: int) -> list[str]:
    f = lambda n: "0" if not n else "1" if n < 10 else "2"
    return ["bias", f"mark{mark}", f"known{f(whole)}{f(compound)}", f"compound{compound > 0}", f"whole{whole > 0}", f"small{right[:1].islower()}", f"capital{left[:1].isupper()}", f"left{left[-2:]}", f"right{right[:2]}", f"digits{any(c.isdigit() for c in left + right)}"]


# ---- pages

def breaks(lines: list[str]) -> Iterator[tuple[int, str, str, str]]:
    """(line index, left part, mark, right part) of each line that ends in a hyphen after a letter and goes on."""
    for i, x in enumerate(lines):
        x = x.rstrip(" ")
        if len(x) < 2 or x[-1] not in HYPHENS or not x[-2].isalnum():
            continue
        j = i + 1
        while j < len(lines) and not lines[j].strip():
            j += 1
        if j == len(lines):
            continue
        left, right = x[:-1].split(" ")[-1], lines[j].strip().split(" ")[0]
        left, right = re.sub(r"^[\W_]+", "", left), re.sub(r"[\W_]+$", "", right)
        if left and right and right[0].isalpha():
            yield i, left, x[-1], right


def parse_page(text: str, page_number: int, title: str | None) -> tuple[list[str], list[int], list[str]]:
    lines = text.split("\n")
    return lines, [i for i, x in enumerate(lines) if x.strip()], title_words(title or "")


def examples_of_page(text: str, page_number: int, title: str | None, clean: str) -> list[tuple[str, str, str]]:
    """(what, seen, label): labelled cases of a page, from its document's clean text."""
    words = [core(t) for t in clean.split()]
    known = set(words)
    between = {(a, c): b for a, b, c in zip(words, words[1:], words[2:])}
    lines, filled, t = parse_page(text, page_number, title)
    out: list[tuple[str, str, str]] = []
    tokens = [core(x) for x in text.split()]
    for a, b, c in zip(tokens, tokens[1:], tokens[2:]):
        right = between.get((a, c))
        if right is None or len(b) < 3 or not any(x.isalpha() for x in b):
            continue
        if right == b:
            if len(out) < 2:
                out.append(("edit", b, b))
        elif b not in known and abs(len(b) - len(right)) <= 2 and difflib.SequenceMatcher(None, b, right, autojunk=False).ratio() >= 0.5:
            out.append(("edit", b, right))
    for _, left, mark, right in breaks(lines):
        whole, compound = left + right in known, f"{left}-{right}" in known
        if whole != compound:
            out.append(("join" if whole else "keep", f"{left}\t{mark}\t{right}", ""))
    flat = f" {' '.join(clean.split())} "
    for before, i in zip([None, *filled], filled):
        x = " ".join(lines[i].split())
        share, others = title_share(x, t)
        if _NUMBER.match(x):  # a number of the text goes on from the line before
            kind = "text" if before is not None and f" {lines[before].split()[-1]} {x} " in flat else "page_number"
        else:
            kind = "text" if x in flat else "header" if share >= 0.6 and others <= 2 else "other"
        if kind != "text" or i % 4 == 0:
            out.append(("line", "\t".join(line_features(lines, i, filled, t)), kind))
    return out


class ScanModels:
    """The three perceptrons."""

    def __init__(self, rows: list[tuple[str, str, str]], known: dict[str, int], least: int = 3):
        edit, join, line = [], [], []
        for what, seen, label in rows:
            if what == "edit":
                edit += [(edit_features(seen, i), e) for i, e in enumerate(edits(seen, label))]
            elif what == "line":
                line.append((seen.split("\t"), label))
            else:
                left, mark, right = seen.split("\t")
                join.append((hyphen_features(left, mark, right, known.get(left + right, 0), known.get(f"{left}-{right}", 0)), what))
        self.confusions = Confusions([(seen, label) for what, seen, label in rows if what == "edit" and seen != label])
        count = Counter(e for _, e in edit)
        self.edit = AveragedPerceptron().train([x for x in edit if count[x[1]] >= least])
        self.join = AveragedPerceptron().train(join or [(["bias"], "join"), (["compoundTrue"], "keep")])
        self.line = AveragedPerceptron().train(line) if line else None

    def kind_of_line(self, lines: list[str], i: int, filled: list[int], title: list[str]) -> str:
        return self.line.predict(line_features(lines, i, filled, title)) if self.line else ""


def train(pages: DataFrame, documents: DataFrame, vocabulary: DataFrame, sample_pages: int = 2_000, most_chars: int = 20_000) -> ScanModels:
    """Learns from at most ``sample_pages`` scanned pages of at most ``most_chars`` characters, those with the smallest hashes of their ids."""
    spark = pages.sparkSession
    short = pages.filter(F.length("text") <= most_chars)
    sample = smallest_hashes(short, "page_id", sample_pages, short.count())
    labelled = documents.select("doc_id", "title", F.col("text").alias("clean")).filter("clean is not null").join(F.broadcast(sample), F.col("doc_id") == F.col("document_id"))  # bounded by the sample

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [e for x in zip(b["text"], b["page_number"], b["title"], b["clean"]) for e in examples_of_page(*x)]
            yield records(rows, ["what", "seen", "label"])

    rows = labelled.select("text", "page_number", "title", "clean").mapInPandas(run, "what string, seen string, label string").collect()  # bounded by the sample
    rows = sorted((r["what"], r["seen"], r["label"]) for r in rows)
    wanted = sorted({w for what, seen, _ in rows if what in ("join", "keep") for a, _, b in [seen.split("\t")] for w in (a + b, f"{a}-{b}")})
    known = {}
    if wanted:
        ask = spark.createDataFrame([(w,) for w in wanted], "word string")
        known = {r["word"]: r["f"] for r in vocabulary.join(F.broadcast(ask), "word").collect()}
    return ScanModels(rows, known)


def scan_noise(pages: DataFrame, documents: DataFrame, sample_pages: int = 2_000) -> DataFrame:
    """(page_id, line_no, kind, word, seen): everything found on the scanned pages; seen is the token of a misread word."""
    scanned = pages.filter("extraction_method = 'ocr' and text is not null and page_id is not null").select("page_id", "document_id", "page_number", "text")
    titles = documents.select(F.col("doc_id").alias("document_id"), "title").dropDuplicates(["document_id"])
    # native pages have the words of notices, which are in no document's reading text
    native = count_words(pages.filter("extraction_method = 'native'"), "text")
    vocabulary = cut(count_words(documents, "text", "title").unionByName(native).groupBy("word").agg(F.sum("f").alias("f")))
    models = train(scanned, documents, vocabulary, sample_pages)
    shared = pages.sparkSession.sparkContext.broadcast(models)  # bounded by the sample
    titled = scanned.join(broadcast_if_small(titles), "document_id", "left")  # then no text is shuffled; beyond, adaptive execution divides a hot document
    schema = "page_id long, line_no int, kind string, word string, left string, mark string, right string"

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = shared.value
        for b in batches:
            rows = []
            for pid, number, text, title in zip(b["page_id"], b["page_number"], b["text"], b["title"]):
                lines, filled, t = parse_page(text, number, title)
                for i in filled:
                    kind = m.kind_of_line(lines, i, filled, t)
                    if kind in ("header", "page_number"):
                        rows.append((pid, i + 1, kind, "", None, None, None))
                broken = set()
                for i, left, mark, right in breaks(lines):
                    broken |= {(i, left), (i + 1, right)}
                    rows.append((pid, i + 1, "hyphen", left + right, left, mark, right))
                for i in filled:
                    for w in {core(x) for x in lines[i].split()}:
                        if len(w) >= 2 and (i, w) not in broken and any(c.isalpha() for c in w):
                            rows.append((pid, i + 1, "token", w, None, None, None))
            yield records(rows, ["page_id", "line_no", "kind", "word", "left", "mark", "right"])

    parsed = cut(titled.mapInPandas(parse, schema))
    furniture = parsed.filter("kind in ('header', 'page_number')").select("page_id", "line_no", "kind", "word", F.lit(None).cast("string").alias("seen"))
    return furniture.unionByName(_joins(parsed, vocabulary, shared)).unionByName(_misreads(parsed, vocabulary, shared)).distinct()


def _joins(parsed: DataFrame, vocabulary: DataFrame, shared) -> DataFrame:
    """Broken words; the second perceptron tells them from compounds that keep their hyphen."""
    cases = parsed.filter("kind = 'hyphen'").withColumn("compound", F.concat_ws("-", "left", "right"))
    voc = vocabulary.withColumnRenamed("f", "fw")
    known = cases.join(voc, "word", "left").join(vocabulary.select(F.col("word").alias("compound"), F.col("f").alias("fc")), "compound", "left").fillna(0, ["fw", "fc"])

    def decide(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = shared.value.join
        for b in batches:
            ok = [m.predict(hyphen_features(*x)) == "join" for x in zip(b["left"], b["mark"], b["right"], b["fw"], b["fc"])]
            k = b[pd.Series(ok, index=b.index, dtype=bool)]
            yield objects({"page_id": k["page_id"], "line_no": k["line_no"], "kind": ["hyphen"] * len(k), "word": k["word"], "seen": [None] * len(k)})

    return known.mapInPandas(decide, "page_id long, line_no int, kind string, word string, seen string")


def _misreads(parsed: DataFrame, vocabulary: DataFrame, shared) -> DataFrame:
    """Unknown tokens with the best of their edits that are known words, at least twice as frequent as they are."""
    tokens = parsed.filter("kind = 'token'").select("page_id", "line_no", "word")
    own = cut(tokens.groupBy("word").agg(F.count("*").alias("n")))
    unknown = own.filter(~F.col("word").rlike(CODE) & (F.length("word") <= LONGEST)).join(vocabulary, "word", "left_anti")

    def edit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = shared.value
        for b in batches:
            rows = [(w, n, t, s) for w, n in zip(b["word"], b["n"]) for t, s in best_edits(m.edit, m.confusions, w) if t.lower() != w.lower()]
            yield records(rows, ["word", "n", "candidate", "score"])

    made = unknown.mapInPandas(edit, "word string, n long, candidate string, score double")
    known = made.join(vocabulary.withColumnRenamed("word", "candidate"), "candidate").filter("f >= 2 * n")
    best = known.groupBy("word").agg(F.max_by("candidate", F.struct(F.col("score") + F.log("f"), F.col("candidate"))).alias("right_word"))
    best = broadcast_if_small(cut(best))  # then hot words stay in their tasks; beyond, adaptive execution divides them
    return tokens.join(best, "word").select("page_id", "line_no", F.lit("misread").alias("kind"), F.col("right_word").alias("word"), F.col("word").alias("seen"))


def repaired_pages(pages: DataFrame, found: DataFrame) -> DataFrame:
    """(page_id, text): the scanned pages as continuous paragraphs, without running lines, with whole and right words. ``found`` comes from ``scan_noise``."""
    scanned = pages.filter("extraction_method = 'ocr'").select("page_id", "text").dropDuplicates(["page_id"])
    marks = found.groupBy("page_id").agg(F.collect_list(F.struct("line_no", "kind", "word", "seen")).alias("marks"))

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield objects({"page_id": b["page_id"], "text": [None if x is None else repair(x, [] if m is None else [tuple(r[c] for c in ("line_no", "kind", "word", "seen")) for r in m]) for x, m in zip(b["text"], b["marks"])]})

    return scanned.join(marks, "page_id", "left").mapInPandas(write, "page_id long, text string")


def repair(text: str, marks: list[tuple[int, str, str, str | None]]) -> str:
    """Applies what was found to one page's text and runs its lines together; blank lines keep paragraphs apart.

    A misread word is put right where it was read. Broken words lose their hyphen, compounds that break after theirs keep it; neither gets a space.
    """
    lines = text.split("\n")
    gone = {n for n, kind, *_ in marks if kind in ("header", "page_number")}
    joined = {n for n, kind, *_ in marks if kind == "hyphen"}
    kept = {i + 1 for i, *_ in breaks(lines)} - joined
    right: dict[int, dict[str, str]] = {}
    for n, kind, word, seen in marks:
        if kind == "misread":
            right.setdefault(n, {})[seen] = word
    out: list[str] = []
    glue, open_ = True, False  # whether the next line follows without a space, and whether a broken word waits for it
    for n, x in enumerate(lines, 1):
        if n in gone:
            continue
        swap = right.get(n, {})
        x = " ".join(w.replace(c, swap[c], 1) if (c := core(w)) in swap else w for w in x.split())
        if not x:
            if not open_:
                out.append("\n\n")
                glue = True
            continue
        out.append(x if glue else " " + x)
        glue = open_ = n in joined | kept
        if n in joined and x[-1] in HYPHENS:
            out[-1] = out[-1][:-1]
    return re.sub(r"\n{2,}", "\n\n", "".join(out)).strip()
