"""Problem 2: lines repeated across one source's documents.

Method: lines are parsed into templates by fixed-depth token trees. A tree's path is the source, the
number of tokens and the first tokens (tokens with digits are wildcards); its leaf holds templates, whose differing
tokens become wildcard slots. Each partition grows trees of its own lines; trees are merged
path by path across partitions. A template only ever gains slots, so that a merged one still covers every line that went into its parts, and the documents that
it counts are no fewer than those of any of its lines. Lines whose template covers enough documents are the candidates; all others are out. Candidates are
then counted exactly: the distinct documents of a line (``repeated_lines``), or of a whole template (``repeated_templates``, for bylines with names).

Two lines are the same if they are equal without leading and trailing spaces, with single spaces, in lower case and with one sign for each run
of digits. Defined results: null texts and sources have no lines; repeated deliveries of a row count once;
an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagequarry.frames import records
from pagequarry.session import broadcast_if_small, cut, shuffle_partitions

SLOT = "<*>"
KEY = ("k", "k2")


def normal_line(line: Column) -> Column:
    return F.regexp_replace(F.lower(F.regexp_replace(F.btrim(line, F.lit(" ")), " +", " ")), r"\d+", "0")


def line_key(norm: Column) -> list[Column]:
    """96 bits that stand for a normal line where only its identity matters."""
    return [F.xxhash64(norm).alias("k"), F.hash(norm).alias("k2")]


class Leaf:
    """The templates of one path. A line joins the template with which it shares most tokens, if these are enough."""

    def __init__(self, least: float):
        self.least, self.templates, self.documents = least, [], []
        self.taken: dict[tuple[str, ...], int] = {}  # what came before goes to the template that took it

    def match(self, tokens: list[str]) -> int | None:
        """The template nearest to the tokens, slots on either side counting half; None if none is near enough."""
        best, at = 0.0, None
        for i, t in enumerate(self.templates):
            s = sum(0.5 if x == SLOT or y == SLOT else float(x == y) for x, y in zip(t, tokens)) / len(t)
            if s > best:
                best, at = s, i
                if s == 1.0:
                    break
        return at if best >= self.least else None

    def add(self, tokens: list[str], documents: int = 0) -> int:
        """Takes a line or another tree's template, and the documents it covers; gives the number of the template that took it."""
        same = tuple(tokens)
        at = self.taken[same] if same in self.taken else self.match(tokens)
        if at is None:
            self.templates.append(list(tokens))
            self.documents.append(documents)
            self.taken[same] = len(self.templates) - 1
            return len(self.templates) - 1
        self.taken[same] = at
        self.documents[at] += documents
        t = self.templates[at]
        for i, y in enumerate(tokens):
            if t[i] != y:
                t[i] = SLOT
        return at

    def covering(self, tokens: list[str]) -> int | None:
        """Of the templates that have the line's token or a slot in every place, the one of most documents."""
        fits = [i for i, t in enumerate(self.templates) if all(x == y or x == SLOT for x, y in zip(t, tokens))]
        return max(fits, key=lambda i: (self.documents[i], -i), default=None)


def page_lines(pages: DataFrame, min_letters: int) -> DataFrame:
    """(page_id, document_id, line_no, norm) of the lines with enough letters."""
    lines = pages.select("page_id", "document_id", F.posexplode(F.split("text", "\n", -1)).alias("at", "line"))
    lines = lines.filter((F.length("line") >= min_letters) & (F.length(F.regexp_replace("line", r"\P{L}+", "")) >= min_letters))
    return lines.select("page_id", "document_id", (F.col("at") + 1).alias("line_no"), normal_line(F.col("line")).alias("norm"))


def sources_of(documents: DataFrame) -> DataFrame:
    return documents.filter("source is not null and doc_id is not null").select(F.col("doc_id").alias("document_id"), "source").dropDuplicates(["document_id"])


def covered_lines(lines: DataFrame, min_documents: int, depth: int = 3, least: float = 0.7, most_lines: int = 200_000) -> DataFrame:
    """(source, norm, template, template_documents) of the lines whose template covers enough documents; lines: (source, norm, document_id).

    ``template_documents`` adds up lines and partitions: it is never too small. A task grows new trees after ``most_lines`` distinct lines.
    """

    def path(norm: str) -> str:
        tokens = norm.split(" ")
        return " ".join([str(len(tokens)), *(SLOT if "0" in x else x for x in tokens[:depth])])

    def grow(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """One partition's trees: their templates, and the lines under those with slots."""
        seen: dict[tuple[str, str], list[int]] = {}  # the last document, and how often it was another one

        def trees() -> Iterator[pd.DataFrame]:
            leaves: dict[tuple[str, str], Leaf] = {}
            where = []
            for (s, n), (_, docs) in seen.items():
                at = (s, path(n))
                where.append((at, n, leaves.setdefault(at, Leaf(least)).add(n.split(" "), docs)))
            rows = [(s, p, 0, " ".join(t), d) for (s, p), leaf in leaves.items() for t, d in zip(leaf.templates, leaf.documents)]
            rows += [(*at, 1, n, 0) for at, n, i in where if SLOT in leaves[at].templates[i]]
            seen.clear()
            for lo in range(0, len(rows), 20_000):
                yield records(rows[lo : lo + 20_000], ["source", "path", "kind", "norm", "docs"])

        for b in batches:
            for s, n, d in zip(b["source"], b["norm"], b["document_id"]):
                have = seen.setdefault((s, n), [d, 1])
                if have[0] != d:
                    have[0], have[1] = d, have[1] + 1
            if len(seen) > most_lines:
                yield from trees()
        yield from trees()

    def merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows come sorted by source, path, kind and line: a path's templates are merged first, with their documents, then its lines pass by."""
        at, leaf, own, last = None, Leaf(least), [], None
        names = ["source", "norm", "template", "template_documents"]

        def told(line: str) -> list[tuple]:
            i = leaf.covering(line.split(" "))
            return [(at[0], line, " ".join(leaf.templates[i]), leaf.documents[i])] if i is not None and leaf.documents[i] >= min_documents else []

        def close() -> list[tuple]:
            """The path's lines that were templates themselves; with no template of enough documents there is nothing to look at."""
            return [r for line in dict.fromkeys(own) for r in told(line)] if leaf.documents and max(leaf.documents) >= min_documents else []

        for b in batches:
            out = []
            for s, p, k, n, d in zip(b["source"], b["path"], b["kind"], b["norm"], b["docs"]):
                if (s, p) != at:
                    out += close()
                    at, leaf, own, last = (s, p), Leaf(least), [], None
                if k == 0:
                    leaf.add(n.split(" "), d)
                    if SLOT not in n.split(" "):
                        own.append(n)
                elif n != last:
                    out += told(n)
                    last = n
            if out:
                yield records(out, names)
        if out := close():
            yield records(out, names)

    schema = "source string, path string, kind int, norm string, docs long"
    trees = lines.select("source", "norm", "document_id").mapInPandas(grow, schema)
    parts = shuffle_partitions(lines.sparkSession)
    ordered = trees.repartition(parts, "source", "path").sortWithinPartitions("source", "path", "kind", "norm")
    return ordered.mapInPandas(merge, "source string, norm string, template string, template_documents long")


def candidate_lines(pages: DataFrame, documents: DataFrame, min_documents: int, min_letters: int) -> DataFrame:
    """(page_id, line_no, document_id, source, k, k2, template): the occurrences of all lines whose template covers enough documents."""
    lines, sources = page_lines(pages, min_letters), sources_of(documents)
    found = cut(covered_lines(lines.join(sources, "document_id"), min_documents).select("source", *line_key(F.col("norm")), "template").distinct())
    # lines go by their keys from here; those of no candidate are out before anything is shuffled, if the candidates are few
    keyed = lines.select("page_id", "line_no", "document_id", *line_key(F.col("norm"))).join(broadcast_if_small(found.select(*KEY).distinct()), [*KEY], "left_semi")
    return keyed.join(sources, "document_id").join(broadcast_if_small(found), ["source", *KEY])


def _of_many_documents(candidates: DataFrame, by: list[str], min_documents: int) -> DataFrame:
    """The candidates whose ``by`` at least ``min_documents`` distinct documents have. Both steps add up in the tasks first: a hot document is one row a line."""
    many = candidates.select(*by, "document_id").distinct().groupBy(*by).agg(F.count("*").alias("_docs")).filter(F.col("_docs") >= min_documents).drop("_docs")
    return candidates.join(many, by, "left_semi").select("page_id", "line_no", "source", "template").distinct()


def repeated_lines(pages: DataFrame, documents: DataFrame, min_documents: int = 6, min_letters: int = 20) -> DataFrame:
    """(page_id, line_no, source, template): every occurrence of a line that at least ``min_documents`` documents of its source have."""
    candidates = cut(candidate_lines(pages, documents, min_documents, min_letters))
    return _of_many_documents(candidates, ["source", *KEY], min_documents)


def repeated_templates(pages: DataFrame, documents: DataFrame, min_documents: int = 6, min_letters: int = 20) -> DataFrame:
    """(page_id, line_no, source, template): every occurrence of a line whose template at least ``min_documents`` documents of its source have."""
    candidates = cut(candidate_lines(pages, documents, min_documents, min_letters))
    return _of_many_documents(candidates, ["source", "template"], min_documents)


def without_lines(pages: DataFrame, found: DataFrame) -> DataFrame:
    """(page_id, text): the pages without their found lines; pages delivered twice come once."""
    marked = found.groupBy("page_id").agg(F.collect_set("line_no").alias("_lines"))
    one = pages.select("page_id", "text").dropDuplicates(["page_id"])
    kept = F.array_join(F.filter(F.split("text", "\n", -1), lambda x, i: ~F.array_contains("_lines", i + 1)), "\n")
    return one.join(marked, "page_id", "left").select("page_id", F.when(F.col("_lines").isNull(), F.col("text")).otherwise(kept).alias("text"))
