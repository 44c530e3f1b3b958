"""Problem 4: text that looks the same, in one form.

Method: vocabulary tries and a weighted edit automaton. The distinct tokens of the corpus are divided
into clean ones (one script, composed, nothing invisible) and others. Tokens meet by a coarse skeleton,
under which all look-alikes fall together, and for costs above 0 by all forms of it with that many characters left out, which
any two tokens of that distance share. The clean tokens that meet others form a trie, which the automaton
traverses with each of these: look-alike characters and ignorables cost nothing, every other edit costs 1.
The cheapest spelling (then the most frequent, then the last in order) within ``max_cost`` becomes the canonical one, however the tokens are partitioned; a token
without a match is normalised by table. Terms are found at cost 0, since a visible letter tells them apart.
Pages without any suspicious character need no lookup at all.

Defined results: null text stays null; empty text stays empty; runs of white space of any kind count as one space;
pages without a key have a canonical text, but no terms are found on them;
an empty table gives an empty table.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagequarry.frames import objects, records
from pagequarry.session import shuffle_partitions

# Letters of other scripts that look like Latin ones, each followed by its look-alike.
CYRILLIC = "АA ВB ЕE ІI ЈJ КK МM НH ОO РP ЅS СC ТT УY ХX ԚQ ԜW аa сc ԁd еe һh іi јj ӏl оo рp ԛq ѕs уy хx ѵv ԝw"
GREEK = "ΑA ΒB ΕE ΖZ ΗH ΙI ΚK ΜM ΝN ΟO ΡP ΤT ΥY ΧX ϹC αa ιi νv οo ρp υu ϲc"
OTHER = "օo սu հh ոn ՕO ՍU ՏS ԼL ᎪA ᏴB ᏟC ᎬE ᎻH ᎫJ ᏦK ᏞL ᎷM ᏢP ᏚS ᎢT ᏙV ᏃZ ɑa ɡg"
MARKS = "’' ‘' ʼ' ′' `' ´' ‐- ‑- −- ﹣-"

TO_LATIN = {p[0]: p[1] for p in f"{CYRILLIC} {GREEK} {OTHER}".split()}
TO_CYRILLIC = {p[1]: p[0] for p in CYRILLIC.split()}
_MARKS = {ord(p[0]): p[1] for p in MARKS.split()}
#: the same white space for Python and for Spark
SPACES = r"[\u0009-\u000d\u001c- \u0085\u00a0\u1680\u180e\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+"
_SPACE = re.compile(SPACES)


@lru_cache(maxsize=100_000)
def _ignorable(c: str) -> bool:
    return unicodedata.category(c) == "Cf" or c in "\u034f\u115f\u1160\u17b4\u17b5\u3164\uffa0" or "\ufe00" <= c <= "\ufe0f"


def _suspicious() -> str:
    """A pattern of one character, the same for Python and for Spark: scripts with look-alikes, combining marks, white space, and all that the table changes."""
    old = "\u00a0\u0300-\u052f\u1680\u180e\u2000-\u2011\u2018\u2019\u2028-\u202f\u205f-\u206f\u2212\u3000\ufe00-\ufe0f\ufeff\uff00-\uffef"
    known = re.compile(f"[{old}]")
    more = {chr(x) for x in _MARKS} | {c for c in map(chr, (*range(0x80, 0x20000), *range(0xE0000, 0xE1000))) if _ignorable(c) or unicodedata.decomposition(c).startswith("<")}
    runs: list[list[int]] = []
    for x in sorted(ord(c) for c in more | set(TO_LATIN) if not known.match(c)):
        if runs and x == runs[-1][1] + 1:
            runs[-1][1] = x
        else:
            runs.append([x, x])
    plain = "(?=[^\\x00-_a-\\x7f])"  # turns ASCII but for the grave accent away before the many ranges are tried
    return plain + f"[{old}{''.join(chr(a) if a == b else f'{chr(a)}-{chr(b)}' for a, b in runs)}]"


#: what a page must contain for its tokens to need more than a change of case
SUSPICIOUS = _suspicious()


def bare(token: str) -> str:
    """The token decomposed, without ignorables and with plain quotes and hyphens."""
    return unicodedata.normalize("NFKD", "".join(c for c in token if not _ignorable(c)).translate(_MARKS))


def _close(token: str) -> str:
    """Composed and without case; the second pass is for forms that casefolding opens."""
    return unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", token).casefold())


@lru_cache(maxsize=200_000)
def by_table(token: str) -> str:
    """A token's form by table: letters go over to Latin, or to Cyrillic if it has letters of Cyrillic alone and its Latin ones can."""
    b = bare(token)
    letters = [c for c in b if c.isalpha()]
    foreign = [c for c in letters if "\u0370" <= c <= "\u052f" or c in TO_LATIN]
    if foreign:
        latin = [c for c in letters if c < "\u0250" and c not in TO_LATIN]
        alone = any(c not in TO_LATIN for c in foreign)
        if not alone:
            b = "".join(TO_LATIN.get(c, c) for c in b)
        elif latin and all(c in TO_CYRILLIC for c in latin):
            b = "".join(TO_CYRILLIC.get(c, c) for c in b)
    return _close(b)


@lru_cache(maxsize=200_000)
def skeleton(token: str) -> str:
    """A coarse key: equal for all tokens that look alike, whatever the case of their letters."""
    out = []
    for c in bare(token).casefold():
        for x in (c, c.upper()):
            c = TO_LATIN.get(x, c)
        out.append(c.casefold())
    return _close("".join(out))


@lru_cache(maxsize=50_000)
def looks(c: str) -> tuple[str, ...]:
    """The case-folded characters that a reader may take a decomposed character for."""
    own = c.casefold()
    other = TO_LATIN.get(c) or TO_CYRILLIC.get(c)
    return (own,) if other is None else tuple(dict.fromkeys((own, other.casefold(), *(TO_CYRILLIC[other].casefold() for _ in (1,) if other in TO_CYRILLIC))))


class Trie:
    """Spellings with weights, as nested dictionaries; the empty key holds (weight, spelling)."""

    def __init__(self) -> None:
        self.root: dict = {}

    def add(self, spelling: str, weight: int) -> None:
        node = self.root
        for c in unicodedata.normalize("NFD", spelling):
            node = node.setdefault(c, {})
        if "" not in node or node[""] < (weight, spelling):
            node[""] = (weight, spelling)

    def nearest(self, token: str, max_cost: int = 0) -> tuple[int, int, str] | None:
        """(cost, weight, spelling) of the cheapest, then most frequent spelling within max_cost of the token."""
        states: list[tuple[int, dict]] = self._grow([(0, self.root)], max_cost)
        for c in bare(token):
            forms = {"".join(x) for x in (looks(c))}
            step: list[tuple[int, dict]] = []
            for cost, node in states:
                for f in forms:
                    n = node
                    for x in unicodedata.normalize("NFD", f):
                        n = n.get(x)
                        if n is None:
                            break
                    else:
                        step.append((cost, n))
                if cost < max_cost:
                    step.append((cost + 1, node))
                    step.extend((cost + 1, n) for x, n in node.items() if x and x not in forms)
            states = self._grow(step, max_cost)
            if not states:
                return None
        ends = [(cost, *n[""]) for cost, n in states if "" in n]
        return min(ends, key=lambda e: (e[0], -e[1], [-ord(c) for c in e[2]])) if ends else None

    def _grow(self, states: list[tuple[int, dict]], max_cost: int) -> list[tuple[int, dict]]:
        """The states reached besides by insertions, the cheapest of each node."""
        best: dict[int, tuple[int, dict]] = {}
        todo = list(states)
        while todo:
            cost, node = todo.pop()
            if id(node) in best and best[id(node)][0] <= cost:
                continue
            best[id(node)] = (cost, node)
            if cost < max_cost:
                todo.extend((cost + 1, n) for x, n in node.items() if x)
        return list(best.values())


def shortened(key: str, most: int) -> set[str]:
    """``key`` and what is left of it without up to ``most`` characters. Two keys of edit distance up to ``most`` share one of these forms."""
    forms = {key}
    for _ in range(most):
        forms |= {x[:i] + x[i + 1 :] for x in forms for i in range(len(x))}
    return forms


def canonical_tokens(texts: DataFrame, text: str = "text", extra: DataFrame | None = None, max_cost: int = 0) -> DataFrame:
    """(token, canonical) for each distinct suspicious token. ``extra`` has a column ``token`` of spellings preferred to all others."""
    words = texts.select(F.explode(F.split(F.col(text), SPACES)).alias("token")).filter("token <> ''")
    counts = words.groupBy("token").agg(F.count("*").alias("weight"))
    if extra is not None:
        counts = counts.unionByName(extra.select("token", F.lit(2**40).alias("weight")))

    def sort_out(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        odd = re.compile(SUSPICIOUS)
        for b in batches:
            out = []
            for t, w in zip(b["token"], b["weight"]):
                if not odd.search(t):
                    key, clean = t.casefold(), True
                else:
                    key, clean = skeleton(t), by_table(t) == t.casefold()
                out += [(k, t, w, clean) for k in (shortened(key, max_cost) if max_cost else (key,))]
            yield records(out, ["skeleton", "token", "weight", "clean"])

    sorted_ = counts.mapInPandas(sort_out, "skeleton string, token string, weight long, clean boolean")
    parts = shuffle_partitions(texts.sparkSession)

    def match(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows come sorted by skeleton, clean ones first; a finished skeleton's trie can go."""
        at, trie = None, Trie()
        for b in batches:
            out = []
            for s, t, w, clean in zip(b["skeleton"], b["token"], b["weight"], b["clean"]):
                if s != at:
                    at, trie = s, Trie()
                if clean:
                    trie.add(_close(t), w)
                else:
                    out.append((t, *(trie.nearest(t, max_cost) or (max_cost + 1, 0, by_table(t)))))
            yield records(out, ["token", "cost", "weight", "canonical"])

    met = sorted_.repartition(parts, "skeleton").sortWithinPartitions("skeleton", F.desc("clean")).mapInPandas(match, "token string, cost int, weight long, canonical string")
    if max_cost:  # a token met others under several forms
        met = met.groupBy("token").agg(F.max_by("canonical", F.struct(-F.col("cost"), "weight", "canonical")).alias("canonical"))
    return met.select("token", "canonical")


def _apply(text: str, forms: dict[str, str]) -> str:
    return " ".join(forms.get(t) or by_table(t) for t in _SPACE.split(text) if t)


def canonical_text(pages: DataFrame, key: str = "page_id", text: str = "text", extra: DataFrame | None = None, max_cost: int = 0) -> DataFrame:
    """(key, canonical): every text in its one form. Only texts with suspicious characters are shuffled to meet their tokens' forms."""
    kind = pages.schema[key].dataType.simpleString()
    rows = pages.select(F.col(key).cast("string").alias("key"), F.col(text).alias("text"))  # pandas would make whole numbers with nulls floats
    odd = F.coalesce(F.col("text").rlike(SUSPICIOUS), F.lit(False))
    forms = canonical_tokens(rows, "text", extra, max_cost)
    mine = rows.filter(odd).select("key", F.explode(F.array_distinct(F.split("text", SPACES))).alias("token")).filter(F.col("token").rlike(SUSPICIOUS))
    maps = mine.join(forms, "token").distinct().groupBy("key").agg(F.collect_list("token").alias("tokens"), F.collect_list("canonical").alias("forms"))

    def rewrite(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = [_apply(x, {} if t is None else dict(zip(t, f))) for x, t, f in zip(b["text"], b["tokens"], b["forms"])]
            yield objects({"key": b["key"], "canonical": out})

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield objects({"key": b["key"], "canonical": [None if x is None else " ".join(_close(x).split()) for x in b["text"]]})

    schema = "key string, canonical string"
    slow = rows.filter(odd).join(maps, "key", "left").mapInPandas(rewrite, schema)
    fast = rows.filter(~odd).mapInPandas(fold, schema)
    return slow.unionByName(fast).select(F.col("key").cast(kind).alias(key), "canonical")


def find_terms(pages: DataFrame, terms: DataFrame, key: str = "page_id", text: str = "text", term_key: str = "term_id", term: str = "term", most_terms: int = 100_000) -> DataFrame:
    """(term_key, key): the pages that show each term, searched in canonical text. The terms are a small fixed table; over ``most_terms`` is an error."""
    import ahocorasick

    listed = terms.filter(F.col(term).isNotNull()).select(term_key, term).limit(most_terms + 1).collect()
    if len(listed) > most_terms:
        raise ValueError(f"more than {most_terms} search terms")
    needles: dict[str, list] = {}
    for r in listed:
        needle = _apply(r[term], {})
        if needle:
            needles.setdefault(needle, []).append(r[term_key])
    tokens = terms.select(F.explode(F.split(term, r"\s+")).alias("token")).filter("token <> ''").distinct()
    kind, tkind = pages.schema[key].dataType.simpleString(), terms.schema[term_key].dataType.simpleString()

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        a = ahocorasick.Automaton()
        for i, (n, ids) in enumerate(needles.items()):
            a.add_word(n, ids)
        if needles:
            a.make_automaton()
        for b in batches:
            found = [] if not needles else [(t, k) for k, x in zip(b[key], b["canonical"]) if x for t in {t for _, ids in a.iter(x) for t in ids}]
            yield records(found, [term_key, key])

    return canonical_text(pages.filter(F.col(key).isNotNull()), key, text, tokens).mapInPandas(search, f"{term_key} {tkind}, {key} {kind}").distinct()
