"""Problem 6: oversized items cut at natural boundaries.

Method: byte-range processing. An item, be it a text or a giant file, is taken in ranges, each with a halo on both sides; a worker finds the natural
boundaries that end within its range, counted in words from the range's start. A halo that holds no settled context is widened until it does (see
``settled_range``), so that ranges give what the whole item would. The ranges' word counts are summed in order (prefix sums over a table of one row a
range); pieces are chosen from this stitched table alone, as it streams by, and each range then emits its parts of the pieces by offset. No task holds a whole file.

Words are the maximal runs of characters without U+0020 and line feed. Defined results: null keys, null and empty
texts and items of at most ``max_words`` words give no boundary rows (they need no cutting); the
end of the text is always a boundary; rows delivered twice give the same rows once. A line longer than the halo widens the left halos of the ranges within it to the
line's start, since its kind shows there. Bytes that are no UTF-8 count as U+FFFD.
"""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pagequarry.frames import objects, records
from pagequarry.session import partitions_for, shuffle_partitions
from pagequarry.sources.files import open_file

# Usual abbreviations of the corpus languages (en, de, fr, es, ru), without their last full stop.
ABBREVIATIONS = frozenset(
    """vs approx max min e.g i.e etc cf no nos fig figs ref refs eq sec ch vol pp p dr mr mrs ms st inc ltd co corp dept est incl excl
    z b z.b d.h u.a bzw ca abb nr tab vgl ggf evtl usw u o inkl exkl max bspw sog gem s str tel art bzgl zzgl d h
    p.ex env réf fig ex cf mme art chap n vol éd av c.-à-d c.à.d
    p.ej ej pág págs núm sr sra aprox ud uds ref etc máx mín p
    т.е т.д т.п т е д п рис напр см стр гл табл др г им ок прим макс мин руб ул""".split()
)
_WORD = re.compile(r"[^ \n]+")
_HEADING = re.compile(r"^\s*(?:\d{1,2}(?:\.\d{1,2})+\.?|[A-Z]\.\d+|§ ?\d+)\s+[^\W\d_]{3,}[^,;:.!?]*$")
_BULLET = re.compile(r"^\s*(?:[•‣▪●◦*·\-–—]|\(?\d{1,3}[.)]|\(?[a-zA-Zа-я][)])(?= |$)")
_HEADING_START = re.compile(r"^\s*(?:\d{1,2}\.|[A-Z]\.\d|§)")
_CLOSERS = "\"'”’»“)]}›"
_OPENERS = "\"'“„«‹([{¿¡"


def ends_sentence(word: str, following: str | None, previous: str = "") -> bool:
    """Whether ``word`` ends a sentence, given its neighbours in the same block (following is null at the block's end)."""
    core = word.rstrip(_CLOSERS)
    if not core or core[-1] not in ".!?…":
        return False
    if following is None:
        return True
    if core[-1] == "." and not core.endswith(".."):
        stem = core[:-1].strip(_OPENERS + _CLOSERS).lower()
        single = len(stem) == 1 and stem.isalpha() and not previous[-1:].isdigit()  # "5 V." is a quantity, "z. B." is not
        if single or stem in ABBREVIATIONS and len(stem) > 1 or re.fullmatch(r"(?:\w\.)+\w", stem) and not stem[0].isdigit():
            return False
    head = following.lstrip(_OPENERS + "-–—•±≤≥<>~")
    return not head[:1].islower() or head[1:2].isupper()  # pH and the like begin a sentence too


def _continues(line: str) -> bool:
    return bool(line) and line.lstrip(_OPENERS)[:1].islower()


def boundaries(text: str, start: int = 0, end: int | None = None, at_end: bool = True) -> tuple[int, list[int]]:
    """Words that begin within [start, end) and, counted from 1 among them, those that end at a natural boundary.

    ``text`` may be a range with settled halos; at_end tells whether it reaches the item's end.
    """
    end = len(text) if end is None else end
    lines, at = [], 0
    for x in text.split("\n"):
        lines.append((at, x))
        at += len(x) + 1
    words: list[tuple[int, str, int]] = []  # offset, word, line
    for k, (o, x) in enumerate(lines):
        words.extend((o + m.start(), m.group(), k) for m in _WORD.finditer(x))
    kinds = ["blank" if not x.strip() else "item" if _BULLET.match(x) else "text" for _, x in lines]
    closed = True  # whether the lines before have come to an end, so that a heading may follow
    for k, (_, x) in enumerate(lines):
        if kinds[k] == "item" and not closed and (x.lstrip()[0] in "-–—·*" or x.lstrip()[0].isupper()):
            kinds[k] = "text"  # a dash or a unit within a sentence
        if kinds[k] == "text" and closed and len(x.split()) <= 8 and _HEADING.match(x):
            kinds[k] = "heading"
        closed = kinds[k] != "text" or ends_sentence(x.split()[-1], None)
    # an item's continuation lines belong to it as far as they begin in lower case
    block = [0] * len(lines)
    for k in range(1, len(lines)):
        new = kinds[k] in ("blank", "heading", "item") or kinds[k - 1] in ("blank", "heading")
        if kinds[k - 1] == "item" and kinds[k] == "text":
            if _continues(lines[k][1]):
                kinds[k] = "item"
            else:
                new = True
        block[k] = block[k - 1] + new
    found, n = [], 0
    for i, (o, w, k) in enumerate(words):
        if o < start or o >= end:
            continue
        n += 1
        if i + 1 == len(words):
            if at_end:
                found.append(n)
            continue
        after, k2 = words[i + 1][1], words[i + 1][2]
        if block[k2] != block[k]:
            if kinds[k] in ("heading", "item") or not _continues(after) or ends_sentence(w, None):
                found.append(n)
            continue
        before = words[i - 1][1] if i and block[words[i - 1][2]] == block[k] else None
        if kinds[k] == "item" and before is None:
            continue  # the item's number
        if ends_sentence(w, after, before or ""):
            found.append(n)
    return n, found


def settled_start(text: str, at: int, whole: bool) -> int | None:
    """The last line start at or before ``at`` from which a reading goes on as one from the item's start would; null if none is there.

    Blank lines, numbered items and lines that begin neither like an item or a heading nor in lower case are what they are whatever comes before.
    """
    while True:
        begin = text.rfind("\n", 0, at) + 1
        if begin == 0 and not whole:
            return None
        end = text.find("\n", begin)
        line = text[begin : len(text) if end < 0 else end]
        bullet = _BULLET.match(line)
        plain = not bullet and not _HEADING_START.match(line) and not _continues(line)
        if begin == 0 or not line.strip() or plain or bullet and line.lstrip()[0] not in "-–—·*" and not line.lstrip()[0].isupper():
            return begin
        at = begin - 1


def settled_end(text: str, end: int) -> bool:
    """Whether ``text`` goes on far enough after ``end``: to the next whole word, and to the end of its line or so far that this can be no heading."""
    at = end
    while at < len(text) and at > 0 and text[at - 1] not in " \n" and text[at] not in " \n":
        at += 1
    following = _WORD.search(text, at)
    if following is None or following.end() == len(text):
        return False
    line = text.rfind("\n", 0, following.start()) + 1
    return "\n" in text[following.end() :] or len(text[line:].split()) > 9


def settled_range(read: Callable[[int, int, int, int], tuple[str, int, int]], size: int, lo: int, hi: int, halo: int) -> tuple[str, int, int, bool]:
    """(part, start, end, at_end) of the range [lo, hi) with settled halos. ``read`` gives the text of [a, b) and where lo and hi are in it."""
    left = right = halo
    while True:
        a, b = max(0, lo - left), min(size, hi + right)
        part, start, end = read(a, lo, hi, b)
        s, far = settled_start(part, start, a == 0), b == size or settled_end(part, end)
        if s is not None and far:
            return part[s:], start - s, end - s, b == size
        left, right = left * (1 + (s is None)), right * (2 - far)


def _in_text(text: str) -> Callable[[int, int, int, int], tuple[str, int, int]]:
    return lambda a, lo, hi, b: (text[a:b], lo - a, hi - a)


def _in_file(file) -> Callable[[int, int, int, int], tuple[str, int, int]]:
    """Reads UTF-8 by byte offsets; every offset stands for the first whole character at or after it."""

    def whole(raw: bytes, at: int) -> int:
        while at < len(raw) and raw[at] & 0xC0 == 0x80:
            at += 1
        return at

    def read(a: int, lo: int, hi: int, b: int) -> tuple[str, int, int]:
        file.seek(a)
        raw = file.read(b - a + 4)
        at = [whole(raw, x - a) for x in (a, lo, hi, b)]
        pre, mid, post = (raw[x:y].decode("utf-8", "replace") for x, y in zip(at, at[1:]))
        return pre + mid + post, len(pre), len(pre) + len(mid)

    return read


RANGE = "range int, n int, found array<int>"


def text_ranges(df: DataFrame, key: str, text: str, range_chars: int, halo: int) -> DataFrame:
    """(key, range, n, found): words of each range of each text, and those that end at a boundary. A map without a shuffle."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for k, x in zip(b["key"], b["text"]):
                for i, lo in enumerate(range(0, len(x), range_chars)):
                    part, start, end, at_end = settled_range(_in_text(x), len(x), lo, min(len(x), lo + range_chars), halo)
                    rows.append((k, i, *boundaries(part, start, end, at_end)))
            yield records(rows, ["key", "range", "n", "found"])

    rows = df.filter(F.length(text) > 0).select(F.col(key).alias("key"), F.col(text).alias("text"))
    return rows.mapInPandas(run, f"key {kind}, {RANGE}")


def planned_ranges(spark: SparkSession, paths: list[str], range_bytes: int) -> DataFrame:
    """(key, size, range): the ranges of the files under ``paths``, listed through Spark's file system and spread over the tasks."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(paths).select(F.col("path").alias("key"), F.col("length").alias("size"))
    ranges = files.select("key", "size", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.col("size") - 1) / range_bytes)).cast("int"))).alias("range"))
    return ranges.repartition(partitions_for(spark, ranges.count(), 64), "key", "range")


def _each_range(b: pd.DataFrame, range_bytes: int, halo: int) -> Iterator[tuple[int, tuple[str, int, int, bool]]]:
    for i, (path, size, r) in enumerate(zip(b["key"], b["size"], b["range"])):
        with open_file(path) as file:
            lo = int(r) * range_bytes
            yield i, settled_range(_in_file(file), int(size), lo, min(int(size), lo + range_bytes), halo)


def file_ranges(ranges: DataFrame, range_bytes: int, halo: int) -> DataFrame:
    """The same rows for ``planned_ranges``: each task seeks to its ranges, none reads a whole file."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = [boundaries(*x) for _, x in _each_range(b, range_bytes, halo)]
            yield objects({"key": b["key"], "range": b["range"], "n": [n for n, _ in got], "found": [f for _, f in got]})

    return ranges.mapInPandas(run, f"key string, {RANGE}")


def natural_boundaries(ranges: DataFrame, key: str) -> DataFrame:
    """(key, word_end long): the stitched boundary table of all items, in words from the item's start."""
    table = ranges.dropDuplicates(["key", "range"])
    before = F.coalesce(F.sum(F.col("n").cast("long")).over(W.partitionBy("key").orderBy("range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    ends = table.withColumn("before", before).select("key", "before", F.explode("found").alias("within"))
    return ends.select(F.col("key").alias(key), (F.col("before") + F.col("within")).alias("word_end")).distinct()


def oversized(df: DataFrame, key: str, text: str, max_words: int) -> DataFrame:
    """Rows of more than ``max_words`` words; the length test spares most rows the word count."""
    return df.filter(F.col(key).isNotNull() & (F.length(text) > 2 * max_words) & (F.size(F.filter(F.split(text, "[ \n]+"), lambda w: w != "")) > max_words))


def item_boundaries(df: DataFrame, key: str = "page_id", text: str = "text", max_words: int = 260, range_chars: int = 65_536, halo: int = 2_048) -> DataFrame:
    return natural_boundaries(text_ranges(oversized(df, key, text, max_words), key, text, range_chars, halo), key)


class Cutter:
    """Chooses the pieces of one item while its ranges stream by in order; it holds only what the open piece reaches back to.

    A piece ends at the last boundary within ``max_words`` that leaves more than the overlap, or at the limit where there is none; the next one
    begins ``overlap`` words before that end.
    """

    def __init__(self, max_words: int, overlap: int):
        self.max_words, self.overlap = max_words, overlap
        self.seen, self.begin, self.ordinal, self.last = 0, 0, 0, 0
        self.ends: deque[int] = deque()  # boundaries that the open piece may end at
        self.ranges: deque[tuple[int, int, int]] = deque()  # (range, words before it, words before the next) that it reaches

    def push(self, number: int, words: int, found: list[int]) -> Iterator[tuple]:
        self.ranges.append((number, self.seen, self.seen + words))
        self.ends.extend(self.seen + f for f in found)
        self.seen += words
        while self.seen >= self.begin + self.max_words:
            yield from self._piece(self.begin + self.max_words)

    def finish(self) -> Iterator[tuple]:
        while self.last < self.seen:
            yield from self._piece(min(self.seen, self.begin + self.max_words))

    def _piece(self, limit: int) -> Iterator[tuple]:
        """(range, ordinal, word_start, word_end, lo, hi): the piece that begins now, once for each range that it lies in."""
        end = limit
        while self.ends and self.ends[0] <= limit:
            e = self.ends.popleft()
            end = e if e > self.begin + self.overlap else limit
        for number, lo, hi in self.ranges:
            if max(lo, self.begin) < min(hi, end):
                yield number, self.ordinal, self.begin, end, max(self.begin, lo) - lo, min(end, hi) - lo
        self.last, self.ordinal, self.begin = end, self.ordinal + 1, max(self.begin + 1, end - self.overlap)
        while self.ranges and self.ranges[0][2] <= self.begin:
            self.ranges.popleft()


PLACE = "ordinal int, word_start long, word_end long, lo int, hi int"


def cut_ranges(ranges: DataFrame, max_words: int, overlap: int) -> DataFrame:
    """(key, range, places): where the pieces of all items lie in their ranges, places as array of structs. Only counts and boundaries are shuffled."""
    kind = ranges.schema["key"].dataType.simpleString()
    names = ["key", "range", *(x.split(" ")[0] for x in PLACE.split(", "))]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, cutter, last = None, Cutter(max_words, overlap), None
        for b in batches:
            rows = []
            for k, r, n, found in zip(b["key"], b["range"], b["n"], b["found"]):
                if k != key or last is None:
                    rows += [(key, *p) for p in cutter.finish()]
                    key, cutter, last = k, Cutter(max_words, overlap), -1
                if r != last:  # a row delivered twice
                    rows += [(key, *p) for p in cutter.push(r, n, found)]
                    last = r
            yield records(rows, names)
        yield records([(key, *p) for p in cutter.finish()], names)

    ordered = ranges.repartition(shuffle_partitions(ranges.sparkSession), "key").sortWithinPartitions("key", "range")
    pieces = ordered.mapInPandas(run, f"key {kind}, range int, {PLACE}")
    return pieces.groupBy("key", "range").agg(F.collect_list(F.struct(*names[2:])).alias("places"))


def _parts(rows: list[tuple[object, int, list[str], list]]) -> pd.DataFrame:
    """What ranges, given as (key, range, own words, places), have of their pieces."""
    out = [(k, p["ordinal"], p["word_start"], p["word_end"], r, " ".join(words[p["lo"] : p["hi"]])) for k, r, words, places in rows for p in places]
    return records(out, ["key", "ordinal", "word_start", "word_end", "range", "part"])


PARTS = "ordinal int, word_start long, word_end long, range int, part string"


def _own_words(part: str, start: int, end: int) -> list[str]:
    return [m.group() for m in _WORD.finditer(part) if start <= m.start() < end]


def _whole_pieces(parts: DataFrame, key: str) -> DataFrame:
    """Pieces out of the few ranges that each lies in, put together in order."""
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("range", "part"))), lambda p: p["part"]), " ")
    return parts.groupBy("key", "ordinal", "word_start", "word_end").agg(text.alias("text")).select(F.col("key").alias(key), "ordinal", "word_start", "word_end", "text")


def split_items(df: DataFrame, key: str = "page_id", text: str = "text", max_words: int = 260, overlap: int = 40, range_chars: int = 65_536, halo: int = 2_048) -> DataFrame:
    """(key, ordinal, word_start, word_end, text) of every piece of every oversized item; rows of one key must have one text."""
    big = oversized(df, key, text, max_words)
    places = cut_ranges(text_ranges(big, key, text, range_chars, halo), max_words, overlap)
    kind = df.schema[key].dataType.simpleString()

    def words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for k, x in zip(b["key"], b["text"]):
                for i, lo in enumerate(range(0, len(x), range_chars)):
                    hi = min(len(x), lo + range_chars)
                    a, z = x.rfind("\n", 0, lo) + 1, hi
                    a = max(a, x.rfind(" ", 0, lo) + 1)
                    while z < len(x) and x[z] not in " \n":
                        z += 1
                    rows.append((k, i, " ".join(_own_words(x[a:z], lo - a, hi - a))))
            yield records(rows, ["key", "range", "words"])

    def emit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield _parts([(k, r, w.split(" "), p) for k, r, w, p in zip(b["key"], b["range"], b["words"], b["places"])])

    own = big.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInPandas(words, f"key {kind}, range int, words string").dropDuplicates(["key", "range"])
    return _whole_pieces(own.join(places, ["key", "range"]).mapInPandas(emit, f"key {kind}, {PARTS}"), key)


def split_files(spark: SparkSession, paths: list[str], max_words: int = 260, overlap: int = 40, range_bytes: int = 1 << 20, halo: int = 4_096) -> DataFrame:
    """(path, ordinal, word_start, word_end, text): the pieces of UTF-8 files on a file system that all tasks reach. Each range is read twice, by offset."""
    ranges = planned_ranges(spark, paths, range_bytes)
    places = cut_ranges(file_ranges(ranges, range_bytes, halo), max_words, overlap)

    def emit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for i, (part, start, end, _) in _each_range(b, range_bytes, halo):
                yield _parts([(b["key"].iloc[i], int(b["range"].iloc[i]), _own_words(part, start, end), b["places"].iloc[i])])

    return _whole_pieces(ranges.join(places, ["key", "range"]).mapInPandas(emit, f"key string, {PARTS}"), "path")
