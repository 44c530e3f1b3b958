"""Problem 9: text that was decoded with a wrong character encoding.

Method: noisy-channel decoding. A channel reads a token's characters back into bytes by the encoding that was wrongly used,
and decodes these bytes by the one meant. Bytes that the wrong encoding could not show, and U+FFFD, are wildcards in the byte lattice.
The source model is the corpus itself: frequencies of its words, digits masked. Per document, a Viterbi
search over its tokens chooses unchanged text or a channel for each, with a cost for each change of channel.

All counts cover the whole corpus. Only a table of character counts (bounded by Unicode) comes to the driver.
Defined results: null and empty texts are no case and stay as they are; a token that cannot be recovered (a lost character of an unknown word)
is found but stays as it is; rows of one key are taken as one document each time; rows without a key are left out.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagequarry.frames import objects, records
from pagequarry.session import broadcast_if_small, cut

WRONG = ("cp1252", "latin-1", "cp1250", "cp1251", "cp437", "cp850", "cp866", "mac_roman", "koi8_r")
MEANT = ("cp1252", "cp1251", "koi8_r", "cp866")
LOST = "�"


def _back(encoding: str) -> dict[str, int]:
    """Characters to the bytes that the encoding shows so; bytes without a character are shown as controls."""
    out = {}
    for b in range(128, 256):
        try:
            out[bytes([b]).decode(encoding)] = b
        except UnicodeDecodeError:
            out[chr(b)] = b
    for b in range(128, 160):
        out.setdefault(chr(b), b)
    return out


BACK = {e: _back(e) for e in WRONG}
#: bytes that tend to get lost: without a character in the wrong encoding, or a no-break space that became a space
GONE = {e: [b for b in range(128, 192) if bytes([b]).decode(e, "replace") in (LOST, "\xa0", "\xad")] for e in WRONG}


def to_bytes(token: str, wrong: str) -> bytes | None:
    back, out = BACK[wrong], bytearray()
    for c in token:
        if c < "\x80":
            out.append(ord(c))
        elif (b := back.get(c)) is not None:
            out.append(b)
        else:
            return None
    return bytes(out)


def lattice_utf8(raw: bytes, wrong: str, common: dict[str, int]) -> str | None:
    """The text of ``raw``, in which a sequence may lack one byte; it is filled so that its character is the commonest.

    Filled sequences alone are no evidence: there must be a whole one besides.
    """
    out, i, n, multi = [], 0, len(raw), 0
    while i < n:
        b = raw[i]
        if b < 0x80:
            out.append(chr(b))
            i += 1
            continue
        need = 2 if 0xC2 <= b < 0xE0 else 3 if 0xE0 <= b < 0xF0 else 4 if 0xF0 <= b < 0xF5 else 0
        if not need:
            return None
        j = i + 1
        while j < n and j < i + need and 0x80 <= raw[j] < 0xC0:
            j += 1
        seq = raw[i:j]
        if len(seq) == need:
            fills = [seq]
        elif len(seq) == need - 1 and common:
            fills = [seq[:k] + bytes([g]) + seq[k:] for g in GONE[wrong] for k in range(1, need)]
        else:
            return None
        best = None
        for f in fills:
            try:
                c = f.decode("utf-8")
            except UnicodeDecodeError:
                continue
            if best is None or common.get(c, 0) > common.get(best, 0):
                best = c
        if best is None or len(fills) > 1 and common.get(best, 0) < 50:
            return None
        out.append(best)
        multi += len(fills) == 1
        i = j
    return "".join(out) if multi else None


def decode(token: str, channel: str, common: dict[str, int]) -> str | None:
    """``channel``: wrong>meant, several steps apart by a bar."""
    for step in channel.split("|"):
        wrong, meant = step.split(">")
        raw = to_bytes(token, wrong)
        if raw is None:
            return None
        if meant == "utf-8":
            token = lattice_utf8(raw, wrong, common)
            if token is None:
                return None
        else:
            try:
                token = raw.decode(meant)
            except UnicodeDecodeError:
                return None
    return token


def _sane(text: str) -> bool:
    """One script, and no capital after a small letter: what words of a right decoding look like."""
    latin = any(c.isalpha() and c < "ɐ" for c in text)
    cyrillic = any("Ѐ" <= c <= "ӿ" for c in text)
    return not (latin and cyrillic) and not any(a.islower() and b.isupper() for a, b in zip(text, text[1:]))


def channels(token: str, common: dict[str, int]) -> list[tuple[str, str, bool]]:
    """(channel, restored, strong) of a token. A valid UTF-8 reading is strong evidence, another byte table weak."""
    out: list[tuple[str, str, bool]] = []
    for w in WRONG:
        raw = to_bytes(token, w)
        if raw is None:
            continue
        r = lattice_utf8(raw, w, common)
        if r is not None and r != token:
            path = f"{w}>utf-8"
            out.append((path, r, True))
            for _ in range(2):  # decoded wrongly several times
                again = [(f"{v}>utf-8", x) for v in WRONG if (b := to_bytes(r, v)) is not None and (x := lattice_utf8(b, v, {})) is not None]
                if not again:
                    break
                path, r = f"{path}|{again[0][0]}", again[0][1]
                out.append((path, r, True))
            continue
        for m in MEANT:
            if m != w:
                try:
                    x = raw.decode(m)
                except UnicodeDecodeError:
                    continue
                if x != token and _sane(x):
                    out.append((f"{w}>{m}", x, False))
    return out


_MASKS = ((re.compile(r"[0-9]+"), "0"), (re.compile(r"[A-Z]{2,}-0"), "A-0"))
_EDGE = " \t!\"#%&'()*+,-./:;<=>?@[]^_`{|}~"


@lru_cache(maxsize=200_000)
def word_key(token: str) -> str:
    """The form under which words are counted: digits and codes masked, without ASCII punctuation at its ends."""
    for pattern, by in _MASKS:
        token = pattern.sub(by, token)
    return token.strip(_EDGE)


def tokens_beyond_ascii(documents: DataFrame, key: str, text: str) -> DataFrame:
    """(key, pos, token, word) of the tokens with a character beyond ASCII, pos in the order of the text."""
    kind = documents.schema[key].dataType.simpleString()
    odd = re.compile(r"[^ \n]*[^\x00-\x7f][^ \n]*")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(k, m.start(), m.group(), word_key(m.group())) for k, x in zip(b["key"], b["text"]) if not x.isascii() for m in odd.finditer(x)]
            yield records(rows, ["key", "pos", "token", "word"])

    rows = documents.filter(F.col(text).isNotNull() & F.col(key).isNotNull()).select(F.col(key).alias("key"), F.col(text).alias("text"))
    return rows.mapInPandas(run, f"key {kind}, pos int, token string, word string")


def _character_counts(words: DataFrame) -> dict[str, int]:
    chars = words.select("f", F.explode(F.array_distinct(F.split("word", ""))).alias("c")).filter(F.col("c") > "\x7f").groupBy("c").agg(F.sum("f").alias("n"))
    return {r["c"]: r["n"] for r in chars.collect()}  # at most the characters of Unicode


def candidates(tokens: DataFrame, least_ratio: float = 4.0, least_count: int = 3) -> tuple[DataFrame, dict[str, int]]:
    """(word, options): for each word that may be damaged, its channels with their gain in log frequency."""
    words = cut(tokens.groupBy("word").agg(F.count("*").alias("f")))
    common = _character_counts(words)
    shared = tokens.sparkSession.sparkContext.broadcast(common)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        common = shared.value
        for b in batches:
            rows = []
            for w, f in zip(b["word"], b["f"]):
                if LOST in w:
                    continue
                for path, r, strong in channels(w, common):
                    beyond = [c for c in r if c > "\x7f"]
                    if all(common.get(c, 0) >= least_count for c in beyond):
                        rows.append((w, f, path, word_key(r), strong, len(beyond), r))
            yield records(rows, ["word", "f", "channel", "restored", "strong", "beyond", "raw"])

    made = words.mapInPandas(run, "word string, f long, channel string, restored string, strong boolean, beyond int, raw string")
    known = made.join(words.select(F.col("word").alias("restored"), F.col("f").alias("fr")), "restored", "left").withColumn("fr", F.coalesce("fr", F.lit(0)))
    ratio = F.log((F.col("fr") + 1.0) / (F.col("f") + 1.0))
    cyrillic = F.col("word").rlike("[Ѐ-ӿ]") & F.col("raw").rlike("[Ѐ-ӿ]")
    short = (cyrillic & (F.col("beyond") <= 2)) | (F.length("word") <= 1)
    weak = (F.col("fr") >= least_count) & (F.col("fr") >= least_ratio * F.col("f")) & (~short | (ratio >= 4.0))
    # short words alone prove nothing, but follow the channel of their neighbours
    follows = (F.col("fr") >= least_count) & (F.col("fr") >= F.col("f"))
    gain = F.when(F.col("strong"), 5.0 + F.log(F.col("fr") + 1.0)).when(weak, ratio).otherwise(0.001)
    kept = known.filter(F.col("strong") | weak | follows).select("word", F.struct(F.col("channel"), gain.alias("gain"), F.lit(None).cast("string").alias("restored")).alias("option"))
    # lost characters: words of the same pattern, the most frequent first
    pattern = F.regexp_replace("word", r"[^\x00-\x7f]", LOST)
    whole = words.filter(~F.col("word").contains(LOST)).groupBy(pattern.alias("pattern")).agg(F.max_by("word", F.struct("f", "word")).alias("best"), F.max("f").alias("fb"))
    lost = words.filter(F.col("word").contains(LOST)).select("word", pattern.alias("pattern")).join(whole, "pattern", "left")
    lost = lost.select("word", F.struct(F.lit("lost").alias("channel"), (8.0 + F.log(F.coalesce("fb", F.lit(0)) + 1.0)).alias("gain"), F.col("best").alias("restored")).alias("option"))
    return kept.unionByName(lost).groupBy("word").agg(F.collect_list("option").alias("options")), common


def viterbi(options: list[list[tuple[str, float]]], switch: float = 1.0) -> list[str]:
    """The best channel of each token; '' is unchanged text. Each change of channel costs ``switch``."""
    states: dict[str, tuple[float, tuple | None]] = {"": (0.0, None)}
    for choice in options:
        best = max(states, key=lambda s: states[s][0])
        step: dict[str, tuple[float, tuple | None]] = {}
        for channel, gain in [("", 0.0), *choice]:
            stay = states[channel][0] if channel in states else -math.inf
            came, score = (channel, stay) if stay >= states[best][0] - switch else (best, states[best][0] - switch)
            if channel not in step or step[channel][0] < score + gain:
                step[channel] = (score + gain, (channel, states[came][1]))
        states = step
    at, out = max(states.values(), key=lambda s: s[0])[1], []
    while at is not None:
        out.append(at[0])
        at = at[1]
    return out[::-1]


def damaged_tokens(documents: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """(key, positions, restored): of each damaged document its damaged tokens' places and their original, null where it is lost."""
    tokens = tokens_beyond_ascii(documents, key, text)
    kind = documents.schema[key].dataType.simpleString()
    maybe, common = candidates(tokens, **options)
    maybe = broadcast_if_small(cut(maybe), 50_000)  # then no token but those of damaged words leaves its task; beyond, adaptive execution divides hot words
    shared = tokens.sparkSession.sparkContext.broadcast(common)
    hits = tokens.join(maybe, "word").groupBy("key").agg(F.sort_array(F.collect_list(F.struct("pos", "token", "word", "options"))).alias("hits"))

    def choose(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for k, hit in zip(b["key"], b["hits"]):
                path = viterbi([[(o["channel"], o["gain"]) for o in h["options"]] for h in hit])
                places, texts = [], []
                for h, channel in zip(hit, path):
                    if channel:
                        places.append(h["pos"])
                        texts.append(_lost(h) if channel == "lost" else decode(h["token"], channel, shared.value))
                if places:
                    rows.append((k, places, texts))
            yield records(rows, ["key", "positions", "restored"])

    return hits.mapInPandas(choose, f"key {kind}, positions array<int>, restored array<string>").withColumnRenamed("key", key)


def _lost(hit) -> str | None:
    best = next((o["restored"] for o in hit["options"] if o["channel"] == "lost"), None)
    if best is None:
        return None
    fill = iter([c for c in best if c > "\x7f"])
    return "".join(next(fill, c) if c > "\x7f" else c for c in hit["token"])


def restore(documents: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """(key, text, n_damaged, n_restored): every document; only the damaged ones are written anew."""
    kind = documents.schema[key].dataType.simpleString()
    bad = broadcast_if_small(cut(damaged_tokens(documents, key, text, **options)), 20_000)  # then no text is shuffled
    rows = documents.filter(F.col(key).isNotNull()).select(key, F.col(text).alias("text"))

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out, n, m = [], [], []
            for x, places, new in zip(b["text"], b["positions"], b["restored"]):
                if places is None:
                    places, new = [], []
                parts, at, good = [], 0, 0
                for p, r in zip(places, new):
                    end = min([e for e in (x.find(" ", p), x.find("\n", p)) if e >= 0], default=len(x))
                    parts += [x[at:p], x[p:end] if r is None else r]
                    good += r is not None
                    at = end
                out.append(None if x is None else "".join(parts) + x[at:])
                n.append(len(places))
                m.append(good)
            yield objects({key: b[key], "text": out, "n_damaged": n, "n_restored": m})

    return rows.join(bad, key, "left").mapInPandas(write, f"{key} {kind}, text string, n_damaged int, n_restored int")
