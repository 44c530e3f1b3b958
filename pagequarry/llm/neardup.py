"""Problem 5: pages that differ by small edits, as a set-similarity join.

Method: grouped prefix join. A page is its set of word shingles, as 64-bit hashes. All shingles are
ordered by an estimate of their frequency (a count sketch), rare ones first; of two sets of Jaccard similarity t that
have ``common`` shingles in common or more, as many lie within the first ``n - ceil(t n) + common`` of each. Pages of equal prefix and
size collapse into one group, which goes by its smallest page id; only groups meet, by prefix shingle, under length and position filters. Pairs that met
by too few shingles are left out, the others are expanded to pairs of distinct sets and verified exactly, on shingles that a second pass over the
pages makes for these sets alone. No candidate is dropped: a hot prefix shingle is divided into blocks that meet pairwise in
separate tasks. Joins by group or set are plain ones, whose hot keys adaptive execution divides.

Defined results: null and short texts (under ``min_words``) have no partner; exact copies form one set, which goes by the smallest
id of its pages and is expanded in ``near_duplicate_pages`` only; rows delivered twice count once; null ids are left out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagequarry.frames import objects
from pagequarry.llm import tables
from pagequarry.session import broadcast_if_small, cut, partitions_for

SKETCH_BITS = range(12, 25)
BLOOM_BITS = range(12, 29)
TOKEN = 6  # bytes of a shingle's hash that the prefixes keep: more candidates at worst, never fewer

class Shingler:
    """Hashes of the sets of ``k`` consecutive lower-cased words; word hashes are kept per worker."""

    def __init__(self, k: int, most_words: int = 2_000_000):
        self.k, self.most, self.seen = k, most_words, {}

    def __call__(self, text: str) -> tuple[int, np.ndarray]:
        words = text.lower().replace("\n", " ").split(" ")
        words = [w for w in words if w]
        seen = self.seen
        if len(seen) > self.most:
            seen.clear()
        try:
            h = np.array([seen[w] for w in words], dtype=np.uint64)
        except KeyError:
            for w in words:
                if w not in seen:
                    seen[w] = xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass"))
            h = np.array([seen[w] for w in words], dtype=np.uint64)
        n = len(h) - self.k + 1
        if n < 1:
            return len(words), np.empty(0, np.uint64)
        s = np.zeros(n, np.uint64)
        with np.errstate(over="ignore"):
            for i in range(self.k):
                s = (s ^ h[i : i + n]) * np.uint64(0x9E3779B97F4A7C15)
                s ^= s >> np.uint64(29)
        return len(words), np.unique(s)


def _bits(n: float, allowed: range) -> int:
    """The binary logarithm of a table for ``n`` entries, within bounds; beyond them its entries are shared by more and more."""
    return max(allowed.start, min(allowed.stop - 1, math.ceil(math.log2(max(2.0, n)))))


def _bucket(s: np.ndarray, size: int) -> np.ndarray:
    """By the upper bits, which prefixes keep too."""
    return (s >> np.uint64(65 - size.bit_length())).astype(np.int64)


def _sum(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.minimum(a.astype(np.int64) + b, 2**32 - 1).astype(np.uint32)


def shingle_sketch(pages: DataFrame, text: str, k: int, min_words: int, bits: int | None = None) -> tables.Shared:
    """Pages per sketch bucket, over all pages; the table's size follows the length of the texts. Each task adds up its own pages first."""
    if bits is None:
        chars = pages.agg(F.sum(F.octet_length(text))).first()[0] or 0
        bits = _bits(chars / 16, SKETCH_BITS)
    size = 2**bits

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingle, total = Shingler(k), np.zeros(size, np.uint32)
        for b in batches:
            found = []
            for t in b["text"]:
                if t is not None:
                    n, s = shingle(t)
                    if n >= min_words:
                        found.append(_bucket(s, size))
            if found:
                np.add.at(total, np.concatenate(found), 1)
        yield tables.parts_of(total)

    parts = pages.select(F.col(text).alias("text")).mapInPandas(run, tables.PART)
    return tables.Shared(pages.sparkSession, tables.added_up(parts, np.uint32, _sum), size, np.uint32)


def _bloom_at(ids: np.ndarray, size: int) -> np.ndarray:
    """Three bits of each id, as positions."""
    u = ids.astype(np.int64).view(np.uint64)
    out = []
    with np.errstate(over="ignore"):
        for m in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9):
            x = (u ^ (u >> np.uint64(31))) * np.uint64(m)
            out.append(_bucket(x ^ (x >> np.uint64(29)) * np.uint64(m), size))
    return np.stack(out)


def _keep_wanted(rows: DataFrame, key: str, wanted: DataFrame, n: int) -> DataFrame:
    """The rows whose ``key`` may be among the ``n`` ids ``wanted``: a Bloom filter spares the others what follows; the join after it is exact."""
    size = 2 ** _bits(12.0 * n, BLOOM_BITS)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bits = np.zeros(size, bool)
        for b in batches:
            bits[_bloom_at(b.iloc[:, 0].to_numpy(), size).ravel()] = True
        yield tables.parts_of(np.packbits(bits))

    table = tables.added_up(wanted.mapInPandas(run, tables.PART), np.uint8, np.bitwise_or)
    shared = tables.Shared(rows.sparkSession, table, size // 8, np.uint8)

    @F.pandas_udf(T.BooleanType())
    def known(ids: pd.Series) -> pd.Series:
        at = _bloom_at(ids.to_numpy(), size)
        return pd.Series(((shared.table()[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1).all(axis=0))

    return rows.filter(known(key))


def prefix_length(n: np.ndarray | int, t: float, common: int = 1):
    """How many of a set's first shingles must hold ``common`` shared ones with any set of similarity ``t``, or all shared ones if these are fewer."""
    least = np.ceil(t * n - 1e-9).astype(np.int64)
    return n - least + np.minimum(common, least)


def shared_least(na: np.ndarray, nb: np.ndarray, t: float) -> np.ndarray:
    """Shingles that sets of these sizes share at least if their similarity is ``t``."""
    return np.ceil(t / (1 + t) * (na + nb) - 1e-9).astype(np.int64)


def signatures(pages: DataFrame, key: str, text: str, k: int, t: float, min_words: int, common: int, sketch: tables.Shared) -> DataFrame:
    """(id, set_hash, group_hash, n, prefix): prefix has the rarest shingles as bytes, TOKEN of each, in order."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingle, counts = Shingler(k), sketch.table()
        for b in batches:
            ids, sets, groups, sizes, rows = [], [], [], [], []
            for i, x in zip(b["id"], b["text"]):
                words, s = shingle(x)
                if words < min_words or not len(s):
                    continue
                s = s[np.lexsort((s, counts[_bucket(s, sketch.size)]))]
                p = int(prefix_length(np.int64(len(s)), t, common))
                raw = s.tobytes()
                ids.append(i)
                sets.append(xxhash.xxh3_64_intdigest(raw) - 2**63)
                groups.append(xxhash.xxh3_64_intdigest(raw[: 8 * p] + len(s).to_bytes(8, "little"), seed=1) - 2**63)
                sizes.append(len(s))
                rows.append(s[:p].view(np.uint8).reshape(-1, 8)[:, 8 - TOKEN :].tobytes())
            yield objects({"id": ids, "set_hash": np.array(sets, np.int64), "group_hash": np.array(groups, np.int64), "n": np.array(sizes, np.int32), "prefix": rows})

    rows = pages.filter(F.col(key).isNotNull() & F.col(text).isNotNull()).select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
    return rows.mapInPandas(run, "id long, set_hash long, group_hash long, n int, prefix binary")


def _tokens(prefixes: pd.Series) -> np.ndarray:
    raw = np.frombuffer(b"".join(prefixes), np.uint8).reshape(-1, TOKEN)
    whole = np.zeros((len(raw), 8), np.uint8)
    whole[:, 8 - TOKEN :] = raw
    return whole.view(np.uint64).ravel()


def _meet(pdf_iter: Iterator[pd.DataFrame], t: float, common: int) -> Iterator[pd.DataFrame]:
    """Pairs of groups that share prefix shingles. Rows come sorted by token, cell and size; a token may run over several batches.

    ``side`` says in which role a row meets the others of its block pair: rows of one block (0) meet
    each other once, rows of two blocks (1 and 2) meet across.
    """
    rest = None
    for pdf in pdf_iter:
        if rest is not None:
            pdf = pd.concat([rest, pdf], ignore_index=True)
        if not len(pdf):
            continue
        cutat = np.flatnonzero((pdf["token"].to_numpy() != pdf["token"].iloc[-1]) | (pdf["cell"].to_numpy() != pdf["cell"].iloc[-1]))
        at = int(cutat[-1]) + 1 if len(cutat) else 0
        rest = pdf.iloc[at:]
        if at:
            yield from _pairs(pdf.iloc[:at], t, common)
    if rest is not None and len(rest):
        yield from _pairs(rest, t, common)


def _pairs(pdf: pd.DataFrame, t: float, common: int, step: int = 2_000_000) -> Iterator[pd.DataFrame]:
    """(ga, gb, c, least): c shingles by which two groups met here, and how many they need in all."""
    tok, cell, g, side = (pdf[x].to_numpy() for x in ("token", "cell", "gid", "side"))
    n, pos = pdf["place"].to_numpy() >> 32, pdf["place"].to_numpy() & 0xFFFFFFFF
    start = np.flatnonzero(np.r_[True, (tok[1:] != tok[:-1]) | (cell[1:] != cell[:-1])])
    end = np.r_[start[1:], len(tok)]
    # each row meets the later rows of its run whose size is at most its own over t (rows are sorted by size)
    run_end = np.repeat(end, end - start)
    # offset sizes by run so that one searchsorted serves all runs
    run_no = np.repeat(np.arange(len(start)), end - start)
    big = int(n.max()) + 2
    order_key = run_no * big + n
    limit = np.minimum(run_no * big + np.minimum((n / t + 1e-9).astype(np.int64), big - 1), (run_no + 1) * big - 1)
    last = np.minimum(np.searchsorted(order_key, limit, side="right"), run_end)
    many = np.maximum(0, last - np.arange(len(tok)) - 1)
    todo = np.flatnonzero(many)
    total = np.cumsum(many[todo])
    lo = 0
    while lo < len(todo):
        hi = max(lo + 1, int(np.searchsorted(total, (total[lo - 1] if lo else 0) + step)))
        rows = todo[lo:hi]
        m = many[rows]
        a = np.repeat(rows, m)
        b = a + 1 + np.arange(len(a)) - np.repeat(np.cumsum(m) - m, m)
        # the first ``wanted`` shared shingles of a similar pair leave room for all that t asks for after them
        need = shared_least(n[a], n[b], t)
        wanted = np.minimum(common, need)
        ok = (np.minimum(n[a] - pos[a], n[b] - pos[b]) >= need - wanted + 1) & (g[a] != g[b]) & ((side[a] == 0) | (side[b] == 0) | (side[a] != side[b]))
        a, b, wanted = a[ok], b[ok], wanted[ok]
        if len(a):
            x, y = np.minimum(g[a], g[b]), np.maximum(g[a], g[b])
            order = np.lexsort((y, x))
            x, y, wanted = x[order], y[order], wanted[order]
            first = np.flatnonzero(np.r_[True, (x[1:] != x[:-1]) | (y[1:] != y[:-1])])
            yield pd.DataFrame({"ga": x[first], "gb": y[first], "c": np.diff(np.r_[first, len(x)]), "least": wanted[first]})
        lo = hi


def similar_pairs(pages: DataFrame, key: str = "page_id", text: str = "text", k: int = 5, t: float = 0.8, min_words: int = 1, block: int = 2_000, common: int = 4) -> tuple[DataFrame, DataFrame]:
    """(pairs of different sets, copies).

    pairs: set_a, set_b, similarity, set_a < set_b, each at least ``t``. copies: set_id, id of every set that several pages have. A set's id is
    the smallest id of its pages; pages of one set are of similarity 1 to each other.
    """
    sketch = shingle_sketch(pages, text, k, min_words)
    sig = cut(signatures(pages, key, text, k, t, min_words, common, sketch))
    many = cut(sig.groupBy("group_hash", "n").agg(F.min("id").alias("gid"), F.max("id").alias("last")).filter("gid != last").drop("last"))
    named = sig.join(broadcast_if_small(many), ["group_hash", "n"], "left")
    # the sets of groups of several pages; every other group is one set of one page
    inside = cut(named.filter("gid is not null").select("gid", "set_hash", "id").distinct())
    sets = inside.groupBy("gid", "set_hash").agg(F.min("id").alias("sid"), F.max("id").alias("last"))
    copies = inside.join(sets.filter("sid != last"), ["gid", "set_hash"]).select(F.col("sid").alias("set_id"), "id")
    met = _group_pairs(named.filter("gid is null or gid = id").select(F.col("id").alias("gid"), "n", "prefix"), sketch, t, block, common)
    # group pairs, and the pairs within a group, expand to pairs of different sets
    side = lambda x: sets.select(F.col("gid").alias(f"g{x}"), F.col("sid").alias(f"s{x}"))
    across = met.join(side("a"), "ga", "left").join(side("b"), "gb", "left").select(F.coalesce("sa", "ga").alias("sa"), F.coalesce("sb", "gb").alias("sb"))
    within = side("a").join(side("b").withColumnRenamed("gb", "ga"), "ga").filter("sa < sb").select("sa", "sb")
    cand = cut(across.unionByName(within).select(F.least("sa", "sb").alias("set_a"), F.greatest("sa", "sb").alias("set_b")))
    return verified(cand, pages, key, text, k, t), copies


def verified(cand: DataFrame, pages: DataFrame, key: str, text: str, k: int, t: float) -> DataFrame:
    """(set_a, set_b, similarity) of the candidates that are similar; their shingles are made again in a second pass over the pages."""
    wanted = cand.select(F.explode(F.array("set_a", "set_b")).alias("sid")).distinct()
    n = 2 * cand.count()
    few = _keep_wanted(pages.filter(F.col(key).isNotNull() & F.col(text).isNotNull()).select(F.col(key).cast("long").alias("sid"), F.col(text).alias("text")), "sid", wanted, n)

    def shingles(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingle = Shingler(k)
        for b in batches:
            yield objects({"sid": b["sid"], "body": [shingle(x)[1].tobytes() for x in b["text"]]})

    body = few.mapInPandas(shingles, "sid long, body binary").join(wanted, "sid", "left_semi").groupBy("sid").agg(F.first("body").alias("body"))
    both = cand.join(body.select(F.col("sid").alias("set_a"), F.col("body").alias("xa")), "set_a").join(body.select(F.col("sid").alias("set_b"), F.col("body").alias("xb")), "set_b")

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            sim = np.empty(len(b))
            for i, (x, y) in enumerate(zip(b["xa"], b["xb"])):
                shared = len(np.intersect1d(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), assume_unique=True))
                sim[i] = shared / ((len(x) + len(y)) // 8 - shared)
            keep = sim >= t - 1e-12
            yield objects({"set_a": b["set_a"][keep], "set_b": b["set_b"][keep], "similarity": sim[keep]})

    return both.mapInPandas(verify, "set_a long, set_b long, similarity double")


def _group_pairs(groups: DataFrame, sketch: tables.Shared, t: float, block: int, common: int) -> DataFrame:
    """(ga, gb): groups that share enough prefix shingles and pass the filters.

    Shingles that the sketch counts once have no partner and are not posted. One that it counts at most ``block`` (over the mean load)
    has no more postings than that. The others are divided into blocks of near sizes that meet pairwise, each pair of blocks in a cell of its own.
    """
    spark = groups.sparkSession
    table = tables.opened(sketch.blocks.value, sketch.size, np.uint32)
    most = block + float(table.mean(dtype=np.float64))
    any_hot = bool((table > most).any())
    schema = "token long, gid long, place long"  # place: the group's size, and the shingle's place among its own

    def postings(hot: bool):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            counts = sketch.table()
            for b in batches:
                if not len(b):
                    continue
                n = b["n"].to_numpy(np.int64)
                p = prefix_length(n, t, common)
                tok = _tokens(b["prefix"])
                pos = np.arange(len(tok)) - np.repeat(np.cumsum(p) - p, p)
                c = counts[_bucket(tok, sketch.size)]
                ok = (c > most) if hot else (c > 1) & (c <= most)
                yield pd.DataFrame({"token": (tok >> np.uint64(64 - 8 * TOKEN)).astype(np.int64)[ok], "gid": np.repeat(b["gid"].to_numpy(), p)[ok], "place": ((np.repeat(n, p) << 32) + pos)[ok]})

        return groups.mapInPandas(run, schema)

    length = F.octet_length("prefix") / TOKEN
    parts = partitions_for(spark, int(groups.agg(F.sum(length)).first()[0] or 0), 1_000_000)
    met_schema = "ga long, gb long, c long, least long"
    cold = postings(False).repartition(parts, "token").sortWithinPartitions("token", "place", "gid")
    found = cold.withColumn("cell", F.lit(0).cast("long")).withColumn("side", F.lit(0)).mapInPandas(lambda it: _meet(it, t, common), met_schema)
    if any_hot:
        hot = postings(True).distinct()
        blocks = hot.groupBy("token").agg(F.ceil(F.count("*") / block).cast("long").alias("blocks"))
        # the rank within a token comes from the counts of its sizes, not from a window over the whole token
        hot = hot.withColumn("n", F.shiftright("place", 32))
        by_size = hot.groupBy("token", "n").agg(F.count("*").alias("many"))
        before = by_size.withColumn("before", F.sum("many").over(W.partitionBy("token").orderBy("n")) - F.col("many"))
        ranked = hot.join(before, ["token", "n"]).join(blocks, "token").withColumn("blk", F.least(F.col("blocks") - 1, F.floor((F.col("before") + F.pmod(F.xxhash64("gid"), F.col("many"))) / block).cast("long")))
        # a row of block i goes to cell (i, j) for each j: as side 1 or 2 to meet another block, as side 0 to meet its own
        met = ranked.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).select(
            "token", "gid", "place",
            (F.least("blk", "other") * F.col("blocks") + F.greatest("blk", "other")).alias("cell"),
            F.when(F.col("blk") == F.col("other"), 0).when(F.col("blk") < F.col("other"), 1).otherwise(2).alias("side"),
        )
        found = found.unionByName(met.repartition(parts, "token", "cell").sortWithinPartitions("token", "cell", "place", "gid").mapInPandas(lambda it: _meet(it, t, common), met_schema))
    return found.groupBy("ga", "gb").agg(F.sum("c").alias("c"), F.max("least").alias("least")).filter("c >= least").select("ga", "gb")


def near_duplicate_pages(pages: DataFrame, key: str = "page_id", text: str = "text", k: int = 5, t: float = 0.8, min_words: int = 1) -> DataFrame:
    """(id_a, id_b), id_a < id_b: every pair of rows with similarity at least ``t``, copies included."""
    pairs, copies = similar_pairs(pages, key, text, k, t, min_words)
    side = lambda x: copies.select(F.col("set_id").alias(f"set_{x}"), F.col("id").alias(x))
    across = pairs.join(side("a"), "set_a", "left").join(side("b"), "set_b", "left").select(F.coalesce("a", "set_a").alias("a"), F.coalesce("b", "set_b").alias("b"))
    within = side("a").join(side("b").withColumnRenamed("set_b", "set_a"), "set_a").filter("a < b").select("a", "b")
    return across.unionByName(within).select(F.least("a", "b").alias("id_a"), F.greatest("a", "b").alias("id_b")).distinct()
