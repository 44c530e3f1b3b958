"""Problem 1: the k most similar vectors of every vector.

Method: vantage-point trees per shard. A bounded sample of vectors serves as vantage points of the first
level; the vectors nearest to one form its shard. A shard of more than ``shard_rows`` vectors is divided in the same way by vantage points out of
its own vectors. Each such cell is held as a vantage-point tree.
For unit vectors a cosine of at least c is a Euclidean distance of at most r = sqrt(2 - 2 c), so a cell or subtree
can only hold such neighbours of q if the triangle inequality allows it; the bound 2 r (cells) or r (subtrees) is relaxed by ``factor`` (cells) and
``tree_factor`` (subtrees): ``factor`` 1 alone restores exact search, smaller values look into fewer cells. A pair that is met from either side counts
for both vectors. Vectors travel to their cells as half floats (``compact``; similarities then err by under 0.001).

Equal vectors collapse into one before the search. Their first k + 1 ids stand for them as neighbours (ties go to smaller ids),
all of them get results. Defined results: null, zero and NaN vectors and those of another length are left out;
an id with several vectors keeps the first by value; an empty table gives an empty table.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pagequarry.session import broadcast_if_small, cut, partitions_for, smallest_hashes


def usable(vectors: DataFrame, key: str, vector: str, dim: int) -> DataFrame:
    """(id, v): the usable vectors as float arrays."""
    v = F.col(vector)
    ok = v.isNotNull() & F.col(key).isNotNull() & (F.size(v) == dim) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x)) & F.exists(v, lambda x: x != 0)
    return vectors.filter(ok).select(F.col(key).cast("long").alias("id"), v.cast("array<float>").alias("v"))


def _units(series: pd.Series) -> np.ndarray:
    x = np.stack(series.to_numpy()).astype(np.float32)
    x /= np.abs(x).max(axis=1, keepdims=True)  # lengths near the float range
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def unit_vectors(vectors: DataFrame, key: str, vector: str, dim: int, among: DataFrame | None) -> DataFrame:
    """(id, h, unit): one unit vector of each id, as float32 bytes, and its 128-bit hash. ``among`` has the ids that count; vectors are shuffled once for both."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                units = [x.tobytes() for x in np.round(_units(b["v"]), 7) + np.float32(0)]
                yield pd.DataFrame({"id": b["id"], "h": [xxhash.xxh3_128_digest(x) for x in units], "unit": units})

    units = usable(vectors, key, vector, dim).mapInPandas(run, "id long, h binary, unit binary")
    if among is not None:
        units = units.join(among.select(F.col(among.columns[0]).cast("long").alias("id")).filter("id is not null"), "id", "left_semi")
    return units.groupBy("id").agg(F.min(F.struct("unit", "h")).alias("_v")).select("id", "_v.h", "_v.unit")


class VPTree:
    """A vantage-point tree over unit vectors with a leaf size, searched for many queries at once."""

    def __init__(self, x: np.ndarray, leaf: int = 256):
        self.x, self.leaf = x, leaf
        self.root = self._build(np.arange(len(x)))

    def _build(self, rows: np.ndarray):
        if len(rows) <= self.leaf:
            return rows
        p = rows[len(rows) // 2]
        d = np.sqrt(np.maximum(0, 2 - 2 * (self.x[rows] @ self.x[p])))
        mu = float(np.median(d))
        inner, outer = rows[d <= mu], rows[d > mu]
        if not len(inner) or not len(outer):
            return rows
        return p, mu, float(d[d <= mu].max()), self._build(inner), self._build(outer)

    def search(self, q: np.ndarray, r: float, factor: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(query rows, data rows) blocks to compare: the leaves that the relaxed triangle inequality leaves over."""
        stack = [(self.root, np.arange(len(q)))]
        while stack:
            node, rows = stack.pop()
            if not len(rows):
                continue
            if isinstance(node, np.ndarray):
                yield rows, node
                continue
            p, mu, _, inner, outer = node
            d = np.sqrt(np.maximum(0, 2 - 2 * (q[rows] @ self.x[p])))
            stack.append((inner, rows[d <= mu + factor * r]))
            stack.append((outer, rows[d >= mu - factor * r]))


def vantage_points(units: DataFrame, n: int, most: int) -> np.ndarray:
    """A uniform sample of sqrt(n) / 3 unit vectors, at most ``most``: the rows with the smallest hashes of their ids."""
    want = min(most, max(8, math.ceil(math.sqrt(n) / 3)))
    got = smallest_hashes(units, "rep", want, n).collect()  # bounded by ``most``
    return np.stack([np.frombuffer(r["unit"], np.float32) for r in got])


class Router:
    """The cells of vectors: shards by vantage points of the first level, large shards divided by vantage points of their own."""

    def __init__(self, points: np.ndarray, margin: float):
        self.points, self.margin = points, margin
        self.second: dict[int, np.ndarray] = {}  # shard to its own vantage points

    @staticmethod
    def distances(x: np.ndarray, points: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(0, 2 - 2 * (x @ points.T)))

    def _near(self, x: np.ndarray, points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, point) of all points that are near enough, and each row's nearest point."""
        d = self.distances(x, points)
        home = d.argmin(axis=1)
        rows = np.arange(len(x))
        close = d - d[rows, home][:, None] <= self.margin
        close[rows, home] = True
        return (*np.nonzero(close), home)

    def shards(self, x: np.ndarray) -> np.ndarray:
        return (x @ self.points.T).argmax(axis=1)

    def cells(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, cell, whether it is the row's home) of every cell that a row has to visit."""
        i, shard, home = self._near(x, self.points)
        cell, at_home = shard.astype(np.int64) << 24, shard == home[i]
        large = np.isin(shard, list(self.second)) if self.second else np.zeros(len(i), bool)
        if not large.any():
            return i, cell, at_home
        out = [(i[~large], cell[~large], at_home[~large])]
        for s in np.unique(shard[large]):
            mine = np.flatnonzero(large & (shard == s))
            j, sub, nearest = self._near(x[i[mine]], self.second[int(s)])
            out.append((i[mine][j], cell[mine][j] + sub, at_home[mine][j] & (sub == nearest[j])))
        return tuple(np.concatenate(c) for c in zip(*out))


def _slices(batches: Iterator[pd.DataFrame], rows: int = 2_000) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
    for b in batches:
        for lo in range(0, len(b), rows):
            part = b.iloc[lo : lo + rows]
            yield part, np.stack([np.frombuffer(u, np.float32) for u in part["unit"]])


def _second_level(reps: DataFrame, router: Router, shard_rows: int, most: int) -> dict[int, np.ndarray]:
    """Vantage points of the shards that hold more than ``shard_rows`` vectors: a uniform sample of about two for each ``shard_rows``, at most ``most`` in all."""
    shared = reps.sparkSession.sparkContext.broadcast(router)

    def homes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(len(shared.value.points), np.int64)
        for _, x in _slices(batches):
            total += np.bincount(shared.value.shards(x), minlength=len(total))
        at = np.flatnonzero(total)
        yield pd.DataFrame({"shard": at.astype(np.int32), "n": total[at]})

    counts = reps.select("unit").mapInPandas(homes, "shard int, n long").groupBy("shard").agg(F.sum("n").alias("n")).filter(F.col("n") > shard_rows)
    large = {r["shard"]: r["n"] for r in counts.collect()}  # at most one row a vantage point
    if not large:
        return {}
    each = max(shard_rows // 2, math.ceil(sum(large.values()) / (0.9 * most)))

    def sampled(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part, x in _slices(batches):
            shard = shared.value.shards(x)
            ok = np.isin(shard, list(large))
            yield pd.DataFrame({"shard": shard[ok].astype(np.int32), "unit": part["unit"].to_numpy()[ok]})

    few = reps.filter(F.pmod(F.xxhash64("rep", F.lit(1)), F.lit(each)) == 0).select("unit").mapInPandas(sampled, "shard int, unit binary")
    found: dict[int, list[np.ndarray]] = {}
    for r in few.collect():  # about ``most`` rows at most
        found.setdefault(r["shard"], []).append(np.frombuffer(r["unit"], np.float32))
    return {s: np.stack(x) for s, x in found.items() if len(x) > 1}


def similar_vectors(vectors: DataFrame, key: str = "embedding_id", vector: str = "embedding", k: int = 5, min_similarity: float = 0.8, factor: float = 0.09, tree_factor: float | None = None, dim: int = 64, most_vantage: int = 8_192, shard_rows: int = 20_000, compact: bool | None = None, among: DataFrame | None = None, task_rows: int = 60_000) -> DataFrame:
    """(id, neighbour, similarity): for each usable vector its at most k most similar others of at least ``min_similarity``.

    ``tree_factor`` (0.3) and ``compact`` (true) follow ``factor`` where they are not given: at 1 they are 1 and false, so that the search is exact.
    A task searches for about ``task_rows`` vectors: a cell that more of them visit is searched by several tasks, which hold its tree each.
    """
    tree_factor = (1.0 if factor >= 1 else 0.3) if tree_factor is None else tree_factor
    compact = factor < 1 if compact is None else compact
    spark = vectors.sparkSession
    per_id = cut(unit_vectors(vectors, key, vector, dim, among))
    copied = cut(per_id.groupBy("h").agg(F.min("id").alias("rep"), F.max("id").alias("last")).filter("rep != last").select("h", "rep"))
    named = per_id.join(broadcast_if_small(copied), "h", "left")
    reps = named.filter("rep is null or rep = id").select(F.col("id").alias("rep"), "unit")
    n = reps.count()
    if not n:
        return spark.createDataFrame([], "id long, neighbour long, similarity double")
    r = math.sqrt(max(0.0, 2 - 2 * min_similarity))
    router = Router(vantage_points(reps, n, most_vantage), 2 * factor * r)
    router.second = _second_level(reps, router, shard_rows, 64 * most_vantage)
    shared = spark.sparkContext.broadcast(router)  # bounded by ``most_vantage``

    def visits(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: Counter[int] = Counter()
        for _, x in _slices(batches):
            total.update(dict(zip(*(c.tolist() for c in np.unique(shared.value.cells(x)[1], return_counts=True)))))
        yield pd.DataFrame({"cell": np.array(list(total), np.int64), "n": np.array(list(total.values()), np.int64)})

    visited = cut(reps.select("unit").mapInPandas(visits, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")))
    all_visits = visited.agg(F.sum("n")).first()[0]
    busy = {c["cell"]: -(-c["n"] // task_rows) for c in visited.filter(F.col("n") > task_rows).collect()}  # at most all_visits / task_rows cells
    salts = spark.sparkContext.broadcast(busy)

    def route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part, x in _slices(batches):
            i, cell, at_home = shared.value.cells(x)
            rep, unit = part["rep"].to_numpy(), part["unit"].to_numpy()
            if compact:
                unit = np.array([u.astype(np.float16).tobytes() for u in x], dtype=object)
            unit, salt = unit[i], np.zeros(len(i), np.int32)
            more = []
            if busy := salts.value:
                many = np.array([busy.get(c, 1) for c in cell.tolist()])
                salt = np.where(at_home, 0, (rep[i] * 2_654_435_761 & 0x7FFFFFFF) % many).astype(np.int32)
                more = [(j, s) for j in np.flatnonzero(at_home & (many > 1)) for s in range(1, many[j])]  # a cell's own vectors go to all its tasks
            j, s = np.array([j for j, _ in more], np.int64), np.array([s for _, s in more], np.int32)
            at, salt = np.r_[np.arange(len(i)), j], np.r_[salt, s].astype(np.int32)
            yield pd.DataFrame({"cell": cell[at], "salt": salt, "is_home": at_home[at], "rep": rep[i][at], "unit": unit[at]})

    def within(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows come sorted by cell and salt, those at home first: they make the tree, which all others of the cell then pass by."""
        at, home, tree = None, [], None

        def close(own) -> Iterator[pd.DataFrame]:
            if at[1] == 0:  # one of a cell's tasks also meets its own vectors with each other
                yield from _search(pd.concat(home), own, k, min_similarity, r, tree_factor)

        for b in batches:
            if not len(b):
                continue
            c, s, h = (b[x].to_numpy() for x in ("cell", "salt", "is_home"))
            cuts = [0, *(np.flatnonzero((c[1:] != c[:-1]) | (s[1:] != s[:-1]) | (h[1:] != h[:-1])) + 1), len(b)]
            for lo, hi in zip(cuts, cuts[1:]):
                piece = b.iloc[lo:hi]
                if at != (c[lo], s[lo]):
                    if home:
                        yield from close(_tree(home, dim))
                    at, home, tree = (c[lo], s[lo]), [], None
                if h[lo]:
                    home.append(piece)
                    continue
                if home:
                    tree = _tree(home, dim)
                    yield from close(tree)
                    home = []
                if tree is not None:
                    yield from _search(piece, tree, k, min_similarity, r, tree_factor)
        if home:
            yield from close(_tree(home, dim))

    routed = reps.mapInPandas(route, "cell long, salt int, is_home boolean, rep long, unit binary")
    parts = partitions_for(spark, all_visits, task_rows)
    ordered = routed.repartition(parts, "cell", "salt").sortWithinPartitions("cell", "salt", F.desc("is_home"))
    met = ordered.mapInPandas(within, "a long, b long, similarity float")
    return _best(met, named.filter("rep is not null").select("rep", "id"), k)


def _vector(raw: bytes, dim: int) -> np.ndarray:
    return np.frombuffer(raw, np.float32 if len(raw) == 4 * dim else np.float16).astype(np.float32)


def _tree(home: list[pd.DataFrame], dim: int) -> tuple[VPTree, np.ndarray]:
    """The tree of a cell's own rows, about ``shard_rows`` of them at most, and their ids."""
    x = np.stack([_vector(u, dim) for part in home for u in part["unit"]])
    return VPTree(x), np.concatenate([part["rep"].to_numpy() for part in home])


def _search(rows: pd.DataFrame, own: tuple[VPTree, np.ndarray], k: int, least: float, r: float, factor: float) -> Iterator[pd.DataFrame]:
    """Meets queries with a cell's tree; of each vector the k best, in both directions."""
    tree, ids = own
    x = tree.x
    for lo in range(0, len(rows), 4_096):
        part = rows.iloc[lo : lo + 4_096]
        q = np.stack([_vector(u, x.shape[1]) for u in part["unit"]])
        me = part["rep"].to_numpy()
        a, b, s = [], [], []
        for qi, xi in tree.search(q, r, factor):
            c = q[qi] @ x[xi].T
            i, j = np.nonzero(c >= least - 1e-6)
            a.append(me[qi[i]])
            b.append(ids[xi[j]])
            s.append(c[i, j])
        if not a:
            continue
        out = pd.DataFrame({"a": np.concatenate(a), "b": np.concatenate(b), "similarity": np.concatenate(s)})
        out = out[out["a"] != out["b"]].drop_duplicates(["a", "b"])
        both = pd.concat([out, out.rename(columns={"a": "b", "b": "a"})[["a", "b", "similarity"]]])
        both = both.drop_duplicates(["a", "b"]).sort_values(["a", "similarity", "b"], ascending=[True, False, True])
        yield both[both.groupby("a").cumcount() < k]


def _best(met: DataFrame, of: DataFrame, k: int) -> DataFrame:
    """The k best of each id out of the pairs of representatives. ``of``: (rep, id) of equal vectors; as neighbours at most k + 1 ids of a direction count."""
    pairs = met.groupBy("a", "b").agg(F.max("similarity").alias("similarity"))
    top = F.row_number().over(W.partitionBy("a").orderBy(F.desc("similarity"), "b"))
    pairs = pairs.withColumn("rank", top).filter(F.col("rank") <= k).drop("rank")
    first = of.withColumn("rank", F.row_number().over(W.partitionBy("rep").orderBy("id"))).filter(F.col("rank") <= k + 1).drop("rank")
    # neighbours: a representative stands for its first ids
    b_ids = pairs.join(first.select(F.col("rep").alias("b"), F.col("id").alias("nb")), "b", "left").select("a", F.coalesce("nb", "b").alias("neighbour"), F.col("similarity").cast("double").alias("similarity"))
    # queries: every id of a representative
    asked = b_ids.join(of.select(F.col("rep").alias("a"), F.col("id").alias("q")), "a", "left").select(F.coalesce("q", "a").alias("id"), "neighbour", "similarity")
    among = of.join(first.select("rep", F.col("id").alias("neighbour")), "rep").filter("id != neighbour").select("id", "neighbour", F.lit(1.0).alias("similarity"))
    ranked = asked.unionByName(among).withColumn("rank", F.row_number().over(W.partitionBy("id").orderBy(F.desc("similarity"), "neighbour")))
    return ranked.filter(F.col("rank") <= k).select("id", "neighbour", "similarity")
