"""Vectors, near-duplicates, splitting, packing: against brute force on small tables."""

import itertools
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pagequarry.llm import neardup, packing, splitting, vectors


def brute_neighbours(rows, k, least):
    ids = sorted(rows)
    x = np.stack([rows[i] / np.linalg.norm(rows[i]) for i in ids])
    s = x @ x.T
    out = {}
    for a, i in enumerate(ids):
        order = sorted((-round(float(s[a, b]), 5), ids[b]) for b in range(len(ids)) if b != a)
        out[i] = [(j, -v) for v, j in order if -v >= least][:k]
    return out


def clustered(n, dim=8, seed=3):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(max(1, n // 6), dim))
    return {i: (centres[i % len(centres)] + 0.25 * rng.normal(size=dim)).astype(np.float32) for i in range(n)}


@pytest.mark.parametrize("shard_rows,most_vantage,task_rows", [(20_000, 8_192, 60_000), (7, 4, 60_000), (7, 4, 5), (20_000, 8_192, 9)])
def test_factor_one_is_exact(spark, shard_rows, most_vantage, task_rows):
    """Also with shards that are divided by vantage points of their own, and cells that several tasks search."""
    rows = clustered(150)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in rows.items()], "embedding_id long, embedding array<float>")
    got = {}
    for r in vectors.similar_vectors(df, dim=8, factor=1.0, tree_factor=1.0, compact=False, shard_rows=shard_rows, most_vantage=most_vantage, task_rows=task_rows).collect():
        got.setdefault(r["id"], []).append(r["similarity"])
    want = {i: [v for _, v in w] for i, w in brute_neighbours(rows, 5, 0.8).items() if w}
    assert got.keys() == want.keys()
    assert all(len(got[i]) == len(want[i]) and np.allclose(sorted(got[i]), sorted(want[i]), atol=1e-4) for i in want)


@pytest.mark.parametrize("most_vantage", [1, 8_192])
def test_factor_one_alone_is_exact(spark, most_vantage):
    """One shard of several subtrees, and many shards with copies between them."""
    rows = clustered(600)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in rows.items()], "embedding_id long, embedding array<float>")
    got = {}
    for r in vectors.similar_vectors(df, dim=8, factor=1.0, most_vantage=most_vantage).collect():
        got.setdefault(r["id"], []).append(r["similarity"])
    want = {i: [v for _, v in w] for i, w in brute_neighbours(rows, 5, 0.8).items() if w}
    assert got.keys() == want.keys()
    assert all(len(got[i]) == len(want[i]) and np.allclose(sorted(got[i]), sorted(want[i]), atol=3e-5) for i in want)


def test_relaxed_search_finds_nine_of_ten(spark):
    rows = clustered(600, 16, 5)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in rows.items()], "embedding_id long, embedding array<float>")
    got = {(r["id"], r["neighbour"]) for r in vectors.similar_vectors(df, dim=16).collect()}
    want = {(i, j) for i, w in brute_neighbours(rows, 5, 0.8).items() for j, _ in w}
    assert len(got & want) >= 0.9 * len(want) > 0


def test_vectors_unusable_equal_and_empty(spark):
    bad = [(100, None), (101, [0.0, 0.0]), (102, [float("nan"), 1.0]), (103, [1.0]), (None, [1.0, 0.0]), (104, [1.0, None])]
    same = [(i, [2.0, 0.0]) for i in range(10)] + [(10, [1.0, 0.0]), (10, [1.0, 0.0])]
    df = spark.createDataFrame(bad + same + [(11, [0.0, 1.0])], "embedding_id long, embedding array<float>").withColumn("id", F.lit(1)).withColumn("unit", F.lit("x"))
    got = {}
    for r in vectors.similar_vectors(df, dim=2).collect():
        got.setdefault(r["id"], []).append(r["neighbour"])
    assert {i: sorted(g) for i, g in got.items()} == {i: [j for j in range(7) if j != i][:5] for i in range(11)}
    assert vectors.similar_vectors(df.limit(0), dim=2).count() == 0
    assert vectors.similar_vectors(df.filter("embedding_id = 11"), dim=2).count() == 0


def test_tree_search_covers_the_ball():
    x = np.stack([v / np.linalg.norm(v) for v in clustered(300).values()]).astype(np.float32)
    tree = vectors.VPTree(x, leaf=8)
    seen = set()
    for q, rows in tree.search(x, 0.6, 1.0):
        seen |= set(itertools.product(q.tolist(), rows.tolist()))
    close = np.argwhere(np.linalg.norm(x[:, None] - x[None], axis=2) <= 0.6)
    assert {(a, b) for a, b in close.tolist()} <= seen


def shingles(text, k):
    w = text.lower().replace("\n", " ").split()
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}


def brute_pairs(rows, k, t, least):
    s = {i: shingles(x, k) for i, x in rows.items() if x and len(x.split()) >= least and len(x.split()) >= k}
    return {(a, b) for a, b in itertools.combinations(sorted(s), 2) if len(s[a] & s[b]) >= t * len(s[a] | s[b]) - 1e-12}


def edited_texts(n, seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(60)]
    out = {}
    for i in range(n):
        if out and rng.random() < 0.6:
            w = out[rng.choice(list(out))].split()
            for _ in range(rng.randrange(4)):
                w[rng.randrange(len(w))] = rng.choice(words)
            out[i] = " ".join(w)
        else:
            out[i] = " ".join(rng.choice(words) for _ in range(rng.randrange(6, 60)))
    return out


@pytest.mark.parametrize("k,t,block", [(3, 0.6, 2_000), (3, 0.6, 3), (2, 0.8, 2), (5, 0.8, 2_000)])
def test_near_duplicates_equal_brute_force(spark, k, t, block):
    rows = edited_texts(120, k * 7 + block)
    df = spark.createDataFrame(list(rows.items()), "page_id long, text string")
    pairs, copies = neardup.similar_pairs(df, k=k, t=t, min_words=6, block=block)
    sets = {}
    for r in copies.collect():
        sets.setdefault(r["set_id"], []).append(r["id"])
    got = {tuple(sorted((a, b))) for r in pairs.collect() for a in sets.get(r["set_a"], [r["set_a"]]) for b in sets.get(r["set_b"], [r["set_b"]])} | {c for ids in sets.values() for c in itertools.combinations(sorted(ids), 2)}
    assert got == brute_pairs(rows, k, t, 6)


@pytest.mark.parametrize("load,factor", [(0, 1_000), (100_000, 1_000)])
def test_hot_shingles_meet_in_blocks(spark, load, factor):
    """With large counts and tiny blocks every shingle takes the way of the hot ones, also over a mean load beyond 16 bits."""
    rows = {i: " ".join([*(f"a{j}" for j in range(20)), f"b{i}"]) for i in range(40)}
    df = spark.createDataFrame(list(rows.items()), "page_id long, text string")
    counted = neardup.shingle_sketch(df, "text", 3, 1, bits=16)
    sketch = neardup.tables.opened(counted.blocks.value, counted.size, np.uint32) * factor + load
    blocks = dict(neardup.tables.parts_of(sketch).itertuples(index=False))
    shared = neardup.tables.Shared(spark, [blocks.get(i) for i in range(neardup.tables.BLOCKS)], counted.size, np.uint32)
    assert (sketch > 5 + sketch.mean()).sum() >= 18
    groups = neardup.signatures(df, "page_id", "text", 3, 0.6, 1, 4, shared).withColumnRenamed("id", "gid").cache()
    found = sorted((r["ga"], r["gb"]) for r in neardup._group_pairs(groups, shared, 0.6, 5, 4).collect())
    assert found == list(itertools.combinations(range(40), 2))


def test_small_sets_need_fewer_common_shingles(spark):
    rows = {1: "a b c", 2: "A b c", 3: "a b c d", 4: "a b c a b c a b c", 5: "x y z w v", 6: "x y z w v u"}
    df = spark.createDataFrame(list(rows.items()), "page_id long, text string")
    for k, t in ((3, 0.5), (2, 0.6), (1, 0.9)):
        assert {tuple(r) for r in neardup.near_duplicate_pages(df, k=k, t=t).collect()} == brute_pairs(rows, k, t, 1)


def test_near_duplicates_edge_cases(spark):
    long = " ".join(f"word{i}" for i in range(30_000))
    rows = [(1, "a b c d e f"), (2, "A  b\nc d e f"), (2, "A  b\nc d e f"), (3, None), (4, ""), (5, "a b"), (None, "a b c d e f"), (6, long), (7, long + " end")]
    df = spark.createDataFrame(rows, "page_id long, text string").withColumn("set_id", F.lit(0)).withColumn("id", F.lit("clash"))
    got = {tuple(r) for r in neardup.near_duplicate_pages(df, k=3, t=0.6).collect()}
    assert got == {(1, 2), (6, 7)}
    assert neardup.near_duplicate_pages(df.limit(0), k=3, t=0.6).count() == 0


TEXT = """2.1 Mounting

The valve is closed at 5 V. See Fig. 4 for the hinge, approx. 3 mm, and turn
off the “pump”. Is it cold? Never lift it! pH values matter.

1. first item, 3 A
2. second item
   which goes on
• last one

a tail without an end"""


def test_boundaries():
    n, ends = splitting.boundaries(TEXT)
    words = TEXT.split()
    assert n == len(words)
    pieces = [" ".join(words[a:b]) for a, b in zip([0, *ends], ends)]
    assert pieces == ["2.1 Mounting", "The valve is closed at 5 V.", "See Fig. 4 for the hinge, approx. 3 mm, and turn off the “pump”.", "Is it cold?", "Never lift it!", "pH values matter.", "1. first item, 3 A", "2. second item which goes on", "• last one a tail without an end"] or pieces[-2:] == ["• last one", "a tail without an end"]


def test_ranges_give_what_the_whole_text_gives(spark):
    body = "\n\n".join(f"{i}.1 Heading\n\nThe part number {i} is set. It may not be seen, e.g. in\nwinter, by No. 7 of them! Is it {i} V? Yes." for i in range(1, 60))
    df = spark.createDataFrame([(1, body), (1, body), (2, "short text."), (3, None), (4, ""), (5, " ".join(["word"] * 400))], "page_id long, text string").withColumn("key", F.lit(1)).withColumn("range", F.lit(1))
    whole = {(1, e) for e in splitting.boundaries(body)[1]} | {(5, 400)}
    for size in (97, 500, 65_536):
        got = {tuple(r) for r in splitting.item_boundaries(df, range_chars=size, halo=300).collect()}
        assert got == whole
    assert splitting.item_boundaries(df.limit(0)).count() == 0


def test_pieces(spark):
    body = " ".join(f"w{i}." if i % 50 == 49 else f"W{i}" for i in range(900))
    df = spark.createDataFrame([(1, body), (2, " ".join(["x"] * 600))], "page_id long, text string")
    rows = splitting.split_items(df).orderBy("page_id", "ordinal").collect()
    one = [(r["word_start"], r["word_end"]) for r in rows if r["page_id"] == 1]
    assert one == [(0, 250), (210, 450), (410, 650), (610, 850), (810, 900)]
    assert [(r["word_start"], r["word_end"]) for r in rows if r["page_id"] == 2] == [(0, 260), (220, 480), (440, 600)]
    assert all(r["text"] == " ".join(body.split()[r["word_start"] : r["word_end"]]) for r in rows if r["page_id"] == 1)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 40), min_size=1, max_size=60), st.integers(5, 60), st.integers(0, 4), st.lists(st.integers(0, 90), max_size=30))
def test_cutter(gaps, most, overlap, widths):
    """Every piece by the rule, whatever ranges the item comes in."""
    ends = list(itertools.accumulate(gaps))
    total, at, ranges = ends[-1], 0, []
    for w in [*widths, total]:
        hi = min(total, at + w)
        ranges.append((hi - at, [e - at for e in ends if at < e <= hi]))
        at = hi
    cutter = splitting.Cutter(most, overlap)
    parts = [p for i, (n, found) in enumerate(ranges) for p in cutter.push(i, n, found)] + list(cutter.finish())
    pieces = sorted({p[1:4] for p in parts})
    starts = list(itertools.accumulate([n for n, _ in ranges], initial=0))
    for ordinal, lo, hi in pieces:
        inside = [e for e in ends if lo + overlap < e <= lo + most]
        assert hi == (inside[-1] if inside else min(total, lo + most))
        covered = [w for r, o, _, _, a, b in parts if o == ordinal for w in range(starts[r] + a, starts[r] + b)]
        assert covered == list(range(lo, hi))
    assert [lo for _, lo, _ in pieces] == [0, *(max(lo + 1, hi - overlap) for _, lo, hi in pieces[:-1])] and pieces[-1][2] == total
    assert len(cutter.ranges) <= len(ranges) and [o for o, _, _ in pieces] == list(range(len(pieces)))


HARD = {
    "trailing feeds": "One is here. Two is there." + "\n" * 600,
    "gap": "One is here.\n" + " " * 500 + "\n\nTwo is there\n" + "\n" * 400 + "three goes on.",
    "long item": "- an item " + "that goes on " * 60 + "\n  " + "and on " * 60 + "\n- another\nText. 1.1 No heading\n\n1.1 A Heading\nText again.",
    "one line": "word and word " * 80 + "ends here. Another. " * 20,
    "lower case": "\n".join(f"line {i} goes on and on" for i in range(60)) + ".\n- dash",
    "long word": "Start. " + "x" * 900 + " End. " + "y" * 300 + ".",
    "digits": "\n".join(f"{i}. item {i}\n   more of it" for i in range(60)),
    "marks": " ".join("Größe „ist“ fest. Да! ½ € 日本。" for _ in range(40)),
}


@pytest.mark.parametrize("name", HARD)
@pytest.mark.parametrize("width", [1, 17, 64, 256])
def test_settled_halos(name, width, tmp_path):
    text = HARD[name]
    want = splitting.boundaries(text)
    path = tmp_path / "item.txt"
    path.write_text(text, encoding="utf-8")
    with splitting.open_file(path.as_uri()) as file:
        for read, size in ((splitting._in_text(text), len(text)), (splitting._in_file(file), path.stat().st_size)):
            n, found = 0, []
            for lo in range(0, size, width):
                part, start, end, at_end = splitting.settled_range(read, size, lo, min(size, lo + width), 8)
                m, f = splitting.boundaries(part, start, end, at_end)
                found += [n + x for x in f]
                n += m
            assert (n, found) == want


def test_files_give_what_texts_give(spark, tmp_path):
    for name, text in HARD.items():
        (tmp_path / f"{name.replace(' ', '_')}.txt").write_text(text, encoding="utf-8")
    (tmp_path / "empty.txt").write_text("")
    df = spark.createDataFrame([(name, text) for name, text in HARD.items()] * 2, "name string, text string").withColumn("key", F.lit(1)).withColumn("words", F.lit("x"))
    by_text = {tuple(r) for r in splitting.split_items(df, "name", "text", 20, 5, 100, 8).collect()}
    by_file = {(r["path"].rsplit("/", 1)[1][:-4].replace("_", " "), *r[1:]) for r in splitting.split_files(spark, [str(tmp_path)], 20, 5, 130, 8).collect()}
    assert by_text == {r for r in by_file if len(HARD[r[0]].split()) > 20} and len(by_text) > 50
    for name, _, lo, hi, piece in by_file:
        assert piece == " ".join(HARD[name].split()[lo:hi])
    assert splitting.split_items(df.limit(0), "name").count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 100), min_size=1, max_size=60))
def test_packing_and_its_bound(sizes):
    s = np.array(sizes, np.int64)
    c = packing.best_fit_decreasing(s, 100)
    fill = np.bincount(c, weights=s)
    assert fill.max() <= 100 and packing.lower_bound(s, 100) <= len(fill)
    assert len(fill) <= 2 * packing.lower_bound(s, 100)


def test_bound_sees_large_items():
    assert packing.lower_bound(np.array([60, 60, 60]), 100) == 3
    assert packing.lower_bound(np.array([], np.int64), 100) == 0


def test_pack_sizes(spark):
    rng = random.Random(1)
    items = [(i, 0, rng.randrange(1, 90)) for i in range(900)]
    df = spark.createDataFrame(items, "doc_id long, piece int, size int")
    got = packing.pack_sizes(df, 100, per_partition=40, rounds=2).collect()
    assert sorted((r["doc_id"], r["piece"], r["size"]) for r in got) == items
    fill = {}
    for r in got:
        fill[r["container"]] = fill.get(r["container"], 0) + r["size"]
    assert max(fill.values()) <= 100
    single = packing.pack_sizes(df, 100, per_partition=40, rounds=0).select("container").distinct().count()
    assert packing.lower_bound(np.array([s for _, _, s in items]), 100) <= len(fill) <= single
    assert packing.pack_sizes(df.limit(0), 100).count() == 0
    row = packing.certificate(packing.pack_sizes(df, 100, per_partition=40, rounds=2), 100, "size").first()
    assert (row["containers"], row["bound"]) == (len(fill), packing.lower_bound(np.array([s for _, _, s in items]), 100))
    assert tuple(packing.certificate(packing.pack_sizes(df.limit(0), 100), 100, "size").first()) == (0, 0)


def test_exchanged_items_stay_in_small_partitions(spark, monkeypatch):
    """Two items of 70 never share a container: all are loose in every round, and no partition grows for it."""
    items = [(i, 0, 70) for i in range(400)]
    df = spark.createDataFrame(items, "doc_id long, piece int, size int")
    got = packing.pack_sizes(df, 100, per_partition=50, rounds=2)
    assert got.select("container").distinct().count() == 400
    parts = got.groupBy(F.split("container", "-")[1]).count().collect()
    assert max(r["count"] for r in parts) < 120


def test_pack_documents(spark):
    df = spark.createDataFrame([(1, "a b c"), (2, None), (3, ""), (4, " x" * 50), (1, "a b c"), (None, "a b"), (2**62 + 1, "a")], "doc_id long, text string").withColumn("piece", F.lit(9)).withColumn("container", F.lit("x"))
    rows = packing.pack_documents(df, capacity=16).collect()
    four = sorted((r["piece"], r["token_start"], r["n_tokens"]) for r in rows if r["doc_id"] == 4)
    assert four == [(0, 0, 16), (1, 16, 16), (2, 32, 16), (3, 48, 2)]
    assert {(r["doc_id"], r["container"] is None) for r in rows if r["n_tokens"] == 0} == {(2, True), (3, True)}
    assert len([r for r in rows if r["doc_id"] == 1]) == 2 and {None, 2**62 + 1} < {r["doc_id"] for r in rows}
