"""The stored index of pages: postings of terms and of trigrams, written once and kept up for changed pages.

An index is a folder of segments. A segment has ``terms`` (bucket, term, page_id, document_id, tf, dl) and ``grams`` (bucket, gram, ids),
stored by ``bucket`` (a partition column) and sorted by term or gram, so that a query reads the buckets
of its own terms and within them the row groups that can hold these, and ``pages`` (page_id, dl). A changed page is written to a new segment and hides its postings in the older ones; a
removed page is listed there without any. ``compact`` writes one segment again. The newest manifest names the segments and the sums of the statistics.

Repeated deliveries of a page give the same postings again; readers take each page's counts once. Null texts have no terms, their pages count.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagequarry.frames import objects
from pagequarry.functions.text import terms
from pagequarry.session import broadcast_if_small, checkpoint_folder
from pagequarry.sources.snapshots import newest, publish

TERM_ROWS = "term string, page_id long, document_id long, tf int, dl int"
GRAM_ROWS = "gram string, ids array<long>"
STORED = {"terms": f"{TERM_ROWS}, bucket int", "grams": f"{GRAM_ROWS}, bucket int", "pages": "page_id long, dl int"}
GRAM = 3


@dataclass
class Manifest:
    version: int = 0
    buckets: int = 8
    segments: list[str] = field(default_factory=list)
    n: int = 0
    total: int = 0


def bucket_of(value: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(value), F.lit(buckets)).cast("int")


def term_rows(pages: DataFrame) -> DataFrame:
    """(term, page_id, document_id, tf, dl) of each delivered page; counted inside the task, without a shuffle."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            length = b["terms"].str.len().to_numpy(np.int64)
            if not length.sum():
                continue
            code, names = pd.factorize(np.concatenate(b["terms"].to_numpy()))
            pairs, tf = np.unique(np.repeat(np.arange(len(b)), length) * len(names) + code, return_counts=True)
            row, code = np.divmod(pairs, len(names))
            got = b.take(row)
            yield pd.DataFrame({"term": names[code], "page_id": got["page_id"].to_numpy(), "document_id": got["document_id"].to_numpy(), "tf": tf.astype(np.int32), "dl": length[row].astype(np.int32)})

    none = F.lit(-(2**63))  # pandas would make a column with nulls one of floats
    rows = pages.filter("page_id is not null").select("page_id", F.coalesce("document_id", none).alias("document_id"), terms(F.col("text")).alias("terms"))
    return rows.mapInPandas(run, TERM_ROWS).withColumn("document_id", F.nullif("document_id", none))


def gram_rows(pages: DataFrame) -> DataFrame:
    """(gram, ids): trigrams of the normalised texts with the pages of one batch that have them."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found: dict[str, list[int]] = {}
            for p, x in zip(b["page_id"], b["normalized_text"]):
                for g in {x[i : i + GRAM] for i in range(len(x) - GRAM + 1)}:
                    found.setdefault(g, []).append(p)
            yield objects({"gram": found.keys(), "ids": found.values()})

    return pages.filter("normalized_text is not null and page_id is not null").select("page_id", "normalized_text").mapInPandas(run, GRAM_ROWS)


class PageIndex:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self.manifest = self._newest()

    def _newest(self) -> Manifest:
        return Manifest(**(newest(self.spark, f"{self.folder}/manifest") or {}))

    def _publish(self, m: Manifest) -> None:
        """Readers that come after this see the new segments; those before it the old ones whole."""
        m.version += 1
        publish(self.spark, f"{self.folder}/manifest", m.version, asdict(m))
        self.manifest = m

    def _write(self, rows: DataFrame, path: str, by: str, buckets: int) -> None:
        """Stores rows by bucket. Adaptive execution divides the bucket of a hot term over several tasks and files."""
        df = rows.withColumn("bucket", bucket_of(F.col(by), buckets)).hint("rebalance", F.col("bucket")).sortWithinPartitions("bucket", by)
        df.write.partitionBy("bucket").parquet(path)

    def _segment(self, pages: DataFrame, buckets: int, removed: DataFrame | None) -> str:
        name = f"s{self.manifest.version + 1:06d}"
        at = f"{self.folder}/{name}"
        self._write(term_rows(pages), f"{at}/terms", "term", buckets)
        self._write(gram_rows(pages), f"{at}/grams", "gram", buckets)
        own = pages.filter("page_id is not null").select("page_id", F.size(terms(F.col("text"))).alias("dl")).groupBy("page_id").agg(F.max("dl").alias("dl"))
        gone = self.spark.createDataFrame([], "page_id long, dl int") if removed is None else removed.select("page_id", F.lit(None).cast("int").alias("dl")).distinct()
        own.unionByName(gone).write.parquet(f"{at}/pages")
        return name

    @classmethod
    def build(cls, spark: SparkSession, pages: DataFrame, folder: str, pages_per_bucket: int = 20_000) -> PageIndex:
        """A new index of all ``pages`` (page_id, document_id, text, normalized_text)."""
        index = cls(spark, folder)
        buckets = max(8, -(-pages.count() // pages_per_bucket))
        name = index._segment(pages, buckets, None)
        n, total = index._sums([name])
        index._publish(Manifest(index.manifest.version, buckets, [name], n, total))
        return index

    def update(self, changed: DataFrame, removed: DataFrame | None = None) -> None:
        """Takes the new state of changed or new pages, and the page_id of removed ones, as one more segment."""
        m = self.manifest
        name = self._segment(changed, m.buckets, removed)
        n, total = self._sums([*m.segments, name])
        self._publish(Manifest(m.version, m.buckets, [*m.segments, name], n, total))

    def compact(self) -> None:
        """The live postings of all segments as one."""
        m = self.manifest
        name = f"s{m.version + 1:06d}"
        for part, by in (("terms", "term"), ("grams", "gram")):
            rows = self._live(part)
            self._write(rows.drop("bucket"), f"{self.folder}/{name}/{part}", by, m.buckets)
        self._live("pages").filter("dl is not null").write.parquet(f"{self.folder}/{name}/pages")
        self._publish(Manifest(m.version, m.buckets, [name], m.n, m.total))

    def _pages(self, segment: str) -> DataFrame:
        return self.spark.read.schema(STORED["pages"]).parquet(f"{self.folder}/{segment}/pages")

    def _live(self, part: str, segments: list[str] | None = None, where: Column | None = None) -> DataFrame:
        """The rows of all segments that no later segment hides. ``where`` is asked of each segment's files first."""
        names = self.manifest.segments if segments is None else segments
        out = None
        for i, s in enumerate(names):
            rows = self.spark.read.schema(STORED[part]).parquet(f"{self.folder}/{s}/{part}")
            if where is not None:
                rows = rows.filter(where)
            for later in names[i + 1 :]:
                hidden = broadcast_if_small(self._pages(later).select("page_id"))
                if part == "grams":
                    one = rows.select("bucket", "gram", F.explode("ids").alias("page_id")).join(hidden, "page_id", "left_anti")
                    rows = one.groupBy("bucket", "gram").agg(F.collect_list("page_id").alias("ids"))
                else:
                    rows = rows.join(hidden, "page_id", "left_anti")
            out = rows if out is None else out.unionByName(rows)
        return out

    def _sums(self, segments: list[str]) -> tuple[int, int]:
        r = self._live("pages", segments).filter("dl is not null").agg(F.count("*").alias("n"), F.coalesce(F.sum("dl"), F.lit(0)).alias("total")).first()
        return r["n"], r["total"]

    # ---- reading

    def postings(self, wanted: list[str]) -> DataFrame:
        """(term, page_id, document_id, tf, dl) of some terms, each page once a term. Only their buckets are read."""
        rows = self._live("terms", where=self._among(wanted, "term"))
        return rows.groupBy("term", "page_id").agg(F.max("document_id").alias("document_id"), F.max("tf").alias("tf"), F.max("dl").alias("dl"))

    def _among(self, wanted: list[str], column: str) -> Column:
        hashed = self.spark.createDataFrame([(w,) for w in wanted], "w string").select(bucket_of(F.col("w"), self.manifest.buckets).alias("b")).distinct().collect() if wanted else []
        return F.col("bucket").isin(sorted(r["b"] for r in hashed)) & F.col(column).isin(wanted)

    def stats(self) -> DataFrame:
        """(n, total): pages and their terms, from the manifest."""
        return self.spark.range(1).select(F.lit(self.manifest.n).cast("long").alias("n"), F.lit(self.manifest.total).cast("long").alias("total"))

    def term_stats(self) -> DataFrame:
        """(term, df, cf) of all terms."""
        one = self._live("terms").groupBy("bucket", "term", "page_id").agg(F.max("tf").alias("tf"))
        return one.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))

    def pages_with(self, needles: dict[str, list], most_grams: int = 8) -> DataFrame:
        """(needle, page_id): the pages that have all trigrams of a needle, so that it can occur there. At most ``most_grams`` spread over a needle are asked; the search after it is exact."""
        asked = []
        for needle in needles:
            grams = list(dict.fromkeys(needle[i : i + GRAM] for i in range(len(needle) - GRAM + 1)))
            step = max(1, -(-len(grams) // most_grams))
            asked += [(needle, g, len(grams[::step])) for g in grams[::step]]
        q = self.spark.createDataFrame(asked, "needle string, gram string, need int")
        rows = self._live("grams", where=self._among(sorted({g for _, g, _ in asked}), "gram"))
        one = rows.select("gram", F.explode("ids").alias("page_id")).distinct().join(F.broadcast(q), "gram")  # a bounded list of needles
        return one.groupBy("needle", "page_id").agg(F.count("*").alias("have"), F.max("need").alias("need")).filter("have = need").select("needle", "page_id")


_built: dict[tuple, PageIndex] = {}


def index_of(spark: SparkSession, pages: DataFrame, name: str) -> PageIndex:
    """The index of a stored pages table, built at its first use by this application in the shared checkpoint folder; new or changed files give a new one."""
    files = spark.read.format("binaryFile").load(pages.inputFiles()).select(F.xxhash64("path", "length", "modificationTime").alias("h"))
    key = (spark.sparkContext.applicationId, name, files.agg(F.sum(F.col("h").cast("decimal(38,0)"))).first()[0])
    if key not in _built or not _there(spark, _built[key].folder):
        _built[key] = PageIndex.build(spark, pages.select("page_id", "document_id", "text", "normalized_text"), f"{checkpoint_folder(spark)}/page-index-{uuid.uuid4().hex}")
    return _built[key]


def _there(spark: SparkSession, folder: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/manifest")
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)
