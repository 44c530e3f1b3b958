"""Files as a source: discovery, fingerprints, extraction into pages."""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagequarry.frames import records
from pagequarry.functions.layout import layout_of, pack_layout, too_little_text
from pagequarry.functions.text import normalize

PAGE = "path string, page_number int, text string, normalized_text string, width double, height double, extraction_method string, layout_json binary, warning string, error string, sha256 string"


def existing_roots(roots: list[str]) -> list[str]:
    """The roots that are there; missing ones are passed over. Roots with a scheme are left to the file system they name."""
    return [r for r in dict.fromkeys(roots) if "://" in r or os.path.isdir(r)]


def discover(spark: SparkSession, roots: list[str], pattern: str = "*.pdf") -> DataFrame:
    """(path, size, mtime_ns) of the files under the roots, each once, in order. Contents are not read; mtime_ns has Spark's milliseconds as nanoseconds."""
    there = existing_roots(roots)
    if not there:
        return spark.createDataFrame([], "path string, size long, mtime_ns long")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(there)
    return files.select("path", F.col("length").alias("size"), (F.unix_millis("modificationTime") * 1_000_000).alias("mtime_ns")).dropDuplicates(["path"]).orderBy("path")


def with_sha256(spark: SparkSession, roots: list[str], pattern: str = "*.pdf") -> DataFrame:
    """(path, sha256) of the files' contents."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(existing_roots(roots))
    return files.select("path", F.sha2("content", 256).alias("sha256")).dropDuplicates(["path"])


def open_file(path: str):
    """A file of any file system that Arrow knows, for reading by offset; paths as Spark writes them."""
    system, name = fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path))
    return system.open_input_file(name)


def contents(paths: DataFrame) -> DataFrame:
    """(path, content) of the files in a column ``path``, read by the tasks; content is null where that fails."""

    def read(path: str) -> bytes | None:
        try:
            with open_file(path) as f:
                return f.read()
        except OSError:
            return None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for path in b["path"]:  # one file at a time
                yield records([(path, read(path))], ["path", "content"])

    return paths.select("path").mapInPandas(run, "path string, content binary")


class PlainTextExtractor:
    """Pages of a plain-text file, parted by form feeds, as of a fixed-width type; the stand-in for extractors of other formats."""

    width, height, margin, letter, line = 595.0, 842.0, 36.0, 5.0, 12.0

    def pages(self, content: bytes) -> list[dict]:
        if content.startswith(b"%PDF") and b"/Encrypt" in content:
            raise ValueError("PDF is password protected")
        return [{"text": t, "width": self.width, "height": self.height, "words": self._words(t)} for t in content.decode("utf-8").split("\f")]

    def _words(self, text: str) -> list[dict]:
        out = []
        for n, x in enumerate(text.split("\n")):
            y = self.margin + n * self.line
            for o, m in enumerate(re.finditer(r"[^ ]+", x)):
                out.append({"t": m.group(), "x0": self.margin + m.start() * self.letter, "y0": y, "x1": self.margin + m.end() * self.letter, "y1": y + self.line, "l": n, "o": o})
        return out


def extract(files: DataFrame, extractor, ocr: Callable[[bytes, int], str] | None = None) -> DataFrame:
    """One row a page of (path, content) rows. A file that fails gives one row with its error; a page with too little text goes to ``ocr``.

    If that fails the page keeps its own text with a warning; no failure of a file or a page ends the job. A page's layout is that of its own words; text
    that was read from the picture has none.
    """
    names = [c.strip().split(" ")[0] for c in PAGE.split(",")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for path, content in zip(b["path"], b["content"]):
                try:
                    digest = hashlib.sha256(content).hexdigest()
                    pages = extractor.pages(bytes(content))
                except Exception as error:
                    rows.append((path, *[None] * (len(names) - 3), str(error) if content is not None else "the file could not be read", None))
                    continue
                for number, p in enumerate(pages, 1):
                    text, method, warning, words = p["text"], "native", None, p.get("words")
                    if too_little_text(len(normalize(text)), len(text.split()), p.get("coverage", 0.0)):
                        try:
                            if ocr is None:
                                raise RuntimeError("no engine")
                            text, method, words = ocr(bytes(content), number), "ocr", None
                        except Exception as error:
                            warning = f"OCR unavailable: {error}"
                    boxes = None if words is None else pack_layout(layout_of(words, p["width"], p["height"]))
                    rows.append((path, number, text, normalize(text), p["width"], p["height"], method, boxes, warning, None, digest))
            yield records(rows, names)

    return files.select("path", "content").mapInPandas(run, PAGE)
