"""Models behind small protocols: embedders, rerankers, extractors, and batches that adapt to memory."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagequarry.frames import objects


class Embedder(Protocol):
    name: str

    def encode(self, texts: list[str]) -> np.ndarray: ...


class Reranker(Protocol):
    def rerank(self, query: str, texts: list[str]) -> list[float]: ...


class ModelOutOfMemoryError(RuntimeError):
    """No batch fits, not even one text on the last device."""

    def __init__(self, operation: str, device: str, cause: str):
        super().__init__(f"{operation} ran out of memory on {device} with a batch of one: {cause}")
        self.operation, self.device = operation, device


def is_out_of_memory(error: BaseException) -> bool:
    return isinstance(error, MemoryError) or "OutOfMemory" in type(error).__name__ or bool(re.search(r"out of memory|alloc\w* fail|cannot allocate", str(error), re.I))


def adaptive_batches(items: list, run: Callable[[list, str], list], size: int, devices: tuple[str, ...] = ("cpu",), operation: str = "inference") -> tuple[list, list[int]]:
    """Runs ``items`` in batches, halved when memory runs out; at one it goes over to the next device. Also returns the sizes tried."""
    out, tried, at, device = [], [], 0, 0
    while at < len(items):
        n = min(size, len(items) - at)
        tried.append(n)
        try:
            out.extend(run(items[at : at + n], devices[device]))
        except Exception as error:
            if not is_out_of_memory(error):
                raise
            if n > 1:
                size = n // 2
            elif device + 1 < len(devices):
                device += 1
            else:
                raise ModelOutOfMemoryError(operation, devices[device], str(error)) from error
            continue
        at += n
    return out, tried


class HashEmbedder:
    """A deterministic embedder without a model: signed counts of hashed words, at length one."""

    def __init__(self, dim: int = 64, name: str = "hash"):
        self.dim, self.name = dim, name

    def encode(self, texts: list[str]) -> np.ndarray:
        import xxhash

        out = np.zeros((len(texts), self.dim), np.float32)
        for i, t in enumerate(texts):
            for w in t.lower().split():
                h = xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass"))
                out[i, h % self.dim] += 1 if h >> 63 else -1
        n = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(n > 0, n, 1)


_loaded: dict[str, object] = {}


class PerWorker:
    """A model that each Python worker loads when it is first asked; only ``make`` and the name travel to the tasks."""

    def __init__(self, name: str, make: Callable[[], object]):
        self.name, self.make = name, make

    def model(self):
        if self.name not in _loaded:
            _loaded[self.name] = self.make()
        return _loaded[self.name]

    def encode(self, texts: list[str]) -> np.ndarray:
        return self.model().encode(texts)

    def rerank(self, query: str, texts: list[str]) -> list[float]:
        return self.model().rerank(query, texts)


class OverlapReranker:
    """A deterministic reranker without a model: distinct query terms in the text, less one."""

    def rerank(self, query: str, texts: list[str]) -> list[float]:
        from pagequarry.functions.text import fold_query

        split = lambda s: set(re.findall(r"[^\W_]+", fold_query(s)))
        wanted = split(query)
        return [float(len(wanted & split(t or ""))) - 1.0 for t in texts]


class OfflineModels:
    """Stands for models that cannot be loaded."""

    name = "offline"

    def encode(self, texts: list[str]) -> np.ndarray:
        raise RuntimeError("models offline")

    def rerank(self, query: str, texts: list[str]) -> list[float]:
        raise RuntimeError("models offline")


def with_prefix(name: str, text: Column, query: bool = False) -> Column:
    """Models of the e5 family want to be told queries from passages."""
    return F.concat(F.lit("query: " if query else "passage: "), text) if "e5" in name.lower() else text


def embed(df: DataFrame, embedder: Embedder, key: str, text: str, batch: int = 32, devices: tuple[str, ...] = ("cpu",)) -> DataFrame:
    """(key, embedding, error) of each row; a failing batch gives its rows an error and leaves the job alone."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts = [x or "" for x in b["text"]]
            try:
                vectors, _ = adaptive_batches(texts, lambda part, device: list(embedder.encode(part)), batch, devices, "embedding")
                yield objects({"key": b["key"], "embedding": [v.tolist() for v in vectors], "error": [None] * len(b)})
            except RuntimeError as error:
                yield objects({"key": b["key"], "embedding": [None] * len(b), "error": [str(error)] * len(b)})

    rows = df.select(F.col(key).alias("key"), with_prefix(embedder.name, F.col(text)).alias("text"))
    return rows.mapInPandas(run, f"key {kind}, embedding array<float>, error string").withColumnRenamed("key", key)


def rerank_column(reranker: Reranker, query: str, text: Column, batch: int = 16) -> Column:
    """The reranker's logits for a column of few texts."""

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        out, _ = adaptive_batches(list(texts), lambda part, device: list(reranker.rerank(query, part)), batch, operation="reranking")
        return pd.Series(out, dtype="float64")

    return score(text)


def device_order(available: dict[str, float], need_gib: float) -> tuple[str, ...]:
    """Devices to try in order: a GPU only with enough free memory (available: free GiB by name), then mps, then the CPU."""
    out = [d for d in ("cuda", "mps") if d in available and (d != "cuda" or available[d] >= need_gib)]
    return (*out, "cpu")


def models_of_profile(profile: str) -> tuple[str, str, float] | None:
    """Embedder, reranker and GPU GiB of a profile; the exact profile embeds nothing."""
    if profile == "exact":
        return None
    return ("BAAI/bge-m3", "BAAI/bge-reranker-v2-m3", 3.0) if profile == "quality" else ("intfloat/multilingual-e5-small", "cross-encoder/mmarco-mMiniLMv2-L12-H384-v1", 1.5)
