"""Problem 7: token ids of a whole corpus by a public tokenizer.

Method: the tokenizers library over Arrow batches, one tokenizer per Python worker. Byte-level
vocabularies write bytes as printable characters; ``byte_table`` gives that mapping, and ``decode`` and ``offsets``
reverse it for whole tables, so characters whose bytes are split over several tokens come back whole.

Defined results: null and empty text give an empty list; special tokens' strings in a text are
ordinary text; repeated rows and null keys are passed on as they are; an empty table gives an empty
table. Extra columns are not read, so clashing names do no harm.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOCABULARY = os.environ.get("TOKENIZER_FILE", "/opt/tokenizers/byte_bpe_50k.json")
_loaded: dict = {}


def tokenizer(path: str):
    """The tokenizer of ``path``, loaded once per process; it runs on the task's own core."""
    if path not in _loaded:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        t.encode_special_tokens = True
        t.no_truncation()
        t.no_padding()
        _loaded[path] = t
    return _loaded[path]


def byte_table() -> dict[int, str]:
    """The printable character that stands for each byte in byte-level vocabularies.

    Printable bytes of ASCII and Latin-1 stand for themselves, the others for the code points from 256 on, in order.
    """
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(kept)]
    return {b: chr(b) for b in kept} | {b: chr(256 + i) for i, b in enumerate(rest)}


def token_bytes(path: str = VOCABULARY) -> list[bytes]:
    """The bytes of every id, made once per process."""
    key = f"{path} bytes"
    if key not in _loaded:
        t, back = tokenizer(path), {c: b for b, c in byte_table().items()}
        special = {i for i, x in t.get_added_tokens_decoder().items()}
        names = [t.id_to_token(i) or "" for i in range(t.get_vocab_size(with_added_tokens=True))]
        _loaded[key] = [x.encode() if i in special else bytes(back[c] for c in x) for i, x in enumerate(names)]
    return _loaded[key]


def decode_ids(ids: list[int], path: str = VOCABULARY, errors: str = "replace") -> str:
    """The text of ``ids``: tokens are mapped back to bytes and only their whole is decoded."""
    table = token_bytes(path)
    return b"".join([table[i] for i in ids]).decode("utf-8", errors)


def decode(df: DataFrame, key: str = "doc_id", ids: str = "ids", path: str = VOCABULARY) -> DataFrame:
    """(key, text) for each row of ids; null ids give the empty text, bytes that are no UTF-8 U+FFFD. A map over Arrow batches."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([decode_ids(x or [], path) for x in b.column(1).to_pylist()], pa.string())], ["key", "text"])

    return df.select(F.col(key).alias("key"), F.col(ids).alias("ids")).mapInArrow(run, f"key {kind}, text string").withColumnRenamed("key", key)


def offsets(df: DataFrame, key: str = "doc_id", ids: str = "ids", path: str = VOCABULARY) -> DataFrame:
    """(key, ends array<long>): the byte of the text's UTF-8 form at which each token ends; it begins where the one before ends. A map over Arrow batches."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = np.array([len(x) for x in token_bytes(path)], np.int64)
        for b in batches:
            ends = [np.cumsum(width[np.array(x or [], np.int64)]) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ends, pa.list_(pa.int64()))], ["key", "ends"])

    return df.select(F.col(key).alias("key"), F.col(ids).alias("ids")).mapInArrow(run, f"key {kind}, ends array<long>").withColumnRenamed("key", key)


def byte_offsets(text: str, ids: list[int], path: str = VOCABULARY) -> list[tuple[int, int]]:
    """Start and end byte of each token in the UTF-8 form of one ``text``; ids of another text are an error."""
    table, at, out = token_bytes(path), 0, []
    for i in ids:
        out.append((at, at + len(table[i])))
        at = out[-1][1]
    if at != len(text.encode("utf-8", "surrogatepass")):
        raise ValueError("these ids are not of this text")
    return out


def _batches(texts: list, t, most_chars: int = 4_000_000) -> Iterator[list]:
    """Encodings in slices of bounded text, so that a batch of giant texts needs no more memory than one slice."""
    start = total = 0
    for i, x in enumerate(texts):
        total += len(x or "")
        if total >= most_chars or i == len(texts) - 1:
            yield from t.encode_batch_fast([x or "" for x in texts[start : i + 1]], add_special_tokens=False)
            start, total = i + 1, 0


def encode(df: DataFrame, key: str = "doc_id", text: str = "text", path: str = VOCABULARY) -> DataFrame:
    """(key, ids array<int>) for each row of ``df``. A map over Arrow batches, without a shuffle."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizer(path)
        for b in batches:
            ids = pa.array([e.ids for e in _batches(b.column(1).to_pylist(), t)], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([b.column(0), ids], ["key", "ids"])

    rows = df.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, f"key {kind}, ids array<int>").withColumnRenamed("key", key)


def count_tokens(df: DataFrame, key: str = "doc_id", text: str = "text", path: str = VOCABULARY) -> DataFrame:
    """(key, n_tokens int): only lengths leave the Python worker."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizer(path)
        for b in batches:
            n = pa.array([len(e.ids) for e in _batches(b.column(1).to_pylist(), t)], pa.int32())
            yield pa.RecordBatch.from_arrays([b.column(0), n], ["key", "n_tokens"])

    rows = df.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, f"key {kind}, n_tokens int").withColumnRenamed("key", key)
