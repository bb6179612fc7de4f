"""Removal of repeated byte strings, by bucket-pointer refinement of suffixes.

The suffixes that can matter (see ``repeats``) are put into buckets by their first q-gram.
A bucket's suffixes are then sorted by the identifiers of the buckets that they point to
one depth later; the new, finer identifiers are used in the next sorting, so each
round doubles the depth that equal identifiers stand for. Suffixes alone in
their bucket are done. At the depth of the window, suffixes that still share a bucket
begin with equal windows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bytetext import chunks, prefix_sums, window_hashes
from .common import Scratch, documents
from .repeats import covered, keyed, repeated_spans

WIDTH = 400
GRAM = 128
FIRST = 50


def byte_symbols(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return data, ends


def buckets(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Identifier of each key's bucket in sorted order, and whether others are in it."""
    _, identifier, size = np.unique(keys, return_inverse=True, return_counts=True)
    return identifier, size[identifier] > 1


def refine(width: int, first: int = FIRST):
    def by_pointers(values: np.ndarray, ends: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        n, depth = len(values), min(first, width)
        start = np.zeros(n, bool)  # where a window starts
        for a, b in zip(low, high + 1):
            start[a:b] = True
        room = np.repeat(ends[1:], np.diff(ends)) - np.arange(n)  # symbols up to the slice's end
        at = np.flatnonzero(room >= depth)
        pointer = np.full(n, -1, np.int64)
        identifier, shared = buckets(window_hashes(prefix_sums(values), depth)[at])
        at = at[shared]
        pointer[at] = identifier[shared]
        while depth < width:
            step = min(depth, width - depth)
            at = at[room[at] >= depth + step]
            at = at[pointer[at + step] >= 0]
            identifier, shared = buckets(pointer[at] * n + pointer[at + step])
            pointer = np.full(n, -1, np.int64)
            at = at[shared]
            pointer[at] = identifier[shared]
            depth += step
        return start & (pointer >= 0)

    return by_pointers


def repeated_bytes(docs: DataFrame, doc: str = "doc_id", text: str = "text", width: int = WIDTH, gram: int = GRAM) -> DataFrame:
    """One row per input row: doc_id, text, kept (the remaining bytes), n_bytes, n_removed, n_spans.

    A byte goes if a string of ``width`` bytes that covers it also starts at another
    place of any row, its own included; strings are judged on the input and never cross
    rows. Null and short texts lose nothing for themselves. Rows that repeat as a whole,
    also with one identifier, lose every byte if they have ``width`` bytes. ``kept`` is
    binary, as what remains may part a character. An empty table gives no rows, a text of any
    length is judged whole, rows without identifier are rows like others. Other columns are ignored.
    """
    spark = docs.sparkSession
    rows = keyed(docs, doc, text)
    spans = repeated_spans(rows, Scratch(spark, "suffix-dedup"), byte_symbols, refine(width), width, gram)
    joined = rows.join(spans, "row", "left").select("doc_id", "text", "spans")
    kind = joined.schema["doc_id"].dataType.simpleString()
    return joined.mapInArrow(_removed, f"doc_id {kind}, text string, kept binary, n_bytes long, n_removed long, n_spans long")


def _removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, data, ends in chunks(batches):
        kept, removed, runs = [], [], []
        for r, spans in enumerate(batch.column("spans").to_pylist()):
            part = data[ends[r] : ends[r + 1]]
            gone = covered(len(part), spans or [])
            kept.append(part[~gone].tobytes())
            removed.append(int(gone.sum()))
            runs.append(int(np.count_nonzero(np.diff(gone.astype(np.int8), prepend=0) == 1)))
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("text"), pa.array(kept, pa.binary()), pa.array(np.diff(ends)),
             pa.array(removed, pa.int64()), pa.array(runs, pa.int64())],
            ["doc_id", "text", "kept", "n_bytes", "n_removed", "n_spans"],
        )


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_bytes(documents(spark, sf_dir)).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256")
    )
