"""Removal of repeated word sequences, by level-wise doubling.

Level one are the word grams at the anchors (see ``repeats``): only those that occur
again anywhere survive. Windows of the surviving places are then counted at twice the
length, and only where both halves repeated; so on, until the window's length is
reached or no candidate is left.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bytetext import NOT_SPACE, chunks, prefix_sums, runs, window_hashes, word_hashes
from .common import Scratch, documents
from .repeats import covered, keyed, repeated_spans

WIDTH = 35
GRAM = 9


def word_symbols(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    hashes, _, _, first = word_hashes(data, ends, NOT_SPACE, lower=False)
    return hashes, first


def doubling(width: int, first: int = GRAM):
    def by_levels(values: np.ndarray, ends: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        n, length = len(values), min(first, width)
        sums = prefix_sums(values)
        room = np.repeat(ends[1:], np.diff(ends)) - np.arange(n)
        candidates = np.flatnonzero(room >= length)
        while True:
            hashes = window_hashes(sums, length)[candidates]
            _, inverse, count = np.unique(hashes, return_inverse=True, return_counts=True)
            repeated = np.zeros(n + 1, bool)
            repeated[candidates[count[inverse] > 1]] = True
            if length == width or not repeated.any():
                break
            step = min(length, width - length)  # both halves, which overlap at the last level
            candidates = np.flatnonzero(repeated[:n])
            candidates = candidates[room[candidates] >= length + step]
            candidates = candidates[repeated[candidates + step]]
            length += step
        windows = np.zeros(n, bool)
        for a, b in zip(low, high + 1):
            windows[a:b] = True
        return repeated[:n] & windows if length == width else np.zeros(n, bool)

    return by_levels


def repeated_words(docs: DataFrame, doc: str = "doc_id", text: str = "text", width: int = WIDTH, gram: int = GRAM) -> DataFrame:
    """One row per input row: doc_id, kept (the remaining words joined by one space), n_words, n_removed.

    Words are runs of anything but ASCII white space, unchanged. A word goes if a window
    of ``width`` words that covers it also starts at another place of any row, its own
    included; windows are judged on the input and never cross rows. Null and blank texts
    have no words; rows that repeat as a whole, also with one identifier, lose every
    word if they have ``width`` words. An empty table gives no rows, a text of any length is
    judged whole, rows without identifier are rows like others. Other columns are ignored.
    """
    spark = docs.sparkSession
    rows = keyed(docs, doc, text)
    spans = repeated_spans(rows, Scratch(spark, "substring-dedup"), word_symbols, doubling(width, gram), width, gram)
    joined = rows.join(spans, "row", "left").select("doc_id", "text", "spans")
    kind = joined.schema["doc_id"].dataType.simpleString()
    return joined.mapInArrow(_removed, f"doc_id {kind}, kept string, kept_sha256 string, n_words long, n_removed long")


def _removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, data, ends in chunks(batches):
        starts, stops, first = runs(data, ends, NOT_SPACE)
        kept, removed = [], []
        for r, spans in enumerate(batch.column("spans").to_pylist()):
            a, b = first[r], first[r + 1]
            gone = covered(b - a, spans or [])
            words = [data[x:y].tobytes() for x, y in zip(starts[a:b][~gone], stops[a:b][~gone])]
            kept.append(b" ".join(words))
            removed.append(int(gone.sum()))
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(kept, pa.binary()).cast(pa.string()),
             pa.array([hashlib.sha256(k).hexdigest() for k in kept]), pa.array(np.diff(first)), pa.array(removed, pa.int64())],
            ["doc_id", "kept", "kept_sha256", "n_words", "n_removed"],
        )


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_words(documents(spark, sf_dir)).select("doc_id", "n_words", "n_removed", "kept_sha256")


OP6_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
p AS (SELECT doc_id, i, md5(array_to_string(w[i : i + 34], ' ')) AS h
      FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS i FROM d WHERE len(w) >= 35)),
r AS (SELECT doc_id, i FROM p WHERE h IN (SELECT h FROM p GROUP BY h HAVING count(*) > 1)),
c AS (SELECT DISTINCT doc_id, x FROM (SELECT doc_id, unnest(range(i, i + 35)) AS x FROM r)),
k AS (SELECT doc_id, string_agg(word, ' ' ORDER BY x) AS kept, count(*) AS n_kept
      FROM (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS x FROM d) ANTI JOIN c USING (doc_id, x)
      GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, len(w) - coalesce(n_kept, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id)
"""
