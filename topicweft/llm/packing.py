"""Best-fit packing of documents into sequences, in rounds over classes of equal length.

Lengths are whole numbers up to the sequence size, so all documents of a length, and all
sequences with an equal gap, are interchangeable and are ranges of ranks: the range-sorted
documents and gaps are two short sorted tables (at most one row per length or gap) beside
the ranks of the rows. A round takes the longest documents left, sweeps to the
successor gap (the smallest that is large enough), lets the documents of lowest rank have
those sequences, moves the sequences to their new gap, and repeats; what fits nowhere
opens sequences. Only the two tables of classes take part in rounds, which are a loop on the driver (at most ``size`` classes each,
whatever the input), in place of distributed sweeps over rows. Ranks come from the
tasks' own numbering plus the totals of the tasks before, so a length that a third of all
documents share is no task's burden.
"""

from __future__ import annotations

import json
import re
import zlib
from bisect import bisect_left, insort
from collections import Counter, defaultdict
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import Scratch, documents, small_batches, whole_text

SEQUENCE = 1024
END_ID = 2
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Common letters and marks, about whose classes all libraries agree; other texts take the slow way
COMMON = re.compile("[\x00-\x1b\x20-\x84\x86-\x9f\xa1-\u024f\u0391-\u03c9\u0400-\u045f\u2013-\u2026\u20ac\u4e00-\u9fa5]*")


def byte_characters() -> dict[str, int]:
    """The printable character that byte-level vocabularies use for each byte."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(other)}


def merge_ranks(path: str) -> dict[bytes, int] | None:
    """Ids as merge ranks, if the file is a byte-level BPE with the usual pattern whose ids
    follow its merges. Then the pair with the lowest id of what it makes is the pair
    with the first merge: a token's bytes come to the same last pair in any context."""
    model = json.loads(Path(path).read_text("utf-8"))
    bpe, split = model["model"], model["pre_tokenizer"] or {}
    plain = (
        bpe["type"] == "BPE" and not model["normalizer"] and split.get("type") == "ByteLevel" and split.get("use_regex")
        and not split.get("add_prefix_space") and not bpe.get("dropout") and not bpe.get("ignore_merges")
    )
    if not plain:
        return None
    vocabulary, merges = bpe["vocab"], ["".join(m.split(" ") if isinstance(m, str) else m) for m in bpe["merges"]]
    order = [vocabulary[m] for m in merges]
    special = {t["content"] for t in model["added_tokens"]}
    table, named = byte_characters(), set(merges)
    singles = [t for t in vocabulary if t not in named and t not in special]
    if order != sorted(set(order)) or any(len(t) > 1 or vocabulary[t] >= order[0] for t in singles) or len(singles) != 256:
        return None
    return {bytes(table[c] for c in t): i for t, i in vocabulary.items() if t not in special}


class Ids:
    """Token ids (little-endian unsigned 32-bit) of whole texts, for one worker."""

    def __init__(self, path: str):
        self.library = Tokenizer.from_file(path)
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        ranks = merge_ranks(path)
        self.fast = ranks and tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> bytes:
        """By merge ranks where that is known to give the library's ids, else by the library."""
        if self.fast and COMMON.fullmatch(text) and not any(s in text for s in self.special):
            return self.fast.encode_to_numpy(text, disallowed_special=()).astype("<u4").tobytes()
        return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


_WORKER: dict[str, Ids] = {}


def _ids(path: str) -> Ids:
    if path not in _WORKER:
        _WORKER[path] = Ids(path)
    return _WORKER[path]


PIECE_FIELDS = "piece int, start long, length long, ids_crc32 long, task long, rank long"


def pieces_of(docs: DataFrame, doc: str, text: str, vocabulary: str, size: int) -> DataFrame:
    """One row per piece, with its rank among the pieces of its length in its task."""
    end = np.array([END_ID], "<u4").tobytes()
    names = ["doc_id", *(f.split()[0] for f in PIECE_FIELDS.split(", "))]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, task, ranks = _ids(vocabulary), TaskContext.get().partitionId(), Counter()
        for batch in batches:
            texts = batch.column(1).to_pylist()
            owner: list[int] = []
            columns: list[list[int]] = [[] for _ in range(6)]
            for row, text in enumerate(texts):
                found = ids.encode(text) + end
                n = len(found) // 4
                head = n % size or size
                bounds = [0, *range(head, n + 1, size)]
                for piece, (a, b) in enumerate(zip(bounds, bounds[1:])):
                    owner.append(row)
                    for column, value in zip(columns, (piece, a, b - a, zlib.crc32(found[4 * a : 4 * b]), task, ranks[b - a])):
                        column.append(value)
                    ranks[b - a] += 1
            kinds = [pa.int32(), *[pa.int64()] * 5]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(owner, pa.int64())), *(pa.array(c, k) for c, k in zip(columns, kinds))], names
            )

    rows = docs.select(F.col(doc).alias("doc_id"), whole_text(text).alias("text"))
    return rows.mapInArrow(cut, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, {PIECE_FIELDS}")


def match(counts: dict[int, int], size: int) -> list[tuple[int, int, int, int, int, int]]:
    """Rounds of best fit over the classes. Each row of the result places the ranks
    ``rank .. rank + n - 1`` of one length: (length, rank, n, first sequence, offset,
    pieces per sequence); ranks follow each other through the sequences."""
    gaps: dict[int, list[tuple[int, int]]] = defaultdict(list)  # gap: ranges of sequences
    sizes: list[int] = []
    opened, placed = 0, []

    def put(gap: int, first: int, n: int) -> None:
        if gap and n:
            if not gaps[gap]:
                insort(sizes, gap)
            gaps[gap].append((first, n))

    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            at = bisect_left(sizes, length)
            if at == len(sizes):
                break
            gap = sizes[at]
            first, n = gaps[gap].pop()
            if not gaps[gap]:
                sizes.pop(at)
            each = gap // length  # the same gap would be the best one again
            whole = min(n, left // each)
            if whole:
                placed.append((length, rank, whole * each, first, size - gap, each))
                put(gap - each * length, first, whole)
                rank, left = rank + whole * each, left - whole * each
                first, n = first + whole, n - whole
            if n and left:
                last = min(left, each)
                placed.append((length, rank, last, first, size - gap, last))
                put(gap - last * length, first, 1)
                rank, left = rank + last, left - last
                first, n = first + 1, n - 1
            put(gap, first, n)
        if left:
            each = size // length
            whole, rest = divmod(left, each)
            if whole:
                placed.append((length, rank, whole * each, opened, 0, each))
                put(size - each * length, opened, whole)
            if rest:
                placed.append((length, rank + whole * each, rest, opened + whole, 0, rest))
                put(size - rest * length, opened + whole, 1)
            opened += whole + bool(rest)
    return placed


def pack(
    docs: DataFrame, doc: str = "doc_id", text: str = "text", vocabulary: str | None = None, size: int = SEQUENCE
) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A document is its whole text's ids and the end id; a null or empty text is the end
    id alone. Documents longer than ``size`` are cut into pieces of that length, the
    first one shorter if need be. Every input row is placed, rows with null or repeated
    identifiers too (each as a document of its own); an empty table gives no pieces, a text of any
    length is cut whole. Other columns are ignored.
    """
    spark = docs.sparkSession
    small_batches(spark)
    scratch = Scratch(spark, "pack")
    pieces = scratch.save(pieces_of(docs, doc, text, vocabulary or public_tokenizers.path("byte_bpe_50k.json"), size), "pieces")
    by_task = pieces.groupBy("length", "task").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    offsets = by_task.select("length", "task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("earlier"))
    counts = {r["length"]: r["n"] for r in by_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `size` rows
    placed = sorted(match(counts, size))
    table = spark.sparkContext.broadcast(np.array(placed, np.int64).reshape(-1, 6))

    @F.arrow_udf("struct<sequence_id: long, offset: long>")
    def place(length: pa.Array, rank: pa.Array) -> pa.Array:
        rows, n, k = table.value, length.to_numpy(), rank.to_numpy()
        step = 1 << 44  # ranks of one length are fewer
        row = rows[np.searchsorted(rows[:, 0] * step + rows[:, 1], n * step + k, "right") - 1]
        within = k - row[:, 1]
        return pa.StructArray.from_arrays(
            [pa.array(row[:, 3] + within // row[:, 5]), pa.array(row[:, 4] + within % row[:, 5] * n)], ["sequence_id", "offset"]
        )

    return (
        pieces.join(offsets, ["length", "task"])
        .withColumn("_p", place("length", (F.col("rank") + F.col("earlier")).cast("long")))
        .select("doc_id", "piece", "start", "length", "ids_crc32", "_p.sequence_id", "_p.offset")
    )


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir))
