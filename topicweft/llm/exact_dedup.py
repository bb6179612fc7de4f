"""Exact duplicates by content sort.

Rows are range-partitioned by Spark's sampled splitters on a bounded head of the
normalised bytes, their hash and the identifier, and sorted (externally) by head,
hash, bytes and identifier, so equal texts are adjacent. One pass over each sorted
partition compares whole neighbouring texts. The identifier is part of the splitters,
so a group of copies of any size is dealt over as many partitions as it fills; only
the groups at a partition's two ends can go on elsewhere, and those few pieces are
put together by comparing their texts again.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, documents, lower_ascii, small_batches, whole_text

HEAD_BYTES = 32
FIELDS = "doc_id long, keep_id long, group_size long, text_sha256 string, piece long, edge string"


def _pieces(largest: bool):
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Runs of equal neighbours; a run's text is kept where its sort key is the
        first or the last of the partition, as it may go on in another one."""
        part = TaskContext.get().partitionId()
        ids: list[int] = []
        state = {"key": None, "text": None, "sha": "", "pieces": 0}
        first_key = None
        held: list[tuple] = []  # runs under the current key, which may turn out to be the last one
        choose = max if largest else min

        def rows(runs: list[tuple], edge: bool) -> pa.RecordBatch:
            columns: list[list] = [[] for _ in range(6)]
            for members, sha, text, piece in runs:
                n, keep = len(members), choose((m for m in members if m is not None), default=None)
                columns[0] += members
                columns[1] += [keep] * n
                columns[2] += [n] * n
                columns[3] += [sha] * n
                columns[4] += [piece] * n
                columns[5] += [text] + [None] * (n - 1) if edge else [None] * n
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string()]
            return pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds)],
                ["doc_id", "keep_id", "group_size", "text_sha256", "piece", "edge"],
            )

        def close() -> None:
            if ids:
                held.append((ids.copy(), state["sha"], state["text"], (part << 32) + state["pieces"]))
                state["pieces"] += 1
                ids.clear()

        out: list[tuple] = []
        for batch in batches:
            for head, code, text, doc in zip(*(batch.column(c).to_pylist() for c in range(4))):
                if text != state["text"]:
                    close()
                    if (head, code) != state["key"]:
                        if state["key"] == first_key:
                            if held:
                                yield rows(held, True)
                        else:
                            out += held
                        held.clear()
                        state["key"] = (head, code)
                        if first_key is None:
                            first_key = (head, code)
                    state["text"] = text
                    state["sha"] = hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()
                ids.append(doc)
            if out:
                yield rows(out, False)
                out = []
        close()
        if held:
            yield rows(held, True)

    return compare


def exact_duplicates(docs: DataFrame, doc: str = "doc_id", text: str = "text", keep: str = "smallest") -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z; null counts as the empty
    text. Of equal rows the one with the smallest (or ``keep="largest"``) identifier
    stays. Identifiers are integers; repeated identifiers are rows of their own, all
    of which are marked kept if theirs is the kept one; a null identifier is never kept. No rows give no rows; other
    columns of the input, whatever their names, are not looked at.
    """
    spark = docs.sparkSession
    small_batches(spark)
    scratch = Scratch(spark, "exact-dedup")
    rows = docs.select(
        F.col(doc).cast("long").alias("doc_id"), lower_ascii(whole_text(text)).alias("norm")
    ).select(
        F.substring(F.col("norm").cast("binary"), 1, HEAD_BYTES).alias("head"),
        F.xxhash64("norm").alias("code"), "norm", "doc_id",
    )
    dealt = rows.repartitionByRange("head", "code", "doc_id").sortWithinPartitions("head", "code", "norm", "doc_id")
    pieces = scratch.save(dealt.mapInArrow(_pieces(keep == "largest"), FIELDS), "pieces")
    choose = F.max if keep == "largest" else F.min
    ends = pieces.filter("edge is not null").select("piece", "keep_id", "group_size", "edge")
    groups = ends.groupBy("edge").agg(
        choose("keep_id").alias("best"), F.sum("group_size").alias("size"), F.collect_list("piece").alias("of")
    )
    # pieces of one text at partition ends: at most two per partition and text
    joined = groups.filter(F.size("of") > 1).select(F.explode("of").alias("piece"), "best", "size")
    return (
        pieces.drop("edge").join(joined, "piece", "left")
        .select(
            "doc_id",
            F.coalesce("best", "keep_id").alias("keep_id"),
            F.coalesce("size", "group_size").alias("group_size"),
            F.coalesce(F.col("doc_id") == F.coalesce("best", "keep_id"), F.lit(False)).alias("kept"),
            "text_sha256",
        )
    )


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(documents(spark, sf_dir), keep="largest")


OP7_SQL = """
WITH t AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm
  FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY norm) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY norm) AS kept, text_sha256
FROM t
"""
