"""Windows of symbols (bytes or words) that start more than once in a corpus.

Every window of ``width`` symbols has an anchor: the leftmost smallest hash among its
grams of ``gram`` symbols. Equal windows have equal anchor grams at equal places, so the
windows of one anchor, which follow each other, only need to be compared with those
of anchors with the same gram. There is about one anchor to every (width - gram) / 2
symbols, and a row leaves Python per anchor, not per symbol.

An anchor's *slice* is the text that its windows cover. Slices that occur twice are
repeated throughout and need no closer look. Slices that occur once, but whose gram
another slice has too, are fetched and given to the operator's own ``refine``
function, which tells the repeated windows. Slices of a gram with very many different ones are
not brought together: they are dealt in blocks, each block sends its distinct windows'
hashes, packed by ranges of hashes, and is told which of them another one has too.

Equality is that of a 64-bit slice hash within a 64-bit gram hash (128 bits for windows of blocks).
Rows are known by a hash of identifier and text, so rows may repeat.
"""

from __future__ import annotations

import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytetext import U, buffer_of, chunks, mixed_bytes, prefix_sums, span_hashes, window_hashes
from .common import Scratch, small_batches, whole_text

SLICES_TOGETHER = 2_000  # slices of one gram that may meet in a task
SLICES_PER_GROUP = 3_000  # slices of several grams compared in one call
LOW = U(0xFFFFFFFF)

#: symbols(data, ends) -> the symbols (bytes, or 64-bit hashes of words) and the rows' ends in symbols
Symbols = Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]
#: refine(symbols, slice ends, first windows, last windows) -> flag per symbol: a repeated window starts here
Refine = Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], np.ndarray]


def free_shuffles(spark) -> None:
    """Lets Spark delete shuffle files of frames that are no longer referred to."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def sliding_min(keys: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of ``width`` keys: block-wise running minima from both sides."""
    n = len(keys) - width + 1
    if n <= 0:
        return keys[:0]
    padded = np.full(-(-len(keys) // width) * width, np.iinfo(np.uint64).max, U)
    padded[: len(keys)] = keys
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.ascontiguousarray(np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1]).ravel()
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def numbers(symbols: np.ndarray) -> np.ndarray:
    """64-bit numbers of the symbols."""
    return mixed_bytes()[symbols] if symbols.dtype == np.uint8 else symbols


def anchors_of(values: np.ndarray, ends: np.ndarray, width: int, gram: int):
    """Per anchor: gram hash, slice hash, row, first window, last window, anchor's place in the text."""
    sums = prefix_sums(values)
    grams = window_hashes(sums, gram)
    keys = (grams & ~LOW) | np.arange(len(grams), dtype=U)
    at = (sliding_min(keys, width - gram + 1) & LOW).astype(np.int64)
    count = np.maximum(np.diff(ends) - width + 1, 0)
    row = np.repeat(np.arange(len(count)), count)
    window = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + ends[:-1][row]
    at = at[window]
    if not len(at):
        none = np.zeros(0, np.int64)
        return none, none, none, none, none, none
    begin = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (row[1:] != row[:-1])]))
    last = np.concatenate([begin[1:], [len(at)]]) - 1
    low, high, at, row = window[begin], window[last], at[begin], row[begin]
    inside = (at - low).astype(U) * U(0xD6E8FEB86659FD93)
    slices = span_hashes(sums, low, high + width) + inside
    return grams[at].view(np.int64), slices.view(np.int64), row, low - ends[row], high - ends[row], at - ends[row]


def packed(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """First window and number of further windows as one number."""
    return (low << 20) | (high - low)


def repeated_spans(
    docs: DataFrame, scratch: Scratch, symbols: Symbols, refine: Refine, width: int, gram: int,
    together: int = SLICES_TOGETHER, per_group: int = SLICES_PER_GROUP,
) -> DataFrame:
    """``docs`` has ``row`` (long) and ``text``. Returns row, spans: per row with repeated
    windows, (first symbol, symbol after the last) of stretches that they cover."""
    spark = docs.sparkSession
    small_batches(spark)

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, ends in chunks(batches):
            values, stops = symbols(data, ends)
            grams, slices, row, low, high, _ = anchors_of(numbers(values), stops, width, gram)
            if len(grams):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(grams), pa.array(slices), batch.column("row").take(pa.array(row)), pa.array(packed(low, high))],
                    ["gram", "slice", "row", "place"],
                )

    anchors = scratch.save(docs.select("row", "text").mapInArrow(extract, "gram long, slice long, row long, place long"), "anchors")
    slices = scratch.save(
        anchors.groupBy("gram", "slice").agg(
            F.count(F.lit(1)).alias("n"), F.min_by("place", "row").alias("place"), F.min("row").alias("row")
        ),
        "slices",
    )
    free_shuffles(spark)
    open_grams = (
        slices.groupBy("gram").agg(F.count(F.lit(1)).alias("m"), F.min("n").alias("least"))
        .filter("m > 1 and least = 1").select("gram", "m")
    )
    members = scratch.save(slices.join(open_grams, "gram").select("gram", "m", "n", "row", "place"), "members")
    few, many = members.agg(
        F.count(F.when(F.col("m") <= together, 1)), F.count(F.when(F.col("m") > together, 1))
    ).first()
    wanted = members.groupBy("row").agg(F.collect_list(F.struct("gram", "m", "n", "place")).alias("wanted"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, ends in chunks(batches):
            values, stops = symbols(data, ends)
            out: list[list] = [[] for _ in range(6)]
            for r, (row, members) in enumerate(zip(batch.column("row").to_pylist(), batch.column("wanted").to_pylist())):
                for x in members:
                    low, more = x["place"] >> 20, x["place"] & 0xFFFFF
                    part = values[stops[r] + low : stops[r] + low + more + width]
                    for column, v in zip(out, (x["gram"], x["m"], x["n"], row, x["place"], part.tobytes())):
                        column.append(v)
            kinds = [pa.int64()] * 5 + [pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], ["gram", "m", "n", "row", "place", "part"])

    parts = (
        docs.join(wanted, "row").select("row", "text", "wanted")
        .mapInArrow(cut, "gram long, m long, n long, row long, place long, part binary")
    )
    if many:
        parts = scratch.save(parts, "parts")
    groups = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-few // per_group))
    kind = symbols(np.zeros(0, np.uint8), np.zeros(1, np.int64))[0].dtype
    found = (
        parts.filter(F.col("m") <= together)
        .withColumn("g", F.pmod(F.xxhash64("gram"), F.lit(groups)).cast("int"))
        .groupBy("g").applyInArrow(_refined(refine, width, kind), "row long, first long, last long")
    )
    found = scratch.save(found, "found")
    free_shuffles(spark)
    if many:
        blocks = -(-many // per_group)
        crowded = parts.filter(F.col("m") > together).withColumn("block", F.pmod(F.xxhash64("row", "place"), F.lit(blocks)).cast("int"))
        told = scratch.save(
            crowded.groupBy("block").applyInArrow(_ask(width, kind, blocks), ASKED).groupBy("part").applyInArrow(_tell, TOLD), "told"
        )
        alike = crowded.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(
            _alike(width, kind, blocks), "row long, first long, last long"
        )
        found = found.unionByName(alike)
    whole = anchors.join(slices.filter("n > 1").select("gram", "slice"), ["gram", "slice"], "left_semi").select(
        "row", F.shiftright("place", 20).alias("first"), (F.shiftright("place", 20) + F.col("place").bitwiseAND(0xFFFFF) + width).alias("last")
    )
    spans = found.unionByName(whole).groupBy("row").agg(F.collect_set(F.struct("first", "last")).alias("spans"))
    return scratch.save(spans, "spans")


def _refined(refine: Refine, width: int, kind: np.dtype):
    def compare(table: pa.Table) -> pa.Table:
        """Stretches of repeated windows of slices that occur once (the others are removed anyway)."""
        table = table.combine_chunks()
        data, ends = buffer_of(table.column("part").chunk(0))
        ends = ends // kind.itemsize
        values = numbers(np.frombuffer(data.tobytes(), kind))
        place = table.column("place").to_numpy()
        again = refine(values, ends, ends[:-1], ends[1:] - width)
        n = table.column("n").to_numpy()
        rows, at = table.column("row").to_numpy(), np.flatnonzero(again)
        of = np.searchsorted(ends, at, "right") - 1
        at, of = at[n[of] == 1], of[n[of] == 1]
        begin = np.flatnonzero(np.concatenate([[True], (np.diff(at) > 1) | (np.diff(of) > 0)])) if len(at) else at
        stop = np.concatenate([begin[1:], [len(at)]]).astype(np.int64) - 1 if len(at) else at
        start = (place[of[begin]] >> 20) - ends[of[begin]]
        return pa.table({"row": rows[of[begin]], "first": start + at[begin], "last": start + at[stop] + width})

    return compare


ASKED = "part int, block int, a binary, b binary, n binary"
TOLD = "part int, block int, again binary"


def _block_windows(table: pa.Table, width: int, kind: np.dtype):
    """All windows of a block's slices: two hashes each, sorted by them, the slice and the
    place in it, and the index of each window's distinct pair of hashes."""
    parts: list[list[np.ndarray]] = [[np.zeros(0, U)], [np.zeros(0, U)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]]
    for k, part in enumerate(table.column("part").to_pylist()):
        values = numbers(np.frombuffer(part, kind))
        a = window_hashes(prefix_sums(values), width)
        b = window_hashes(prefix_sums(values ^ U(0x5851F42D4C957F2D)), width)
        for column, value in zip(parts, (a, b, np.full(len(a), k), np.arange(len(a)))):
            column.append(value)
    a, b, piece, at = (np.concatenate(x) for x in parts)
    order = np.lexsort((b, a))
    a, b, piece, at = a[order], b[order], piece[order], at[order]
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    return a[new], b[new], piece, at, np.cumsum(new) - 1


def range_starts(keys: np.ndarray, ranges: int) -> np.ndarray:
    """Where each of the equal ranges of 64-bit values begins among the sorted keys."""
    cuts = [(i << 64) // ranges for i in range(1, ranges)]
    return np.concatenate([[0], np.searchsorted(keys, np.array(cuts, U)), [len(keys)]]).astype(np.int64)


def _ask(width: int, kind: np.dtype, ranges: int):
    def ask(table: pa.Table) -> pa.Table:
        a, b, piece, _, distinct = _block_windows(table, width, kind)
        often = np.minimum(table.column("n").to_numpy(), 2)  # a slice that occurs twice makes its windows repeated
        n = np.minimum(np.bincount(distinct, often[piece], len(a)), 2).astype(np.uint8)
        cut, block = range_starts(a, ranges), table.column("block")[0].as_py()
        rows = [
            {"part": p, "block": block, "a": a[x:y].tobytes(), "b": b[x:y].tobytes(), "n": n[x:y].tobytes()}
            for p, (x, y) in enumerate(zip(cut, cut[1:])) if x < y
        ]
        return pa.Table.from_pylist(rows, pa.schema([("part", pa.int32()), ("block", pa.int32()), ("a", pa.binary()), ("b", pa.binary()), ("n", pa.binary())]))

    return ask


def _tell(table: pa.Table) -> pa.Table:
    """For each block's windows in a range, in its order: whether there are two of them anywhere."""
    rows = table.to_pylist()
    a, b = (np.concatenate([np.frombuffer(r[c], U) for r in rows]) for c in ("a", "b"))
    n = np.concatenate([np.frombuffer(r["n"], np.uint8) for r in rows]).astype(np.int64)
    order = np.lexsort((b, a))
    new = np.ones(len(a), bool)
    new[1:] = (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1])
    distinct = np.empty(len(a), np.int64)
    distinct[order] = np.cumsum(new) - 1
    again = (np.bincount(distinct, n) > 1)[distinct]
    ends = np.cumsum([0, *(len(r["n"]) for r in rows)])
    return pa.table({
        "part": pa.array([r["part"] for r in rows], pa.int32()), "block": pa.array([r["block"] for r in rows], pa.int32()),
        "again": pa.array([again[x:y].tobytes() for x, y in zip(ends, ends[1:])], pa.binary()),
    })


def _alike(width: int, kind: np.dtype, ranges: int):
    def alike(_, left: pa.Table, right: pa.Table) -> pa.Table:
        """Stretches of repeated windows in a block's slices."""
        _, _, piece, at, distinct = _block_windows(left, width, kind)
        told = b"".join(r["again"] for r in sorted(right.to_pylist(), key=lambda r: r["part"]))
        again = np.frombuffer(told, bool)[distinct]
        order = np.lexsort((at[again], piece[again]))
        piece, at = piece[again][order], at[again][order]
        begin = np.ones(len(at), bool)
        begin[1:] = (np.diff(at) > 1) | (np.diff(piece) > 0)
        begin = np.flatnonzero(begin)
        stop = np.concatenate([begin[1:], [len(at)]]).astype(np.int64)[: len(begin)] - 1
        low = left.column("place").to_numpy() >> 20
        return pa.table({
            "row": left.column("row").to_numpy()[piece[begin]], "first": low[piece[begin]] + at[begin],
            "last": low[piece[stop]] + at[stop] + width,
        })

    return alike


def keyed(docs: DataFrame, doc: str, text: str) -> DataFrame:
    """doc_id, text (null as empty) and a hash of both that stands for the row."""
    return docs.select(F.col(doc).alias("doc_id"), whole_text(text).alias("text")).withColumn("row", F.xxhash64("doc_id", "text"))


def covered(n: int, spans: list[dict]) -> np.ndarray:
    """Flag per symbol: inside one of the spans."""
    marks = np.zeros(n + 1, np.int64)
    for s in spans:
        marks[s["first"]] += 1
        marks[s["last"]] -= 1
    return np.cumsum(marks[:-1]) > 0
