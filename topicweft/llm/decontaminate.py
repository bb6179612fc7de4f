"""Benchmark decontamination by Wu-Manber search over words.

Patterns are the word windows of the benchmark. A block of two words indexes a shift
table: how far a window's end may move before it can be the end of a pattern. Where
the shift is 0, the suffix-hash bucket of the block names the patterns to compare, and
a comparison of all the words, then of the bytes, confirms an occurrence. Documents
are cut into overlapping segments whose cursors advance together in numpy; no row is
shuffled. The pattern tables are broadcast in shards of bounded size, one pass each.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bytetext import ALNUM, LOWERED, U, chunks, mixed, word_hashes
from .common import Scratch, benchmark, documents, small_batches, total, whole_text

WORDS = 10
SHARD_BYTES = 8 << 20
SEGMENT = 256
TABLE_BITS = 20


def _blocks(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (mixed(a * U(3) + b) >> U(64 - TABLE_BITS)).astype(np.int64)


@dataclass
class Patterns:
    """Tables for all patterns of one length. ``items[p]``: the items that hold pattern p."""

    length: int
    words: np.ndarray  # patterns x length hashes
    texts: list[bytes]
    items: list[np.ndarray]
    shift: np.ndarray
    order: np.ndarray  # patterns by their last block
    bucket: np.ndarray  # where a block's patterns begin in order, by block + 1


def build(items: list[tuple[str, bytes]], words: int = WORDS) -> list[Patterns]:
    """Pattern tables of (identifier, text) items, one per pattern length."""
    found: dict[int, dict[bytes, tuple[np.ndarray, set[int]]]] = {}
    for number, (_, text) in enumerate(items):
        data = np.frombuffer(text, np.uint8)
        hashes, starts, stops, _ = word_hashes(data, np.array([0, len(data)]), ALNUM)
        low = LOWERED[data].tobytes()
        parts = [low[a:b] for a, b in zip(starts, stops)]
        size = min(words, len(parts))
        for i in range(len(parts) - size + 1 if size else 0):
            key = b" ".join(parts[i : i + size])
            found.setdefault(size, {}).setdefault(key, (hashes[i : i + size], set()))[1].add(number)
    out = []
    for size, patterns in sorted(found.items()):
        table = np.array([h for h, _ in patterns.values()], U).reshape(-1, size)
        shift = np.full(1 << TABLE_BITS, max(1, size - 1), np.int32)
        if size > 1:
            for end in range(1, size):  # later blocks leave smaller shifts
                np.minimum.at(shift, _blocks(table[:, end - 1], table[:, end]), size - 1 - end)
            last = _blocks(table[:, -2], table[:, -1])
        else:
            last = _blocks(table[:, 0], table[:, 0])
            shift[last] = 0
        order = np.argsort(last, kind="stable")
        bucket = np.searchsorted(last[order], np.arange((1 << TABLE_BITS) + 1))
        out.append(Patterns(size, table, list(patterns), [np.array(sorted(s)) for _, s in patterns.values()],
                            shift, order, bucket))
    return out


def occurrences(p: Patterns, hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Last words and patterns of all windows whose word hashes equal a pattern's."""
    m = p.length
    ends, stops = [], []
    lengths = np.diff(first)
    for at, n in zip(first[:-1][lengths >= m], lengths[lengths >= m]):
        begin = np.arange(at + m - 1, at + n, SEGMENT)
        ends.append(begin)
        stops.append(np.minimum(begin + SEGMENT, at + n))
    if not ends:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    cursor, stop = np.concatenate(ends), np.concatenate(stops)
    hit_ends, hit_patterns = [], []
    while len(cursor):
        block = _blocks(hashes[cursor - 1] if m > 1 else hashes[cursor], hashes[cursor])
        step = p.shift[block]
        at = np.flatnonzero(step == 0)
        if len(at):
            lo, hi = p.bucket[block[at]], p.bucket[block[at] + 1]
            count = hi - lo
            where = np.repeat(cursor[at], count)
            within = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            pattern = p.order[np.repeat(lo, count) + within]
            same = np.ones(len(where), bool)
            for k in range(m):
                same &= hashes[where - (m - 1) + k] == p.words[pattern, k]
            hit_ends.append(where[same])
            hit_patterns.append(pattern[same])
        cursor = cursor + np.maximum(step, 1)
        live = cursor < stop
        cursor, stop = cursor[live], stop[live]
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *hit_ends]), np.concatenate([none, *hit_patterns])


def search(data: np.ndarray, ends: np.ndarray, tables: list[Patterns]):
    """Per row: its words, a flag per word that a confirmed window covers, and the set of items."""
    hashes, starts, stops, first = word_hashes(data, ends, ALNUM)
    low = LOWERED[data]
    covered = np.zeros(len(hashes) + 1, np.int64)
    pairs = []
    for p in tables:
        at, pattern = occurrences(p, hashes, first)
        if not len(at):
            continue
        begin = at - p.length + 1
        sure = np.ones(len(at), bool)
        for k in range(len(at)):
            words = [low[a:b].tobytes() for a, b in zip(starts[begin[k] : at[k] + 1], stops[begin[k] : at[k] + 1])]
            sure[k] = b" ".join(words) == p.texts[pattern[k]]
        at, begin, pattern = at[sure], begin[sure], pattern[sure]
        np.add.at(covered, begin, 1)
        np.add.at(covered, at + 1, -1)
        row = np.searchsorted(first, at, "right") - 1
        pairs += [(r, i) for r, x in {*zip(row.tolist(), pattern.tolist())} for i in p.items[x].tolist()]
    return first, np.cumsum(covered[:-1]) > 0, pairs


def contamination(
    docs: DataFrame, bench: DataFrame, doc: str = "doc_id", text: str = "text", item: str = "item_id",
    item_text: str = "text", words: int = WORDS, shard_bytes: int = SHARD_BYTES,
) -> DataFrame:
    """doc_id, n_words, hits (positions of hit words), item_ids (sorted as strings) per input row.

    Words are runs of letters and digits (and anything beyond ASCII) after lower-casing
    A-Z; windows are ``words`` words of an item, or the whole item if it has fewer but
    not none. Null and empty texts have no words. The windows of items without an identifier count;
    they stand in ``item_ids`` as one null at the end. Rows with equal identifiers are rows of their own. An empty benchmark gives
    no hits, an empty table no rows; a text of any length is searched whole. A benchmark above ``shard_bytes`` is searched in several passes, each
    of which is written before the next one's tables are broadcast. Other columns are ignored.
    """
    spark = docs.sparkSession
    small_batches(spark)
    items = bench.select(F.col(item).cast("string").alias("i"), whole_text(item_text).alias("t"))
    shards = max(1, -(-total(items, F.octet_length("t") + 16) // shard_bytes))
    scratch = Scratch(spark, "decontaminate")
    rows = docs.select(F.col(doc).alias("doc_id"), whole_text(text).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    out = rows.select("doc_id", "text", F.lit(0).cast("long").alias("n_words"),
                      F.array().cast("array<long>").alias("hits"), F.array().cast("array<string>").alias("item_ids"))
    for shard in range(shards):
        part = items.filter(F.pmod(F.xxhash64("i", "t"), F.lit(shards)) == shard).dropDuplicates().collect()
        tables = spark.sparkContext.broadcast(
            ([r["i"] for r in part], build([(r["i"], r["t"].encode("utf-8", "surrogatepass")) for r in part], words))
        )
        last = shard == shards - 1
        out = out.mapInArrow(
            _pass(tables, last), f"doc_id {kind}, {'' if last else 'text string, '}n_words long, hits array<long>, item_ids array<string>"
        )
        if not last:
            out = scratch.save(out, f"pass-{shard}")
            tables.destroy()
            if shard:
                scratch.drop(f"pass-{shard - 1}")
    return out


def _pass(tables, last: bool):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, patterns = tables.value
        for batch, data, ends in chunks(batches):
            first, hit, pairs = search(data, ends, patterns)
            hits = [set(x) for x in batch.column("hits").to_pylist()]
            found = [set(x) for x in batch.column("item_ids").to_pylist()]
            at = np.flatnonzero(hit)
            for r, k in zip((np.searchsorted(first, at, "right") - 1).tolist(), at.tolist()):
                hits[r].add(k - int(first[r]))
            for r, i in pairs:
                found[r].add(names[i])
            columns = [
                batch.column("doc_id"), *([] if last else [batch.column("text")]), pa.array(np.diff(first), pa.int64()),
                pa.array([sorted(x) for x in hits], pa.list_(pa.int64())),
                pa.array([sorted(x, key=lambda s: (s is None, (s or "").encode())) for x in found], pa.list_(pa.string())),
            ]
            yield pa.RecordBatch.from_arrays(
                columns, ["doc_id", *([] if last else ["text"]), "n_words", "hits", "item_ids"]
            )

    return scan


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(documents(spark, sf_dir), benchmark(spark, sf_dir))
    return found.select(
        "doc_id", "n_words", F.size("hits").cast("long").alias("n_hit"), F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ",").cast("binary"), 256).alias("items_sha256"), (F.size("hits") > 0).alias("contaminated"),
    )


OP9_SQL = r"""
WITH dw AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
bw AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bp AS (SELECT item_id, w, least(len(w), 10) AS k, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM bw WHERE len(w) > 0),
bx AS (SELECT DISTINCT item_id, k, array_to_string(w[i : i + k - 1], ' ') AS p FROM bp),
ks AS (SELECT DISTINCT k FROM bx),
dp AS (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM dw, ks WHERE len(w) >= k),
dx AS (SELECT doc_id, k, i, array_to_string(w[i : i + k - 1], ' ') AS p FROM dp),
m AS (SELECT doc_id, k, i, item_id FROM dx JOIN bx USING (k, p)),
h AS (SELECT doc_id, count(DISTINCT x) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS x FROM m) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids
       FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM m) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN h USING (doc_id) LEFT JOIN it USING (doc_id)
"""
