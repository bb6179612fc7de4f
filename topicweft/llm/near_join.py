"""N-gram Jaccard join by MinHash banding.

Documents with equal n-gram sets form one node. Bands of MinHash values, as many and as
long as the target recall asks for, are shuffled on their hashes, and nodes that share a
band are joined in a star around the smallest, never in pairs. The stars' connected
components hold all candidate pairs. The full n-gram set of each member is sent to its
component once, and there all pairs are verified on the full sets. A component too large for
a task is cut into blocks, and each pair of blocks is a task of its own. Out come one
number of links per node and a spanning forest of the links, never the pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bytetext import NOT_SPACE, U, chunks, mixed, rows_of, word_hashes
from .common import Scratch, documents, lower_ascii, small_batches, whole_text
from .components import components
from .repeats import free_shuffles

WORDS = 5
THRESHOLD = 0.8
RECALL = 0.9999
MOST_HASHES = 128
BLOCK_ROWS = 512
BLOCK_SHINGLES = 1 << 18
GROUP_SHINGLES = 1 << 20
BLOCK_MASK = (1 << 31) - 1  # a pair of blocks is one number, the lower block above these bits


def bands_for(threshold: float, recall: float, most: int = MOST_HASHES) -> tuple[int, int]:
    """Bands and rows per band: the most rows with which few enough hashes reach the
    recall for pairs at the threshold."""
    best = (most, 1)
    for rows in range(1, most + 1):
        bands = max(1, math.ceil(math.log(1 - recall) / math.log1p(-(threshold**rows))))
        if bands * rows <= most:
            best = (bands, rows)
    return best


def shingles(data: np.ndarray, ends: np.ndarray, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct n-gram hashes of each row, one row after the other, and the rows'
    ends (0 first). A row of fewer words, but not none, has one n-gram."""
    hashes, _, _, first = word_hashes(data, ends, NOT_SPACE)
    row = rows_of(first)
    count = np.diff(first)
    size = np.minimum(count, words)[row]  # the n-gram's length in this row
    begins = np.flatnonzero(np.arange(len(hashes)) + size <= first[1:][row])
    code = np.zeros(len(begins), U)
    for k in range(words):
        inside = k < size[begins]
        part = mixed(code * U(0x9E3779B97F4A7C15) + hashes[np.minimum(begins + k, len(hashes) - 1)] + U(k))
        code = np.where(inside, part, code)
    row = row[begins]
    order = np.lexsort((code, row))
    code, row = code[order], row[order]
    new = np.ones(len(code), bool)
    new[1:] = (code[1:] != code[:-1]) | (row[1:] != row[:-1])
    code, row = code[new], row[new]
    return code, np.searchsorted(row, np.arange(len(ends)))


def band_keys(code: np.ndarray, ends: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """rows x bands: hashes of the MinHash values of each band. Rows must not be empty."""
    factors = mixed(np.arange(1, bands * rows + 1, dtype=U)) | U(1)
    out = np.zeros((len(ends) - 1, bands), U)
    for b in range(bands):
        key = np.full(len(ends) - 1, U(b + 1))
        for k in range(rows):
            least = np.minimum.reduceat(code * factors[b * rows + k], ends[:-1])
            key = mixed(key * U(0xFF51AFD7ED558CCD) + least)
        out[:, b] = key
    return out


def _sketch(words: int, bands: int, rows: int):
    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Per row a hash of its n-gram set, the set's size and its band hashes; nulls without n-grams."""
        for batch, data, ends in chunks(batches):
            code, first = shingles(data, ends, words)
            size = np.diff(first)
            full = np.flatnonzero(size)
            node, keys = np.zeros(len(size), np.int64), np.zeros((len(full), bands), U)
            if len(full):
                node[full] = set_hashes(code, first[:-1][full]).view(np.int64)
                keys = band_keys(code, np.append(first[:-1][full], len(code)), bands, rows)
            offsets = np.concatenate([[0], np.cumsum((size > 0) * bands)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("row"), pa.array(node, mask=size == 0), pa.array(size, pa.int64()),
                 pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys.ravel().view(np.int64)))],
                ["doc_id", "row", "node", "size", "keys"],
            )

    return sketch


def set_hashes(code: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """A hash per set from the sum of its mixed members."""
    return mixed(np.add.reduceat(mixed(code ^ U(0xA0761D6478BD642F)), starts))


def _sets(words: int):
    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Full n-gram sets of the members, once for each pair of blocks that theirs is in."""
        for batch, data, ends in chunks(batches):
            code, first = shingles(data, ends, words)
            out: list[list] = [[] for _ in range(6)]
            rows = zip(*(batch.column(c).to_pylist() for c in ("node", "component", "blocks", "copies")))
            for r, (node, component, blocks, copies) in enumerate(rows):
                own = code[first[r] : first[r + 1]]
                if not len(own) or int(set_hashes(own, np.zeros(1, np.int64)).view(np.int64)[0]) != node:
                    continue  # another text under the same hash
                block = int(mixed(np.array([node]).view(U))[0] % U(blocks))
                for other in range(blocks):
                    low, high = min(block, other), max(block, other)
                    for column, value in zip(out, (node, component, low << 31 | high, block, copies, own.tobytes())):
                        column.append(value)
            kinds = [pa.int64()] * 5 + [pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], SET_NAMES)

    return sets


SET_NAMES = ["node", "component", "pair", "block", "copies", "grams"]
SETS = "node long, component long, pair long, block long, copies long, grams binary"
LINKS = "node long, root long, links long"


def linked(sets: list[np.ndarray], blocks: np.ndarray, threshold: float, across: bool) -> list[np.ndarray]:
    """For each set the later ones with at least that Jaccard similarity, only those of
    another block if ``across``. A group of two blocks is across even where one of them is empty."""
    if across and (blocks == blocks[0]).all():
        return [np.zeros(0, np.int64)] * len(sets)
    sizes = np.array([len(s) for s in sets])
    _, member = np.unique(np.concatenate(sets), return_inverse=True)
    first = np.concatenate([[0], np.cumsum(sizes)])
    flags = np.zeros(member.max() + 1, np.int32)
    out = []
    for i in range(len(sets)):
        rest = first[i + 1]
        if rest == len(member):
            out.append(np.zeros(0, np.int64))
            break
        own = member[first[i] : rest]
        flags[own] = 1
        shared = np.add.reduceat(flags[member[rest:]], first[i + 1 : -1] - rest)
        flags[own] = 0
        like = shared >= threshold * (sizes[i] + sizes[i + 1 :] - shared) - 1e-9
        if across:
            like &= blocks[i + 1 :] != blocks[i]
        out.append(np.flatnonzero(like) + i + 1)
    return out


def _verify(threshold: float):
    def verify(table: pa.Table) -> pa.Table:
        groups: dict[tuple[int, int], dict[int, tuple]] = {}
        columns = (table.column(c).to_pylist() for c in SET_NAMES)
        for node, component, pair, block, copies, grams in zip(*columns):
            groups.setdefault((component, pair), {})[node] = (block, copies, np.frombuffer(grams, U))
        out: list[tuple[int, int, int]] = []
        for (_, pair), members in groups.items():
            nodes = sorted(members)
            copies = np.array([members[n][1] for n in nodes])
            links, root = np.zeros(len(nodes), np.int64), list(range(len(nodes)))

            def top(x: int) -> int:
                while root[x] != x:
                    root[x] = root[root[x]]
                    x = root[x]
                return x

            blocks, across = np.array([members[n][0] for n in nodes]), pair >> 31 != pair & BLOCK_MASK
            found = linked([members[n][2] for n in nodes], blocks, threshold, across)
            for i, partners in enumerate(found):
                links[i] += copies[partners].sum()
                links[partners] += copies[i]
                for j in partners.tolist():
                    a, b = top(i), top(j)
                    root[max(a, b)] = min(a, b)
            out += [(n, nodes[top(i)], int(links[i])) for i, n in enumerate(nodes) if links[i]]
        return pa.table({c: pa.array([r[k] for r in out], pa.int64()) for k, c in enumerate(("node", "root", "links"))})

    return verify


def near_classes(
    docs: DataFrame, doc: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, words: int = WORDS,
    recall: float = RECALL, block_rows: int = BLOCK_ROWS, block_shingles: int = BLOCK_SHINGLES,
) -> DataFrame:
    """One row per input row: doc_id, class_id (smallest identifier of its class), n_links, class_size,
    row (a hash of identifier and text) and first (the row stands for its class).

    Rows are linked if the sets of their ``words``-grams (words between ASCII white space,
    A-Z lower-cased; a text of fewer words is one n-gram) have a Jaccard similarity of
    ``threshold`` or more; a class is what links connect, and ``n_links`` counts the other
    rows linked to this one, copies included. A pair at the threshold becomes a
    candidate with probability ``recall``; all pairs within the candidates' components are
    verified, and none is left out for the size of its group. Texts without words (null, blank) are linked to
    nothing and are classes of their own. A row without an identifier is linked like any other; a class of such rows
    only has a null ``class_id``. The first row of a class is that of the smallest identifier (null last), then of the smallest
    ``row``; rows that repeat identifier and text are first together. Identifiers are integers; other columns are ignored. An
    empty table gives no rows, and a text of any length is one set.
    """
    spark = docs.sparkSession
    small_batches(spark)
    scratch = Scratch(spark, "near-join")
    bands, rows = bands_for(threshold, recall)
    texts = docs.select(F.col(doc).cast("long").alias("doc_id"), whole_text(text).alias("text")).select(
        "doc_id", F.xxhash64("doc_id", "text").alias("row"), lower_ascii(F.col("text")).alias("text")
    )
    sketches = scratch.save(
        texts.mapInArrow(_sketch(words, bands, rows), "doc_id long, row long, node long, size long, keys array<long>"), "sketches"
    )
    known = sketches.filter("node is not null")
    nodes = scratch.save(
        known.groupBy("node").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row")).alias("best"), F.count(F.lit(1)).alias("copies"), F.max("size").alias("size"))
        .select("node", "best", "best.row", "copies", "size"), "nodes"
    )
    banded = known.dropDuplicates(["node"]).select("node", F.explode("keys").alias("key"))
    shared = banded.groupBy("key").agg(F.min("node").alias("center"), F.max("node").alias("other")).filter("center <> other")
    stars = banded.join(shared.select("key", "center"), "key").select(F.col("node").alias("u"), F.col("center").alias("v"))
    candidates = components(stars, scratch, "candidates")
    members = scratch.save(candidates.join(nodes, "node"), "members")
    sizes = members.groupBy("component").agg(
        F.greatest(F.ceil(F.count(F.lit(1)) / block_rows), F.ceil(F.sum("size") / block_shingles)).alias("blocks")
    )
    members = scratch.save(members.join(sizes, "component"), "blocked")
    free_shuffles(spark)
    shipped = members.agg(F.sum(F.col("size") * F.col("blocks"))).first()[0] or 0
    groups = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-shipped // GROUP_SHINGLES))
    wanted = members.select("row", "node", "component", "blocks", "copies").hint("merge")  # grows with the input
    sets = texts.select("row", "text").join(wanted, "row").mapInArrow(_sets(words), SETS)
    links = scratch.save(
        sets.withColumn("g", F.pmod(F.xxhash64("component", "pair"), F.lit(groups)).cast("int"))
        .groupBy("g").applyInArrow(_verify(threshold), LINKS), "links",
    )
    free_shuffles(spark)
    classes = components(links.select(F.col("node").alias("u"), F.col("root").alias("v")), scratch, "classes")
    counts = links.groupBy("node").agg(F.sum("links").alias("links"))
    of_node = (
        nodes.join(classes, "node", "left").join(counts, "node", "left")
        .withColumn("component", F.coalesce("component", "node"))
    )
    named = of_node.groupBy("component").agg(F.min("best").alias("head"), F.sum("copies").alias("class_size"))
    of_node = of_node.join(named, "component").select(
        "node", "head", "class_size", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")
    )
    return sketches.select("doc_id", "row", "node").join(of_node, "node", "left").select(
        "doc_id", F.coalesce("head.doc_id", "doc_id").alias("class_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("class_size", F.lit(1)).cast("long").alias("class_size"),
        "row", F.coalesce(F.col("head.row") == F.col("row"), F.lit(True)).alias("first"),
    )


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_classes(documents(spark, sf_dir)).select("doc_id", "class_id", "n_links", "class_size")
