"""Collapsed Gibbs LDA on DataFrames.

State: one row per document with its words and topics as arrays, dealt in blocks of whole
documents; a word is its place among the block's words. Next to its documents a block
gives its words' topic counts, which are summed over the blocks that share the word; the
counts of a word that one block has stay in it. So tokens are never rows of a join.
``LdaModel.state`` shows the same as one row per token, ``doc_id, pos, word_id, z``.
Within a sweep all documents see the counts of the sweep's start (the AD-LDA
approximation, Newman et al. 2009). Three modes:

``sync``  every token is drawn against the sweep-start counts with its own
          count removed.
``doc``   tokens of a document are drawn one after the other and each draw sees
          the document's earlier ones; Arrow batches of whole documents, a row per token.
``alias`` as ``doc`` within a document, but a draw costs the same for any number of
          topics: proposals from alias tables of the word's sweep-start counts and
          from the document's own topics, accepted by Metropolis-Hastings.

No topic-word matrix is ever held by the driver or a single task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.arrays import counts_by_topic
from ..functions.draws import bits, remix, token_bits, token_uniform, uniform
from ..plans.scratch import Scratch
from ..plans.skew import HotKeys, count_by
from . import corpus as C


def random_topics(tokens: DataFrame, k: int, seed: int) -> DataFrame:
    """Uniform random topic ``z`` per token."""
    u = uniform(seed, F.col("doc_id"), F.col("pos"), 0)
    return tokens.withColumn("z", F.floor(u * k).cast("int"))


def word_topic_counts(state: DataFrame, k: int) -> DataFrame:
    """``word_id, n array`` of K counts; partial sums before the only shuffle."""
    return state.groupBy("word_id").agg(counts_by_topic(F.col("z"), F.lit(1), k).alias("n"))


def doc_topic_counts(state: DataFrame, k: int) -> DataFrame:
    """``doc_id, n array`` of K counts."""
    return state.groupBy("doc_id").agg(counts_by_topic(F.col("z"), F.lit(1), k).alias("n"))


def topic_totals(state: DataFrame, k: int) -> DataFrame:
    """One row: ``n array`` of K totals."""
    return state.agg(counts_by_topic(F.col("z"), F.lit(1), k).alias("n"))


def by_topic(df: DataFrame, value: str) -> DataFrame:
    """K-arrays as rows: the other columns, ``topic`` and ``value``."""
    rest = [c for c in df.columns if c != value]
    return df.select(*rest, F.posexplode(value).alias("topic", value))


BLOCK_TOKENS, LEAST_TOKENS, BLOCKS_PER_CORE = 2_000_000, 20_000, 4
BLOCK_BYTES = 128 << 20  # of the vectors of a block's words
CELLS = 1 << 17  # of a working array, which stays in a core's cache
FEW_TOPICS = 16


def block_of(blocks: int) -> Column:
    """The block of a document: whole documents, about equal numbers of tokens."""
    return F.pmod(F.xxhash64("doc_id"), F.lit(blocks)).cast("int")


def blocks_for(tokens: DataFrame, v: int, k: int) -> int:
    """Blocks grow in number with the tokens, not in size: small enough for the K-vectors of their words (at most one
    per token, and ``v``) to fit, and a few per core where there are tokens enough."""
    return _blocks(tokens.sparkSession, tokens.count(), v, k)


def _blocks(spark: SparkSession, n: int, v: int, k: int, per_core: int = BLOCKS_PER_CORE) -> int:
    most = min(BLOCK_TOKENS, max(1, BLOCK_BYTES // (8 * k))) if v * k * 8 > BLOCK_BYTES else BLOCK_TOKENS
    cores = spark.sparkContext.defaultParallelism
    return max(1, -(-n // most), min(per_core * cores, n // LEAST_TOKENS))


def block_words(tokens: DataFrame, blocks: int) -> DataFrame:
    """``part, word``: the distinct words of each block."""
    return tokens.select(block_of(blocks).alias("part"), F.col("word_id").alias("word")).distinct()


def _word_vectors(pairs: DataFrame, words: DataFrame, value: str) -> DataFrame:
    """``part, word, vector``: a word's vector once for each block that has the word."""
    return pairs.join(words.select(F.col("word_id").alias("word"), F.col(value).alias("vector")), "word")


def _draw(weights: np.ndarray, u: np.ndarray) -> np.ndarray:
    """Per row the first running sum that reaches ``u`` times the total."""
    running = np.cumsum(weights, axis=1)
    hit = running >= (u * running[:, -1])[:, None]
    return np.where(hit.any(axis=1), hit.argmax(axis=1), weights.shape[1] - 1)


def _slices(n: int, k: int) -> Iterator[slice]:
    step = max(1, CELLS // k)
    return (slice(i, min(i + step, n)) for i in range(0, n, step))


class _Block:
    """The tokens of a block of documents as arrays, and the vectors of their words."""

    def __init__(self, tokens: pa.Table, vectors: pa.Table):
        self.doc = pc.dictionary_encode(tokens.column("doc_id").combine_chunks())
        self.docs = self.doc.indices.to_numpy()
        self.z = tokens.column("z").to_numpy().astype(np.int64)
        words = vectors.column("word").to_numpy()
        order = np.argsort(words)
        self.row = order[np.searchsorted(words[order], tokens.column("word_id").to_numpy())]
        flat = pc.list_flatten(vectors.column("vector").combine_chunks()).to_numpy(zero_copy_only=False)
        self.vectors = flat.astype(float).reshape(len(words), -1)

    def doc_counts(self, k: int) -> np.ndarray:
        n = len(self.doc.dictionary)
        return np.bincount(self.docs * k + self.z, minlength=n * k).reshape(n, k).astype(float)


def _list(values: np.ndarray, lengths: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(lengths))), pa.int32()), pa.array(values))


def _packed(values: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """Binary values of ``lengths`` numbers each."""
    ends = np.concatenate(([0], np.cumsum(lengths))) * values.itemsize
    return pa.Array.from_buffers(pa.binary(), len(lengths), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(values))])


def _unpacked(column: pa.ChunkedArray, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of ``_packed`` values, and how many each value has."""
    packed = column.combine_chunks()
    _, ends, data = packed.buffers()
    ends = np.frombuffer(ends, np.int32)[packed.offset : packed.offset + len(packed) + 1]
    bytes_ = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data else np.empty(0, np.uint8)
    return bytes_.view(kind).astype(np.int64), np.diff(ends).astype(np.int64) // np.dtype(kind).itemsize


def _topic_kind(k: int) -> type:
    return np.uint8 if k <= 256 else np.int32


def _matrix(values: np.ndarray) -> pa.ListArray:
    return _list(values.astype(np.int64).ravel(), np.full(len(values), values.shape[1]))


def _rows_of(table: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """``table[rows]``; of few columns, column by column."""
    return table.T.take(rows, axis=1).T if table.shape[1] <= FEW_TOPICS else table[rows]


class _Documents:
    """The tokens of a block's documents as arrays: ``row`` of the document's row, ``doc`` of its identifier."""

    def __init__(self, rows: pa.Table, lengths: np.ndarray):
        self.lengths = lengths
        self.keys, self.ids = rows.column("key").to_pylist(), rows.column("doc_id").combine_chunks()
        encoded = pc.dictionary_encode(self.ids, null_encoding="encode")
        self.size, self.repeated = len(encoded.dictionary), len(encoded.dictionary) < rows.num_rows
        self.row = np.repeat(np.arange(rows.num_rows), self.lengths)
        self.doc = encoded.indices.to_numpy()[self.row]
        self.pos = np.arange(len(self.row)) - np.repeat(np.cumsum(self.lengths) - self.lengths, self.lengths)
        if "pos" in rows.column_names:  # kept where the words looked up are not all of the text
            kept = rows.column("pos").combine_chunks()
            at = kept.is_valid().to_numpy(zero_copy_only=False)[self.row]
            self.pos[at] = pc.list_flatten(kept).to_numpy()

    def counts(self, at: np.ndarray, z: np.ndarray, n: int, k: int) -> np.ndarray:
        """``n`` rows of K counts of the topics ``z``."""
        return np.bincount(at * k + z, minlength=n * k).reshape(n, k)

    def dealt(self, block: int, word: np.ndarray, z: np.ndarray, k: int, kept: pa.Array | None = None) -> pa.Table:
        """A row per document that has words."""
        table = pa.table({
            "block": pa.array(np.full(len(self.ids), block, np.int32)), "doc_id": self.ids,
            "pos": pa.nulls(len(self.ids), pa.list_(pa.int32())) if kept is None else kept,
            "word": _packed(word.astype(np.int32), self.lengths), "z": _packed(z.astype(_topic_kind(k)), self.lengths),
            "n": _matrix(self.counts(self.row, z, len(self.ids), k)),
        })
        return table.filter(pa.array(self.lengths > 0))


def _with_words(documents: pa.Table, words: dict[str, pa.Array], names: list[str]) -> pa.Table:
    """A block's documents and words as one table; ``place`` is null in a document's row."""
    return pa.concat_tables([documents, pa.table(words)], promote_options="default").select(names)


COLUMNS = "block int, doc_id {kind}, pos array<int>, word binary, z binary, n array<bigint>, place int, "


def block_texts(corpus: DataFrame, blocks: int) -> DataFrame:
    """``block, doc_id, key, text, sizes``: documents that have words, these joined without a gap and their lengths in bytes."""
    return corpus.filter(F.size("words") > 0).select(block_of(blocks).alias("block"), "doc_id", F.col("doc_id").cast("string").alias("key"),
        F.array_join("words", "").alias("text"), F.transform("words", F.octet_length).alias("sizes"))


def _placed(rows: pa.Table) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The distinct words of ``block_texts`` rows in byte order, the place of every token's word among them, and the tokens per row."""
    sizes = rows.column("sizes").combine_chunks()
    ends = np.concatenate(([0], np.cumsum(pc.list_flatten(sizes).to_numpy())))
    texts = rows.column("text").combine_chunks()
    first = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset]
    flat = pa.Array.from_buffers(pa.string(), len(ends) - 1, [None, pa.py_buffer((ends + first).astype(np.int32)), texts.buffers()[2]])
    words = flat.dictionary_encode()
    order = pc.sort_indices(words.dictionary).to_numpy()
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    lengths = pc.list_value_length(sizes).to_numpy(zero_copy_only=False).astype(np.int64)
    return words.dictionary.take(pa.array(order)), place[words.indices.to_numpy()], lengths


def _split(corpus: DataFrame, k: int, seed: int, blocks: int) -> DataFrame:
    """The corpus in blocks, its tokens' first topics drawn: documents, and the words of each block with their counts.
    ``place`` numbers the words of a block in byte order, which is that of their ``word_id``."""
    names = ["block", "doc_id", "pos", "word", "z", "n", "place", "text"]

    def split(key: tuple, rows: pa.Table) -> pa.Table:
        order, word, lengths = _placed(rows)
        block = _Documents(rows, lengths)
        z = np.floor(token_uniform(seed, block.keys, block.row, block.pos, 0) * k).astype(np.int64)
        found = {
            "block": pa.array(np.full(len(order), key[0].as_py(), np.int32)), "place": pa.array(np.arange(len(order), dtype=np.int32)),
            "text": order, "n": _matrix(block.counts(word, z, len(order), k)),
        }
        return _with_words(block.dealt(key[0].as_py(), word, z, k), found, names)

    rows = block_texts(corpus, blocks)
    return rows.groupBy("block").applyInArrow(split, COLUMNS.format(kind=dict(corpus.dtypes)["doc_id"]) + "text string")


def _gather(tokens: DataFrame, k: int, blocks: int) -> DataFrame:
    """Given tokens ``doc_id, pos, word_id, z`` in blocks, as ``_split`` gives them; words by ``word_id``."""
    names = ["block", "doc_id", "pos", "word", "z", "n", "place", "word_id"]

    def gather(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("doc_id", "ascending"), ("pos", "ascending")])
        ids = pc.dictionary_encode(rows.column("doc_id").combine_chunks(), null_encoding="encode")
        lengths = np.bincount(ids.indices.to_numpy(), minlength=len(ids.dictionary))
        ends = np.cumsum(lengths)
        starts = rows.column("doc_id").combine_chunks().take(pa.array(ends - lengths))
        block = _Documents(pa.table({"doc_id": starts, "key": pa.nulls(len(lengths), pa.string())}), lengths)
        words, word = np.unique(rows.column("word_id").to_numpy(), return_inverse=True)
        z, pos = rows.column("z").to_numpy().astype(np.int64), rows.column("pos").to_numpy()
        kept = None if (pos == block.pos).all() else _list(pos.astype(np.int32), lengths)
        found = {
            "block": pa.array(np.full(len(words), key[0].as_py(), np.int32)), "place": pa.array(np.arange(len(words), dtype=np.int32)),
            "word_id": pa.array(words), "n": _matrix(block.counts(word, z, len(words), k)),
        }
        return _with_words(block.dealt(key[0].as_py(), word, z, k, kept), found, names)

    rows = tokens.select(block_of(blocks).alias("block"), "doc_id", "pos", F.col("word_id").cast("long"), "z")
    return rows.groupBy("block").applyInArrow(gather, COLUMNS.format(kind=dict(tokens.dtypes)["doc_id"]) + "word_id bigint")


def _sum_counts(n: str, k: int) -> Column:
    return F.array(*[F.sum(F.col(n)[i]) for i in range(k)])


class _Blocks:
    """A state in blocks: ``dealt`` has a row per document and, next to them, the topic counts of each block's words;
    ``pairs`` (``part, place, word_id, shared, vector``) says which words these are, with the first counts of those that several blocks have."""

    def __init__(self, dealt: DataFrame, pairs: DataFrame, k: int, counted: DataFrame):
        self.dealt, self.pairs, self.k, self.counted = dealt, pairs, k, counted

    @property
    def documents(self) -> DataFrame:
        return self.dealt.filter("place is null").select("block", "doc_id", "pos", "word", "z", "n")

    def totals(self) -> np.ndarray:
        """Tokens per topic."""
        found = self.documents.agg(_sum_counts("n", self.k).alias("n")).first()["n"]
        return np.array([t or 0 for t in found], dtype=float)

    def doc_topics(self) -> DataFrame:
        return self.documents.groupBy("doc_id").agg(_sum_counts("n", self.k).alias("n"))

    def word_topics(self) -> DataFrame:
        return self.counted

    def tokens(self) -> DataFrame:
        """``doc_id, pos, word_id, z``"""
        kind = _topic_kind(self.k)

        def listed(_, rows: pa.Table, words: pa.Table) -> pa.Table:
            word, lengths = _unpacked(rows.column("word"), np.int32)
            block, z = _Documents(rows, lengths), _unpacked(rows.column("z"), kind)[0]
            ids = np.empty(words.num_rows, np.int64)
            ids[words.column("place").to_numpy()] = words.column("word_id").to_numpy()
            return pa.table({"doc_id": block.ids.take(pa.array(block.row)), "pos": block.pos.astype(np.int32), "word_id": ids[word], "z": z.astype(np.int32)})

        rows = self.documents.select("block", "doc_id", F.col("doc_id").cast("string").alias("key"), "pos", "word", "z")
        words = self.pairs.select("part", "place", "word_id")
        schema = f"doc_id {dict(rows.dtypes)['doc_id']}, pos int, word_id bigint, z int"
        return rows.groupBy("block").cogroup(words.groupBy("part")).applyInArrow(listed, schema)

    def word_pairs(self, phi: DataFrame | None = None) -> DataFrame:
        """``doc_id, word_id, n`` for the words of each document, counted in its block; with ``phi`` (``word_id, phi``) also
        ``p``, the sum over the topics of the document's and the word's shares."""
        kind, k, scored = _topic_kind(self.k), self.k, phi is not None

        def counted(_, rows: pa.Table, words: pa.Table) -> pa.Table:
            word, lengths = _unpacked(rows.column("word"), np.int32)
            block, place = _Documents(rows, lengths), words.column("place").to_numpy()
            size = int(word.max()) + 1
            ids = np.empty(size, np.int64)
            ids[place] = words.column("word_id").to_numpy()
            cells, n = np.unique(block.doc * size + word, return_counts=True)
            doc, at = np.divmod(cells, size)
            names = pc.dictionary_encode(block.ids, null_encoding="encode").dictionary
            found = {"doc_id": names.take(pa.array(doc)), "word_id": ids[at], "n": n.astype(np.int64)}
            if scored:
                by_doc = block.counts(block.doc, _unpacked(rows.column("z"), kind)[0], block.size, k)
                theta, shares, p = by_doc / by_doc.sum(axis=1, keepdims=True), np.empty((size, k)), np.zeros(len(cells))
                shares[place] = pc.list_flatten(words.column("phi").combine_chunks()).to_numpy(zero_copy_only=False).reshape(-1, k)
                for i in range(k):
                    p += theta[doc, i] * shares[at, i]
                found["p"] = p
            return pa.table(found)

        rows = self.documents.select("block", "doc_id", F.lit(None).cast("string").alias("key"), "word", *(["z"] if scored else []))
        words = self.pairs.select("part", "place", "word_id")
        if scored:
            words = words.join(phi, "word_id").select("part", "place", "word_id", "phi")
        schema = f"doc_id {dict(rows.dtypes)['doc_id']}, word_id bigint, n bigint" + (", p double" if scored else "")
        return rows.groupBy("block").cogroup(words.groupBy("part")).applyInArrow(counted, schema)

    def vectors(self, first: bool, last: bool) -> DataFrame:
        """``part, place, word_id, vector``: the counts of words that several blocks have; at the last sweep all words, whose counts are asked for.
        After the first sweep these counts are packed, as ``places, words, counts`` of a block's words in a range."""
        # no null arrays: to size its batches Spark walks the nulls of a list column again for every row
        columns = ["part", "place", "word_id", F.coalesce("vector", F.array().cast("array<bigint>")).alias("vector")]
        nothing = [F.lit(None).cast("binary").alias(c) for c in PACKED]
        if first:
            return (self.pairs if last else self.pairs.filter("shared")).select(*columns, *nothing)
        sent = self.dealt.filter("place is not null").select("place", "block", "places", F.col("word").alias("words"), F.col("z").alias("counts"))
        found = sent.groupBy("place").applyInArrow(_added(self.k), "part int, " + ", ".join(f"{c} binary" for c in PACKED))
        found = found.select("part", F.lit(None).cast("int").alias("place"), F.lit(None).cast("long").alias("word_id"), F.array().cast("array<bigint>").alias("vector"), *PACKED)
        return found.unionByName(self.pairs.filter("not shared").select(*columns, *nothing)) if last else found


PACKED = ["places", "words", "counts"]
WORDS_PER_RANGE = 500_000


def _ranges(state: _Blocks) -> int:
    """Ranges of words, in which the counts of shared words are summed over the blocks: one per core, more where they would be large."""
    n = state.pairs.filter("shared").count()
    return max(1, min(state.pairs.sparkSession.sparkContext.defaultParallelism, n // LEAST_TOKENS), -(-n // WORDS_PER_RANGE))


def _arrays(column: pa.ChunkedArray, kind: type) -> np.ndarray:
    """The numbers of all binary values that are not null, one after the other."""
    return np.frombuffer(b"".join(column.drop_null().to_pylist()), kind)


def _added(k: int) -> Callable[[pa.Table], pa.Table]:
    """Counts of a range's words summed over the blocks, for each block in the order in which it gave them."""

    def added(rows: pa.Table) -> pa.Table:
        lengths = pc.binary_length(rows.column("words")).to_numpy() // 8
        words, counts = _arrays(rows.column("words"), np.int64), _arrays(rows.column("counts"), np.int64).reshape(-1, k)
        found, at = np.unique(words, return_inverse=True)
        sums = np.stack([np.bincount(at, counts[:, i], len(found)) for i in range(k)], axis=1).astype(np.int64)
        ends = np.cumsum(lengths)
        given = pa.array([sums[at[end - n : end]].tobytes() for end, n in zip(ends, lengths)], pa.binary())
        return pa.table({"part": rows.column("block"), "places": rows.column("places"), "words": rows.column("words"), "counts": given})

    return added


def _packed_words(block: int, place: np.ndarray, words: np.ndarray, counts: np.ndarray, ranges: int) -> dict[str, pa.Array]:
    """A row per range of words: ``place`` is the range, ``word`` has the identifiers and ``z`` the counts."""
    of = words % ranges
    order = np.argsort(of, kind="stable")
    parts = np.split(order, np.flatnonzero(np.diff(of[order])) + 1) if len(order) else []
    return {
        "block": pa.array(np.full(len(parts), block, np.int32)), "place": pa.array([int(of[p[0]]) for p in parts], pa.int32()),
        "places": pa.array([place[p].astype(np.int32).tobytes() for p in parts], pa.binary()),
        "word": pa.array([words[p].astype(np.int64).tobytes() for p in parts], pa.binary()),
        "z": pa.array([np.ascontiguousarray(counts[p], np.int64).tobytes() for p in parts], pa.binary()),
    }


def _deal(corpus: DataFrame, k: int, seed: int, scratch: Scratch, per_core: int = BLOCKS_PER_CORE) -> tuple[DataFrame, _Blocks]:
    """Dictionary and first state of a corpus. Texts are read once, after their tokens are counted."""
    n = corpus.agg(F.sum(F.size("words"))).first()[0] or 0
    v = n if k <= FEW_TOPICS else corpus.select(F.explode("words").alias("word")).agg(F.approx_count_distinct("word")).first()[0]
    dealt = scratch.save(_split(corpus, k, seed, _blocks(corpus.sparkSession, n, v, k, per_core)), "sweep=0")
    found = dealt.filter("place is not null").select(F.col("block").alias("part"), "place", F.col("text").alias("word"), "n")
    counts = scratch.save(found.groupBy("word").agg(_sum_counts("n", k).alias("vector"), F.count(F.lit(1)).alias("blocks")), "counts")
    indexed = scratch.save(C.dense_index(counts, "word", "word_id").select("word_id", "word", "vector", "blocks"), "vocabulary")
    size = F.aggregate("vector", F.lit(0).cast("long"), lambda a, x: a + x)
    pairs = found.drop("n").join(indexed, "word").select("part", "place", "word_id", (F.col("blocks") > 1).alias("shared"), F.when(F.col("blocks") > 1, F.col("vector")).alias("vector"))
    counted = indexed.select("word_id", F.col("vector").alias("n"))
    return indexed.select("word_id", "word", size.alias("n")), _Blocks(dealt, scratch.save(pairs, "block-words"), k, counted)


def _deal_tokens(tokens: DataFrame, k: int, v: int, scratch: Scratch, name: str) -> _Blocks:
    """A state in blocks from one with a row per token."""
    return _paired(scratch.save(_gather(tokens, k, blocks_for(tokens, v, k)), name), k, scratch)


def _paired(dealt: DataFrame, k: int, scratch: Scratch) -> _Blocks:
    """A state to start from, of blocks whose words all have a row with their counts."""
    found = dealt.filter("place is not null").select(F.col("block").alias("part"), "place", "word_id", "n")
    over = Window.partitionBy("word_id")
    shared = F.count(F.lit(1)).over(over) > 1
    summed = F.array(*[F.sum(F.col("n")[i]).over(over) for i in range(k)])
    pairs = found.select("part", "place", "word_id", shared.alias("shared"), summed.alias("vector"))
    pairs = pairs.withColumn("vector", F.when(F.col("shared"), F.col("vector")))
    return _Blocks(dealt, scratch.save(pairs, "block-words"), k, found.groupBy("word_id").agg(_sum_counts("n", k).alias("n")))


Draw = Callable[[_Documents, np.ndarray, np.ndarray, np.ndarray, np.ndarray], np.ndarray]


def _sweep(state: _Blocks, draw: Draw, first: bool, last: bool, ranges: int) -> DataFrame:
    """One sweep over all blocks; ``draw`` gives a block's new topics from its documents, words, topics, word counts and the topic totals.
    Next to the documents the last sweep has a row per block and word, others a row per block and range of words that several blocks have."""
    k, totals = state.k, state.totals()
    names = ["block", "doc_id", "pos", "word", "z", "n", "place", "word_id" if last else "places"]

    def redraw(key: tuple, rows: pa.Table, vectors: pa.Table) -> pa.Table:
        word, lengths = _unpacked(rows.column("word"), np.int32)
        block, z = _Documents(rows, lengths), _unpacked(rows.column("z"), _topic_kind(k))[0]
        size = int(word.max()) + 1
        by_word = block.counts(word, z, size, k)  # right for a word that this block alone has
        given = vectors.filter(pc.greater(pc.list_value_length(vectors.column("vector")), 0))
        flat = pc.list_flatten(given.column("vector").combine_chunks()) if given.num_rows else pa.array([], pa.int64())
        by_word[given.column("place").to_numpy()] = flat.to_numpy().reshape(-1, k)
        at, ids = _arrays(vectors.column("places"), np.int32), _arrays(vectors.column("words"), np.int64)
        by_word[at] = _arrays(vectors.column("counts"), np.int64).reshape(-1, k)
        new = draw(block, word, z, by_word.astype(float), totals)
        plain = vectors.filter(pc.is_valid(vectors.column("place")))
        place = np.concatenate([plain.column("place").to_numpy().astype(np.int64), at])
        ids, counts = np.concatenate([plain.column("word_id").to_numpy(), ids]).astype(np.int64), block.counts(word, new, size, k)[place]
        if last:
            found = {
                "block": pa.array(np.full(len(place), key[0].as_py(), np.int32)), "place": pa.array(place, pa.int32()),
                "word_id": pa.array(ids, pa.int64()), "n": _matrix(counts),
            }
        else:
            found = _packed_words(key[0].as_py(), place, ids, counts, ranges)
        return _with_words(block.dealt(key[0].as_py(), word, new, k, rows.column("pos").combine_chunks()), found, names)

    rows = state.documents.drop("n").withColumn("key", F.col("doc_id").cast("string"))
    schema = COLUMNS.format(kind=dict(rows.dtypes)["doc_id"]) + ("word_id bigint" if last else "places binary")
    return rows.groupBy("block").cogroup(state.vectors(first, last).groupBy("part")).applyInArrow(redraw, schema)


def _sync_draw(k: int, alpha: float, beta: float, v: int, seed: int, sweep: int) -> Draw:
    def draw(block: _Documents, word: np.ndarray, z: np.ndarray, by_word: np.ndarray, totals: np.ndarray) -> np.ndarray:
        order = "F" if k <= FEW_TOPICS else "C"
        by_doc = np.asarray(block.counts(block.doc, z, block.size, k), dtype=float, order=order)
        by_word = np.asarray(by_word, order=order)
        u, new = token_uniform(seed, block.keys, block.row, block.pos, sweep), np.empty(len(z), np.int64)
        for part in _slices(len(z), k):
            of_doc, of_word = _rows_of(by_doc, block.doc[part]), _rows_of(by_word, word[part])
            own = np.zeros_like(of_doc)
            own[np.arange(len(own)), z[part]] = 1.0
            new[part] = _draw((of_doc - own + alpha) * (of_word - own + beta) / (totals - own + v * beta), u[part])
        return new

    return draw


def _per_document(tokens: DataFrame, vector: str, k: int, columns: list[str], run, schema: str) -> DataFrame:
    """Apply ``run`` to the tokens of one document after the other, in text order.

    Rows are hashed and sorted by document, so a document is a stretch of its
    partition; ``run(doc, data, vectors)`` gets its columns as arrays, with one
    K-vector per token, and returns a frame. No document is split, and a task
    holds the current one only.
    """
    cells = [F.col(vector)[i].alias(f"_v{i}") for i in range(k)]
    ordered = tokens.select("doc_id", "pos", *columns, *cells).repartition("doc_id").sortWithinPartitions("doc_id", "pos")

    def documents(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [f"_v{i}" for i in range(k)]

        def finish(parts):
            data = pd.concat(parts, ignore_index=True) if len(parts) > 1 else parts[0]
            ids, vectors = data["doc_id"].to_numpy(), data[names].to_numpy(dtype=float)
            starts = np.concatenate(([0], np.flatnonzero(ids[1:] != ids[:-1]) + 1, [len(ids)]))
            arrays = {c: data[c].to_numpy() for c in ["pos", *columns]}
            return pd.concat(
                [run(ids[i], {c: a[i:j] for c, a in arrays.items()}, vectors[i:j]) for i, j in zip(starts, starts[1:])]
            )

        held: list[pd.DataFrame] = []
        for batch in batches:
            if not len(batch):
                continue
            last = batch["doc_id"].iloc[-1]
            cut = len(batch) - int((batch["doc_id"].to_numpy() == last)[::-1].argmin() or len(batch))
            if cut == 0 and (not held or held[-1]["doc_id"].iloc[-1] == last):
                held.append(batch)
                continue
            yield finish(held + [batch.iloc[:cut]] if cut else held)
            held = [batch.iloc[cut:]]
        if held:
            yield finish(held)

    return ordered.mapInPandas(documents, schema)


def _doc_sweep(
    state: DataFrame, k: int, alpha: float, beta: float, v: int, seed: int, sweep: int, hot: HotKeys
) -> DataFrame:
    totals = np.array(topic_totals(state, k).first()["n"], dtype=float)
    words = word_topic_counts(state, k).withColumnRenamed("n", "n_word")
    tokens = hot.join(state, words, by=["doc_id", "pos"])
    tokens = tokens.withColumn("u", uniform(seed, F.col("doc_id"), F.col("pos"), sweep))

    def redraw(doc, data: dict[str, np.ndarray], vectors: np.ndarray) -> pd.DataFrame:
        _, first, row = np.unique(data["word_id"], return_index=True, return_inverse=True)
        by_word = vectors[first] + beta
        by_doc = np.bincount(data["z"], minlength=k) + alpha
        by_topic = totals + v * beta
        weights, running, new = np.empty(k), np.empty(k), []
        for r, old, x in zip(row.tolist(), data["z"].tolist(), data["u"].tolist()):
            word = by_word[r]
            by_doc[old] -= 1
            word[old] -= 1
            by_topic[old] -= 1
            np.divide(np.multiply(by_doc, word, weights), by_topic, weights)
            np.add.accumulate(weights, out=running)
            t = min(int(running.searchsorted(x * running[-1])), k - 1)
            by_doc[t] += 1
            word[t] += 1
            by_topic[t] += 1
            new.append(t)
        return pd.DataFrame({"doc_id": doc, "pos": data["pos"], "word_id": data["word_id"], "z": new})

    schema = f"doc_id {dict(state.dtypes)['doc_id']}, pos int, word_id bigint, z int"
    return _per_document(tokens, "n_word", k, ["word_id", "z", "u"], redraw, schema)


CYCLES = 4  # proposals per token: each cycle one from the word and one from the document


def _alias_draw(k: int, alpha: float, beta: float, v: int, seed: int, sweep: int) -> Draw:
    def draw(block: _Documents, word: np.ndarray, z: np.ndarray, by_word: np.ndarray, totals: np.ndarray) -> np.ndarray:
        own_bits = token_bits(seed, block.keys, block.row, block.pos)
        if not block.repeated:  # in order of document and position
            return alias_pass(block.doc, word, z, by_word, totals, alpha, beta, v, own_bits, sweep)
        order, new = np.lexsort((block.pos, block.doc)), np.empty_like(z)
        new[order] = alias_pass(block.doc[order], word[order], z[order], by_word, totals, alpha, beta, v, own_bits[order], sweep)
        return new

    return draw


def alias_tables(weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per row of positive weights ``share, other``: of a column chosen evenly, keep it with
    ``share``, else take ``other``. All rows are filled side by side, a column per step."""
    n, k = weights.shape
    rest = weights * (k / weights.sum(axis=1, keepdims=True))
    share, other = np.ones((n, k)), np.tile(np.arange(k), (n, 1))
    order = np.argsort(rest >= 1, axis=1, kind="stable")
    few = (rest < 1).sum(axis=1)
    rows = np.flatnonzero((few > 0) & (few < k))
    now, small, large = order[rows, 0], np.ones(len(rows), np.int64), few[rows].copy()
    while len(rows):
        giver = order[rows, large]
        share[rows, now], other[rows, now] = rest[rows, now], giver
        left = rest[rows, giver] - (1 - rest[rows, now])
        rest[rows, giver] = left
        spent = left < 1
        large += spent
        more = small < few[rows]
        now = np.where(spent, giver, order[rows, np.minimum(small, k - 1)])
        small += ~spent
        go = np.where(spent, large < k, more)
        rows, now, small, large = rows[go], now[go], small[go], large[go]
    return share, other


def alias_pass(
    docs: np.ndarray, row: np.ndarray, z: np.ndarray, vectors: np.ndarray, totals: np.ndarray,
    alpha: float, beta: float, v: int, own_bits: np.ndarray, sweep: int, cycles: int = CYCLES,
) -> np.ndarray:
    """New topics of a block's tokens, which are in order of document and position; ``row`` is a token's row of ``vectors``.

    A token's topic is drawn from (its document's current counts + alpha) x (the word's sweep-start counts + beta) / (topic
    totals + v beta), itself left out of all three. Documents are walked side by side, the tokens of one in order; what a
    draw costs does not depend on the number of topics, only the tables of the block's words do.
    """
    k, n = len(totals), len(docs)
    cuts = np.flatnonzero(np.diff(docs)) + 1
    starts = np.concatenate(([0], cuts)) if n else np.empty(0, np.int64)
    lengths = np.diff(np.concatenate((starts, [n])))
    by_length = np.argsort(-lengths, kind="stable")
    starts, lengths = starts[by_length], lengths[by_length]
    doc_row = np.repeat(np.arange(len(starts)), lengths)
    where = np.repeat(starts, lengths) + np.arange(n) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    step = np.arange(n) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    by_doc = np.bincount(doc_row * k + z[where], minlength=len(starts) * k)
    proposal = (vectors + beta) / (totals + v * beta)
    share, other = (table.ravel() for table in alias_tables(proposal))
    proposal, vectors = proposal.ravel(), np.ascontiguousarray(vectors).ravel()
    order = where[np.argsort(step, kind="stable")]  # what is drawn in one step lies together, the longest document first
    ends = np.cumsum(np.bincount(step)) if n else np.empty(0, np.int64)
    begins = np.concatenate(([0], ends[:-1])).astype(np.int64)
    cells, firsts, keys = row[order] * k, z[order], own_bits[order]
    us = np.empty((cycles, 4, n))
    for part in _slices(n, 4):
        for c in range(cycles):
            for j in range(4):
                us[c, j, part] = remix(keys[part], (sweep * cycles + c) * 4 + j)
    new = firsts.copy()
    for i, (begin, end) in enumerate(zip(begins.tolist(), ends.tolist())):
        d = np.arange(end - begin)
        mine, size, w, first = d * k, lengths[: end - begin] - 1, cells[begin:end], firsts[begin:end]
        spare, last = size + k * alpha, np.maximum(size - 1, 0)

        def word_part(t):
            own = t == first
            return (vectors.take(w + t) - own + beta) / (totals.take(t) - own + v * beta)

        now = first
        by_doc[mine + now] -= 1
        of_now = word_part(now)
        for pick, accept, pick_doc, accept_doc in us[:, :, begin:end]:
            spot = pick * k
            column = spot.astype(np.int64)
            at = w + column
            t = np.where(spot - column < share.take(at), column, other.take(at))
            of_t = word_part(t)
            up = (by_doc.take(mine + t) + alpha) * of_t * proposal.take(w + now)
            take = accept * ((by_doc.take(mine + now) + alpha) * of_now * proposal.take(w + t)) < up
            now, of_now = np.where(take, t, now), np.where(take, of_t, of_now)
            spot = pick_doc * spare
            mate = np.minimum(spot.astype(np.int64), last)
            mate = np.minimum(mate + (mate >= i), size)
            t = np.where(spot < size, new.take(begins.take(mate) + d), np.clip((spot - size) / alpha, 0, k - 1).astype(np.int64))
            of_t = word_part(t)
            take = accept_doc * of_now < of_t
            now, of_now = np.where(take, t, now), np.where(take, of_t, of_now)
        by_doc[mine + now] += 1
        new[begin:end] = now
    drawn = z.copy()
    drawn[order] = new
    return drawn


class LdaModel:
    """A trained state with its dictionary. The count tables are written once, on
    first use; the shares and reports are derived from them."""

    def __init__(
        self, state: DataFrame, vocab: DataFrame, k: int, alpha: float, beta: float,
        word_topics: DataFrame | None = None, doc_topics: DataFrame | None = None, blocks: _Blocks | None = None,
    ):
        self.state, self.vocab, self.k, self.alpha, self.beta = state, vocab, k, alpha, beta
        for name, saved in (("_word_topics", word_topics), ("_doc_topics", doc_topics)):
            if saved is not None:
                self.__dict__[name] = saved
        self._blocks = blocks
        self._scratch = Scratch(state.sparkSession, "lda-counts")

    @cached_property
    def _word_topics(self) -> DataFrame:
        return self._scratch.save(self._blocks.word_topics() if self._blocks else word_topic_counts(self.state, self.k), "word_topics")

    @cached_property
    def _doc_topics(self) -> DataFrame:
        return self._scratch.save(self._blocks.doc_topics() if self._blocks else doc_topic_counts(self.state, self.k), "doc_topics")

    def word_pairs(self, scored: bool = False) -> DataFrame | None:
        """``doc_id, word_id, n`` (``scored``: and ``p``) of the training texts, whose tokens stay packed; None for a state of rows."""
        return self._blocks.word_pairs(self.phi() if scored else None) if self._blocks else None

    def word_topics(self) -> DataFrame:
        """``word_id, n array``."""
        return self._word_topics

    def doc_topics(self) -> DataFrame:
        """``doc_id, n array``."""
        return self._doc_topics

    @property
    def in_blocks(self) -> bool:
        """Whether the state is kept in blocks that a run can go on from: after a sweep, not as first dealt."""
        return self._blocks is not None and "word_id" in self._blocks.dealt.columns

    def _sums(self) -> DataFrame:
        if self._blocks and "_word_topics" not in self.__dict__:  # the documents' counts are there without a shuffle
            return self._blocks.documents.agg(_sum_counts("n", self.k).alias("n"))
        return self._word_topics.agg(F.array(*[F.sum(F.col("n")[i]) for i in range(self.k)]).alias("n"))

    @cached_property
    def totals(self) -> list[int]:
        """Tokens per topic: K numbers, the only part the driver holds."""
        return self._sums().first()["n"] or [0] * self.k

    def topics(self) -> DataFrame:
        """``topic, n``."""
        return by_topic(self._sums(), "n")

    def theta(self) -> DataFrame:
        """``doc_id, theta array``: share of each topic in a document, not smoothed."""
        docs = self.doc_topics()
        length = F.aggregate("n", F.lit(0).cast("long"), lambda a, x: a + x)
        return docs.select("doc_id", F.transform("n", lambda x: x / length).alias("theta"))

    def phi(self) -> DataFrame:
        """``word_id, phi array``: share of the word in each topic, not smoothed."""
        share = [F.col("n")[i] / F.lit(float(t)) if t else F.lit(0.0) for i, t in enumerate(self.totals)]
        return self.word_topics().select("word_id", F.array(*share).alias("phi"))

    def top_words(self, n: int) -> DataFrame:
        """``topic, rank, word, n, p``: the n most frequent words of each topic."""
        totals = F.array(*[F.lit(float(t)) for t in self.totals])
        return top_per_topic(by_topic(self.word_topics(), "n").filter("n > 0"), "n", n).join(self.vocab.select("word_id", "word"), "word_id").select(
            "topic", "rank", "word", "n", (F.col("n") / totals[F.col("topic")]).alias("p")
        )

    def report(self, n: int) -> DataFrame:
        """One line per topic: ``n(word)=count`` for its top words."""
        item = F.concat(F.lit("n("), "word", F.lit(")="), F.col("n").cast("string"))
        return (
            self.top_words(n)
            .groupBy("topic")
            .agg(F.array_sort(F.collect_list(F.struct("rank", item.alias("item")))).alias("items"))
            .select("topic", F.array_join(F.col("items.item"), " ").alias("words"))
        )


def top_per_topic(long: DataFrame, value: str, n: int) -> DataFrame:
    """First ``n`` rows per topic by value, then word id. Each input partition
    keeps its own best first, so only a few rows per topic meet in one task."""
    order = [F.col(value).desc(), F.col("word_id")]
    local = Window.partitionBy("topic", "_part").orderBy(*order)
    overall = Window.partitionBy("topic").orderBy(*order)
    parts = int(long.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    return (
        long.withColumn("_part", F.pmod(F.xxhash64("word_id"), F.lit(parts)))
        .withColumn("_r", F.row_number().over(local))
        .filter(F.col("_r") <= n)
        .withColumn("rank", F.row_number().over(overall))
        .filter(F.col("rank") <= n)
        .drop("_part", "_r")
    )


def fit_lda(
    corpus: DataFrame,
    k: int = 10,
    alpha: float = 0.45,
    beta: float = 0.01,
    sweeps: int = 100,
    seed: int = 11,
    mode: str = "sync",
    resume: DataFrame | LdaModel | None = None,
    first_sweep: int = 1,
    keep_every: int = 10,
) -> LdaModel:
    """Train by ``sweeps`` Gibbs sweeps. A sweep's state is a table in the shared
    checkpoint folder; the last one and every ``keep_every``-th stay, and one of
    them, read by ``kept_state``, or a model's ``state`` may be given as ``resume`` to go on from it. A model of the same
    corpus given as ``resume`` goes on from its saved blocks and with its dictionary, no token made a row."""
    if mode not in ("doc", "sync", "alias"):
        raise ValueError("mode is 'doc', 'sync' or 'alias'")
    scratch = Scratch(corpus.sparkSession, "lda")
    if isinstance(resume, LdaModel) and resume.k != k:
        raise ValueError(f"the model has {resume.k} topics, not {k}")
    if isinstance(resume, LdaModel) and (mode == "doc" or not resume.in_blocks):
        resume = resume.state
    if mode != "doc":
        return _fit_blocks(corpus, k, alpha, beta, sweeps, seed, mode, resume, first_sweep, keep_every, scratch)
    vocab = scratch.save(C.vocabulary(corpus), "vocabulary")
    v, hot = vocab.count(), HotKeys(vocab, "word_id")
    state = scratch.save(random_topics(C.encoded_tokens(corpus, vocab), k, seed), "sweep=0") if resume is None else resume
    for sweep in range(first_sweep, first_sweep + sweeps):
        state = scratch.save(_doc_sweep(state, k, alpha, beta, v, seed, sweep, hot), f"sweep={sweep}")
        if sweep > first_sweep and (sweep - 1) % keep_every:
            scratch.drop(f"sweep={sweep - 1}")
    return LdaModel(state, vocab, k, alpha, beta)


def _fit_blocks(
    corpus: DataFrame, k: int, alpha: float, beta: float, sweeps: int, seed: int, mode: str,
    resume: DataFrame | LdaModel | None, first_sweep: int, keep_every: int, scratch: Scratch,
) -> LdaModel:
    if resume is None:
        # a pass of "alias" has as many steps as the block's longest document has words, whatever the number of documents
        vocab, state = _deal(corpus, k, seed, scratch, 1 if mode == "alias" else BLOCKS_PER_CORE)
        v = vocab.count()
    elif isinstance(resume, LdaModel):
        vocab, state = resume.vocab, _paired(resume._blocks.dealt, k, scratch)
        v = vocab.count()
    else:
        vocab = scratch.save(C.vocabulary(corpus), "vocabulary")
        v = vocab.count()
        state = _deal_tokens(resume, k, v, scratch, f"sweep={first_sweep - 1}")
    ranges = _ranges(state) if sweeps > 1 else 1
    kind, last = _sync_draw if mode == "sync" else _alias_draw, first_sweep + sweeps - 1
    for sweep in range(first_sweep, last + 1):
        drawn = _sweep(state, kind(k, alpha, beta, v, seed, sweep), sweep == first_sweep, sweep == last, ranges)
        dealt = scratch.save(drawn, f"sweep={sweep}")
        if sweep > first_sweep and (sweep - 1) % keep_every:
            scratch.drop(f"sweep={sweep - 1}")
        counted = state.counted
        if sweep == last:
            counted = dealt.filter("place is not null").groupBy("word_id").agg(_sum_counts("n", k).alias("n"))
        state = _Blocks(dealt, state.pairs, k, counted)
    return LdaModel(state.tokens(), vocab, k, alpha, beta, blocks=state)


def kept_state(spark: SparkSession, folder: str, sweep: int, k: int) -> DataFrame:
    """``doc_id, pos, word_id, z`` of a sweep that a run of ``k`` topics left in its folder below the checkpoint folder."""
    dealt, pairs = spark.read.parquet(f"{folder}/sweep={sweep}"), spark.read.parquet(f"{folder}/block-words")
    return _Blocks(dealt, pairs, k, pairs).tokens()


def encode_new(corpus: DataFrame, vocab: DataFrame, oov: str = "drop", seed: int = 11) -> DataFrame:
    """``doc_id, pos, word_id`` of new text. Unknown words are dropped, or with
    ``oov="random"`` each replaced by a random known word."""
    hot = HotKeys(C.word_count(corpus), "word")
    if oov == "drop":
        return C.encoded_tokens(corpus, vocab, "inner", hot)
    v = vocab.agg(F.count(F.lit(1)).alias("n")).scalar()
    random_word = F.floor(uniform(seed, F.col("doc_id"), F.col("pos"), -1) * v).cast("long")
    return C.encoded_tokens(corpus, vocab, "left", hot).withColumn("word_id", F.coalesce("word_id", random_word))


def infer_theta(
    corpus: DataFrame,
    model: LdaModel,
    alpha: float | None = None,
    sweeps: int = 50,
    seed: int = 11,
    mode: str = "sync",
    oov: str = "drop",
) -> DataFrame:
    """Smoothed topic shares of new documents with the trained word shares fixed:
    ``doc_id, theta array``. No document needs another one, so all sweeps of a block of
    documents are one task's, and a word's vector goes to a block once."""
    k, a = model.k, model.alpha if alpha is None else alpha
    scratch = Scratch(corpus.sparkSession, "fold-in")
    tokens = random_topics(encode_new(corpus, model.vocab, oov, seed), k, seed)
    if mode == "sync":
        counts = _fold_blocks(scratch.save(tokens, "tokens"), model.phi(), k, a, sweeps, seed)
    else:
        hot = HotKeys(count_by(tokens, "word_id"), "word_id")
        state = scratch.save(hot.join(tokens, model.phi(), by=["doc_id", "pos"]), "sweep=0")
        counts = _fold_documents(state, k, a, sweeps, seed)
    size = F.aggregate("n", F.lit(0.0), lambda acc, x: acc + x)
    return counts.select("doc_id", F.transform("n", lambda x: (x + F.lit(a)) / (size + F.lit(k * a))).alias("theta"))


def _fold_blocks(tokens: DataFrame, phi: DataFrame, k: int, alpha: float, sweeps: int, seed: int) -> DataFrame:
    """All synchronous sweeps over a block's documents; a token's key is hashed once, its draw of a sweep is a ``remix`` of it."""

    def fold(_, own: pa.Table, vectors: pa.Table) -> pa.Table:
        block = _Block(own, vectors)
        own_bits = own.column("bits").to_numpy()
        for sweep in range(1, sweeps + 1):
            u, by_doc, new = remix(own_bits, sweep), block.doc_counts(k), np.empty(len(own_bits), np.int64)
            length = by_doc.sum(axis=1)
            for part in _slices(len(own_bits), k):
                mine = np.zeros((len(u[part]), k))
                mine[np.arange(len(mine)), block.z[part]] = 1.0
                docs = block.docs[part]
                new[part] = _draw(block.vectors[block.row[part]] * (by_doc[docs] - mine + alpha) / (length[docs] - 1 + k * alpha)[:, None], u[part])
            block.z = new
        return pa.table({"doc_id": block.doc.dictionary, "n": pa.array(block.doc_counts(k).astype(np.int64).tolist(), pa.list_(pa.int64()))})

    blocks = blocks_for(tokens, phi.count(), k)
    key = bits(seed, F.col("doc_id"), F.col("pos")).alias("bits")
    rows = tokens.select(block_of(blocks).alias("block"), "doc_id", "word_id", "z", key)
    schema = f"doc_id {dict(tokens.dtypes)['doc_id']}, n array<bigint>"
    return rows.groupBy("block").cogroup(_word_vectors(block_words(tokens, blocks), phi, "phi").groupBy("part")).applyInArrow(fold, schema)


def _fold_documents(state: DataFrame, k: int, alpha: float, sweeps: int, seed: int) -> DataFrame:
    """All sweeps of a document inside one task: with fixed word shares it needs
    nothing from any other document."""

    def fold(doc, data: dict[str, np.ndarray], shares: np.ndarray) -> pd.DataFrame:
        rng = np.random.default_rng(int(data["key"][0]))
        topics = data["z"].tolist()
        counts = np.bincount(topics, minlength=k) + alpha
        weights, running = np.empty(k), np.empty(k)
        for _ in range(sweeps):
            for i, x in enumerate(rng.random(len(topics)).tolist()):
                counts[topics[i]] -= 1
                np.add.accumulate(np.multiply(shares[i], counts, weights), out=running)
                t = topics[i] = min(int(running.searchsorted(x * running[-1])), k - 1)
                counts[t] += 1
        return pd.DataFrame({"doc_id": [doc], "n": [np.bincount(topics, minlength=k).tolist()]})

    schema = f"doc_id {dict(state.dtypes)['doc_id']}, n array<bigint>"
    key = (uniform(seed, F.col("doc_id")) * 2**52).cast("long")
    return _per_document(state.withColumn("key", key), "phi", k, ["z", "key"], fold, schema)
