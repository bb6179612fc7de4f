"""Topics by expectation-maximisation with the topic matrix as rows.

The MAP form of smoothed LDA (Asuncion et al. 2009): expected counts per word and topic and per document and topic,
each a table with one K-vector per row in the end. Document-term rows are packed once, in blocks of whole documents; in a step a
block keeps the vectors of its documents and of words that it alone has, gets those of words that other blocks have as well, adds up
the expected counts of both, and gives back its part of the shared words', which are summed over the blocks. Nothing of the size of the vocabulary is held by the driver or one task;
the driver keeps the K totals. Results depend neither on partitions nor on retries.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.arrays import total
from ..functions.draws import token_uniform
from ..plans.ranges import numbered
from ..plans.scratch import Scratch
from .topics import _blocks, _placed, _slices, block_of, block_texts, block_words, by_topic, top_per_topic

TOKENS_PER_ROW = 2  # of a document-term row, for the size of blocks of texts


@dataclass(frozen=True)
class EmModel:
    """``word_topics(word_id, n array)`` and ``doc_topics(doc_id, n array)``: expected counts; ``totals``: per topic."""

    word_topics: DataFrame
    doc_topics: DataFrame
    totals: list[float]
    k: int
    v: int
    alpha: float
    eta: float

    def topic_sums(self) -> DataFrame:
        """``topic, terms, weight``: words with a weight in the topic, and the sum of their shares."""
        shares = by_topic(self.phi(), "phi").filter("phi > 0")
        return shares.groupBy("topic").agg(F.count(F.lit(1)).alias("terms"), F.sum("phi").alias("weight"))

    def phi(self) -> DataFrame:
        """``word_id, phi array``: share of the word in each topic."""
        share = [F.col("n")[i] / F.lit(t) if t else F.lit(0.0) for i, t in enumerate(self.totals)]
        return self.word_topics.select("word_id", F.array(*share).alias("phi"))

    def theta(self) -> DataFrame:
        """``doc_id, theta array``: smoothed topic shares of the training documents."""
        size, more = total(F.col("n")), F.lit(self.alpha - 1)
        return self.doc_topics.select("doc_id", F.transform("n", lambda x: (x + more) / (size + self.k * more)).alias("theta"))

    def top_terms(self, vocab: DataFrame, n: int) -> DataFrame:
        """``topic, rank, word_id, word, weight``: the n heaviest words of each topic."""
        best = top_per_topic(by_topic(self.phi(), "phi"), "phi", n)
        return best.join(vocab.select("word_id", "word"), "word_id").select("topic", "rank", "word_id", "word", F.col("phi").alias("weight"))


def blocks_for(rows: DataFrame, v: int, k: int) -> int:
    """One block per core, more where they would be large: a step's cost is the words that several blocks have."""
    return _blocks(rows.sparkSession, rows.count(), v, k, 1)


def _vectors(column: pa.ChunkedArray, k: int) -> np.ndarray:
    return pc.list_flatten(column.combine_chunks()).to_numpy(zero_copy_only=False).astype(float).reshape(-1, k)


class _Rows:
    """A block's document-term rows, with the place of each row's word and document among their vectors."""

    def __init__(self, rows: pa.Table, vectors: pa.Table, k: int):
        of_word = vectors.filter(pc.is_valid(vectors.column("word")))
        of_doc = vectors.filter(pc.is_valid(vectors.column("doc")))
        self.words, self.docs = of_word.column("word").combine_chunks(), of_doc.column("doc").combine_chunks()
        self.by_word, self.by_doc = _vectors(of_word.column("vector"), k), _vectors(of_doc.column("vector"), k)
        if not len(self.docs):  # the first pass: documents have no vectors yet
            self.docs = pc.unique(rows.column("doc_id").combine_chunks())
        self.word = pc.index_in(rows.column("word_id").combine_chunks(), value_set=self.words).to_numpy()
        self.doc = pc.index_in(rows.column("doc_id").combine_chunks(), value_set=self.docs).to_numpy()
        self.n = rows.column("n").to_numpy().astype(float)

    def add(self, sums: np.ndarray, at: np.ndarray, values: np.ndarray) -> None:
        for i in range(values.shape[1]):
            sums[:, i] += np.bincount(at, values[:, i], len(sums))


def _list(values: np.ndarray) -> pa.Array:
    k = values.shape[1]
    return pa.ListArray.from_arrays(pa.array(np.arange(0, values.size + 1, k), pa.int32()), pa.array(values.ravel()))


def _packed(values: np.ndarray) -> pa.Array:
    return pa.array([np.ascontiguousarray(values).tobytes()], pa.binary())


def _numbers(column: pa.ChunkedArray, kind: type, k: int = 0) -> np.ndarray:
    found = np.frombuffer(column[0].as_py(), kind)
    return found.reshape(-1, k) if k else found


def _pack(key: tuple, rows: pa.Table) -> pa.Table:
    """A block's document-term rows as one row of numbered documents and words, and a row per word."""
    docs = pc.dictionary_encode(rows.column("doc_id").combine_chunks(), null_encoding="encode")
    words, word = np.unique(rows.column("word_id").to_numpy(), return_inverse=True)
    return _block_rows(key, docs.dictionary, docs.indices.to_numpy(), word, rows.column("n").to_numpy(), {"word": pa.array(words)})


def _block_rows(key: tuple, docs: pa.Array, doc: np.ndarray, word: np.ndarray, n: np.ndarray, words: dict[str, pa.Array]) -> pa.Table:
    whole = pa.table({
        "docs": pa.ListArray.from_arrays(pa.array([0, len(docs)], pa.int32()), docs),
        "doc": _packed(doc.astype(np.int32)), "term": _packed(word.astype(np.int32)), "n": _packed(n.astype(float)),
    })
    both = pa.concat_tables([whole, pa.table(words)], promote_options="default")
    return both.append_column("block", pa.array(np.full(both.num_rows, key[0].as_py(), np.int32))).select(["block", *words, *whole.column_names])


BLOCK = "block int, {words}, docs array<{kind}>, doc binary, term binary, n binary"


def _count(key: tuple, rows: pa.Table) -> pa.Table:
    """The texts of a block as ``_pack`` gives its document-term rows; a word's row has its text and number of tokens."""
    texts, word, lengths = _placed(rows)
    docs = pc.dictionary_encode(rows.column("doc_id").combine_chunks(), null_encoding="encode")
    at = np.repeat(docs.indices.to_numpy().astype(np.int64), lengths)
    found, n = np.unique(at * len(texts) + word, return_counts=True)
    sizes = pa.array(np.bincount(word, minlength=len(texts)).astype(np.int64))
    return _block_rows(key, docs.dictionary, found // len(texts), found % len(texts), n, {"text": texts, "tokens": sizes})


class _Packed:
    """A block with the vectors of its words and documents after the last step, and those of words that others have as well."""

    def __init__(self, rows: pa.Table, vectors: pa.Table, k: int, seed: int):
        self.docs = rows.column("docs").combine_chunks().flatten()
        self.doc, self.word = _numbers(rows.column("doc"), np.int32), _numbers(rows.column("term"), np.int32)
        self.n = _numbers(rows.column("n"), float)
        given = vectors.filter(pc.is_valid(vectors.column("word")))
        kept = vectors.filter(pc.is_null(vectors.column("word")))
        if not kept.num_rows:  # the first pass: all words of the block are given, and their start is drawn
            given = given.sort_by("word")
            self.words, self.by_doc = given.column("word").to_numpy(), None
            self.shared = np.flatnonzero(given.column("shared").to_numpy())
            one, of = [None], np.zeros(len(self.words), np.int64)
            self.by_word = np.stack([token_uniform(seed, one, of, self.words, i) for i in range(k)], axis=1)
            return
        self.words = _numbers(kept.column("words"), np.int64)
        self.by_word, self.by_doc = _numbers(kept.column("by_word"), float, k).copy(), _numbers(kept.column("by_doc"), float, k)
        self.shared = np.searchsorted(self.words, given.column("word").to_numpy())
        if given.num_rows:
            self.by_word[self.shared] = _vectors(given.column("vector"), k)

    def add(self, sums: np.ndarray, at: np.ndarray, values: np.ndarray) -> None:
        for i in range(values.shape[1]):
            sums[:, i] += np.bincount(at, values[:, i], len(sums))


STEP = "block int, word bigint, doc {kind}, vector array<double>, words binary, by_word binary, by_doc binary, total array<double>"


def _expected(k: int, seed: int, weights, last: bool):
    """Expected counts of a block's documents and words; ``weights(block, slice)`` gives each row's topic weights. One row keeps them
    for the next step; rows per word are given for words that others have as well, in the last step for all words and documents."""
    names = [c.split()[0] for c in STEP.split(", ")]

    def expected(key: tuple, rows: pa.Table, vectors: pa.Table) -> pa.Table:
        block = _Packed(rows, vectors, k, seed)
        by_doc, by_word = np.zeros((len(block.docs), k)), np.zeros((len(block.words), k))
        for part in _slices(len(block.n), k):
            w = weights(block, part)
            share = w / w.sum(axis=1, keepdims=True) * block.n[part, None]
            block.add(by_doc, block.doc[part], share)
            block.add(by_word, block.word[part], share)
        told = np.arange(len(block.words)) if last else block.shared
        whole = {"total": _list(by_word.sum(axis=0)[None])}
        if not last:
            whole |= {"words": _packed(block.words), "by_word": _packed(by_word), "by_doc": _packed(by_doc)}
        tables = [pa.table(whole), pa.table({"word": pa.array(block.words[told]), "vector": _list(by_word[told])})]
        tables.append(pa.table({"doc": block.docs[: len(block.docs) if last else 0], "vector": _list(by_doc if last else by_doc[:0])}))
        both = pa.concat_tables(tables, promote_options="default")
        for name in set(names) - {*both.column_names, "block"}:
            both = both.append_column(name, pa.nulls(both.num_rows, pa.binary()))
        return both.append_column("block", pa.array(np.full(both.num_rows, key[0].as_py(), np.int32))).select(names)

    return expected


def fit_em(doc_terms: DataFrame, k: int, iterations: int, alpha: float | None = None, eta: float = 1.1, seed: int = 11) -> EmModel:
    """Train on ``doc_id, word_id, n`` for a number of steps. ``alpha`` (default ``50 / k + 1``) and ``eta`` are above 1.

    The start deals each word's occurrences over the topics in shares drawn for the word.
    """
    scratch = Scratch(doc_terms.sparkSession, "em")
    kind = dict(doc_terms.dtypes)["doc_id"]
    rows = scratch.save(doc_terms.select("doc_id", F.col("word_id").cast("long"), "n"), "rows")
    v = rows.select("word_id").distinct().count()
    dealt = rows.withColumn("block", block_of(blocks_for(rows, v, k))).groupBy("block").applyInArrow(_pack, BLOCK.format(words="word bigint", kind=kind))
    dealt = scratch.save(dealt, "blocks")
    pairs = dealt.filter("word is not null").select(F.col("block").alias("part"), "word")
    several = pairs.groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("word")
    shared = scratch.save(pairs.join(several, "word"), "block-words").withColumn("shared", F.lit(True))
    pairs = pairs.join(shared, ["part", "word"], "left").withColumn("shared", F.coalesce("shared", F.lit(False)))
    return _steps(scratch, dealt.filter("word is null").drop("word"), pairs, kind, k, v, iterations, alpha, eta, seed)


def fit_em_corpus(corpus: DataFrame, k: int, iterations: int, alpha: float | None = None, eta: float = 1.1, seed: int = 11) -> tuple[DataFrame, EmModel]:
    """``fit_em`` of the document-term counts of a corpus, and its dictionary (``word_id, word, n``, as ``vocabulary`` gives it).

    Blocks of whole texts are counted by a task each, so neither tokens nor document-term rows are rows of an aggregate or a join; only the
    distinct words of a block are, once, to be numbered.
    """
    scratch = Scratch(corpus.sparkSession, "em")
    kind = dict(corpus.dtypes)["doc_id"]
    n = corpus.agg(F.sum(F.size("words"))).first()[0] or 0
    texts = block_texts(corpus, _blocks(corpus.sparkSession, n // TOKENS_PER_ROW, n, k, 1))
    dealt = scratch.save(texts.groupBy("block").applyInArrow(_count, BLOCK.format(words="text string, tokens bigint", kind=kind)), "blocks")
    found = dealt.filter("text is not null").select(F.col("block").alias("part"), F.col("text").alias("word"), "tokens")
    indexed = numbered(found, "word", "word_id", {"n": F.sum("tokens"), "blocks": F.count(F.lit(1))})
    vocab = scratch.save(indexed.filter("first").select("word_id", "word", "n"), "vocabulary")
    pairs = indexed.select("part", F.col("word_id").alias("word"), (F.col("blocks") > 1).alias("shared"))
    blocks = dealt.filter("text is null").drop("text", "tokens")
    return vocab, _steps(scratch, blocks, pairs, kind, k, vocab.count(), iterations, alpha, eta, seed)


def _steps(
    scratch: Scratch, blocks: DataFrame, pairs: DataFrame, kind: str, k: int, v: int, iterations: int, alpha: float | None, eta: float, seed: int
) -> EmModel:
    """The steps over packed ``blocks``; ``pairs`` (``part, word, shared``) has the words of each block, and which of them others have as well."""
    alpha = 50.0 / k + 1 if alpha is None else alpha
    nothing = {"words": "binary", "by_word": "binary", "by_doc": "binary", "vector": "array<double>", "shared": "boolean", "word": "long"}
    columns = ["part", "word", "shared", "vector", "words", "by_word", "by_doc"]

    def whole_row(df: DataFrame) -> DataFrame:
        # no null arrays: to size its batches Spark walks the nulls of a list column again for every row
        empty = {c: F.array() if c == "vector" else F.lit(None) for c in nothing}
        return df.select(*[c if c in df.columns else empty[c].cast(nothing[c]).alias(c) for c in columns])

    vectors = whole_row(pairs)
    totals: list[float] = []
    sums = [F.sum(F.col("vector")[i]) for i in range(k)]
    same = Window.partitionBy("word")

    def start(block: _Packed, part: slice) -> np.ndarray:
        return block.by_word[block.word[part]]

    for step in range(iterations + 1):
        last = step == iterations
        if step:
            below = np.array(totals) + v * (eta - 1)

            def weights(block: _Packed, part: slice, below=below) -> np.ndarray:
                return (block.by_word[block.word[part]] + (eta - 1)) * (block.by_doc[block.doc[part]] + (alpha - 1)) / below

        else:
            weights = start
        found = blocks.groupBy("block").cogroup(vectors.groupBy("part")).applyInArrow(_expected(k, seed, weights, last), STEP.format(kind=kind))
        found = scratch.save(found, f"step-{step}")
        whole = found.filter("total is not null")
        totals = whole.agg(F.array(*[F.sum(F.col("total")[i]) for i in range(k)]).alias("n")).first()["n"]
        totals = [t or 0.0 for t in totals]
        if not last:
            told = found.filter("word is not null").select(F.col("block").alias("part"), "word", F.array(*[s.over(same) for s in sums]).alias("vector"))
            vectors = whole_row(told).unionByName(whole_row(whole.select(F.col("block").alias("part"), "words", "by_word", "by_doc")))
        if step:
            scratch.drop(f"step-{step - 1}")
    words = found.filter("word is not null").groupBy("word").agg(F.array(*sums).alias("n"))
    words = scratch.save(words.withColumnRenamed("word", "word_id"), "words")
    docs = found.filter("word is null and total is null").select(F.col("doc").alias("doc_id"), F.col("vector").alias("n"))
    return EmModel(words, docs, totals, k, v, alpha, eta)


def infer_em(doc_terms: DataFrame, model: EmModel, iterations: int = 20) -> DataFrame:
    """``doc_id, theta array`` of new documents (``doc_id, word_id, n`` in the model's words) with the words' shares fixed.
    All steps of a block of documents are one task's, which gets the shares of the block's words only."""
    k, more = model.k, model.alpha - 1
    smooth = [(F.col("n")[i] + (model.eta - 1)) / F.lit(t + model.v * (model.eta - 1)) for i, t in enumerate(model.totals)]
    shares = model.word_topics.select(F.col("word_id").alias("word"), F.array(*smooth).alias("vector"))
    rows = Scratch(doc_terms.sparkSession, "em-new").save(doc_terms.select("doc_id", F.col("word_id").cast("long"), "n"), "rows")
    kind = dict(rows.dtypes)["doc_id"]
    blocks = blocks_for(rows, model.v, k)

    def settle(_, own: pa.Table, vectors: pa.Table) -> pa.Table:
        block = _Rows(own, vectors, k)
        size = np.bincount(block.doc, block.n, len(block.docs))
        by_doc = np.repeat(size[:, None] / k, k, axis=1)
        for _ in range(iterations):
            new = np.zeros_like(by_doc)
            for part in _slices(len(block.n), k):
                w = block.by_word[block.word[part]] * (by_doc[block.doc[part]] + more)
                block.add(new, block.doc[part], w / w.sum(axis=1, keepdims=True) * block.n[part, None])
            by_doc = new
        return pa.table({"doc_id": block.docs, "theta": _list((by_doc + more) / (size + k * more)[:, None])})

    no_doc = F.lit(None).cast(kind).alias("doc")
    vectors = block_words(rows, blocks).join(shares, "word").select("part", no_doc, "word", "vector")
    return rows.groupBy(block_of(blocks).alias("block")).cogroup(vectors.groupBy("part")).applyInArrow(settle, f"doc_id {kind}, theta array<double>")
