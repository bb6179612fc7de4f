"""Corpora, words, vocabulary and document-term counts.

A corpus has columns ``user_id string, doc_id, words array<string>``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.draws import uniform
from ..functions.text import WHITESPACE, words
from ..plans.ranges import dense_index
from ..plans.scratch import Scratch
from ..plans.skew import HotKeys, count_by


def corpus(table: DataFrame, doc: str, text: str, user: str | None = None, pattern: str = WHITESPACE) -> DataFrame:
    """A table with a text column as a corpus."""
    user_id = F.col(user).cast("string") if user else F.lit(None).cast("string")
    return table.select(user_id.alias("user_id"), F.col(doc).alias("doc_id"), words(F.col(text), pattern).alias("words"))


def tokens(corpus: DataFrame) -> DataFrame:
    """One row per token: ``doc_id, pos, word``."""
    return corpus.select("doc_id", F.posexplode("words").alias("pos", "word"))


def word_count(corpus: DataFrame) -> DataFrame:
    return count_by(corpus.select(F.explode("words").alias("word")), "word")


def document_frequency(corpus: DataFrame) -> DataFrame:
    """Number of documents that contain each word."""
    return (
        corpus.select(F.explode(F.array_distinct("words")).alias("word"))
        .groupBy("word")
        .agg(F.count(F.lit(1)).alias("df"))
    )


def token_total(corpus: DataFrame) -> DataFrame:
    return corpus.agg(F.sum(F.size("words")).cast("long").alias("n_tokens"))


def vocabulary(corpus: DataFrame) -> DataFrame:
    """``word_id, word, n``: distinct words numbered 0..V-1 in ascending order,
    with their number of tokens. The counts are written once, so the text is
    read once."""
    counts = Scratch(corpus.sparkSession, "words").save(word_count(corpus), "counts")
    return dense_index(counts, "word", "word_id").select("word_id", "word", "n")


def encoded_tokens(corpus: DataFrame, vocab: DataFrame, how: str = "inner", hot: HotKeys | None = None) -> DataFrame:
    """``doc_id, pos, word_id``: tokens looked up in the dictionary. ``how="left"``
    keeps unknown words with a null id. Very frequent words are split over tasks;
    ``hot`` says which, by default from the dictionary's own counts."""
    hot = hot or HotKeys(vocab, "word")
    out = hot.join(tokens(corpus), vocab.select("word", "word_id"), by=["doc_id", "pos"], how=how)
    return out.select("doc_id", "pos", "word_id")


def doc_term_matrix(corpus: DataFrame, vocab: DataFrame) -> DataFrame:
    """``doc_id, word_id, n`` with ``n > 0``; counted per document before the
    dictionary join."""
    counts = tokens(corpus).groupBy("doc_id", "word").agg(F.count(F.lit(1)).alias("count"))
    hot = HotKeys(vocab, "word")
    joined = hot.join(counts, vocab.select("word", "word_id"), by=["doc_id"])
    return joined.select("doc_id", "word_id", F.col("count").alias("n"))


def sample_rows(df: DataFrame, rate: float, seed: int = 11) -> DataFrame:
    """Bernoulli sample without replacement."""
    return df.sample(withReplacement=False, fraction=rate, seed=seed)


def sample_by_key(df: DataFrame, key: str, rate: float, seed: int = 11) -> DataFrame:
    """Bernoulli sample whose choice depends on the key only."""
    return df.filter(uniform(seed, F.col(key)) < rate)
