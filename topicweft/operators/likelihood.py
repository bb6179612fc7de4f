"""Token likelihood and perplexity of a corpus under a topic model."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import dot
from ..plans.skew import HotKeys, count_by
from .topics import LdaModel, by_topic

UNKNOWN = -1


def word_pairs(tokens: DataFrame) -> DataFrame:
    """``doc_id, word_id, n`` from encoded tokens; unknown words get id -1."""
    known = tokens.select("doc_id", F.coalesce("word_id", F.lit(UNKNOWN)).alias("word_id"))
    return known.groupBy("doc_id", "word_id").agg(F.count(F.lit(1)).alias("n"))


def token_likelihood(
    pairs: DataFrame, theta: DataFrame, phi: DataFrame, k: int, hot: HotKeys | None = None
) -> DataFrame:
    """``doc_id, word_id, n, p`` with ``p = sum over topics theta * phi``; 0 for
    words or documents the model does not know.

    Driven by the (document, word) pairs that occur; documents times words is
    never formed. Frequent words (``hot``, by default counted from the pairs) are
    split over several tasks.
    """
    hot = hot or HotKeys(count_by(pairs, "word_id"), "word_id")
    joined = hot.join(pairs, phi, by=["doc_id"], how="left").join(theta, "doc_id", "left")
    return joined.select(
        "doc_id", "word_id", "n", F.coalesce(dot(F.col("theta"), F.col("phi"), k), F.lit(0.0)).alias("p")
    )


def trained_pairs(model: LdaModel) -> DataFrame:
    """``word_pairs`` of the model's training texts, counted in its blocks where it has them."""
    pairs = model.word_pairs()
    return word_pairs(model.state) if pairs is None else pairs


def trained_likelihood(model: LdaModel) -> DataFrame:
    """``token_likelihood`` of the model's training texts. A block of documents gets its words' shares once, so neither tokens nor
    pairs are rows of a join."""
    rows = model.word_pairs(scored=True)
    if rows is None:
        rows = token_likelihood(word_pairs(model.state), model.theta(), model.phi(), model.k, HotKeys(model.vocab, "word_id"))
    return rows


def document_likelihood(likelihood: DataFrame) -> DataFrame:
    """``doc_id, mass, n``: summed likelihood and token count per document."""
    return likelihood.groupBy("doc_id").agg(F.sum(F.col("n") * F.col("p")).alias("mass"), F.sum("n").alias("n"))


def mean_likelihood(likelihood: DataFrame, corpus: DataFrame) -> DataFrame:
    """One row: total token likelihood over the number of documents."""
    docs = corpus.agg(F.count(F.lit(1)).alias("n")).scalar()
    found = likelihood.filter("p <> 0")
    return found.agg(F.abs(F.sum(F.col("n") * F.col("p")) / docs).alias("mean_likelihood"))


def perplexity(likelihood: DataFrame) -> DataFrame:
    """One row: ``exp(-sum log p / N)`` over tokens of positive likelihood."""
    found = likelihood.filter("p > 0")
    tokens = F.sum("n")
    return found.agg(
        tokens.alias("n_tokens"), F.exp(-F.sum(F.col("n") * F.log("p")) / tokens).alias("perplexity")
    )


def sparse_theta(theta: DataFrame, above: float) -> DataFrame:
    """``doc_id, topic, p`` with ``p > above``."""
    return by_topic(theta.withColumnRenamed("theta", "p"), "p").filter(F.col("p") > above)


def sparse_phi(phi: DataFrame) -> DataFrame:
    """``word_id, topic, p`` with ``p > 0``."""
    return by_topic(phi.withColumnRenamed("phi", "p"), "p").filter("p > 0")


def link_topics(pairs: DataFrame, topics_of_docs: DataFrame, at_least: float) -> DataFrame:
    """``word_id, topic, p, n``: tokens linked to their document's topics, shares
    rounded to two places and kept from ``at_least`` on; the document is dropped
    and equal rows are counted in ``n``."""
    linked = pairs.join(topics_of_docs, "doc_id", "left")
    unlinked = [F.coalesce("topic", F.lit(-1)).alias("topic"), F.round(F.coalesce("p", F.lit(0.0)), 2).alias("p")]
    return (
        linked.select("word_id", *unlinked, "n")
        .filter(F.col("p") >= at_least)
        .groupBy("word_id", "topic", "p")
        .agg(F.sum("n").alias("n"))
    )


def word_mass(links: DataFrame, topics_of_words: DataFrame) -> DataFrame:
    """``word_id, mass``: sum over a word's links of share times word share."""
    shares = topics_of_words.select("word_id", "topic", F.col("p").alias("phi"))
    return (
        links.join(shares, ["word_id", "topic"], "left")
        .groupBy("word_id")
        .agg(F.sum(F.col("n") * F.col("p") * F.coalesce("phi", F.lit(0.0))).alias("mass"))
    )


def total_mass(masses: DataFrame) -> DataFrame:
    return masses.agg(F.sum("mass").alias("mass"))
