"""Query expansion and user relevance from a topic model.

Topic vectors are ``array<double>`` columns of length K; per-topic constants
come in as one-row scalar subqueries, so no join is spent on them.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.arrays import dot, total, zeros
from ..plans.scratch import Scratch
from ..plans.skew import HotKeys, count_by
from . import corpus as C
from .topics import LdaModel, by_topic


def topic_prior(topics: DataFrame) -> DataFrame:
    """``topic, n, p``: share of all tokens per topic."""
    everything = topics.agg(F.sum("n").alias("n")).scalar()
    return topics.select("topic", "n", (F.col("n") / everything).alias("p"))


def word_probability(vocab: DataFrame, counts: DataFrame) -> DataFrame:
    """``word_id, word, p``: corpus share per dictionary word, 0 when absent."""
    everything = counts.agg(F.sum("n").alias("n")).scalar()
    return (
        vocab.select("word_id", "word")
        .join(counts.select("word", "n"), "word", "left")
        .select("word_id", "word", F.coalesce(F.col("n") / everything, F.lit(0.0)).alias("p"))
    )


def own_probability(vocab: DataFrame) -> DataFrame:
    """``word_id, word, p``: share of a dictionary's own counts ``n``; no join, as the count is on the row."""
    everything = vocab.agg(F.sum("n").alias("n")).scalar()
    return vocab.select("word_id", "word", (F.col("n") / everything).alias("p"))


def word_topic_lift(phi: DataFrame, topics: DataFrame, words: DataFrame, posterior: bool = False) -> DataFrame:
    """``word_id, word, lift array``: ``phi / p(z) / p(w)`` per topic, or with
    ``posterior`` ``phi * p(z) / p(w)``. Words of probability 0 are left out."""
    prior = topic_prior(topics).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("topic", "p"))), lambda t: t["p"]).alias("p")
    ).scalar()
    per_topic = F.zip_with("phi", "prior", lambda x, z: (x * z if posterior else x / z) / F.col("p"))
    joined = phi.join(words.filter("p > 0"), "word_id").withColumn("prior", prior)
    return joined.select("word_id", "word", per_topic.alias("lift"))


def expansion_scores(lift: DataFrame) -> DataFrame:
    """``word_id, word, score``: lift summed over the topics."""
    return lift.select("word_id", "word", total(F.col("lift")).alias("score"))


def ranked(scores: DataFrame) -> DataFrame:
    return scores.orderBy(F.col("score").desc(), "word")


def query_words(scores: DataFrame, n: int) -> DataFrame:
    """The ``n`` best words, the smaller word first on a tie."""
    return ranked(scores).limit(n).select("word_id", "word")


def word_similarity(vectors: DataFrame, seeds: DataFrame, n: int, value: str = "phi") -> DataFrame:
    """``seed_id, word_id, similarity``: per seed word the ``n`` words of largest
    cosine between topic vectors, rounded to 12 places so that equal vectors tie
    whatever the order of summation; the smaller id comes first. Values may have either sign; words whose cosine is not above 0 are left out.

    Few seeds (by the size of their vectors) go along with every word's row, which then
    needs no shuffle before the best rows per seed. Else words and seeds meet per topic; a
    topic holds most of the vocabulary, so it is split into pieces by word and the seed rows
    are copied to every piece.
    """
    few = vectors.join(seeds.select("word_id"), "word_id").select("word_id", value).limit(MOST_SEEDS + 1).collect()
    if len(few) <= MOST_SEEDS and sum(len(r[value]) for r in few) <= MOST_SEED_VALUES:
        products = _similar_to_few(vectors, few, value)
    else:
        products = _similar_to_many(vectors, seeds, value)
    best = F.struct((-F.col("similarity")).alias("s"), F.col("word_id"))
    return _smallest(products, "seed_id", best, n).select(
        "seed_id", "b.word_id", (-F.col("b.s")).alias("similarity")
    )


MOST_SEEDS, MOST_SEED_VALUES = 100, 10_000


def _similar_to_few(vectors: DataFrame, few: list, value: str) -> DataFrame:
    items = [
        F.struct(F.lit(r["word_id"]).cast("long").alias("id"), F.array(*map(F.lit, r[value])).alias("v"), F.lit(math.hypot(*r[value])).alias("norm"))
        for r in few
    ]
    if not items:
        return vectors.limit(0).select(F.col("word_id").alias("seed_id"), "word_id", F.lit(0.0).alias("similarity"))
    k = len(few[0][value])
    length = F.sqrt(dot(F.col(value), F.col(value), k))
    rows = vectors.select("word_id", value, length.alias("norm"), F.explode(F.array(*items)).alias("seed")).filter("word_id <> seed.id")
    cosine = F.round(dot(F.col(value), F.col("seed.v"), k) / (F.col("norm") * F.col("seed.norm")), 12)
    return rows.select(F.col("seed.id").alias("seed_id"), "word_id", cosine.alias("similarity")).filter("similarity > 0")


def _similar_to_many(vectors: DataFrame, seeds: DataFrame, value: str) -> DataFrame:
    length = F.sqrt(F.aggregate(value, F.lit(0.0), lambda a, x: a + x * x))
    long = by_topic(vectors.select("word_id", value, length.alias("norm")), value).filter(F.col(value) != 0)
    seed = long.join(seeds.select("word_id"), "word_id").select(
        F.col("word_id").alias("seed_id"), "topic", F.col("norm").alias("_norm"), F.col(value).alias("_v")
    )
    part = F.col(value) * F.col("_v")
    return (
        HotKeys(count_by(long, "topic"), "topic")
        .join(long, seed, by=["word_id"])
        .filter("word_id <> seed_id")
        .groupBy("seed_id", "word_id")
        .agg(F.round(F.sum(part) / (F.first("norm") * F.first("_norm")), 12).alias("similarity"))
        .filter("similarity > 0")
    )


def _smallest(df: DataFrame, key: str, item: Column, n: int) -> DataFrame:
    """The ``n`` smallest structs per key, cut down per piece before they meet."""
    pieces = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    staged = df.select(key, item.alias("b")).withColumn("_piece", F.pmod(F.xxhash64("b"), F.lit(pieces)))
    for keys in ((key, "_piece"), (key,)):
        staged = staged.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy("b"))).filter(
            F.col("_r") <= n
        )
    return staged


def query_topic_likelihood(
    model: LdaModel,
    corpus: DataFrame,
    query: DataFrame,
    lam: float = 0.3,
    theta: float = 0.4,
    combine: str = "sum",
) -> DataFrame:
    """``topic, likelihood`` of a query set.

    The query set is written first, since four tables are joined to it. Per word ``theta*(lam*n_kw/n_w + (1-lam)*df_w/D) + (1-theta)*phi_kw``, then
    the sum over the words (``combine="logsum"``: the sum of logarithms).
    """
    docs = corpus.agg(F.count(F.lit(1)).alias("n")).scalar()
    words = Scratch(query.sparkSession, "query").save(query.select("word_id", "word"), "words")
    counts = words.join(model.word_topics(), "word_id", "left").join(model.phi(), "word_id", "left")
    frequency = C.document_frequency(corpus).join(words.select("word"), "word", "left_semi")
    n_w = F.aggregate("n", F.lit(0).cast("long"), lambda a, x: a + x)
    background = F.coalesce(F.col("df"), F.lit(0)) / F.col("docs")
    none = zeros(model.k)
    trained = F.coalesce(F.when(n_w > 0, F.transform("n", lambda x: x / n_w)), none)
    smoothed = F.zip_with(
        trained,
        F.coalesce("phi", none),
        lambda ml, p: F.lit(theta) * (F.lit(lam) * ml + F.lit(1 - lam) * background) + F.lit(1 - theta) * p,
    )
    rows = counts.join(frequency, "word", "left").withColumn("docs", docs)
    mixed = by_topic(rows.select("word_id", smoothed.alias("p")), "p")
    fold = F.sum("p") if combine == "sum" else F.sum(F.log("p"))
    return mixed.groupBy("topic").agg(fold.alias("likelihood"))


def user_topic_relevance(theta: DataFrame, corpus: DataFrame, likelihood: DataFrame, k: int) -> DataFrame:
    """``user_id, docs, relevance array, total``: per topic the mean over a user's
    documents of ``theta * likelihood``; ``total`` is the sum over documents and
    topics. Partial sums per user form before the shuffle, however many
    documents one user has."""
    per_topic = likelihood.agg(
        F.transform(F.array_sort(F.collect_list(F.struct("topic", "likelihood"))), lambda t: t["likelihood"]).alias("l")
    ).scalar()
    rows = theta.withColumn("likelihood", per_topic)
    weighted = rows.select("doc_id", F.zip_with("theta", "likelihood", lambda t, q: t * q).alias("w"))
    sums = (
        weighted.join(corpus.select("doc_id", "user_id"), "doc_id")
        .groupBy("user_id")
        .agg(F.count(F.lit(1)).alias("docs"), F.array(*[F.sum(F.col("w")[i]) for i in range(k)]).alias("s"))
    )
    return sums.select(
        "user_id", "docs",
        F.transform("s", lambda x: x / F.col("docs")).alias("relevance"),
        total(F.col("s")).alias("total"),
    )


def scaled(relevance: DataFrame) -> DataFrame:
    """``user_id, scaled array, score``: each value times 10000 modulo 10000 and
    the sum over the topics."""
    values = F.transform("relevance", lambda x: (x * 10000) % 10000)
    return relevance.select("user_id", values.alias("scaled")).withColumn("score", total(F.col("scaled")))


def attach_relevance(users: DataFrame, relevance: DataFrame, score: str = "score") -> DataFrame:
    """User table with its relevance, 0.0 for users without one."""
    return users.join(relevance.select("user_id", score), "user_id", "left").na.fill(0.0, [score])


def relevant_users(users: DataFrame, score: str = "score") -> DataFrame:
    return users.filter(F.col(score) != 0)
