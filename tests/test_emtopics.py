"""Expectation-maximisation with the topic matrix as rows, against dense numpy."""

from __future__ import annotations

import hashlib

import numpy as np
import pytest

from topicweft.operators import emtopics as X
from topicweft.operators import topics as T


def counts(docs=17, words=23, seed=1):
    rng = np.random.default_rng(seed)
    return rng.poisson(0.7, (docs, words))


def frame(spark, n, name):
    rows = [(name(d), int(w), int(n[d, w])) for d, w in zip(*np.nonzero(n))]
    kind = "string" if isinstance(rows[0][0], str) else "bigint"
    return spark.createDataFrame(rows, f"doc_id {kind}, word_id bigint, n bigint")


def draw(word, i):
    return int(hashlib.md5(f"11:{word}:{i}".encode()).hexdigest()[:13], 16) / 2**52


def dense(n, k, steps, alpha, eta):
    share = np.array([[draw(w, i) for i in range(k)] for w in range(n.shape[1])])
    gamma = np.repeat((share / share.sum(axis=1, keepdims=True))[None], n.shape[0], axis=0)
    for step in range(steps + 1):
        if step:
            gamma = (words + eta - 1)[None] * (docs + alpha - 1)[:, None] / (words.sum(axis=0) + (n.sum(axis=0) > 0).sum() * (eta - 1))  # noqa: F821
            gamma /= gamma.sum(axis=2, keepdims=True)
        weighted = gamma * n[:, :, None]
        words, docs = weighted.sum(axis=0), weighted.sum(axis=1)
    return words, docs


@pytest.mark.parametrize("blocks", [1, 6])
@pytest.mark.parametrize("name", [int, "doc{}".format])
def test_steps_equal_dense_ones(spark, monkeypatch, blocks, name):
    monkeypatch.setattr(X, "blocks_for", lambda rows, v, k: blocks)
    n = counts()
    model = X.fit_em(frame(spark, n, name), k=4, iterations=3, eta=1.2)
    words, docs = dense(n, 4, 3, 50 / 4 + 1, 1.2)
    for r in model.word_topics.collect():
        assert r.n == pytest.approx(words[r.word_id])
    got = {r.doc_id: r.theta for r in model.theta().collect()}
    more = 50 / 4
    for d in range(len(n)):
        assert got[name(d)] == pytest.approx((docs[d] + more) / (docs[d].sum() + 4 * more))
    assert {r.topic: round(r.weight, 9) for r in model.topic_sums().collect()} == dict.fromkeys(range(4), 1.0)


def test_words_of_two_themes_part(spark):
    n = np.zeros((40, 20), int)
    n[:20, :10] = 3
    n[20:, 10:] = 3
    model = X.fit_em(frame(spark, n, int), k=2, iterations=12, alpha=1.1)
    best = {r.word_id: int(np.argmax(r.n)) for r in model.word_topics.collect()}
    assert len({best[w] for w in range(10)}) == 1 and len({best[w] for w in range(10, 20)}) == 1 and best[0] != best[10]
    new = spark.createDataFrame([(1, 3, 5), (2, 15, 5)], "doc_id bigint, word_id bigint, n bigint")
    theta = {r.doc_id: r.theta for r in X.infer_em(new, model).collect()}
    assert theta[1][best[3]] > 0.9 and theta[2][best[15]] > 0.9


def test_only_shared_words_pass_between_blocks(spark, monkeypatch):
    """Five documents in a block each: words of one document stay with it, and the rows are computed once."""
    from pyspark.sql import functions as F

    monkeypatch.setattr(X, "blocks_for", lambda rows, v, k: 64)
    tables, saved = {}, X.Scratch.save

    def kept(self, df, name):
        out = saved(self, df, name)
        if name.startswith(("block-words", "step-1")):
            tables[name] = [r.word for r in out.select("word").collect() if r.word is not None]
        return out

    monkeypatch.setattr(X.Scratch, "save", kept)
    read = spark.sparkContext.accumulator(0)
    n = np.zeros((5, 21), int)
    for d in range(5):
        n[d, [20, *range(4 * d, 4 * d + 4)]] = 1 + d
    rows = frame(spark, n, int)
    count = F.udf(lambda x: read.add(1) or x, "bigint").asNondeterministic()
    model = X.fit_em(rows.withColumn("n", count("n")), k=2, iterations=2)
    assert read.value == 25
    assert set(tables["block-words"]) == set(tables["step-1"]) == {20}
    words, _ = dense(n, 2, 2, 26.0, 1.1)
    assert {r.word_id: r.n for r in model.word_topics.collect()} == {w: pytest.approx(words[w]) for w in range(21)}


@pytest.mark.parametrize("blocks", [1, 5])
def test_a_corpus_trains_as_its_document_term_rows(spark, monkeypatch, blocks):
    """Same dictionary and model, but a table row per block and word in place of one per document and word."""
    from topicweft.operators import corpus as C

    texts = [(d, " ".join(f"w{(d * i) % 7}" for i in range(12)) if d % 4 else None) for d in range(1, 40)] + [(None, "w1 w1 \u00e9"), (3, "w2 x")]
    docs = C.corpus(spark.createDataFrame(texts, "id bigint, text string"), "id", "text")
    monkeypatch.setattr(X, "_blocks", lambda *_: blocks)
    vocab = C.vocabulary(docs)
    want = X.fit_em(C.doc_term_matrix(docs, vocab), k=3, iterations=2)
    tables, saved = {}, X.Scratch.save

    def kept(self, df, name):
        out = tables[name] = saved(self, df, name)
        return out

    monkeypatch.setattr(X.Scratch, "save", kept)
    found, model = X.fit_em_corpus(docs, k=3, iterations=2)
    assert sorted(found.collect()) == sorted(vocab.select("word_id", "word", "n").collect())
    assert model.v == want.v and model.totals == pytest.approx(want.totals)
    for got, same in ((model.word_topics, want.word_topics), (model.doc_topics, want.doc_topics)):
        left, right = ({r[0]: r.n for r in t.collect()} for t in (got, same))
        assert left.keys() == right.keys() and all(left[i] == pytest.approx(right[i]) for i in right)
    assert tables["blocks"].filter("text is null").count() <= blocks
    assert tables["blocks"].filter("text is not null").count() <= blocks * found.count()


def test_a_corpus_without_words(spark):
    from topicweft.operators import corpus as C

    docs = C.corpus(spark.createDataFrame([(1, " "), (2, None)], "id bigint, text string"), "id", "text")
    vocab, model = X.fit_em_corpus(docs, k=2, iterations=1)
    assert vocab.count() == 0 and model.v == 0 and model.totals == [0.0, 0.0] and model.topic_sums().count() == 0


def test_numbered_ranks_values_over_all_ranges(spark):
    from pyspark.sql import functions as F

    from topicweft.plans.ranges import numbered

    rows = spark.createDataFrame([(f"v{i % 50:02d}", i) for i in range(400)], "word string, i bigint").repartition(7)
    got = numbered(rows, "word", "at", {"n": F.count(F.lit(1))}).collect()
    assert len(got) == 400 and {(r.word, r.at, r.n) for r in got} == {(f"v{i:02d}", i, 8) for i in range(50)}
    assert sorted(r.word for r in got if r.first) == [f"v{i:02d}" for i in range(50)]


def test_empty_corpus(spark):
    none = spark.createDataFrame([], "doc_id bigint, word_id bigint, n bigint")
    model = X.fit_em(none, k=2, iterations=2)
    assert model.word_topics.count() == 0 and model.totals == [0.0, 0.0] and model.theta().count() == 0


def test_blocks_fit_their_words_vectors(spark):
    tokens = spark.range(200_000)
    assert T.blocks_for(tokens, v=1000, k=10) == min(10, 4 * spark.sparkContext.defaultParallelism)
    assert T.blocks_for(tokens, v=10**7, k=1000) == -(-200_000 // (T.BLOCK_BYTES // 8000))
