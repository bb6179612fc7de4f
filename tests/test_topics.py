import numpy as np
import pytest
from pyspark.sql import functions as F

from topicweft.operators import corpus as C
from topicweft.operators import likelihood as K
from topicweft.operators import mltopics as E
from topicweft.operators import relevance as R
from topicweft.operators import topics as T
from topicweft.functions.draws import remix, remixed, uniform
from topicweft.plans import tables as B
from topicweft.sources import models

TEXTS = [
    (1, "u1", "red apple red pear"), (2, "u1", "pear plum apple  apple "), (3, "u2", "dog cat dog"),
    (4, "u2", "cat bird dog cat"), (5, "u3", "apple dog"),
]


@pytest.fixture(scope="module")
def small(spark):
    return C.corpus(spark.createDataFrame(TEXTS, "doc_id bigint, user string, text string"), "doc_id", "text", "user")


@pytest.fixture(scope="module")
def model(small):
    return T.fit_lda(small, k=2, sweeps=2, mode="sync")


def test_words_and_vocabulary(small):
    counts = {r["word"]: r["n"] for r in C.word_count(small).collect()}
    assert counts["apple"] == 4 and "" not in counts and sum(counts.values()) == 17
    vocab = [r["word"] for r in C.vocabulary(small).orderBy("word_id").collect()]
    assert vocab == sorted(counts)
    df = {r["word"]: r["df"] for r in C.document_frequency(small).collect()}
    assert df["apple"] == 3 and df["dog"] == 3
    terms = C.doc_term_matrix(small, C.vocabulary(small))
    assert terms.agg(F.sum("n")).first()[0] == 17


@pytest.mark.parametrize("n", [1, 3, 16])
def test_dense_index_on_any_partitioning(spark, sf, partitions, n):
    partitions(n)
    vocab = C.vocabulary(B.documents(spark, sf)).orderBy("word_id").collect()
    assert [r["word_id"] for r in vocab] == list(range(len(vocab)))
    assert [r["word"] for r in vocab] == sorted(r["word"] for r in vocab)


@pytest.mark.parametrize("mode", ["sync", "doc", "alias"])
def test_counts_stay_whole(spark, sf, mode):
    docs = B.documents(spark, sf)
    tokens = C.token_total(docs).first()[0]
    model = T.fit_lda(docs, k=3, sweeps=2, mode=mode)
    assert model.state.count() == tokens
    assert model.topics().agg(F.sum("n")).first()[0] == tokens
    theta = model.theta().select(F.aggregate("theta", F.lit(0.0), lambda a, x: a + x).alias("s"))
    assert theta.agg(F.min("s"), F.max("s")).first() == pytest.approx((1.0, 1.0))
    phi = T.by_topic(model.phi(), "phi").groupBy("topic").agg(F.sum("phi").alias("s"))
    assert [r["s"] for r in phi.collect()] == pytest.approx([1.0] * 3)


@pytest.mark.parametrize("mode", ["sync", "doc", "alias"])
def test_same_draws_on_any_partitioning(small, partitions, mode):
    states = []
    for n in (1, 4, 16):
        partitions(n)
        state = T.fit_lda(small, k=3, sweeps=3, mode=mode).state
        states.append(sorted(tuple(r[c] for c in ("doc_id", "pos", "word_id", "z")) for r in state.collect()))
    assert states[0] == states[1] == states[2]


@pytest.mark.parametrize("mode", ["doc", "alias"])
def test_training_raises_likelihood(spark, sf, mode):
    docs = B.documents(spark, sf)

    def score(sweeps):
        m = T.fit_lda(docs, k=4, sweeps=sweeps, mode=mode)
        pairs = K.word_pairs(C.encoded_tokens(docs, m.vocab))
        return K.perplexity(K.token_likelihood(pairs, m.theta(), m.phi(), 4)).first()["perplexity"]

    assert score(6) < score(0)


def test_resume_equals_one_run(small):
    whole = T.fit_lda(small, k=2, sweeps=3, mode="sync")
    first = T.fit_lda(small, k=2, sweeps=2, mode="sync")
    rest = T.fit_lda(small, k=2, sweeps=1, mode="sync", resume=first.state, first_sweep=3)
    assert whole.state.exceptAll(rest.state.select(*whole.state.columns)).count() == 0


@pytest.mark.parametrize("sweeps", [0, 2])
def test_a_model_goes_on_from_its_blocks(small, monkeypatch, sweeps):
    """Also from a model as first dealt; after a sweep the tokens are not made rows."""
    whole = T.fit_lda(small, k=2, sweeps=sweeps + 2)
    first = T.fit_lda(small, k=2, sweeps=sweeps)
    if sweeps:
        monkeypatch.setattr(T, "_gather", None)
    rest = T.fit_lda(small, k=2, sweeps=2, resume=first, first_sweep=sweeps + 1)
    assert whole.state.exceptAll(rest.state.select(*whole.state.columns)).count() == 0
    assert sorted(map(tuple, whole.word_topics().select("word_id", "n").collect())) == sorted(map(tuple, rest.word_topics().select("word_id", "n").collect()))
    with pytest.raises(ValueError):
        T.fit_lda(small, k=3, sweeps=1, resume=first, first_sweep=sweeps + 1)


@pytest.mark.parametrize("sweeps", [0, 1])
def test_likelihood_of_training_texts_in_blocks(spark, sf, monkeypatch, sweeps):
    """The same rows as by joins of tokens, without them."""
    monkeypatch.setattr(T, "LEAST_TOKENS", 2_000)
    model = T.fit_lda(B.documents(spark, sf), k=3, sweeps=sweeps)
    pairs = K.word_pairs(model.state)
    want = {(r.doc_id, r.word_id): (r.n, r.p) for r in K.token_likelihood(pairs, model.theta(), model.phi(), 3).collect()}
    monkeypatch.setattr(K, "word_pairs", None)
    got = K.trained_likelihood(model).collect()
    assert len(got) == len(want) and {(r.doc_id, r.word_id): (r.n, pytest.approx(r.p)) for r in got} == want
    assert sorted(map(tuple, K.trained_pairs(model).collect())) == sorted((d, w, n) for (d, w), (n, _) in want.items())


def test_draws_take_the_first_running_sum_that_reaches_the_aim():
    for k in (1, 3, 20):
        weights = [float((i * 7) % 5) for i in range(k)]
        us = [i / 50 for i in range(50)]
        want = []
        for u in us:
            running, hit = 0.0, k - 1
            for i, w in enumerate(weights):
                running += w
                if running >= u * sum(weights):
                    hit = i
                    break
            want.append(hit)
        assert T._draw(np.tile(weights, (50, 1)), np.array(us)).tolist() == want


def test_alias_tables_hold_the_weights():
    rng = np.random.default_rng(3)
    for k in (1, 2, 3, 17):
        weights = np.concatenate([rng.random((40, k)) ** 8 + 1e-9, np.ones((2, k)), np.eye(k) + 1e-12])
        share, other = T.alias_tables(weights)
        held = share.copy()
        for c in range(k):
            np.add.at(held, (np.arange(len(held)), other[:, c]), 1 - share[:, c])
        assert np.allclose(held / k, weights / weights.sum(axis=1, keepdims=True), atol=1e-12)


@pytest.mark.parametrize("place", [0, 2, 3])
def test_alias_draws_follow_the_conditional(place):
    """Many copies of one document, only one token of which is free to move: its topics come in the shares of the exact
    conditional, own count left out."""
    k, alpha, beta, v, copies = 5, 0.3, 0.1, 6, 40_000
    words, z0 = np.array([0, 2, 0, 1]), np.array([1, 4, 1, 0])
    vectors = np.array([[3, 9, 0, 1, 2], [5, 0, 0, 0, 4], [0, 1, 7, 7, 2]], float)
    totals = np.array([20.0, 15.0, 9.0, 30.0, 12.0])
    own = np.eye(k)[z0[place]]
    # tokens before the place are drawn first; the conditional is that of the topics they got
    n = len(words)
    docs = np.repeat(np.arange(copies), n)
    bits = np.random.default_rng(5).integers(0, 2**52, copies * n)
    new = T.alias_pass(docs, np.tile(words, copies), np.tile(z0, copies), vectors, totals, alpha, beta, v, bits, 1, cycles=12).reshape(copies, n)
    current = np.tile(z0, (copies, 1))
    current[:, :place] = new[:, :place]
    by_doc = np.stack([np.bincount(r, minlength=k) for r in current]) - own
    weights = (by_doc + alpha) * (vectors[words[place]] - own + beta) / (totals - own + v * beta)
    want = (weights / weights.sum(axis=1, keepdims=True)).mean(axis=0)
    got = np.bincount(new[:, place], minlength=k) / copies
    assert np.all(np.abs(got - want) < 4.5 * np.sqrt(want * (1 - want) / copies) + 1e-4), (got, want)


def test_alias_pass_without_tokens_and_with_single_ones():
    none = np.empty(0, np.int64)
    assert len(T.alias_pass(none, none, none, np.empty((0, 3)), np.ones(3), 0.1, 0.1, 2, none, 1)) == 0
    one = T.alias_pass(np.arange(4), np.zeros(4, int), np.zeros(4, int), np.full((1, 1), 4.0), np.array([4.0]), 0.1, 0.1, 1, np.arange(4), 1)
    assert one.tolist() == [0, 0, 0, 0]


def test_remixed_draws_in_all_forms(spark):
    import duckdb

    from topicweft.plans.oracles import remix as as_sql

    keys = [0, 1, 2**52 - 1, 2**26, 123_456_789_012_345]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(keys)], "i int, b bigint")
    for counter in (0, 1, 50, 2**31 - 1):
        want = remix(np.array(keys, np.int64), counter).tolist()
        assert [r[0] for r in df.orderBy("i").select(remixed(F.col("b"), counter)).collect()] == want
        sql = f"SELECT u FROM (SELECT b, {as_sql('b', counter)} FROM (SELECT unnest({keys}::BIGINT[]) AS b))"
        assert [r[0] for r in duckdb.sql(sql).fetchall()] == want


def test_remixed_draws_are_even_and_unrelated():
    rng = np.random.default_rng(7)
    for keys in (np.arange(200_000), rng.integers(0, 2**52, 200_000)):
        draws = [remix(keys.astype(np.int64), c) for c in (0, 1, 2, 40)]
        for i, u in enumerate(draws):
            assert len(np.unique(u)) == len(np.unique(keys))
            cells = np.bincount((u * 100).astype(int), minlength=100)
            assert ((cells - 2000) ** 2 / 2000).sum() < 170  # chi-square of 99 degrees, about 1 in 10,000
            assert abs(np.corrcoef(u[1:], u[:-1])[0, 1]) < 0.01
            for other in draws[:i]:
                grid = np.bincount((u * 10).astype(int) * 10 + (other * 10).astype(int), minlength=100)
                assert ((grid - 2000) ** 2 / 2000).sum() < 170


def test_uniform_draws_are_bits_of_the_keys_hash(spark):
    import hashlib

    df = spark.createDataFrame([(3, 4), (70, 0)], "d bigint, p int")
    got = [r[0] for r in df.orderBy("d").select(uniform(11, F.col("d"), F.col("p"), 5)).collect()]
    want = [(int.from_bytes(hashlib.md5(f"11:{d}:{p}:5".encode()).digest()[:7], "big") >> 4) / 2**52 for d, p in ((3, 4), (70, 0))]
    assert got == want


def test_fold_in(small, model, spark):
    new = C.corpus(spark.createDataFrame([(7, "apple pear zzz"), (8, "zzz")], "doc_id bigint, text string"), "doc_id", "text")
    for mode in ("doc", "sync"):
        rows = T.infer_theta(new, model, sweeps=5, mode=mode).collect()
        assert [r["doc_id"] for r in rows] == [7]
        assert sum(rows[0]["theta"]) == pytest.approx(1.0)
    assert {r["doc_id"] for r in T.infer_theta(new, model, sweeps=2, oov="random").collect()} == {7, 8}


def test_reports_and_model_folder(small, model, spark, tmp_path):
    assert model.top_words(2).count() <= 4
    assert all("n(" in r["words"] for r in model.report(2).collect())
    path = str(tmp_path / "model")
    models.save_model(model, path)
    again = models.load_model(spark, path)
    assert again.k == 2 and again.phi().exceptAll(model.phi()).count() == 0
    lines = models.model_lines(model)
    assert lines["theta"].first()["value"].count("List(") == 1
    assert lines["nk"].count() == 2


def test_hot_word_is_split(spark):
    """One word with most tokens: nothing lost, nothing doubled."""
    texts = [(i, "the " * 50 + f"w{i}") for i in range(40)]
    docs = C.corpus(spark.createDataFrame(texts, "doc_id bigint, text string"), "doc_id", "text")
    vocab = C.vocabulary(docs)
    tokens = C.encoded_tokens(docs, vocab)
    assert tokens.count() == 40 * 51
    assert T.fit_lda(docs, k=3, sweeps=1, mode="sync").state.count() == 40 * 51
    assert C.doc_term_matrix(docs, vocab).agg(F.sum("n")).first()[0] == 40 * 51


def test_relevance_by_hand(small, model):
    words = R.word_probability(model.vocab, model.vocab.select("word", "n"))
    assert words.agg(F.sum("p")).first()[0] == pytest.approx(1.0)
    lift = R.word_topic_lift(model.phi(), model.topics(), words)
    posterior = R.word_topic_lift(model.phi(), model.topics(), words, posterior=True)
    total = posterior.select(F.aggregate("lift", F.lit(0.0), lambda a, x: a + x).alias("s")).agg(F.min("s"), F.max("s")).first()
    assert total == pytest.approx((1.0, 1.0))
    query = R.query_words(R.expansion_scores(lift), 3)
    assert query.count() == 3
    likelihood = R.query_topic_likelihood(model, small, query)
    phi = {r["word_id"]: r["phi"] for r in model.phi().collect()}
    n = {r["word_id"]: r["n"] for r in model.word_topics().collect()}
    df = {r["word"]: r["df"] for r in C.document_frequency(small).collect()}
    want = [0.0, 0.0]
    for r in query.collect():
        for k in range(2):
            ml, bg = n[r["word_id"]][k] / sum(n[r["word_id"]]), df[r["word"]] / len(TEXTS)
            want[k] += 0.4 * (0.3 * ml + 0.7 * bg) + 0.6 * phi[r["word_id"]][k]
    got = [r["likelihood"] for r in likelihood.orderBy("topic").collect()]
    assert got == pytest.approx(want)
    rel = {r["user_id"]: r for r in R.user_topic_relevance(model.theta(), small, likelihood, 2).collect()}
    theta = {r["doc_id"]: r["theta"] for r in model.theta().collect()}
    assert rel["u1"]["relevance"] == pytest.approx([(theta[1][k] + theta[2][k]) / 2 * want[k] for k in range(2)])
    assert rel["u3"]["docs"] == 1


@pytest.mark.parametrize("mode", ["sync", "alias"])
def test_between_sweeps_words_are_packed(spark, monkeypatch, mode):
    """Blocks give each other a row per range of words, not one per word, with the same result as one block's for draws from the sweep's start."""
    texts = [(d, " ".join(f"w{(d * 7 + i * i) % 40}" for i in range(30)) + f" only{d}") for d in range(30)]
    docs = C.corpus(spark.createDataFrame(texts, "id bigint, text string"), "id", "text")
    blocks, tables, saved = 1, {}, T.Scratch.save

    def kept(self, df, name):
        out = saved(self, df, name)
        if name in ("sweep=3", "block-words"):
            tables[name] = out.filter("place is not null" if name == "sweep=3" else "shared").count()
        return out

    monkeypatch.setattr(T, "_blocks", lambda *_: blocks)
    want = T.fit_lda(docs, k=3, sweeps=4, mode=mode)
    words = {r.word_id: r.n for r in want.word_topics().collect()}
    blocks = 4
    monkeypatch.setattr(T, "WORDS_PER_RANGE", 30)
    monkeypatch.setattr(T.Scratch, "save", kept)
    model = T.fit_lda(docs, k=3, sweeps=4, mode=mode)
    assert {r.word_id: r.n for r in model.word_topics().collect()} == words and len(words) == len({w for _, t in texts for w in t.split()})
    shared = tables["block-words"]
    ranges = -(-shared // 30)
    assert ranges > 2 and 0 < tables["sweep=3"] <= 4 * ranges < shared


def test_unknown_words(spark, small, model):
    new = C.corpus(spark.createDataFrame([(7, "apple zzz")], "doc_id bigint, text string"), "doc_id", "text")
    pairs = K.word_pairs(C.encoded_tokens(new, model.vocab, "left", None))
    assert {r["word_id"] for r in pairs.collect()} == {-1, 0}


def test_em_lda(spark, small, tmp_path):
    from pyspark.ml.clustering import DistributedLDAModel

    vocab = C.vocabulary(small)
    vectors = E.count_vectors(C.doc_term_matrix(small, vocab), vocab.count())
    model = E.fit_em_lda(vectors, k=3, iterations=5)
    assert model.isDistributed()
    assert E.topic_terms(model, vocab, 2).count() == 6
    assert {r["terms"] for r in E.topic_sums(model).collect()} == {vocab.count()}
    theta = E.doc_topics(model, vectors).collect()
    assert len(theta) == 5 and all(sum(r["theta"]) == pytest.approx(1.0) for r in theta)
    model.write().overwrite().save(str(tmp_path / "em"))
    assert DistributedLDAModel.load(str(tmp_path / "em")).vocabSize() == vocab.count()


def test_em_lda_on_dense_lines(spark):
    from topicweft.sources import text

    lines = spark.createDataFrame([("1 2 0",), ("0 1 5",), ("3 0 0",)], "value string")
    vectors = E.dense_vectors(text.parse_count_vectors(lines))
    assert E.fit_em_lda(vectors, k=2, iterations=3).vocabSize() == 3


def test_long_document_spans_batches(spark, partitions):
    """A document over several Arrow batches is drawn as one, next to short ones."""
    partitions(1)
    texts = [(1, "a b"), (2, "c d " * 40), (3, "a"), (4, "d c b a " * 30), (5, "b")]
    docs = C.corpus(spark.createDataFrame(texts, "doc_id bigint, text string"), "doc_id", "text")
    whole = T.fit_lda(docs, k=3, sweeps=2)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        cut = T.fit_lda(docs, k=3, sweeps=2)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert whole.state.count() == cut.state.count() == 204
    assert whole.state.exceptAll(cut.state.select(*whole.state.columns)).count() == 0


@pytest.mark.parametrize("most", [100, 0])
def test_similarity_of_signed_vectors_in_both_forms(spark, monkeypatch, most):
    monkeypatch.setattr(R, "MOST_SEEDS", most)
    rng = np.random.default_rng(5)
    vectors = np.round(rng.normal(size=(30, 4)), 3) * (rng.random((30, 4)) > 0.3)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors) if v.any()], "word_id bigint, phi array<double>")
    seeds = spark.createDataFrame([(0,), (3,), (8,)], "word_id bigint")
    got = {(r.seed_id, r.word_id): r.similarity for r in R.word_similarity(df, seeds, 6).collect()}
    want = {}
    for s in (0, 3, 8):
        cosine = {}
        for i, v in enumerate(vectors):
            if i != s and v.any() and vectors[s].any():
                cosine[i] = round(float(v @ vectors[s] / (np.linalg.norm(v) * np.linalg.norm(vectors[s]))), 12)
        best = sorted((-c, i) for i, c in cosine.items() if c > 0)[:6]
        want |= {(s, i): -c for c, i in best}
    assert got == pytest.approx(want, abs=1e-9)


def test_token_draws_in_numpy_equal_the_columns(spark):
    """Keys of any length, without a key, any position; messages beyond one md5 block too."""
    from topicweft.functions.draws import bits, token_bits

    keys = ["0", "12345", None, "é" * 9, "x" * 49, "y" * 70]
    pos = [0, 7, 9, 10, 99, 100, 12345]
    doc = np.repeat(np.arange(len(keys)), len(pos))
    rows = spark.createDataFrame([(k, p) for k in keys for p in pos], "k string, p int")
    for last in ((), (0,), (17,)):
        want = [r[0] for r in rows.select(bits(11, F.col("k"), F.col("p"), *last)).collect()]
        assert token_bits(11, keys, doc, np.array(pos * len(keys)), *last).tolist() == want


def test_words_of_one_block_stay_in_it(small, monkeypatch):
    """Only words that several blocks have are sent between sweeps, and the counts do not depend on the blocks."""
    found = []
    for blocks in (1, 3):
        monkeypatch.setattr(T, "_blocks", lambda spark, n, v, k, per_core=4, blocks=blocks: blocks)
        model = T.fit_lda(small, k=2, sweeps=3)
        found.append(sorted((r["word_id"], r["n"]) for r in model.word_topics().collect()))
        sent, pairs = model._blocks.vectors(True, False), model._blocks.pairs
        alone = pairs.groupBy("word_id").count().filter("count = 1")
        assert alone.count() > 0 and sent.join(alone, "word_id").count() == 0
    assert found[0] == found[1]


def test_repeated_and_missing_identifiers(spark):
    """Rows of one identifier are one document; texts without words give no row."""
    texts = [(1, "a b a"), (1, "b c"), (2, ""), (3, None), (None, "a c")]
    docs = C.corpus(spark.createDataFrame(texts, "doc_id bigint, text string"), "doc_id", "text")
    for mode in ("sync", "alias"):
        model = T.fit_lda(docs, k=2, sweeps=2, mode=mode)
        assert sorted((r["doc_id"] or 0, sum(r["n"])) for r in model.doc_topics().collect()) == [(0, 2), (1, 5)]
        assert model.state.count() == 7


def test_topic_totals_need_no_word_counts(spark, small):
    """They come from the documents' counts, which the sweep has written; and what a sweep is given has no null arrays."""
    model = T.fit_lda(small, k=2, sweeps=1, mode="sync")
    totals = {r["topic"]: r["n"] for r in model.topics().collect()}
    assert "_word_topics" not in model.__dict__ and sum(totals.values()) == 17 and model.totals == [totals[0], totals[1]]
    words = T.by_topic(model.word_topics(), "n").groupBy("topic").agg(F.sum("n").alias("n")).collect()
    assert {r["topic"]: r["n"] for r in words} == totals
    assert model._blocks.vectors(True, True).filter("vector is null").count() == 0
