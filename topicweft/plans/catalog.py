"""The registered queries: every operator over the whole given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import community as M
from ..operators import corpus as C
from ..operators import emtopics as X
from ..operators import graph as G
from ..operators import learn as L
from ..operators import likelihood as K
from ..operators import mltopics as E
from ..operators import paths as P
from ..operators import programs as V
from ..operators import relevance as R
from ..operators import topics as T
from ..sources import models, sinks, text
from . import tables as B
from .scratch import Scratch

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

TOPICS, EM_TOPICS = 4, 3
SEED = 11
SWEEPS = 20
QUERY_WORDS = 20


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def r6(column: Column | str) -> Column:
    return F.round(column, 6)


# --- text -------------------------------------------------------------------


@query
def word_count(spark, sf):
    return C.word_count(B.documents(spark, sf))


@query
def doc_frequency(spark, sf):
    return C.document_frequency(B.documents(spark, sf))


@query
def token_total(spark, sf):
    return C.token_total(B.documents(spark, sf))


@query
def vocabulary(spark, sf):
    return C.vocabulary(B.documents(spark, sf))


@query
def doc_term_matrix(spark, sf):
    docs = B.documents(spark, sf)
    return C.doc_term_matrix(docs, C.vocabulary(docs))


@query
def document_sample(spark, sf):
    return C.sample_by_key(B.table(spark, sf, "documents"), "doc_id", 0.3, SEED).select("doc_id", "source")


def _conversation_lines(spark, sf):
    rows = B.table(spark, sf, "conversations")
    return rows.select(F.concat_ws("\t", "role", F.col("conv_id").cast("string"), "text").alias("value"))


@query
def corpus_text(spark, sf):
    """Three-field corpus lines, parsed."""
    corpus = text.parse_corpus(_conversation_lines(spark, sf))
    return corpus.groupBy("user_id", "doc_id").agg(
        F.count(F.lit(1)).alias("lines"), F.sum(F.size("words")).cast("long").alias("words")
    )


@query
def document_corpus_text(spark, sf):
    """Two-field corpus lines with quotes, parsed."""
    rows = B.table(spark, sf, "benchmark")
    lines = rows.select(F.concat(F.lit('"'), F.col("item_id").cast("string"), F.lit('"\t"'), "text", F.lit('"')).alias("value"))
    return text.parse_document_corpus(lines).select("doc_id", F.size("words").cast("long").alias("words"))


@query
def wide_corpus_text(spark, sf):
    """Six-field corpus lines: document in field 1, words in field 5."""
    rows = B.table(spark, sf, "documents")
    flat = F.regexp_replace("text", r"[\t\n\f\r]", " ")
    lines = rows.select(
        F.concat_ws("\t", "source", F.col("doc_id").cast("string"), "lang", F.col("n_chars").cast("string"), F.lit("-"), flat).alias("value")
    )
    return text.parse_wide_corpus(lines).select(F.col("doc_id").cast("long"), F.size("words").cast("long").alias("words"))


@query
def arity_filter(spark, sf):
    """Space-separated fields of part rows; rows with another field count go."""
    lines = sinks.as_lines(B.table(spark, sf, "part").select("p_partkey", "p_size", "p_name", "p_type"))
    return text.parse_delimited(lines, "id bigint, size int, word string, type string", " ", 5, [0, 1, 3, 4])


@query
def matrix_text_roundtrip(spark, sf):
    vectors = B.table(spark, sf, "embeddings")
    lines = sinks.matrix_lines(vectors, ["vec_id"], F.col("embedding"))
    matrix = text.parse_matrix(lines, ["vec_id"])
    total = F.aggregate("values", F.lit(0.0), lambda a, x: a + x)
    return matrix.select(
        F.col("vec_id").cast("long"), F.size("values").cast("long").alias("length"), F.round(total, 3).alias("total")
    )


@query
def labelled_points_text(spark, sf):
    from pyspark.ml.functions import vector_to_array

    lines = sinks.as_lines(B.points(spark, sf), ",")
    points = text.parse_labelled_points(lines, 4).select("label", vector_to_array("features").alias("f"))
    return points.groupBy("label").agg(
        F.count(F.lit(1)).alias("n"), *[F.round(F.sum(F.col("f")[i]), 2).alias(f"f{i}") for i in range(4)]
    )


@query
def count_vectors_text(spark, sf):
    lines = sinks.as_lines(B.table(spark, sf, "part").select("p_size", "p_retailprice", "p_partkey"))
    return text.parse_count_vectors(lines).select(
        F.col("counts")[2].cast("long").alias("id"), r6(F.aggregate("counts", F.lit(0.0), lambda a, x: a + x)).alias("total")
    )


@query
def canonical_edges_text(spark, sf):
    lines = sinks.as_lines(B.edges(spark, sf).select("src", "dst"))
    return text.parse_edges(lines, canonical=True).groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))


@query
def edge_line_kinds(spark, sf):
    """Order lines with the customer left out of some, and comment lines."""
    lines = B.table(spark, sf, "orders").select(
        F.when(F.col("o_custkey") % 7 == 0, F.col("o_orderkey").cast("string"))
        .when(F.col("o_custkey") % 7 == 1, F.concat(F.lit("# "), F.col("o_orderkey").cast("string")))
        .otherwise(F.concat_ws(" ", F.col("o_custkey").cast("string"), F.col("o_orderkey").cast("string"))).alias("value")
    )
    return text.edge_line_kinds(lines)


# --- files and models ----


def _folder(spark, label):
    """A folder of the run below the shared one, for tables that are written and read back."""
    return Scratch(spark, label).base


def _part_rows(spark, sf):
    return B.table(spark, sf, "part").select("p_partkey", "p_size", "p_retailprice")


def _parsed_parts(lines):
    return text.parse_delimited(lines, "id bigint, size int, price double")


@query
def delimited_file_roundtrip(spark, sf):
    """Rows to delimited text files and back."""
    path = _folder(spark, "delimited")
    sinks.write_delimited(_part_rows(spark, sf), path)
    return _parsed_parts(text.read_lines(spark, path))


@query
def folder_scan(spark, sf):
    """Two folders of lines read by one glob."""
    path = _folder(spark, "folders")
    rows = _part_rows(spark, sf)
    sinks.write_delimited(rows.filter("p_size <= 25"), f"{path}/small")
    sinks.write_delimited(rows.filter("p_size > 25"), f"{path}/large")
    return _parsed_parts(text.read_lines(spark, f"{path}/*"))


@query
def single_file_report(spark, sf):
    """A report of one line per source in one file."""
    path = _folder(spark, "report")
    report = B.table(spark, sf, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    sinks.write_single_file(report, path)
    return text.parse_delimited(text.read_lines(spark, path), "source string, n bigint")


@query
def snapshot_roundtrip(spark, sf):
    """Snapshots of two iterations, one of them written twice; the edges of that one."""
    path, g = _folder(spark, "snapshots"), B.graph(spark, sf)
    models.write_snapshot(G.subgraph(g, edge=F.col("attr") > 25), 2, path)
    for _ in range(2):
        models.write_snapshot(g, 1, path)
    return models.read_snapshot(spark, 1, path).edges


@query
def update_where_matched(spark, sf):
    """Attribute a replaced by 0 for the vertices that are customers."""
    g = _property_graph(spark, sf)
    updates = B.table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.lit(0).cast("int").alias("a"))
    return G.update_matching(g.vertices, updates, "a").select("id", F.col("a").cast("long"))


@query
def map_vertices(spark, sf):
    total = F.col("a") + F.col("b") + F.col("c")
    return _property_graph(spark, sf).map_vertices(total=total).vertices.select("id", "total")


@query
def map_edges(spark, sf):
    return B.graph(spark, sf).map_edges(attr=F.col("attr") * 2 + 1).edges


@query
def model_save_load(spark, sf):
    """A trained model saved, loaded, and its word counts."""
    path = _folder(spark, "model")
    models.save_model(_one_sweep(spark, sf)[1], path)
    return T.by_topic(models.load_model(spark, path).word_topics(), "n").filter("n > 0")


@query
def model_text(spark, sf):
    """The topic-word counts of a model as text lines, written and read back."""
    path = _folder(spark, "model-text")
    models.model_lines(_one_sweep(spark, sf)[1])["nkv"].write.text(path)
    matrix = text.parse_matrix(text.read_lines(spark, path), ["word_id"])
    rows = matrix.select(F.col("word_id").cast("long"), F.posexplode("values").alias("topic", "n"))
    return rows.filter("n > 0").select("word_id", "topic", F.col("n").cast("long"))


def _exported(spark, sf, name):
    """A table of a model as text lines, written and read back."""
    path = _folder(spark, "model-text")
    models.model_lines(_one_sweep(spark, sf)[1])[name].write.text(path)
    return text.read_lines(spark, path)


def _exported_matrix(spark, sf, name, key, value):
    matrix = text.parse_matrix(_exported(spark, sf, name), [key])
    return matrix.select(F.col(key).cast("long"), F.posexplode("values").alias("topic", value))


@query
def model_text_theta(spark, sf):
    return _exported_matrix(spark, sf, "theta", "doc_id", "theta").withColumn("theta", r6(F.col("theta").cast("double")))


@query
def model_text_phi(spark, sf):
    rows = _exported_matrix(spark, sf, "phi", "word_id", "p").withColumn("p", F.col("p").cast("double"))
    return rows.filter("p > 0").withColumn("p", F.round("p", 9))


@query
def model_text_nmk(spark, sf):
    return _exported_matrix(spark, sf, "nmk", "doc_id", "n").withColumn("n", F.col("n").cast("long"))


@query
def model_text_nk(spark, sf):
    return text.parse_delimited(_exported(spark, sf, "nk"), "topic int, n bigint")


@query
def model_text_words(spark, sf):
    """The word map; words hold no blanks, so a line has two fields."""
    return text.parse_delimited(_exported(spark, sf, "wordMap"), "word_id bigint, word string")


@query
def lda_resume(spark, sf):
    """One sweep, then one more from its saved state."""
    docs, model = _one_sweep(spark, sf)
    more = T.fit_lda(docs, k=TOPICS, sweeps=1, seed=SEED, resume=model, first_sweep=2)
    return T.by_topic(more.word_topics(), "n").filter("n > 0")


@query
def weights_save_load(spark, sf):
    path = _folder(spark, "weights")
    L.save_weights(L.weight_table(spark, B.FEATURES, _weights(spark, sf)), path)
    return _weight_rows(spark, L.load_weights(spark, path, B.FEATURES))


# --- graph primitives ---------------------------------------------------------


@query
def degrees(spark, sf):
    return G.all_degrees(B.edges(spark, sf))


@query
def max_degree(spark, sf):
    return G.extreme(G.degrees(B.edges(spark, sf)), "degree")


@query
def min_degree(spark, sf):
    return G.extreme(G.degrees(B.edges(spark, sf)), "degree", largest=False)


def _property_graph(spark, sf):
    g = B.graph(spark, sf)
    return G.Graph(G.with_properties(g.vertices, B.properties(spark, sf), B.PROPERTY_DEFAULTS), g.edges)


@query
def vertex_properties(spark, sf):
    return _property_graph(spark, sf).vertices


@query
def vertex_filter(spark, sf):
    return _property_graph(spark, sf).vertices.filter("a > 30").select("id", "a")


@query
def edge_filter(spark, sf):
    return B.edges(spark, sf).filter("attr > 25")


@query
def subgraph(spark, sf):
    return G.subgraph(_property_graph(spark, sf), vertex=F.col("a") >= 10).edges


@query
def triplets(spark, sf):
    view = G.triplets(_property_graph(spark, sf))
    return view.filter("src_a > dst_a").select("src", "dst", "attr", "src_a", "dst_a")


@query
def map_triplets(spark, sf):
    gap = F.abs(F.col("src_a") - F.col("dst_a")) * F.col("attr")
    return _property_graph(spark, sf).map_triplets(attr=gap).edges


@query
def reverse_edges(spark, sf):
    return G.reverse(B.edges(spark, sf))


@query
def equal_in_out(spark, sf):
    return G.equal_in_out(B.graph(spark, sf))


@query
def oldest_follower(spark, sf):
    return G.oldest_follower(_property_graph(spark, sf), "a")


@query
def message_sums(spark, sf):
    reduce = [F.sum(F.col("src_a") * F.col("attr")).alias("weighted"), F.min("src").alias("first_src")]
    return G.aggregate_messages(_property_graph(spark, sf), reduce)


@query
def overlap_score(spark, sf):
    return M.overlap_score(_property_graph(spark, sf), ["a", "b", "c"])


# --- paths --------------------------------------------------------------------


def _root(edges):
    return edges.agg(F.min("src").alias("id"))


@query
def bfs_hops(spark, sf):
    edges = B.graph(spark, sf).edges
    return P.bfs(edges, _root(edges)).select("id", F.col("level").cast("long").alias("hops"))


@query
def bfs_levels_parents(spark, sf):
    edges = B.graph(spark, sf).edges
    return P.bfs(edges, _root(edges)).select("id", F.col("level").cast("long"), "parents")


@query
def sssp(spark, sf):
    edges = B.graph(spark, sf).edges
    return P.shortest_paths(edges, _root(edges)).select("id", "distance")


@query
def betweenness(spark, sf):
    edges = B.graph(spark, sf).edges
    found = P.betweenness(edges, _root(edges)).vertices
    return found.select("id", F.col("level").cast("long"), r6("sigma").alias("sigma"), r6("credit").alias("credit"))


@query
def edge_betweenness(spark, sf):
    edges = B.graph(spark, sf).edges
    return P.betweenness(edges, _root(edges)).edges.select("src", "dst", r6("credit").alias("credit"))


@query
def sampled_betweenness(spark, sf):
    """Credit of vertices summed over a sample of two in a thousand of them as roots."""
    return _sampled(spark, sf).vertices.select("id", "roots", r6("credit").alias("credit"))


@query
def sampled_edge_betweenness(spark, sf):
    return _sampled(spark, sf).edges.select("src", "dst", r6("credit").alias("credit"))


def _sampled(spark, sf):
    g = B.graph(spark, sf)
    return P.betweenness_totals(g.edges, C.sample_by_key(g.vertices, "id", 0.002, SEED))


@query
def vertex_ranks(spark, sf):
    """A vertex program: rank passed on along edges until the gains are small."""
    g = B.graph(spark, sf)
    return V.rank_to_tolerance(g.edges, g.vertices, tolerance=1e-3).withColumn("rank", r6("rank"))


# --- communities ----------------------------------------------------------------


def _peeled(spark, sf):
    g = B.graph(spark, sf)
    return g, M.peel(g)


@query
def core_peel(spark, sf):
    return _peeled(spark, sf)[1].vertices.select("id", F.col("last_iter").cast("long"), "degree")


@query
def peel_stats(spark, sf):
    stats = M.peel_stats(_peeled(spark, sf)[1], B.labelled_users(spark, sf))
    return stats.withColumns({"iter": F.col("iter").cast("long"), "alpha": F.col("alpha").cast("long")})


@query
def user_last_iter(spark, sf):
    found = M.located_users(_peeled(spark, sf)[1], B.labelled_users(spark, sf))
    return found.withColumn("iter", F.col("iter").cast("long"))


@query
def community_index(spark, sf):
    found = M.located_users(_peeled(spark, sf)[1], B.labelled_users(spark, sf))
    return M.community_index(found).withColumn("iter", F.col("iter").cast("long"))


@query
def not_in_graph(spark, sf):
    users = B.labelled_users(spark, sf)
    return M.absent_users(users, M.located_users(_peeled(spark, sf)[1], users))


@query
def users_in_removed(spark, sf):
    found = M.users_in_removed(M.removed_per_iteration(_peeled(spark, sf)[1]), B.labelled_users(spark, sf))
    return found.withColumn("iter", F.col("iter").cast("long"))


@query
def new_users(spark, sf):
    users = B.labelled_users(spark, sf)
    known = B.table(spark, sf, "customer").select(F.col("c_custkey").alias("id"))
    found = M.new_users(users, known, M.located_users(_peeled(spark, sf)[1], users))
    return found.withColumn("iter", F.col("iter").cast("long"))


def _metrics(spark, sf):
    g, peeling = _peeled(spark, sf)
    return M.community_metrics(g, peeling), M.located_users(peeling, B.labelled_users(spark, sf))


@query
def community_metrics(spark, sf):
    m = _metrics(spark, sf)[0]
    return m.select(
        F.col("iter").cast("long"), "m", "edges", "dm", "cs", *[r6(c).alias(c) for c in ("fd", "fa", "q", "phi")]
    )


@query
def community_weighted_avg(spark, sf):
    metrics, located = _metrics(spark, sf)
    avg = M.weighted_averages(metrics, M.community_index(located), min_iter=10)
    return avg.select("users", *[r6(c).alias(c) for c in avg.columns if c != "users"])


@query
def user_attributes(spark, sf):
    peeling = _peeled(spark, sf)[1]
    rows = M.user_attributes(peeling, M.located_users(peeling, B.labelled_users(spark, sf)))
    return rows.select(
        "id", F.col("iter").cast("long"), r6("relative_degree").alias("relative_degree"), "community_size", r6("agreement").alias("agreement")
    )


@query
def harmonic_closeness(spark, sf):
    """Listed users (nation keys) inside their communities; community 0 skipped."""
    g, peeling = _peeled(spark, sf)
    leveled = Scratch(spark, "levels").save(M.edge_levels(g, peeling.vertices).select("src", "dst", "lo"), "edges")
    users = B.table(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("id"))
    sources = users.join(peeling.vertices, "id").filter("last_iter > 0").select("id", F.col("last_iter").alias("community"))
    rows = P.harmonic_closeness(leveled, sources, allowed=F.col("lo") >= F.col("community"))
    return rows.select("id", F.col("community").cast("long"), r6("closeness").alias("closeness"))


def _member_set(spark, sf):
    g = B.graph(spark, sf)
    members = G.with_properties(g.vertices, B.properties(spark, sf), B.PROPERTY_DEFAULTS).filter("a >= 10")
    return g, members.select("id")


def _set_metrics(rows):
    return rows.select(F.col("m").cast("long"), "edges", "cs", r6("fd").alias("fd"), r6("q").alias("q"), r6("phi").alias("phi"))


@query
def set_metrics(spark, sf):
    return _set_metrics(M.set_metrics(*_member_set(spark, sf)))


@query
def set_metrics_whole(spark, sf):
    """Conductance with the whole graph's volume."""
    return _set_metrics(M.set_metrics(*_member_set(spark, sf), whole_volume=True))


@query
def frontier_candidates(spark, sf):
    g = B.graph(spark, sf)
    return M.frontier_candidates(g, P.bfs(g.edges, _root(g.edges), depth=2), 1)


@query
def greedy_degree_community(spark, sf):
    g = B.graph(spark, sf)
    target = _root(g.edges).first()["id"]
    return M.greedy_community(g, target)


@query
def greedy_overlap_community(spark, sf):
    g = _property_graph(spark, sf)
    target = _root(g.edges).first()["id"]
    return M.greedy_community(g, target, ["a", "b", "c"])


# --- topic model -------------------------------------------------------------------


def _one_sweep(spark, sf):
    docs = B.documents(spark, sf)
    return docs, T.fit_lda(docs, k=TOPICS, sweeps=1, seed=SEED, mode="sync")


@query
def lda_init_counts(spark, sf):
    docs = B.documents(spark, sf)
    state = T.random_topics(C.encoded_tokens(docs, C.vocabulary(docs)), TOPICS, SEED)
    return T.by_topic(T.word_topic_counts(state, TOPICS), "n").filter("n > 0")


@query
def lda_one_sweep(spark, sf):
    return T.by_topic(_one_sweep(spark, sf)[1].word_topics(), "n").filter("n > 0")


@query
def lda_doc_topics(spark, sf):
    return T.by_topic(_one_sweep(spark, sf)[1].doc_topics(), "n")


@query
def lda_topic_totals(spark, sf):
    return _one_sweep(spark, sf)[1].topics()


@query
def lda_theta(spark, sf):
    theta = T.by_topic(_one_sweep(spark, sf)[1].theta(), "theta")
    return theta.withColumn("theta", r6("theta"))


@query
def lda_phi(spark, sf):
    phi = K.sparse_phi(_one_sweep(spark, sf)[1].phi())
    return phi.withColumn("p", F.round("p", 9))


@query
def lda_top_words(spark, sf):
    return _one_sweep(spark, sf)[1].top_words(10).withColumn("p", F.round("p", 9)).withColumn("rank", F.col("rank").cast("long"))


@query
def lda_topic_report(spark, sf):
    return _one_sweep(spark, sf)[1].report(10)


@query
def lda_fit(spark, sf):
    """Twenty synchronous training sweeps: topic counts of words."""
    model = T.fit_lda(B.documents(spark, sf), k=TOPICS, sweeps=SWEEPS, seed=SEED)
    return T.by_topic(model.word_topics(), "n").filter("n > 0")


@query
def lda_alias_totals(spark, sf):
    """Three sweeps of the alias sampler: tokens per word and per document, summed from the topic counts."""
    model = T.fit_lda(B.documents(spark, sf), k=TOPICS, sweeps=3, seed=SEED, mode="alias")
    size = F.aggregate("n", F.lit(0).cast("long"), lambda a, x: a + x).alias("n")
    words = model.word_topics().join(model.vocab.select("word_id", "word"), "word_id")
    return words.select(F.lit("word").alias("kind"), F.col("word").alias("item"), size).unionByName(
        model.doc_topics().select(F.lit("document").alias("kind"), F.col("doc_id").cast("string").alias("item"), size)
    )


@query
def lda_fold_in_step(spark, sf):
    """New texts, one synchronous sweep."""
    _, model = _one_sweep(spark, sf)
    theta = T.by_topic(T.infer_theta(B.new_texts(spark, sf), model, sweeps=1, seed=SEED, mode="sync"), "theta")
    return theta.withColumn("theta", r6("theta"))


@query
def lda_fold_in(spark, sf):
    """New texts, fifty synchronous sweeps."""
    _, model = _one_sweep(spark, sf)
    theta = T.by_topic(T.infer_theta(B.new_texts(spark, sf), model, sweeps=50, seed=SEED), "theta")
    return theta.withColumn("theta", r6("theta"))


@query
def new_text_tokens(spark, sf):
    """New texts looked up in the dictionary, unknown words replaced at random."""
    vocab = C.vocabulary(B.documents(spark, sf))
    return T.encode_new(B.new_texts(spark, sf), vocab, oov="random", seed=SEED)


def _em(spark, sf):
    docs = B.documents(spark, sf)
    vocab = C.vocabulary(docs)
    vectors = E.count_vectors(C.doc_term_matrix(docs, vocab), vocab.count())
    return vocab, vectors, E.fit_em_lda(vectors, k=3, iterations=50, seed=SEED)


@query
def mllib_lda_topics(spark, sf):
    """Ranks, distinct words and falling weights of each topic's ten heaviest words."""
    vocab, _, model = _em(spark, sf)
    rows = E.topic_terms(model, vocab, 10)
    return rows.groupBy(F.col("topic").cast("long")).agg(
        F.count_distinct("rank").alias("ranks"), F.count_distinct("word").alias("words"), (F.min("weight") > 0).alias("positive")
    )


@query
def mllib_lda_sums(spark, sf):
    """Every topic has a weight for every word, and they sum to 1."""
    return E.topic_sums(_em(spark, sf)[2]).select(F.col("topic").cast("long"), F.col("terms").cast("long"), r6("weight").alias("weight"))


@query
def mllib_lda_theta(spark, sf):
    """Topic shares of each document, by a model that was saved and loaded."""
    _, vectors, model = _em(spark, sf)
    path = _folder(spark, "em-model")
    E.save_em_lda(model, path)
    theta = T.by_topic(E.doc_topics(E.load_em_lda(path), vectors), "theta")
    return theta.groupBy("doc_id").agg(F.count(F.lit(1)).alias("topics"), r6(F.sum("theta")).alias("total"))


def _em_rows(spark, sf):
    return X.fit_em_corpus(B.documents(spark, sf), k=EM_TOPICS, iterations=2, seed=SEED)


@query
def em_word_topics(spark, sf):
    """Expected counts of words after two steps, the topic matrix as rows."""
    return T.by_topic(_em_rows(spark, sf)[1].word_topics, "n").withColumn("n", F.round("n", 5))


@query
def em_doc_topics(spark, sf):
    theta = T.by_topic(_em_rows(spark, sf)[1].theta(), "theta")
    return theta.withColumn("theta", r6("theta"))


@query
def em_topic_sums(spark, sf):
    return _em_rows(spark, sf)[1].topic_sums().withColumn("weight", r6("weight"))


@query
def em_new_texts(spark, sf):
    """Topic shares of new texts after three steps with the words' shares fixed."""
    vocab, model = _em_rows(spark, sf)
    theta = T.by_topic(X.infer_em(C.doc_term_matrix(B.new_texts(spark, sf), vocab), model, iterations=3), "theta")
    return theta.withColumn("theta", r6("theta"))


# --- relevance -----------------------------------------------------------------------


@query
def topic_prior(spark, sf):
    return R.topic_prior(_one_sweep(spark, sf)[1].topics()).withColumn("p", r6("p"))


@query
def word_probability(spark, sf):
    """Corpus words looked up for every word of the new texts."""
    vocab = C.vocabulary(B.new_texts(spark, sf))
    rows = R.word_probability(vocab, C.word_count(B.documents(spark, sf)))
    return rows.withColumn("p", F.round("p", 9))


def _lift(spark, sf, posterior=False):
    docs, model = _one_sweep(spark, sf)
    return docs, model, R.word_topic_lift(model.phi(), model.topics(), R.own_probability(model.vocab), posterior)


@query
def word_topic_posterior(spark, sf):
    rows = T.by_topic(_lift(spark, sf, posterior=True)[2], "lift")
    return rows.select("word_id", "topic", r6("lift").alias("p")).filter("p > 0")


@query
def word_lift_rank(spark, sf):
    scores = R.ranked(R.expansion_scores(_lift(spark, sf)[2]))
    return scores.withColumn("score", r6("score"))


def _query_set(spark, sf):
    docs, model, lift = _lift(spark, sf)
    return docs, model, R.query_words(R.expansion_scores(lift), QUERY_WORDS)


@query
def query_words(spark, sf):
    return _query_set(spark, sf)[2]


@query
def word_similarity(spark, sf):
    """Ten nearest words of the five most frequent ones."""
    _, model = _one_sweep(spark, sf)
    seeds = model.vocab.orderBy(F.col("n").desc(), "word").limit(5)
    rows = R.word_similarity(model.phi(), seeds, 10)
    return rows.withColumn("similarity", r6("similarity"))


def _likelihood(spark, sf):
    docs, model, words = _query_set(spark, sf)
    return docs, model, R.query_topic_likelihood(model, docs, words)


@query
def query_topic_likelihood(spark, sf):
    return _likelihood(spark, sf)[2].withColumn("likelihood", F.round("likelihood", 9))


@query
def query_topic_loglikelihood(spark, sf):
    docs, model, words = _query_set(spark, sf)
    rows = R.query_topic_likelihood(model, docs, words, combine="logsum")
    return rows.withColumn("likelihood", r6("likelihood"))


def _user_relevance(spark, sf):
    docs, model, likelihood = _likelihood(spark, sf)
    return R.user_topic_relevance(model.theta(), docs, likelihood, TOPICS)


@query
def user_relevance(spark, sf):
    rows = _user_relevance(spark, sf)
    long = T.by_topic(rows.select("user_id", "docs", "total", "relevance"), "relevance")
    return long.select("user_id", "docs", "topic", F.round("relevance", 9).alias("relevance"), F.round("total", 9).alias("total"))


@query
def user_relevance_scaled(spark, sf):
    rows = R.scaled(_user_relevance(spark, sf))
    return T.by_topic(rows, "scaled").select("user_id", "topic", r6("scaled").alias("scaled"), r6("score").alias("score"))


def _user_table(spark, sf):
    """Sources of documents and roles of conversations as users."""
    sources = B.table(spark, sf, "documents").groupBy(F.col("source").alias("user_id")).agg(
        F.count(F.lit(1)).alias("items"), F.max("n_chars").alias("longest")
    )
    roles = B.table(spark, sf, "conversations").groupBy(F.col("role").alias("user_id")).agg(
        F.count(F.lit(1)).alias("items"), F.max(F.length("text")).cast("long").alias("longest")
    )
    return sources.unionByName(roles)


def _users_with_relevance(spark, sf):
    scores = R.scaled(_user_relevance(spark, sf))
    return R.attach_relevance(_user_table(spark, sf), scores).withColumn("score", r6("score"))


@query
def users_with_relevance(spark, sf):
    return _users_with_relevance(spark, sf)


@query
def users_nonzero(spark, sf):
    return R.relevant_users(_users_with_relevance(spark, sf))


# --- likelihood ------------------------------------------------------------------------


def _token_likelihood(spark, sf):
    docs, model = _one_sweep(spark, sf)
    return docs, K.trained_likelihood(model)


@query
def token_index(spark, sf):
    """Words of new texts as dictionary numbers, -1 when unknown."""
    vocab = C.vocabulary(B.documents(spark, sf))
    return K.word_pairs(C.encoded_tokens(B.new_texts(spark, sf), vocab, "left"))


@query
def token_likelihood(spark, sf):
    return _token_likelihood(spark, sf)[1].withColumn("p", F.round("p", 9))


@query
def document_likelihood(spark, sf):
    return K.document_likelihood(_token_likelihood(spark, sf)[1]).withColumn("mass", r6("mass"))


@query
def mean_likelihood(spark, sf):
    docs, rows = _token_likelihood(spark, sf)
    return K.mean_likelihood(rows, docs).withColumn("mean_likelihood", r6("mean_likelihood"))


@query
def perplexity(spark, sf):
    return K.perplexity(_token_likelihood(spark, sf)[1]).withColumn("perplexity", F.round("perplexity", 4))


@query
def sparse_theta(spark, sf):
    return K.sparse_theta(_one_sweep(spark, sf)[1].theta(), 0.2).withColumn("p", r6("p"))


def _links(spark, sf):
    _, model = _one_sweep(spark, sf)
    return model, K.link_topics(K.trained_pairs(model), K.sparse_theta(model.theta(), 0.0), 0.2)


@query
def topic_links(spark, sf):
    return _links(spark, sf)[1]


@query
def word_mass(spark, sf):
    model, links = _links(spark, sf)
    return K.word_mass(links, K.sparse_phi(model.phi())).withColumn("mass", r6("mass"))


@query
def staged_likelihood(spark, sf):
    model, links = _links(spark, sf)
    return K.total_mass(K.word_mass(links, K.sparse_phi(model.phi()))).withColumn("mass", r6("mass"))


# --- learning ----------------------------------------------------------------------------


def _points(spark, sf):
    return L.standardised(B.points(spark, sf), B.FEATURES)


def _weights(spark, sf, **settings):
    return L.linear_descent(_points(spark, sf), B.FEATURES, **settings)


def _weight_rows(spark, weights):
    return L.weight_table(spark, B.FEATURES, weights).withColumn("weight", r6("weight"))


@query
def linreg_gd(spark, sf):
    return _weight_rows(spark, _weights(spark, sf))


@query
def ridge_gd(spark, sf):
    return _weight_rows(spark, _weights(spark, sf, penalty="l2"))


@query
def lasso_gd(spark, sf):
    return _weight_rows(spark, _weights(spark, sf, penalty="l1", reg=0.0005))


@query
def logreg_gd(spark, sf):
    signed = _points(spark, sf).withColumn("label", 2 * F.col("label") - 1)
    weights = L.logistic_descent(signed, B.FEATURES, iterations=5)
    return L.weight_table(spark, B.FEATURES, weights).withColumn("weight", F.round("weight", 3))


def _scored(spark, sf):
    weights = _weights(spark, sf)
    return _points(spark, sf).select("label", L.score(weights, B.FEATURES).alias("score"))


@query
def predictions(spark, sf):
    """Scores counted by label and sign."""
    rows = _scored(spark, sf).withColumn("above", F.col("score") > 0)
    return rows.groupBy("label", "above").agg(F.count(F.lit(1)).alias("n"), r6(F.sum("score")).alias("total"))


@query
def auc(spark, sf):
    return L.area_under_roc(_scored(spark, sf), "score", F.col("label") > 0).withColumn("auc", r6("auc"))


def _confusion(spark, sf):
    """Scores are of centred features, so the boundary is 0."""
    prediction = L.called(F.col("score"), threshold=0.0)
    return L.confusion(_scored(spark, sf).withColumn("prediction", prediction), "label", "prediction")


@query
def confusion(spark, sf):
    return _confusion(spark, sf)


@query
def class_metrics(spark, sf):
    m = L.class_metrics(_confusion(spark, sf))
    return m.select("class", *[r6(c).alias(c) for c in ("precision", "recall", "f", "accuracy")])


@query
def mse(spark, sf):
    """Training error of the three linear models."""
    out = None
    for name, settings in (("linear", {}), ("ridge", {"penalty": "l2"}), ("lasso", {"penalty": "l1", "reg": 0.0005})):
        weights = _weights(spark, sf, **settings)
        row = L.mean_squared_error(_points(spark, sf), "label", L.score(weights, B.FEATURES))
        row = row.select(F.lit(name).alias("model"), r6("mse").alias("mse"))
        out = row if out is None else out.unionByName(row)
    return out
