from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from topicweft.operators import corpus as C
from topicweft.operators import graph as G
from topicweft.plans.scratch import checkpoint_root
from topicweft.sources import models, sinks, text


def lines(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "value string")


def test_three_field_corpus(spark, tmp_path):
    (tmp_path / "part-0").write_text("u1\td1\ta b  c\nbad line\nu2\td2\tx\textra\nu3\td3\ty \n")
    rows = text.read_corpus(spark, str(tmp_path / "part-*")).orderBy("doc_id").collect()
    assert [(r["user_id"], r["doc_id"], r["words"]) for r in rows] == [("u1", "d1", ["a", "b", "c"]), ("u3", "d3", ["y"])]


def test_two_and_six_field_corpus(spark):
    two = text.parse_document_corpus(lines(spark, '"7"\t"a b"', "x\ty\tz")).collect()
    assert [(r["doc_id"], r["words"]) for r in two] == [(7, ["a", "b"])]
    six = text.parse_wide_corpus(lines(spark, "f0\td9\tf2\tf3\tf4\ta b", "short\tline")).collect()
    assert [(r["doc_id"], r["words"]) for r in six] == [("d9", ["a", "b"])]


def test_trailing_separators_do_not_count(spark):
    rows = text.parse_delimited(lines(spark, "1 a", "2 b ", "3", "4 c d"), "id bigint, w string").orderBy("id").collect()
    assert [tuple(r) for r in rows] == [(1, "a"), (2, "b")]


def test_bad_field_is_null(spark):
    rows = text.parse_delimited(lines(spark, "x 2", "1 3"), "id bigint, n int").collect()
    assert {tuple(r) for r in rows} == {(None, 2), (1, 3)}


def test_column_numbers(spark):
    rows = text.parse_delimited(lines(spark, "1 a b c d"), "id bigint, x string, y string", " ", 5, [0, 3, 4]).collect()
    assert tuple(rows[0]) == (1, "c", "d")


def test_matrix_roundtrip(spark, tmp_path):
    df = spark.createDataFrame([("u", 1, [0.5, 0.25]), ("v", 2, [1.0, 0.0])], "u string, d bigint, p array<double>")
    path = str(tmp_path / "theta")
    sinks.write_matrix(df, ["u", "d"], F.col("p"), path)
    again = text.parse_matrix(text.read_lines(spark, path), ["u", "d"]).orderBy("u").collect()
    assert [tuple(r) for r in again] == [("u", "1", [0.5, 0.25]), ("v", "2", [1.0, 0.0])]
    shape = text.matrix_shape(text.parse_matrix(text.read_lines(spark, path), ["u", "d"]), "u")
    assert {r["length"] for r in shape.collect()} == {2}


def test_edge_list(spark, tmp_path):
    (tmp_path / "edges.txt").write_text("# comment\n1 2\n3\t1\n2 2\n")
    assert {tuple(r) for r in text.read_edges(spark, str(tmp_path / "edges.txt")).collect()} == {(1, 2, 1), (3, 1, 1), (2, 2, 1)}
    turned = text.read_edges(spark, str(tmp_path / "edges.txt"), canonical=True, partitions=7)
    assert {tuple(r)[:2] for r in turned.collect()} == {(1, 2), (1, 3), (2, 2)}
    assert turned.rdd.getNumPartitions() == 7


def test_points_and_vectors(spark):
    row = text.parse_labelled_points(lines(spark, "1.0,2,3", "bad"), 2).collect()
    assert row[0]["label"] == 1.0 and list(row[0]["features"]) == [2.0, 3.0]
    assert text.parse_count_vectors(lines(spark, " 1 2 0 ")).first()["counts"] == [1.0, 2.0, 0.0]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id int, w string")
    sinks.write_delimited(df, str(tmp_path / "many"))
    sinks.write_single_file(df, str(tmp_path / "one"))
    assert {r[0] for r in text.read_lines(spark, str(tmp_path / "many")).collect()} == {"1 a", "2 b"}
    assert len(list((tmp_path / "one").glob("part-*"))) == 1
    with pytest.raises(ValueError, match="too many"):
        sinks.write_single_file(df, str(tmp_path / "large"), most_bytes=5)
    assert not (tmp_path / "large").exists()


def test_snapshots_read_one_partition(spark, tmp_path):
    path = str(tmp_path / "snap")
    for i in (1, 2, 2, 1):  # written again, a snapshot is replaced
        e = spark.createDataFrame([(i, i + 1, 1)], "src bigint, dst bigint, attr int")
        models.write_snapshot(G.Graph.from_edges(e), i, path)
    g = models.read_snapshot(spark, 2, path)
    assert [tuple(r) for r in g.edges.collect()] == [(2, 3, 1)] and g.vertices.count() == 2
    assert "PartitionFilters: [isnotnull(iter" in g.edges._jdf.queryExecution().toString()


def test_sampling(spark):
    df = spark.range(2000).withColumnRenamed("id", "k")
    kept = C.sample_by_key(df, "k", 0.25)
    assert 400 < kept.count() < 600
    assert kept.exceptAll(C.sample_by_key(df.repartition(7), "k", 0.25)).count() == 0
    assert 400 < C.sample_rows(df, 0.25).count() < 600


def session_stub(conf, master, context_dir=None):
    context = SimpleNamespace(master=master, getCheckpointDir=lambda: context_dir)
    return SimpleNamespace(conf=SimpleNamespace(get=lambda key, default=None: conf.get(key, default)), sparkContext=context)


def test_scratch_folder_follows_the_session():
    named = session_stub({"spark.checkpoint.dir": "hdfs://shared/ck/"}, "yarn", "elsewhere")
    assert checkpoint_root(named) == "hdfs://shared/ck"
    assert checkpoint_root(session_stub({}, "yarn", "hdfs://set/by/code")) == "hdfs://set/by/code"
    with pytest.raises(RuntimeError):
        checkpoint_root(session_stub({}, "yarn"))
