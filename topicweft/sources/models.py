"""Model folders and graph snapshots as Parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.graph import Graph
from ..operators.topics import LdaModel


def save_model(model: LdaModel, path: str) -> None:
    """State, dictionary, counts and shares, one table each; a repeated save replaces them."""
    parts = {
        "state": model.state, "vocabulary": model.vocab, "word_topics": model.word_topics(),
        "doc_topics": model.doc_topics(), "topics": model.topics(), "theta": model.theta(), "phi": model.phi(),
    }
    for name, table in parts.items():
        table.write.mode("overwrite").parquet(f"{path}/{name}")
    spark = model.state.sparkSession
    settings = [(model.k, model.alpha, model.beta)]
    spark.createDataFrame(settings, "k int, alpha double, beta double").write.mode("overwrite").parquet(f"{path}/settings")


def load_model(spark: SparkSession, path: str) -> LdaModel:
    """The model with the counts that were saved; no token is counted again."""
    s = spark.read.parquet(f"{path}/settings").first()
    state, vocab = spark.read.parquet(f"{path}/state"), spark.read.parquet(f"{path}/vocabulary")
    counts = {name: spark.read.parquet(f"{path}/{name}") for name in ("word_topics", "doc_topics")}
    return LdaModel(state, vocab, s["k"], s["alpha"], s["beta"], **counts)


def write_snapshot(graph: Graph, iteration: int, path: str) -> None:
    """Vertices and edges of one iteration, in a partition of their tables; written again,
    the partition is replaced."""
    for name, table in (("vertices", graph.vertices), ("edges", graph.edges)):
        table.write.mode("overwrite").parquet(f"{path}/{name}/iter={iteration}")


def read_snapshot(spark: SparkSession, iteration: int, path: str) -> Graph:
    """Reads only the partition of the iteration."""
    tables = [
        spark.read.parquet(f"{path}/{name}").filter(F.col("iter") == iteration).drop("iter")
        for name in ("vertices", "edges")
    ]
    return Graph(*tables)


def model_lines(model: LdaModel) -> dict[str, DataFrame]:
    """The count and share tables of a model as text lines, ready for
    ``write.text``: one line per document (theta, nmk), word (wordMap) or topic
    (nk), and the topic-word tables one line per word with its K values."""
    from .sinks import as_lines, matrix_lines

    return {
        "theta": matrix_lines(model.theta(), ["doc_id"], F.col("theta")),
        "phi": matrix_lines(model.phi(), ["word_id"], F.col("phi")),
        "nkv": matrix_lines(model.word_topics(), ["word_id"], F.col("n")),
        "nmk": matrix_lines(model.doc_topics(), ["doc_id"], F.col("n")),
        "nk": as_lines(model.topics().select("topic", "n")),
        "wordMap": as_lines(model.vocab.select("word_id", "word")),
    }
