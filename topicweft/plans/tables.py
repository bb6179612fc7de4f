"""Bindings: the logical inputs of the operators as views of the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import corpus as C
from ..operators.graph import Graph
from .scratch import Scratch


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Corpus: user = source, document = doc_id, words of the whole text."""
    rows = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return C.corpus(rows, "doc_id", "text", "source")


def new_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.corpus(table(spark, sf_dir, "benchmark"), "item_id", "text")


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customer -> order and order -> part over one id space, without loops;
    ``attr`` is the ordered quantity, or 1 between customer and order."""
    placed = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("src"), F.col("o_orderkey").alias("dst"), F.lit(1).cast("long").alias("q")
    )
    lines = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("src"), F.col("l_partkey").alias("dst"), F.col("l_quantity").cast("long").alias("q")
    )
    return (
        placed.unionByName(lines).filter("src <> dst").groupBy("src", "dst").agg(F.sum("q").alias("attr"))
    )


def graph(spark: SparkSession, sf_dir: str) -> Graph:
    """The edge table written once, for the operators that read it several times."""
    return Graph.from_edges(Scratch(spark, "graph").save(edges(spark, sf_dir), "edges"))


def properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User table: three whole-number attributes per id."""
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("id"),
        F.col("p_size").cast("long").alias("a"),
        F.floor("p_retailprice").cast("long").alias("b"),
        F.length("p_name").cast("long").alias("c"),
    )


PROPERTY_DEFAULTS = {"a": 0, "b": 0, "c": 0}


def labelled_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listed users: every customer, and every event as an even-numbered user, who
    may or may not be in the graph; label N or P."""
    customers = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("id"), F.when(F.col("c_acctbal") < 0, "N").otherwise("P").alias("label")
    )
    others = table(spark, sf_dir, "events").select(
        (F.col("event_id") * 2).alias("id"), F.when(F.col("event_type") == "error", "N").otherwise("P").alias("label")
    )
    return customers.unionByName(others).groupBy("id").agg(F.min("label").alias("label"))


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled points: label 1 for a returned line item, four features."""
    return table(spark, sf_dir, "lineitem").select(
        F.when(F.col("l_returnflag") == "R", 1.0).otherwise(0.0).alias("label"),
        F.col("l_quantity").alias("quantity"),
        F.col("l_extendedprice").alias("price"),
        F.col("l_discount").alias("discount"),
        F.col("l_tax").alias("tax"),
    )


FEATURES = ["quantity", "price", "discount", "tax"]
