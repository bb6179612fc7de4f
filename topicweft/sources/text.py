"""Readers for delimited text. Each has a ``parse_*`` form over any DataFrame
with a string column ``value``, so lines may come from files or tables alike."""

from __future__ import annotations

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.text import fields, list_items, words


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of a file, a folder or a glob."""
    return spark.read.text(path)


def parse_delimited(lines: DataFrame, schema: str, sep: str = " ", arity: int | None = None,
                    columns: list[int] | None = None) -> DataFrame:
    """Lines with exactly ``arity`` fields as typed columns; others are dropped.

    ``columns`` are the field numbers of the schema's columns, by default the
    first ones. A field that is not of its type becomes null.
    """
    target = StructType.fromDDL(schema)
    numbers = columns or list(range(len(target)))
    split = lines.select(fields(F.col("value"), sep).alias("f")).filter(F.size("f") == (arity or len(target)))
    return split.select(
        *[F.get("f", F.lit(i)).try_cast(c.dataType).alias(c.name) for i, c in zip(numbers, target)]
    )


def parse_corpus(lines: DataFrame, user: int | None = 0, doc: int = 1, text: int = 2, arity: int = 3,
                 sep: str = "\t", strip_quotes: bool = False) -> DataFrame:
    """``user_id, doc_id, words`` from tab-separated lines of ``arity`` fields."""
    raw = F.regexp_replace("value", '"', "") if strip_quotes else F.col("value")
    split = lines.select(fields(raw, sep).alias("f")).filter(F.size("f") == arity)
    user_id = F.get("f", F.lit(user)) if user is not None else F.lit(None).cast("string")
    return split.select(
        user_id.alias("user_id"), F.get("f", F.lit(doc)).alias("doc_id"), words(F.get("f", F.lit(text)), " ").alias("words")
    )


def read_corpus(spark: SparkSession, path: str, **layout) -> DataFrame:
    """Three fields: user, document, words."""
    return parse_corpus(read_lines(spark, path), **layout)


def parse_document_corpus(lines: DataFrame) -> DataFrame:
    """Two fields: document number, words; double quotes removed."""
    rows = parse_corpus(lines, user=None, doc=0, text=1, arity=2, strip_quotes=True)
    return rows.withColumn("doc_id", F.col("doc_id").try_cast("bigint"))


def parse_wide_corpus(lines: DataFrame) -> DataFrame:
    """Six fields: document in field 1, words in field 5 (from 0)."""
    return parse_corpus(lines, user=None, doc=1, text=5, arity=6)


def parse_matrix(lines: DataFrame, keys: list[str], to: str = "double", value: str = "values") -> DataFrame:
    """``k, List(a, b, ...)`` or ``k1, k2, List(...)`` lines as key columns and an array."""
    head = F.split(F.regexp_extract("value", r"^(.*?), List\(", 1), ", ")
    rows = lines.select(head.alias("h"), list_items(F.col("value"), to).alias(value))
    rows = rows.filter((F.size("h") == len(keys)) & F.col(value).isNotNull())
    return rows.select(*[F.get("h", F.lit(i)).alias(k) for i, k in enumerate(keys)], value)


def parse_edges(lines: DataFrame, canonical: bool = False, partitions: int | None = None) -> DataFrame:
    """``src, dst, attr = 1`` from ``src dst`` lines; ``#`` starts a comment line.
    ``canonical`` turns every edge from the smaller to the larger id."""
    rows = lines.filter(~F.col("value").startswith("#")).select(words(F.col("value")).alias("f")).filter(F.size("f") >= 2)
    edges = rows.select(F.col("f")[0].cast("bigint").alias("src"), F.col("f")[1].cast("bigint").alias("dst"))
    if canonical:
        edges = edges.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"))
    edges = edges.withColumn("attr", F.lit(1))
    return edges.repartition(partitions) if partitions else edges


def edge_line_kinds(lines: DataFrame) -> DataFrame:
    """``kind, n``: how many lines are edges, comments, or too short to be one (these are
    left out by ``parse_edges``; ids that are no numbers raise there)."""
    short = F.size(words(F.col("value"))) < 2
    kind = F.when(F.col("value").startswith("#"), "comment").when(short, "short").otherwise("edge")
    return lines.groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"))


def read_edges(spark: SparkSession, path: str, canonical: bool = False, partitions: int | None = None) -> DataFrame:
    return parse_edges(read_lines(spark, path), canonical, partitions)


def parse_labelled_points(lines: DataFrame, n_features: int) -> DataFrame:
    """``label, features vector`` from ``label,f1,f2,...`` lines."""
    names = [f"f{i}" for i in range(1, n_features + 1)]
    schema = ", ".join(f"{c} double" for c in ["label", *names])
    return VectorAssembler(inputCols=names, outputCol="features").transform(
        parse_delimited(lines, schema, ",")
    ).select("label", "features")


def parse_count_vectors(lines: DataFrame) -> DataFrame:
    """``counts array<double>`` from lines of space-separated numbers."""
    return lines.select(F.transform(words(F.col("value"), " "), lambda x: x.cast("double")).alias("counts"))


def matrix_shape(matrix: DataFrame, key: str, value: str = "values") -> DataFrame:
    """Row key and row length of a parsed matrix."""
    return matrix.select(key, F.size(value).alias("length"))
