"""The corpus pipeline: language, exact and near copies, benchmark passages, packing.

Each stage takes the documents that the one before kept, as Parquet, and all but the
last return rows and columns of ``documents`` unchanged, whatever other columns these have. Decisions are made by row, not by identifier:
rows that share an identifier but not the text are documents of their own, and rows that share both are one
document, of which the stages that choose one row of a group keep one. A null identifier counts as the smallest where the largest is kept
and as the largest where the smallest is; a group of such rows only keeps one. Null and empty texts are rejected by the first stage; the later ones treat
null as empty. An empty table gives no rows, and texts of any length are handled whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from topicweft.llm.common import Scratch, benchmark, documents, lower_ascii, remainder, whole_text
from topicweft.llm.decontaminate import contamination
from topicweft.llm.exact_dedup import exact_duplicates
from topicweft.llm.language_id import fit_languages, identify_languages
from topicweft.llm.near_join import near_classes
from topicweft.llm.packing import pack


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents whose language is told with enough confidence."""
    model = fit_languages(docs, "doc_id", "text", "lang", remainder("doc_id", 4) != 2)
    names = {c: f"c{i}" for i, c in enumerate(docs.columns)}  # clash with no column of the operator
    told = identify_languages(docs.select(*[F.col(c).alias(n) for c, n in names.items()]), model, text=names["text"])
    return told.filter("not rejected").select(*[F.col(n).alias(c) for c, n in names.items()])


def _only(docs: DataFrame, key: Column, kept: DataFrame) -> DataFrame:
    """Rows whose key is among the kept ones (column ``key``), one row of each key."""
    names = docs.columns
    rows = docs.select(F.struct(*names).alias("row"), key.alias("key"))
    return rows.join(kept.select("key").distinct(), "key", "left_semi").dropDuplicates(["key"]).select("row.*")


def _key(identifier: str, version: Column) -> Column:
    """A row's identifier and a hash of its text as one value that is never null."""
    return F.concat(F.coalesce(F.col(identifier).cast("string"), F.lit("")), F.lit(":"), version.cast("string"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts keep the row with the largest identifier."""
    found = exact_duplicates(docs.select("doc_id", "text"), keep="largest")
    digest = F.sha2(lower_ascii(whole_text("text")), 256)
    return _only(docs, _key("doc_id", digest), found.select(_key("keep_id", F.col("text_sha256")).alias("key")))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near copies keep the row with the smallest identifier."""
    found = near_classes(docs.select("doc_id", "text"))
    version = F.xxhash64("doc_id", whole_text("text"))
    return _only(docs, _key("doc_id", version), found.filter("first").select(_key("doc_id", F.col("row")).alias("key")))


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a window of a benchmark item."""
    names, key = docs.columns, _key("doc_id", F.xxhash64(whole_text("text")))
    found = contamination(docs.select(key.alias("key"), "text"), benchmark(spark, sf_dir), doc="key")
    hit = found.filter(F.size("hits") > 0).select(F.col("doc_id").alias("key")).distinct()
    rows = docs.select(F.struct(*names).alias("row"), key.alias("key"))
    return rows.join(hit, "key", "left_anti").select("row.*")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Place every document in sequences."""
    return pack(docs.select("doc_id", "text"))


STAGES = [
    ("language_id", language), ("exact_dedup", exact), ("near_dedup", near),
    ("decontamination", decontaminated), ("packing", packed),
]

#: Language identification and tokenising can't be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = scratch.save(stage(spark, docs, sf_dir), name)
    return docs
