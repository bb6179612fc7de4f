"""Repeated lines across documents.

Lines are exploded with their position, normalised and hashed (128 bits). Per hash the
distinct documents are counted, in two steps (hash and document, then hash), so that a
line in a third of all documents is folded before it meets. Lines over the threshold are
dropped in all documents but the one of the largest identifier, and each document is
put together again from the positions that stay. Only hashes and positions of long
enough lines are shuffled, and each text once, whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.skew import HotKeys
from .common import Scratch, documents, lower_ascii, whole_text

SHORTEST = 20
FEWEST = 3
BLANK = " \t\n\x0b\f\r"


def line_key(line: Column) -> Column:
    """The line without ASCII white space at its ends, A-Z lower-cased."""
    return lower_ascii(F.btrim(line, F.lit(BLANK)))


def line_dedup(
    docs: DataFrame, doc: str = "doc_id", text: str = "text", shortest: int = SHORTEST, fewest: int = FEWEST
) -> DataFrame:
    """One row per input row: doc_id, n_lines, n_dropped, kept (the text of the lines that stay).

    Lines end at each line feed. A key of at least ``shortest`` code points that
    at least ``fewest`` documents hold loses all its lines except those in the document of
    the largest identifier that holds it. Null and empty texts are one empty line; an
    empty table gives no rows. Rows that share an identifier are one document; all rows without an
    identifier are one document, smaller than every other. Identical rows get
    identical results, one each. A text of any length is one row of an array of its lines;
    other columns are ignored.
    """
    scratch = Scratch(docs.sparkSession, "lines")
    rows = docs.select(F.col(doc).alias("doc_id"), whole_text(text).alias("text"))
    rows = rows.select("doc_id", F.xxhash64("text").alias("version"), F.split("text", "\n", -1).alias("lines"))
    exploded = rows.select("doc_id", "version", F.posexplode("lines").alias("position", "line"))
    keyed = exploded.select("doc_id", "version", "position", line_key(F.col("line")).alias("key"))
    long = keyed.filter(F.length("key") >= shortest)
    lines = scratch.save(long.withColumn("key", F.unhex(F.md5(F.col("key").cast("binary")))), "lines")
    held = lines.groupBy("key").agg(
        (F.count_distinct("doc_id") + F.max(F.col("doc_id").isNull().cast("int"))).alias("documents"),
        F.max("doc_id").alias("keeper"), F.count(F.lit(1)).alias("n"),
    )
    repeated = scratch.save(held.filter(F.col("documents") >= fewest), "repeated")
    hot = HotKeys(repeated.select("key", "n"), "key")
    found = hot.join(lines, repeated.select("key", "keeper"), by=["doc_id", "version", "position"])
    gone = found.filter(~F.col("doc_id").eqNullSafe(F.col("keeper")))
    drops = gone.groupBy(F.col("doc_id").alias("_doc"), F.col("version").alias("_version")).agg(F.collect_set("position").alias("drops"))
    same = F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("version") == F.col("_version"))
    joined = rows.join(drops, same, "left")
    every = F.sequence(F.lit(0), F.size("lines") - 1)
    kept = F.when(F.col("drops").isNull(), F.col("lines")).otherwise(
        F.transform(F.array_except(every, "drops"), lambda i: F.get("lines", i))
    )
    return joined.select(
        "doc_id", F.size("lines").cast("long").alias("n_lines"),
        F.coalesce(F.size("drops"), F.lit(0)).cast("long").alias("n_dropped"), F.array_join(kept, "\n").alias("kept"),
    )


def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = line_dedup(documents(spark, sf_dir))
    return rows.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


OP11_SQL = r"""
WITH lines AS (
    SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
        unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS position
    FROM documents
), keyed AS (
    SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
    FROM lines
), repeated AS (
    SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= 20
    GROUP BY key HAVING count(DISTINCT doc_id) >= 3
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
    sha256(coalesce(string_agg(line, chr(10) ORDER BY position) FILTER (NOT gone), '')) AS kept_sha256
FROM (SELECT k.*, r.keeper IS NOT NULL AND r.keeper <> k.doc_id AS gone FROM keyed k LEFT JOIN repeated r USING (key))
GROUP BY doc_id
"""
