"""Token counts by a map-side two-tier lookup.

A pre-token here is a run of characters between ASCII white space. The tokenizer
drops white space and never joins characters across it, so a text's tokens are those
of its pre-tokens. The lengths of frequent pre-tokens are broadcast as one compact
table; each Python worker keeps a bounded cache for the others and encodes, in
batches, what neither holds. No pre-token is shuffled: the only aggregation is the one
over the bounded sample that fills the broadcast table, which affects speed alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import documents, small_batches, whole_text

TABLE_ROWS = 65_536
SAMPLE_ROWS = 4_000
CACHE_ROWS = 400_000
BLANKS = " \t\n\r\x0b\x0c"
TO_BLANK = str.maketrans("\t\n\r\x0b\x0c", "     ")


class Lengths(dict):
    """Pre-token lengths of one worker: the broadcast table first, then what it met itself."""

    def __init__(self, path: str, table: dict[str, int]):
        super().__init__(table)
        self.encoder = Tokenizer.from_file(path)
        self.table = table

    def learn(self, words) -> None:
        """Encode the words not held yet; forget earlier ones when there are too many."""
        if len(self) > len(self.table) + CACHE_ROWS:
            self.clear()
            self.update(self.table)
        new = [w for w in words if w not in self]
        for start in range(0, len(new), 20_000):
            part = new[start : start + 20_000]
            for word, found in zip(part, self.encoder.encode_batch_fast(part, add_special_tokens=False)):
                self[word] = len(found)


_WORKER: dict[str, Lengths] = {}


def _lengths(path: str, table: dict[str, int]) -> Lengths:
    """One table per worker process and vocabulary, kept from task to task."""
    if path not in _WORKER:
        _WORKER[path] = Lengths(path, table)
    return _WORKER[path]


def count_texts(texts: list[str], lengths: Lengths) -> list[int]:
    """Token counts of whole texts, a few megabytes of text at a time."""
    out: list[int] = []
    start = 0
    while start < len(texts):
        size, end = 0, start
        while end < len(texts) and (end == start or size < 1 << 20):
            size += len(texts[end])
            end += 1
        split = [t.translate(TO_BLANK).split(" ") for t in texts[start:end]]
        lengths.learn(set(chain.from_iterable(split)))
        look = lengths.__getitem__
        out += [sum(map(look, words)) for words in split]
        start = end
    return out


def frequent_pretokens(docs: DataFrame, doc: str, text: str, sample_rows: int, table_rows: int) -> list[str]:
    """The most frequent pre-tokens of a sample of about so many rows, chosen by a hash of
    identifier and text (any sample gives the same counts)."""
    share = min(1.0, sample_rows / max(docs.count(), 1))
    sample = docs.select(F.col(doc).alias("_d"), whole_text(text).alias("_t")).filter(
        (F.pmod(F.xxhash64("_d", "_t"), F.lit(1 << 30)) < int(share * (1 << 30))) & (F.octet_length("_t") < 100_000)
    )
    words = sample.select(F.explode(F.split("_t", f"[{BLANKS}]+")).alias("w")).filter(F.length("w").between(1, 64))
    top = words.groupBy("w").count().orderBy(F.desc("count"), "w").limit(table_rows)
    return [r["w"] for r in top.select("w").collect()]


def token_counts(
    docs: DataFrame, doc: str = "doc_id", text: str = "text", vocabulary: str | None = None, limit: int = 2048,
    sample_rows: int = SAMPLE_ROWS, table_rows: int = TABLE_ROWS,
) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit per input row, in no order.

    The counts are those of the whole text by the tokenizer file ``vocabulary`` without
    begin, end or added special tokens, nothing cut; special strings in a text count as
    the library's default has them. Null and empty texts have 0 bytes and tokens. Rows
    with repeated or null identifiers are rows of their own; an empty table gives no rows, a text of
    any length is counted whole. Other columns are ignored.
    """
    spark = docs.sparkSession
    small_batches(spark)
    path = vocabulary or public_tokenizers.path("word_bpe_49k.json")
    words = frequent_pretokens(docs, doc, text, sample_rows, table_rows)
    found = Tokenizer.from_file(path).encode_batch_fast(words, add_special_tokens=False)
    table = spark.sparkContext.broadcast({"": 0} | {w: len(x) for w, x in zip(words, found)})

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths = _lengths(path, table.value)
        for batch in batches:
            n = pa.array(count_texts(batch.column(2).to_pylist(), lengths), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), n], ["doc_id", "n_bytes", "n_tokens"])

    rows = docs.select(
        F.col(doc).alias("doc_id"), F.octet_length(whole_text(text)).cast("long").alias("n_bytes"),
        whole_text(text).alias("text"),
    )
    kind = rows.schema["doc_id"].dataType.simpleString()
    counted = rows.mapInArrow(count, f"doc_id {kind}, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(documents(spark, sf_dir))
