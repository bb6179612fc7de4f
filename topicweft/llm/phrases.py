"""Phrase collocations from count streams in prefix and suffix order.

External stream estimation (the layout of large n-gram model builders): every position of
a text gives one window of up to four words. A task sorts its windows in blocks and folds
equal ones; Spark range-partitions and sorts them in prefix order (external sort), and one
pass over each partition counts all prefixes of all windows, which are all phrases of one to
four words. Phrases that reach the least count go on, as two streams:

* prefix order: a phrase comes right before its right extensions, so one pass gives each phrase the counts of its
  beginnings, and finds the beginnings that an extension by one word nearly always continues;
* suffix order: the same over the words in reverse, for endings and left extensions.

Both streams are merge-joined on the phrase. No pass keeps more than four words of
state, and no table of counts is hashed or held by a task. Where a partition ends, the open runs (counting) or the last
count per length (streams) are written apart, and put together over one row per partition.

Words are known by 63 bits of a hash of language and word, their texts by a dictionary joined at the end.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bytetext import LOWERED, U, byte_class, chunks, mixed, rows_of, word_hashes
from .common import Scratch, documents, small_batches, whole_text

LONGEST = 4
LEAST = 30
TOP = 2_000
SCALE = 2_000_000
SHARE = 80
BLOCK_WINDOWS = 1 << 20
FILTER_BITS, FILTER_SLICE = 28, 16  # 32 MB at most, in slices of 8 KB
WORDS = ["w1", "w2", "w3", "w4"]

ENDS = byte_class(*[(ord(c), ord(c)) for c in ".,;:!?"], (0x0A, 0x0D))
INSIDE = ~(ENDS | byte_class((0x20, 0x20), (0x09, 0x09)))


def _words(batch: pa.RecordBatch, data: np.ndarray, ends: np.ndarray):
    """Identifiers (63 bits, never 0), starts and stops of a chunk's words and their rows."""
    hashes, starts, stops, first = word_hashes(data, ends, INSIDE)
    row = rows_of(first)
    code = batch.column("lang").to_numpy().view(U)
    ids = mixed(hashes ^ mixed(code)[row]) >> U(1)
    ids[ids == 0] = 1
    return ids.view(np.int64), starts, stops, row


def _vocabulary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct words of each chunk: language, identifier, text, occurrences."""
    for batch, data, ends in chunks(batches):
        ids, starts, stops, row = _words(batch, data, ends)
        if not len(ids):
            continue
        w, first, n = np.unique(ids, return_index=True, return_counts=True)
        size = stops[first] - starts[first]
        offsets = np.concatenate([[0], np.cumsum(size)])
        at = np.repeat(starts[first] - offsets[:-1], size) + np.arange(offsets[-1])
        text = pa.LargeBinaryArray.from_buffers(
            pa.large_binary(), len(w), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(LOWERED[data][at])]
        ).cast(pa.binary()).cast(pa.string())
        yield pa.RecordBatch.from_arrays(
            [pa.array(batch.column("lang").to_numpy()[row[first]]), pa.array(w), text, pa.array(n)], ["lang", "w", "word", "n"]
        )


def _filter_slice(table: pa.Table) -> pa.Table:
    bits = np.zeros(1 << FILTER_SLICE, bool)
    bits[table.column("bit").to_numpy() & ((1 << FILTER_SLICE) - 1)] = True
    return pa.table({"slice": table.column("slice")[:1], "bits": [np.packbits(bits, bitorder="little").tobytes()]})


def word_filter(frequent: DataFrame) -> np.ndarray:
    """Bits of the identifiers' low ends, sixteen bits a word and 2**28 at most. A word that is
    frequent always passes; others pass more often the fuller it is, which costs rows, not results."""
    n = frequent.count()
    bits = min(max(FILTER_SLICE, (16 * n).bit_length()), FILTER_BITS)
    marked = frequent.select(F.expr(f"w & {(1 << bits) - 1}").alias("bit")).withColumn("slice", F.shiftright("bit", FILTER_SLICE))
    out = np.zeros(1 << max(bits - 3, 0), np.uint8)
    width = 1 << (FILTER_SLICE - 3)
    for row in marked.groupBy("slice").applyInArrow(_filter_slice, "slice long, bits binary").collect():
        out[row["slice"] * width : (row["slice"] + 1) * width] = np.frombuffer(row["bits"], np.uint8)
    return out


def _fold(lang: np.ndarray, w: np.ndarray, n: np.ndarray | None = None) -> pa.RecordBatch:
    """Windows (4 x rows) sorted in prefix order with equal ones folded."""
    order = np.lexsort(w[::-1])
    w, lang = w[:, order], lang[order]
    new = np.ones(w.shape[1], bool)
    new[1:] = (w[:, 1:] != w[:, :-1]).any(axis=0)
    starts = np.flatnonzero(new)
    n = np.diff(np.append(starts, w.shape[1]))
    return pa.RecordBatch.from_arrays(
        [pa.array(lang[starts]), *[pa.array(c[starts]) for c in w], pa.array(n)], ["lang", *WORDS, "n"]
    )


def _windows(passing, block: int):
    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One window per position: the words from it on, up to four, within the piece and
        up to the first word that the filter knows to be too rare for any phrase."""
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0
        bits = passing.value
        mask = len(bits) * 8 - 1
        for batch, data, ends in chunks(batches):
            ids, starts, _, row = _words(batch, data, ends)
            if not len(ids):
                continue
            low = ids & mask
            ids = np.where((bits[low >> 3] >> (low & 7).astype(np.uint8)) & 1, ids, 0)
            piece = np.cumsum(ENDS[data], dtype=np.int64)[starts]
            w = np.zeros((LONGEST, len(ids)), np.int64)
            w[0] = ids
            for k in range(1, LONGEST):
                m = len(ids) - k
                if m > 0:
                    together = (row[k:] == row[:m]) & (piece[k:] == piece[:m]) & (w[k - 1, :m] != 0)
                    w[k, :m] = np.where(together, ids[k:], 0)
            keep = ids != 0
            held.append((batch.column("lang").to_numpy()[row[keep]], w[:, keep]))
            size += int(keep.sum())
            if size >= block:
                yield _fold(np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held], axis=1))
                held, size = [], 0
        if size:
            yield _fold(np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held], axis=1))

    return windows


GRAM_NAMES = ["lang", *WORDS, "m", "f", "edge"]
GRAMS = "lang long, w1 long, w2 long, w3 long, w4 long, m int, f long, edge boolean"


def _count(least: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Counts of all prefixes of the sorted windows. Runs open at an end of the partition are
        marked and kept whatever their count, others where they reach the least."""
        last, last_lang = None, 0
        opened, at_edge = np.zeros(LONGEST, np.int64), [True] * LONGEST

        def rows(lang, w, m, f, edge) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array(lang), *[pa.array(w[k] if k < m else np.zeros(len(lang), np.int64)) for k in range(LONGEST)],
                 pa.array(np.full(len(lang), m, np.int32)), pa.array(f), pa.array(edge)], GRAM_NAMES,
            )

        def single(m: int, f: int, edge: bool) -> pa.RecordBatch:
            return rows(np.array([last_lang]), [np.array([x]) for x in last], m, np.array([f]), np.array([edge]))

        for batch in batches:
            if not batch.num_rows:
                continue
            w = [batch.column(c).to_numpy() for c in WORDS]
            n, lang = batch.column("n").to_numpy(), batch.column("lang").to_numpy()
            sums = np.concatenate([[0], np.cumsum(n)])
            differs = np.zeros(len(n), bool)
            for j in range(LONGEST):
                differs[1:] |= w[j][1:] != w[j][:-1]
                differs[0] |= last is None or w[j][0] != last[j]
                starts = np.flatnonzero(differs)
                if not len(starts):
                    opened[j] += sums[-1]
                    continue
                if last is not None and last[j]:
                    f = int(opened[j] + sums[starts[0]])
                    if f >= least or at_edge[j]:
                        yield single(j + 1, f, at_edge[j])
                f = np.diff(sums[starts])
                inner = starts[:-1]
                edge = np.zeros(len(inner), bool)
                if last is None:
                    edge[:1] = True
                keep = (w[j][inner] != 0) & ((f >= least) | edge)
                inner = inner[keep]
                if len(inner):
                    yield rows(lang[inner], [c[inner] for c in w], j + 1, f[keep], edge[keep])
                opened[j] = sums[-1] - sums[starts[-1]]
                at_edge[j] = last is None and len(starts) == 1
            last, last_lang = [int(c[-1]) for c in w], int(lang[-1])
        if last is not None:
            for j in range(LONGEST):
                if last[j]:
                    yield single(j + 1, int(opened[j]), True)

    return count


STREAM_NAMES = ["part", "lang", *WORDS, "m", "f", "c1", "c2", "c3"]
STREAM = "part int, lang long, w1 long, w2 long, w3 long, w4 long, m int, f long, c1 long, c2 long, c3 long"


def _lockstep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of each phrase's beginnings of one to three words, in one pass over the order in
    which a beginning comes before its extensions; null where it lies in an earlier
    partition. Last comes a row without phrase: the last count of each length."""
    part = TaskContext.get().partitionId()
    carried: list[int | None] = [None] * (LONGEST - 1)
    seen = False
    for batch in batches:
        m, f = batch.column("m").to_numpy(), batch.column("f").to_numpy()
        if not len(m):
            continue
        seen, counts = True, []
        for j in range(1, LONGEST):
            at = np.maximum.accumulate(np.where(m == j, np.arange(len(m)), -1))
            value = np.where(at >= 0, f[np.maximum(at, 0)], carried[j - 1] or 0)
            counts.append(pa.array(value, mask=(m <= j) | ((at < 0) & (carried[j - 1] is None))))
            if at[-1] >= 0:
                carried[j - 1] = int(f[at[-1]])
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(m), part, np.int32)), *[batch.column(c) for c in ("lang", *WORDS, "m", "f")], *counts], STREAM_NAMES
        )
    if seen:
        kinds = [pa.int32(), *[pa.int64()] * 5, pa.int32(), *[pa.int64()] * 4]
        end = [part, *[None] * 7, *carried]
        yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(end, kinds)], STREAM_NAMES)


def _stream(grams: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """Rows of ``grams`` with the counts of their beginnings, over range partitions sorted by the words."""
    rows = scratch.save(grams.repartitionByRange(*WORDS).sortWithinPartitions(*WORDS).mapInArrow(_lockstep, STREAM), name)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    ends = rows.filter("m is null").select("part", *[F.last(f"c{j}", True).over(before).alias(f"_c{j}") for j in (1, 2, 3)])
    found = rows.filter("m is not null").join(ends, "part")
    known = [F.when(F.col("m") > j, F.coalesce(f"c{j}", f"_c{j}")).alias(f"c{j}") for j in (1, 2, 3)]
    return found.select("lang", *WORDS, "m", "f", *known)


def _turned() -> list[Column]:
    """The words of a phrase in reverse order."""
    return [
        F.coalesce(*[F.when(F.col("m") == m, F.col(f"w{m - k}")) for m in range(k + 1, LONGEST + 1)], F.lit(0)).alias(f"w{k + 1}")
        for k in range(LONGEST)
    ]


def _shorter(stream: DataFrame, share: int) -> DataFrame:
    """Phrases that an extension by one word at their end holds in at least that share of their occurrences."""
    before = F.element_at(F.array("c1", "c2", "c3"), F.col("m") - 1)
    cut = stream.filter((F.col("m") > 2) & (100 * F.col("f") >= share * before))
    return cut.select(*[F.when(F.col("m") > k + 1, F.col(w)).otherwise(0).alias(w) for k, w in enumerate(WORDS)], (F.col("m") - 1).alias("m"))


def phrase_counts(windows: DataFrame, least: int, scratch: Scratch) -> DataFrame:
    """lang, w1..w4 (0 for none), m, f: all phrases of one to four words with that count."""
    sorted_ = windows.repartitionByRange(*WORDS).sortWithinPartitions(*WORDS)
    runs = scratch.save(sorted_.mapInArrow(_count(least), GRAMS), "runs")
    edges = runs.filter("edge").groupBy("lang", *WORDS, "m").agg(F.sum("f").alias("f")).filter(F.col("f") >= least)
    return scratch.save(runs.filter("not edge").drop("edge").unionByName(edges), "grams")


def collocations(
    docs: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST, top: int = TOP, share: int = SHARE,
    block: int = BLOCK_WINDOWS,
) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the best phrases of two to four words per language.

    Texts are lower-cased (A-Z), cut at ``.,;:!?`` and line ends into pieces, and these
    at blanks and tabs into words; a null language is ``und``. A phrase's score is the least, over its cuts, of
    ``floor(2000000 * a / (l + r))``, where a, l, r count the phrase and its two parts; on ties the
    first cut counts. Phrases found fewer than ``least`` times are left out, and so are
    those of which a longer one holds at least ``share`` percent: it is enough to look at phrases
    longer by one word, as every longer one holds such a one, at least as frequent. All documents and positions are
    counted; null and empty texts have no words, and an empty table gives no rows. Rows that repeat count as often as they
    are there. A text of any length is handled in one row; other columns are ignored. Ties in score go by count, then phrase.
    """
    spark = docs.sparkSession
    small_batches(spark)
    scratch = Scratch(spark, "phrases")
    named = F.coalesce(F.col(lang), F.lit("und"))
    coded = docs.select(F.xxhash64(named).alias("lang"), named.alias("name"), whole_text(text).alias("text"))
    texts = coded.select("lang", "text")
    found = texts.mapInArrow(_vocabulary, "lang long, w long, word string, n long")
    words = scratch.save(found.groupBy("lang", "w", "word").agg(F.sum("n").alias("n")), "words")
    frequent = words.filter(F.col("n") >= least)
    passing = spark.sparkContext.broadcast(word_filter(frequent))
    windows = texts.mapInArrow(_windows(passing, block), "lang long, w1 long, w2 long, w3 long, w4 long, n long")
    grams = phrase_counts(windows, least, scratch)
    passing.unpersist()
    prefix = _stream(grams, scratch, "prefix")
    suffix = _stream(grams.select("lang", *_turned(), "m", "f"), scratch, "suffix")
    held = _shorter(prefix, share).unionByName(_shorter(suffix, share).select(*_turned(), "m")).select(*WORDS).distinct()
    endings = suffix.filter("m > 1").select(*_turned(), *[F.col(f"c{j}").alias(f"e{j}") for j in (1, 2, 3)])
    both = prefix.filter("m > 1").join(endings.hint("merge"), WORDS).join(held, WORDS, "left_anti")
    scored = scratch.save(both.select("lang", *WORDS, F.col("f").alias("a"), _least_cut().alias("cut")), "scored")
    langs = words.groupBy("lang").agg(F.sum("n").alias("n")).join(coded.select("lang", "name").distinct(), "lang")
    return _best(scored, frequent.select("w", "word"), langs, top, scratch)


def _least_cut() -> Column:
    """Score, cut and part counts of the cut with the lowest score."""
    cuts = []
    for k in (1, 2, 3):
        left, right = F.col(f"c{k}"), F.element_at(F.array("e1", "e2", "e3"), F.greatest(F.col("m") - k, F.lit(1)))
        score = F.expr(f"(cast(f as decimal(20, 0)) * {SCALE}) div cast(c{k} + element_at(array(e1, e2, e3), greatest(m - {k}, 1)) as decimal(20, 0))")
        cuts.append(F.when(F.col("m") > k, F.struct(score.alias("score"), F.lit(k).alias("k"), left.alias("l"), right.alias("r"))))
    return F.least(*cuts)


def _best(scored: DataFrame, dictionary: DataFrame, langs: DataFrame, top: int, scratch: Scratch) -> DataFrame:
    """The first ``top`` of each language. The best of each piece of the rows give a bound on score and count
    that nothing better falls below; texts are looked up for the rows that reach it, ties and all."""
    pieces = int(scored.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    rows = scored.select("lang", *WORDS, "a", "cut.score", "cut.l", "cut.r").withColumn("piece", F.pmod(F.xxhash64(*WORDS), F.lit(pieces)))

    def first(df: DataFrame, order: list[Column]) -> DataFrame:
        for keys in (["lang", "piece"], ["lang"]):
            df = df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("rank") <= top)
        return df

    by_count = [F.col("score").desc(), F.col("a").desc()]
    bound = first(rows.select("lang", "piece", "score", "a"), by_count).groupBy("lang").agg(F.min(F.struct("score", "a")).alias("bound"))
    out = rows.join(bound, "lang").filter(F.struct("score", "a") >= F.col("bound")).drop("bound")
    out = scratch.save(out, "reaching")
    for w in WORDS:
        out = out.join(dictionary.select(F.col("w").alias(w), F.col("word").alias(f"_{w}")), w, "left")
    out = out.withColumn("phrase", F.concat_ws(" ", *[f"_{w}" for w in WORDS]))
    ranked = first(out, [*by_count, F.col("phrase")])
    return ranked.join(langs, "lang").select(
        F.col("name").alias("lang"), F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score"
    )


def op12_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(documents(spark, sf_dir))


OP12_SQL = r"""
WITH pieces AS (
    SELECT coalesce(lang, 'und') AS lang, doc_id, unnest(string_split_regex(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
    FROM documents
), split AS (
    SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS words FROM pieces
), grams AS (
    SELECT lang, m, array_to_string(words[i : i + m - 1], ' ') AS phrase, count(*) AS f
    FROM (SELECT lang, words, unnest(range(1, len(words) + 1)) AS i FROM split WHERE len(words) > 0), (VALUES (1), (2), (3), (4)) AS t(m)
    WHERE i + m - 1 <= len(words)
    GROUP BY ALL
), totals AS (
    SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM grams WHERE m = 1 GROUP BY lang
), frequent AS (
    SELECT * FROM grams WHERE f >= 30
), split_phrases AS (
    SELECT lang, m, phrase, f AS a, string_split(phrase, ' ') AS words FROM frequent WHERE m > 1
), cuts AS (
    SELECT c.lang, c.phrase, c.a, k, l.f AS l, r.f AS r, CAST((2000000::HUGEINT * c.a) // (l.f + r.f) AS BIGINT) AS score
    FROM (SELECT *, unnest(range(1, m)) AS k FROM split_phrases) c
    JOIN frequent l ON l.lang = c.lang AND l.phrase = array_to_string(c.words[1 : k], ' ')
    JOIN frequent r ON r.lang = c.lang AND r.phrase = array_to_string(c.words[k + 1 :], ' ')
), least AS (
    SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS place FROM cuts
), inner_phrases AS (
    SELECT lang, a, array_to_string(words[i : i + j - 1], ' ') AS phrase
    FROM (SELECT *, unnest(range(1, m)) AS i FROM split_phrases), (VALUES (2), (3)) AS t(j)
    WHERE j < m AND i + j - 1 <= m
    UNION ALL
    SELECT lang, a, array_to_string(words[m - j + 1 :], ' ') FROM split_phrases, (VALUES (2), (3)) AS t(j) WHERE j < m
), held AS (
    SELECT DISTINCT i.lang, i.phrase FROM inner_phrases i JOIN frequent s ON s.lang = i.lang AND s.phrase = i.phrase
    WHERE 100::HUGEINT * i.a >= 80::HUGEINT * s.f
), ranked AS (
    SELECT lang, phrase, a, l, r, score,
        row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank
    FROM least WHERE place = 1 AND NOT EXISTS (SELECT 1 FROM held h WHERE h.lang = least.lang AND h.phrase = least.phrase)
)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
"""
