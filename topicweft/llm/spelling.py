"""Spelling variants: words one edit apart, found by a frontier that walks a trie of the words.

The trie is a table of paths (node, next): the node is a prefix itself, and a path has the next characters below it, a fixed number of them
or fewer where a word ends. States (word, position, node) have made their edit and must go on by the word's characters from the position.
A state is made where the word leaves out its next character, or takes another child of its node; only paths of ``AHEAD`` edges that lead on
are taken, so the words of a node are grouped by the characters that come after the changed one: a group's characters there are the
children that can be taken, and a path of the node itself lets the character be left out. From there on all states, of all
levels at once, walk along the trie in strides that double, each a join with the paths of that length, written to the
shared folder; where a path ends a word that the state's word ends with, the two are neighbours. One of two neighbours leaves out a
character of the longer word or takes the greater character, so each pair is found once
and turned round afterwards; an inserted character is the other word's left-out one.

The number of strides is the logarithm of the longest word's length, at most ``deepest``. Pairs with a longer word
are found from hashes of the word without each of its characters, one row per character: equal hashes at
the same place are a replacement, equality with a whole word is a deletion. Groups of these are counted, never paired.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.ranges import dense_index
from .bytetext import LOWERED, U, mixed, powers, prefix_sums
from .common import Scratch, documents, small_batches

SHORTEST = 7
FEWEST = 2
FACTOR = 10
MUTATED = 31
DEEPEST = 64
AHEAD = 3  # edges that an edit is followed at once
CACHE_BYTES = 32 << 20
TO_LOWER = LOWERED.tobytes()


def _word_counts(shortest: int, mutated: int):
    run = re.compile("[a-zÀ-ÿ]{%d,}" % shortest)

    def table(counts: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], ["word", "n"])

    def word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Words and their occurrences, folded up to a number of bytes."""
        counts, size = Counter(), 0
        for batch in batches:
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                text = text.as_py()
                if not text:
                    continue
                lowered = text.encode().translate(TO_LOWER).decode()
                name = "" if doc is None else str(doc)
                for word, n in Counter(m.group() for m in run.finditer(lowered)).items():
                    code = zlib.crc32(f"{name}:{word}".encode())
                    if code % mutated == 0:
                        at = code % len(word)
                        word = word[:at] + word[at + 1 :]
                        if len(word) < shortest:
                            continue
                    if word not in counts:
                        size += len(word) + 100
                    counts[word] += n
                if size > CACHE_BYTES:
                    yield table(counts)
                    counts, size = Counter(), 0
        if counts:
            yield table(counts)

    return word_counts


def words_of(docs: DataFrame, doc: str = "doc_id", text: str = "text", shortest: int = SHORTEST, mutated: int = MUTATED) -> DataFrame:
    """word, n: runs of letters of at least ``shortest`` code points after the mutation that the
    crc32 of ``<doc_id>:<run>`` chooses (a null identifier as an empty one), and their occurrences."""
    texts = docs.select(F.col(doc).alias("doc_id"), F.col(text).alias("text"))
    found = texts.mapInArrow(_word_counts(shortest, mutated), "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n"))


def _paths(words: DataFrame, edges: int, least: int = 0) -> DataFrame:
    """node, next: the prefixes of at least ``least`` characters, and the ``edges`` characters that follow (fewer at a word's end)."""
    levels = words.filter(F.col("length") >= least).select("word", F.explode(F.sequence(F.lit(least), "length")).alias("level"))
    return levels.select(F.expr("substring(word, 1, level)").alias("node"), F.expr(f"substring(word, level + 1, {edges})").alias("next"))


def trie_pairs(words: DataFrame, scratch: Scratch) -> DataFrame:
    """word, other: each pair of words one edit apart once. ``words`` has the columns word, length."""
    longest = words.agg(F.max("length")).first()[0]
    if longest is None:
        return words.select("word", F.col("word").alias("other")).limit(0)
    words = words.repartition(int(words.sparkSession.conf.get("spark.sql.shuffle.partitions")), "word")
    levels = words.filter("length > 0").select("word", F.explode(F.expr("sequence(0, length - 1)")).alias("level"))
    after = levels.select(
        "word", "level", F.expr("substring(word, 1, level)").alias("node"), F.expr("substring(word, level + 1, 1)").alias("own"),
        F.expr(f"substring(word, level + 2, {AHEAD})").alias("next"),
    )
    below = after.select("node", "next", "own").unionByName(_paths(words, AHEAD).withColumn("own", F.lit("")))
    children = below.groupBy("node", "next").agg(F.collect_set("own").alias("chars")).filter(F.size("chars") > 1)
    first_of_run = (F.col("level") == 0) | (F.col("own") != F.expr("substring(word, level, 1)"))  # equal characters are left out once
    other = F.filter("chars", lambda c: (c > F.col("own")) | ((c == "") & first_of_run))
    edited = after.join(children, ["node", "next"]).select("word", "level", "node", "next", F.explode(other).alias("ch"))
    states = scratch.save(edited.select(
        "word", (F.col("level") + 1 + AHEAD).alias("position"), F.concat("node", "ch", "next").alias("node"), (F.length("next") < AHEAD).alias("done")
    ), "states/step=0")
    step, least, stride = 0, AHEAD, 2 * AHEAD
    while least <= longest:  # a node has at least as many characters as edges have been followed
        step += 1
        moving = states.filter("not done").select("word", "position", "node", F.expr(f"substring(word, position + 1, {stride})").alias("next"))
        kept = moving.join(_paths(words, stride, least).distinct(), ["node", "next"])
        states = scratch.save(kept.select(
            "word", (F.col("position") + stride).alias("position"), F.concat("node", "next").alias("node"), (F.length("next") < stride).alias("done")
        ), f"states/step={step}")
        least, stride = least + stride, 2 * stride
    states = scratch.table("states", "word string, position int, node string, done boolean, step int")
    return states.filter("done").select("word", F.col("node").alias("other"))


KEYS = "kind int, place long, k1 long, k2 long, rank long, n long"


def _long_keys(deepest: int):
    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """128-bit hashes of each word (kind 0), and of a longer one without each character: at its
        place (kind 1), and once per run of equal characters for the word that is left (kind 2)."""
        for batch in batches:
            for word, rank, n in zip(*(batch.column(c).to_pylist() for c in ("word", "rank", "n"))):
                points = np.frombuffer(word.encode("utf-32-le"), np.uint32).astype(U)
                size, back = len(points), powers(len(points))[1][1]
                whole, without = [], []
                for salt in (U(1), U(1 << 40)):
                    sums = prefix_sums(mixed(points + salt))
                    whole.append(mixed(sums[-1:] + U(size)))
                    without.append(mixed(sums[:-1] + (sums[-1] - sums[1:]) * back + U(size - 1)))
                new = np.ones(size, bool)
                new[1:] = points[1:] != points[:-1]
                parts = [(0, np.zeros(1, np.int64), whole)]
                if size > deepest:
                    parts += [(1, np.arange(size), without), (2, np.zeros(int(new.sum()), np.int64), [k[new] for k in without])]
                for kind, place, (k1, k2) in parts:
                    fixed = [pa.array(np.full(len(place), v)) for v in (rank, n)]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(place), kind, np.int32)), pa.array(place), pa.array(k1.view(np.int64)), pa.array(k2.view(np.int64)), *fixed],
                        ["kind", "place", "k1", "k2", "rank", "n"],
                    )

    return keys


def long_neighbours(words: DataFrame, scratch: Scratch, deepest: int) -> DataFrame:
    """word, n_near, best (the negative count of the most frequent neighbour, and that word) for
    the pairs in which a word has more than ``deepest`` code points."""
    ranked = scratch.save(dense_index(words.filter(F.col("length") >= deepest).select("word", "n"), "word", "rank"), "long-words")
    keys = scratch.save(ranked.select("word", "rank", "n").mapInArrow(_long_keys(deepest), KEYS), "long-keys")
    item = F.struct((-F.col("n")).alias("n"), F.col("rank"))
    replaced = keys.filter("kind = 1")
    groups = replaced.groupBy("place", "k1", "k2").agg(F.count(F.lit(1)).alias("size"), F.min(item).alias("best")).filter("size > 1")
    same = replaced.join(groups, ["place", "k1", "k2"]).select("rank", (F.col("size") - 1).alias("n_near"), F.when(F.col("best.rank") != F.col("rank"), F.col("best")).alias("best"))
    left = keys.filter("kind = 2").select("k1", "k2", F.col("rank").alias("longer"), F.col("n").alias("longer_n"))
    pairs = scratch.save(left.join(keys.filter("kind = 0").select("k1", "k2", "rank", "n"), ["k1", "k2"]), "long-pairs")
    one = F.lit(1).cast("long").alias("n_near")
    shorter = pairs.select("rank", one, F.struct((-F.col("longer_n")).alias("n"), F.col("longer").alias("rank")).alias("best"))
    longer = pairs.select(F.col("longer").alias("rank"), one, item.alias("best"))
    folded = same.unionByName(shorter).unionByName(longer).groupBy("rank").agg(F.sum("n_near").alias("n_near"), F.min("best").alias("best"))
    names = ranked.select(F.col("rank").alias("_rank"), F.col("word").alias("_best"))
    named = folded.join(ranked.select("rank", "word"), "rank").join(names, F.col("best.rank") == F.col("_rank"), "left")
    return named.select("word", "n_near", F.when(F.col("_best").isNotNull(), F.struct(F.col("best.n").alias("n"), F.col("_best").alias("word"))).alias("best"))


def last_forms(forms: DataFrame, scratch: Scratch) -> DataFrame:
    """word, root from word, form: forms followed to the last by doubling. A form is at least twice as
    frequent as its word, so that chains are short and have an end."""
    now, step, moved = scratch.save(forms.select("word", F.col("form").alias("root")), "roots-0"), 0, True
    while moved:
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        step += 1
        after = scratch.save(now.join(ahead, "root", "left").select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("moved")), f"roots-{step}")
        moved = not after.filter("moved").isEmpty()
        now = after.select("word", "root")
    return now


def spelling_groups(
    words: DataFrame, fewest: int = FEWEST, shortest: int = SHORTEST, factor: int = FACTOR, deepest: int = DEEPEST
) -> DataFrame:
    """word, n, n_near, form, form_n, root for the words (``word``, ``n``, no word twice) of at least ``shortest`` code
    points and ``fewest`` occurrences.

    ``n_near`` counts the words one edit away (a code point inserted, deleted or replaced). The form is the most
    frequent of these (the smallest in code-point order on ties) if it is ``factor`` (2 or more) times as
    frequent, else null; the root follows forms to the last, and is the word itself without one.
    Null words are left out, an empty table gives no rows, and words of any length are compared. Other columns are ignored.
    """
    if factor < 2:
        raise ValueError("factor must be at least 2")
    scratch = Scratch(words.sparkSession, "spelling")
    length = F.length("word").alias("length")
    listed = scratch.save(words.select("word", "n", length).filter((F.col("n") >= fewest) & (F.col("length") >= shortest)), "words")
    once = trie_pairs(listed.filter(F.col("length") <= deepest).select("word", "length"), scratch)
    pairs = once.unionByName(once.select(F.col("other").alias("word"), F.col("word").alias("other")))
    other = listed.select(F.col("word").alias("other"), F.col("n").alias("other_n"))
    item = F.struct((-F.col("other_n")).alias("n"), F.col("other").alias("word"))
    near = pairs.join(other, "other").groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(item).alias("best"))
    if not listed.filter(F.col("length") > deepest).isEmpty():
        both = near.unionByName(long_neighbours(listed, scratch, deepest))
        near = both.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min("best").alias("best"))
    enough = -F.col("best.n") >= factor * F.col("n")
    known = scratch.save(
        listed.join(near, "word", "left").select(
            "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
            F.when(enough, F.col("best.word")).alias("form"), F.when(enough, -F.col("best.n")).alias("form_n"),
        ), "known",
    )
    roots = last_forms(known.filter("form is not null"), scratch)
    return known.join(roots, "word", "left").withColumn("root", F.coalesce("root", "word"))


def spelling_variants(docs: DataFrame, doc: str = "doc_id", text: str = "text", **settings) -> DataFrame:
    """``spelling_groups`` of the words of whole texts: letters ``A-Z a-z U+00C0-U+00FF``, A-Z lower-cased, with the
    one-in-31 deletions of ``words_of``. Null and empty texts have no words; rows that repeat
    count as often as they are there; an empty table gives no rows. A text of any length is handled in one row."""
    small_batches(docs.sparkSession)
    shortest = settings.get("shortest", SHORTEST)
    return spelling_groups(words_of(docs, doc, text, shortest), **settings)


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spelling_variants(documents(spark, sf_dir))
    return rows.select("word", "form", "root", "n", "n_near", "form_n")
