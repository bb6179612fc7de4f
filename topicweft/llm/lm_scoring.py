"""Language-model scoring by deleted interpolation.

The probability of a token mixes the maximum-likelihood estimates of its bigram and its
unigram and a uniform share, with weights that depend on how often the context (the token
before) occurred. The weights are learned by expectation-maximisation: part of the
training documents is deleted from the counts, and what the rest says of their tokens is
the held-out evidence. Final estimates count all training documents.

Words never travel as rows. Documents fall into blocks of some megabytes by a hash; each
block asks for the counts of its distinct n-grams, and says what it adds to them, in one
packed row for each range of n-gram hashes. A range's task adds up and answers in the same
order. An n-gram of any frequency appears once for each block. Blocks and ranges grow
in number with the input, not in size. Tokens are known by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bytetext import NOT_SPACE, U, chunks, mixed, word_hashes
from .common import Scratch, documents, remainder, small_batches, total, whole_text
from .repeats import free_shuffles, range_starts

BLOCK_BYTES = 8 << 20
END = mixed(np.array([0x656E64], U))[0]
TEST, HELD, KEPT = 0, 1, 2
BUCKETS = 24  # of context counts: powers of two
FINE = 4  # histogram cells per octave of an estimate's ratio to the uniform share
DELETED = 10  # one training document in so many is deleted while weights are learned
ROUNDS = 40


def tokens(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes of all rows, each row closed by END, and where rows begin (one more entry)."""
    parts, counts = [np.zeros(0, U)], []
    for _, data, ends in chunks(table.to_batches()):
        hashes, _, _, first = word_hashes(data, ends, NOT_SPACE)
        parts.append(np.insert(hashes, first[1:], END))
        counts.append(np.diff(first) + 1)
    return np.concatenate(parts), np.concatenate([[0], np.cumsum(np.concatenate([np.zeros(0, np.int64), *counts]))])


def grams(token: np.ndarray) -> list[np.ndarray]:
    """Hashes of the unigram and the bigram that end at each token. Rows end with END, so
    the token before a row's first one is END, too."""
    before = np.concatenate([[END], token[:-1]]) if len(token) else token
    return [token, mixed(before * U(0x9FB21C651E98DF25) + token)]


def packed(values: np.ndarray) -> bytes:
    """Numbers as compressed planes of their bytes: high bytes of small numbers are all zero."""
    planes = np.ascontiguousarray(values.view(np.uint8).reshape(len(values), values.itemsize).T)
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpacked(data: bytes, kind) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    return np.ascontiguousarray(planes.reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def packed_keys(keys: np.ndarray) -> bytes:
    """Sorted keys as their differences."""
    return packed(np.diff(keys, prepend=U(0)))


def unpacked_keys(data: bytes) -> np.ndarray:
    return np.cumsum(unpacked(data, U), dtype=U)


ASK = "part int, kind int, block int, keys binary, counted binary, deleted binary"


def _ask(ranges: int):
    def ask(table: pa.Table) -> pa.Table:
        token, starts = tokens(table)
        role = np.repeat(table.column("role").to_numpy(), np.diff(starts))
        block = table.column("block")[0].as_py()
        rows: list[tuple] = []
        for kind, keys in enumerate(grams(token), 1):
            keys, inverse = np.unique(keys, return_inverse=True)
            counted = np.bincount(inverse[role != TEST], minlength=len(keys)).astype(np.int32)
            deleted = np.bincount(inverse[role == HELD], minlength=len(keys)).astype(np.int32)
            cut = range_starts(keys, ranges)
            for p in np.flatnonzero(np.diff(cut)).tolist():
                a, b = cut[p], cut[p + 1]
                rows.append((p, kind, block, packed_keys(keys[a:b]), packed(counted[a:b]), packed(deleted[a:b])))
        return pa.Table.from_pylist([dict(zip(("part", "kind", "block", "keys", "counted", "deleted"), r)) for r in rows], _schema(ASK))

    return ask


def _schema(fields: str) -> pa.Schema:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "double": pa.float64(), "boolean": pa.bool_()}
    return pa.schema([(f.split()[0], kinds[f.split()[1]]) for f in fields.split(", ")])


#: use "score": counts of all training documents, in the order of the block's keys; "fit":
#: counts without the deleted documents, for keys that those of the block hold; "size": totals
ANSWER = "use int, part int, kind int, block int, keys binary, counts binary, total long, distinct long"
SCORE, FIT, SIZE, SIZE_KEPT = 0, 1, 2, 3


def answer(table: pa.Table) -> pa.Table:
    rows = table.to_pylist()
    out = []
    for kind in (1, 2):
        own = [r for r in rows if r["kind"] == kind]
        if not own:
            continue
        asked = [unpacked_keys(r["keys"]) for r in own]
        counted = [unpacked(r["counted"], np.int32) for r in own]
        deleted = [unpacked(r["deleted"], np.int32) for r in own]
        keys, inverse = np.unique(np.concatenate(asked), return_inverse=True)
        sums = [np.bincount(inverse, np.concatenate(x), len(keys)).astype(np.int64) for x in (counted, deleted)]
        sums[1] = sums[0] - sums[1]  # without the deleted documents
        if kind == 1:
            out += [(use, own[0]["part"], kind, -1, None, None, int(s.sum()), int((s > 0).sum())) for use, s in zip((SIZE, SIZE_KEPT), sums)]
        at = 0
        for r, k, held in zip(own, asked, deleted):
            mine = inverse[at : at + len(k)]
            at += len(k)
            out.append((SCORE, r["part"], kind, r["block"], None, packed(sums[0][mine].astype("<u4")), None, None))
            held = held > 0
            if held.any():
                out.append((FIT, r["part"], kind, r["block"], packed_keys(k[held]), packed(sums[1][mine[held]].astype("<u4")), None, None))
    names = ("use", "part", "kind", "block", "keys", "counts", "total", "distinct")
    return pa.Table.from_pylist([dict(zip(names, r)) for r in out], _schema(ANSWER))


def estimates(count1, count2, context, n: int, v: int) -> tuple[np.ndarray, np.ndarray, float]:
    """Maximum-likelihood estimates of bigram and unigram, and the uniform share."""
    two = np.where(context > 0, count2 / np.maximum(context, 1), 0.0)
    return two, count1 / max(n, 1), 1 / (v + 1)


def bucket_of(context: np.ndarray) -> np.ndarray:
    """0 for an unseen context, then one bucket for each power of two."""
    return np.minimum(np.ceil(np.log2(context + 1.0)), BUCKETS - 1).astype(np.int64)


def _gathered(table: pa.Table, kind: int) -> tuple[np.ndarray, np.ndarray]:
    rows = sorted((r for r in table.to_pylist() if r["kind"] == kind), key=lambda r: r["part"])
    keys = [unpacked_keys(r["keys"]) for r in rows if r["keys"] is not None]
    counts = [unpacked(r["counts"], "<u4") for r in rows]
    return np.concatenate([np.zeros(0, U), *keys]), np.concatenate([np.zeros(0, np.int64), *counts])


CELL = "bucket int, two int, one int, n long"


def _evidence(n: int, v: int):
    def cells(_, left: pa.Table, right: pa.Table) -> pa.Table:
        """Held-out tokens of a block by context bucket and the sizes of the two estimates."""
        if not left.num_rows:
            return pa.Table.from_pylist([], _schema(CELL))
        token, _ = tokens(left)
        counts = []
        for kind, keys in enumerate(grams(token), 1):
            known, found = _gathered(right, kind)
            counts.append(found[np.searchsorted(known, keys)])
        end = int(counts[0][-1])
        context = np.concatenate([[end], counts[0][:-1]])
        two, one, uniform = estimates(counts[0], counts[1], context, n, v)
        fine = [np.where(x > 0, np.round(FINE * np.log2(np.maximum(x, 1e-300) / uniform)), -9999).astype(np.int64) for x in (two, one)]
        seen, size = np.unique(np.stack([bucket_of(context), *fine]), axis=1, return_counts=True)
        return pa.table({"bucket": seen[0], "two": seen[1], "one": seen[2], "n": size}).cast(_schema(CELL))

    return cells


def learn_weights(cells: list, rounds: int = ROUNDS) -> np.ndarray:
    """Weights (bigram, unigram, uniform) per bucket by expectation-maximisation; a
    bucket starts from the weights that all buckets have together."""

    def fit(rows: np.ndarray, start: np.ndarray) -> np.ndarray:
        values = np.stack([*(np.where(rows[:, k] == -9999, 0.0, 2.0 ** (rows[:, k] / FINE)) for k in (1, 2)), np.ones(len(rows))], axis=1)
        weights = start
        for _ in range(rounds):
            share = values * weights
            share /= share.sum(axis=1, keepdims=True)
            weights = np.maximum((share * rows[:, 3:4]).sum(axis=0) / rows[:, 3].sum(), 1e-9)
            weights = weights / weights.sum()
        return np.maximum(weights, [0, 0, 1e-6])

    table = np.array([(c["bucket"], c["two"], c["one"], c["n"]) for c in cells], float).reshape(-1, 4)
    shared = fit(table, np.array([0.5, 0.4, 0.1])) if len(table) else np.array([0.5, 0.4, 0.1])
    out = np.tile(shared, (BUCKETS, 1))
    for b in range(BUCKETS):
        rows = table[table[:, 0] == b]
        if len(rows):
            out[b] = fit(rows, shared)
    out[0] = [0, *(out[0][1:] / out[0][1:].sum())]
    return out / out.sum(axis=1, keepdims=True)


SCORED = "n_tokens long, n_known long, base_score double, score double"


def _score(n: int, v: int, weights: np.ndarray):
    def score(_, left: pa.Table, right: pa.Table) -> pa.Table:
        token, starts = tokens(left)
        if not left.num_rows:
            none = pa.Table.from_pylist([], _schema(SCORED))
            return pa.table({"doc_id": left.column("doc_id"), "role": left.column("role"), **{c: none.column(c) for c in none.column_names}})
        counts = []
        for kind, keys in enumerate(grams(token), 1):
            _, inverse = np.unique(keys, return_inverse=True)
            counts.append(_gathered(right, kind)[1][inverse])
        context = np.concatenate([counts[0][-1:], counts[0][:-1]])  # the last token is END
        two, one, uniform = estimates(counts[0], counts[1], context, n, v)
        w = weights[bucket_of(context)] if n else np.tile([0.0, 0.0, 1.0], (len(token), 1))
        mixture = np.log10(w[:, 0] * two + w[:, 1] * one + w[:, 2] * uniform)
        base = np.log10((counts[0] + 1) / (n + v + 1))
        at = starts[:-1]
        return pa.table({
            "doc_id": left.column("doc_id"), "role": left.column("role"), "n_tokens": np.diff(starts),
            "n_known": np.add.reduceat((counts[0] > 0).astype(np.int64), at),
            "base_score": np.add.reduceat(base, at), "score": np.add.reduceat(mixture, at),
        })

    return score


def score_texts(
    docs: DataFrame, learn, doc: str = "doc_id", text: str = "text", deleted: int = DELETED, block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """One row per input row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    ``learn`` is a condition on the input's columns; rows where it is false or null are
    held out: scored, but not counted. Tokens are the words between ASCII white space
    after lower-casing A-Z, and one end; null and blank texts have the end only.
    ``base_score`` is the add-one unigram score, ``score`` the mixture's, both as sums of
    log10. Without training rows every token is as likely as the unknown one. Rows with
    null or repeated identifiers are rows of their own; an empty table gives no rows, a text of
    any length is scored whole. Other columns are ignored.
    """
    spark = docs.sparkSession
    small_batches(spark)
    scratch = Scratch(spark, "lm")
    role = F.when(F.coalesce(learn, F.lit(False)), F.when(F.pmod(F.xxhash64(F.col(doc), F.lit(3)), F.lit(deleted)) == 0, HELD).otherwise(KEPT)).otherwise(TEST)
    rows = docs.select(F.col(doc).alias("doc_id"), whole_text(text).alias("text"), role.alias("role"))
    blocks = max(1, -(-total(rows, F.octet_length("text") + 8) // block_bytes))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).cast("int"))
    asked = rows.select("block", "text", "role").groupBy("block").applyInArrow(_ask(blocks), ASK)
    answers = scratch.save(asked.groupBy("part").applyInArrow(answer, ANSWER), "answers")
    free_shuffles(spark)
    sizes = {r["use"]: r for r in answers.filter("block = -1").groupBy("use").agg(F.sum("total").alias("n"), F.sum("distinct").alias("v")).collect()}
    n, v = ((sizes[SIZE]["n"], sizes[SIZE]["v"]) if sizes else (0, 0))
    kept_n, kept_v = ((sizes[SIZE_KEPT]["n"], sizes[SIZE_KEPT]["v"]) if sizes else (0, 0))
    cells = (
        rows.filter(F.col("role") == HELD).select("block", "text").groupBy("block")
        .cogroup(answers.filter(F.col("use") == FIT).select("block", "part", "kind", "keys", "counts").groupBy("block"))
        .applyInArrow(_evidence(kept_n, kept_v), CELL)
        .groupBy("bucket", "two", "one").agg(F.sum("n").alias("n")).collect()  # a bounded histogram
    )
    weights = learn_weights(cells)
    free_shuffles(spark)
    kind = rows.schema["doc_id"].dataType.simpleString()
    return (
        rows.groupBy("block")
        .cogroup(answers.filter(F.col("use") == SCORE).select("block", "part", "kind", "keys", "counts").groupBy("block"))
        .applyInArrow(_score(n, v, weights), f"doc_id {kind}, role int, {SCORED}")
        .select(
            "doc_id", (F.col("role") == TEST).alias("held_out"), "n_tokens", "n_known",
            F.lit(n).cast("long").alias("train_tokens"), "base_score", "score",
        )
    )


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(documents(spark, sf_dir), remainder("doc_id", 7) != 2)
