"""Language identification: averaged hashed subword embeddings and a linear softmax.

Subwords are the byte 3-grams and 4-grams of the text, lower-cased, with everything
that is no letter as a blank; each is hashed to a bucket with an embedding, and the mean
embedding of the whole text goes through a linear softmax. Both are trained together by
stochastic gradient descent in numpy on a bounded sample of labelled rows. As mean and
layer are linear, prediction sums one number per subword and class from the broadcast
product of embeddings and layer. A temperature and a rejection threshold are fitted on
sampled rows that training left out.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .bytetext import CHUNK, LOWERED, buffer_of, chunks
from .common import Scratch, documents, remainder, small_batches, whole_text

BITS = 16
SIZES = (3, 4)
MULTIPLIERS = {3: np.uint32(2654435761), 4: np.uint32(2246822519)}
NONE = len(SIZES) << BITS  # the bucket of subwords without letters
LETTERS = LOWERED.copy()
LETTERS[:0x41] = LETTERS[0x5B:0x61] = LETTERS[0x7B:0x80] = 0x20

DIMENSIONS = 16
EPOCHS = 6
RATE = 0.5
ROWS_PER_LANGUAGE = 750
LONGEST_SAMPLE = 1 << 16
MOST_ERRORS = 0.01
MOST_REJECTED = 0.002
UNKNOWN = "und"


def subwords(data: np.ndarray, ends: np.ndarray) -> Iterator[np.ndarray]:
    """For each subword size, the bucket at each byte; NONE where it has no letter or
    would cross a row's end."""
    letters = LETTERS[data].astype(np.uint32)
    blank = letters == 0x20
    for order, size in enumerate(SIZES):
        n = len(data) - size + 1
        out = np.full(len(data), NONE, np.int32)
        if n > 0:
            code = letters[:n].copy()
            empty = blank[:n].copy()
            for k in range(1, size):
                code |= letters[k : n + k] << np.uint32(8 * k)
                empty &= blank[k : n + k]
            found = ((code * MULTIPLIERS[size]) >> np.uint32(32 - BITS)).astype(np.int32) + (order << BITS)
            found[empty] = NONE
            out[:n] = found
            for k in range(1, size):
                crossing = ends[1:] - k
                out[crossing[crossing >= ends[:-1]]] = NONE
        yield out


def row_sums(values: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sums of each row's values; 0 for empty rows."""
    out = np.zeros(len(ends) - 1)
    full = np.flatnonzero(np.diff(ends))
    if len(full):
        out[full] = np.add.reduceat(values, ends[:-1][full], dtype=np.float64)
    return out


@dataclass
class Model:
    """``logits[c]`` holds a number per bucket (the last is 0) for class c."""

    languages: list[str]
    logits: np.ndarray
    bias: np.ndarray
    temperature: float
    threshold: float

    def probabilities(self, data: np.ndarray, ends: np.ndarray) -> np.ndarray:
        scores = np.zeros((len(ends) - 1, len(self.languages)))
        count = np.zeros(len(ends) - 1)
        for bucket in subwords(data, ends):
            count += row_sums((bucket != NONE).astype(np.float32), ends)
            for c in range(len(self.languages)):
                scores[:, c] += row_sums(self.logits[c][bucket], ends)
        return softmax((scores / np.maximum(count, 1)[:, None] + self.bias) / self.temperature)


def softmax(x: np.ndarray) -> np.ndarray:
    x = np.exp(x - x.max(axis=-1, keepdims=True))
    return x / x.sum(axis=-1, keepdims=True)


def train(texts: list[str], labels: list[str], seed: int = 7) -> Model | None:
    """Fit on whole texts; a fifth of them, in the given order, calibrate. None without texts."""
    languages = sorted(set(labels))
    if not languages:
        return None
    rng = np.random.default_rng(seed)
    examples = []
    for text, label in zip(texts, labels):
        data, ends = buffer_of(pa.array([text]))
        bucket, n = np.unique(np.concatenate(list(subwords(data, ends))), return_counts=True)
        keep = bucket != NONE
        if keep.any():
            n = n[keep].astype(np.float32)
            examples.append((bucket[keep], n / n.sum(), languages.index(label)))
    held = examples[::5] if len(examples) >= 25 else examples
    fit = [x for i, x in enumerate(examples) if i % 5] if len(examples) >= 25 else examples
    embed = rng.normal(0, 0.1, (NONE + 1, DIMENSIONS)).astype(np.float32)
    layer = rng.normal(0, 0.5, (DIMENSIONS, len(languages))).astype(np.float32)
    bias = np.zeros(len(languages), np.float32)
    steps, done = EPOCHS * max(1, len(fit)), 0
    for _ in range(EPOCHS):
        for k in rng.permutation(len(fit)):
            bucket, weight, label = fit[k]
            rate = RATE * (1 - done / steps)
            done += 1
            mean = weight @ embed[bucket]
            error = softmax(mean @ layer + bias)
            error[label] -= 1
            embed[bucket] -= (rate * len(bucket) ** 0.5) * weight[:, None] * (layer @ error)[None, :]
            layer -= rate * mean[:, None] * error[None, :]
            bias -= 0.1 * rate * error
    logits = np.ascontiguousarray((embed @ layer).T)
    logits[:, NONE] = 0
    raw = np.array([w @ logits.T[b] + bias for b, w, _ in held]).reshape(-1, len(languages))
    truth = np.array([label for _, _, label in held], np.int64)
    grid = np.geomspace(0.2, 5, 30)
    temperature = min(grid, key=lambda t: -np.log(np.maximum(softmax(raw / t)[np.arange(len(truth)), truth], 1e-12)).mean() if len(truth) else 0)
    return Model(languages, logits, bias, float(temperature), rejection(softmax(raw / temperature), truth))


def rejection(probability: np.ndarray, truth: np.ndarray) -> float:
    """Half way, in log-odds, from chance to the least confident right calibration row: no
    right one is rejected, at any number of rows. Where accepted rows would have too many
    errors it is the least confidence at which they have few enough, but one that rejects
    no more than a small share (interpolated) of the calibration rows. 0 where chance is
    not exceeded."""
    if not len(truth):
        return 0.0
    best, right = probability.max(axis=1), probability.argmax(axis=1) == truth
    chance = 1 / probability.shape[1]
    threshold = 0.0
    if right.any() and chance < 1:
        odds = (log_odds(chance) + log_odds(best[right].min())) / 2
        threshold = float(1 / (1 + np.exp(-odds)))
    order = np.argsort(best)
    wrong = np.cumsum(~right[order][::-1])[::-1]
    fits = np.flatnonzero(wrong <= MOST_ERRORS * np.arange(len(order), 0, -1))
    first = int(fits[0]) if len(fits) else len(order) - 1
    if first:
        threshold = max(threshold, min(float(best[order[first]]), float(np.quantile(best, MOST_REJECTED))))
    return threshold if threshold > chance else 0.0


def log_odds(p: float) -> float:
    p = min(p, 1 - 1e-12)
    return float(np.log(p / (1 - p)))


def sampled(labelled: DataFrame, per_language: int) -> tuple[list[str], list[str]]:
    """About ``per_language`` rows of each language, chosen by a hash of the identifier; should identifiers repeat so that
    more than twice as many are chosen, the first by hash, identifier and text."""
    counts = Scratch(labelled.sparkSession, "languages").save(labelled.groupBy("lang").count(), "counts")  # its measured size decides on the join
    languages = counts.count()
    if not languages:
        return [], []
    share = F.least(F.lit(1.0), F.lit(float(per_language)) / F.col("count"))
    cuts = counts.select("lang", F.floor(share * (1 << 30)).alias("cut"))
    place = F.pmod(F.xxhash64("doc_id", F.lit(8)), F.lit(1 << 30))
    chosen = labelled.withColumn("place", place).join(cuts, "lang").filter("place < cut")
    rows = chosen.orderBy("place", "doc_id", "text").limit(2 * per_language * languages).select("doc_id", "text", "lang").collect()
    rows.sort(key=lambda r: (zlib.crc32(str(r["doc_id"]).encode()), str(r["doc_id"]), r["text"]))
    return [r["text"] for r in rows], [r["lang"] for r in rows]


def fit_languages(docs: DataFrame, doc: str, text: str, lang: str, learn, per_language: int = ROWS_PER_LANGUAGE) -> Model | None:
    """A model of all languages of the rows that ``learn`` chooses, from about ``per_language`` rows of each with a letter and at
    most ``LONGEST_SAMPLE`` bytes; None without such rows."""
    rows = docs.filter(learn).select(F.col(doc).alias("doc_id"), F.col(text).alias("text"), F.col(lang).alias("lang"))
    return train(*sampled(
        rows.filter((F.col("lang") != "") & (F.octet_length("text") <= LONGEST_SAMPLE) & F.col("text").rlike(r"\p{L}")),
        per_language,
    ))


def identify_languages(docs: DataFrame, model: Model | None, text: str = "text", whole: bool = False) -> DataFrame:
    """The input's rows and columns with lang_pred, score and rejected, from the whole text.

    Rows whose text is null or has no letter get ``und``, score 0 and rejected; so does
    every row if there was nothing to learn from. A row is rejected too where its
    calibrated probability is below the model's threshold. An empty table gives no rows, a text of any
    length is judged whole. Input columns of these
    three names are replaced; repeated rows get equal predictions.
    """
    spark = docs.sparkSession
    small_batches(spark)
    known = spark.sparkContext.broadcast(model)
    kept = docs.drop("lang_pred", "score", "rejected")

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = known.value
        for batch, data, ends in chunks(batches, text, CHUNK // 2):
            seen = batch.column(batch.schema.get_field_index(text)).to_pylist()
            pred, score, rejected = [UNKNOWN] * len(seen), np.zeros(len(seen)), np.ones(len(seen), bool)
            if m is not None:
                p = m.probabilities(data, ends)
                best = p.argmax(axis=1)
                ascii_letter = row_sums(((LETTERS[data] != 0x20) & (data < 0x80)).astype(np.float32), ends) > 0
                for i, t in enumerate(seen):
                    if t and (ascii_letter[i] or any(map(str.isalpha, t))):
                        pred[i], score[i] = m.languages[best[i]], min(1.0, p[i, best[i]])
                        rejected[i] = score[i] < m.threshold
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(pred), pa.array(score), pa.array(rejected)],
                [*batch.schema.names, "lang_pred", "score", "rejected"],
            )

    schema = StructType([*kept.schema.fields]).add("lang_pred", "string").add("score", "double").add("rejected", "boolean")
    return kept.mapInArrow(predict, schema)


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = fit_languages(docs, "doc_id", "text", "lang", remainder("doc_id", 4) != 2)
    rows = docs.select("doc_id", "text", (remainder("doc_id", 4) == 2).alias("held_out"))
    return identify_languages(rows, model).select("doc_id", "held_out", "lang_pred", "score", "rejected")
