"""The training-data operators against brute force, on tricky rows and on the small tables."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import __spark_entry__ as entry
from topicweft.llm import (
    bytetext, components, decontaminate, exact_dedup, language_id, licenses, lm_scoring, near_join, packing, repeats,
    substring_dedup, suffix_dedup, token_counts,
)
from topicweft.llm.common import Scratch, remainder

LOW = {i: i + 32 for i in range(65, 91)}
#: columns named like the operators' own
SCHEMA = (
    "doc_id long, text string, row long, block int, node long, role int, gram long, keys string, lang string, "
    "kept boolean, score double, length int, `rank` long, part int, hits string"
)


def frame(spark, rows):
    """Rows of (doc_id, text), with other columns that clash or are null."""
    return spark.createDataFrame([(d, t, None, 1, 2, 3, None, "x", None, True, None, 5, 6, 7, "h") for d, t in rows], SCHEMA)


def tricky(seed=3):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdeéñ") for _ in range(rng.randint(1, 7))) for _ in range(60)]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    passage, base = prose(90), prose(120)
    near = base.split()
    near[60] = "changed"
    return [
        (1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "One"), (6, "one two three"), (7, base), (8, base.upper()),
        (9, base), (10, base), (10, base), (11, " ".join(near)), (12, prose(30) + " " + passage + " " + prose(40)),
        (13, passage), (14, "x" * 1500), (15, "x" * 450), (16, prose(6000)), (17, prose(20) + "\n" + passage + "\r\n\x0b"),
        (18, "a b  c   d\u0085e\x1cf"), (19, "<|endoftext|> ퟿ \U0001f600 é́"), (20, base + " " + base),
        (None, "no identifier"), (None, None), (21, "..., --- 12"), (22, "ab " * 200),
    ]


@pytest.fixture(scope="module")
def rows():
    return tricky()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return frame(spark, rows)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW))


# --- words as bytes -------------------------------------------------------------------


def test_words_of_bytes_are_those_of_characters(rows):
    texts = [t for _, t in rows]
    data, ends = bytetext.buffer_of(pa.array(texts))
    low = bytetext.LOWERED[data]
    for kind, pattern in ((bytetext.NOT_SPACE, r"[^\x20\x09-\x0D]+"), (bytetext.ALNUM, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")):
        starts, stops, first = bytetext.runs(low, ends, kind)
        found = [low[a:b].tobytes().decode() for a, b in zip(starts, stops)]
        for r, t in enumerate(texts):
            assert found[first[r] : first[r + 1]] == re.findall(pattern, (t or "").translate(LOW))


def test_equal_spans_have_equal_hashes_and_others_differ():
    data = np.frombuffer(b"abcabcabd", np.uint8)
    sums = bytetext.prefix_sums(bytetext.mixed_bytes()[data])
    h = bytetext.window_hashes(sums, 3)
    assert h[0] == h[3] and len(set(h[:3].tolist())) == 3 and h[6] not in h[:6]


# --- 1 token counts --------------------------------------------------------------------


def test_token_counts_are_the_librarys(docs, rows):
    encoder = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    got = token_counts.token_counts(docs, table_rows=20).collect()
    want = Counter((d, len((t or "").encode()), n := len(encoder.encode(t or "", add_special_tokens=False)), n > 2048) for d, t in rows)
    assert Counter(map(tuple, got)) == want


def test_token_counts_with_a_small_cache(monkeypatch):
    monkeypatch.setattr(token_counts, "CACHE_ROWS", 3)
    path = public_tokenizers.path("word_bpe_49k.json")
    lengths = token_counts.Lengths(path, {"": 0})
    texts = ["alpha beta gamma", "delta epsilon zeta", "", "alpha \t beta"]
    encoder = Tokenizer.from_file(path)
    assert [token_counts.count_texts([t], lengths)[0] for t in texts] == [len(encoder.encode(t)) for t in texts]


def test_empty_tables_give_no_rows(empty, spark):
    assert token_counts.token_counts(empty).count() == 0
    assert exact_dedup.exact_duplicates(empty).count() == 0
    assert suffix_dedup.repeated_bytes(empty).count() == 0
    assert substring_dedup.repeated_words(empty).count() == 0
    assert near_join.near_classes(empty).count() == 0
    assert packing.pack(empty).count() == 0
    assert lm_scoring.score_texts(empty, F.lit(True)).count() == 0
    assert language_id.fit_languages(empty, "doc_id", "text", "lang", F.lit(True)) is None
    assert language_id.identify_languages(empty, None).count() == 0
    assert licenses.scan_licenses(empty, licenses.train(licenses.corpus_sample(empty, "doc_id", "text"))).count() == 0


# --- 2 near copies ----------------------------------------------------------------------


def brute_links(rows, threshold=0.8):
    sets = []
    for _, t in rows:
        w = words_of(t)
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    n, root = [0] * len(rows), list(range(len(rows)))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i + 1, len(rows)):
            if sets[i] and sets[j] and len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= threshold:
                n[i], n[j] = n[i] + 1, n[j] + 1
                a, b = top(i), top(j)
                root[max(a, b)] = min(a, b)
    classes = {}
    for i in range(len(rows)):
        classes.setdefault(top(i), []).append(i)
    best = {c: min((rows[i][0] for i in m if rows[i][0] is not None), default=None) for c, m in classes.items()}
    return [(rows[i][0], best[top(i)], n[i]) for i in range(len(rows))]


@pytest.mark.parametrize("block_rows", [512, 2])
def test_near_classes_are_those_of_all_pairs(spark, rows, block_rows):
    rng = random.Random(5)
    base = [f"w{rng.randrange(400)}" for _ in range(150)]
    near = []
    for k in range(12):
        copy = list(base)
        for _ in range(k % 5):
            copy[rng.randrange(150)] = "edit"
        near.append((100 + k, " ".join(copy)))
    rows = [*rows, *near]
    got = near_join.near_classes(frame(spark, rows), block_rows=block_rows).select("doc_id", "class_id", "n_links").collect()
    assert Counter(map(tuple, got)) == Counter(brute_links(rows))


@pytest.mark.parametrize("block_shingles", [150, 60, 20])
def test_near_classes_with_empty_blocks(spark, block_shingles):
    rng = random.Random(6)
    near = []
    for k in range(4):
        base = [f"v{rng.randrange(400)}" for _ in range(120)]
        near += [(10 * k + c, " ".join(base[: 120 - c])) for c in range(3)]
    got = near_join.near_classes(frame(spark, near), block_shingles=block_shingles).select("doc_id", "class_id", "n_links").collect()
    assert Counter(map(tuple, got)) == Counter(brute_links(near))


def test_rows_without_identifier_are_linked(spark):
    words = [f"w{i}" for i in range(100)]
    texts = [" ".join(words), " ".join([*words[:99], "x"]), " ".join([*words[:99], "y"])]
    rows = [(1, texts[0]), (None, texts[1]), (None, texts[2]), (None, "alone and null"), (None, None), (5, "")]
    got = near_join.near_classes(frame(spark, rows)).collect()
    assert sorted((r.class_id or 0, r.n_links, r.class_size) for r in got) == [(0, 0, 1), (0, 0, 1), (1, 2, 3), (1, 2, 3), (1, 2, 3), (5, 0, 1)]
    assert sorted((r.doc_id or 0) for r in got if r.first) == [0, 0, 1, 5]
    got = near_join.near_classes(frame(spark, [(None, t) for t in texts])).collect()
    assert [(r.class_id, r.n_links, r.class_size) for r in got] == [(None, 2, 3)] * 3 and sum(r.first for r in got) == 1


def test_bands_reach_the_recall():
    for recall in (0.9, 0.99, 0.9999):
        bands, size = near_join.bands_for(0.8, recall)
        assert 1 - (1 - 0.8**size) ** bands >= recall and bands * size <= near_join.MOST_HASHES


def test_components_of_a_chain_and_a_hub(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, k) for k in range(101, 140)] + [(7, 7)]
    found = components.components(spark.createDataFrame(edges, "u long, v long"), Scratch(spark, "test"))
    assert {(r.node, r.component) for r in found.collect()} == {(i, 0) for i in range(61)} | {(k, 100) for k in range(100, 140)}


# --- 3 language model -------------------------------------------------------------------


def test_base_scores_and_known_tokens(docs, rows):
    got = lm_scoring.score_texts(docs, remainder("doc_id", 7) != 2, block_bytes=4000).collect()
    learn = [d is not None and zlib.crc32(str(d).encode()) % 7 != 2 for d, _ in rows]
    tokens = [[*words_of(t), None] for _, t in rows]
    counts = Counter(w for ws, ok in zip(tokens, learn) if ok for w in ws)
    n, v = sum(counts.values()), len(counts)
    want = Counter(
        (d, not ok, len(ws), sum(w in counts for w in ws), n, round(sum(np.log10((counts[w] + 1) / (n + v + 1)) for w in ws), 6))
        for (d, _), ws, ok in zip(rows, tokens, learn)
    )
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    assert all(np.isfinite(r.score) and r.score < 0 for r in got)


def test_mixture_is_the_interpolated_bigram(spark):
    rows = [(i, " ".join(random.Random(i).choices("a b c d".split(), k=30))) for i in range(40)]
    cells = []
    learned = lm_scoring.learn_weights

    def spy(found):
        cells.append(learned(found))
        return cells[-1]

    lm_scoring.learn_weights, before = spy, lm_scoring.learn_weights
    try:
        got = {r.doc_id: r.score for r in lm_scoring.score_texts(frame(spark, rows), F.col("doc_id") < 30).collect()}
    finally:
        lm_scoring.learn_weights = before
    tokens = {d: [*words_of(t), "$"] for d, t in rows}
    one = Counter(w for d in range(30) for w in tokens[d])
    two = Counter(p for d in range(30) for p in zip(["$", *tokens[d]], tokens[d]))
    n, v = sum(one.values()), len(one)
    for d in (2, 33):
        total = 0.0
        for u, w in zip(["$", *tokens[d]], tokens[d]):
            a, b, c = cells[0][int(lm_scoring.bucket_of(np.array([one[u]]))[0])]
            total += np.log10(a * (two[u, w] / one[u] if one[u] else 0) + b * one[w] / n + c / (v + 1))
        assert got[d] == pytest.approx(total, rel=1e-9)
    assert np.allclose(cells[0].sum(axis=1), 1) and (cells[0][:, 2] > 0).all()


def test_scoring_without_training_rows(docs, rows):
    got = lm_scoring.score_texts(docs, F.lit(False)).collect()
    assert len(got) == len(rows) and {r.train_tokens for r in got} == {0} and {r.n_known for r in got} == {0}


def test_held_out_scores_beat_the_unigram(spark, sf):
    got = entry.queries()["op3_lm_scoring"](spark, sf).filter("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert got[0] > got[1]


# --- 4 and 6 repeated strings ----------------------------------------------------------------


def brute_repeats(sequences, width):
    count = Counter(tuple(s[i : i + width]) for s in sequences for i in range(len(s) - width + 1))
    out = []
    for s in sequences:
        gone = np.zeros(len(s), bool)
        for i in range(len(s) - width + 1):
            if count[tuple(s[i : i + width])] > 1:
                gone[i : i + width] = True
        out.append(gone)
    return out


@pytest.mark.parametrize(("width", "gram"), [(400, 128), (40, 12)])
def test_repeated_bytes_are_those_of_all_windows(docs, rows, width, gram):
    texts = [(t or "").encode() for _, t in rows]
    want = Counter()
    for (d, _), t, gone in zip(rows, texts, brute_repeats(texts, width)):
        spans = int((np.diff(gone.astype(int), prepend=0) == 1).sum())
        want[d, len(t), int(gone.sum()), spans, bytes(np.frombuffer(t, np.uint8)[~gone])] += 1
    got = suffix_dedup.repeated_bytes(docs, width=width, gram=gram).collect()
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got) == want


@pytest.mark.parametrize(("width", "gram"), [(35, 9), (12, 5)])
def test_repeated_words_are_those_of_all_windows(docs, rows, width, gram):
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    want = Counter()
    for (d, _), w, gone in zip(rows, words, brute_repeats(words, width)):
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        want[d, len(w), int(gone.sum()), kept, hashlib.sha256(kept.encode()).hexdigest()] += 1
    got = substring_dedup.repeated_words(docs, width=width, gram=gram).collect()
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept, r.kept_sha256) for r in got) == want


def test_whole_table_of_repeated_bytes(spark, sf):
    """Every 400-byte window of every document of the small table."""
    docs = {r.doc_id: (r.text or "").encode() for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    seen = Counter(hash(t[i : i + 400]) for t in docs.values() for i in range(len(t) - 399))
    want = {}
    for d, t in docs.items():
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - 399):
            if seen[hash(t[i : i + 400])] > 1:
                gone[i : i + 400] = True
        kept = np.frombuffer(t, np.uint8)[~gone].tobytes()
        want[d] = (len(t), int(gone.sum()), int((np.diff(gone.astype(int), prepend=0) == 1).sum()), hashlib.sha256(kept).hexdigest())
    got = entry.queries()["op4_suffix_dedup"](spark, sf).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got} == want
    assert sum(w[1] for w in want.values()) > 1000


def test_crowded_grams_are_counted_as_rows(spark):
    """More slices of one gram than may meet: the same result by counted windows."""
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    shared = " ".join(word() for _ in range(50))
    rows = [(k, " ".join(word() for _ in range(30)) + " " + shared + " " + " ".join(word() for _ in range(30))) for k in range(12)]
    rows.append((99, rows[0][1]))
    docs = frame(spark, rows)
    keyed = repeats.keyed(docs, "doc_id", "text")

    def spans(together):
        found = repeats.repeated_spans(
            keyed, Scratch(spark, "test"), substring_dedup.word_symbols, substring_dedup.doubling(35, 9), 35, 9, together=together
        )
        return {r.row: tuple(np.flatnonzero(repeats.covered(200, [s.asDict() for s in r.spans]))) for r in found.collect()}

    assert spans(2) == spans(1000) != {}


@pytest.mark.parametrize("refine", [suffix_dedup.refine(40, 7), substring_dedup.doubling(40, 7)])
def test_refinement_finds_exactly_the_repeated_windows(refine):
    rng = np.random.default_rng(1)
    part = rng.integers(0, 3, 300)
    values = bytetext.mixed(np.concatenate([part, rng.integers(0, 3, 200), part[50:200], [1] * 90]).astype(np.uint64))
    ends = np.array([0, 300, 500, 650, 740])
    got = refine(values, ends, ends[:-1], ends[1:] - 40)
    slices = [values[a:b].tolist() for a, b in zip(ends, ends[1:])]
    count = Counter(tuple(s[i : i + 40]) for s in slices for i in range(len(s) - 39))
    want = [a + i for a, s in zip(ends, slices) for i in range(len(s) - 39) if count[tuple(s[i : i + 40])] > 1]
    assert np.flatnonzero(got).tolist() == want


# --- 5 licences -----------------------------------------------------------------------------


def test_licences_are_found_and_other_lines_left(spark):
    model = licenses.train(["The river runs to the sea.", "Prices rose again in the second quarter of the year."] * 50)
    rows = [
        (1, "Some prose first.\nReleased under the MIT License.\nMore prose."), (2, "Licensed under CC BY-NC 4.0."),
        (3, "A license is required to sell food in public places.\nThe general public was not admitted."), (4, None), (5, ""),
        (6, "\n\n\nThis work is licensed under the GNU General Public License, version 3.\n"),
        (7, "Licensed under the Apache License, Version 2.0.\n" * 3), (None, "Licensed under the BSD 3-Clause License."),
    ]
    got = {r.doc_id: r for r in licenses.scan_licenses(frame(spark, rows), model).collect()}
    sure = {d: [x.family for x in r.found if x.confirmed] for d, r in got.items()}
    assert sure == {1: ["mit"], 2: ["cc-by-nc"], 3: [], 4: [], 5: [], 6: ["gpl"], 7: ["apache-2.0"] * 3, None: ["bsd"]}
    assert [got[d].n_paragraphs for d in (1, 3, 4, 5, 6, 7)] == [3, 2, 0, 0, 1, 3]
    span = got[1].found[0]
    assert rows[0][1].encode()[span.start : span.stop] == b"Released under the MIT License.\n"


def test_licence_lines_of_the_documents(spark, sf):
    known = {
        "apache-2.0": "Licensed under the Apache License, Version 2.0.", "mit": "Released under the MIT License.",
        "gpl": "This work is licensed under the GNU General Public License, version 3.", "cc-by-nc": "Licensed under CC BY-NC 4.0.",
    }
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in entry.queries()["op5_license_scan"](spark, sf).collect():
        assert set(filter(None, r.families.split(","))) == {f for f, t in known.items() if t in texts[r.doc_id]}


# --- 7 exact copies -----------------------------------------------------------------------------


@pytest.mark.parametrize("keep", ["largest", "smallest"])
def test_exact_copies(docs, rows, keep, partitions):
    partitions(7)
    norm = [(t or "").translate(LOW) for _, t in rows]
    choose = max if keep == "largest" else min
    best = {n: choose((d for (d, _), m in zip(rows, norm) if m == n and d is not None), default=None) for n in norm}
    size = Counter(norm)
    want = Counter(
        (d, best[n], size[n], d is not None and d == best[n], hashlib.sha256(n.encode()).hexdigest()) for (d, _), n in zip(rows, norm)
    )
    assert Counter(map(tuple, exact_dedup.exact_duplicates(docs, keep=keep).collect())) == want


def test_a_large_group_of_copies_spans_partitions(spark, partitions):
    partitions(9)
    rows = [(k, "the same text" if k % 3 else f"text {k}") for k in range(900)]
    got = exact_dedup.exact_duplicates(frame(spark, rows), keep="largest").filter("group_size > 1").collect()
    assert len(got) == 600 and {(r.keep_id, r.group_size) for r in got} == {(899, 600)} and sum(r.kept for r in got) == 1


# --- 8 language ------------------------------------------------------------------------------


def test_languages_of_held_out_documents(spark, sf):
    langs = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = entry.queries()["op8_language_id"](spark, sf).collect()
    held = [r for r in got if r.held_out]
    assert len(got) == len(langs) and sum(r.lang_pred == langs[r.doc_id] for r in held) >= 0.95 * len(held)
    assert all(0 <= r.score <= 1 for r in got)


def test_texts_without_letters_are_undetermined(docs, rows):
    model = language_id.train(["the cat sat on the mat"] * 30 + ["le chat est sur la table"] * 30, ["en"] * 30 + ["fr"] * 30)
    got = language_id.identify_languages(docs.select("doc_id", "text", "score"), model).collect()
    assert len(got) == len(rows)
    for r in got:
        letters = any(c.isalpha() for c in r.text or "")
        assert (r.lang_pred in ("en", "fr")) == letters and (letters or (r.score == 0 and r.rejected))
    assert {r.lang_pred for r in language_id.identify_languages(docs, None).collect()} == {"und"}


def test_rejection_keeps_nearly_all_calibration_rows():
    p = np.stack([np.linspace(0.5, 1, 1000), 1 - np.linspace(0.5, 1, 1000)], axis=1)
    assert language_id.rejection(p, np.zeros(1000, int)) == 0
    threshold = language_id.rejection(p, np.ones(1000, int))
    assert (p.max(axis=1) < threshold).sum() <= language_id.MOST_REJECTED * 1000


@pytest.mark.parametrize("languages", [2, 4])
def test_unlearned_and_noise_texts_are_rejected(spark, languages):
    rng = random.Random(11)
    voices = [("bdfglm", "aou"), ("kprstv", "eiy"), ("chjnwz", "aei"), ("qxbñçl", "oué"), ("þðgmßw", "äöü")]
    word = lambda c, v: "".join(rng.choice(c) + rng.choice(v) for _ in range(rng.randint(1, 3)))
    vocabulary = [[word(c, v) for _ in range(80)] for c, v in voices]
    prose = lambda k, n: " ".join(rng.choice(vocabulary[k]) for _ in range(n))
    rows = [(prose(k, rng.randint(5, 60)), f"l{k}") for _ in range(100) for k in range(languages)]
    model = language_id.train(*map(list, zip(*rows)))
    foreign = [prose(4, 40) for _ in range(40)]
    noise = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(300)) for _ in range(40)]
    known = [prose(k, 40) for k in range(languages) for _ in range(40)]
    texts = spark.createDataFrame(list(enumerate(known + foreign + noise)), "doc_id long, text string")
    gone = {r.doc_id for r in language_id.identify_languages(texts, model).collect() if r.rejected}
    first = len(known)
    assert not gone & set(range(first)) and len(gone) >= 0.9 * 80


def test_rejection_does_not_depend_on_the_number_of_rows():
    p = np.array([[0.99, 0.01], [0.02, 0.98]])
    for n in (5, 100, 5000):
        threshold = language_id.rejection(np.tile(p, (n, 1)), np.tile([0, 1], n))
        assert 0.5 < threshold < 0.98


# --- 9 benchmark passages -----------------------------------------------------------------------


def brute_hits(rows, items, words=10):
    pattern = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    windows = {}
    for i, t in items:
        w = re.findall(pattern, (t or "").translate(LOW))
        k = min(words, len(w))
        for a in range(len(w) - k + 1 if k else 0):
            windows.setdefault(tuple(w[a : a + k]), set()).add(str(i))
    out = Counter()
    for d, t in rows:
        w = re.findall(pattern, (t or "").translate(LOW))
        hits, found = set(), set()
        for k in {len(x) for x in windows}:
            for a in range(len(w) - k + 1):
                if tuple(w[a : a + k]) in windows:
                    hits |= set(range(a, a + k))
                    found |= windows[tuple(w[a : a + k])]
        out[d, len(w), tuple(sorted(hits)), tuple(sorted(found))] += 1
    return out


@pytest.mark.parametrize("shard_bytes", [1 << 20, 100])
def test_benchmark_windows_are_found(spark, docs, rows, shard_bytes):
    passage = rows[13][1]
    items = [
        (1, passage), (2, passage.upper()), (10, " ".join(passage.split()[20:31])), (3, "one"), (4, None), (5, "..."),
        (6, "ab ab ab"), (7, "not here at all"), (8, "one two"), (6, "ab ab ab"),
    ]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.contamination(docs, bench, shard_bytes=shard_bytes).collect()
    assert Counter((r.doc_id, r.n_words, tuple(r.hits), tuple(r.item_ids)) for r in got) == brute_hits(rows, items)


def test_items_without_identifier_count(spark, docs, rows):
    items = [(None, rows[13][1]), (None, "one"), (2, "one")]
    for size in (1 << 20, 10):
        got = decontaminate.contamination(docs, spark.createDataFrame(items, "item_id long, text string"), shard_bytes=size).collect()
        want = Counter((d, n, hits, len(set(found))) for d, n, hits, found in brute_hits(rows, items).elements())
        assert Counter((r.doc_id, r.n_words, tuple(r.hits), len(r.item_ids)) for r in got) == want
    assert {tuple(r.item_ids) for r in got} >= {("2", None), (None,)}


def test_no_documents_to_search(spark, empty):
    bench = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    assert decontaminate.contamination(empty, bench).count() == 0


def test_no_benchmark_no_hits(spark, docs, rows):
    got = decontaminate.contamination(docs, spark.createDataFrame([], "item_id long, text string")).collect()
    assert len(got) == len(rows) and not any(r.hits or r.item_ids for r in got)


# --- 10 packing ----------------------------------------------------------------------------------


def check_packing(got, rows, size):
    encoder = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = Counter()
    for d, t in rows:
        ids = [*encoder.encode(t or "", add_special_tokens=False).ids, 2]
        cuts = [0, *range(len(ids) % size or size, len(ids) + 1, size)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
            want[d, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    sequences = {}
    for r in got:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= size
    return len(sequences)


@pytest.mark.parametrize("size", [1024, 16])
def test_packing_round_trip(docs, rows, size):
    check_packing(packing.pack(docs, size=size).collect(), rows, size)


def test_packing_is_close_to_the_bound(spark, sf):
    got = entry.queries()["op10_packing"](spark, sf).collect()
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert check_packing(got, rows, 1024) <= 1.02 * sum(r.length for r in got) / 1024 + 1


def test_rounds_equal_sequential_best_fit():
    rng = random.Random(2)
    for _ in range(30):
        size = rng.choice([10, 50, 64])
        counts = Counter(rng.randint(1, size) for _ in range(rng.randint(0, 200)))
        gaps = []
        for length in sorted(counts.elements(), reverse=True):
            best = min((g for g in gaps if g >= length), default=None)
            if best is not None:
                gaps.remove(best)
            gaps.append((size if best is None else best) - length)
        used = {}
        for length, rank, n, first, offset, each in packing.match(counts, size):
            for k in range(n):
                used.setdefault(first + k // each, []).append((offset + k % each * length, length))
        assert sum(map(len, used.values())) == sum(counts.values())
        assert sorted(size - sum(x for _, x in s) for s in used.values()) == sorted(gaps)


# --- pipeline ------------------------------------------------------------------------------------


def test_pipeline_stages_on_tricky_rows(spark, rows, sf):
    import corpus_pipeline

    wide = [(d, t, "en" if (d or 0) % 2 else "fr", "s", None) for d, t in rows]
    docs = spark.createDataFrame(wide, "doc_id long, text string, lang string, source string, n_chars long")
    scratch = Scratch(spark, "test")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        columns = docs.columns
        docs = scratch.save(stage(spark, docs, sf), name)
        seen[name] = [r.doc_id for r in docs.collect()]
        assert docs.columns == columns or name == "packing"
    kept = set(seen["exact_dedup"])
    assert {7, 9}.isdisjoint(kept) and {8, 10} <= kept and seen["exact_dedup"].count(10) == 1
    assert set(seen["packing"]) == set(seen["decontamination"]) <= set(seen["near_dedup"])


CLASHING = "doc_id long, text string, lang string, source string, n_chars long, score double, rejected string, lang_pred long, row long, key string, hits int"


def clashing(spark, rows):
    return spark.createDataFrame([(d, t, "en", "s", None, 0.5, "r", 7, 8, "k", 9) for d, t in rows], CLASHING)


def test_pipeline_stages_decide_by_row(spark, sf):
    import corpus_pipeline

    stages = dict(corpus_pipeline.STAGES)
    shared = [(1, "one text under an identifier"), (1, "and another text under it"), (None, "no id"), (None, "No id"), (3, "no ID"), (None, "alone")]
    got = stages["exact_dedup"](spark, clashing(spark, [*shared, shared[0]]), sf).collect()
    assert Counter((r.doc_id, r.text) for r in got) == Counter([*shared[:2], shared[4], shared[5]])
    item = spark.read.parquet(f"{sf}/benchmark.parquet").filter("length(text) > 100").first().text
    mixed = [(1, item), (1, "clean"), (None, item), (None, "clean too"), (2, "x " + item), (4, None)]
    got = stages["decontamination"](spark, clashing(spark, mixed), sf).collect()
    assert Counter((r.doc_id, r.text) for r in got) == Counter([mixed[1], mixed[3], mixed[5]])
    words = " ".join(f"w{i}" for i in range(100))
    near = [(1, words), (1, "quite another text with no copy"), (2, words + " z"), (None, words + " y"), (None, "nobody's"), (4, None)]
    got = stages["near_dedup"](spark, clashing(spark, near), sf).collect()
    assert Counter((r.doc_id, r.text) for r in got) == Counter([near[0], near[1], near[4], near[5]])
    for r in got:
        assert (r.score, r.rejected, r.lang_pred, r.row, r.key, r.hits) == (0.5, "r", 7, 8, "k", 9)


def test_language_stage_keeps_clashing_columns(spark, sf):
    import corpus_pipeline

    rows = spark.read.parquet(f"{sf}/documents.parquet").withColumns({"score": F.lit(0.25), "rejected": F.lit("r"), "lang_pred": F.lit(7)})
    kept = corpus_pipeline.language(spark, rows, sf)
    assert kept.columns == rows.columns and kept.count() > 100
    assert kept.select("score", "rejected", "lang_pred").distinct().collect() == [(0.25, "r", 7)]


def test_pipeline_stages_on_empty_tables(spark, sf):
    import corpus_pipeline

    docs = clashing(spark, [])
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, sf).count() == 0, name


def test_pipeline_equals_its_parts(spark, sf):
    import corpus_pipeline

    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    best = {}
    for d, t in docs.items():
        if any(map(str.isalpha, t)):
            k = t.translate(LOW)
            best[k] = max(d, best.get(k, d))
    rows = [(d, docs[d]) for d in sorted(best.values())]
    rows = [(d, docs[d]) for d, c, _ in brute_links(rows) if d == c]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    clean = [(d, docs[d]) for (d, _, hits, _) in brute_hits(rows, items) if not hits]
    got = corpus_pipeline.run(spark, sf).collect()
    assert check_packing(got, clean, 1024)
