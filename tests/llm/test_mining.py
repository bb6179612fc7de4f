"""Line dedup, phrase collocations and spelling variants against brute force."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

import __spark_entry__ as entry
from tests.llm.test_llm import frame, tricky
from tests.oracle_check import connect, rows_of
from topicweft.llm import line_dedup, phrases, spelling

LOW = str.maketrans({i: i + 32 for i in range(65, 91)})
BLANK = " \t\n\x0b\f\r"


def long_text(seed, words=400_000):
    rng = random.Random(seed)
    return " ".join(rng.choice(("lorem", "ipsumdolor", "sitamet.", "consectetur", "adipiscing\n")) for _ in range(words))


# --- lines -------------------------------------------------------------------


def brute_lines(rows, shortest=20, fewest=3):
    key = lambda line: line.strip(BLANK).translate(LOW)
    held = defaultdict(set)
    for doc, text in rows:
        for line in (text or "").split("\n"):
            held[key(line)].add(doc)
    out = []
    for doc, text in rows:
        lines = (text or "").split("\n")
        kept = []
        for line in lines:
            docs = held[key(line)]
            gone = len(key(line)) >= shortest and len(docs) >= fewest and doc != max((d for d in docs if d is not None), default=None)
            if not gone:
                kept.append(line)
        out.append((doc, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return Counter(out)


def line_rows():
    rng = random.Random(5)
    pool = [f"{w} repeated line number {i} é" for i, w in enumerate(["Alpha", "beta", "Gamma", "delta"])] + ["short", "", "x" * 20, "y" * 19]
    rows = []
    for doc in [*range(40), None, None, 7, 7]:
        lines = [rng.choice((" ", "", "\t", "\r")) + rng.choice((str.upper, str.lower))(rng.choice(pool)) for _ in range(rng.randint(0, 9))]
        rows.append((doc, "\n".join(lines)))
    text = "\n".join(["the same line in every document"] * 3)
    return [*rows, (60, text), (60, text), (61, text), (62, text + "\n"), (None, text), (63, None), (64, ""), (65, "\n\n"), (None, None), *tricky()]


@pytest.mark.parametrize("parts", [1, 7])
def test_repeated_lines(spark, partitions, parts):
    partitions(parts)
    rows = line_rows()
    got = line_dedup.line_dedup(frame(spark, rows)).collect()
    assert Counter(tuple(r) for r in got) == brute_lines(rows)


def test_very_long_text_of_lines(spark):
    text = "\n".join(f"line {i % 50_000} of a long document" for i in range(400_000))
    rows = [(1, text), (2, text), (3, text)]
    got = {r.doc_id: (r.n_lines, r.n_dropped) for r in line_dedup.line_dedup(frame(spark, rows)).collect()}
    assert got == {1: (400_000, 400_000), 2: (400_000, 400_000), 3: (400_000, 0)}


def test_a_line_in_a_third_of_all_documents_is_split(spark, partitions):
    partitions(6)
    rows = [(i, "one line that is everywhere\n" + f"a line of its own, number {i}") for i in range(600)]
    got = line_dedup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sum(r.n_dropped for r in got) == 599


# --- phrases -----------------------------------------------------------------


def brute_phrases(rows, least, top=2000, share=80):
    f, total = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(LOW)):
            words = re.findall("[^\x20\x09]+", piece)
            total[lang] += len(words)
            for m in (1, 2, 3, 4):
                for i in range(len(words) - m + 1):
                    f[lang, tuple(words[i : i + m])] += 1
    f = {k: v for k, v in f.items() if v >= least}
    inside = defaultdict(int)
    for (lang, p), a in f.items():
        for m in range(2, len(p)):
            for i in range(len(p) - m + 1):
                key = lang, p[i : i + m]
                inside[key] = max(inside[key], a)
    found = defaultdict(list)
    for (lang, p), a in f.items():
        if len(p) < 2 or 100 * inside[lang, p] >= share * a:
            continue
        score, _, left, right = min((2_000_000 * a // (f[lang, p[:k]] + f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p)))
        found[lang].append((-score, -a, " ".join(p).encode(), left, right))
    out = set()
    for lang, items in found.items():
        for rank, (score, a, phrase, left, right) in enumerate(sorted(items)[:top], 1):
            out.add((lang, rank, phrase.decode(), -a, left, right, total[lang], -score))
    return out


def phrase_rows():
    rng = random.Random(2)
    words = ["of", "the", "New", "york", "times", "été", "a", "b\x01", "\x00", "San", "francisco", "bay"]
    fixed = ["New York Times", "san francisco bay area", "of the", "the the the the the"]
    rows = []
    for _ in range(150):
        text = " ".join(rng.choice(fixed) if rng.random() < 0.4 else rng.choice(words) for _ in range(rng.randint(0, 30)))
        rows.append((rng.choice(("en", "en", "en", "fr", None, "und")), text.replace(" a ", rng.choice((", ", "\t\t", "\n")))))
    return [*rows, ("en", None), ("de", ""), (None, "..,;"), *rows[:30]]


def phrase_frame(spark, rows):
    schema = "doc_id long, text string, lang string, w1 long, w2 string, m int, f long, n long, part int, piece int, word string, name string"
    return spark.createDataFrame([(None, t, lang, 1, "x", 2, 3, 4, 5, 6, None, "n") for lang, t in rows], schema)


@pytest.mark.parametrize(("parts", "least", "top", "block"), [(1, 3, 2000, 1 << 20), (9, 2, 7, 50), (23, 1, 40, 10)])
def test_phrases(spark, partitions, parts, least, top, block):
    partitions(parts)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = phrase_rows()
        got = phrases.collocations(phrase_frame(spark, rows).repartition(5), least=least, top=top, block=block).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    want = brute_phrases(rows, least, top)
    assert len(got) == len(want) and {tuple(r) for r in got} == want


def test_phrases_of_a_very_long_text(spark):
    rows = [("en", long_text(1)), ("en", "lorem ipsumdolor")]
    assert {tuple(r) for r in phrases.collocations(phrase_frame(spark, rows)).collect()} == brute_phrases(rows, 30)


def test_a_full_filter_costs_rows_only(spark, monkeypatch):
    monkeypatch.setattr(phrases, "word_filter", lambda frequent: __import__("numpy").full(8, 255, "uint8"))
    rows = phrase_rows()
    got = phrases.collocations(phrase_frame(spark, rows), least=4).collect()
    assert {tuple(r) for r in got} == brute_phrases(rows, 4)


def test_phrase_scores_beyond_64_bits(spark):
    names = "lang long, w1 long, w2 long, w3 long, w4 long, m int, f long, c1 long, c2 long, c3 long, e1 long, e2 long, e3 long"
    big = 9 * 10**15
    row = spark.createDataFrame([(1, 1, 2, 0, 0, 2, big, big + 1, None, None, big + 2, None, None)], names)
    cut = row.select(phrases._least_cut().alias("c")).first()["c"]
    assert (cut["score"], cut["k"], cut["l"], cut["r"]) == (2_000_000 * big // (2 * big + 3), 1, big + 1, big + 2)


# --- spelling ----------------------------------------------------------------


def brute_words(rows, shortest=7):
    n = Counter()
    for doc, text in rows:
        for word in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = word.translate(LOW)
            code = zlib.crc32(f"{'' if doc is None else doc}:{word}".encode())
            if code % 31 == 0:
                at = code % len(word)
                word = word[:at] + word[at + 1 :]
            n[word] += 1
    return {w: c for w, c in n.items() if len(w) >= shortest}


def brute_spelling(n, fewest=2, factor=10):
    n = {w: c for w, c in n.items() if c >= fewest}
    near, groups = defaultdict(set), defaultdict(set)
    for w in n:
        for i in range(len(w)):
            rest = w[:i] + w[i + 1 :]
            groups[i, rest].add(w)
            if rest in n:
                near[w].add(rest)
                near[rest].add(w)
    for members in groups.values():
        for w in members:
            near[w] |= members - {w}
    form = {}
    for w in n:
        best = min(near[w], key=lambda o: (-n[o], o), default=None)
        if best is not None and n[best] >= factor * n[w]:
            form[w] = best
    out = set()
    for w in n:
        root = w
        while root in form:
            root = form[root]
        out.add((w, form.get(w), root, n[w], len(near[w]), n[form[w]] if w in form else None))
    return out


def spelled(df):
    return {tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect()}


def variant_words(seed=4):
    rng = random.Random(seed)
    n = {}
    for size in (7, 8, 12, 20, 21, 64, 300):
        base = "".join(rng.choice("abé") for _ in range(size))
        n[base] = 5_000
        for _ in range(25):
            i, c = rng.randrange(size), rng.choice("abéÿ")
            for w in (base[:i] + c + base[i + 1 :], base[:i] + base[i + 1 :], base[:i] + c + base[i:]):
                n.setdefault(w, rng.choice((2, 3, 40, 400)))
    for k in (7, 8, 9, 19, 20, 21, 66, 67):
        n["a" * k] = 2 * k
    return n


@pytest.mark.parametrize("deepest", [20, 8])
def test_variants_of_words(spark, deepest):
    n = variant_words()
    df = spark.createDataFrame([(c, w, 1) for w, c in n.items()], "n long, word string, level int")
    got = spelling.spelling_groups(df, deepest=deepest)
    assert spelled(got) == brute_spelling({w: c for w, c in n.items() if len(w) >= 7})


def test_trie_is_walked_in_few_strides(spark, monkeypatch):
    """The longest word has 64 characters; tables are written per stride, not per character."""
    names, saved = [], spelling.Scratch.save
    monkeypatch.setattr(spelling.Scratch, "save", lambda self, df, name: (names.append(name), saved(self, df, name))[1])
    n = {w: c for w, c in variant_words().items() if 7 <= len(w) <= 64}
    got = spelling.spelling_groups(spark.createDataFrame(list(n.items()), "word string, n long"))
    assert max(map(len, n)) == 64 and spelled(got) == brute_spelling(n)
    assert sum(name.startswith("states/") for name in names) == 5


def test_words_of_texts(spark):
    rng = random.Random(9)
    pool = ["Training", "trainning", "résumés", "RESUMES", "abcdefg", "abcdefgh", "x×y÷zabc", "short", "Ābcdefgh", "longerÿwords"]
    rows = [(d, " ".join(rng.choice(pool) + rng.choice(("", "1", "-")) for _ in range(40))) for d in [*range(60), None, None, 3]]
    rows += [(100, None), (101, ""), (102, "..."), (103, "a" * 3000 + " " + "a" * 2999), (104, "a" * 3000 + " " + "a" * 2999), *tricky()]
    docs = frame(spark, rows)
    n = brute_words(rows)
    assert {(r.word, r.n) for r in spelling.words_of(docs).collect()} == set(n.items())
    assert spelled(spelling.spelling_variants(docs)) == brute_spelling(n)


def test_words_folded_in_small_parts(spark, monkeypatch):
    monkeypatch.setattr(spelling, "CACHE_BYTES", 500)
    rows = [(i, long_text(i, 200)) for i in range(5)]
    fold = spelling._word_counts(7, 31)
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows]), pa.array([r[1] for r in rows])], ["doc_id", "text"])
    total = Counter()
    for out in fold(iter([batch])):
        for w, c in zip(out.column("word").to_pylist(), out.column("n").to_pylist()):
            total[w] += c
    assert total == Counter(brute_words(rows))


# --- all three ---------------------------------------------------------------


def test_empty_tables(spark):
    docs = frame(spark, [])
    assert line_dedup.line_dedup(docs).count() == 0
    assert phrases.collocations(docs).count() == 0
    assert spelling.spelling_variants(docs).count() == 0


@pytest.mark.parametrize("name", ["op11_line_dedup", "op12_phrase_collocations"])
def test_queries_equal_their_sql(spark, sf, name):
    got = entry.queries()[name](spark, sf).toPandas()
    want = connect(sf).execute(entry.oracle_sql()[name]).fetch_df()
    assert rows_of(got) == rows_of(want)


def test_digest_of_lines(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    want = Counter((d, n, gone, hashlib.sha256(t.encode()).hexdigest()) for d, n, gone, t in brute_lines(rows))
    got = entry.queries()["op11_line_dedup"](spark, sf).select("doc_id", "n_lines", "n_dropped", "kept_sha256").collect()
    assert Counter(tuple(r) for r in got) == want


def test_spelling_query_equals_brute_force(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert spelled(entry.queries()["op13_spelling_variants"](spark, sf)) == brute_spelling(brute_words(rows))
