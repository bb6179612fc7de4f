"""Licence scan: whole texts, wrapped and commented notices, notices within long lines, and prose that only speaks of licences."""

import random
import textwrap

import numpy as np
import pytest

from topicweft.llm import licenses

FAMILIES = sorted(licenses.TEMPLATES)
PROSE = (
    "The river runs past the old mill and down to the harbour, where boats wait for the evening tide. Prices rose again in the second quarter "
    "of the year, although the bank had promised otherwise. She opened the window, looked at the garden and decided to write the letter after all. "
    "Researchers measured the depth of the lake at forty places and compared the figures with those of the last century. The committee will meet "
    "on Thursday to discuss the budget for the new library and the repair of the bridge."
)
NEAR_MISSES = [
    "A licence is required to sell food in public places, and the inspector may ask to see it at any time of the day.",
    "He lost his driving license after the third fine and had to walk to the software company where he worked.",
    "The general public was not admitted to the library; the foundation published its report under other conditions.",
    "MIT researchers released a paper on free charge carriers, which was distributed to every person at the conference.",
    "The warranty covers any damages arising from the use of the machine for a particular purpose within two years.",
    "Permission was granted by the city to build on the property, subject to the following rules about noise.",
    "The Eclipse was visible to the public in May, and the Apache helicopter pilot had a license to fly, version or not.",
    "Creative people work in common rooms; an international committee gave the attribution of the picture to another painter.",
    "All rights reserved. No part of this book may be reproduced without the permission of the publisher.",
]


@pytest.fixture(scope="module")
def model():
    rng = random.Random(3)
    words = PROSE.split()
    return licenses.train([" ".join(rng.choice(words) for _ in range(rng.randint(5, 60))) for _ in range(400)] + PROSE.split(". "))


def frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def families_of(spark, model, texts):
    rows = sorted(licenses.scan_licenses(frame(spark, texts), model).collect())
    return [{x.family for x in r.found if x.confirmed} for r in rows]


def longest(family):
    return max(licenses.TEMPLATES[family], key=len)


def test_each_family_in_wrapped_comments_and_in_long_lines(spark, model):
    forms = [
        lambda t: "\n".join(textwrap.wrap(t, 60)),
        lambda t: "/*\n" + "\n".join(" * " + x for x in textwrap.wrap("Copyright 2019 Jane Roe. " + t, 44)) + "\n */\nint main() { return 0; }\n",
        lambda t: PROSE + " " + t + " " + PROSE,
        lambda t: t.upper(),
    ]
    texts = [form(longest(f)) for f in FAMILIES for form in forms]
    got = families_of(spark, model, texts)
    wrong = [(FAMILIES[i // 4], i % 4, g) for i, g in enumerate(got) if g != {FAMILIES[i // 4]}]
    missed = [w for w in wrong if w[0] not in w[2]]
    assert len(missed) <= 0.03 * len(texts), missed
    assert len(wrong) <= 0.08 * len(texts), wrong


def test_whole_texts_have_one_family(spark, model):
    whole = lambda f, title: title + "\n\nCopyright (c) 2020 A. Author\n\n" + "\n\n".join(textwrap.fill(t, 72) for t in licenses.TEMPLATES[f] if len(t) > 150)
    texts = [whole("mit", "MIT License"), whole("isc", "ISC License"), whole("zlib", "zlib License"), whole("bsd", "BSD 3-Clause License"), whole("boost", "Boost Software License")]
    assert families_of(spark, model, texts) == [{"mit"}, {"isc"}, {"zlib"}, {"bsd"}, {"boost"}]


def test_titles_confirm_only_lines_of_their_own(spark, model):
    got = families_of(spark, model, ["MIT License\n" + PROSE, "She studied at MIT, license in hand.\n" + PROSE])
    assert got == [{"mit"}, set()]


def test_prose_about_licences_grants_none(spark, model):
    texts = [*NEAR_MISSES, PROSE, " ".join(NEAR_MISSES), "\n".join(NEAR_MISSES), (PROSE + " ") * 300]
    assert families_of(spark, model, texts) == [set()] * len(texts)


def test_tricky_texts(spark, model):
    notice = "Licensed under the Apache License, Version 2.0."
    texts = ["x" * 3_000_000, (PROSE + " ") * 8_000 + notice, (notice + " ") * 5_000, "\n" * 50, None, "", "ä ö ü"]
    rows = sorted(licenses.scan_licenses(frame(spark, texts), model).collect())
    assert [{x.family for x in r.found if x.confirmed} for r in rows] == [set(), {"apache-2.0"}, {"apache-2.0"}, set(), set(), set(), set()]
    assert [r.n_paragraphs for r in rows] == [1, 1, 1, 0, 0, 0, 1]
    span = next(x for x in rows[1].found if x.confirmed)
    assert notice.rstrip(".").encode() in texts[1].encode()[span.start : span.stop] and span.stop - span.start < 200


def test_two_notices_in_one_line_are_both_found(spark, model):
    text = PROSE + " Licensed under CC BY-NC 4.0. " + PROSE + " This work is licensed under the GNU General Public License, version 3. " + PROSE
    assert families_of(spark, model, [text]) == [{"cc-by-nc", "gpl"}]


def test_windows_cover_all_words_and_stay_in_rows():
    first = np.array([0, 0, 5, 30, 54, 100])
    for width, step in licenses.WINDOWS:
        row, start, stop = licenses.windows(first, width, step)
        for r in range(5):
            own = {w for a, b in zip(start[row == r], stop[row == r]) for w in range(a, b)}
            assert own == set(range(first[r], first[r + 1]))
        assert np.all(np.diff(start) >= 0) and np.all(np.diff(stop) >= 0) and np.all(stop - start <= width)


def test_strongest_spans_do_not_overlap():
    rng = random.Random(5)
    for _ in range(200):
        items = []
        for _ in range(rng.randint(0, 30)):
            a = rng.randint(0, 100)
            items.append({"start": a, "stop": a + rng.randint(1, 12), "family": rng.choice("xyz"), "likeness": rng.choice([0.6, 0.8, 1.0]), "probability": rng.random()})
        kept = licenses._strongest(items)
        assert all(a["stop"] <= b["start"] for a, b in zip(kept, kept[1:]))
        for x in items:  # nothing goes without a stronger one in its place
            assert any(k["start"] < x["stop"] and x["start"] < k["stop"] for k in kept)
