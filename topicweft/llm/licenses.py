"""Licence scan by a trained paragraph classifier.

The paragraphs classified are the lines of a document and, for notices that are wrapped over
lines or stand within a long one, windows of 8 and 24 words over the whole text. Sparse word unigrams and bigrams, hashed, go into a
softmax regression over licence families and an unknown class. It is trained by
stochastic gradient descent in numpy on variants of the templates below (parts of them,
words left out, replaced or added) against lines of a bounded sample of the corpus and
sentences that merely speak of licences. The probability is calibrated by a temperature on
variants that training left out, and a paragraph below the fitted threshold is unknown.
A comparison with the family's templates confirms each prediction. A passage that the texts of
several families share goes to one that the document shows elsewhere without doubt.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bytetext import ALNUM, U, buffer_of, chunks, mixed, word_hashes
from .common import documents, small_batches, whole_text
from .language_id import row_sums, softmax

# Notices in common use, by family.
TEMPLATES = {
    "apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
        "SPDX-License-Identifier: Apache-2.0",
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in "
        "writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either "
        "express or implied. See the License for the specific language governing permissions and limitations under the License.",
        "Subject to the terms and conditions of this License, each Contributor hereby grants to You a perpetual, worldwide, non-exclusive, "
        "no-charge, royalty-free, irrevocable copyright license to reproduce, prepare Derivative Works of, publicly display, publicly perform, "
        "sublicense, and distribute the Work and such Derivative Works in Source or Object form.",
    ],
    "mit": [
        "Released under the MIT License.",
        "This project is licensed under the terms of the MIT license.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
        "SPDX-License-Identifier: MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "
        "Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, "
        "distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to "
        "the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions "
        "of the Software.",
        "THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF "
        "MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR "
        "ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH "
        "THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ],
    "bsd": [
        "Licensed under the BSD 3-Clause License.",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "SPDX-License-Identifier: BSD-3-Clause",
        "SPDX-License-Identifier: BSD-2-Clause",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
        "documentation and/or other materials provided with the distribution. Neither the name of the copyright holder nor the names of its "
        "contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT "
        "LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE "
        "COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES "
        "(INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) "
        "HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) "
        "ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    ],
    "gpl": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
        "SPDX-License-Identifier: GPL-2.0-only",
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of "
        "MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy "
        "of the GNU General Public License along with this program. If not, see https://www.gnu.org/licenses/.",
        "The GNU General Public License is a free, copyleft license for software and other kinds of works. The licenses for most software and "
        "other practical works are designed to take away your freedom to share and change the works.",
    ],
    "lgpl": [
        "This library is licensed under the GNU Lesser General Public License, version 2.1.",
        "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
        "SPDX-License-Identifier: LGPL-2.1-or-later",
        "This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY. See the GNU Lesser General Public License for "
        "more details. You should have received a copy of the GNU Lesser General Public License along with this library",
    ],
    "agpl": [
        "Licensed under the GNU Affero General Public License, version 3.",
        "you can redistribute it and/or modify it under the terms of the GNU Affero General Public License",
        "SPDX-License-Identifier: AGPL-3.0-only",
        "See the GNU Affero General Public License for more details. You should have received a copy of the GNU Affero General Public License "
        "along with this program",
    ],
    "mpl-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Licensed under the Mozilla Public License, version 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
        "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    ],
    "cc-by": [
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ],
    "cc-by-sa": [
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    ],
    "cc-by-nc": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ],
    "public-domain": [
        "This work is dedicated to the public domain under CC0 1.0 Universal.",
        "This is free and unencumbered software released into the public domain.",
        "SPDX-License-Identifier: Unlicense",
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled "
        "binary, for any purpose, commercial or non-commercial, and by any means.",
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    ],
    "cc-by-nd": [
        "Licensed under CC BY-ND 4.0.",
        "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.",
    ],
    "cc-by-nc-sa": [
        "Licensed under CC BY-NC-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.",
    ],
    "isc": [
        "Licensed under the ISC License.",
        "SPDX-License-Identifier: ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the "
        "above copyright notice and this permission notice appear in all copies.",
        "THE SOFTWARE IS PROVIDED AS IS AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF "
        "MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY "
        "DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, "
        "ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    ],
    "zlib": [
        "Distributed under the zlib license.",
        "SPDX-License-Identifier: Zlib",
        "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages "
        "arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial "
        "applications, and to alter it and redistribute it freely, subject to the following restrictions:",
        "The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software "
        "in a product, an acknowledgment in the product documentation would be appreciated but is not required. Altered source versions must be "
        "plainly marked as such, and must not be misrepresented as being the original software. This notice may not be removed or altered from any "
        "source distribution.",
    ],
    "boost": [
        "Distributed under the Boost Software License, Version 1.0. See accompanying file LICENSE_1_0.txt",
        "SPDX-License-Identifier: BSL-1.0",
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying "
        "documentation covered by this license (the Software) to use, reproduce, display, distribute, execute, and transmit the Software, and to "
        "prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so",
        "unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.",
    ],
    "epl-2.0": [
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at "
        "https://www.eclipse.org/legal/epl-2.0/",
        "Licensed under the Eclipse Public License, version 2.0.",
        "SPDX-License-Identifier: EPL-2.0",
    ],
    "artistic": [
        "This program is free software; you can redistribute it and/or modify it under the terms of the Artistic License 2.0.",
        "Licensed under the Artistic License 2.0.",
        "SPDX-License-Identifier: Artistic-2.0",
        "This license establishes the terms under which a given free software Package may be copied, modified, distributed, and/or redistributed.",
    ],
    "cddl": [
        "The contents of this file are subject to the terms of the Common Development and Distribution License. You may not use this file except "
        "in compliance with the License.",
        "SPDX-License-Identifier: CDDL-1.0",
    ],
    "eupl": [
        "Licensed under the EUPL, Version 1.2 or as soon they will be approved by the European Commission subsequent versions of the EUPL",
        "Licensed under the European Union Public Licence, version 1.2.",
        "SPDX-License-Identifier: EUPL-1.2",
    ],
    "ofl": [
        "This Font Software is licensed under the SIL Open Font License, Version 1.1.",
        "Licensed under the SIL Open Font License 1.1.",
        "SPDX-License-Identifier: OFL-1.1",
    ],
    "gfdl": [
        "Permission is granted to copy, distribute and/or modify this document under the terms of the GNU Free Documentation License, Version 1.3 "
        "or any later version published by the Free Software Foundation; with no Invariant Sections, no Front-Cover Texts, and no Back-Cover Texts.",
        "SPDX-License-Identifier: GFDL-1.3-or-later",
    ],
    "wtfpl": [
        "Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as "
        "the name is changed.",
        "SPDX-License-Identifier: WTFPL",
    ],
    "ms-pl": [
        "This license governs use of the accompanying software. If you use the software, you accept this license. If you do not accept the "
        "license, do not use the software.",
        "Licensed under the Microsoft Public License.",
        "SPDX-License-Identifier: MS-PL",
    ],
    "postgresql": [
        "Permission to use, copy, modify, and distribute this software and its documentation for any purpose, without fee, and without a written "
        "agreement is hereby granted, provided that the above copyright notice and this paragraph and the following two paragraphs appear in all "
        "copies.",
        "SPDX-License-Identifier: PostgreSQL",
    ],
}
# Titles, which confirm a line that is nothing else.
HEADINGS = {
    "apache-2.0": ["Apache License"], "mit": ["MIT License", "The MIT License", "The MIT License (MIT)"], "isc": ["ISC License"], "zlib": ["zlib License"],
    "bsd": ["BSD License", "BSD 3-Clause License", "BSD 2-Clause License"], "gpl": ["GNU General Public License"],
    "lgpl": ["GNU Lesser General Public License"], "agpl": ["GNU Affero General Public License"], "mpl-2.0": ["Mozilla Public License"],
    "boost": ["Boost Software License"], "epl-2.0": ["Eclipse Public License"], "artistic": ["Artistic License", "The Artistic License 2.0"],
    "ofl": ["SIL Open Font License"], "gfdl": ["GNU Free Documentation License"], "ms-pl": ["Microsoft Public License"],
}
# Sentences about licences that grant none.
OTHERS = [
    "All rights reserved.", "No part of this work may be copied without permission of the publisher.",
    "The driver lost the license after the third fine.", "A license is required to sell food in public places.",
    "The company bought a license for the new program version.", "Version 2.0 of the program was released in the spring.",
    "The general public was not admitted to the library.", "Licensed engineers must renew their license every year.",
    "The creative work of the commons committee was published under its terms.", "Released in 2019 by the university press.",
    "Permission to build was granted by the city, free of charge to any resident.", "This document is subject to change.",
]

BITS = 18
UNKNOWN = "unknown"
EPOCHS = 12
RATE = 0.5
VARIANTS = 24
SAMPLE_ROWS = 300
LONGEST_SAMPLE = 1 << 16
MOST_LINES = 6_000
MOST_FALSE = 0.001
CONFIRM = 0.6
FRAGMENT = 29  # words and pairs: 15 words
NEWLINE = 0x0A
WINDOWS = ((8, 4), (24, 12))  # words, step
WINDOWS_TOGETHER = 1 << 14
CLEAR = 0.1  # by how much the likeness to one family has to exceed the others to leave no doubt


def features(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of unigrams and bigrams, and where each row's begin (one more entry). Every
    word gives one of each; a row's first word has a bigram with the row's start."""
    hashes, _, _, first = word_hashes(data, ends, ALNUM)
    before = np.concatenate([np.zeros(1, U), hashes[:-1]]) if len(hashes) else hashes
    before[first[:-1][first[:-1] < len(hashes)]] = U(1)
    pairs = mixed(before * U(0xC2B2AE3D27D4EB4F) + hashes)
    out = np.empty(2 * len(hashes), np.int64)
    out[0::2] = (hashes >> U(64 - BITS)).astype(np.int64)
    out[1::2] = (pairs >> U(64 - BITS)).astype(np.int64) + (1 << BITS)
    return out, 2 * first


def lines(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ends of all lines (0 first; line ends and row ends both part) and each row's first line."""
    cuts = np.union1d(np.flatnonzero(data == NEWLINE) + 1, ends)
    return cuts, np.searchsorted(cuts, ends)


@dataclass
class Model:
    families: list[str]  # the unknown class first
    weights: np.ndarray  # class x bucket
    bias: np.ndarray
    temperature: float
    threshold: float

    def probabilities(self, data: np.ndarray, ends: np.ndarray) -> np.ndarray:
        bucket, first = features(data, ends)
        norm = np.sqrt(np.maximum(np.diff(first), 1))
        logits = np.stack([row_sums(w[bucket], first) / norm + b for w, b in zip(self.weights, self.bias)], axis=1)
        return softmax(logits / self.temperature)


    def of_windows(self, bucket: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of windows of words, in order: the family, its probability and that of being none; a bounded number at once."""
        family, p, none = np.zeros(len(start), np.int64), np.zeros(len(start)), np.ones(len(start))
        for i in range(0, len(start), WINDOWS_TOGETHER):
            part = slice(i, i + WINDOWS_TOGETHER)
            low, a, b = start[i], start[part] - start[i], stop[part] - start[i]
            own, norm = bucket[2 * low : 2 * (low + b[-1])], np.sqrt(2 * (b - a))
            logits = np.empty((len(a), len(self.families)))
            for k, w in enumerate(self.weights):
                sums = np.concatenate([[0.0], np.cumsum(w[own].reshape(-1, 2).sum(axis=1), dtype=float)])
                logits[:, k] = (sums[b] - sums[a]) / norm + self.bias[k]
            all_p = softmax(logits / self.temperature)
            family[part] = all_p[:, 1:].argmax(axis=1) + 1
            p[part], none[part] = all_p[np.arange(len(a)), family[part]], all_p[:, 0]
        return family, p, none


def windows(first: np.ndarray, width: int, step: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, first word and end of the windows over each row's words, up to its last word; a row of fewer words is one."""
    n = np.diff(first)
    count = np.where(n > width, -(-(n - width) // step) + 1, n > 0)
    row = np.repeat(np.arange(len(n)), count)
    place = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    start = first[row] + np.minimum(place * step, np.maximum(n[row] - width, 0))
    return row, start, np.minimum(start + width, first[row + 1])


def variants(text: str, rng: np.random.Generator, noise: list[str]) -> Iterator[str]:
    """The text, and parts of it with words left out, replaced or added around it; of a long one also parts as short as a window."""
    words = text.split()
    yield text
    for _ in range(VARIANTS * max(1, len(words) // 30)):
        size = max(min(len(words), 4), int(len(words) * rng.uniform(0.7, 1)))
        if len(words) > 30 and rng.random() < 0.7:
            size = int(rng.integers(7, 26))
        begin = int(rng.integers(0, len(words) - size + 1))
        part = words[begin : begin + size]
        if len(part) > 6:
            part = [w if rng.random() > 0.05 else str(rng.choice(noise)) for w in part if rng.random() > 0.05]
        extra = [str(w) for w in rng.choice(noise, int(rng.integers(0, 4)))]
        yield " ".join([*extra, *part] if rng.random() < 0.5 else [*part, *extra])


def words_of(text: str) -> list[str]:
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.lower())


def word_set(text: str) -> set[tuple[str, ...]]:
    """Words and pairs of words."""
    words = words_of(text)
    return {(w,) for w in words} | set(zip(words, words[1:]))


TEMPLATE_SETS = {family: [word_set(t) for t in texts] for family, texts in TEMPLATES.items()}
TITLES = {family: [words_of(t) for t in texts] for family, texts in HEADINGS.items()}


def likeness(text: str, family: str) -> float:
    """Of the passage and the closest template, how much the smaller one shares; a passage shorter than ``FRAGMENT`` is measured against
    that much of a longer template, as a few of its words confirm nothing. 1 for a title of the family, if there is nothing else."""
    if words_of(text) in TITLES.get(family, []):
        return 1.0
    own = word_set(text)
    if len(own) < 5:
        return 0.0
    return max((len(own & t) / max(1, min(max(len(own), FRAGMENT), len(t))) for t in TEMPLATE_SETS.get(family, [])), default=0.0)


def train(corpus_lines: list[str], seed: int = 11) -> Model:
    """Fit on template variants, the given lines (those like a template are left out) and OTHERS."""
    rng = np.random.default_rng(seed)
    families = [UNKNOWN, *TEMPLATES]
    plain = [t for t in corpus_lines if max(likeness(t, f) for f in TEMPLATES) < 0.5]
    noise = [w for t in plain[:500] for w in t.split()[:5]] or ["the", "of", "project", "2020", "file"]
    texts, labels = [], []
    for label, family in enumerate(families[1:], 1):
        for template in TEMPLATES[family] + HEADINGS.get(family, []):
            for t in variants(template, rng, noise):
                texts.append(t)
                labels.append(label)
    for t in OTHERS:
        for v in [*variants(t, rng, noise)][:12]:
            texts.append(v)
            labels.append(0)
    for width, _ in WINDOWS:  # parts of lines, as windows are
        plain += [" ".join(w[i : i + width]) for w in map(str.split, plain[: MOST_LINES // 3]) if len(w) > width for i in (0, (len(w) - width) // 2)]
    plain = [plain[i] for i in rng.permutation(len(plain))[:MOST_LINES]]
    plain *= max(1, -(-len(texts) // len(plain))) if plain else 1  # a small corpus does not make licences the likelier class
    # words never met are no evidence: lines of made-up ones teach that the rest of the corpus is plain
    strange = [" ".join(f"q{x:x}" for x in rng.integers(1 << 40, size=int(rng.integers(1, 25)))) for _ in range(len(texts) // 4)]
    texts += plain + strange
    labels += [0] * len(plain + strange)
    data, ends = buffer_of(pa.array(texts))
    bucket, first = features(data, ends)
    label = np.array(labels)
    weights = np.zeros((len(families), 2 << BITS), np.float32)
    bias = np.zeros(len(families))
    order = rng.permutation(len(texts))
    held, fit = order[::5], order[np.arange(len(order)) % 5 > 0]
    for epoch in range(EPOCHS):
        for i in rng.permutation(fit):
            mine = bucket[first[i] : first[i + 1]]
            if not len(mine):
                continue
            scale = 1 / np.sqrt(len(mine))
            error = softmax(weights[:, mine].sum(axis=1) * scale + bias)
            error[label[i]] -= 1
            rate = RATE * (1 - epoch / EPOCHS)
            np.add.at(weights, (slice(None), mine), (-rate * scale * error)[:, None])
            bias -= 0.1 * rate * error
    model = Model(families, weights, bias, 1.0, 0.5)
    probability = np.log(np.maximum(model.probabilities(data, ends)[held], 1e-30))
    truth = label[held]
    model.temperature = float(min(np.geomspace(0.2, 5, 30), key=lambda t: -np.log(np.maximum(softmax(probability / t)[np.arange(len(truth)), truth], 1e-12)).mean()))
    p = softmax(probability / model.temperature)
    wrong = np.sort(1 - p[truth == 0, 0])  # how surely a plain line is taken for a licence
    if len(wrong):
        model.threshold = float(min(0.9, max(0.5, wrong[max(0, int(np.ceil((1 - MOST_FALSE) * len(wrong))) - 1)])))
    return model


def corpus_sample(docs: DataFrame, doc: str, text: str, rows: int = SAMPLE_ROWS) -> list[str]:
    """Lines of about ``rows`` rows of at most ``LONGEST_SAMPLE`` bytes, chosen by a hash of the identifier (the first by hash,
    identifier and text should repeated identifiers choose more than twice as many)."""
    n = docs.count()
    place = F.pmod(F.xxhash64(F.col(doc), F.lit(5)), F.lit(1 << 30))
    chosen = docs.filter((place < int((1 << 30) * min(1.0, rows / max(n, 1)))) & (F.octet_length(text) <= LONGEST_SAMPLE))
    chosen = chosen.orderBy(place, doc, text).limit(2 * rows)
    texts = sorted(r[0] for r in chosen.select(text).collect() if r[0])
    return [line for t in texts for line in t.split("\n") if line.strip()]


FOUND = "array<struct<start: long, stop: long, family: string, probability: double, likeness: double, confirmed: boolean>>"


def scan_licenses(docs: DataFrame, model: Model, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_paragraphs (lines with a word), found (byte spans of licence passages, in order).

    Every line of the whole text is classified, and every window of words, which may cross lines. A found
    span has a family, its calibrated probability, its likeness to the closest template of that family, and
    whether that confirms it; lines that no template confirms stand as predictions only, windows are given where
    confirmed and liker to their template than the confirmed lines they meet. Null and empty texts have no paragraph, blank lines are none. Rows
    with null or repeated identifiers are rows of their own, equal texts get equal spans; an empty table gives no
    rows; a text of any length is classified whole, its windows a bounded number at once. Other columns are ignored.
    """
    spark = docs.sparkSession
    small_batches(spark)
    known = spark.sparkContext.broadcast(model)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = known.value
        for batch, data, ends in chunks(batches):
            cuts, first = lines(data, ends)
            found: list[list[dict]] = [[] for _ in range(batch.num_rows)]
            words = np.diff(features(data, cuts)[1]) if len(cuts) > 1 else np.zeros(0, np.int64)
            if len(cuts) > 1:
                p = m.probabilities(data, cuts)
                best = p[:, 1:].argmax(axis=1) + 1
                sure = np.flatnonzero((words > 0) & (1 - p[:, 0] >= m.threshold))
                for k in sure.tolist():
                    r = int(np.searchsorted(first, k, "right")) - 1
                    found[r].append(_span(data, ends[r], cuts[k], cuts[k + 1], m.families[best[k]], p[k, best[k]]))
                within: dict[int, list[dict]] = {}
                for r, item in _in_windows(m, data, ends):
                    if item["confirmed"]:
                        within.setdefault(r, []).append(item)
                for r, items in within.items():
                    found[r] = _joined(found[r], items)
                for r, items in enumerate(found):
                    if items:
                        _settle(items, data[ends[r] : ends[r + 1]])
            filled = np.concatenate([[0], np.cumsum(words > 0)])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(filled[first[1:]] - filled[first[:-1]], pa.int64()), pa.array(found, FOUND_TYPE)],
                ["doc_id", "n_paragraphs", "found"],
            )

    rows = docs.select(F.col(doc).alias("doc_id"), whole_text(text).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(scan, f"doc_id {kind}, n_paragraphs long, found {FOUND}")


def _span(data: np.ndarray, base: int, start: int, stop: int, family: str, probability: float) -> dict:
    alike = likeness(data[start:stop].tobytes().decode("utf-8", "replace"), family)
    return {
        "start": int(start - base), "stop": int(stop - base), "family": family, "probability": float(probability),
        "likeness": alike, "confirmed": alike >= CONFIRM,
    }


def _in_windows(m: Model, data: np.ndarray, ends: np.ndarray) -> Iterator[tuple[int, dict]]:
    """Row and span of each window that is not taken for plain text."""
    _, begin, end, first = word_hashes(data, ends, ALNUM)
    bucket, _ = features(data, ends)
    for width, step in WINDOWS:
        row, start, stop = windows(first, width, step)
        family, p, none = m.of_windows(bucket, start, stop)
        for i in np.flatnonzero(1 - none >= m.threshold).tolist():
            yield int(row[i]), _span(data, ends[row[i]], begin[start[i]], end[stop[i] - 1], m.families[family[i]], p[i])


def _joined(of_lines: list[dict], of_windows: list[dict]) -> list[dict]:
    """The spans of lines, and those of windows where no confirmed line as likely is there; confirmed lines of another family that
    such windows meet go."""
    sure = sorted((x for x in of_lines if x["confirmed"]), key=lambda x: x["start"])  # lines don't overlap
    starts = [x["start"] for x in sure]

    def met(item: dict) -> list[dict]:
        first = max(0, bisect_right(starts, item["start"]) - 1)
        return [x for x in sure[first : bisect_left(starts, item["stop"])] if item["start"] < x["stop"]]

    stronger = _strongest([w for w in of_windows if all(x["likeness"] < w["likeness"] for x in met(w))])
    gone = {x["start"] for w in stronger for x in met(w) if x["family"] != w["family"]}
    return sorted([x for x in of_lines if not (x["confirmed"] and x["start"] in gone)] + stronger, key=lambda x: (x["start"], x["stop"]))


def _strongest(items: list[dict]) -> list[dict]:
    """Overlapping spans of one family as one; where families overlap, the likest (then surest, then first) one stays."""
    kept: list[dict] = []
    starts: list[int] = []  # the spans kept don't overlap and are held in order
    for item in sorted(items, key=lambda x: (-x["likeness"], -x["probability"], x["start"], x["stop"])):
        low = max(0, bisect_right(starts, item["start"]) - 1)
        high = bisect_left(starts, item["stop"])
        met = [k for k in range(low, high) if kept[k]["start"] < item["stop"] and item["start"] < kept[k]["stop"]]
        if any(kept[k]["family"] != item["family"] for k in met):
            continue
        whole = [kept[k] for k in met] or [item]
        merged = whole[0] | {"start": min(x["start"] for x in [*whole, item]), "stop": max(x["stop"] for x in [*whole, item])}
        at = met[0] if met else bisect_left(starts, merged["start"])
        kept[at : at + len(met)], starts[at : at + len(met)] = [merged], [merged["start"]]
    return kept


def _settle(items: list[dict], data: np.ndarray) -> None:
    """Give a passage that several families' texts share to one that other passages of the document leave no doubt of."""
    sure = [x for x in items if x["confirmed"]]
    if len({x["family"] for x in sure}) < 2:
        return
    alike = [{f: likeness(data[x["start"] : x["stop"]].tobytes().decode("utf-8", "replace"), f) for f in TEMPLATES} for x in sure]
    clear = {x["family"] for x, a in zip(sure, alike) if all(a[x["family"]] - v >= CLEAR for f, v in a.items() if f != x["family"])}
    for x, a in zip(sure, alike):
        other = max(clear, key=lambda f: (a[f], f), default=None)
        if x["family"] not in clear and other and a[other] >= max(CONFIRM, a[x["family"]] - CLEAR):
            x["family"], x["likeness"] = other, a[other]


FOUND_TYPE = pa.list_(pa.struct([
    ("start", pa.int64()), ("stop", pa.int64()), ("family", pa.string()), ("probability", pa.float64()),
    ("likeness", pa.float64()), ("confirmed", pa.bool_()),
]))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    sure = F.filter("found", lambda x: x["confirmed"])
    return scan_licenses(docs, train(corpus_sample(docs, "doc_id", "text"))).select(
        "doc_id", "n_paragraphs", F.size(sure).cast("long").alias("n_license"),
        (F.size("found") - F.size(sure)).cast("long").alias("n_unconfirmed"),
        F.array_join(F.array_sort(F.array_distinct(F.transform(sure, lambda x: x["family"]))), ",").alias("families"),
    )
