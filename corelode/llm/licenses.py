"""License scan: phrases at word level, and text blocks that contain most of a license template.

Method: exact set-similarity join. A template is a set of words; the words of all templates are ordered by the number of documents that hold
them (counted over the whole corpus; rarest first). A block is a stretch of words of the text, over line ends too, since license texts are
wrapped (words end at signs, so comment marks are none): two strides long, beginning every stride, where a template's stride is its length or somewhat more, so any stretch of
its length lies in a block. A block is the set of its words that any template has. It can contain `share` of a template only if it holds one of the
template's first |T| - need + 1 words in that order (prefix filter), has at least `need` words (length filter), and, where the first word that both hold is the
template's i-th and the block's j-th, still leaves room for the need in both: min(|T| - i, |B| - j) >= need (positional filter). What passes is compared in full, so every
block that reaches the threshold is found. The templates are a fixed short list, so they travel with the tasks as the small side of the join. Templates of fewer than WHOLE
words must be there whole.

Besides, phrases give labels wherever their words stand consecutively, across lines too.

Defined results: a null or empty text has no words, no labels and score 0. The score is the largest containment of any template that reached the
threshold, 1 where a phrase was found. Letters A-Z have no case; other letters are as they are. Every row is scanned by itself, so repeated rows and ids
get the same result each; templates as good as each other all give their labels. Very long texts are scanned whole, in all their blocks. An input column named like an output
is replaced. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textops as X
from .frames import without

#: Least words between the starts of blocks; templates of fewer than WHOLE words must be there whole.
STRIDE, WHOLE = 8, 10

# Phrases and the labels that they give.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
# The texts of public licenses (or the notices by which files are put under them), and sentences that usually name them.
_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the
Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall
be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT
LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY
CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS
IN THE SOFTWARE."""
_BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of
source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright
notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE
COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A
PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL
DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY
OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE
POSSIBILITY OF SUCH DAMAGE."""
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice
and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED
WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER
RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE
OF THIS SOFTWARE."""
_APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the
License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an
"AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under
the License."""
_GPL = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software
Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY;
without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy
of the GNU General Public License along with this program. If not, see https://www.gnu.org/licenses/."""
_ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of
this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to
the following restrictions: The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a
product, an acknowledgment in the product documentation would be appreciated but is not required. Altered source versions must be plainly marked as such, and must not be
misrepresented as being the original software. This notice may not be removed or altered from any source distribution."""
_UNLICENSE = """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this
software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."""
_MPL = """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at
https://mozilla.org/MPL/2.0/."""
TEMPLATES = (
    ("mit", _MIT),
    ("bsd", _BSD),
    ("isc", _ISC),
    ("apache-2.0", _APACHE),
    ("gpl-3.0", _GPL),
    ("zlib", _ZLIB),
    ("unlicense", _UNLICENSE),
    ("mpl-2.0", _MPL),
    ("apache-2.0", "licensed under the apache license version 2 0"),
    ("apache-2.0", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0"),
    ("cc-by-4.0", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("gpl-3.0", "this work is licensed under the gnu general public license version 3"),
    ("gpl-3.0", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
)

#: Bytes that end a word: ASCII but digits and letters.
STOP = np.array([b < 0x80 and not chr(b).isalnum() for b in range(256)])


def _hash(word: str) -> int:
    raw = np.frombuffer(word.encode(), np.uint8)
    return int(X.find_words(raw, np.array([0, len(raw)]), STOP).hashes(lower=True)[0])


def words_of(text: str) -> list[str]:
    """The words of a text, in ASCII lower case."""
    raw = np.frombuffer(text.encode(), np.uint8)
    found = X.find_words(raw, np.array([0, len(raw)]), STOP)
    return [raw[a:b].tobytes().lower().decode() for a, b in zip(found.starts, found.ends, strict=True)]


class Templates:
    """The templates with their words in global order (a word's number is its place in it), and the index of their prefixes."""

    def __init__(self, templates, share: float, frequency: dict[str, int], phrases: dict[str, str]):
        texts = [words_of(t) for _, t in templates]
        self.labels = [label for label, _ in templates]
        self.words = sorted({w for t in texts for w in t} | {w for p in phrases for w in words_of(p)}, key=lambda w: (frequency.get(w, 0), w))
        code = np.array([_hash(w) for w in self.words], np.uint64)
        order = np.argsort(code)
        self.code, self.word_of = code[order], order.astype(np.int64)
        number = {w: i for i, w in enumerate(self.words)}
        self.holds = np.zeros((len(self.words), len(texts)), bool)
        for k, t in enumerate(texts):
            self.holds[[number[w] for w in t], k] = True
        self.size = self.holds.sum(axis=0)
        self.need = np.array([n if n < WHOLE else max(1, math.ceil(share * n - 1e-9)) for n in self.size.tolist()])
        self.stride = np.array([max(STRIDE, 1 << (len(t) - 1).bit_length()) for t in texts])
        # rows of the prefix index: word, template, place in the template's order; ordered by word
        rows = [(w, k, i) for k in range(len(texts)) for i, w in enumerate(np.flatnonzero(self.holds[:, k])[: self.size[k] - self.need[k] + 1].tolist())]
        self.prefix = np.array(sorted(rows), np.int64).reshape(-1, 3)
        self.phrases = [([number[w] for w in words_of(p)], label) for p, label in phrases.items()]

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The number of each hash's word, -1 for words of no template."""
        at = np.minimum(np.searchsorted(self.code, hashes), len(self.code) - 1)
        return np.where(self.code[at] == hashes, self.word_of[at], -1)


def _block_words(t: Templates, words: X.Words, token: np.ndarray, stride: int, prefix: np.ndarray):
    """(owner, word) of the blocks that hold a prefix word, distinct and ordered by block and word, and where each block starts."""
    known = np.flatnonzero(token >= 0)
    owner = np.searchsorted(words.first, known, "right") - 1
    step = (known - words.first[owner]) // stride
    base = np.concatenate([[0], np.cumsum(-(-np.diff(words.first) // stride))])
    block = base[owner] + step
    before = step > 0
    block, word = np.concatenate([block, block[before] - 1]), np.concatenate([token[known], token[known][before]])
    asked = np.zeros(int(base[-1]), bool)
    asked[block[np.isin(word, prefix)]] = True
    some = asked[block]
    pairs = np.unique(block[some] * len(t.words) + word[some])
    block, word = pairs // len(t.words), pairs % len(t.words)
    start = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]])) if len(block) else np.zeros(0, np.int64)
    return np.searchsorted(base, block[start], "right") - 1, word, np.append(start, len(word))


def _blocks_with(t: Templates, words: X.Words, token: np.ndarray) -> dict[int, dict[str, float]]:
    """For each text: the labels of templates that a block of it contains, with the largest containment."""
    found: dict[int, dict[str, float]] = {}
    for stride in np.unique(t.stride):
        index = t.prefix[t.stride[t.prefix[:, 1]] == stride]
        owner, word, at = _block_words(t, words, token, int(stride), index[:, 0])
        if not len(owner):
            continue
        size = np.diff(at)
        # join by word: each of a block's words with the index rows of the word
        lo, hi = np.searchsorted(index[:, 0], word), np.searchsorted(index[:, 0], word, "right")
        row = np.repeat(np.arange(len(word)), hi - lo)
        hit = index[lo[row] + X.ranges(hi - lo)]
        block = np.searchsorted(at, row, "right") - 1
        # the first word of a block and a template that is in both decides
        _, first = np.unique(block * len(t.labels) + hit[:, 1], return_index=True)
        block, template, i, j = block[first], hit[first, 1], hit[first, 2], row[first] - at[block[first]]
        need = t.need[template]
        room = (size[block] >= need) & (np.minimum(t.size[template] - i, size[block] - j) >= need)
        for k in np.unique(template[room]).tolist():
            mine = block[room & (template == k)]
            sums = np.concatenate([[0], np.cumsum(t.holds[word, k])])
            overlap = sums[at[mine + 1]] - sums[at[mine]]
            for o, n in zip(owner[mine].tolist(), overlap.tolist(), strict=True):
                if n >= t.need[k]:
                    best = found.setdefault(o, {})
                    best[t.labels[k]] = max(best.get(t.labels[k], 0.0), n / int(t.size[k]))
    return found


def _scan(t: Templates, names: list[str], text_col: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, offsets in X.chunks(batch, text_col):
                words = X.find_words(data, offsets, STOP)
                token, owner = t.find(words.hashes(lower=True)), words.owner()
                n = len(offsets) - 1
                base, first, last = np.zeros(n, np.int64), np.full(n, -1, np.int64), np.full(n, -1, np.int64)
                labels: list[set[str]] = [set() for _ in range(n)]
                for ids, label in t.phrases:
                    m = len(ids)
                    hit = np.ones(max(len(token) - m + 1, 0), bool)
                    for i, w in enumerate(ids):
                        hit &= token[i : i + len(hit)] == w
                    at = np.flatnonzero(hit)
                    at = at[owner[at] == owner[at + m - 1]]
                    place = at - words.first[owner[at]]
                    for o, p in zip(owner[at].tolist(), place.tolist(), strict=True):
                        base[o] += 1
                        first[o] = p if first[o] < 0 else min(first[o], p)
                        last[o] = max(last[o], p)
                        labels[o].add(label)
                found = _blocks_with(t, words, token)
                score = np.where(base > 0, 1.0, 0.0)
                both = [",".join(sorted(s)) for s in labels]
                plain = list(both)
                for o, more in found.items():
                    both[o] = ",".join(sorted(labels[o] | set(more)))
                    score[o] = max(score[o], *more.values())
                part = batch.slice(rows.start, rows.stop - rows.start)
                none = base == 0
                yield pa.RecordBatch.from_arrays(
                    [*[part.column(c) for c in names], pa.array(np.diff(words.first)), pa.array(base), pa.array(first, mask=none), pa.array(last, mask=none), pa.array(plain, pa.string()), pa.array(both, pa.string()), pa.array(score)],
                    names=[*names, "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"],
                )

    return run


def _frequencies(t: Templates):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(t.words), np.int64)
        for batch in batches:
            for _, data, offsets in X.chunks(batch, "text"):
                words = X.find_words(data, offsets, STOP)
                token = t.find(words.hashes(lower=True))
                some = token >= 0
                pairs = np.unique(words.owner()[some] * len(t.words) + token[some])
                total += np.bincount(pairs % len(t.words), minlength=len(t.words))
        yield pa.RecordBatch.from_arrays([pa.array(t.words, pa.string()), pa.array(total)], names=["word", "documents"])

    return run


def license_scan(docs: DataFrame, share: float = 0.8, templates=TEMPLATES, phrases=PHRASES, text_col: str = "text") -> DataFrame:
    """docs (without the text) with n_words, n_base, first_word, last_word, base_labels, labels, score."""
    plain = Templates(templates, share, {}, phrases)
    counts = docs.select(F.col(text_col).alias("text")).mapInArrow(_frequencies(plain), "word string, documents long").groupBy("word").agg(F.sum("documents").alias("documents"))
    # one row for each word of the templates
    ordered = Templates(templates, share, {r["word"]: r["documents"] for r in counts.collect()}, phrases)
    rest = without(docs, text_col, "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")
    more = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"
    schema = T.StructType([*rest.schema.fields, *T._parse_datatype_string(more).fields])
    return docs.select(*[f"`{c}`" for c in rest.columns], text_col).mapInArrow(_scan(ordered, rest.columns, text_col), schema)


def op7_license_scan(spark, sf_dir: str) -> DataFrame:
    return license_scan(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
