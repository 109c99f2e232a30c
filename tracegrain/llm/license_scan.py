"""Licence scans: base phrases, and whole notices found through a positional index of rare licence words.

Templates are the texts and headers of common public licences. Of each, the RARE words with the highest inverse template
frequency are indexed by position; so every template can collect its votes, whatever else a file holds. A file's words that
are in the index look up their postings, each posting votes for where its template would begin, and alignments with
enough votes are kept if the template's key phrases stand in the text near the places that the alignment names.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict

from pyspark.sql import DataFrame, SparkSession

from .common import byte_texts, map_texts, texts

#: Phrases that give a label wherever their words stand consecutively.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: Notices as (label, text, key phrases without which it does not count).
TEMPLATES = [
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", ("permission is hereby granted", "this software")),
    ("mit", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction,
      including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so,
      subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
      THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.
      IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE
      OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""", ("permission is hereby granted", "any person obtaining a copy", "sublicense and or sell copies")),
    ("isc", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
      THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.""", ("for any purpose with or without fee is hereby granted",)),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", ("redistribution and use", "with or without modification")),
    ("bsd", """Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice,
      this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.""", ("redistributions of source code must retain", "redistributions in binary form must reproduce")),
    ("bsd", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", ("to endorse or promote products derived from this software",)),
    ("apache", "Licensed under the Apache License, Version 2.0; you may not use this file except in compliance with the License", ("apache license", "version 2")),
    ("apache", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at
      http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS,
      WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.""", ("apache license version 2", "specific language governing permissions")),
    ("gpl", "This work is licensed under the GNU General Public License version 3", ("gnu general public license",)),
    ("gpl", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License,
      or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.
      See the GNU General Public License for more details.""", ("terms of the gnu general public license", "free software foundation")),
    ("gpl", """This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2
      of the License, or (at your option) any later version.""", ("terms of the gnu general public license", "either version 2")),
    ("lgpl", """This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1
      of the License, or (at your option) any later version.""", ("gnu lesser general public license",)),
    ("agpl", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3
      of the License, or (at your option) any later version.""", ("gnu affero general public license",)),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", ("mozilla public license",)),
    ("mpl", """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.""", ("mozilla public license", "a copy of the mpl was not distributed")),
    ("epl", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/", ("eclipse public license",)),
    ("boost", """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display,
      distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so""", ("any person or organization obtaining a copy", "prepare derivative works")),
    ("zlib", """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone
      to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely""", ("permission is granted to anyone to use this software", "alter it and redistribute it freely")),
    ("unlicense", """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary,
      for any purpose, commercial or non-commercial, and by any means.""", ("free and unencumbered software released into the public domain",)),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0", ("cc by nc",)),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License", ("creative commons attribution noncommercial",)),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License", ("creative commons attribution sharealike",)),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License", ("creative commons attribution 4",)),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work", ("to the extent possible under law", "related or neighboring rights")),
]
#: Indexed places of a template, its rarest words', and the share of them whose votes an alignment needs.
RARE, VOTES = 24, 0.3
#: By how many words a key phrase may stand off the place its alignment names.
SLACK = 3

_TABLE = bytearray(range(256))
for _c in range(0x80):
    if chr(_c).isupper():
        _TABLE[_c] = _c + 32
    elif not (chr(_c).isdigit() or chr(_c).islower()):
        _TABLE[_c] = 32
_TABLE = bytes(_TABLE)


def words(text: bytes) -> list[bytes]:
    """Words of the lower-cased text: runs of digits, a-z and everything beyond ASCII."""
    return text.translate(_TABLE).split()


class Index:
    """Postings (template, place) of each template's rarest words, and what is verified of a template."""

    def __init__(self, templates=None, base=None):
        templates = templates or TEMPLATES
        self.base = {tuple(p.encode().split()): label for p, label in (base or BASE).items()}
        self.labels = [label for label, _, _ in templates]
        self.words = [words(text.encode()) for _, text, _ in templates]
        self.keys = [[(self._place(body, k.encode().split()), k.encode().split()) for k in keys] for body, (_, _, keys) in zip(self.words, templates)]
        holding = Counter(w for body in self.words for w in set(body))
        self.rarity = {w: math.log(len(self.words) / n) for w, n in holding.items()}
        self.postings: dict[bytes, list[tuple[int, int]]] = defaultdict(list)
        self.needed, self.least = [], 2
        for t, body in enumerate(self.words):
            rare = sorted(range(len(body)), key=lambda i: (-self.rarity[body[i]], i))[:RARE]
            self.needed.append(VOTES * len(rare))
            if max(Counter(body[i] for i in rare).values()) >= self.needed[-1]:
                self.least = 1  # one word alone can give a template its votes
            for at in rare:
                self.postings[body[at]].append((t, at))
        self.postings = dict(self.postings)
        self.vocabulary = frozenset(self.postings) | {w for p in self.base for w in p}

    @staticmethod
    def _place(body: list[bytes], phrase: list[bytes]) -> int:
        return next(i for i in range(len(body)) if body[i : i + len(phrase)] == phrase)


def base_places(found: list[bytes], index: Index, common: set[bytes]) -> list[tuple[int, bytes]]:
    """(start, label) of each place where a base phrase's words stand consecutively."""
    out = []
    for phrase, label in index.base.items():
        if common.issuperset(phrase):
            first, n, at = phrase[0], len(phrase), -1
            try:
                while True:
                    at = found.index(first, at + 1)
                    if tuple(found[at : at + n]) == phrase:
                        out.append((at, label))
            except ValueError:
                pass
    return out


def share_at(found: list[bytes], t: int, start: int, index: Index) -> float:
    """The share of a template's words in place if it begins at ``start``; 0 without its key phrases."""
    for place, p in index.keys[t]:
        if not any(found[k : k + len(p)] == p for k in range(max(0, start + place - SLACK), start + place + SLACK + 1)):
            return 0.0
    body = index.words[t]
    return sum(0 <= start + i < len(found) and found[start + i] == w for i, w in enumerate(body)) / len(body)


def align(found: list[bytes], index: Index, common: set[bytes]) -> dict[str, tuple[float, int]]:
    """label -> (share of the template's words in place, start) of its best verified alignment, the first of equals."""
    chosen, votes = common & index.postings.keys(), Counter()
    if len(chosen) >= index.least:
        for at, word in enumerate(found):
            if word in chosen:
                for t, place in index.postings[word]:
                    votes[t, at - place] += 1
    out: dict[str, tuple[float, int]] = {}
    for t, start in sorted((x for x, n in votes.items() if n >= index.needed[x[0]]), key=lambda x: (x[1], x[0])):
        share = share_at(found, t, start, index)
        if share > out.get(index.labels[t], (0.0, 0))[0]:
            out[index.labels[t]] = (share, max(0, start))
    return out


def scan(docs: DataFrame, index: Index | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans (`label:start` of each base
    place and alignment). Null text: no words. One pass without a shuffle.

    The score is the best share of a template's words found in place; a base phrase counts as at least a half.
    """
    index = index or Index()
    rows = texts(docs, id_col, text_col)

    def kernel(batch, made):
        out: dict = {k: [] for k in ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans")}
        for text in byte_texts(batch):
            found = words(text)
            common = index.vocabulary.intersection(found)
            base = base_places(found, index, set(common)) if common else []
            more = align(found, index, set(common)) if common else {}
            labels = {label for _, label in base}
            at = [p for p, _ in base]
            values = (
                len(found), len(base), min(at) if at else None, max(at) if at else None,
                ",".join(sorted(labels)), ",".join(sorted(labels | set(more))),
                max([0.5 if base else 0.0, *(share for share, _ in more.values())]),
                ",".join([*(f"{label}:{p}" for p, label in sorted(base)), *(f"{label}:{p}" for label, (_, p) in sorted(more.items()))]),
            )
            for k, v in zip(out, values):
                out[k].append(v)
        return {"doc_id": batch.column("doc_id")} | out

    schema = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans string"
    return map_texts(rows, kernel, schema)


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
