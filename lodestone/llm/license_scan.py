"""Licence scans with a positional index of rare words.

Templates are passages of licences: paragraphs of their texts, the notices that files carry, short
statements with and without versions, and identifiers; families of them are made by rule. Words in
few templates (SPREAD at most) are posted with their positions, and weighted by their inverse
document frequency over all templates. A file's words that are posted vote for (template, relative
position); votes within a drift that grows with the template's length count together, so that small
edits do not hurt. A template's score is the weight of its words found in line over the weight of
all that are posted. It counts if it reaches LEAST and all its mandatory phrases stand, word for
word, where the votes put the template. A finding inside a longer one's words, or of a label that
yields to another one found, is dropped (so `cc by nc sa 4.0` is not `cc by nc` as well).

Besides, plain phrases give base labels wherever they stand.

Cases: null, empty and wordless texts have no labels and a score of 0. Repeated rows give repeated
results. Extra columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache
from math import log

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

PHRASES = [("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl")]

#: Fixed values: (label, passage, mandatory phrases). Passages are quoted from the licences.
TEMPLATES = [
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software", ["permission is hereby granted free of charge"]),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement", ["copies or substantial portions of the software"]),
    ("mit", "released under the mit license", ["mit license"]),
    ("mit", "licensed under the mit license", ["mit license"]),
    ("mit", "distributed under the terms of the mit license", ["mit license"]),
    ("apache-2.0", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at", ["you may not use this file except in compliance with the license"]),
    ("apache-2.0", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license", ["unless required by applicable law or agreed to in writing"]),
    ("apache-2.0", "apache license version 2 0", ["apache license version 2 0"]),
    ("apache-2.0", "apache 2 0 license", ["apache 2 0 license"]),
    ("apache-1.1", "apache software license version 1 1", ["apache software license version 1 1"]),
    ("bsd-2-clause", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer", ["redistribution and use in source and binary forms"]),
    ("bsd-3-clause", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", ["may be used to endorse or promote products derived from this software"]),
    ("bsd-4-clause", "all advertising materials mentioning features or use of this software must display the following acknowledgement this product includes software developed by", ["all advertising materials mentioning features or use of this software"]),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies", ["permission to use copy modify and or distribute this software"]),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely", ["including commercial applications and to alter it and redistribute it freely"]),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at", ["terms of the mozilla public license v 2 0"]),
    ("mpl-1.1", "the contents of this file are subject to the mozilla public license version 1 1 the license you may not use this file except in compliance with the license", ["mozilla public license version 1 1"]),
    ("epl-2.0", "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0 which is available at", ["eclipse public license 2 0"]),
    ("epl-1.0", "this program and the accompanying materials are made available under the terms of the eclipse public license v1 0 which accompanies this distribution", ["eclipse public license v1 0"]),
    ("bsl-1.0", "distributed under the boost software license version 1 0", ["boost software license version 1 0"]),
    ("artistic-2.0", "under the terms of the artistic license 2 0", ["artistic license 2 0"]),
    ("unlicense", "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software", ["free and unencumbered software released into the public domain"]),
    ("wtfpl", "do what the fuck you want to public license", ["what the fuck you want to public license"]),
    ("cc0-1.0", "the person who associated a work with this deed has dedicated the work to the public domain by waiving all of his or her rights to the work worldwide under copyright law", ["dedicated the work to the public domain"]),
    ("cc0-1.0", "cc0 1 0 universal", ["cc0 1 0"]),
    ("cc0-1.0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work", ["waived all copyright and related or neighboring rights"]),
    ("ofl-1.1", "this font software is licensed under the sil open font license version 1 1", ["sil open font license version 1 1"]),
    ("odbl-1.0", "open data commons open database license", ["open database license"]),
    ("proprietary", "all rights reserved no part of this publication may be reproduced stored in a retrieval system or transmitted in any form or by any means", ["no part of this publication may be reproduced"]),
]
#: Fixed values: (start of the label, name, versions) of one family of licences.
COPYLEFT = [("gpl", "gnu general public license", ["2.0", "3.0"]), ("lgpl", "gnu lesser general public license", ["2.1", "3.0"]), ("lgpl", "gnu library general public license", ["2.0"]), ("agpl", "gnu affero general public license", ["3.0"])]
#: Codes and names of the parts of Creative Commons licences, kinds and versions of them.
PARTS = {"by": ["attribution"], "nc": ["noncommercial", "non commercial"], "nd": ["noderivatives", "no derivatives", "noderivs"], "sa": ["sharealike", "share alike"]}
KINDS, VERSIONS = ["by", "by-sa", "by-nc", "by-nd", "by-nc-sa", "by-nc-nd"], ["", "2.0", "2.5", "3.0", "4.0"]
#: A label that is dropped where another one is found.
YIELDS = {"bsd-2-clause": {"bsd-3-clause", "bsd-4-clause"}}


def family_templates() -> list[tuple[str, str, list[str]]]:
    """Notices, statements and identifiers that differ by name and version alone."""
    out = []
    for short, name, versions in COPYLEFT:
        for version in versions:
            v = version.removesuffix(".0").replace(".", " ")
            notice = f"is free software you can redistribute it and or modify it under the terms of the {name} as published by the free software foundation either version {v} of the license or at your option any later version"
            out.append((f"{short}-{version}-or-later", notice, [f"terms of the {name}", f"version {v} of the license"]))
            forms = [f"{name} version {v}", f"{name} v{v}", f"{short} v{v}", f"{short}v{v}", f"{short} {version.replace('.', ' ')}"]
            out += [(f"{short}-{version}", f, [f]) for f in dict.fromkeys(forms)]
    for kind in KINDS:
        codes = kind.split("-")
        names = [""]
        for code in codes:
            names = [f"{n} {p}".strip() for n in names for p in PARTS[code]]
        for version in VERSIONS:
            label, v = f"cc-{kind}" + f"-{version}" * bool(version), version.replace(".", " ")
            forms = [f"cc {' '.join(codes)} {v}", f"creativecommons org licenses {' '.join(codes)} {v}", *(f"creative commons {n} {v}" for n in names)]
            out += [(label, f.strip(), [f.strip()]) for f in forms]
    known = sorted({label for label, _, _ in [*TEMPLATES, *out] if label != "proprietary"})
    identifiers = [(label, f"spdx license identifier {' '.join(label.replace('-', ' ').replace('.', ' ').split())}") for label in known]
    return out + [(label, text, [text]) for label, text in identifiers]


#: Words of all prose, never posted where a template has others.
COMMON = frozenset("a all an and any are as at be been but by do each for from had has have he her his if in into is it its may no not of on one only or other our out so some such than that the their them then there these they this to up was we were what when which who will with would you your".split())
LEAST = 0.6
#: Largest share of the templates that hold a posted word.
SPREAD = 0.2
#: A template's words may be out of line by one word for so many of its words.
DRIFT = 8

_CLEAN = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    """Runs of [a-z0-9] and characters beyond ASCII, with A-Z lower-cased."""
    return (text or "").encode().translate(_CLEAN).split()


class Index:
    def __init__(self, templates: list[tuple[str, str, list[str]]]):
        self.labels = [label for label, _, _ in templates]
        texts = [text.encode().split() for _, text, _ in templates]
        self.sizes = [len(words) for words in texts]
        self.needed = [[p.encode().split() for p in phrases] for _, _, phrases in templates]
        frequency = Counter(w for words in texts for w in set(words))
        self.postings: dict[bytes, list[tuple[int, int, float]]] = defaultdict(list)
        self.total = []
        most = max(1, SPREAD * len(texts))
        for t, words in enumerate(texts):
            rare = [k for k, w in enumerate(words) if frequency[w] <= most and w.decode() not in COMMON]
            # where every word is common, the rarest ones stand in
            rare = rare or [k for k, w in enumerate(words) if frequency[w] == min(frequency[x] for x in words)]
            weights = [log(1 + len(texts) / frequency[words[k]]) for k in rare]
            for k, weight in zip(rare, weights, strict=True):
                self.postings[words[k]].append((t, k, weight))
            self.total.append(sum(weights))
        #: word -> its weight in each template, wherever it stands there
        self.shares = {w: [(t, sum(x for u, _, x in of if u == t)) for t in dict.fromkeys(u for u, _, _ in of)] for w, of in self.postings.items()}

    def candidates(self, vocabulary: set[bytes]) -> set[int]:
        """Templates of whose words enough stand anywhere in a file, and all of their phrases'."""
        weight: dict[int, float] = defaultdict(float)
        for w in vocabulary & self.shares.keys():
            for t, share in self.shares[w]:
                weight[t] += share
        return {t for t, w in weight.items() if w >= (LEAST - 1e-9) * self.total[t] and all(vocabulary.issuperset(p) for p in self.needed[t])}

    def findings(self, words: list[bytes], vocabulary: set[bytes] | None = None) -> list[tuple[str, int, int, float]]:
        """(label, first word, end, score) of each template that stands in a file, at its best place."""
        open_ = self.candidates(set(words) if vocabulary is None else vocabulary)
        if not open_:
            return []
        votes: dict[int, list[tuple[int, int, float]]] = defaultdict(list)
        postings = {w: mine for w, of in self.postings.items() if (mine := [x for x in of if x[0] in open_])}
        for at in [i for i, w in enumerate(words) if w in postings]:
            for t, k, weight in postings[words[at]]:
                votes[t].append((at - k, k, weight))
        found = []
        for t, cast in votes.items():
            cast.sort()
            drift, size = self.sizes[t] // DRIFT, self.sizes[t]
            best, i = None, 0
            held: Counter[int] = Counter()
            weight = 0.0
            for shift, k, w in cast:  # a window of the drift over the shifts; each place counts once
                held[k] += 1
                weight += w * (held[k] == 1)
                while cast[i][0] < shift - drift:
                    held[cast[i][1]] -= 1
                    weight -= cast[i][2] * (not held[cast[i][1]])
                    i += 1
                if weight >= (LEAST - 1e-9) * self.total[t] and (best is None or weight > best[0] + 1e-9):
                    near = words[max(0, cast[i][0]) : shift + size + drift]
                    if all(places(near, p) for p in self.needed[t]):
                        best = (weight, max(0, cast[i][0]), shift + size)
            if best:
                found.append((self.labels[t], best[1], min(best[2], len(words)), round(min(1.0, best[0] / self.total[t]), 6)))
        return found

    def scan(self, words: list[bytes], vocabulary: set[bytes] | None = None) -> list[tuple[str, int, int, float]]:
        """The findings that no longer one of another label contains, and that yield to none."""
        found = self.findings(words, vocabulary)
        longest = [x for x in found if not any(y[1] <= x[1] and x[2] <= y[2] and y[2] - y[1] > x[2] - x[1] and y[0] != x[0] for y in found)]
        labels = {x[0] for x in longest}
        return sorted(x for x in longest if not YIELDS.get(x[0], set()) & labels)


def places(words: list[bytes], phrase: list[bytes]) -> list[int]:
    """Where the words of a phrase stand in a row."""
    out, at, n = [], -1, len(phrase)
    try:
        while True:
            at = words.index(phrase[0], at + 1)
            if words[at : at + n] == phrase:
                out.append(at)
    except ValueError:
        return out


@lru_cache(maxsize=1)
def _index() -> Index:
    return Index(TEMPLATES + family_templates())


def scan_text(text: str | None) -> tuple:
    words = words_of(text)
    vocabulary = set(words)
    base: set[str] = set()
    spots: list[int] = []
    for phrase, label in PHRASES:
        parts = phrase.encode().split()
        if vocabulary.issuperset(parts) and (at := places(words, parts)):
            base.add(label)
            spots += at
    found = _index().scan(words, vocabulary)
    score = max([*(x[3] for x in found), 0.5 if base else 0.0])
    return len(words), len(spots), min(spots, default=None), max(spots, default=None), ",".join(sorted(base)), ",".join(sorted(base | {x[0] for x in found})), score


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]
    for batch in batches:
        rows = [scan_text(t) for t in batch.column(1).to_pylist()]
        columns = list(zip(*rows, strict=True)) if rows else [()] * len(kinds)
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True))], names=["id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"])


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    schema = f"id {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"
    return rows.mapInArrow(_scan, schema).withColumnRenamed("id", id_col)
