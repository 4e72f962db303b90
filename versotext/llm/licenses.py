"""Licence scan with a positional rare-token index.

Every template is a licence statement or a licence's text. Its anchors, the words with the highest
inverse document frequency in the whole corpus, are indexed with their places. All
anchors that stand in a file are looked up; each hit votes for the place where the
template would have to begin (place in the file minus place in the template). Places
are intersected with some slack, more for longer templates, so that words put in or left out
don't part a template from its votes: a template word counts at a beginning b if it stands in the
file at b plus its place or up to ``slack`` words later.
Beginnings with enough votes are compared word by word, and the template's mandatory
key phrases must stand in the file near that place.

A template has so many anchors, and so few votes are asked for, that no place with the
wanted share of the template's idf mass can miss them: the scan finds what a comparison
at every place would.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from versotext.llm.text import id_and_text, pieces, plain_words, raw_texts

#: Phrases whose places are always counted, with their labels.
BASE_PHRASES = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))


@dataclass(frozen=True)
class Template:
    label: str
    text: str
    mandatory: tuple[str, ...]


#: Licence statements and the phrases each must hold.
TEMPLATES = (
    Template("mit", "released under the mit license", ("mit license",)),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", ("permission is hereby granted free of charge",)),
    Template("apache-2", "licensed under the apache license version 2 0", ("apache license", "version 2")),
    Template("apache-2", "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0", ("apache org licenses license 2 0",)),
    Template("cc-by-nc", "licensed under cc by nc 4 0", ("cc by nc",)),
    Template("cc-by-nc", "this work is licensed under a creative commons attribution noncommercial 4 0 international license", ("creative commons attribution noncommercial",)),
    Template("cc-by-sa", "licensed under cc by sa 4 0", ("cc by sa",)),
    Template("cc-by-sa", "this work is licensed under a creative commons attribution sharealike 4 0 international license", ("creative commons attribution sharealike",)),
    Template("cc-by", "this work is licensed under a creative commons attribution 4 0 international license", ("creative commons attribution 4",)),
    Template("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights", ("waived all copyright",)),
    Template("gpl-2", "this work is licensed under the gnu general public license version 2", ("gnu general public license", "version 2")),
    Template("gpl-3", "this work is licensed under the gnu general public license version 3", ("gnu general public license", "version 3")),
    Template("lgpl", "licensed under the gnu lesser general public license", ("gnu lesser general public license",)),
    Template("agpl-3", "licensed under the gnu affero general public license version 3", ("gnu affero general public license",)),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ("redistribution and use in source and binary forms",)),
    Template("bsd", "released under the bsd license", ("bsd license",)),
    Template("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0", ("mozilla public license",)),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ("with or without fee is hereby granted",)),
    Template("unlicense", "this is free and unencumbered software released into the public domain", ("unencumbered software released into the public domain",)),
    Template("proprietary", "all rights reserved no part of this work may be reproduced", ("all rights reserved",)),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software", ("permission is hereby granted free of charge", "sublicense and or sell copies")),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall the copyright holder or contributors be liable for any direct indirect incidental special exemplary or consequential damages", ("redistribution and use in source and binary forms", "must reproduce the above copyright notice")),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness in no event shall the author be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software", ("with or without fee is hereby granted",)),
    Template("apache-2", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license", ("apache license version 2", "distributed on an as is basis")),
    Template("gpl-2", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details", ("gnu general public license as published", "version 2 of the license")),
    Template("gpl-3", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details", ("gnu general public license as published", "version 3 of the license")),
    Template("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version this library is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu lesser general public license for more details", ("gnu lesser general public license as published",)),
    Template("agpl-3", "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version", ("gnu affero general public license as published",)),
    Template("unlicense", "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means", ("unencumbered software released into the public domain", "compile sell or distribute")),
    Template("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions the origin of this software must not be misrepresented", ("the origin of this software must not be misrepresented",)),
    Template("bsl-1", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software and to permit third parties to whom the software is furnished to do so", ("person or organization obtaining a copy", "prepare derivative works")),
)

OUTPUT = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, matches string"


class Index:
    """Postings of template words, and which of them are looked up."""

    def __init__(self, frequency: dict[bytes, int], documents: int, templates=TEMPLATES, base=BASE_PHRASES, rare: int = 6, share: float = 0.7):
        self.share, self.rare = share, rare
        self.words = [t.text.encode().split() for t in templates]
        self.slack = [2 + len(ws) // 20 for ws in self.words]
        self.labels = [t.label for t in templates]
        self.mandatory = [tuple(b" " + m.encode() + b" " for m in t.mandatory) for t in templates]
        self.idf = {w: math.log((documents + 1) / (frequency.get(w, 0) + 1)) + 1 for ws in self.words for w in ws}
        # of each template the words with the highest idf are its anchors; ties by the word itself
        self.anchors = [self._anchors(ws) for ws in self.words]
        self.least = [self._least(ws, kept) for ws, kept in zip(self.words, self.anchors, strict=True)]
        self.postings: dict[bytes, list[tuple[int, int]]] = defaultdict(list)
        for t, ws in enumerate(self.words):
            kept = set(self.anchors[t])
            for place, w in enumerate(ws):
                if w in kept:
                    self.postings[w].append((t, place))
        self.base = [(p.encode().split(), label) for p, label in base]
        self.base_first = {ws[min(range(len(ws)), key=lambda i: -self.idf.get(ws[i], 99.0))] for ws, _ in self.base}
        self.lookup = frozenset(self.postings) | self.base_first

    def _anchors(self, ws: list[bytes]) -> list[bytes]:
        """At least ``rare`` words, and more while a place with the wanted share could hold fewer than two of them, or less than half of that share in them."""
        ranked = sorted(set(ws), key=lambda w: (-self.idf[w], w))
        total = sum(self.idf[w] for w in ws)
        n = self.rare
        while n < len(ranked) and (self._least(ws, ranked[:n]) < 2 or sum(self.idf[w] for w in ws if w in ranked[n:]) > self.share / 2 * total):
            n += 1
        return ranked[:n]

    def _least(self, ws: list[bytes], anchors: list[bytes]) -> int:
        """How many places of anchors any place with the wanted share holds at least."""
        total = sum(self.idf[w] for w in ws)
        masses = sorted((self.idf[w] for w in ws if w in anchors), reverse=True)
        held, n = total - sum(masses), 0
        while n < len(masses) and held < (self.share - 1e-9) * total:
            held += masses[n]
            n += 1
        return n

    def base_places(self, words: list[bytes]) -> list[tuple[int, str]]:
        found = []
        at = defaultdict(list)
        for i, w in enumerate(words):
            if w in self.base_first:
                at[w].append(i)
        for ws, label in self.base:
            k = min(range(len(ws)), key=lambda i: -self.idf.get(ws[i], 99.0))
            for i in at.get(ws[k], ()):
                if i >= k and words[i - k : i - k + len(ws)] == ws:
                    found.append((i - k, label))
        return found

    def matches(self, words: list[bytes]) -> list[tuple[str, int, float]]:
        """(label, first word, share of the template's idf mass in place) of each verified template.

        Of neighbouring beginnings of a template that all hold it, the one with the largest share counts, then the smallest.
        """
        hits: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for i, w in enumerate(words):
            if w in self.postings:
                for t, place in self.postings[w]:
                    hits[t].append((i - place, place))
        found = []
        for t, own in hits.items():
            if len(own) >= self.least[t]:
                held = [(b, *self.compare(t, b, words)) for b in self._beginnings(t, sorted(own))]
                found += self.best(t, [(b, share, first) for b, share, first in held if share >= self.share and self.certain(t, b, words)])
        return sorted(found)

    def _beginnings(self, t: int, own: list[tuple[int, int]]) -> list[int]:
        """Beginnings with votes enough of different places, the hits (offset, place) being sorted."""
        ws, anchors = self.words[t], set(self.anchors[t])
        out, seen = [], Counter()
        left = right = 0
        at = own[0][0] - self.slack[t]
        # the share that the votes of different places leave possible
        total = sum(self.idf[w] for w in ws)
        possible = sum(self.idf[w] for w in ws if w not in anchors)
        while left < len(own):
            while right < len(own) and own[right][0] <= at + self.slack[t]:
                seen[own[right][1]] += 1
                if seen[own[right][1]] == 1:
                    possible += self.idf[ws[own[right][1]]]
                right += 1
            while left < right and own[left][0] < at:
                seen[own[left][1]] -= 1
                if not seen[own[left][1]]:
                    del seen[own[left][1]]
                    possible -= self.idf[ws[own[left][1]]]
                left += 1
            if left == right:  # no hit in reach: on to the next one
                if right == len(own):
                    break
                at = own[right][0] - self.slack[t]
                continue
            if len(seen) >= self.least[t] and possible > (self.share - 1e-6) * total:
                out.append(at)
            at += 1
        return out

    def compare(self, t: int, begin: int, words: list[bytes]) -> tuple[float, int]:
        """The share of a template's idf mass that stands at a beginning, and the first place of it."""
        held, first, total = 0.0, len(words), 0.0
        for j, w in enumerate(self.words[t]):
            total += self.idf[w]
            near = words[max(0, begin + j) : max(0, begin + j + self.slack[t] + 1)]
            if w in near:
                held += self.idf[w]
                first = min(first, max(0, begin + j) + near.index(w))
        return held / total, first

    def certain(self, t: int, begin: int, words: list[bytes]) -> bool:
        """Whether all mandatory phrases stand near."""
        near = b" " + b" ".join(words[max(0, begin - 4) : max(0, begin + len(self.words[t]) + self.slack[t] + 8)]) + b" "
        return all(m in near for m in self.mandatory[t])

    def best(self, t: int, held: list[tuple[int, float, int]]) -> list[tuple[str, int, float]]:
        """Of each run of beginnings (begin, share, first place) no further apart than the slack, the best one."""
        out, run = [], []
        for k, (begin, share, first) in enumerate(held):
            run.append((-share, begin, first))
            if k + 1 == len(held) or held[k + 1][0] - begin > self.slack[t] + 1:
                share, _, first = min(run)
                out.append((self.labels[t], first, -share))
                run = []
        return out


def _document_frequency(docs: DataFrame, vocabulary: frozenset[bytes]) -> tuple[dict[bytes, int], int]:
    """In how many documents each template word stands, over all documents; the vocabulary is fixed and small."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[bytes] = Counter()
        rows = 0
        for batch in pieces(batches, "text"):
            for raw in raw_texts(batch):
                rows += 1
                if raw:
                    seen.update(vocabulary.intersection(plain_words(raw)))
        names = [*(w.decode() for w in seen), None]
        yield pa.RecordBatch.from_pydict({"word": pa.array(names, pa.string()), "n": pa.array([*seen.values(), rows], pa.int64())})

    rows = docs.select("text").mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    counts = {r["word"]: r["n"] for r in rows}
    total = counts.pop(None, 0)
    return {w.encode(): n for w, n in counts.items()}, total


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates=TEMPLATES, base=BASE_PHRASES, rare: int = 6, share: float = 0.7) -> DataFrame:
    """Licence labels of every document.

    One row per input row: ``n_words``, ``n_base`` (places of base phrases),
    ``first_word``/``last_word`` (smallest and largest place of a base phrase,
    else null), ``base_labels``, ``labels`` (base and template labels, distinct,
    sorted, comma-joined), ``score`` (1 with a base phrase, else the largest share
    of a verified template's idf mass, else 0) and ``matches``
    (``label@first word`` of each verified template).

    Null and empty texts have no words, no places, empty labels and score 0. A null
    id stays null. Repeated rows get a row each; other columns are ignored.
    """
    own = id_and_text(docs, id_col, text_col)
    vocabulary = frozenset(w for t in templates for w in t.text.encode().split())
    frequency, total = _document_frequency(own, vocabulary)
    index = Index(frequency, total, templates, base, rare, share)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            out: list[tuple] = []
            for raw in raw_texts(batch):
                words = plain_words(raw) if raw else []
                present = index.lookup.intersection(words)
                if not present:
                    out.append((len(words), 0, None, None, "", "", 0.0, ""))
                    continue
                places = index.base_places(words)
                found = index.matches(words)
                base_labels = {label for _, label in places}
                labels = base_labels | {label for label, _, _ in found}
                starts = [p for p, _ in places]
                score = 1.0 if places else max((s for _, _, s in found), default=0.0)
                out.append((len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted(base_labels)), ",".join(sorted(labels)), score, ",".join(f"{label}@{begin}" for label, begin, _ in found)))
            columns = list(zip(*out, strict=True))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), pa.string()]
            names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "matches"]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], ["doc_id", *names])

    return own.mapInArrow(scan, OUTPUT)
