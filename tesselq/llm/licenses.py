"""Licences of texts: a positional index of rare words over licence notices.

Each notice of ``TEMPLATES`` is words with positions; whole notices are there a paragraph each. Words are
ranked by inverse document frequency over the whole corpus. The index holds the postings (notice,
position) of each notice's rarest words, as many as make up ``INDEXED`` of its weight; every word of a file
is looked up there, and postings that agree on an offset between file and notice, give or take ``SLACK``
words, vote for that placement. A placement whose score is high enough lacks at most 1 - ``AGREE`` of the
weight, so its indexed words alone have INDEXED + AGREE - 1 of it, and placements with fewer votes go.
The others are verified word by word, weighted by rarity, and by a mandatory key phrase that must stand
inside. Fixed phrases are found in any case: those of ``PHRASES`` are the base and their places count;
those of ``NAMES``, which every one of ``PHRASES`` contains, only give a label.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import rows_of, table, utf8

#: Fixed phrases and their labels.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
#: Names that are enough for a label, though not for a place; each of ``PHRASES`` holds one of them.
NAMES = {"the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
#: Notices by label, and the phrases of which one must stand in a match.
TEMPLATES = (
    ("mit", "released under the mit license", ("mit license",)),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction", ("hereby granted free of charge",)),
    ("apache-2", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license", ("apache license version 2", "apache license 2")),
    ("apache-2", "licensed under the apache license version 2 0", ("apache license version 2", "apache license 2")),
    ("cc-by-nc", "licensed under cc by nc 4 0", ("cc by nc",)),
    ("cc-by-nc", "this work is licensed under a creative commons attribution noncommercial 4 0 international license", ("attribution noncommercial",)),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license", ("commons attribution 4", "commons attribution 3")),
    ("cc-by-sa", "this work is licensed under a creative commons attribution sharealike 4 0 international license", ("attribution sharealike",)),
    ("gpl-3", "this work is licensed under the gnu general public license version 3", ("gnu general public license version 3",)),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", ("copies or substantial portions of the software",)),
    ("gpl-3", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license", ("version 3 of the license",)),
    ("gpl-2", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license", ("version 2 of the license",)),
    ("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation", ("gnu lesser general public license",)),
    ("agpl-3", "you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license", ("gnu affero general public license",)),
    ("apache-2", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied", ("distributed under the license is distributed on an as is basis",)),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ("source and binary forms",)),
    ("bsd", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer", ("redistributions of source code must retain",)),
    ("bsd", "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution", ("redistributions in binary form must reproduce",)),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0", ("mozilla public license",)),
    ("mpl-2", "if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0", ("copy of the mpl was not distributed",)),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies", ("with or without fee is hereby granted",)),
    ("zlib", "altered source versions must be plainly marked as such and must not be misrepresented as being the original software", ("altered source versions must be plainly marked",)),
    ("unlicense", "this is free and unencumbered software released into the public domain", ("unencumbered software released into the public domain",)),
    ("boost", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license", ("any person or organization obtaining",)),
    ("epl-2", "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0", ("eclipse public license",)),
)
#: Weighted share of a notice that must agree, share of its weight that is indexed, and words that a place may be off.
AGREE, INDEXED, SLACK = 0.75, 0.5, 2

#: A-Z to a-z, other ASCII but letters and digits to a blank; bytes of other characters stay.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(FOLD).split()


class Index:
    """Postings of the notices' rarest words, with idf over a corpus of ``n`` texts of which ``df[w]`` hold w."""

    def __init__(self, n: int, df: dict[bytes, int]) -> None:
        self.notices = [(label, [w.encode() for w in words.split()], [b" " + p.encode() + b" " for p in phrases]) for label, words, phrases in TEMPLATES]
        self.idf = {w: math.log((n + 1) / (df.get(w, 0) + 1)) + 1e-6 for _, words, _ in self.notices for w in words}
        self.weight: list[float] = []
        self.least: list[float] = []
        self.postings: dict[bytes, list[tuple[int, int]]] = defaultdict(list)
        for t, (_, words, _) in enumerate(self.notices):
            total, held = sum(self.idf[w] for w in words), 0.0
            for i in sorted(range(len(words)), key=lambda i: (-self.idf[words[i]], i)):
                if held >= INDEXED * total:
                    break
                self.postings[words[i]].append((t, i))
                held += self.idf[words[i]]
            self.weight.append(total)
            self.least.append(held - (1 - AGREE) * total - 1e-9)

    def match(self, words: list[bytes]) -> dict[str, float]:
        """Score by label, of the placements that hold."""
        if self.postings.keys().isdisjoint(words):
            return {}
        votes: dict[int, dict[int, float]] = defaultdict(lambda: defaultdict(float))
        for at, w in enumerate(words):
            for t, i in self.postings.get(w, ()):
                votes[t][at - i] += self.idf[w]
        found: dict[str, float] = {}
        for t, at_offset in votes.items():
            label = self.notices[t][0]
            for at in {at + k for at in at_offset for k in range(-SLACK, SLACK + 1)}:
                if sum(at_offset.get(at + k, 0.0) for k in range(-SLACK, SLACK + 1)) >= self.least[t]:
                    score = self.verify(words, t, at)
                    if score >= AGREE:
                        found[label] = max(found.get(label, 0.0), score)
        return found

    def verify(self, words: list[bytes], t: int, at: int) -> float:
        """Weighted share of notice ``t`` that stands at ``at``, each word at most ``SLACK`` off; 0 without a key phrase."""
        _, own, phrases = self.notices[t]
        window = words[max(0, at - SLACK) : at + len(own) + SLACK]
        text = b" " + b" ".join(window) + b" "
        if not any(p in text for p in phrases):
            return 0.0
        shift = at - max(0, at - SLACK)
        return min(1.0, sum(self.idf[w] for i, w in enumerate(own) if w in window[max(0, i + shift - SLACK) : max(0, i + shift + SLACK + 1)]) / self.weight[t])


def phrase_places(words: list[bytes], phrases: dict[str, str] = NAMES) -> tuple[set[str], list[int]]:
    """Labels of ``phrases`` in a text, and the start of each place, counted in words."""
    labels: set[str] = set()
    places: list[int] = []
    text = b" " + b" ".join(words) + b" "
    for phrase, label in phrases.items():
        own = b" " + phrase.encode() + b" "
        at, last, word = text.find(own), 0, 0
        while at >= 0:
            word += text.count(b" ", last, at)
            labels.add(label)
            places.append(word)
            last, at = at, text.find(own, at + 1)
    return labels, places


def document_frequency(docs: DataFrame) -> tuple[int, dict[bytes, int]]:
    """Texts in ``docs``, and for each word of the notices how many hold it, over whole texts; no more rows than the notices have words."""
    vocabulary = {w.encode() for _, words, _ in TEMPLATES for w in words.split()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count: Counter = Counter()
        for part in rows_of(batches, 4_000_000):
            for t in utf8(part.column("text")):
                count[b""] += 1
                count.update(vocabulary.intersection(words_of(t)))
        yield pa.RecordBatch.from_pydict({"word": pa.array([w.decode() for w in count], pa.string()), "n": pa.array(list(count.values()), pa.int64())})

    rows = docs.select("text").mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    df = {r["word"].encode(): r["n"] for r in rows}
    return df.pop(b"", 0), df


def label_licenses(docs: DataFrame) -> DataFrame:
    """One row for each row of ``docs`` (doc_id, text): words, places of ``PHRASES``, labels and score.

    score is that of the best placement, 0.5 where only a phrase or name stands, 0 without labels. Null and empty
    texts have no words. Equal placements count once; repeated rows come out as often as they go in and
    count as often in the document frequencies; null ids stay null; other columns are ignored; an empty
    table gives no rows.
    """
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    n, df = document_frequency(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(n, df)
        for part in rows_of(batches, 4_000_000):
            n_words, n_base, first, last, base, labels, score = ([] for _ in range(7))
            for t in utf8(part.column("text")):
                words = words_of(t)
                named, _ = phrase_places(words)
                own, places = phrase_places(words, PHRASES) if named else (set(), [])
                found = index.match(words)
                n_words.append(len(words))
                n_base.append(len(places))
                first.append(min(places, default=None))
                last.append(max(places, default=None))
                base.append(",".join(sorted(own)))
                labels.append(",".join(sorted(named | found.keys())))
                score.append(max(found.values(), default=0.5 if named else 0.0))
            longs = {"n_words": n_words, "n_base": n_base, "first_word": first, "last_word": last}
            yield pa.RecordBatch.from_pydict(
                {"doc_id": part.column("doc_id").combine_chunks()} | {k: pa.array(v, pa.int64()) for k, v in longs.items()}
                | {"base_labels": pa.array(base, pa.string()), "labels": pa.array(labels, pa.string()), "score": pa.array(score, pa.float64())}
            )

    return docs.mapInArrow(run, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return label_licenses(table(spark, sf_dir, "documents"))
