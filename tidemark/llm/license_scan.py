"""Licence scan with a positional index of rare licence words.

Words are ranked by inverse template frequency. A template is matched by runs of at least MIN_RUN of its words (SHORT_RUN
for a short one) that stand in a file in order, with gaps of any length between the runs; the words of the best chain of
runs are its share. A file is looked at for a template where

1. all mandatory key phrases of the template stand in it, and
2. of the template's highest-IDF words, as many as have to be left when the smallest share that counts is reached, one
   stands in the file with its neighbours at the same relative positions: the intersection of their postings. Fewer words
   than that can't be missing, so no file is lost by it.

Then the best chain that holds the key phrases whole is found by dynamic programming over the template's words, all places
of the file at once. Base phrases are templates whose every place counts: they are anchored at their
rarest word and compared at all its places.

Words are the runs of ASCII letters, digits and non-ASCII characters of the text with A-Z lower-cased, compared by a
64-bit hash. One narrow pass, no shuffle; only the index (a few kB, fixed by the templates) is sent to tasks.

Defined results: a null or empty text has no words (counts 0, labels "", score 0, places null); repeated rows and null ids
give a row each; other columns are ignored; empty input gives no rows.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.kernels import NOT_ALNUM, Words, slices, words

# The phrases that the scan has to find, and their labels.
BASE_PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: Words that a run has at least, in a template of SHORT words or more, and in a shorter one.
MIN_RUN, SHORT_RUN, SHORT = 3, 2, 12


@dataclass(frozen=True)
class Template:
    label: str
    text: str
    key_phrases: tuple[str, ...]


# Openings of well-known public licence notices, and the phrases without which they don't count.
TEMPLATES = (
    Template("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions", ("permission is hereby granted", "without restriction")),
    Template("mit", "Released under the MIT License", ("mit license",)),
    Template("apache", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at", ("apache license", "version 2 0")),
    Template("apache", "Licensed under the Apache License, Version 2.0", ("apache license",)),
    Template("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version", ("general public license", "free software")),
    Template("gpl", "This work is licensed under the GNU General Public License, version 3", ("general public license",)),
    Template("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", ("redistribution and use in source and binary forms",)),
    Template("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies", ("with or without fee is hereby granted",)),
    Template("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at", ("mozilla public license",)),
    Template("unlicense", "This is free and unencumbered software released into the public domain", ("unencumbered software", "public domain")),
    Template("cc-by", "This work is licensed under the Creative Commons Attribution 4.0 International License", ("creative commons attribution 4 0",)),
    Template("gpl", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version", ("general public license", "version 2")),
    Template("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version", ("lesser general public license",)),
    Template("agpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version", ("affero general public license",)),
    Template("bsd", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", ("endorse or promote products derived from this software",)),
    Template("zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely", ("alter it and redistribute it freely",)),
    Template("boost", "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license", ("person or organization obtaining a copy",)),
    Template("mit-0", "Licensed under MIT No Attribution", ("mit no attribution",)),
    Template("artistic", "This package is licensed under the Artistic License 2.0", ("artistic license 2 0",)),
    Template("epl", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at", ("eclipse public license",)),
    Template("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work", ("waived all copyright and related or neighboring rights",)),
    Template("ofl", "This Font Software is licensed under the SIL Open Font License, Version 1.1", ("sil open font license",)),
    Template("psf", "This LICENSE AGREEMENT is between the Python Software Foundation and the Individual or Organization accessing and otherwise using this software", ("python software foundation",)),
    Template("ms-pl", "This license governs use of the accompanying software. If you use the software, you accept this license. If you do not accept the license, do not use the software", ("governs use of the accompanying software",)),
    Template("cddl", "The contents of this file are subject to the terms of the Common Development and Distribution License", ("common development and distribution license",)),
    Template("gfdl", "Permission is granted to copy, distribute and/or modify this document under the terms of the GNU Free Documentation License, Version 1.3", ("free documentation license",)),
    Template("eupl", "Licensed under the EUPL, Version 1.2 or as soon they will be approved by the European Commission", ("eupl",)),
    *(Template(f"cc-by{short}", f"This work is licensed under the Creative Commons Attribution{name} 4.0 International License", (f"creative commons attribution{name} 4 0",)) for short, name in (("-nc", "-NonCommercial"), ("-sa", "-ShareAlike"), ("-nd", "-NoDerivatives"), ("-nc-sa", "-NonCommercial-ShareAlike"), ("-nc-nd", "-NonCommercial-NoDerivatives"))),
    *(Template(f"cc-by{short}", f"Licensed under CC BY{short} 4.0", (f"cc by{short} 4 0",)) for short in ("", "-nc", "-sa", "-nd", "-nc-sa", "-nc-nd")),
)


def _hashes(text: str) -> np.ndarray:
    return words(pa.array([text]), NOT_ALNUM, lower=True).hash


class Index:
    """Templates as hashes, and the places of their highest-IDF words. least: the smallest share that counts."""

    def __init__(self, templates: Sequence[Template], phrases: dict[str, str], least: float):
        self.least = least
        self.templates = [_hashes(t.text) for t in templates]
        self.labels = [t.label for t in templates]
        self.keys = [[_hashes(k) for k in t.key_phrases] for t in templates]
        self.phrases = [(_hashes(p), label) for p, label in phrases.items()]
        self.key_places = [[self._place(hs, key) for key in keys] for hs, keys in zip(self.templates, self.keys)]
        n = len(templates)
        held = Counter(h for hs in self.templates for h in set(hs.tolist()))
        self.idf = {h: math.log((1 + n) / (1 + c)) for h, c in held.items()}
        self.runs = [min(len(hs), MIN_RUN if len(hs) >= SHORT else SHORT_RUN) for hs in self.templates]
        # So many words can be missing at most; of one more, one is left.
        self.rare = [sorted(range(len(hs)), key=lambda p: (-self.idf[int(hs[p])], p))[: len(hs) - self.needed(len(hs)) + 1] for hs in self.templates]
        rarest = lambda hs: int(np.argmax([self.idf.get(h, math.inf) for h in hs.tolist()]))
        self.anchors = [rarest(hs) for hs, _ in self.phrases]
        self.key_anchors = [[rarest(hs) for hs in keys] for keys in self.keys]

    @staticmethod
    def _place(template: np.ndarray, key: np.ndarray) -> int:
        """Where a mandatory phrase begins in its template."""
        for p in range(len(template) - len(key) + 1):
            if (template[p : p + len(key)] == key).all():
                return p
        raise ValueError("a template has to hold its key phrases")

    def needed(self, n: int) -> int:
        """Words of a template of n that have to stand in chain."""
        return math.ceil(self.least * n - 1e-9)


def find_phrase(w: Words, phrase: np.ndarray, anchor: int = 0) -> np.ndarray:
    """All places where the phrase's words stand consecutively in one document."""
    at = np.flatnonzero(w.hash == phrase[anchor]) - anchor
    at = at[(at >= 0) & (at + len(phrase) <= len(w.hash))]
    for j, h in enumerate(phrase):
        at = at[w.hash[at + j] == h]
    return at[w.doc[at] == w.doc[at + len(phrase) - 1]]


#: Each mandatory phrase that a chain holds counts more than all words of a template.
PHRASE = 10_000


def best_chain(words_of: np.ndarray, template: np.ndarray, run: int, phrases: Sequence[tuple[int, int, np.ndarray]] = ()) -> tuple[int, int]:
    """(phrases, words): of the chains of runs of at least `run` words of the template, one that holds the most of the
    phrases, and then the most words. phrases: first and last word within the template, counted from 0 and from 1, and the
    places in the file behind each occurrence."""
    n = len(words_of)
    best = [np.zeros(n + 1, np.int64)]
    going = np.full(n + 1, -1, np.int64)  # chains whose last run ends right here
    diagonal = np.zeros(n + 1, np.int64)
    for p, h in enumerate(template, 1):
        hit = np.append(False, words_of == h)
        diagonal = np.where(hit, np.append(0, diagonal[:-1]) + 1, 0)
        longer = np.append(-1, going[:-1])
        longer = np.where(hit & (longer >= 0), longer + 1, -1)
        opened = np.full(n + 1, -1, np.int64)
        if p >= run and n >= run:
            opened[run:] = best[p - run][: n + 1 - run] + run
            for low, high, ends in phrases:  # those within the run's first words
                if p - run <= low and high < p:
                    opened[ends[ends + p - high <= n] + p - high] += PHRASE
            opened[diagonal < run] = -1
        going = np.maximum(longer, opened)
        for low, high, ends in phrases:
            if high == p:
                whole = ends[(diagonal[ends] >= high - low) & (going[ends] >= 0)]
                going[whole] += PHRASE
        best.append(np.maximum(best[-1], np.maximum.accumulate(np.maximum(going, 0))))
        if p > run:
            best[p - run - 1] = best[0][:0]  # no longer read
    return divmod(int(best[-1][-1]), PHRASE)


def _matches(w: Words, index: Index) -> list[tuple[int, int, float]]:
    """(document, template, share of its words that fit) of the verified templates of each document."""
    found = []
    if not len(w.hash):
        return found
    for t, hs in enumerate(index.templates):
        stands = [find_phrase(w, key, anchor) for key, anchor in zip(index.keys[t], index.key_anchors[t])]
        has = np.ones(w.n_docs, bool)
        for places in stands:
            has &= np.bincount(w.doc[places], minlength=w.n_docs) > 0
        if not has.any():
            continue
        # Places of the rare words, in files that have the key phrases, where a run of the template stands around them.
        near = np.flatnonzero(has[w.doc])
        near = near[np.isin(w.hash[near], hs[index.rare[t]])]
        seeded = np.zeros(w.n_docs, bool)
        for p in index.rare[t]:
            q = near[w.hash[near] == hs[p]]
            for start in range(max(0, p - index.runs[t] + 1), min(p, len(hs) - index.runs[t]) + 1):
                fits = np.ones(len(q), bool)
                for j in range(start, start + index.runs[t]):
                    there = q + j - p
                    inside = (there >= 0) & (there < len(w.hash))
                    there = np.clip(there, 0, len(w.hash) - 1)
                    fits &= inside & (w.hash[there] == hs[j]) & (w.doc[there] == w.doc[q])
                seeded[w.doc[q[fits]]] = True
        for d in np.flatnonzero(seeded).tolist():
            first, n = w.first[d], w.counts[d]
            held = [(low, low + len(key), places[(places >= first) & (places < first + n)] + len(key) - first) for low, key, places in zip(index.key_places[t], index.keys[t], stands)]
            phrases, total = best_chain(w.hash[first : first + n], hs, index.runs[t], held)
            if phrases == len(held) and total >= index.needed(len(hs)):
                found.append((d, t, total / len(hs)))
    return found


SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: Sequence[Template] = TEMPLATES, phrases: dict[str, str] = BASE_PHRASES, least: float = 0.8) -> DataFrame:
    """One row per document: number of words, places of base phrases, labels and the best template score.

    least: share of a template's words that have to stand in chain.
    """
    index = Index(templates, phrases, least)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                w = words(part.column("text"), NOT_ALNUM, lower=True)
                n = part.num_rows
                count, first, last = np.zeros(n, np.int64), np.full(n, np.iinfo(np.int64).max), np.full(n, -1, np.int64)
                base: dict[int, set[str]] = {}
                for (hs, label), anchor in zip(index.phrases, index.anchors):
                    at = find_phrase(w, hs, anchor)
                    doc = w.doc[at]
                    np.add.at(count, doc, 1)
                    np.minimum.at(first, doc, at - w.first[doc])
                    np.maximum.at(last, doc, at - w.first[doc])
                    for d in np.unique(doc).tolist():
                        base.setdefault(d, set()).add(label)
                labels = {d: set(x) for d, x in base.items()}
                score = np.zeros(n)
                score[list(base)] = 1.0
                for d, t, s in _matches(w, index):
                    labels.setdefault(d, set()).add(index.labels[t])
                    score[d] = max(score[d], s)
                none = count == 0
                joined = lambda x: pa.array([",".join(sorted(x.get(d, ()))) for d in range(n)], pa.string())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(w.counts.astype(np.int64)), pa.array(count), pa.array(first, mask=none), pa.array(last, mask=none), joined(base), joined(labels), pa.array(score)], names=["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(scan, SCHEMA)
