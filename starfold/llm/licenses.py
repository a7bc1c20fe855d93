"""License scan: exact set-containment join of text blocks with license templates.

A token is a pair of consecutive words, so the order of words counts and line feeds do not. A block is any
stretch of ``SPAN`` times a template's words; it matches when it holds at least ``threshold`` of the
template's distinct tokens. Tokens are ordered by their frequency in the whole corpus, rarest first, and
only pairs that pass three lossless filters are compared: prefix (a match shares one of the template's
``n - need + 1`` rarest tokens), length (the text has ``need`` tokens of templates) and position (the tokens
after the first common one still suffice). The blocks of a text that passes are the windows that start at
one of its tokens. Templates are a parameter of bounded size and travel with the tasks; the corpus is read
twice, once for the frequencies and once for the join.
"""

from __future__ import annotations

import math
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starfold.llm.common import blank, map_batches

THRESHOLD = 0.8
SPAN = 1.25

#: (phrase, label) of the plain search for consecutive words.
PHRASES = [
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
]

#: (label, text): notices as the licenses themselves suggest them, and the usual short forms.
TEMPLATES = [
    ("gpl-3", "This work is licensed under the GNU General Public License, version 3."),
    (
        "gpl",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
        "General Public License as published by the Free Software Foundation",
    ),
    ("apache-2", "Licensed under the Apache License, Version 2.0"),
    ("apache-2", "you may not use this file except in compliance with the License"),
    ("mit", "Released under the MIT License"),
    (
        "mit",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
        "associated documentation files",
    ),
    (
        "bsd",
        "Redistribution and use in source and binary forms, with or without modification, are permitted "
        "provided that the following conditions are met",
    ),
    ("cc-by-nc-4", "Licensed under CC BY-NC 4.0"),
    ("cc-by-4", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    (
        "mit",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions "
        "of the Software",
    ),
    (
        "gpl",
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the "
        "implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License "
        "for more details",
    ),
    (
        "lgpl",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser "
        "General Public License as published by the Free Software Foundation",
    ),
    (
        "agpl",
        "it under the terms of the GNU Affero General Public License as published by the Free Software Foundation",
    ),
    (
        "apache-2",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is "
        'distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND',
    ),
    (
        "isc",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
        "hereby granted",
    ),
    (
        "bsd-3",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote "
        "products derived from this software without specific prior written permission",
    ),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
    ("cc-by-sa-4", "licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("epl-2", "made available under the terms of the Eclipse Public License 2.0"),
]

# Bytes that stand in words: digits, letters and everything beyond ASCII; the rest becomes a space.
_WORD_BYTES = [chr(b).isalnum() if b < 128 else True for b in range(256)]
_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if _WORD_BYTES[b] else 32 for b in range(256))

FOUND = "doc_id long, n_words long, places array<struct<label:string,start:long>>, " + (
    "blocks array<struct<label:string,first_word:long,last_word:long,containment:double>>"
)


def words_of(text: str) -> list[bytes]:
    return text.encode().translate(_WORDS).split()


def phrase_places(words: list[bytes], phrases=PHRASES) -> list[tuple[str, int]]:
    """(label, index of the first word) of every place where a phrase's words stand together."""
    joined = b" " + b" ".join(words) + b" "
    out = []
    for phrase, label in phrases:
        wanted = f" {phrase} ".encode()
        at, seen, index = joined.find(wanted), 0, 0
        while at >= 0:
            index += joined.count(b" ", seen, at)
            seen = at
            out.append((label, index))
            at = joined.find(wanted, at + 1)
    return out


class TemplateIndex:
    """Templates as ranked token lists with an inverted index over their prefixes."""

    def __init__(self, templates, counts: dict[tuple[bytes, bytes], int], threshold: float = THRESHOLD, span: float = SPAN):
        kept = [(label, words_of(text)) for label, text in templates]
        kept = [(label, words) for label, words in kept if len(words) > 1]
        held = [set(zip(words, words[1:])) for _, words in kept]
        ordered = sorted(set().union(*held), key=lambda p: (counts.get(p, 0), p))
        self.tokens = ordered
        self.follow: dict[bytes, dict[bytes, int]] = {}
        for i, (first, second) in enumerate(ordered):
            self.follow.setdefault(first, {})[second] = i
        rank = {p: i for i, p in enumerate(ordered)}
        self.labels = [label for label, _ in kept]
        self.widths = [math.ceil(span * len(words) - 1e-9) for _, words in kept]
        self.templates = [sorted(rank[p] for p in pairs) for pairs in held]
        self.need = [math.ceil(threshold * len(t) - 1e-9) for t in self.templates]
        self.least = min(self.need, default=1)
        self.prefixes: dict[int, list[tuple[int, int]]] = {}
        for t, template in enumerate(self.templates):
            for i, token in enumerate(template[: len(template) - self.need[t] + 1]):
                self.prefixes.setdefault(token, []).append((t, i))

    def hits(self, words: list[bytes]) -> list[tuple[int, int]]:
        """(index of the first word, token) of every template token in a text."""
        follow, out = self.follow, []
        for i in [i for i, w in enumerate(words) if w in follow]:
            token = follow[words[i]].get(words[i + 1]) if i + 1 < len(words) else None
            if token is not None:
                out.append((i, token))
        return out

    def candidates(self, hits: list[tuple[int, int]]) -> list[int]:
        """The templates that the whole text may contain."""
        own = sorted({token for _, token in hits})
        if len(own) < self.least:
            return []
        met = {}
        for j, token in enumerate(own):
            for t, i in self.prefixes.get(token, ()):
                if t not in met:
                    need, template = self.need[t], self.templates[t]
                    met[t] = len(own) - j >= need and len(template) - i >= need
        return [t for t, possible in met.items() if possible and len(set(own).intersection(self.templates[t])) >= self.need[t]]

    def search(self, words: list[bytes]) -> list[tuple[int, int, int, float]]:
        """(template, first word, last word, containment): the best block of each stretch that matches."""
        hits = self.hits(words)
        return [block for t in self.candidates(hits) for block in self._blocks(t, hits)]

    def _blocks(self, t: int, hits: list[tuple[int, int]]) -> list[tuple[int, int, int, float]]:
        template, width = set(self.templates[t]), self.widths[t]
        own = [h for h in hits if h[1] in template]
        held, end, out = Counter(), 0, []
        for start, token in own:
            # A token takes two words, so the last one of a block starts before its last word.
            while end < len(own) and own[end][0] <= start + width - 2:
                held[own[end][1]] += 1
                end += 1
            if len(held) >= self.need[t]:
                block = (t, start, own[end - 1][0] + 1, len(held) / len(template))
                if out and start <= out[-1][2]:
                    if block[3] > out[-1][3]:
                        out[-1] = block
                else:
                    out.append(block)
            held[token] -= 1
            if not held[token]:
                del held[token]
        return out


def token_counts(docs: DataFrame, index: TemplateIndex) -> dict[tuple[bytes, bytes], int]:
    """How often each token of a template stands in the corpus."""

    def run(batch):
        counts = Counter()
        for text in batch.column(0).to_pylist():
            counts.update(token for _, token in index.hits(words_of(text)))
        columns = [pa.array(list(counts), pa.int32()), pa.array(counts.values(), pa.int64())]
        yield pa.record_batch(columns, names=["token", "n"])

    rows = map_batches(docs.select(blank("text").alias("text")), run, "token int, n long")
    return {index.tokens[r.token]: r.n for r in rows.groupBy("token").agg(F.sum("n").alias("n")).collect()}


def scan(docs: DataFrame, templates=TEMPLATES, phrases=PHRASES, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, n_words, places, blocks): one row per document, in the docs' own order and number.

    Words are maximal runs of ASCII letters and digits and of characters beyond ASCII, A-Z
    lower-cased. ``places`` holds each place of a phrase, ``blocks`` the best block of each stretch that
    contains a template, with its first and last word; templates of one word are not looked for. Null text
    is empty and matches nothing; null ids and repeated rows are scanned like others; other columns are
    ignored.
    """
    counts = token_counts(docs, TemplateIndex(templates, {}, threshold))
    index = TemplateIndex(templates, counts, threshold)

    def run(batch):
        totals, places, blocks = [], [], []
        for text in batch.column(1).to_pylist():
            words = words_of(text)
            totals.append(len(words))
            places.append([{"label": a, "start": b} for a, b in phrase_places(words, phrases)])
            blocks.append(
                [
                    {"label": index.labels[t], "first_word": first, "last_word": last, "containment": share}
                    for t, first, last, share in index.search(words)
                ]
            )
        place = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64())]))
        block = [("label", pa.string()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("containment", pa.float64())]
        arrays = [pa.array(totals, pa.int64()), pa.array(places, place), pa.array(blocks, pa.list_(pa.struct(block)))]
        yield pa.record_batch([batch.column(0), *arrays], names=["doc_id", "n_words", "places", "blocks"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), blank("text").alias("text"))
    return map_batches(rows, run, FOUND)
