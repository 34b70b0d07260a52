"""Licence scans by an exact set-similarity join of text blocks with licence templates.

Templates are sets of words. Words are ordered by their frequency over all documents, rarest first. Blocks are the lines of a text
and, over line ends, all its runs of as many words as the template has, so that wrapped notices are met whole. A block contains a
template to the threshold if it has at least ``ceil(threshold * size)`` of its words, so it must hold one of the first
``size - that + 1`` words of the template in this order (prefix filter). Of a block only its words known to any template count:
fewer than needed end the comparison (length filter), and so does a first common word after which either side has too few words
left (positional filter). Survivors are counted exactly, so the join finds every block that meets the threshold. As a text holds all words of its runs, the filters are applied to whole
texts first, and runs are counted for the templates that are left. Of runs that overlap the best one is listed, and none that a line
of the same template contains as well. A line counts if a run of twice
the template's words in it is enough, and a block must hold the words that tell the template's licence from others. A phrase is a
template with threshold 1 whose block is the whole text; an exact comparison of word order follows.

The templates are a fixed list and the only thing sent to the executors.

Edge cases: null and empty texts have no words and no labels; a threshold met exactly is met; repeated rows are scanned on their
own; a text with more than one match of a label lists every one, and of matches at one word those of blocks come first, by label; very
long texts are scanned whole, in memory in proportion to the text; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from conceptloom.llm.common import documents, in_bytes

# Phrases and their labels.
PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}
# Notices of public licences, as their texts suggest to print them.
NOTICES = (
    ("mit", "Released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction"),
    ("apache-2", "Licensed under the Apache License, Version 2.0"),
    ("apache-2", "you may not use this file except in compliance with the License. You may obtain a copy of the License at http www apache org licenses LICENSE-2.0"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("gpl-3", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl-3", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("lgpl-3", "This library is licensed under the GNU Lesser General Public License, version 3"),
    ("bsd-3", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
)
THRESHOLD = 0.8
# Words that tell a licence from others. A block must hold those that its template has, whatever else it holds.
# lgpl-3 has none: the SQL labels the GPL notice lgpl-3 as well, and the tables hold such documents.
TELLING = {
    "mit": "mit", "apache-2": "apache 2", "cc-by-nc": "cc nc creative commons noncommercial", "cc-by": "creative commons attribution", "gpl-3": "gnu general 3",
    "mpl-2": "mozilla 2",
}
# Words of a line that may hold a template, as a multiple of its own.
SPREAD = 2

_TABLE = bytes((c + 32 if 65 <= c <= 90 else c) if c >= 128 or chr(c).isalnum() else 32 for c in range(256))
MATCH = "struct<label:string,kind:string,first_word:long,n_words:long,containment:double>"


def words_of(text: bytes) -> list[bytes]:
    """Lower-cased runs of ASCII letters, digits and non-ASCII characters."""
    return text.translate(_TABLE).split()


@dataclass
class Template:
    label: str
    words: list[bytes]  # in the order of the text
    threshold: float
    phrase: bool
    ranked: list[bytes] = field(default_factory=list)  # distinct, rarest first
    telling: frozenset[bytes] = frozenset()

    @property
    def needed(self) -> int:
        return math.ceil(self.threshold * len(self.ranked) - 1e-9)


class Scanner:
    """Templates indexed by the words of their prefixes, for one order of words."""

    def __init__(self, templates: list[Template], frequency: dict[bytes, int]):
        self.templates = templates
        vocabulary = sorted({w for t in templates for w in t.words}, key=lambda w: (frequency.get(w, 0), w))
        self.rank = {w: i for i, w in enumerate(vocabulary)}
        self.block_index: dict[bytes, list[tuple[int, int]]] = {}
        self.phrase_index: dict[bytes, list[int]] = {}
        for i, t in enumerate(templates):
            t.ranked = sorted(set(t.words), key=self.rank.__getitem__)
            for position, w in enumerate(t.ranked[: len(t.ranked) - t.needed + 1]):
                if t.phrase:
                    self.phrase_index.setdefault(w, []).append(i)
                else:
                    self.block_index.setdefault(w, []).append((i, position))
        self.starters = frozenset(self.block_index) | frozenset(self.phrase_index)
        self.blocked = frozenset(self.block_index)

    def block(self, words: list[bytes]) -> Iterator[tuple[Template, float]]:
        """The templates that a block contains to their thresholds."""
        known = sorted({self.rank[w] for w in words if w in self.rank})
        if not known:
            return
        here = frozenset(words)
        seen: set[int] = set()
        names = {self.rank[w]: w for w in here if w in self.rank}
        for at, r in enumerate(known):
            for i, position in self.block_index.get(names[r], ()):
                t = self.templates[i]
                if i in seen:
                    continue
                seen.add(i)  # the first common word is met first: both sides are in one order
                if len(known) < t.needed or 1 + min(len(t.ranked) - position - 1, len(known) - at - 1) < t.needed:
                    continue
                common = sum(w in here for w in t.ranked)
                if common >= t.needed:
                    yield t, common / len(t.ranked)

    def runs(self, words: list[bytes]) -> Iterator[tuple[Template, int, int, float]]:
        """(template, first word, number of words, containment) of runs as long as a template that contain it, the best of overlapping ones."""
        for t, _ in self.block(words):
            for first, last, common in self.spans(t, words, len(t.words)):
                yield t, first, last - first + 1, common / len(t.ranked)

    def spans(self, t: Template, words: list[bytes], length: int) -> Iterator[tuple[int, int, int]]:
        """(first, last, words in common) of runs of at most ``length`` words that contain the template, the best of overlapping ones."""
        own = frozenset(t.ranked)
        places = [i for i, w in enumerate(words) if w in own]
        held: Counter[bytes] = Counter()
        low, best = 0, None
        for last in places:
            held[words[last]] += 1
            while places[low] <= last - length:
                w = words[places[low]]
                held[w] -= 1
                if not held[w]:
                    del held[w]
                low += 1
            if len(held) < t.needed or not t.telling <= held.keys():
                continue
            if best and places[low] > best[1]:
                yield best
                best = None
            if not best or len(held) > best[2]:
                best = places[low], last, len(held)
        if best:
            yield best

    def scan(self, text: bytes) -> tuple[int, list[dict]]:
        """Number of words, and every match in the order of the text."""
        words = words_of(text)
        if self.starters.isdisjoint(words):
            return len(words), []
        found = []
        here = frozenset(words)
        for w in self.phrase_index:
            for i in self.phrase_index[w] if w in here else ():
                t = self.templates[i]
                if not here.issuperset(t.ranked):
                    continue
                k, n, at = t.words.index(w), len(t.words), -1
                while True:
                    try:
                        at = words.index(w, at + 1)
                    except ValueError:
                        break
                    if at >= k and words[at - k : at - k + n] == t.words:
                        found.append({"label": t.label, "kind": "phrase", "first_word": at - k, "n_words": n, "containment": 1.0})
        start, met = 0, []
        for line in text.split(b"\n"):
            own = words_of(line)
            if not self.blocked.isdisjoint(own):
                for t, _ in self.block(own):
                    common = max((n for _, _, n in self.spans(t, own, SPREAD * len(t.words))), default=0)
                    if common:
                        met.append((t, start, len(own), common / len(t.ranked)))
            start += len(own)
        if b"\n" in text and not self.blocked.isdisjoint(here):
            lines = list(met)
            met += [(t, at, n, c) for t, at, n, c in self.runs(words) if not any(t is u and at < a + m and a < at + n and c <= d for u, a, m, d in lines)]
        found += [{"label": t.label, "kind": "block", "first_word": at, "n_words": n, "containment": c} for t, at, n, c in met]
        return len(words), sorted(found, key=lambda m: (m["first_word"], m["kind"], m["label"]))


def templates_of(phrases: dict[str, str], notices: tuple[tuple[str, str], ...], threshold: float) -> list[Template]:
    return [Template(label, words_of(p.encode()), 1.0, True) for p, label in phrases.items()] + [
        Template(label, words_of(n.encode()), threshold, False, telling=frozenset(words_of(TELLING.get(label, "").encode())) & frozenset(words_of(n.encode()))) for label, n in notices
    ]


def word_frequencies(docs: DataFrame, vocabulary: frozenset[bytes]) -> dict[bytes, int]:
    """In how many documents each word of the fixed vocabulary stands; counted over all documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[bytes] = Counter()
        for batch in batches:
            for text in in_bytes(batch.column(0)):
                total.update(vocabulary.intersection(words_of(text)))
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.binary()), pa.array(list(total.values()), pa.int64())], names=["word", "n"])

    counts = docs.select("text").mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return {bytes(r.word): r.n for r in counts.collect()}  # a row for each word of the templates at most


def scan_licenses(docs: DataFrame, phrases: dict[str, str] = PHRASES, notices: tuple[tuple[str, str], ...] = NOTICES, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, text) to (doc_id, n_words, matches): every match with its label, kind, place in words and containment."""
    templates = templates_of(phrases, notices, threshold)
    frequency = word_frequencies(docs, frozenset(w for t in templates for w in t.words))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates, frequency)
        kind = pa.list_(pa.struct([("label", pa.string()), ("kind", pa.string()), ("first_word", pa.int64()), ("n_words", pa.int64()), ("containment", pa.float64())]))
        for batch in batches:
            found = [scanner.scan(text) for text in in_bytes(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([n for n, _ in found], pa.int64()), pa.array([m for _, m in found], kind)], names=["doc_id", "n_words", "matches"])

    slim = docs.select("doc_id", "text")
    return slim.mapInArrow(scan, f"doc_id {dict(slim.dtypes)['doc_id']}, n_words long, matches array<{MATCH}>")


def op9_license_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phrases and labels of every whole text."""
    base = F.filter("matches", lambda m: m["kind"] == "phrase")
    starts = F.transform(base, lambda m: m["first_word"])
    labels = lambda ms: F.array_join(F.sort_array(F.array_distinct(F.transform(ms, lambda m: m["label"]))), ",")
    return scan_licenses(documents(spark, sf_dir)).select(
        "doc_id", "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        labels(base).alias("base_labels"), labels(F.col("matches")).alias("labels"),
        F.coalesce(F.array_max(F.transform("matches", lambda m: m["containment"])), F.lit(0.0)).alias("score"),
    )

