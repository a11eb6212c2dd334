"""Licence scan: matching statistics on a generalised suffix automaton of licence words.

The words of all templates build one suffix automaton.  A document's words are streamed through it
once; after each word the state tells the longest run of words ending there that occurs in some
template.  Where that run stops growing it is a maximal match.  Matches of ``MIN_MATCH`` words or
more are chained, template by template, in the order of both texts with bounded gaps; a chain is a
span of the document, and the share of the template that it covers is its score.  A short phrase
that names a licence is found by the same walk: it ends wherever its state lies on the suffix links
of the current one.

Templates are a fixed table of a few kB, sent with the function.  Documents are scanned where they
lie; nothing is shuffled and no document depends on another, so skew and copies do not matter.

Defined results: null and empty texts have no words, no places, empty labels and score 0; every
place of a phrase counts, overlapping or not; repeated rows are each scanned.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mirrortab.llm.automaton import SuffixAutomaton
from mirrortab.llm.common import alnum_words, query, table

#: Phrases of the contract and their labels.  Fixed values.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: Notices as licences publish them, in their customary wording.  Fixed values.
TEMPLATES = (
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated"
     " documentation files (the Software), to deal in the Software without restriction, including without limitation the"
     " rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("mit", "Licensed under the MIT License."),
    ("apache", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance"
     " with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("apache", "Licensed under the Apache License, Version 2.0."),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public"
     " License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("gpl", "This work is licensed under the GNU General Public License, version 3."),
    ("lgpl", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("agpl", "under the terms of the GNU Affero General Public License as published by the Free Software Foundation"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the"
     " following conditions are met"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not"
     " distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby"
     " granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by", "Licensed under CC BY 4.0."),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0."),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    ("cc-by", "CC BY 4.0"),
    ("cc-by-sa", "CC BY-SA 4.0"),
    ("cc-by-nc", "CC BY-NC 4.0"),
    ("unlicense", "This is free and unencumbered software released into the public domain."),
)

#: Words of the shortest match that is chained.
MIN_MATCH = 4
#: Words that may lie between two matches of a chain, in either text.
MAX_GAP = 8
#: Share of a template that a span must cover for its label.
MIN_COVERED = 0.75


class Scanner:
    """The automaton of templates and phrases, and what its states stand for."""

    def __init__(self, templates=TEMPLATES, phrases=PHRASES) -> None:
        self.number: dict[bytes, int] = {}
        texts = [(label, text, True) for label, text in templates] + [(label, text, False) for text, label in phrases.items()]
        sequences = [[self.number.setdefault(w, len(self.number)) for w in alnum_words(text)] for _, text, _ in texts]
        self.automaton = automaton = SuffixAutomaton()
        for sequence in sequences:
            automaton.add(sequence)
        states = len(automaton.length)
        self.labels = [label for label, _, _ in texts]
        self.words = [len(s) for s in sequences]
        self.places: list[set] = [set() for _ in range(states)]
        self.phrases: list[tuple] = [()] * states
        for t, ((label, _, is_template), sequence) in enumerate(zip(texts, sequences)):
            state = 0
            for end, symbol in enumerate(sequence):
                state = automaton.next[state][symbol]
                if is_template:
                    self.places[state].add((t, end))
            if not is_template:
                self.phrases[state] += ((label, len(sequence)),)
        order = sorted(range(1, states), key=automaton.length.__getitem__)
        for state in order:
            self.phrases[state] += self.phrases[automaton.link[state]]
        for state in reversed(order):
            self.places[automaton.link[state]] |= self.places[state]

    def matches(self, words: list[bytes]):
        """``(base places as (start, label), maximal matches as (start, words, state))``."""
        base: list[tuple[int, str]] = []
        found: list[tuple[int, int, int]] = []
        ids = np.fromiter(map(self.number.get, words, repeat(-1)), np.int64, len(words))
        edge = np.diff(np.concatenate(([0], (ids >= 0).astype(np.int8), [0])))
        begins, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        shortest = 2 if self.words and min(self.words) > 1 else 1
        long = ends - begins >= shortest
        arrows, link, length, phrases = self.automaton.next, self.automaton.link, self.automaton.length, self.phrases
        for begin, end in zip(begins[long].tolist(), ends[long].tolist()):
            state = matched = 0
            for i in range(begin, end):
                symbol = int(ids[i])
                target = arrows[state].get(symbol)
                if target is None:
                    if matched >= MIN_MATCH:
                        found.append((i - matched, matched, state))
                    while target is None and state:
                        state = link[state]
                        matched = length[state]
                        target = arrows[state].get(symbol)
                    if target is None:
                        continue
                state, matched = target, matched + 1
                for label, k in phrases[state]:
                    if k <= matched:
                        base.append((i - k + 1, label))
            if matched >= MIN_MATCH:
                found.append((end - matched, matched, state))
        return base, found

    def spans(self, found) -> list[tuple[int, int, int, float]]:
        """Chains as ``(template, first word, end, covered share)``."""
        done: list[tuple[int, int, int, float]] = []
        open_: dict[int, list[int]] = {}  # template -> start, end, end in the template, covered words

        def close(t: int) -> None:
            start, end, _, covered = open_.pop(t)
            done.append((t, start, end, covered / self.words[t]))

        for start, size, state in found:
            fits: dict[int, tuple[int, int]] = {}
            for t, last in self.places[state]:
                here, there, words = start, last - size + 1, size
                if t in open_:
                    _, end, reached, _ = open_[t]
                    skip = max(0, end - here)
                    here, there, words = here + skip, there + skip, words - skip
                    if words > 0 and 0 <= there - reached <= MAX_GAP and here - end <= MAX_GAP:
                        if t not in fits or fits[t][1] > there:
                            fits[t] = (here, there)
                        continue
                    here, there = start, last - size + 1
                if t not in fits:
                    fits[t] = (-1, there)
            for t, (here, there) in fits.items():
                end = start + size
                if here >= 0:
                    chain = open_[t]
                    words = end - here
                    chain[1], chain[2], chain[3] = end, there + words, chain[3] + words
                else:
                    if t in open_:
                        close(t)
                    open_[t] = [start, end, there + size, size]
        for t in list(open_):
            close(t)
        return sorted(done)

    def scan(self, text: str | None) -> dict:
        words = alnum_words(text)
        base, found = self.matches(words)
        spans = [s for s in self.spans(found) if s[3] >= MIN_COVERED]
        base_labels = {label for _, label in base}
        starts = [s for s, _ in base]
        return {
            "n_words": len(words), "n_base": len(base),
            "first_word": min(starts, default=None), "last_word": max(starts, default=None),
            "base_labels": ",".join(sorted(base_labels)),
            "labels": ",".join(sorted(base_labels | {self.labels[s[0]] for s in spans})),
            "score": 1.0 if base else max((s[3] for s in spans), default=0.0),
            "spans": [{"label": self.labels[t], "first": a, "end": b, "covered": c} for t, a, b, c in spans],
        }


FIELDS = pa.struct([
    ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()),
    ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()),
    ("spans", pa.list_(pa.struct([("label", pa.string()), ("first", pa.int64()), ("end", pa.int64()), ("covered", pa.float64())]))),
])

_SCANNERS: dict[tuple, Scanner] = {}


def license_scan(docs: DataFrame, templates=TEMPLATES, phrases=None, text: str = "text", to: str = "license") -> DataFrame:
    """``docs`` with a struct column ``to``: counts, labels, score and covered template spans.

    A column that is called ``to`` already is replaced; texts of any length are scanned whole.
    """
    phrases = dict(PHRASES if phrases is None else phrases)
    templates = tuple(templates)
    kept = docs.drop(to)
    where, columns = kept.columns.index(text), kept.columns
    found = "struct<n_words:bigint,n_base:bigint,first_word:bigint,last_word:bigint,base_labels:string,labels:string,score:double," \
        "spans:array<struct<label:string,first:bigint,end:bigint,covered:double>>>"
    schema = T.StructType([T.StructField(str(i), f.dataType) for i, f in enumerate(kept.schema.fields)])
    schema = schema.add("found", T.DataType.fromDDL(found))

    def run(frames):
        key = (templates, tuple(phrases.items()))
        if key not in _SCANNERS:
            _SCANNERS[key] = Scanner(templates, phrases)
        scan = _SCANNERS[key].scan
        for batch in frames:
            rows = [scan(t.as_py()) for t in batch.column(where)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rows, FIELDS)], schema.names)

    return kept.mapInArrow(run, schema).toDF(*columns, to)


@query("op1_license_scan")
def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = license_scan(docs)
    columns = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans")
    return found.select("doc_id", *[F.col("license")[c].alias(c) for c in columns])
