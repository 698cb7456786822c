"""License scans with a positional rare-token index.

Templates are licence texts, given as a table of (label, text, mandatory key phrases); a base phrase is
a template that is nothing but its key phrase.  The index holds every word of every template: word ->
(template, position).  For each file and each template whose key words it has, the file's INDEXED words of
highest IDF (over all files) among the template's are looked up; an occurrence at p of a word at q of
the template proposes that the template starts at p - q, be it before the file's first word, where a
head is cut off.  A proposal is verified: the template's mandatory key phrases must stand there, word
after word, at most SLACK words off their places.

A task holds a text at about 60 times its bytes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textscan as ts

# The phrases that must be found, and their labels.
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

#: label, template, mandatory key phrases
TEMPLATES = [
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files to deal in the software without restriction", ("hereby granted free of charge", "without restriction")),
    ("mit", "released under the mit license", ("mit license",)),
    ("gpl", "gnu general public license", ("gnu general public license",)),
    ("lgpl", "gnu lesser general public license", ("gnu lesser general public license",)),
    ("agpl", "gnu affero general public license", ("gnu affero general public license",)),
    ("mpl-2", "mozilla public license", ("mozilla public license",)),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ("for any purpose with or without fee",)),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ("redistribution and use in source and binary forms",)),
    ("bsd-3", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software", ("endorse or promote products",)),
    ("apache-2", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license", ("apache license version 2",)),
    ("apache-2", "you may obtain a copy of the license at http www apache org licenses license 2 0", ("apache org licenses license 2 0",)),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", ("gnu general public license",)),
    ("gpl", "this work is licensed under the gnu general public license version 3", ("gnu general public license",)),
    ("lgpl", "licensed under the gnu lesser general public license", ("gnu lesser general public license",)),
    ("agpl", "licensed under the gnu affero general public license", ("gnu affero general public license",)),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0", ("mozilla public license",)),
    ("cc-by-nc", "this work is licensed under a creative commons attribution noncommercial 4 0 international license", ("creative commons attribution noncommercial",)),
    ("cc-by-nc", "licensed under cc by nc 4 0", ("cc by nc",)),
    ("cc-by-sa", "this work is licensed under a creative commons attribution sharealike 4 0 international license", ("creative commons attribution sharealike",)),
    ("cc-by", "licensed under cc by 4 0", ("cc by 4 0",)),
    ("unlicense", "this is free and unencumbered software released into the public domain", ("unencumbered software",)),
]

INDEXED = 6  # words of a template that are looked up in a file, the rarest that it has
SLACK = 3  # words by which a key phrase may be off its place

COLUMNS = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"


def _hashes(text: str) -> np.ndarray:
    raw = np.frombuffer(text.encode(), np.uint8)
    return ts.Words(raw, np.array([0, len(raw)]), ts.ALNUM).hash


@dataclass
class Template:
    label: str
    words: np.ndarray
    keys: list[tuple[np.ndarray, int]]  # words of a key phrase and its place in the template
    base: bool


def templates(base: dict[str, str] = BASE, others=TEMPLATES) -> list[Template]:
    def place(whole: np.ndarray, part: np.ndarray) -> int:
        return next(i for i in range(len(whole)) if np.array_equal(whole[i : i + len(part)], part))

    out = [Template(label, w := _hashes(phrase), [(w, 0)], True) for phrase, label in base.items()]
    for label, text, keys in others:
        w = _hashes(text)
        out.append(Template(label, w, [(k, place(w, k)) for k in map(_hashes, keys)], False))
    return out


def _scan(batch: pa.RecordBatch) -> tuple[ts.Words, np.ndarray]:
    data, at = ts.buffer_of(batch.column(batch.schema.get_field_index("text")))
    return ts.Words(ts.LOWER[data], at, ts.ALNUM), at


def document_frequency(docs: DataFrame, vocabulary: np.ndarray) -> tuple[np.ndarray, int]:
    """In how many of all texts each word of the (small, fixed) vocabulary stands, and their number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, n = np.zeros(len(vocabulary), np.int64), 0
        for part in ts.slices(batches, "text"):
            words, _ = _scan(part)
            at = np.minimum(np.searchsorted(vocabulary, words.hash), len(vocabulary) - 1)
            hit = vocabulary[at] == words.hash
            own = np.unique(words.doc[hit] * len(vocabulary) + at[hit])
            seen += np.bincount(own % len(vocabulary), minlength=len(vocabulary))
            n += part.num_rows
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, len(vocabulary)), pa.int32()), pa.array(np.concatenate([[n], seen]), pa.int64())], ["word", "n"])

    counts = {r["word"]: r["n"] for r in docs.select("text").mapInArrow(run, "word int, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()}
    return np.array([counts.get(i, 0) for i in range(len(vocabulary))]), counts.get(-1, 0)


@dataclass
class Index:
    """Postings sorted by template, then word: place of each word of each template."""

    templates: list[Template]
    vocabulary: np.ndarray  # sorted
    idf: np.ndarray  # by word of the vocabulary
    has: np.ndarray  # word, template: whether the template has the word
    key: np.ndarray  # word, template: whether a key phrase of the template has it
    begin: np.ndarray  # word, template: its first posting
    times: np.ndarray  # word, template: how many there are
    place: np.ndarray

    @classmethod
    def build(cls, all_: list[Template], vocabulary: np.ndarray, idf: np.ndarray) -> Index:
        size = len(vocabulary), len(all_)
        times, key, places = np.zeros(size, np.int64), np.zeros(size, bool), {}
        for t, x in enumerate(all_):
            for q, w in enumerate(np.searchsorted(vocabulary, x.words).tolist()):
                times[w, t] += 1
                places.setdefault((w, t), []).append(q)
            for phrase, _ in x.keys:
                key[np.searchsorted(vocabulary, phrase), t] = True
        begin = (np.cumsum(times.ravel()) - times.ravel()).reshape(size)
        place = np.array([q for at in sorted(places) for q in places[at]], np.int64)
        return cls(all_, vocabulary, idf, times > 0, key, begin, times, place)


def scan(docs: DataFrame, base: dict[str, str] = BASE, others=TEMPLATES) -> DataFrame:
    """One row for each row of docs; see COLUMNS.

    Letters A-Z are lower-cased, words are runs of a-z, 0-9 and non-ASCII; places are counted from
    word 0.  A null or empty text has no words, no labels ("") and score 0.  Equal rows give equal
    rows; other columns are left out; an empty table gives an empty result.  The score is the
    largest share of a verified template's words that stand at their place (1 for a base phrase)."""
    all_ = templates(base, others)
    vocabulary = np.unique(np.concatenate([t.words for t in all_]))
    seen, n_docs = document_frequency(docs, vocabulary)
    index = Index.build(all_, vocabulary, np.log((n_docs + 1) / (seen + 0.5)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in ts.slices(batches, "text"):
            yield label(part, index)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, COLUMNS)


def _proposals(words: ts.Words, index: Index) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(template, text, start as an index into all words, which may lie before the text's first)."""
    at = np.minimum(np.searchsorted(index.vocabulary, words.hash), len(index.vocabulary) - 1)
    here = np.flatnonzero(index.vocabulary[at] == words.hash)
    word, doc = at[here], words.doc[here]
    in_text = np.zeros((len(words.count), len(index.vocabulary)), bool)
    in_text[doc, word] = True
    wanted = np.zeros((len(index.templates), *in_text.shape), bool)  # template, text, word: to be looked up
    for t, x in enumerate(index.templates):
        able = np.flatnonzero(in_text[:, index.key[:, t]].all(1))
        own = np.flatnonzero(index.has[:, t])
        own = own[np.lexsort((own, -index.idf[own]))]
        some = in_text[np.ix_(able, own)]
        some &= np.cumsum(some, 1) <= (1 if x.base else INDEXED)
        wanted[t][np.ix_(able, own)] = some
    found = []
    for t in np.flatnonzero(wanted.any((1, 2))):
        k = np.flatnonzero(wanted[t, doc, word])
        times = index.times[word[k], t]
        row = np.repeat(k, times)
        q = index.place[np.repeat(index.begin[word[k], t], times) + np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times)]
        pair = np.unique(np.stack([doc[row], here[row] - q]), axis=1)
        found.append(np.concatenate([np.full((1, pair.shape[1]), t), pair]))
    t, doc, start = np.concatenate(found, 1) if found else np.zeros((3, 0), np.int64)
    return t, doc, start


def _stands(words: ts.Words, phrase: np.ndarray, start: np.ndarray, first: np.ndarray, limit: np.ndarray) -> np.ndarray:
    """Whether the phrase's words stand from each start, from first and before limit."""
    good = (start >= first) & (start + len(phrase) <= limit)
    for j, w in enumerate(phrase):
        good[good] = words.hash[start[good] + j] == w
    return good


def label(part: pa.RecordBatch, index: Index) -> pa.RecordBatch:
    words, _ = _scan(part)
    n = part.num_rows
    t, docs, starts = _proposals(words, index)
    n_base, first, last, score = np.zeros(n, np.int64), np.full(n, np.iinfo(np.int64).max), np.full(n, -1), np.zeros(n)
    base_of: list[set[str]] = [set() for _ in range(n)]
    all_of: list[set[str]] = [set() for _ in range(n)]
    for k in np.unique(t):
        x, s, doc = index.templates[k], starts[t == k], docs[t == k]
        begin, limit = words.first[doc], words.first[doc + 1]
        ok = np.ones(len(s), bool)
        for phrase, place in x.keys:
            found = np.zeros(len(s), bool)
            for off in [0] if x.base else range(-SLACK, SLACK + 1):
                found |= _stands(words, phrase, s + place + off, begin, limit)
            ok &= found
        s, doc, begin, limit = s[ok], doc[ok], begin[ok], limit[ok]
        match = np.zeros(len(s))
        for j, w in enumerate(x.words):
            there = (s + j >= begin) & (s + j < limit)
            match[there] += words.hash[s[there] + j] == w
        np.maximum.at(score, doc, match / len(x.words))
        for d in np.unique(doc):
            all_of[d].add(x.label)
        if x.base:
            own = s - words.first[doc]
            np.add.at(n_base, doc, 1)
            np.minimum.at(first, doc, own)
            np.maximum.at(last, doc, own)
            for d in np.unique(doc):
                base_of[d].add(x.label)
    none = n_base == 0
    return pa.RecordBatch.from_arrays(
        [part.column(part.schema.get_field_index("doc_id")), pa.array(words.count.astype(np.int64)), pa.array(n_base), pa.array(first, pa.int64(), mask=none), pa.array(last, pa.int64(), mask=none), *(pa.array([",".join(sorted(x)) for x in of]) for of in (base_of, all_of)), pa.array(score)],
        [c.split()[0] for c in COLUMNS.split(", ")],
    )
