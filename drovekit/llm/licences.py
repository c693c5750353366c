"""Licence scan by a positional index of rare words: which licences a text names or quotes, and where.

Base phrases are found as such. Beyond these, each licence has templates, runs of words of its notice or of its
text. A template's rarest words by the corpus' document counts are posted with their positions: so few that a text
which holds none of them at its place can't reach the template's share of weight. A file looks up the posted words
that it holds; a posting fixes where the whole template would lie, postings that agree meet in one alignment, and
each alignment is scored over all the template's words, each at its position or a few words off. A template counts if
the score reaches its share and its mandatory phrases stand within the alignment.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import tidied
from .flat import LOWER, powers, slices, spans

WORD = np.ones(256, bool)
WORD[[*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]] = False

#: The base phrases and their labels.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: Runs of words of public licences and of their usual notices, and the phrases that must stand in them.
TEMPLATES: list[tuple[str, str, tuple[str, ...]]] = [
    ("apache-2.0", "licensed under the apache license version 2 0", ("apache license version 2",)),
    ("apache-2.0", "you may not use this file except in compliance with the license you may obtain a copy of the license at", ("in compliance with the license",)),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ("source and binary forms",)),
    ("bsl-1.0", "boost software license version 1 0 permission is hereby granted free of charge to any person or organization obtaining a copy of the software", ("boost software license",)),
    ("cc-by-4.0", "licensed under a creative commons attribution 4 0 international license", ("attribution 4 0",)),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0", ("by nc 4 0",)),
    ("cc-by-sa-4.0", "licensed under cc by sa 4 0", ("by sa 4 0",)),
    ("cc0-1.0", "the person who associated a work with this deed has dedicated the work to the public domain", ("to the public domain",)),
    ("gpl-2.0", "licensed under the gnu general public license version 2", ("general public license version 2",)),
    ("gpl-3.0", "licensed under the gnu general public license version 3", ("general public license version 3",)),
    ("gpl", "it under the terms of the gnu general public license as published by the free software foundation", ("gnu general public license", "free software foundation")),
    ("agpl-3.0", "gnu affero general public license version 3", ("affero general public license",)),
    ("lgpl", "under the terms of the gnu lesser general public license as published by the free software foundation", ("lesser general public license",)),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ("with or without fee",)),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", ("to any person obtaining a copy",)),
    ("mit", "released under the mit license", ("mit license",)),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", ("mozilla public license",)),
    ("unlicense", "this is free and unencumbered software released into the public domain", ("into the public domain",)),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable", ("express or implied warranty",)),
]


def _hash(data: np.ndarray, at: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each run of bytes."""
    ends = np.cumsum(lengths)
    within = np.arange(ends[-1]) - np.repeat(ends - lengths, lengths)
    values = (data[np.repeat(at, lengths) + within].astype(np.uint64) + np.uint64(1)) * powers(int(lengths.max()))[within]
    h = np.add.reduceat(values, ends - lengths)
    h ^= h >> np.uint64(31)
    return h * np.uint64(0xD6E8FEB86659FD93)


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, words of each row) of lower-cased bytes; no word goes over a row's end."""
    mask = WORD[data]
    start, heads = mask.copy(), offsets[:-1][np.diff(offsets) > 0]
    start[1:] &= ~mask[:-1]
    start[heads] = mask[heads]
    stop = np.ones_like(mask)
    stop[:-1] = ~mask[1:]
    stop[offsets[1:][np.diff(offsets) > 0] - 1] = True
    at = np.flatnonzero(start)
    return at, np.flatnonzero(stop & mask) + 1 - at, np.diff(np.searchsorted(at, offsets))


@dataclass
class Index:
    """The licence words, and each template as numbers of these; after ``weighted``, weights and postings."""

    base: dict[str, str]
    templates: list[tuple[str, str, tuple[str, ...]]]
    share: float = 0.8
    slack: int = 2
    weights: np.ndarray = field(default_factory=lambda: np.empty(0))

    def __post_init__(self):
        parts = [w for t in (*self.base, *(x for _, text, must in self.templates for x in (text, *must))) for w in t.split()]
        self.vocabulary = sorted(set(parts))
        self.number = {w: k for k, w in enumerate(self.vocabulary)}
        raw = [np.frombuffer(w.encode(), np.uint8) for w in self.vocabulary]
        lengths = np.array([len(x) for x in raw])
        hashes = _hash(np.concatenate(raw), np.cumsum(lengths) - lengths, lengths)
        self.order = np.argsort(hashes)
        self.hashes = hashes[self.order]
        ids = lambda text: np.array([self.number[w] for w in text.split()])
        self.phrases = [(ids(p), label) for p, label in self.base.items()]
        self.runs = [(label, ids(text), [ids(m) for m in must]) for label, text, must in self.templates]

    def weighted(self, counts: dict[str, int], documents: int) -> Index:
        """With the words' inverse document frequencies as weights, and postings of each template's rarest words: as many as
        leave the others less than its share of the weight, so that every alignment which reaches it holds one of them."""
        self.weights = np.array([np.log((2.0 + documents) / (1.0 + counts.get(w, 0))) for w in self.vocabulary])
        self.postings: dict[int, list[tuple[int, int]]] = {}
        for t, (_, run, _) in enumerate(self.runs):
            weight = self.weights[run]
            rest = weight.sum()
            for p in np.lexsort((np.arange(len(run)), -weight)):  # from the highest weight on
                self.postings.setdefault(int(run[p]), []).append((t, int(p)))
                rest -= weight[p]
                if rest < self.share * weight.sum() * (1 - 1e-9):
                    break
        self.posted = np.zeros(len(self.vocabulary), bool)
        self.posted[list(self.postings)] = True
        return self

    def numbers(self, data: np.ndarray, at: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Each word's number; -1 for one that isn't a licence word. Equal hashes are compared byte by byte."""
        out = np.full(len(at), -1)
        longest = max(map(len, (w.encode() for w in self.vocabulary)))
        fits = np.flatnonzero(lengths <= longest)
        if len(fits):
            h = _hash(data, at[fits], lengths[fits])
            k = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
            hit = self.hashes[k] == h
            out[fits[hit]] = self.order[k[hit]]
        for i in np.flatnonzero(out >= 0):
            if data[at[i] : at[i] + lengths[i]].tobytes() != self.vocabulary[out[i]].encode():
                out[i] = -1
        return out

    def places(self, v: np.ndarray, run: np.ndarray) -> np.ndarray:
        """Where the words of a run stand one after another."""
        n = len(v) - len(run) + 1
        if n <= 0:
            return np.empty(0, np.int64)
        ok = v[:n] == run[0]
        for j in range(1, len(run)):
            ok &= v[j : j + n] == run[j]
        return np.flatnonzero(ok)

    def quotes(self, v: np.ndarray) -> list[tuple[str, float, int]]:
        """(label, score, start) of each template that a file quotes, at its best alignment; the first of equal ones."""
        here = np.flatnonzero((v >= 0) & self.posted[v])
        alignments: dict[int, set[int]] = {}
        for i in here:  # the file's rare words: each posting says where its template would start, give or take the slack
            for t, p in self.postings[int(v[i])]:
                alignments.setdefault(t, set()).update(range(int(i) - p - self.slack, int(i) - p + self.slack + 1))
        out = []
        for t, starts in alignments.items():
            label, run, must = self.runs[t]
            weight, best = self.weights[run], (0.0, 0)
            starts = np.array(sorted(starts))
            found = np.zeros((len(starts), len(run)), bool)
            for shift in range(-self.slack, self.slack + 1):
                where = starts[:, None] + np.arange(len(run)) + shift
                inside = (where >= 0) & (where < len(v))
                found |= inside & (v[np.where(inside, where, 0)] == run)
            scores = found @ weight / weight.sum() if weight.sum() > 0 else found.mean(axis=1)
            for k in np.flatnonzero(scores >= self.share - 1e-12):
                lo, hi = max(0, starts[k] - self.slack), starts[k] + len(run) + self.slack
                if scores[k] > best[0] and all(len(self.places(v[lo:hi], m)) for m in must):
                    best = (float(scores[k]), int(starts[k]))
            if best[0] > 0:
                out.append((label, min(1.0, best[0]), best[1]))
        return out

    def scan(self, v: np.ndarray) -> tuple[int, int | None, int | None, list[str], list[str], float]:
        """(places, first, last, base labels, all labels, score) of a file's word numbers.

        The score is that of the best quote; a base phrase alone counts a half."""
        hits = [(p, label) for run, label in self.phrases for p in self.places(v, run)]
        own = sorted({label for _, label in hits})
        quotes = self.quotes(v)
        at = [int(p) for p, _ in hits]
        score = max([0.5 if own else 0.0, *(s for _, s, _ in quotes)])
        return len(hits), min(at, default=None), max(at, default=None), own, sorted({*own, *(label for label, _, _ in quotes)}), score


def _numbered(index: Index, batches: Iterator[pa.RecordBatch], column: str = "text") -> Iterator[tuple[pa.RecordBatch, int, int, np.ndarray]]:
    """(batch, row, words of the row, its word numbers), slice by slice; rows without licence words have no array."""
    for b in batches:
        data, offsets = spans(b.column(column))
        for i, j in slices(offsets, 2 << 20):
            part = LOWER[data[offsets[i] : offsets[j]]]
            at, lengths, counts = words(part, offsets[i : j + 1] - offsets[i]) if len(part) else (np.empty(0, np.int64), np.empty(0, np.int64), np.zeros(j - i, np.int64))
            v = index.numbers(part, at, lengths)
            ends = np.cumsum(counts)
            for k in range(j - i):
                yield b, i + k, int(counts[k]), v[ends[k] - counts[k] : ends[k]]


def document_counts(docs: DataFrame, index: Index) -> tuple[dict[str, int], int]:
    """In how many rows each licence word stands, and the number of rows; the driver gets a row for each licence word."""

    def run(batches):
        total, n = np.zeros(len(index.vocabulary), np.int64), 0
        for _, _, _, v in _numbered(index, batches):
            n += 1
            total[np.unique(v[v >= 0])] += 1
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array([*some, -1], pa.int64()), pa.array([*total[some], n], pa.int64())], names=["word", "n"])

    rows = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(tidied(run), "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    n = {r["word"]: r["n"] for r in rows}
    return {index.vocabulary[k]: c for k, c in n.items() if k >= 0}, n.get(-1, 0)


def scan(docs: DataFrame, *, base: dict[str, str] | None = None, templates: list | None = None, share: float = 0.8, slack: int = 2) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    ``base`` maps phrases to labels, ``templates`` are (label, words, mandatory phrases), ``share`` is the part of a
    template's weight that must stand within ``slack`` words of its place. Null and empty texts have no words: counts and
    score 0, first_word and last_word null, labels empty texts. Rows are judged one by one, so ids may be null or repeat,
    equal texts get equal rows and other columns don't matter. A text is seen whole, by one task. Of alignments with
    one score the first counts. An empty table gives an empty result.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    index = Index(BASE if base is None else base, TEMPLATES if templates is None else templates, share, slack)
    index.weighted(*document_counts(docs, index))
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64())])

    def run(batches):
        held = []
        for b, i, n, v in _numbered(index, batches):
            n_base, first, last, own, labels, score = index.scan(v) if len(v) and (v >= 0).any() else (0, None, None, [], [], 0.0)
            held.append((b.column("doc_id")[i].as_py(), n, n_base, first, last, ",".join(own), ",".join(labels), score))
            if len(held) == 4096:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
                held = []
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)

    return docs.mapInArrow(tidied(run), "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")
