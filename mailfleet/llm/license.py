"""Licence notices in texts: an exact set-similarity join of text blocks with templates.

A block is a run of as many consecutive words as the template has. It matches if it holds the threshold's share
of the template's distinct words. Every block of every text is judged, but few are looked at:

* *order*: template words are ordered by how often they stand in the whole corpus, rarest first;
* *prefix*: a matching block lacks at most ``size - least`` words of the template, so it holds one of the rarest
  ``size - least + 1``;
* *length*: texts with fewer than ``least`` template words, repeats included, are settled;
* *position*: if a block's rarest common word is the template's i-th, the words from the i-th on must
  suffice, so places around which fewer than ``least`` of these stand are settled.

What is left is verified by exact counts: a word counts for the blocks that start after its previous
place, which makes each place an interval of block starts; sums of interval ends give every block's number of
distinct words at once. Templates are a parameter, so what tasks are given is bounded; texts never move.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mailfleet.llm.words import Words, buffers, hash_words, in_pieces

#: Phrases whose consecutive words give a label.
PHRASES = (
    ("gpl", "gnu general public license"),
    ("apache", "apache license"),
    ("cc-by", "cc by"),
    ("mit", "mit license"),
)

#: Public notices of common licences.
TEMPLATES = (
    ("mit", "Released under the MIT License"),
    ("mit-permission", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
                       "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation "
                       "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("apache-2.0-notice", "you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl-notice", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
                   "License as published by the Free Software Foundation"),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0"),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following "
            "conditions are met"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
)
THRESHOLD = 0.8

_WORD = np.ones(256, bool)
_WORD[:0x80] = False
_WORD[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B)]] = True


def license_words(column: pa.Array | pa.ChunkedArray) -> Words:
    """Longest runs of digits, ASCII letters and characters beyond ASCII, ``A-Z`` as ``a-z``."""
    data, bounds = buffers(column)
    return hash_words(data, bounds, ~_WORD, lower=True)


class Template(NamedTuple):
    label: str
    words: int
    #: Numbers of its distinct words, rarest first.
    order: np.ndarray
    #: So many of them a matching block holds.
    least: int


class Catalog:
    """Phrases and templates over a common list of words."""

    def __init__(self, phrases: Sequence[tuple[str, str]], templates: Sequence[tuple[str, str]], threshold: float) -> None:
        if not 0 < threshold <= 1:
            raise ValueError("the threshold lies above 0 and is at most 1")
        self.threshold = threshold
        cut = license_words(pa.array([t for _, t in (*phrases, *templates)], pa.string()))
        self.hashes = np.unique(cut.hash)
        number = np.searchsorted(self.hashes, cut.hash)
        each = [number[cut.text == k] for k in range(cut.texts)]
        if not all(map(len, each)):
            raise ValueError("a phrase or template without words")
        self.phrases = [(label, n) for (label, _), n in zip(phrases, each)]
        self.raw = [(label, n) for (label, _), n in zip(templates, each[len(phrases):])]
        self.templates: list[Template] = []

    def numbers(self, words: Words) -> np.ndarray:
        """Number of each word, -1 for words of no phrase and no template."""
        if not len(self.hashes):
            return np.full(len(words.hash), -1)
        at = np.minimum(np.searchsorted(self.hashes, words.hash), len(self.hashes) - 1)
        return np.where(self.hashes[at] == words.hash, at, -1)

    def ordered(self, frequency: dict[int, int]) -> Catalog:
        """Orders each template's words by their frequency in the corpus; equal ones by number."""
        self.templates = []
        for label, words in self.raw:
            distinct = sorted(set(words.tolist()), key=lambda w: (frequency.get(w, 0), w))
            # The least number of words whose share is not below the threshold.
            least = max(1, math.ceil(round(self.threshold * len(distinct), 9)))
            self.templates.append(Template(label, len(words), np.array(distinct), least))
        return self


class Blocks(NamedTuple):
    text: np.ndarray
    first: np.ndarray
    last: np.ndarray
    common: np.ndarray


_NONE = Blocks(*[np.zeros(0, np.int64)] * 4)


def matching_blocks(template: Template, text: np.ndarray, place: np.ndarray, number: np.ndarray, lengths: np.ndarray) -> Blocks:
    """Runs of matching block starts: text, first and last start in words, most distinct words of one of them.

    ``text, place, number``: the template words of some texts in order; ``lengths``: words of each text.
    """
    rank = np.full(int(number.max(initial=0)) + 1, -1)
    inside = template.order[template.order < len(rank)]
    rank[inside] = np.flatnonzero(template.order < len(rank))
    own = rank[number]
    keep = own >= 0
    text, place, own = text[keep], place[keep], own[keep]
    size, width, least = len(template.order), template.words, template.least
    held = np.bincount(text, minlength=len(lengths))
    keep = held[text] >= least
    text, place, own = text[keep], place[keep], own[keep]
    if not len(own):
        return _NONE
    # Texts one after the other, with room between them that no block can bridge.
    start = np.concatenate([[0], np.cumsum(lengths + width)])
    at = start[text] + place
    near = np.zeros(len(at), bool)
    for i in range(size - least + 1):
        hits = at[own == i]
        if not len(hits):
            continue
        rest = at[own >= i]
        bound = np.searchsorted(rest, hits + width) - np.searchsorted(rest, hits - width, side="right")
        hits = hits[bound >= least]
        first, last = np.searchsorted(at, hits - width, side="right"), np.searchsorted(at, hits + width)
        edge = np.bincount(first, minlength=len(at) + 1) - np.bincount(last, minlength=len(at) + 1)
        near |= np.cumsum(edge)[:-1] > 0
    text, at, own = text[near], at[near], own[near]
    if not len(own):
        return _NONE
    # The place of the same word before; blocks that start after it count this one.
    by_word = np.lexsort((at, own))
    before = np.full(len(at), -1)
    same = own[by_word][1:] == own[by_word][:-1]
    before[by_word[1:][same]] = at[by_word[:-1][same]]
    opens = np.maximum(np.maximum(before + 1, at - width + 1), start[text])
    events = np.concatenate([opens, at + 1])
    step = np.concatenate([np.ones(len(at), np.int64), -np.ones(len(at), np.int64)])
    order = np.argsort(events, kind="stable")
    points, at_point = np.unique(events[order], return_index=True)
    level = np.cumsum(np.add.reduceat(step[order], at_point))
    good = level >= least
    # Levels hold from one point to the next; neighbouring good stretches are one run.
    begin = np.flatnonzero(good & ~np.concatenate([[False], good[:-1]]))
    end = np.flatnonzero(good & ~np.concatenate([good[1:], [False]]))
    if not len(begin):
        return _NONE
    most = np.maximum.reduceat(np.where(good, level, 0), begin)
    of = np.searchsorted(start, points[begin], side="right") - 1
    return Blocks(of, points[begin] - start[of], points[end + 1] - 1 - start[of], most)


def _word_counts(catalog: Catalog):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(catalog.hashes), np.int64)
        for batch in batches:
            for piece in in_pieces(batch, "_text"):
                number = catalog.numbers(license_words(piece.column(0)))
                total += np.bincount(number[number >= 0], minlength=len(total))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total)], ["word", "n"])
    return run


def _scan_pieces(batches: Iterator[pa.RecordBatch], catalog: Catalog):
    for batch in batches:
        for piece in in_pieces(batch, "_text"):
            words = license_words(piece.column(piece.schema.get_field_index("_text")))
            lengths = np.bincount(words.text, minlength=words.texts)
            number = catalog.numbers(words)
            place = np.arange(len(number)) - (np.cumsum(lengths) - lengths)[words.text]
            yield piece, words.text, place, number, lengths


def _prepared(docs: DataFrame, id_col: str, text_col: str, phrases, templates, threshold: float) -> tuple[DataFrame, Catalog]:
    slim = docs.select(F.col(text_col).cast("string").alias("_text"), F.col(id_col).alias("doc_id"))
    catalog = Catalog(phrases, templates, threshold)
    # One number for each word of the templates.
    counts = slim.select("_text").mapInArrow(_word_counts(catalog), "word int, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    return slim, catalog.ordered({r.word: r.n for r in counts.collect()})


def license_blocks(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates=TEMPLATES, threshold: float = THRESHOLD,
) -> DataFrame:
    """``doc_id, template, first_word, last_word, containment``: one row for each run of matching blocks of a text.

    ``first_word`` and ``last_word`` are the starts of the run's first and last block (words from 0), ``containment`` the largest share of the
    template's distinct words in one of them. Null and empty texts have no blocks. Rows that repeat an id each
    have their own. The order of words in a block does not count. Other columns are ignored, whatever their names.
    """
    slim, catalog = _prepared(docs, id_col, text_col, (), templates, threshold)
    id_type = slim.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece, text, place, number, lengths in _scan_pieces(batches, catalog):
            known = number >= 0
            for t in catalog.templates:
                found = matching_blocks(t, text[known], place[known], number[known], lengths)
                yield pa.RecordBatch.from_arrays([
                    piece.column(1).take(pa.array(found.text)), pa.array([t.label] * len(found.text), pa.string()),
                    pa.array(found.first), pa.array(found.last), pa.array(found.common / len(t.order)),
                ], ["doc_id", "template", "first_word", "last_word", "containment"])

    return slim.mapInArrow(run, f"doc_id {id_type}, template string, first_word bigint, last_word bigint, containment double")


def _joined(sets: list[set[str]]) -> pa.Array:
    return pa.array([",".join(sorted(s)) for s in sets], pa.string())


def license_labels(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", phrases=PHRASES, templates=TEMPLATES, threshold: float = THRESHOLD,
) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_words, n_base, first_word, last_word, base_labels, labels, n_blocks, score``.

    ``n_base`` counts the places where a phrase's words stand one after the other, ``first_word`` and ``last_word`` are the least and
    largest start of such a place, null without one. ``labels`` adds those of the templates that a block matches (see
    ``license_blocks``), ``n_blocks`` counts runs of such blocks. ``score`` is the largest containment found: 1 with a phrase, else that of the best
    block, else 0. Null texts are empty: no words, no labels, score 0. Repeated and null ids are rows like others.
    """
    slim, catalog = _prepared(docs, id_col, text_col, phrases, templates, threshold)
    id_type = slim.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece, text, place, number, lengths in _scan_pieces(batches, catalog):
            n = len(lengths)
            n_base, n_blocks, score = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n)
            first, last = np.full(n, np.iinfo(np.int64).max), np.full(n, -1)
            base: list[set[str]] = [set() for _ in range(n)]
            for label, phrase in catalog.phrases:
                starts = np.flatnonzero(number[:max(0, len(number) - len(phrase) + 1)] == phrase[0])
                for k, w in enumerate(phrase[1:], 1):
                    starts = starts[number[starts + k] == w]
                starts = starts[text[starts] == text[starts + len(phrase) - 1]]
                of, at = text[starts], place[starts]
                n_base += np.bincount(of, minlength=n)
                np.minimum.at(first, of, at)
                np.maximum.at(last, of, at)
                score[of] = 1.0
                for t in np.unique(of).tolist():
                    base[t].add(label)
            labels = [set(s) for s in base]
            known = number >= 0
            for t in catalog.templates:
                found = matching_blocks(t, text[known], place[known], number[known], lengths)
                np.maximum.at(score, found.text, found.common / len(t.order))
                n_blocks += np.bincount(found.text, minlength=n)
                for d in found.text.tolist():
                    labels[d].add(t.label)
            none = n_base == 0
            yield pa.RecordBatch.from_arrays([
                piece.column(1), pa.array(lengths.astype(np.int64)), pa.array(n_base), pa.array(first, mask=none), pa.array(last, mask=none),
                _joined(base), _joined(labels), pa.array(n_blocks), pa.array(score),
            ], ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "n_blocks", "score"])

    return slim.mapInArrow(run, (
        f"doc_id {id_type}, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, "
        "n_blocks bigint, score double"))
