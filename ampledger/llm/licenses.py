"""License scan: winnowed fingerprints of the templates choose places, banded alignment measures them."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ampledger.llm.common import documents_of, pieces
from ampledger.llm.words import ALNUM, mix, word_hashes, word_spans

#: Common notices, by their public identifiers.
TEMPLATES = {
    "MIT-notice": "Released under the MIT License.",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "MIT-grant": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
        'associated documentation files (the "Software"), to deal in the Software without restriction, including '
        "without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell "
        "copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the "
        "following conditions:"
    ),
    "BSD-conditions": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
        "that the following conditions are met:"
    ),
    "Apache-2.0-header": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in '
        "compliance with the License. You may obtain a copy of the License at"
    ),
    "GPL-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
        "option) any later version."
    ),
}

#: Words of a fingerprint. In a text they may stand up to ``REACH`` words apart, so that words
#: put in between do not hide them.
GRAM = 2
REACH = 8
#: The widest window of fingerprints of which one is kept.
WINDOW = 4


def grams(words: np.ndarray, size: int = GRAM) -> np.ndarray:
    """Hashes of the runs of ``size`` words."""
    n = max(0, len(words) - size + 1)
    out = np.zeros(n, np.uint64)
    for i in range(size):
        out = mix(out + words[i : i + n])
    return out


def winnow(values: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Places of the smallest value of every window of ``window`` values, the last of ties."""
    n = len(values)
    if n == 0:
        return np.zeros(0, int)
    w = min(window, n)
    view = np.lib.stride_tricks.sliding_window_view(values, w)
    return np.unique(np.arange(n - w + 1) + w - 1 - view[:, ::-1].argmin(axis=1))


def align(
    template: np.ndarray, words: np.ndarray, need: int, most: int, band: tuple[int, int] | None = None
) -> list[tuple[int, int, int]]:
    """``matches, first, last`` for every place of ``words`` at which template words in order
    may end: the most matches, at least ``need``, inside ``most`` words, and then the
    latest beginning. Template word ``i`` may match word ``j`` only if ``j - i`` is in the
    ``band``, its two ends included."""
    size = len(template)
    low, high = band or (-size, len(words))
    # By words of the template used and matches, the latest place of the first match.
    latest = np.full((size + 1, size + 1), -most, np.int64)
    places = {int(w): np.flatnonzero(template == w)[::-1].tolist() for w in np.unique(template)}
    out = []
    for j, word in enumerate(words.tolist()):
        ended = np.full(size + 1, -most, np.int64)
        for i in places.get(word, ()):
            if low <= j - i <= high:
                new = np.concatenate([[-most, j], latest[i, 1:size]])
                np.maximum(latest[i + 1 :], new, out=latest[i + 1 :])
                np.maximum(ended, new, out=ended)
        fit = np.flatnonzero(j - ended[need:] < most)
        if len(fit):
            n = int(fit[-1]) + need
            out.append((n, int(ended[n]), j))
    return out


def fingerprints(template: np.ndarray, need: int) -> tuple[int, np.ndarray, int]:
    """Words of a fingerprint, the places of those that are kept, and how many of them every
    span with ``need`` of the template's words has at least.

    Each of the ``n - need`` words that a span may lack breaks two pairs of neighbours at
    most. The pairs left follow each other inside ``2 * n`` words, so that few of them
    can be more than ``REACH`` words wide. The widest window that promises four fingerprints
    is taken, else all pairs; where these promise none, single words are the fingerprints.
    """
    n = len(template)
    lost = 2 * (n - need) + (2 * n - 1) // (REACH + 1)
    for window in range(WINDOW, 0, -1):
        kept = winnow(grams(template), window)
        if len(kept) - lost >= (4 if window > 1 else 1):
            return GRAM, kept, len(kept) - lost
    return 1, np.arange(n), need


class Index:
    """The inverted index: fingerprints of all templates and where each template has them."""

    def __init__(self, templates: dict[str, str], coverage: float):
        self.names = list(templates)
        hashes, before = word_hashes(pa.array([templates[n] for n in self.names], pa.string()), ALNUM)
        self.words = [hashes[before[i] : before[i + 1]] for i in range(len(self.names))]
        self.need = [max(1, math.ceil(coverage * len(w) - 1e-9)) for w in self.words]
        self.known = np.unique(hashes)
        self.promised, self.equal = [], []
        entries: dict[int, list[tuple[int, int, int]]] = {1: [], GRAM: []}
        for t, (words, need) in enumerate(zip(self.words, self.need)):
            size, kept, promised = fingerprints(words, need)
            self.promised.append(promised)
            values = grams(words, size)
            # Equal fingerprints of the template: the number of each place's, and their times.
            name = np.zeros(len(words), np.int64)
            _, name[kept], times = np.unique(values[kept], return_inverse=True, return_counts=True)
            self.equal.append((name, times))
            entries[size] += [(int(values[i]), t, int(i)) for i in kept]
        self.postings = {}
        for size, found in entries.items():
            found.sort()
            value = np.array([v for v, _, _ in found], np.uint64)
            prints, first = np.unique(value, return_index=True)
            at = np.array([(t, i) for _, t, i in found], np.int64).reshape(-1, 2)
            self.postings[size] = prints, np.append(first, len(found)), at

    def _look_up(self, size: int, values: np.ndarray, places: np.ndarray) -> np.ndarray:
        """Rows ``template, its place, place`` of the ``values`` found at ``places``."""
        prints, first, at = self.postings[size]
        if not len(prints):
            return np.zeros((0, 3), np.int64)
        found = np.minimum(np.searchsorted(prints, values), len(prints) - 1)
        hit = prints[found] == values
        found, places = found[hit], places[hit]
        times = first[found + 1] - first[found]
        entry = np.repeat(first[found] - np.cumsum(times) + times, times) + np.arange(times.sum())
        return np.column_stack([at[entry], np.repeat(places, times)])

    def hits(self, words: np.ndarray, before: np.ndarray) -> np.ndarray:
        """Rows ``template, its place, place`` of all fingerprints in the texts, the place of
        the first word counted over all texts. ``before``: words before each text."""
        if not len(self.known) or not len(words):
            return np.zeros((0, 3), np.int64)
        inside = self.known[np.minimum(np.searchsorted(self.known, words), len(self.known) - 1)] == words
        at = np.flatnonzero(inside)
        end = before[np.searchsorted(before, at, "right")]
        begun = mix(words[at])
        out = [self._look_up(1, begun, at)]
        for apart in range(1, REACH + 1):
            second = at + apart
            both = second < end
            both[both] = inside[second[both]]
            out.append(self._look_up(GRAM, mix(begun[both] + words[second[both]]), at[both]))
        return np.concatenate(out)

    def places(self, words: np.ndarray, before: np.ndarray) -> list[tuple[int, int, int, int, tuple[int, int]]]:
        """``text, template, first, end, band`` of the stretches of words that can hold a span.

        Hits of a template are chained: a span has as many as are promised inside ``2 * n``
        words, and its other words are no farther from them. Stretches that overlap are one.
        The band has the diagonals of the hits and those that a span may reach from them.
        """
        hits = self.hits(words, before)
        # Texts stand so far apart that no stretch has words of two.
        gap = 4 * max((len(w) for w in self.words), default=0)
        begins = before + gap * np.arange(len(before))
        out = []
        for t, (template, need, promised) in enumerate(zip(self.words, self.need, self.promised)):
            own = hits[hits[:, 0] == t, 1:]
            at = own[:, 1] + gap * (np.searchsorted(before, own[:, 1], "right") - 1)
            order = np.argsort(at, kind="stable")
            at, diagonal = at[order], (at - own[:, 0])[order]
            reach = 2 * len(template) - 1
            # A fingerprint that the template has k times counts up to k times in a window:
            # in windows that begin after its k-th predecessor.
            name, times = self.equal[t]
            found = np.unique(np.column_stack([name[own[:, 0][order]], at]), axis=0)
            kind, place = found[:, 0], found[:, 1]
            earlier = np.arange(len(found)) - times[kind]
            again = earlier >= 0
            again[again] = kind[earlier[again]] == kind[again]
            since = np.maximum(place - reach, np.where(again, place[np.maximum(earlier, 0)] + 1, -gap - reach))
            starts, index = np.unique(np.concatenate([since, place + 1]), return_inverse=True)
            change = np.bincount(index[: len(place)], minlength=len(starts)) - np.bincount(index[len(place) :], minlength=len(starts))
            enough = np.flatnonzero(np.cumsum(change) >= promised)
            lows, highs = starts[enough], starts[np.minimum(enough + 1, len(starts) - 1)] + reach
            cuts = np.flatnonzero(lows[1:] > highs[:-1]) + 1
            slack = reach + 1 - need
            for low, high in zip(np.split(lows, cuts), np.split(highs, cuts)):
                if not len(low):
                    continue
                first, end = int(low[0]), int(high[-1])
                seen = diagonal[np.searchsorted(at, first) : np.searchsorted(at, end)]
                text = int(np.searchsorted(begins, at[np.searchsorted(at, first)], "right")) - 1
                start = max(first - gap * text, int(before[text]))
                shift = start + gap * text
                band = int(seen.min()) - slack - shift, int(seen.max()) + slack - shift
                out.append((text, t, start, min(end - gap * text, int(before[text + 1])), band))
        return out

    def matches(self, words: np.ndarray, before: np.ndarray) -> list[tuple[int, int, int, int, int]]:
        """``text, template, matched words, first, last`` of the spans that cover enough,
        places counted over all texts.

        Of spans of a template that overlap, the one with more matches stays, of equal ones
        the shorter and then the earlier.
        """
        out = []
        for text, t, low, high, band in self.places(words, before):
            template = self.words[t]
            found = align(template, words[low:high], self.need[t], 2 * len(template), band)
            taken = np.zeros(high - low, bool)
            for n, first, last in sorted(found, key=lambda s: (-s[0], s[2] - s[1], s[1])):
                if not taken[first : last + 1].any():
                    taken[first : last + 1] = True
                    out.append((text, t, n, low + first, low + last))
        return sorted(out, key=lambda s: (s[0], s[1], s[3]))


SCHEMA = (
    "doc_id long, template string, coverage double, matched_words int, first_word int, last_word int,"
    " start_byte long, end_byte long"
)


def scan(
    df: DataFrame,
    templates: dict[str, str] = TEMPLATES,
    coverage: float = 0.8,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row for every span of a whole text that covers a template: ``doc_id, template,
    coverage, matched_words, first_word, last_word, start_byte, end_byte``.

    ``coverage`` is the share of the template's words that stand in the span in order; byte
    places are in the UTF-8 text, the end exclusive. A span is at most twice as long as the template;
    no such span is lost (:func:`fingerprints`). Words are runs of letters and digits, ASCII
    letters without case. Null and empty texts have no spans, null ids are kept,
    repeated rows give repeated spans, other columns are ignored. The templates are
    broadcast; they are an argument and do not grow with the data.
    """
    if any(len(word_hashes(pa.array([t], pa.string()), ALNUM)[0]) == 0 for t in templates.values()):
        raise ValueError("a template needs a word")

    def run(batches):
        index = Index(templates, coverage)
        for batch in pieces(batches, "text", 2 << 20):
            texts = batch.column("text")
            hashes, before = word_hashes(texts, ALNUM)
            _, starts, ends, _ = word_spans(texts, ALNUM)
            sizes = np.concatenate([[0], np.cumsum(pa.compute.binary_length(texts).to_numpy())])
            out = []
            ids = batch.column("doc_id")
            for i, t, n, first, last in index.matches(hashes, before):
                begin, end = starts[first] - sizes[i], ends[last] - sizes[i]
                share, first_word = n / len(index.words[t]), int(before[i])
                place = (first - first_word, last - first_word, int(begin), int(end))
                out.append((ids[i].as_py(), index.names[t], share, n, *place))
            kinds = [pa.int64(), pa.string(), pa.float64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64()]
            columns = list(zip(*out)) or [()] * len(kinds)
            names = [part.split()[0] for part in SCHEMA.split(",")]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

    return documents_of(df, id_col, text_col).mapInArrow(run, SCHEMA)
