"""License scan by conditional compression.

Words around a cue ("licence", "CC BY", "redistribution" ...) form candidate blocks, of any length. A block is read in
pieces of bounded size that overlap by more than a license can be long. A piece is compressed plainly and with each license
template as a raw zstandard dictionary; templates are ranked by the bytes that their dictionary saves, which may be none.
The ranking only settles ties: every template of which the piece has enough words is compared with it word by word
(insertions, deletions, replacements against each matching stretch). Stretches with few enough differences and the same numbers
are confirmed, and of them the one wins that has most words in common less those that differ. Its words are taken out and
the rest of the piece is tried again, so a block may hold several licenses.

Places count code points, end exclusive. Defined cases: null or empty texts hold no license; repeated rows are scanned
each; a null id stays null; other columns are ignored; no rows give no rows.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Wordings of common licenses, a short notice or the operative text.
TEMPLATES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
            "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation "
            "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to "
            "permit persons to whom the Software is furnished to do so, subject to the following conditions:"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
                   "compliance with the License. You may obtain a copy of the License at"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0-or-later", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU "
                         "General Public License as published by the Free Software Foundation; either version 2 of the License, "
                         "or (at your option) any later version."),
    ("GPL-3.0-or-later", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
                         "General Public License as published by the Free Software Foundation, either version 3 of the License, "
                         "or (at your option) any later version."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
            "following conditions are met:"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
            "granted, provided that the above copyright notice and this permission notice appear in all copies."),
)

CUE = re.compile(r"(?i)licen[sc]|copyright|\bcc\W{1,4}by\b|redistribut|permission\W+(?:is|to)\b")
_WORD = re.compile(r"\d+(?:\.\d+)+|[^\W_]+")
AROUND = 16  # words before a cue and behind the longest template
PIECE = 4  # words of a piece, as a multiple of the longest stretch that a license can take


def _words(text: str):
    found = list(_WORD.finditer(text))
    return [m[0].lower() for m in found], [m.span() for m in found]


def blocks(text: str, longest: int) -> list[tuple[list[str], list[tuple[int, int]]]]:
    """Candidate blocks as words and their places; overlapping neighbourhoods of cues are one block."""
    cues = [m.start() for m in CUE.finditer(text)]
    if not cues:
        return []
    words, spans = _words(text)
    if not words:
        return []
    starts = np.array([s for s, _ in spans])
    out, reach = [], longest + AROUND
    for at in np.maximum(0, np.searchsorted(starts, cues, "right") - 1).tolist():
        low, high = max(0, at - reach), min(len(words), at + reach)
        if out and low <= out[-1][1]:
            out[-1][1] = high
        else:
            out.append([low, high])
    return [(words[a:b], spans[a:b]) for a, b in out]


def edits_by_end(template: list[str], block: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """For each end of a stretch of the block: fewest word edits that turn a stretch with that end into the template, and its start."""
    n = len(block)
    words = np.array(block, object)
    cost, begin = np.zeros(n + 1, np.int64), np.arange(n + 1)
    for i, t in enumerate(template, 1):
        change = cost[:-1] + (words != t)
        drop = cost[1:] + 1
        use = change <= drop
        step = np.concatenate([[i], np.where(use, change, drop)])
        start = np.concatenate([[0], np.where(use, begin[:-1], begin[1:])])
        # insertions run along the row: the least of step[j] + (k - j) for j <= k
        base = step - np.arange(n + 1)
        best = np.minimum.accumulate(base)
        source = np.maximum.accumulate(np.where(base == best, np.arange(n + 1), 0))
        cost, begin = best + np.arange(n + 1), start[source]
    return cost, begin


def differences(template: list[str], block: list[str]) -> tuple[int, int, int]:
    """Fewest word edits that turn a stretch of the block into the template, and that stretch (the shortest, then first)."""
    cost, begin = edits_by_end(template, block)
    ends = np.flatnonzero(cost == cost.min())
    end = int(ends[np.argmin(ends - begin[ends])])
    return int(cost[end]), int(begin[end]), end


def _numbers(words: list[str]) -> list[str]:
    return sorted(w for w in words if w[0].isdigit())


class Scanner:
    def __init__(self, templates, share: float):
        self.templates = [(name, *_words(text)[:1]) for name, text in templates]
        self.counts = [Counter(w) for _, w in self.templates]
        self.numbers = [_numbers(w) for _, w in self.templates]
        self.most = [int(share * len(w)) for _, w in self.templates]  # differing words
        self.longest = max(len(w) for _, w in self.templates)
        self.reach = max(len(w) + m for (_, w), m in zip(self.templates, self.most))  # words of a stretch
        self.plain = zstandard.ZstdCompressor(level=3, write_content_size=False)
        self.with_template = [
            zstandard.ZstdCompressor(level=3, write_content_size=False, dict_data=zstandard.ZstdCompressionDict(
                " ".join(w).encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)) for _, w in self.templates]

    def saved(self, words: list[str]) -> list[int]:
        body = " ".join(words).encode()
        size = len(self.plain.compress(body))
        return [size - len(c.compress(body)) for c in self.with_template]

    def possible(self, words: list[str]) -> list[int]:
        """Templates that may be confirmed: each word that the piece lacks is a difference."""
        there = Counter(words)
        return [i for i, count in enumerate(self.counts)
                if sum(n - there[w] for w, n in count.items() if there[w] < n) <= self.most[i] and all(w in there for w in self.numbers[i])]

    def best(self, i: int, words: list[str], before: int) -> tuple[int, int, int] | None:
        """Differing words and place of the best stretch with the numbers of template ``i`` that starts before ``before``."""
        cost, begin = edits_by_end(self.templates[i][1], words)
        ends = np.flatnonzero((cost <= self.most[i]) & (begin < before))
        for end in ends[np.lexsort((ends, ends - begin[ends], cost[ends]))].tolist():
            if _numbers(words[begin[end] : end]) == self.numbers[i]:
                return int(cost[end]), int(begin[end]), end
        return None

    def __call__(self, text: str):
        """(license, saved bytes, differing words, template words, start, end) of every license found."""
        for words, spans in blocks(text, self.longest):
            words, at = list(words), 0
            while at < len(words):
                piece = words[at : at + PIECE * self.reach]
                last = at + len(piece) == len(words)
                own = len(piece) if last else len(piece) - self.reach  # a stretch that starts later is whole in the next piece
                while possible := self.possible(piece):
                    saved = self.saved(piece)
                    found = []
                    for rank, i in enumerate(sorted(possible, key=lambda i: (-saved[i], i))):
                        if stretch := self.best(i, piece, own):
                            found.append((2 * stretch[0] - len(self.templates[i][1]), rank, i, *stretch))
                    if not found:
                        break
                    _, _, i, edits, a, b = min(found)
                    yield self.templates[i][0], saved[i], edits, len(self.templates[i][1]), spans[at + a][0], spans[at + b - 1][1]
                    piece[a:b] = words[at + a : at + b] = ["\0"] * (b - a)  # taken: no template has this word
                at += len(piece) if last else own


def scan(docs: DataFrame, templates=TEMPLATES, share: float = 0.15, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per license found; at most ``share`` of a template's words may differ. ``saved_bytes`` is for the piece that holds it."""
    names = ["license", "saved_bytes", "differing", "words", "start", "end"]

    def run(batches):
        scanner = Scanner(templates, share)
        for batch in batches:
            rows = [(i, *found) for i, t in enumerate(batch.column(1)) if t.is_valid for found in scanner(t.as_py())]
            if rows:
                at, *columns = zip(*rows)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(at)), pa.array(columns[0], pa.string()), *[pa.array(c, pa.int64()) for c in columns[1:]]],
                    ["doc_id", *names])

    rows = docs.select(F.col(doc).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, license string, saved_bytes bigint, differing bigint, words bigint, start bigint, end bigint")
