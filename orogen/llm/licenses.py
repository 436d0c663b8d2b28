"""License scans: MinHash bands over overlapping windows, then exact containment.

Texts and templates are folded to lower-case words of letters and digits, and cut into
shingles of five words. A template with t shingles belongs to the class of the least
power of two s with t <= s + 1. For each class, a text's shingles are cut into
blocks of s; a window is two neighbouring blocks, so any t neighbouring
shingles lie in one window. Each window has BANDS MinHash values, each a
band of one row; a window meets a template when a band agrees.

The least Jaccard similarity of a template held to ``least`` by a window of its
class is J = least t / (2 s + (1 - least) t), at least 0.19 for t > s / 2, so a
match is missed with probability (1 - J)^BANDS, below 2e-6. ``miss_bound`` gives
the value for a template.

Candidates are verified: the share of the template's shingles found in the window must
reach ``least``. A text of fewer words than five is one shingle.

Cases: null or empty text matches nothing. A template without words is an error.
Repeated rows each get their matches; a null doc_id is kept. Texts of any length are
taken whole; an empty table gives an empty one. Extra columns are ignored. Nothing is shuffled: templates are few and travel with the task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kit import LOWER, U64, TextView, mix, shingle_hashes, slices

WORDS, BANDS = 5, 64

# Notices by which public licenses are declared.
TEMPLATES = {
    "mit": "Released under the MIT License.",
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-notice": "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
}

_FOLD = LOWER.copy()
_FOLD[[b for b in range(128) if not chr(b).isalnum()]] = 32
_SEEDS = (mix(np.arange(1, BANDS + 1, dtype=np.uint64) * U64(0x632BE59BD9B4E019)) >> U64(32)).astype(np.uint32) | np.uint32(1)

_NONE = np.uint32(0xFFFFFFFF)
_ROW = np.arange(BANDS, dtype=np.uint32) << np.uint32(16)


def folded_shingles(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(shingle hashes, first shingle of each text, shingle's first word in its text)."""
    view = TextView(texts)
    view.data = _FOLD[view.data]
    words, first = view.word_hashes(), view.first
    parts = [shingle_hashes(words[a:b], WORDS) for a, b in zip(first[:-1], first[1:], strict=True)]
    sizes = np.array([len(p) for p in parts], np.int64)
    start = np.append(0, np.cumsum(sizes))
    return (np.concatenate(parts) if parts else words[:0]), start, np.arange(start[-1]) - np.repeat(start[:-1], sizes)


def class_of(t: int) -> int:
    return 1 << max(0, (t - 2).bit_length()) if t > 1 else 1


def miss_bound(t: int, least: float) -> float:
    """The greatest chance that a template of t shingles, held to ``least``, meets no band."""
    j = least * t / (2 * class_of(t) + (1 - least) * t)
    return (1 - j) ** BANDS


class Catalogue:
    """Templates by class, with their band values and a table that rules most windows out."""

    def __init__(self, templates: dict[str, str]):
        names = sorted(templates)
        hashes, start, _ = folded_shingles(pa.array([templates[n] for n in names]))
        self.classes: dict[int, list[tuple[str, np.ndarray, np.ndarray]]] = {}
        for name, a, b in zip(names, start[:-1], start[1:], strict=True):
            if a == b:
                raise ValueError(f"template {name} has no words")
            own = np.unique(hashes[a:b])
            self.classes.setdefault(class_of(len(own)), []).append((name, own, band_hashes(own).min(axis=0)))
        self.maybe = {}
        for s, rows in self.classes.items():
            table = np.zeros((BANDS, 1 << 16), bool)
            for _, _, values in rows:
                table[np.arange(BANDS), values >> 16] = True
            self.maybe[s] = table


def band_hashes(hashes: np.ndarray) -> np.ndarray:
    """Shingles x BANDS: a 32-bit hash of every shingle for each band."""
    folded = (mix(hashes) >> U64(32)).astype(np.uint32)
    out = folded[:, None] * _SEEDS[None, :]
    return out ^ (out >> np.uint32(15))


def matches(texts: pa.Array, catalogue: Catalogue, least: float) -> list[tuple[int, str, float, int, int]]:
    """(text, template, best containment, its first word, words it spans)."""
    hashes, start, word = folded_shingles(texts)
    best: dict[tuple[int, str], tuple[float, int, int]] = {}
    if not len(hashes):
        return []
    owner = np.repeat(np.arange(len(start) - 1), np.diff(start))
    values, blocks, s = band_hashes(hashes), np.arange(len(hashes)), 1
    while s <= max(catalogue.classes):
        if s > 1:  # two blocks of half the size make one, the last of a text may stand alone
            even = word[blocks] % s == 0
            first = np.flatnonzero(even)
            second = np.minimum(first + 1, len(blocks) - 1)
            values = np.minimum(values[first], np.where(even[second, None], _NONE, values[second]))
            blocks = blocks[first]
        if s in catalogue.classes:
            pair = np.append(owner[blocks][1:] == owner[blocks][:-1], False)  # the window's second block is of the same text
            after = np.minimum(np.arange(len(blocks)) + 1, len(blocks) - 1)
            windows = np.minimum(values, np.where(pair[:, None], values[after], _NONE))
            hit = catalogue.maybe[s].ravel()[(windows >> np.uint32(16)) + _ROW].any(axis=1)
            for i in np.flatnonzero(hit):
                text, a = int(owner[blocks[i]]), int(blocks[i])
                b = min(a + 2 * s, int(start[text + 1]))
                for name, own, bands in catalogue.classes[s]:
                    if not (bands == windows[i]).any():
                        continue
                    found = np.isin(hashes[a:b], own)
                    share = len(np.unique(hashes[a:b][found])) / len(own)
                    if share >= least:
                        where = np.flatnonzero(found)
                        this = (share, -int(word[a + where[0]]), int(where[-1] - where[0]) + WORDS)
                        best[text, name] = max(best.get((text, name), this), this)
        s *= 2
    return [(text, name, share, -at, span) for (text, name), (share, at, span) in sorted(best.items())]


def scan(docs: DataFrame, templates: dict[str, str] | None = None, least: float = 0.8) -> DataFrame:
    """doc_id, license, containment, first_word, n_words: each document's best match of every template, the first of equals."""
    templates = dict(TEMPLATES if templates is None else templates)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        catalogue = Catalogue(templates)
        for batch in batches:
            for rows, text in slices(batch, most=500_000):
                got = matches(text, catalogue, least)
                at, name, share, first, span = zip(*got, strict=True) if got else ((),) * 5
                columns = [rows.column(0).take(pa.array(at, pa.int64())), pa.array(name, pa.string()), pa.array(share, pa.float64()), pa.array(first, pa.int64()), pa.array(span, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "license", "containment", "first_word", "n_words"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, license string, containment double, first_word long, n_words long")
