"""License scan: MinHash bands over overlapping windows retrieve templates, exact shingle containment verifies them.

A template of m words (ASCII letters lower-cased, punctuation dropped) is a set of shingles of `q` words. Documents are
read in windows of m + stride - 1 words that start every `stride` words, so that each run of m words lies whole inside
some window; the last window ends with the document, and a shorter document is one window. A window that holds a share
c of the template has a Jaccard similarity of at least c*t / ((2 - c)*t + stride - 1) for t shingles; bands and rows are
the cheapest pair that collides then with probability `certainty` or more. Windows that collide are verified by counting
the template's shingles in them. Overlapping matches of one template become one span.

Templates are a parameter and small; they travel with the task. Null and short texts (under q words) match nothing,
templates under q words use shingles of their own length. Repeated documents give repeated rows. An empty table or no
template gives no rows. Only the named columns are read.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lagweave.llm import kernels as K

SHINGLE, CONTAINMENT, CERTAINTY = 5, 0.8, 0.9999

# Wordings of public license notices.
TEMPLATES = (
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("MIT", "Released under the MIT License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("Apache-2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
)


def band_settings(similarity: float, certainty: float) -> tuple[int, int]:
    """(bands, rows) with the fewest hashes such that 1 - (1 - similarity**rows)**bands >= certainty."""
    best = None
    for rows in (1, 2, 3, 4):
        p = similarity ** rows
        bands = 1 if p >= 1 else math.ceil(math.log(1 - certainty) / math.log(1 - p))
        if best is None or bands * rows < best[0] * best[1]:
            best = (bands, rows)
    return best


@dataclass
class Template:
    name: str
    number: int
    m: int
    q: int
    stride: int
    shingles: np.ndarray
    bands: int
    rows: int
    keys: np.ndarray


MULTIPLIERS = K.mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(K.STEPS[2])) | np.uint64(1)


def _words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    low = K.LOWER[data]
    starts, ends, bounds = K.word_bounds(low, offsets, K.ALPHANUMERIC)
    return starts, ends, bounds, K.word_hashes(low, starts, ends)


def _band_keys(minima: list[np.ndarray], bands: int, rows: int) -> list[np.ndarray]:
    out = []
    for b in range(bands):
        key = minima[b * rows]
        for r in range(1, rows):
            key = K.mixed(key * np.uint64(K.STEPS[1]) + minima[b * rows + r])
        out.append(key)
    return out


def prepare(templates: tuple[tuple[str, str], ...], q: int = SHINGLE, containment: float = CONTAINMENT, certainty: float = CERTAINTY) -> list[Template]:
    out = []
    for number, (name, text) in enumerate(templates):
        _, _, bounds, h = _words(*K.text_bytes(pa.array([text])))
        m = len(h)
        if not m:
            continue
        n = min(q, m)
        shingles = np.unique(K.ngram_hashes(h, bounds, n)[0])
        stride = max(1, m // 8)
        bands, rows = band_settings(containment * len(shingles) / ((2 - containment) * len(shingles) + stride - 1), certainty)
        minima = [np.min(shingles * a, keepdims=True) for a in MULTIPLIERS[:bands * rows]]
        out.append(Template(name, number, m, n, stride, shingles, bands, rows, np.array([k[0] for k in _band_keys(minima, bands, rows)], np.uint64)))
    return out


def _windows(bounds: np.ndarray, m: int, q: int, stride: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, first word, end word) of all windows."""
    n = np.diff(bounds)
    width = m + stride - 1
    many = np.where(n >= q, np.maximum(-(-(n - width) // stride), 0) + 1, 0)
    doc = np.repeat(np.arange(len(n)), many)
    k = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    first = np.minimum(k * stride, np.maximum(n[doc] - width, 0))
    return doc, bounds[doc] + first, bounds[doc] + np.minimum(first + width, n[doc])


def scan_texts(data: np.ndarray, offsets: np.ndarray, templates: list[Template], containment: float) -> list[tuple]:
    """(text, template, first word, end word, byte start, byte end, containment) of all verified matches, merged."""
    starts, ends, bounds, h = _words(data, offsets)
    found: dict[tuple[int, int], list] = {}
    shapes: dict[tuple[int, int, int], list[Template]] = {}
    for t in templates:
        shapes.setdefault((t.m, t.q, t.stride), []).append(t)
    grams: dict[int, np.ndarray] = {}
    for (m, q, stride), same in shapes.items():
        if len(h) < q:
            continue
        if q not in grams:
            total = np.zeros(len(h) - q + 1, np.uint64)
            for j in range(q):
                total += h[j:j + len(total)] * np.uint64(K.STEPS[j % 5] + 2 * (j // 5))
            grams[q] = K.mixed(total)
        g = grams[q]
        doc, first, end = _windows(bounds, m, q, stride)
        if not len(doc):
            continue
        pairs = np.empty(2 * len(doc), np.int64)
        pairs[0::2], pairs[1::2] = first, end - q + 1
        hashes = max(t.bands * t.rows for t in same)
        minima = [np.minimum.reduceat(np.append(g * a, np.uint64(0xFFFFFFFFFFFFFFFF)), pairs)[0::2] for a in MULTIPLIERS[:hashes]]
        for t in same:
            near = np.zeros(len(doc), bool)
            for key, want in zip(_band_keys(minima, t.bands, t.rows), t.keys):
                near |= key == want
            for i in np.flatnonzero(near).tolist():
                share = float(np.isin(t.shingles, g[first[i]:end[i] - q + 1]).mean())
                if share >= containment:
                    found.setdefault((int(doc[i]), t.number), []).append((int(first[i]), int(end[i]), share))
    out = []
    for (d, t), spans in sorted(found.items()):
        spans.sort()
        a, b, share = spans[0]
        for x, y, s in [*spans[1:], (1 << 60, 1 << 60, 0.0)]:
            if x < b:
                b, share = max(b, y), max(share, s)
                continue
            out.append((d, t, a - int(bounds[d]), b - int(bounds[d]), int(starts[a] - offsets[d]), int(ends[b - 1] - offsets[d]), share))
            a, b, share = x, y, s
    return out


def scanner(templates: list[Template], containment: float) -> Callable:
    """Task function over (doc_id, text)."""
    names = {t.number: t.name for t in templates}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, offsets in K.text_slices(batch, "text"):
                found = scan_texts(data, offsets, templates, containment)
                cols = list(zip(*found)) or [()] * 7
                yield pa.RecordBatch.from_arrays([
                    rows.column(0).take(pa.array(cols[0], pa.int64())), pa.array([names[t] for t in cols[1]], pa.string()), pa.array(cols[1], pa.int32()),
                    *[pa.array(c, pa.int64()) for c in cols[2:6]], pa.array(cols[6], pa.float64())],
                    names=["doc_id", "license", "template", "first_word", "end_word", "byte_start", "byte_end", "containment"])

    return run


def scan(docs: DataFrame, templates: tuple[tuple[str, str], ...] = TEMPLATES, doc_id: str = "doc_id", text: str = "text", q: int = SHINGLE,
         containment: float = CONTAINMENT, certainty: float = CERTAINTY) -> DataFrame:
    """One row per matched span: doc_id, license, template (its number), first_word, end_word, byte_start, byte_end,
    containment."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(scanner(prepare(templates, q, containment, certainty), containment), (
        f"doc_id {kind}, license string, template int, first_word long, end_word long, byte_start long, byte_end long, containment double"))
