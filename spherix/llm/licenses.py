"""License scans: MinHash bands over overlapping windows retrieve templates, exact containment verifies them.

A template of n five-word shingles is looked for in every window of n shingles. BANDS hash functions give
each window its minima, by sliding minimum; a window with any minimum equal to the template's is a candidate.
A window that shares s of all shingles with the template is missed with probability (1 - s)**BANDS: under
3e-6 at 0.8. Candidates are kept if at least MIN_CONTAINED of the template's shingles are in the window. A window
can share a minimum only where it holds one of the template's BANDS smallest shingles, so only documents with
such a shingle are looked at. Where templates match the same words, that with the most shingles found, less those
missing, stands. Templates are notices and the bodies in license_texts, a file per SPDX identifier.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession

from spherix.llm import common

SHINGLE, BANDS, MIN_CONTAINED = 5, 8, 0.8
#: Common license notices, by SPDX identifier.
NOTICES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "This project is licensed under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation."),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("EPL-1.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 which accompanies this distribution."),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide."),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0."),
)
TEMPLATES = NOTICES + tuple((p.stem, p.read_text(encoding="utf-8")) for p in sorted((Path(__file__).parent / "license_texts").glob("*.txt")))
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+").findall
_SEEDS = [np.uint64(xxhash.xxh64_intdigest(b"band", seed=k) | 1) for k in range(BANDS)]
_SHIFT = np.uint64(32)
KEPT_WORDS = 500_000
PART = 2 << 20


def words(data: bytes) -> list[bytes]:
    return _WORD(data.lower())


def _mix(x: np.ndarray, by: np.uint64) -> np.ndarray:
    x = x * by
    return x ^ (x >> _SHIFT)


def shingles(hashes: np.ndarray) -> np.ndarray:
    n = len(hashes) - SHINGLE + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, dtype=np.uint64)
    for k in range(SHINGLE):
        out = _mix(out ^ hashes[k : k + n], np.uint64(0x9E3779B97F4A7C15))
    return out


def _hash(word: bytes) -> int:
    return xxhash.xxh64_intdigest(word)


class Templates:
    def __init__(self, templates):
        self.names = [n for n, _ in templates]
        self.own = [np.unique(shingles(np.array([_hash(w) for w in words(t.encode())], dtype=np.uint64))) for _, t in templates]
        if any(not len(s) for s in self.own):
            raise ValueError(f"a template needs at least {SHINGLE} words")
        self.minima = np.array([[_mix(s, seed).min() for seed in _SEEDS] for s in self.own], dtype=np.uint64)
        self.by_shingle: dict[int, set[int]] = {}
        for t, s in enumerate(self.own):
            for seed in _SEEDS:
                self.by_shingle.setdefault(int(s[_mix(s, seed).argmin()]), set()).add(t)
        self.smallest = np.array(sorted(self.by_shingle), dtype=np.uint64)


def sliding_min(x: np.ndarray, n: int) -> np.ndarray:
    """Minimum of x over [i, i + n), by doubling; the last windows are cut short at the end."""
    m, width = x.copy(), 1
    while 2 * width <= n and width < len(m):
        m[: len(m) - width] = np.minimum(m[: len(m) - width], m[width:])
        width *= 2
    rest = min(n - width, width)
    if 0 < rest < len(m):
        m[: len(m) - rest] = np.minimum(m[: len(m) - rest], m[rest:])
    return m


def scan(docs: DataFrame, templates=TEMPLATES) -> DataFrame:
    """(doc_id, licenses): for every row the found licenses as (license, start, containment), by the window's first word.

    Of matches that overlap, one stands: that with the most shingles found less those missing, the first of these. Null
    texts and texts below five words have none. No row leaves its task, so there is no shuffle at all.
    """

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, kept = Templates(templates), {}
        for batch in batches:
            texts = common.text_bytes(batch.column(1))
            out: list[list] = [[] for _ in texts]
            lo = 0
            while lo < len(texts):
                flat, starts, size = [], [], 0
                hi = lo
                while hi < len(texts) and (hi == lo or size < PART):
                    own = words(texts[hi])
                    starts.append(len(flat))
                    for w in own:
                        h = kept.get(w)
                        if h is None:
                            h = _hash(w)
                            if len(kept) < KEPT_WORDS:
                                kept[w] = h
                        flat.append(h)
                    size += len(texts[hi])
                    hi += 1
                starts.append(len(flat))
                self_at = np.array(starts)
                s = shingles(np.array(flat, dtype=np.uint64))
                for doc, t, start, share, first, last in self_find(s, self_at, known):
                    out[lo + doc].append((known.names[t], start - starts[doc], share, len(known.own[t]), first, last))
                for i in range(lo, hi):
                    out[i] = _best(out[i])
                lo = hi
            kind = pa.list_(pa.struct([("license", pa.string()), ("start", pa.int64()), ("containment", pa.float64())]))
            rows = [[{"license": n, "start": int(a), "containment": float(c)} for n, a, c in x] for x in out]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, kind)], ["doc_id", "licenses"])

    return common.text_rows(docs).mapInArrow(find, "doc_id long, licenses array<struct<license:string,start:bigint,containment:double>>")


def self_find(s: np.ndarray, starts: np.ndarray, known: Templates) -> Iterator[tuple]:
    """(text, template, window start, containment, first, last shingle found) over shingles s of texts that begin at `starts`."""
    if not len(s) or not len(known.own):
        return
    there = known.smallest[np.minimum(np.searchsorted(known.smallest, s), len(known.smallest) - 1)] == s
    places: dict[tuple[int, int], list[int]] = {}
    for at in np.nonzero(there)[0].tolist():
        doc = int(np.searchsorted(starts, at, side="right")) - 1
        if at < starts[doc + 1] - SHINGLE + 1:
            for t in known.by_shingle[int(s[at])]:
                places.setdefault((doc, t), []).append(at)
    for (doc, t), at in sorted(places.items()):
        n = len(known.own[t])
        a, b = max(at[0] - n + 1, int(starts[doc])), min(at[-1] + n, int(starts[doc + 1]) - SHINGLE + 1)
        for start, share, first, last in _windows(s[a:b], known.own[t], known.minima[t]):
            yield doc, t, a + start, share, a + first, a + last


def _windows(part: np.ndarray, own: np.ndarray, minima: np.ndarray) -> Iterator[tuple]:
    """(start, containment, first, last shingle found) of windows with a minimum of the template's, best first, none overlapping."""
    n = len(own)
    index = np.minimum(np.searchsorted(own, part), n - 1)
    found = np.nonzero(own[index] == part)[0]
    if len(found) < MIN_CONTAINED * n:
        return
    # a shingle counts in the windows that hold it and not the same one before it
    order = np.lexsort((found, index[found]))
    again = np.nonzero(index[found[order[1:]]] == index[found[order[:-1]]])[0]
    before = np.full(len(found), -1)
    before[order[again + 1]] = found[order[again]]
    change = np.zeros(len(part) + 1, dtype=np.int64)
    np.add.at(change, np.maximum(np.maximum(before + 1, found - n + 1), 0), 1)
    np.add.at(change, found + 1, -1)
    share = np.cumsum(change)[:-1] / n
    if share.max() < MIN_CONTAINED:
        return
    near = np.zeros(len(part), dtype=bool)
    for seed, least in zip(_SEEDS, minima):
        near |= sliding_min(_mix(part, seed), n) == least
    share = np.where(near, share, 0)
    while share.max() >= MIN_CONTAINED:
        w = int(share.argmax())
        own_found = found[(found >= w) & (found < w + n)]
        yield w, float(share[w]), int(own_found[0]), int(own_found[-1])
        share[max(w - n + 1, 0) : w + n] = 0


def _best(found: list[tuple]) -> list[tuple]:
    """Of (name, start, share, n, first, last), (name, start, share) of those that stand, by start."""
    out: list[tuple] = []
    for x in sorted(found, key=lambda x: (-x[3] * (2 * x[2] - 1), x[1], x[0])):
        if all(x[5] < y[4] or y[5] < x[4] for y in out):
            out.append(x)
    return sorted([x[:3] for x in out], key=lambda x: (x[1], x[0]))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_matches, licenses (names, comma-joined) and best_containment, a row per row of documents.

    Null and short texts have none; rows that repeat or have no doc_id are scanned each; an empty table gives no rows.
    """
    from pyspark.sql import functions as F

    out = scan(common.table(spark, sf_dir, "documents"))
    names = F.array_sort(F.array_distinct(F.transform("licenses", lambda x: x["license"])))
    return out.select("doc_id", F.size("licenses").cast("long").alias("n_matches"), F.array_join(names, ",").alias("licenses"), F.round(F.array_max(F.transform("licenses", lambda x: x["containment"])), 6).alias("best_containment"))
