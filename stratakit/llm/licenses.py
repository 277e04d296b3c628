"""License scans: MinHash bands over text windows retrieve templates, exact shingle containment verifies them."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratakit.llm.common import lean
from stratakit.llm.substrings import WordHashes, hashed, rolled, sliding_min

# Public licence notices, as authors put them at the head of a text.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0 header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "BSD": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "MIT": "Released under the MIT License.",
    "MIT text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
}

SHINGLE = 5
WINDOWS = (5, 8, 16, 32, 64)  # words
PUNCTUATION = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def plain_words(text: bytes) -> list[bytes]:
    """Words in small letters without ASCII punctuation; what was punctuation alone is no word."""
    return text.translate(LOWER, PUNCTUATION).split()


def stride(window: int) -> int:
    return max(1, window // 4)


def bands_for(similarity: float, rows: int, sure: float) -> int:
    """The least number of bands with which two windows of this similarity meet with probability ``sure``."""
    return math.ceil(math.log(1 - sure) / math.log(1 - similarity**rows))


class Bands:
    """MinHash of windows of each length, cut into bands of ``rows``; one-shingle windows need no more than one value."""

    def __init__(self, similarity: float = 0.8, rows: int = 2, sure: float = 0.999, seed: int = 23):
        self.rows, self.bands = rows, bands_for(similarity, rows, sure)
        rng = np.random.default_rng(seed)
        self.a = rng.integers(0, 1 << 63, self.bands * rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.b = rng.integers(0, 1 << 63, self.bands * rows, dtype=np.uint64)

    def keys(self, h: np.ndarray, windows: list[int], step) -> Iterator[tuple[int, int, np.ndarray]]:
        """(window, band, key of each window start, every ``step(window)`` words) over shingle hashes ``h``."""
        for w in windows:
            if w == SHINGLE:
                yield w, 0, h[::step(w)]
        longer = [w for w in windows if w > SHINGLE and len(h) >= w - SHINGLE + 1]
        if not longer:
            return
        for band in range(self.bands):
            mixed = {}
            for r in range(self.rows):
                k = band * self.rows + r
                v = h * self.a[k] + self.b[k]
                v ^= v >> np.uint64(32)
                have = 1
                for w in longer:  # windows grow, and so does the part already minimised
                    n = w - SHINGLE + 1
                    v = sliding_min(v, n - have + 1)
                    have = n
                    got = v[::step(w)]
                    mixed[w] = got if r == 0 else mixed[w] * np.uint64(0x9E3779B97F4A7C15) + got
            for w in longer:
                yield w, band, mixed[w] ^ np.uint64(w << 8 | band)


class Templates:
    """The templates' shingles and the band keys of all their windows; small enough for every executor.

    A text that holds a share c of a template's shingles holds at least c of those of some window of it. The text's
    window there may have other shingles in the place of the rest, so the two windows are alike by c / (2 - c) at
    least: that is the similarity at which bands must meet.
    """

    def __init__(self, texts: dict[str, str] = TEMPLATES, similarity: float = 0.8):
        self.names, self.similarity, self.bands = sorted(texts), similarity, Bands(similarity / (2 - similarity))
        self.words = [plain_words(texts[n].encode()) for n in self.names]
        short = [n for n, w in zip(self.names, self.words, strict=True) if len(w) < SHINGLE]
        if short:
            raise ValueError(f"templates of fewer than {SHINGLE} words: {short}")
        self.shingles = [{b" ".join(w[i:i + SHINGLE]) for i in range(len(w) - SHINGLE + 1)} for w in self.words]
        self.window = [max(w for w in WINDOWS if w + stride(w) - 1 <= len(x)) for x in self.words]
        self.windows = sorted(set(self.window))
        known, table = WordHashes(), {}
        for t, (words, w) in enumerate(zip(self.words, self.window, strict=True)):
            for w_, band, keys in self.bands.keys(rolled(hashed(words, known), SHINGLE), [w], lambda _: 1):
                for k in keys.tolist():
                    table.setdefault((w_, band), {}).setdefault(k, set()).add(t)
        self.table = table
        self.sieve = {}
        for at, keys in table.items():
            self.sieve[at] = np.zeros(1 << 16, bool)
            self.sieve[at][[k & 0xFFFF for k in keys]] = True


def matches(text: bytes, templates: Templates, known: WordHashes) -> list[tuple[int, int, int, float]]:
    """(template, first word, end word, containment) of each place of a template that the whole text contains.

    containment counts the template's shingles over the whole text. A place holds enough of them by itself; if none
    does, since the template is split, there is one match from the first to the last shingle.
    """
    words = plain_words(text)
    if len(words) < SHINGLE:
        return []
    h = rolled(hashed(words, known), SHINGLE)
    candidates: dict[int, set[int]] = {}
    for w, band, keys in templates.bands.keys(h, templates.windows, stride):
        if (w, band) not in templates.table:
            continue
        table = templates.table[w, band]
        for i in np.flatnonzero(templates.sieve[w, band][keys & np.uint64(0xFFFF)]).tolist():
            for t in table.get(int(keys[i]), ()):
                candidates.setdefault(t, set()).add(i * stride(w))
    out = []
    for t, places in candidates.items():
        size, wanted, end = len(templates.words[t]), templates.shingles[t], -1
        every = [(i, s) for i in range(len(words) - SHINGLE + 1) if (s := b" ".join(words[i:i + SHINGLE])) in wanted]
        share, found = len({s for _, s in every}) / len(wanted), []
        if share < templates.similarity:
            continue
        for p in sorted(places):
            if p < end:
                continue
            a, b = p - size, p + size + templates.window[t] - SHINGLE
            here = [(i, s) for i, s in every if a <= i <= b]
            if len({s for _, s in here}) >= templates.similarity * len(wanted):
                end = here[-1][0] + SHINGLE
                found.append((t, here[0][0], end, share))
        out += found or [(t, every[0][0], every[-1][0] + SHINGLE, share)]
    return sorted(out, key=lambda m: (m[1], m[0]))


def license_matches(docs: DataFrame, templates: Templates) -> DataFrame:
    """(doc_id, matches) for each row of ``docs``: an array of (license, first_word, end_word, containment) by place.

    Shingles of five words, containment of the template 0.8 or more. Words are counted after punctuation is
    dropped. Null, empty and short texts have no match; repeated rows are repeated; other columns are not read.
    """
    sent = docs.sparkSession.sparkContext.broadcast(templates)
    rows = lean(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    kind = pa.list_(pa.struct([("license", pa.string()), ("first_word", pa.int64()), ("end_word", pa.int64()), ("containment", pa.float64())]))

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for batch in batches:
            got = [[{"license": sent.value.names[t], "first_word": a, "end_word": b, "containment": c} for t, a, b, c in matches(x.as_py() or b"", sent.value, known)] for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(got, kind)], ["doc_id", "matches"])

    return rows.mapInArrow(scanned, "doc_id long, matches array<struct<license: string, first_word: long, end_word: long, containment: double>>")


def sql(texts: dict[str, str] = TEMPLATES) -> str:
    """The same scan in DuckDB without bands: every shingle of every document against those of all templates."""
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    rows = ", ".join(f"({quoted(n)}, {quoted(b' '.join(plain_words(t.encode())).decode())})" for n, t in sorted(texts.items()))
    return rf"""
WITH templates AS (SELECT license, string_split(words, ' ') AS w FROM (VALUES {rows}) AS t(license, words)),
  wanted AS (SELECT DISTINCT license, array_to_string(w[i:i + 4], ' ') AS shingle FROM templates, unnest(range(1, len(w) - 3)) AS u(i)),
  sizes AS (SELECT license, count(*) AS n FROM wanted GROUP BY 1),
  texts AS (SELECT doc_id, coalesce(regexp_extract_all(lower(regexp_replace(text, '[!-/:-@\[-`{{-~]', '', 'g')), '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
  shingles AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS shingle FROM texts, unnest(range(1, len(w) - 3)) AS u(i)),
  shares AS (SELECT doc_id, license, count(*) / CAST(any_value(n) AS DOUBLE) AS share FROM shingles JOIN wanted USING (shingle) JOIN sizes USING (license) GROUP BY 1, 2),
  found AS (SELECT doc_id, string_agg(license, ',' ORDER BY license) AS licenses, max(share) AS containment FROM shares WHERE share >= 0.8 GROUP BY 1)
SELECT doc_id, coalesce(licenses, '') AS licenses, containment FROM documents LEFT JOIN found USING (doc_id)"""
