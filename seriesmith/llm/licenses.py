"""License scans: MinHash bands over overlapping windows retrieve templates, exact shingle containment decides.

Words are lower-cased runs of ASCII letters, digits and non-ASCII characters; shingles are five words (a shorter
template is one shingle). Templates fall into classes of like size. A class of at most s shingles looks at windows of
three steps of ceil(s / 2) shingles, one step apart, so that an unbroken copy lies wholly in some window. The number
of bands follows from the lowest Jaccard similarity that a window with the wanted containment can have, so that such a
window shares a band with the template with probability ``sure`` at least. A retrieved template matches if the window
holds at least ``min_pct`` percent of its distinct shingles, and the words that tell the license from its relatives (a
version, "Lesser") stand in it exactly. Of overlapping matches of several licenses those with most shingles stay.

Everything happens inside the scan: the template table is fixed and small, documents are not shuffled.

Defined cases: null, empty or word-less text has no license; a text shorter than a shingle can only match a template
of that very word sequence; repeated rows are scanned each; templates of equal shingles all match; extra columns are
not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from math import ceil, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import scan

K = 5

GPL = "gnu general public license"


def words(text: str) -> str:
    """The words of a text as the scan sees them, for ASCII."""
    return " ".join(re.findall("[a-z0-9]+", text.lower()))


def gnu(kind: str) -> str:
    return words(f"gnu {kind} general public license")


GNU = (("GPL-1.0", "", "1"), ("GPL-2.0", "", "2"), ("GPL-3.0", "", "3"), ("LGPL-2.0", "Library", "2"), ("LGPL-2.1", "Lesser", "2.1"), ("LGPL-3.0", "Lesser", "3"),
       ("AGPL-3.0", "Affero", "3"))
CC = (("BY", ""), ("BY-SA", "-ShareAlike"), ("BY-ND", "-NoDerivatives"), ("BY-NC", "-NonCommercial"), ("BY-NC-SA", "-NonCommercial-ShareAlike"),
      ("BY-NC-ND", "-NonCommercial-NoDerivatives"))
BSD = ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
       "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
       "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation "
       "and/or other materials provided with the distribution.",
       "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software "
       "without specific prior written permission.")
NUMBERED = (("1.", "2.", "3."), ("", "", ""))

# Notices and key passages of public licenses, and the words that tell a license from its relatives.
TEMPLATES: tuple[tuple, ...] = (
    ("MIT", "Released under the MIT License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0.", ("apache license version 2",)),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3.", (GPL, "public license version 3")),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License.", ("attribution 4 0",)),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
     ("attribution sharealike 4 0",)),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
            "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the "
            "rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit "
            "persons to whom the Software is furnished to do so, subject to the following conditions:", ("subject to the following conditions",)),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
            "following conditions are met:"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance "
                   "with the License. You may obtain a copy of the License at", ("apache license version 2",)),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
                "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
     (GPL, "version 3 of")),
    *[(name, f"This work is licensed under the GNU {kind} General Public License, version {v}.", (f"{gnu(kind)}", f"public license version {words(v)}"))
      for name, kind, v in GNU if name != "GPL-3.0"],
    *[(name, f"This {thing} is free software{mark} you can redistribute it and/or modify it under the terms of the GNU {kind} General Public License "
             f"as published by the Free Software Foundation{',;'[mark == ';']} either version {v} of the License, or (at your option) any later version.",
       (gnu(kind), f"version {words(v)} of"))
      for name, kind, v in GNU if name != "GPL-3.0" for thing, mark in ((("library", ";") if kind in ("Lesser", "Library") else ("program", ";")),)],
    *[(name, f"This {thing} is free software; you can redistribute it and/or modify it under the terms of the GNU {kind} General Public License "
             f"version {v} as published by the Free Software Foundation.", (gnu(kind), f"public license version {words(v)}"))
      for name, kind, v in GNU for thing in (("library" if kind in ("Lesser", "Library") else "program"),)],
    *[(name, f"GNU {kind} GENERAL PUBLIC LICENSE Version {v}, {date} Copyright (C) {years} Free Software Foundation, Inc.", (gnu(kind), f"public license version {words(v)}"))
      for name, kind, v, date, years in (
          ("GPL-1.0", "", "1", "February 1989", "1989"), ("GPL-2.0", "", "2", "June 1991", "1989, 1991"), ("GPL-3.0", "", "3", "29 June 2007", "2007"),
          ("LGPL-2.0", "Library", "2", "June 1991", "1991"), ("LGPL-2.1", "Lesser", "2.1", "February 1999", "1991, 1999"),
          ("LGPL-3.0", "Lesser", "3", "29 June 2007", "2007"), ("AGPL-3.0", "Affero", "3", "19 November 2007", "2007"))],
    *[(f"CC-{short}-{v}", f"This work is licensed under a Creative Commons Attribution{rest} {v} {port} License.", (f"{words('attribution' + rest)} {words(v)}",))
      for v, port in (("4.0", "International"), ("3.0", "Unported")) for short, rest in CC if (short, v) not in (("BY", "4.0"), ("BY-SA", "4.0"))],
    *[(f"CC-{short}-{v}", f"Licensed under CC {short} {v}.") for v in ("4.0", "3.0") for short, _ in CC if (short, v) != ("BY-NC", "4.0")],
    ("CC0-1.0", "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to "
                "the public domain worldwide. This software is distributed without any warranty."),
    ("CC0-1.0", "Creative Commons Legal Code CC0 1.0 Universal CREATIVE COMMONS CORPORATION IS NOT A LAW FIRM AND DOES NOT PROVIDE LEGAL SERVICES.",
     ("cc0 1 0 universal",)),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, "
                  "or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("MIT-0", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "
              "\"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, "
              "distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so. THE SOFTWARE "
              "IS PROVIDED \"AS IS\"", ("do so the software is",)),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the "
            "above copyright notice and this permission notice appear in all copies.", ("granted provided that the above",)),
    ("0BSD", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. THE SOFTWARE IS "
             "PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES", ("granted the software is provided",)),
    *[("BSD-2-Clause", f"{BSD[0]} {a} {BSD[1]} {b} {BSD[2]} THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\"",
       ("with the distribution this software",)) for a, b, _ in NUMBERED],
    *[("BSD-3-Clause", f"{BSD[0]} {a} {BSD[1]} {b} {BSD[2]} {c} {BSD[3]}", (f"{words('with the distribution ' + c)} neither", "prior written permission"))
      for a, b, c in NUMBERED],
    *[("BSD-4-Clause", f"{BSD[0]} {a} {BSD[1]} {b} {BSD[2]} {c} All advertising materials mentioning features or use of this software must display "
                       f"the following acknowledgement:", ("advertising materials mentioning features or",)) for a, b, c in NUMBERED],
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION",
     ("apache license version 2 0",)),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this "
                "file, You can obtain one at", ("mozilla public license v 2",)),
    ("MPL-2.0", "Mozilla Public License Version 2.0 1. Definitions 1.1. \"Contributor\" means each individual or legal entity that creates, contributes to "
                "the creation of, or owns Covered Software.", ("public license version 2 0",)),
    ("MPL-1.1", "The contents of this file are subject to the Mozilla Public License Version 1.1 (the \"License\"); you may not use this file except in "
                "compliance with the License. You may obtain a copy of the License at", ("mozilla public license", "public license version 1 1")),
    ("MPL-1.1", "MOZILLA PUBLIC LICENSE Version 1.1 1. Definitions.", ("mozilla public license", "license version 1 1")),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at",
     ("eclipse public license 2 0",)),
    ("EPL-1.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 which accompanies this "
                "distribution, and is available at", ("eclipse public license v1 0",)),
    ("BSL-1.0", "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying "
                "documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software"),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages "
             "arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial "
             "applications, and to alter it and redistribute it freely, subject to the following restrictions:"),
)


def shingles(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Shingle hashes of all rows, the bounds of each row's, and the number of words of each row."""
    w = scan.words(scan.LOWER[data], offs, scan.ALNUM)
    h, at = scan.windows(w.hash, w.bounds, K, whole=True)
    return h, np.searchsorted(at, w.bounds), np.diff(w.bounds)


def bands_needed(similarity: float, rows: int, sure: float) -> int:
    return max(1, ceil(log(1 - sure) / log(1 - similarity**rows))) if similarity < 1 else 1


class SizeClass:
    """Templates of more than half of ``most`` shingles and at most ``most``, with their band keys."""

    def __init__(self, most: int, templates: list[tuple[int, np.ndarray]], min_pct: int, rows: int, sure: float):
        self.step = ceil(most / 2)
        self.templates = templates
        least = min(len(s) for _, s in templates)
        self.rows = rows
        hit = min_pct * least / 100
        self.similarity = hit / (3 * self.step + least - hit)
        self.bands = bands_needed(self.similarity, rows, sure)
        rng = np.random.default_rng(most)
        self.factors = rng.integers(1, 1 << 63, self.bands * rows, np.uint64) * np.uint64(2) + np.uint64(1)
        lows = [[np.array([(s * f).min()]) for f in self.factors] for _, s in templates]
        self.keys = np.array([[self.combine(low[b * rows : (b + 1) * rows])[0] for b in range(self.bands)] for low in lows], np.uint64)

    def combine(self, mins: list[np.ndarray]) -> np.ndarray:
        """A band's key from its rows' minima."""
        out = np.zeros_like(mins[0])
        for m in mins:
            out = scan.mix(out * np.uint64(scan.BASE) + m)
        return out

    def retrieve(self, h: np.ndarray, starts: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Pairs (window, template) that share a band. Window i is block i and up to two more, to block ``last[i]``."""
        found = [np.zeros((0, 2), np.int64)]
        turned = np.empty_like(h)
        index = np.arange(len(starts))
        none = np.full(2, np.iinfo(np.uint64).max, np.uint64)
        for band in range(self.bands):
            mins = []
            for f in self.factors[band * self.rows : (band + 1) * self.rows]:
                block = np.minimum.reduceat(np.multiply(h, f, out=turned), starts)  # mixed hashes times an odd factor: a new order
                padded, low = np.concatenate([block, none]), block
                for j in (1, 2):
                    low = np.where(index + j <= last, np.minimum(low, padded[j : j + len(block)]), low)
                mins.append(low)
            key = self.combine(mins)
            for t, want in enumerate(self.keys[:, band]):
                if (at := np.flatnonzero(key == want)).size:
                    found.append(np.stack([at, np.full(len(at), t)], 1))
        return np.unique(np.concatenate(found), axis=0)


def spots(text: str, phrase: str) -> list[int]:
    """The shingles of a template that hold all words of a phrase."""
    w, x = words(text).split(" "), phrase.split(" ")
    places = [p for p in range(len(w) - len(x) + 1) if w[p : p + len(x)] == x]
    out = sorted({j for p in places for j in range(max(0, p + len(x) - K), p + 1) if j == 0 or j + K <= len(w)})
    if not out:
        raise ValueError(f"no shingle of the template holds {phrase!r}")
    return out


class Scanner:
    def __init__(self, templates: Sequence[tuple], min_pct: int = 80, rows: int = 1, sure: float = 0.9999):
        self.names, self.min_pct = [t[0] for t in templates], min_pct
        self.first: dict[int, np.ndarray] = {}
        self.exact: dict[int, list[np.ndarray]] = {}
        data, offs = scan.utf8(pa.array([t[1] for t in templates], pa.string()))
        h, bounds, _ = shingles(data, offs)
        by: dict[int, list[tuple[int, np.ndarray]]] = {}
        for i in range(len(templates)):
            s, first, which = np.unique(h[bounds[i] : bounds[i + 1]], return_index=True, return_inverse=True)
            if len(s):
                self.first[i] = first
                self.exact[i] = [np.unique(which[spots(templates[i][1], x)]) for x in (templates[i][2] if len(templates[i]) > 2 else ())]
                by.setdefault((len(s) - 1).bit_length(), []).append((i, s))
        self.classes = [SizeClass(1 << b, ts, min_pct, rows, sure) for b, ts in sorted(by.items())]

    def verify(self, which: int, s: np.ndarray, h: np.ndarray, a: int, b: int) -> tuple[int, int, np.ndarray] | None:
        """Percent and number of the template's shingles in a window, and where they stand; None if too few or another license's.

        Exact words count if they stand about as far apart as in the template: words of two notices in one window don't add up.
        """
        at = np.flatnonzero(np.isin(h[a:b], s)) + a
        found = np.searchsorted(s, h[at])
        held = len(np.unique(found))
        pct = 100 * held // len(s)
        if pct < self.min_pct:
            return None
        if not self.exact[which]:
            return pct, held, at
        start = at - self.first[which][found]
        order = np.argsort(start, kind="stable")
        runs = np.split(order, np.flatnonzero(np.diff(start[order]) > max(2, len(s) // 2)) + 1)
        runs = [r for r in runs if all(np.isin(x, found[r]).any() for x in self.exact[which])]
        if not runs:
            return None
        own = np.sort(np.concatenate(runs))
        return pct, len(np.unique(found[own])), at[own]

    def best(self, matches: list[tuple]) -> list[tuple]:
        """The matches that no other license's match covers for the larger part with more shingles, in the order of their windows."""
        kept: list[tuple] = []
        for m in sorted(matches, key=lambda m: (-m[0], -m[1], m[2], m[3])):
            better = (k for k in kept if k[:2] > m[:2] and self.names[k[2]] != self.names[m[2]])
            if not any(2 * np.isin(m[4], k[4]).sum() > len(m[4]) for k in better):
                kept.append(m)
        return sorted(kept, key=lambda m: m[3])

    def scan_rows(self, data: np.ndarray, offs: np.ndarray, exhaustive: bool = False) -> tuple[np.ndarray, list[dict[int, tuple[int, int]]]]:
        """Words of each row; for each row template -> (percent of its shingles, first shingle of the best window).

        ``exhaustive`` verifies every window against every template instead of retrieving by bands (for tests).
        """
        h, bounds, n_words = shingles(data, offs)
        out: list[dict[int, tuple[int, int]]] = [{} for _ in range(len(offs) - 1)]
        if not len(h):
            return n_words, out
        size = np.diff(bounds)
        matches: dict[int, list[tuple]] = {}
        for c in self.classes:
            blocks = -(-size // c.step)
            row = np.repeat(np.arange(len(size)), blocks)
            edge = np.concatenate([[0], np.cumsum(blocks)])
            number = np.arange(len(row)) - edge[row]
            starts = bounds[row] + number * c.step
            pairs = np.array([(w, t) for w in range(len(row)) for t in range(len(c.templates))]) if exhaustive else c.retrieve(h, starts, edge[row + 1] - 1)
            for w, t in pairs.tolist():
                d = int(row[w])
                a = int(starts[w])
                b = min(a + 3 * c.step, int(bounds[d + 1]))
                which, s = c.templates[t]
                if got := self.verify(which, s, h, a, b):
                    pct, held, at = got
                    matches.setdefault(d, []).append((held, pct, which, a, at))
        for d, ms in matches.items():
            for _, pct, which, a, _ in self.best(ms):
                if out[d].get(which, (-1, 0))[0] < pct:
                    out[d][which] = (pct, a - int(bounds[d]))
        return n_words, out
        size = np.diff(bounds)
        matches: dict[int, list[tuple]] = {}
        for c in self.classes:
            blocks = -(-size // c.step)
            row = np.repeat(np.arange(len(size)), blocks)
            edge = np.concatenate([[0], np.cumsum(blocks)])
            number = np.arange(len(row)) - edge[row]
            starts = bounds[row] + number * c.step
            pairs = np.array([(w, t) for w in range(len(row)) for t in range(len(c.templates))]) if exhaustive else c.retrieve(h, starts, edge[row + 1] - 1)
            for w, t in pairs.tolist():
                d = int(row[w])
                a = int(starts[w])
                b = min(a + 3 * c.step, int(bounds[d + 1]))
                which, s = c.templates[t]
                pct = 100 * int(np.isin(s, h[a:b]).sum()) // len(s)
                if pct >= self.min_pct and out[d].get(which, (-1, 0))[0] < pct:
                    out[d][which] = (pct, a - int(bounds[d]))
        return n_words, out


MATCH = pa.struct([("license", pa.string()), ("template", pa.int32()), ("percent", pa.int32()), ("first_word", pa.int64())])


def find_licenses(docs: DataFrame, templates: Sequence[tuple] = TEMPLATES, id_col: str = "doc_id", text_col: str = "text",
                  min_pct: int = 80, rows: int = 1, sure: float = 0.9999) -> DataFrame:
    """id, n_words, matches (license, template, percent of its shingles, first word of the window) of each document."""
    src = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates, min_pct, rows, sure)
        for batch in batches:
            for a, b, data, offs in scan.pieces(batch.column(1)):
                n, found = scanner.scan_rows(data, offs)
                listed = [[{"license": scanner.names[t], "template": t, "percent": p, "first_word": w} for t, (p, w) in sorted(f.items())] for f in found]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(n, pa.int64()), pa.array(listed, pa.list_(MATCH))], ["id", "n_words", "matches"])

    return src.mapInArrow(run, f"id {dict(src.dtypes)['id']}, n_words long, matches array<struct<license: string, template: int, percent: int, first_word: long>>")
