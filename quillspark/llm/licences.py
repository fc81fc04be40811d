"""License scan: a trained paragraph classifier with template comparison.

Paragraphs (runs of lines with words) are described by the word one- to three-grams of their lines and of windows over
them. A sparse multinomial logistic regression, trained on templates and their perturbed copies against ordinary
paragraphs, names the licence family or none; temperature scaling on held-out perturbations calibrates it, and what stays
below ``least`` is unknown. A prediction is confirmed when the passage and a template of that family contain one
another's words. Paragraphs are looked through by windows of 2 to 64 words at every word, across their line breaks, but
for lines that hold a whole template; so notices that are wrapped over lines count as one.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytegrams import LOWER, Hashes, mix, utf8, words
from .common import slices, texts

BITS = 16
#: Families, their SPDX identifiers and the names under which notices speak of them.
NAMES = [
    ("apache-2.0", ["Apache-2.0"], ["Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 License"]),
    ("bsd", [], ["BSD License", "BSD-style License"]),
    ("bsd-2-clause", ["BSD-2-Clause"], ["BSD 2-Clause License", "BSD 2-Clause", "Simplified BSD License"]),
    ("bsd-3-clause", ["BSD-3-Clause"], ["BSD 3-Clause License", "BSD 3-Clause", "New BSD License", "Modified BSD License"]),
    ("cc-by-4.0", ["CC-BY-4.0"], ["CC BY 4.0", "Creative Commons Attribution 4.0 International License"]),
    ("cc-by-nc-4.0", ["CC-BY-NC-4.0"], ["CC BY-NC 4.0", "Creative Commons Attribution-NonCommercial 4.0 International License"]),
    ("cc-by-nd-4.0", ["CC-BY-ND-4.0"], ["CC BY-ND 4.0", "Creative Commons Attribution-NoDerivatives 4.0 International License"]),
    ("cc-by-sa-4.0", ["CC-BY-SA-4.0"], ["CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike 4.0 International License"]),
    ("cc-by-nc-sa-4.0", ["CC-BY-NC-SA-4.0"], ["CC BY-NC-SA 4.0", "Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License"]),
    ("cc0-1.0", ["CC0-1.0"], ["CC0 1.0", "CC0 1.0 Universal"]),
    ("eupl-1.2", ["EUPL-1.2"], ["European Union Public License, version 1.2", "EUPL v1.2"]),
    ("gpl", [], ["GNU General Public License", "GNU GPL"]),
    ("gpl-2.0", ["GPL-2.0", "GPL-2.0-only", "GPL-2.0-or-later"], ["GNU General Public License, version 2", "GNU General Public License v2.0", "GPL v2", "GNU GPL v2"]),
    ("gpl-3.0", ["GPL-3.0", "GPL-3.0-only", "GPL-3.0-or-later"], ["GNU General Public License, version 3", "GNU General Public License v3.0", "GPL v3", "GNU GPL v3"]),
    ("lgpl", [], ["GNU Lesser General Public License", "GNU LGPL"]),
    ("lgpl-2.1", ["LGPL-2.1", "LGPL-2.1-only", "LGPL-2.1-or-later"], ["GNU Lesser General Public License, version 2.1", "GNU Lesser General Public License v2.1", "LGPL v2.1", "GNU LGPL v2.1"]),
    ("lgpl-3.0", ["LGPL-3.0", "LGPL-3.0-only", "LGPL-3.0-or-later"], ["GNU Lesser General Public License, version 3", "GNU Lesser General Public License v3.0", "LGPL v3", "GNU LGPL v3"]),
    ("agpl-3.0", ["AGPL-3.0", "AGPL-3.0-only", "AGPL-3.0-or-later"], ["GNU Affero General Public License, version 3", "GNU Affero General Public License v3.0", "AGPL v3", "GNU AGPL v3"]),
    ("isc", ["ISC"], ["ISC License"]),
    ("mit", ["MIT"], ["MIT License"]),
    ("mpl-2.0", ["MPL-2.0"], ["Mozilla Public License, v. 2.0", "Mozilla Public License 2.0"]),
    ("unlicense", ["Unlicense"], ["Unlicense"]),
]
FAMILIES = ["none"] + [family for family, *_ in NAMES] + ["unknown"]
#: Families that few words tell apart are one to the model; those words decide within. The first of bsd, gpl and lgpl
#: stands for sentences and names that all of them share.
GROUPS = [["bsd", "bsd-2-clause", "bsd-3-clause"], ["cc-by-4.0", "cc-by-nc-4.0", "cc-by-nd-4.0", "cc-by-sa-4.0", "cc-by-nc-sa-4.0"], ["gpl", "gpl-2.0", "gpl-3.0", "lgpl", "lgpl-2.1", "lgpl-3.0", "agpl-3.0"]]
SHARED = {"bsd": ["bsd-2-clause", "bsd-3-clause"], "gpl": ["gpl-2.0", "gpl-3.0"], "lgpl": ["lgpl-2.1", "lgpl-3.0"]}
#: What stands for a shared family in ``licences``, where it is not its own name.
REPORTED = {"bsd": "bsd-3-clause"}
#: Customary notices and opening sentences of public licences.
SENTENCES = [
    ("apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.'),
    ("apache-2.0", "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("apache-2.0", 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.'),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("bsd", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."),
    ("bsd-3-clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("cc0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("gpl-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("gpl-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("lgpl-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("lgpl-3.0", "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("agpl-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("mit", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction.'),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("unlicense", "This is free and unencumbered software released into the public domain."),
]
#: Wordings in which a name becomes a notice.
FRAMES = ["Licensed under the {}.", "Released under the {}.", "This work is licensed under the {}.", "This project is licensed under the {}.", "License: {}"]
WHOLE = SENTENCES + [(family, f"SPDX-License-Identifier: {i}") for family, ids, _ in NAMES for i in ids]
LABELLED = WHOLE + [(family, frame.format(name)) for family, _, names in NAMES for name in names for frame in FRAMES]
#: Texts with the family that a scan reports for them.
TEMPLATES = [(REPORTED.get(family, family), text) for family, text in LABELLED]
#: Sentences that sound near a licence and are none.
OTHERS = [
    "The driver must hold a valid license.", "All rights reserved.", "Copyright 2021 the authors.", "Please read the terms and conditions of this store.", "The general public is invited to the opening of the software foundation.",
    "You may obtain a copy of the report at the desk.", "The version of this work that was released last year is out of print.", "This program is shown on the third channel.", "A licence to fish is sold in the village.", "Mit.", "Mit", "mit der", "isc", "is free", "MIT", "The MIT campus is open to visitors.", "Apache helicopters were seen over the bay.",
]
#: Wordings of licences that belong to no family.
UNKNOWN = ["Licensed under the {name} License, version {n}.", "Released under the {name} License.", "This work is licensed under the {name} Public License, version {n}.", "SPDX-License-Identifier: {name}-{n}.0", "This project is licensed under the {name} License.", "The {name} Public Licence v{n} applies to this work."]
SYLLABLES = ["ba", "cor", "del", "fi", "gam", "hul", "kin", "lo", "mer", "nov", "par", "qui", "ros", "sel", "tur", "vex"]
#: Words of the windows in which long lines are looked through.
WINDOWS = [2, 3, 5, 7, 10, 14, 20, 28, 40, 64]
PUNCTUATION = np.isin(np.arange(256), list(b".,;:()[]\"'`*#!?<>"))


def grams(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, ...]:
    """Lines with words: feature bucket of every word n-gram (n = 1, 2, 3) within a paragraph, its line (-1: more than
    one), and each line's first and last byte; then each n-gram's first word and n, and each word's line, paragraph, first
    and last byte."""
    clean = LOWER[data]
    clean[PUNCTUATION[clean]] = 32
    # Marks of a comment (//, /*) are no words.
    edge = np.concatenate([[True], (clean == 47) | (clean <= 32), [True]])
    clean[(clean == 47) & (edge[:-2] | edge[2:])] = 32
    breaks = np.flatnonzero(data == 10)
    lines = np.unique(np.concatenate([off[:-1], breaks + 1]))
    lines = lines[lines < len(data)] if len(data) else lines[:0]
    bounds = np.append(lines, len(data))
    s, e, first = words(clean, bounds)
    n = np.diff(first)
    kept = np.flatnonzero(n)
    line = np.repeat(np.cumsum(n > 0) - 1, n)
    opens = np.isin(lines, off[:-1]) | (np.concatenate([[0], n])[: len(n)] == 0)  # after a blank line
    paragraph = np.repeat(np.cumsum(opens), n)
    h = Hashes(clean).of(s, e)
    feats, owner, place = [h], [line], [np.arange(len(h))]
    for k in (2, 3):
        m = max(0, len(h) - k + 1)
        same = paragraph[:m] == paragraph[k - 1 :] if m else np.zeros(0, bool)
        g = h[:m].copy()
        for i in range(1, k):
            g = g * np.uint64(0x9E3779B97F4A7C15) + h[i : m + i]
        feats.append(mix(g[same]))
        owner.append(np.where(line[:m] == line[k - 1 :], line[:m], -1)[same] if m else line[:0])
        place.append(np.flatnonzero(same))
    width = np.repeat([1, 2, 3], [len(x) for x in place])
    f = (np.concatenate(feats) >> np.uint64(64 - BITS)).astype(np.int64)
    return f, np.concatenate(owner), bounds[kept], bounds[kept + 1], np.concatenate(place), width, line, paragraph, s, e


def plain(text: str) -> str:
    """Lower-cased words with one space around each; British spelling and forms of a version number (v. 3.0) are one."""
    text = re.sub(r"[^a-z0-9.\-]+", " ", text.lower().replace("licence", "license"))
    return " " + " ".join(re.sub(r"^v?(\d+(?:\.\d+)*?)(?:\.0)*$", r"\1", w) for w in (x.strip(".") for x in text.split()) if w.strip("-") and w not in ("v", "version")) + " "


def word_set(text: str) -> frozenset:
    return frozenset(plain(text).split())


#: Wordings that tell families of one group apart, and what each of them says.
TELLING = {
    "lesser": "lesser", "lgpl": "lesser", "library general": "lesser", "affero": "affero", "agpl": "affero",
    "noncommercial": "nc", "nc": "nc", "noderivatives": "nd", "nd": "nd", "sharealike": "sa", "sa": "sa",
    "2-clause": "2-clause", "simplified bsd": "2-clause", "3-clause": "3-clause", "new bsd": "3-clause", "modified bsd": "3-clause", "4-clause": "4-clause",
}
TOLD = re.compile(r"(?<=[ \-])(" + "|".join(sorted(TELLING, key=len, reverse=True)) + r")(?=[ \-])")
#: A version number counts after a word of a licence's name only.
VERSION = re.compile(r" (?:license|[al]?gpl|either|by(?:-[a-z]+)*|cc0|eupl|apache|attribution(?:-[a-z]+)*) (\d+(?:\.\d+)*)(?= )")


def marks(text: str) -> frozenset:
    """What of a passage tells families of one group apart: kind, clauses, restrictions, versions."""
    text = plain(text)
    return frozenset({TELLING[x] for x in TOLD.findall(text)} | set(VERSION.findall(text)))


class LicenceModel:
    """Sparse softmax regression: features without weight cost nothing and most paragraphs have only those."""

    def __init__(self, seed: int = 5, rounds: int = 300, l1: float = 5e-5):
        r = np.random.default_rng(seed)
        rows, labels = [], []
        for family, text in LABELLED:
            w = text.split()
            for i in range(64 if (family, text) in WHOLE else 16):  # names come in many frames, sentences and identifiers once
                keep = [x for x in w if i % 2 == 0 or r.random() > 0.05]
                if i % 4 == 3:
                    keep = [x.replace("icense", "icence") for x in keep]
                pre = ["".join(r.choice(SYLLABLES, r.integers(1, 4))) for _ in range(r.integers(0, 4))] if i > 8 else []
                rows.append(" ".join(pre + keep))
                labels.append(FAMILIES.index(family))
        for i in range(240):  # licences of names that no family has
            name = " ".join("".join(r.choice(SYLLABLES, r.integers(2, 4))).title() for _ in range(r.integers(1, 3)))
            rows.append(UNKNOWN[i % len(UNKNOWN)].format(name=name, n=r.integers(1, 10)))
            labels.append(len(FAMILIES) - 1)
        pool = [w for t in OTHERS for w in t.split()] + ["license", "licensed", "under", "the", "version", "this", "work", "is", "free", "software", "public", "general", "released", "project", "distributed", "international", "2.0", "3", *TELLING]
        for text in OTHERS:
            rows += [text] * 6
            labels += [0] * 6
        for _ in range(800):
            rows.append(" ".join(r.choice(pool, r.integers(2, 14))))
            labels.append(0)
        counted = Counter(zip(rows, labels, strict=True))  # copies weigh, and lie on one side of the split
        rows, y = [t for t, _ in counted], np.array([k for _, k in counted])
        weight = np.array(list(counted.values()), np.float32)[:, None]
        held = r.random(len(rows)) < 0.2
        f, line, *_ = grams(*utf8(pa.array(rows, pa.string())))
        names = np.unique(f)
        col = np.searchsorted(names, f)
        x = np.zeros((len(rows), len(names)), np.float32)
        x[line, col] = 1
        x /= np.sqrt(np.maximum(1, x.sum(axis=1, keepdims=True)))
        w, b = np.zeros((len(names), len(FAMILIES)), np.float32), np.zeros(len(FAMILIES), np.float32)
        b[0] = 1.0
        xt, yt, wt = x[~held], np.eye(len(FAMILIES), dtype=np.float32)[y[~held]], weight[~held] / weight[~held].sum()
        for _ in range(rounds):  # proximal gradient: the l1 step keeps the weights sparse
            error = (self._softmax(xt @ w + b) - yt) * wt
            w -= 4.0 * (xt.T @ error)
            b -= 4.0 * error.sum(axis=0)
            w = np.sign(w) * np.maximum(0, np.abs(w) - 4.0 * l1)
        used = np.abs(w).sum(axis=1) > 0
        self.column = np.full(1 << BITS, -1, np.int32)  # of a bucket's weights; -1: none
        self.column[names[used]] = np.arange(used.sum())
        self.weights, self.bias = w[used].astype(np.float32), b
        logits, at = x[held] @ w + b, y[held]
        loss = [-np.log(self._softmax(logits / t)[np.arange(len(at)), at] + 1e-12).mean() for t in np.geomspace(0.1, 4, 40)]
        self.temperature = float(np.geomspace(0.1, 4, 40)[int(np.argmin(loss))])
        self.templates: dict[int, list[tuple[frozenset, frozenset]]] = {}
        self.names: dict[int, list[tuple[str, frozenset]]] = {}
        self.marks: dict[int, frozenset] = {}
        self.words: dict[int, frozenset] = {}
        for family, text in LABELLED:
            k = FAMILIES.index(family)
            self.marks[k] = self.marks.get(k, frozenset()) | marks(text)
            self.words[k] = self.words.get(k, frozenset()) | word_set(text)
        for family, text in WHOLE:
            self.templates.setdefault(FAMILIES.index(family), []).append((word_set(text), marks(text)))
        for family, _, names in NAMES:
            self.names[FAMILIES.index(family)] = [(plain(x), marks(x)) for x in names]
        groups = [sorted(FAMILIES.index(x) for x in g) for g in GROUPS]
        self.group = {k: next((g for g in groups if k in g), [k]) for k in range(len(FAMILIES))}
        #: Adds up the probabilities of a family's group.
        self.together = np.array([[float(k in self.group[i]) for i in range(len(FAMILIES))] for k in range(len(FAMILIES))])

    @staticmethod
    def _softmax(z: np.ndarray) -> np.ndarray:
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)

    def paragraphs(self, data: np.ndarray, off: np.ndarray, least: float) -> list[tuple[int, int, float, bool]]:
        """Lines and passages in which the model sees a licence: first byte, best family, its probability, and whether
        that is ``least`` at least and confirmed."""
        f, line, lo, hi, place, width, line_of, paragraph, s, e = grams(data, off)
        total = np.bincount(line[line >= 0], minlength=len(lo))
        f = self.column[f].astype(np.int64)
        known = f >= 0
        f, line, place, width = f[known], line[known], place[known], width[known]
        # A line in which fewer than a fifth of the n-grams are known is no licence as a whole.
        rich = np.bincount(line[line >= 0], minlength=len(lo)) * 5 >= np.maximum(1, total)
        pick = (line >= 0) & rich[line]
        names, at = np.unique(line[pick], return_inverse=True)
        yes, best, share = self._judged(at, f[pick], total[names])
        names, best, share = names[yes], best[yes], share[yes]
        text = lambda x, y: data[x:y].tobytes().decode("utf-8", "replace")
        own, whole, closed = [], np.zeros(len(lo), bool), np.zeros(len(lo), bool)
        for i, x, y, k, p in zip(names.tolist(), lo[names].tolist(), hi[names].tolist(), best.tolist(), share.tolist(), strict=True):
            member = self.confirmed(text(x, y), k) if p >= least else None
            sure = member is not None
            own.append((i, x, member if sure else k, p, sure))
            whole[i] = sure and not self.names_others(text(x, y), member)
            closed[i] = sure and FAMILIES[member] not in SHARED and self.confirmed(text(x, y), k, entire=True) is not None
        parts = self._passages(text, f, place, width, whole, closed, line_of, paragraph, s, e, least)
        # A line gives way to a confirmed passage over several lines, an unknown one also to a passage within it; else it
        # counts once.
        wrapped, better, seen = set(), set(), set(names.tolist())
        for a, b, _, _, sure in parts:
            if line_of[a] != line_of[b - 1]:
                wrapped.update(range(line_of[a], line_of[b - 1] + 1))
            elif sure:
                better.add(int(line_of[a]))
        out = [(x, k, p, sure) for i, x, k, p, sure in own if i not in wrapped and (sure or i not in better)]
        return out + [(int(s[a]), k, p, sure) for a, _, k, p, sure in parts if sure or (int(line_of[a]) not in seen and int(line_of[a]) not in wrapped)]

    def _judged(self, at: np.ndarray, f: np.ndarray, total: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For paragraphs 0, 1, ... with known features ``f`` (each in paragraph ``at``) of ``total``: whether the model
        sees a licence, the best family, the probability of its group."""
        once = np.unique(at.astype(np.int64) << BITS | f)
        at, f = once >> BITS, once & ((1 << BITS) - 1)
        z = np.zeros((len(total), len(FAMILIES)))
        new = np.flatnonzero(np.diff(at, prepend=-1))
        if len(new):
            z[at[new]] = np.add.reduceat(self.weights[f].astype(float), new, axis=0)
        z = z / np.sqrt(np.maximum(1, total))[:, None] + self.bias
        p = self._softmax(z / self.temperature)
        shares = p @ self.together
        # Of the likeliest group the likeliest family.
        best = (shares[:, 1:] + 1e-6 * p[:, 1:]).argmax(axis=1) + 1 if len(p) else np.zeros(0, int)
        return p[:, 0] < 0.5, best, np.minimum(1.0, shares[np.arange(len(p)), best])

    def _passages(self, text, f, place, width, whole, closed, line_of, paragraph, s, e, least: float) -> list[tuple[int, int, int, float, bool]]:
        """Passages (first word, word after the last, family, probability, sure) within lines that are no confirmed
        licence as a whole and over lines that hold no whole template: of overlapping windows the confirmed, then those of one family alone, then
        the likeliest."""
        n = len(s)
        column = np.full((3, n), -1, np.int64)
        column[width - 1, place] = f
        # No family gains more over none than the sum of each n-gram's best gain: most windows end at that bound.
        gain = np.maximum(0, self.weights[:, 1:].max(axis=1) - self.weights[:, 0])
        sums = np.concatenate([np.zeros((3, 1)), np.cumsum(np.where(column >= 0, gain[column], 0), axis=1)], axis=1)
        need = self.bias[0] - self.bias[1:].max() - self.temperature * np.log(len(FAMILIES) - 1) - 1e-3
        found = []
        for w in WINDOWS:
            m = n - w + 1
            if m <= 0:
                continue
            size = sum(max(0, w - k) for k in range(3))
            most = sum(sums[k, w - k : w - k + m] - sums[k, :m] for k in range(min(3, w)))
            first = np.flatnonzero(most >= need * np.sqrt(size))
            last = first + w - 1
            one = line_of[first] == line_of[last]
            shut = np.concatenate([[0], np.cumsum(closed[line_of])])
            first = first[np.where(one, ~whole[line_of[first]], (paragraph[first] == paragraph[last]) & (shut[last + 1] == shut[first]))]
            for x in range(0, len(first), 8192):
                part = first[x : x + 8192]
                cells = np.concatenate([column[k][part[:, None] + np.arange(w - k)] for k in range(min(3, w))], axis=1)
                at, c = np.nonzero(cells >= 0)
                yes, best, share = self._judged(at, cells[at, c], np.full(len(part), size))
                found += [(a, a + w, k, p) for a, k, p in zip(part[yes].tolist(), best[yes].tolist(), share[yes].tolist(), strict=True)]
        judged, covered = [], {}
        for a, b, k, p in found:
            one = line_of[a] == line_of[b - 1]
            member = self.confirmed(text(s[a], e[b - 1]), k, part=one, entire=not one) if p >= least else None
            if member is not None and FAMILIES[member] in SHARED:  # a name that is cut before its version is not shared
                end = min(n, b + 2)
                while line_of[end - 1] != line_of[b - 1]:
                    end -= 1
                if not marks(text(s[a], e[end - 1])) <= self.marks[member]:
                    member = None
            sure, k = member is not None, k if member is None else member  # noqa: PLW2901
            mixed = sure and self.names_others(text(s[a], e[b - 1]), k)
            if sure and not mixed:
                covered.setdefault(k, np.zeros(n, bool))[a:b] = True
            # A few words of a licence's vocabulary in a line of prose are a notice only if confirmed or worded as one.
            if sure or (one and k == len(FAMILIES) - 1 and b - a >= 5 and p >= least):
                judged.append((not sure, mixed, FAMILIES[k] in SHARED, -p, b - a, a, b, k))
        taken, out = np.zeros(n, bool), []
        for unsure, _, _, p, _, a, b, k in sorted(judged):
            if not taken[a:b].any():
                lo, hi = a, b
                if not unsure:  # the notice goes on as far as the words of its templates do, but not into another notice
                    near = self.words[k]
                    others = [c for x, c in covered.items() if x not in self.group[k]]
                    while lo and not any(c[lo - 1] for c in others) and paragraph[lo - 1] == paragraph[a] and word_set(text(s[lo - 1], e[lo - 1])) <= near:
                        lo -= 1
                    while hi < n and not any(c[hi] for c in others) and paragraph[hi] == paragraph[a] and word_set(text(s[hi], e[hi])) <= near:
                        hi += 1
                taken[lo:hi] = True
                out.append((a, b, k, -p, not unsure))
        return out

    def confirmed(self, text: str, family: int, least: float = 0.8, part: bool = False, entire: bool = False) -> int | None:
        """The family of ``family``'s group that the passage is a notice of, itself first; null if it is of none.

        The passage must hold one of the family's names, or most words of a template, or, unless ``entire``, a template most
        of its words (a ``part`` of a line, of eight words at least). What tells families apart must agree: all that the template
        says of it, and nothing that no template of the family says."""
        own, line, said = word_set(text), plain(text), marks(text)
        for k in [family] + [x for x in self.group[family] if x != family]:
            if k not in self.words or not said <= self.marks[k]:
                continue
            if any(m <= said and name in line for name, m in self.names[k]):
                return k
            for t, m in self.templates.get(k, []):
                if m <= said and (len(own & t) >= least * len(t) or (not entire and len(own) >= (8 if part else 4) and len(own & t) >= 0.9 * len(own))):
                    return k
        return None

    def names_others(self, text: str, family: int) -> bool:
        """Whether the passage holds a name of a family of another group."""
        line = plain(text)
        return any(name in line for k, names in self.names.items() if k not in self.group[family] for name, _ in names)


@cache
def model() -> LicenceModel:
    return LicenceModel()


def licence_scan(docs: DataFrame, least: float = 0.6) -> DataFrame:
    """One row per document: doc_id, licences (families found, in alphabetical order), possible (families that a shared
    sentence or a name without version leaves open), n_paragraphs (licence paragraphs), n_unknown (those below ``least``
    or not confirmed), best_share (highest probability of a group of families, 0 for none).

    Words that families share are reported as gpl, lgpl or (clauses of both BSD licences) bsd-3-clause, with what they
    leave open in ``possible``; beside a family of that set they add nothing.

    A paragraph below ``least``, or whose family no template confirms, counts as "unknown", as does one that the model takes for a licence of
    no family. A null, empty or blank
    text has no paragraphs. Repeated rows get equal results; an empty table gives no rows; other columns are ignored.
    """

    m = model()  # trained here; a few hundred kilobytes travel with the function

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            data, off = utf8(b.column("text"))
            found: list[set] = [set() for _ in range(b.num_rows)]
            n, unknown, top = np.zeros(b.num_rows, np.int64), np.zeros(b.num_rows, np.int64), np.zeros(b.num_rows)
            for lo, family, share, sure in m.paragraphs(data, off, least):
                d = int(np.searchsorted(off, lo, side="right")) - 1
                found[d].add(FAMILIES[family] if sure else "unknown")
                n[d] += 1
                unknown[d] += not sure
                top[d] = max(top[d], share)
            possible = []
            for x in found:  # a sentence that families share says nothing beside one of them
                x -= {shared for shared, members in SHARED.items() if x.intersection(members)}
                possible.append(sorted({k for shared in x & set(SHARED) for k in SHARED[shared]}))
            licences = [sorted(REPORTED.get(k, k) for k in x) for x in found]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(x, pa.list_(pa.string())) for x in (licences, possible)), pa.array(n), pa.array(unknown), pa.array(top)], ["doc_id", "licences", "possible", "n_paragraphs", "n_unknown", "best_share"])

    return texts(docs).mapInArrow(run, "doc_id long, licences array<string>, possible array<string>, n_paragraphs long, n_unknown long, best_share double").withColumn("best_share", F.round("best_share", 6))
