"""Licence notices in paragraphs: sparse n-gram logistic regression, a calibrated unknown class, template comparison."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scholion.llm.workers import lean

# Notices of well-known licences by family.
TEMPLATES = {
    "MIT": ["Released under the MIT License.", "Licensed under the MIT license.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the software without restriction."],
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0.", "You may not use this file except in compliance with the Apache License, Version 2.0.", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an as is basis, without warranties or conditions of any kind."],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3.", "This program is free software: you can redistribute it and modify it under the terms of the GNU General Public License as published by the Free Software Foundation, version 3."],
    "GPL-2.0": ["This work is licensed under the GNU General Public License, version 2.", "You can redistribute it under the terms of the GNU General Public License as published by the Free Software Foundation, version 2."],
    "LGPL": ["This library is licensed under the GNU Lesser General Public License.", "You can redistribute it under the terms of the GNU Lesser General Public License."],
    "BSD": ["Released under the BSD 3-Clause License.", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met."],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC0-1.0": ["Dedicated to the public domain under CC0 1.0 Universal."],
    "Unlicense": ["This is free and unencumbered software released into the public domain."],
}
UNKNOWN = "unknown"
TOKEN = re.compile(r"[a-z0-9]+(?:[.-][a-z0-9]+)*").findall


def grams(paragraph: str) -> set[str]:
    """Distinct words and word pairs of a paragraph."""
    words = TOKEN(paragraph.lower())
    return {*words, *map(" ".join, zip(words, words[1:], strict=False))}


@dataclass
class LicenseModel:
    weights: dict[str, np.ndarray]  # by n-gram, a weight for each class
    bias: np.ndarray
    classes: list[str]
    temperature: float

    def chances(self, found: set[str]) -> np.ndarray:
        z = self.bias.copy()
        for g in sorted(found):
            z += self.weights[g]
        z = z / self.temperature
        e = np.exp(z - z.max())
        return e / e.sum()


def _template_grams() -> dict[str, list[set[str]]]:
    return {family: [grams(t) for t in texts] for family, texts in TEMPLATES.items()}


def template_match(paragraph: set[str], family: list[set[str]]) -> float:
    """The largest share of a template's n-grams that the paragraph holds."""
    return max(len(t & paragraph) / len(t) for t in family)


def fit_licenses(docs: DataFrame, negatives: int = 3000, steps: int = 300, penalty: float = 0.02, text_col: str = "text") -> LicenseModel:
    """Fit on the templates, on parts and extensions of them, and on a bounded sample of the corpus's paragraphs.

    The sample has about ``negatives`` texts, those with the smallest hashes; their paragraphs that resemble no template
    are the unknown class. A fifth of the data is held back to set the temperature that calibrates the chances.
    """
    total = max(1, docs.count())
    rank = F.pmod(F.xxhash64(F.lit(3), text_col), F.lit(1 << 30))
    rows = docs.where(rank < F.lit(float(1 << 30) * min(1.0, negatives / total))).select(F.explode(F.split(text_col, "\n")).alias("p"))
    rows = rows.where("length(p) between 4 and 2000").orderBy(F.xxhash64("p"), "p").limit(negatives)
    families = _template_grams()
    known = frozenset().union(*(t for f in families.values() for t in f))
    classes = [*families, UNKNOWN]
    data: list[tuple[set[str], int]] = []
    for r in rows.collect():
        found = grams(r.p)
        if max(template_match(found, f) for f in families.values()) < 0.4:
            data.append((found & known, len(classes) - 1))
    for k, family in enumerate(TEMPLATES):
        for text in TEMPLATES[family]:
            words = text.split()
            for cut in range(8):  # the whole notice, and the notice without each eighth word, counted from ``cut``
                kept = words if not cut else [w for i, w in enumerate(words) if i % 8 != cut]
                data += [(grams(" ".join(kept)) & known, k), (grams("Notice: " + " ".join(kept)) & known, k)]
    # single words of the notices, as ordinary text has them, tell nothing
    data += [({g}, len(classes) - 1) for g in sorted(known) if " " not in g for _ in range(2)]
    index = {g: i for i, g in enumerate(sorted(known))}
    y = np.array([c for _, c in data])
    at = np.array([k for k, (f, _) in enumerate(data) for _ in f], np.int64)
    col = np.array([index[g] for f, _ in data for g in sorted(f)], np.int64)
    held = np.arange(len(data)) % 5 == 4
    sizes = np.bincount(y[~held], minlength=len(classes))
    share = np.where(held, 0.0, 1.0 / np.sqrt(np.maximum(sizes[y], 1)))
    share /= share.sum()
    w, bias = np.zeros((len(index), len(classes))), np.zeros(len(classes))

    def logits() -> np.ndarray:
        z = np.zeros((len(data), len(classes)))
        np.add.at(z, at, w[col])
        return z + bias

    for _ in range(steps):
        z = logits()
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        p[np.arange(len(y)), y] -= 1
        p *= share[:, None]
        g = np.zeros_like(w)
        np.add.at(g, col, p[at])
        w -= 4.0 * (g + penalty * w / len(data))
        bias -= 4.0 * p.sum(axis=0)
    z = logits()[held]

    def loss(t: float) -> float:
        s = z / t - (z / t).max(axis=1, keepdims=True)
        return float(-(s[np.arange(len(z)), y[held]] - np.log(np.exp(s).sum(axis=1))).mean())

    temperature = min(np.geomspace(0.25, 4.0, 33), key=loss)
    return LicenseModel({g: w[i] for g, i in index.items()}, bias, classes, float(temperature))


def _windows(lines: list[list[str]], template: set[str], match: float) -> Iterator[tuple[int, int, set[int]]]:
    """(first line, last line, places of the words in template pairs) of runs of lines that hold ``match`` of a template.

    The shortest runs, lengthened by lines that bring further word pairs of the template. Lines between the first and
    the last hold no more than twice the template's words together, so that words far apart make no notice.
    """
    room = 2 * sum(" " not in g for g in template)
    starts = np.cumsum([0, *map(len, lines)]).tolist()
    words, line_of = [w for line in lines for w in line], [k for k, line in enumerate(lines) for _ in line]
    ends: list[list[tuple[int, str]]] = [[] for _ in lines]  # by line of the last word: line of the first word, n-gram
    begins: list[list[tuple[int, str]]] = [[] for _ in lines]
    for i, w in enumerate(words):
        for g, j in ((w, i), (f"{words[i - 1]} {w}" if i else "", i - 1)):
            if g in template:
                ends[line_of[i]].append((line_of[j], g))
                begins[line_of[j]].append((line_of[i], g))
    lo, held = 0, Counter()

    def drop(hi: int) -> None:
        nonlocal lo
        held.subtract(g for k, g in begins[lo] if k <= hi)
        for _, g in begins[lo]:
            if held[g] <= 0:
                del held[g]
        lo += 1

    for hi in range(len(lines)):
        held.update(g for k, g in ends[hi] if k >= lo)
        while lo < hi and starts[hi] - starts[lo + 1] > room:
            drop(hi)
        if len(held) / len(template) < match:
            continue
        while lo < hi and len(held.keys() - {g for g, n in Counter(g for k, g in begins[lo] if k <= hi).items() if n == held[g]}) / len(template) >= match:
            drop(hi)
        a, b, have = lo, hi, set(held)
        while b + 1 < len(lines) and (more := {g for k, g in ends[b + 1] if k >= a and " " in g} - have):
            b, have = b + 1, have | more
        while a and (more := {g for k, g in begins[a - 1] if k <= b and " " in g} - have):
            a, have = a - 1, have | more
        at = [i for i in range(starts[a] + 1, starts[b + 1]) if f"{words[i - 1]} {words[i]}" in template]
        yield a, b, {*at, *(i - 1 for i in at)}
        held.clear()
        lo = hi + 1


def _evidence(words: list[str], places: Iterable[int]) -> set[str]:
    """Words at the places, and pairs of words at places that follow each other."""
    own = set(places)
    return {*(words[i] for i in own), *(f"{words[i]} {words[i + 1]}" for i in own if i + 1 in own)}


def find_notices(lines: list[list[str]], model: LicenseModel, families: dict[str, list[set[str]]], chance: float, match: float) -> list[tuple[str, int, int]]:
    """(family, first line, last line) of the notices in a paragraph, given as the words of its lines.

    Each family whose template a run of lines holds is judged for itself. Words that belong to the notice of another
    family are left out, unless the two lie on the same words (versions of one licence): those compete, and the line
    that follows is heard too.
    """
    found = [[family, a, b, at] for family, texts in families.items() for t in texts for a, b, at in _windows(lines, t, match)]
    merged: list[list] = []
    for family, a, b, at in sorted(found, key=lambda x: x[:3]):
        if merged and merged[-1][0] == family and a <= merged[-1][2]:
            merged[-1][2], merged[-1][3] = max(b, merged[-1][2]), merged[-1][3] | at
        else:
            merged.append([family, a, b, at])
    words, starts = [w for line in lines for w in line], np.cumsum([0, *map(len, lines)]).tolist()
    keys, out = model.weights.keys(), []
    for family, a, b, at in merged:
        others = [x for x in merged if x[0] != family and x[1] <= b + 1 and a <= x[2]]
        rivals = [x for x in others if len(x[3] & at) > 0.75 * min(len(x[3]), len(at))]
        lo, hi = min([a, *(x[1] for x in rivals)]), max([b, *(x[2] for x in rivals)])
        hi = min(hi + 1, len(lines) - 1) if rivals else hi
        foreign = set().union(*(x[3] for x in others if x not in rivals)) - at
        p = model.chances(_evidence(words, set(range(starts[lo], starts[hi + 1])) - foreign) & keys)
        if p[model.classes.index(family)] >= chance:
            out.append((family, a, b))
    return sorted(out, key=lambda x: (x[1], x[2], x[0]))


def scan_licenses(docs: DataFrame, model: LicenseModel, chance: float = 0.5, match: float = 0.7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_notices, licenses, spans) of each whole text; paragraphs are runs of lines with a word or number.

    A run of a paragraph's lines is a notice of each family that the classifier gives ``chance`` or more, with unknown
    as a class of its own, if it also holds ``match`` of the n-grams of one of the family's templates; so a notice may
    be wrapped over lines, and a line may name several licences. licenses: distinct families in order, joined by commas;
    spans: ``family:start:end`` of the notices' lines. Null and empty texts have none.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    families = _template_grams()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        single = frozenset(g for g in own.weights if " " not in g)
        shapes = [(family, t, frozenset(g for g in t if " " not in g), [tuple(g.split()) for g in t if " " in g]) for family, texts in families.items() for t in texts]

        def possible(words: list[str]) -> dict[str, list[set[str]]]:
            """Templates of which the words hold enough, wherever they stand; a cheap bound by single words goes first."""
            here = single.intersection(words)
            maybe = []
            for family, t, alone, pairs in shapes:
                n = len(alone & here)
                if (n + len(pairs)) / len(t) >= match and (n + sum(a in here and b in here for a, b in pairs)) / len(t) >= match:
                    maybe.append((family, t))
            found = here.union(f"{a} {b}" for a, b in zip(words, words[1:], strict=False) if a in here and b in here) if maybe else here
            out: dict[str, list[set[str]]] = {}
            for family, t in maybe:
                if len(t & found) / len(t) >= match:
                    out.setdefault(family, []).append(t)
            return out

        for batch in batches:
            out = []
            for text in batch.column(1):
                text = text.as_py() or ""
                spans = []
                if possible(TOKEN(text.lower())):
                    lines = text.split("\n")
                    starts = np.cumsum([0, *(len(line) + 1 for line in lines)]).tolist()
                    words = [TOKEN(line.lower()) for line in lines]
                    for has, group in groupby(range(len(lines)), key=lambda k: bool(words[k])):
                        of = list(group)
                        near = possible([w for k in of for w in words[k]]) if has else {}
                        if near:
                            spans += [(f, starts[of[a]], starts[of[b] + 1] - 1) for f, a, b in find_notices([words[k] for k in of], own, near, chance, match)]
                out.append((len(spans), ",".join(sorted({s[0] for s in spans})), ",".join(f"{f}:{a}:{b}" for f, a, b in spans)))
            cols = list(zip(*out, strict=True)) or [[]] * 3
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.string())], ["doc_id", "n_notices", "licenses", "spans"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(lean(run), f"doc_id {kind}, n_notices long, licenses string, spans string")
