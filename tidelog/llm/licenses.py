"""Licence scans by a trained paragraph classifier.

Every paragraph (a line, or neighbouring lines over which a notice is wrapped) is told a licence family by a
softmax regression on word 1- to 3-grams. The model
knows the n-grams of licence texts only; a paragraph without any of them has the scores of the bias alone, so
that the work follows the paragraphs that hold some. The class ``unknown`` is trained on paragraphs of the
corpus, and the probabilities are calibrated by a temperature chosen on held-out rows. A prediction counts as confirmed if
the paragraph covers one of the family's templates, and its probability reaches a threshold.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm.common import Words, blocks, grams
from tidelog.llm.decontaminate import _WORD
from tidelog.llm.linear import Lookup, fit_logistic, sample, softmax, texts_of

UNKNOWN = "unknown"
#: Documents that give the unknown class its lines, and lines taken from all of them at most.
SAMPLE_ROWS, SAMPLE_LINES = 800, 8000
#: A word that stands in one of so many lines of the corpus is no feature by itself.
COMMON = 200
#: Variants of each template in the training set.
VARIANTS = 60
ORDERS = (1, 2, 3)
LEAST_PROBABILITY = 0.5
#: Share of a template's n-grams that the paragraph must hold.
LEAST_COVER = 0.5

# Notices by which works are put under licences of each family.
TEMPLATES = {
    "apache": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
        "SPDX-License-Identifier: Apache-2.0",
        "This project is released under the Apache 2.0 license.",
    ),
    "mit": (
        "Released under the MIT License.",
        "This software is licensed under the MIT License.",
        "SPDX-License-Identifier: MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction.",
    ),
    "gpl": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
        "Distributed under the GNU GPL v2.",
    ),
    "lgpl": (
        "This library is licensed under the GNU Lesser General Public License, version 2.1.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License.",
        "SPDX-License-Identifier: LGPL-2.1-or-later",
    ),
    "agpl": (
        "This program is licensed under the GNU Affero General Public License, version 3.",
        "You can redistribute it and/or modify it under the terms of the GNU Affero General Public License.",
        "SPDX-License-Identifier: AGPL-3.0-only",
    ),
    "bsd": (
        "Released under the BSD 3-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.",
        "SPDX-License-Identifier: BSD-3-Clause",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    ),
    "isc": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.",
        "Released under the ISC License.",
        "SPDX-License-Identifier: ISC",
    ),
    "mpl": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Licensed under the Mozilla Public License 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
    ),
    "cc-by": (
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "Licensed under CC BY 4.0.",
    ),
    "cc-by-sa": (
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
        "Licensed under CC BY-SA 4.0.",
    ),
    "cc-by-nc": (
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "Licensed under CC BY-NC 4.0.",
    ),
    "cc-by-nd": (
        "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.",
        "Licensed under CC BY-ND 4.0.",
    ),
    "cc-by-nc-sa": (
        "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.",
        "Licensed under CC BY-NC-SA 4.0.",
    ),
    "cc-by-nc-nd": (
        "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License.",
        "Licensed under CC BY-NC-ND 4.0.",
    ),
    "cc0": (
        "To the extent possible under law, the author has waived all copyright and related rights under CC0 1.0 Universal.",
        "This is free and unencumbered software released into the public domain.",
        "Dedicated to the public domain under CC0 1.0.",
    ),
    "proprietary": (
        "Copyright. All rights reserved. No part of this publication may be reproduced without the prior written permission of the publisher.",
        "All rights reserved. Unauthorized copying of this file is strictly prohibited.",
    ),
}
# Sentences on licences that put nothing under one.
OTHERS = (
    "The city council granted a license to the new restaurant.",
    "Please read the terms of service before you use this website.",
    "The version of the software was released in the spring.",
    "He has a driving license and the permission of his parents.",
    "The library is free and open to the general public.",
    "This work is under review and may be modified.",
)
# Ways to name each family's licence, put into FRAMES and DENIED.
NAMES = {
    "apache": ("Apache License, Version 2.0", "Apache 2.0 license"),
    "mit": ("MIT License", "MIT license terms"),
    "gpl": ("GNU General Public License, version 3", "GNU GPL v2", "GPLv3"),
    "lgpl": ("GNU Lesser General Public License, version 2.1", "GNU LGPL v3"),
    "agpl": ("GNU Affero General Public License", "GNU AGPL v3"),
    "bsd": ("BSD 3-Clause License", "BSD 2-Clause License", "BSD license"),
    "isc": ("ISC License",),
    "mpl": ("Mozilla Public License 2.0", "Mozilla Public License, v. 2.0"),
    "cc-by": ("Creative Commons Attribution 4.0 International License", "CC BY 4.0"),
    "cc-by-sa": ("Creative Commons Attribution-ShareAlike 4.0 International License", "CC BY-SA 4.0"),
    "cc-by-nc": ("Creative Commons Attribution-NonCommercial 4.0 International License", "CC BY-NC 4.0"),
    "cc-by-nd": ("Creative Commons Attribution-NoDerivatives 4.0 International License", "CC BY-ND 4.0"),
    "cc-by-nc-sa": ("Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License", "CC BY-NC-SA 4.0"),
    "cc-by-nc-nd": ("Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License", "CC BY-NC-ND 4.0"),
    "cc0": ("CC0 1.0 Universal", "CC0 1.0"),
}
# Licences outside the list: notices of them are unknown.
UNLISTED = (
    "Eclipse Public License 2.0", "Eclipse Public License, v. 1.0", "European Union Public Licence, Version 1.2", "Boost Software License, Version 1.0", "zlib License", "SIL Open Font License, Version 1.1",
    "Microsoft Public License", "Academic Free License, version 3.0", "Artistic License 2.0", "Common Development and Distribution License 1.0", "PostgreSQL License", "Python Software Foundation License",
    "Open Database License", "Universal Permissive License, Version 1.0", "Business Source License 1.1", "Server Side Public License, version 1", "Open Software License 3.0", "Elastic License 2.0", "Common Public License 1.0", "IBM Public License 1.0",
)
FRAMES = ("Licensed under the {}.", "Released under the {}.", "This work is licensed under the {}.", "This program is distributed under the terms of the {}.", "This file is subject to the terms of the {}.", "The accompanying materials are made available under the terms of the {}.", "{}")
# Sentences that deny a notice: what is said of whom. The runs of words that begin with the word of DENYING are features.
DENYING = ("not", "never", "isn't", "wasn't", "aren't", "don't", "didn't", "no longer", "cannot be", "can't be")
DENIED = (
    *(f"{who} {no} {what} under the {{}}." for who, no in (("This work", "is not"), ("It", "isn't"), ("The code", "was never"), ("The files", "aren't"), ("This program", "is no longer"), ("The files", "are no longer"), ("The code", "was no longer"), ("The library", "wasn't"), ("It", "cannot be"), ("It", "can't be"), ("It", "has never been"), ("The package", "has not been")) for what in ("licensed", "released", "distributed", "available")),
    *(f"{who} {no} {what} under the {{}}." for who, no in (("We", "never"), ("We", "no longer"), ("They", "no longer"), ("We", "do not"), ("They", "don't"), ("They", "didn't"), ("The authors", "did not")) for what in ("released this", "license it", "license our code", "release it", "distribute this")),
    *(f"This file {no} {what} the {{}}." for no in ("is not", "isn't", "is no longer", "was never") for what in ("subject to", "covered by", "governed by")),
)
FAMILIES = (*TEMPLATES, UNKNOWN)
#: Words that a notice may run on for after the line in which it begins: those of any template.
SPAN = max(len(t.replace("-", " ").replace("/", " ").replace(".", " ").split()) for ts in TEMPLATES.values() for t in ts)
#: Runs of lines told at once.
AT_ONCE = 4096
_BREAK = np.zeros(256, dtype=bool)
_BREAK[[10, 13]] = True


def _keys(data: np.ndarray, offsets: np.ndarray) -> tuple[Words, list[np.ndarray]]:
    words = Words(data, offsets, _WORD)
    return words, [grams(words.hashes, n) for n in ORDERS]


def paragraphs(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Offsets of the lines of all texts, and the text of each."""
    edges = np.unique(np.concatenate([offsets, np.flatnonzero(_BREAK[data]) + 1]))
    return edges, np.searchsorted(offsets, edges[:-1], side="right") - 1


def _hits(lookup: Lookup, words: Words, keys: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(paragraph, feature) of each known n-gram."""
    owner, out = words.texts(), []
    for n, k in zip(ORDERS, keys, strict=True):
        place, number = lookup.find(k)
        same = owner[place] == owner[place + n - 1]
        out.append((owner[place][same], number[same]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def wrapped(lookup: Lookup, words: Words, keys: list[np.ndarray], data: np.ndarray, edges: np.ndarray, of: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(first line, last line, feature rows) of runs of lines that start where a known n-gram does.

    A run goes on for SPAN words after its first line, but not over a line without words or the end of the text, so
    that a template which begins in the first line is in it as a whole. n-grams cross the line breaks.
    """
    if not len(of):
        return
    feed = (data[edges[:-1]] == 10) & (np.diff(edges) == 1) & (edges[:-1] > 0) & (data[edges[:-1] - 1] == 13)  # the second half of a line break
    part = np.cumsum(((words.counts() == 0) & ~feed) | (np.diff(of, prepend=of[:1]) != 0))
    last = np.minimum(np.searchsorted(words.first, words.first[1:] + SPAN) - 1, np.searchsorted(part, part, side="right") - 1)
    owner, out = words.texts(), []
    for n, k in zip(ORDERS, keys, strict=True):
        place, number = lookup.find(k)
        same = part[owner[place]] == part[owner[place + n - 1]]
        out.append((place[same], place[same] + n, number[same]))
    begin, end, number = (np.concatenate(x) for x in zip(*out, strict=True))
    order = np.argsort(begin, kind="stable")
    begin, end, number = begin[order], end[order], number[order]
    lines = np.unique(owner[begin])
    lines = lines[words.first[last[lines] + 1] > words.first[lines + 1]]
    for i in range(0, len(lines), AT_ONCE):
        a = lines[i : i + AT_ONCE]
        b = last[a]
        low, high = np.searchsorted(begin, words.first[a]), np.searchsorted(begin, words.first[b + 1])
        run = np.repeat(np.arange(len(a)), high - low)
        at = np.arange(len(run)) + np.repeat(low - np.cumsum(high - low) + (high - low), high - low)
        whole = end[at] <= words.first[b + 1][run]
        x = np.zeros((len(a), len(lookup.keys)), np.float32)
        x[run[whole], number[at[whole]]] = 1
        yield a, b, x


def _rows(lookup: Lookup, owner: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Paragraphs with a hit, and their feature rows (1 where an n-gram stands)."""
    which, row = np.unique(owner, return_inverse=True)
    x = np.zeros((len(which), len(lookup.keys)), np.float32)
    x[row, number] = 1
    return which, x


@dataclass
class Model:
    keys: np.ndarray
    weights: np.ndarray
    temperature: float
    covers: list[tuple[int, np.ndarray]]  # family and features of each template

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Family, calibrated probability and cover of the family's best template."""
        p = softmax(np.hstack([x, np.ones((len(x), 1), np.float32)]) @ self.weights.T / self.temperature)
        family = p.argmax(axis=1)
        cover = np.zeros(len(x))
        for k, features in self.covers:
            mine = family == k
            cover[mine] = np.maximum(cover[mine], x[mine][:, features].mean(axis=1))
        return family, p[np.arange(len(p)), family], cover


def _variants(text: str, rng: np.random.Generator, fillers: list[str]) -> Iterator[str]:
    """A template as it may stand in a document: words lost, changed or put around it."""
    words = text.split()
    for k in range(VARIANTS):
        lost = rng.random(len(words)) < (0 if k % 3 == 0 else 0.08)
        mid = [w for w, x in zip(words, lost, strict=True) if not x] or words
        before, after = (list(rng.choice(fillers, rng.integers(0, 6))) if k % 2 else [] for _ in range(2))
        yield " ".join([*before, *mid, *after])


def template_words() -> np.ndarray:
    """Hashes of the templates' words."""
    return np.unique(Words(*texts_of([t for ts in TEMPLATES.values() for t in ts]), _WORD).hashes)


def word_counts(texts: DataFrame) -> tuple[np.ndarray, int]:
    """How often each of the templates' words stands in all texts, and the number of their lines."""
    names = texts.sparkSession.sparkContext.broadcast(template_words())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup = Lookup(names.value)
        sums, lines = np.zeros(len(names.value), np.int64), 0
        for batch in batches:
            for _, _, data, offsets in blocks(batch.column(0)):
                sums += np.bincount(lookup.find(Words(data, offsets, _WORD).hashes)[1], minlength=len(sums))
                lines += len(paragraphs(data, offsets)[1])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, len(sums))), pa.array(np.append(lines, sums))], names=["word", "n"])

    got = {r["word"]: r["n"] for r in texts.mapInArrow(count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()}
    return np.array([got.get(k, 0) for k in range(len(names.value))]), got.get(-1, 0)


def _training_rows(corpus: list[str], rng: np.random.Generator) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Texts, their classes, and whether each is kept back to calibrate.

    Whole wordings are kept back with their variants (names put into FRAMES may still come near one): the last template of each family, one in three
    unlisted licences, one in five denials, and one in five lines of the corpus.
    """
    fillers = [w for t in (*corpus[:50], *OTHERS) for w in t.split()[:20]]
    none = len(FAMILIES) - 1
    rows = [(v, k, j == len(TEMPLATES[f]) - 1) for k, f in enumerate(TEMPLATES) for j, t in enumerate(TEMPLATES[f]) for v in _variants(t, rng, fillers)]
    rows += [(frame.format(name), FAMILIES.index(f), False) for f, names in NAMES.items() for name in names for frame in FRAMES]
    rows += [(frame.format(name), none, k % 3 == 2) for k, name in enumerate(UNLISTED) for frame in FRAMES for _ in range(3)]
    rows += [(denial.format(name), none, k % 5 == 4) for k, denial in enumerate(DENIED) for names in NAMES.values() for name in names for _ in range(3)]
    rows += [(t, none, k % 5 == 4) for k, t in enumerate((*corpus, *(o for o in OTHERS for _ in range(VARIANTS))))]
    texts, y, kept = zip(*rows, strict=True)
    return list(texts), np.array(y), np.array(kept)


def _denials() -> list[str]:
    """The words of each denial from the one that denies on, without the name."""
    out = []
    for t in DENIED:
        at = min(t.index(f" {no} ") for no in DENYING if f" {no} " in t)
        out.append(t[at + 1 : t.index(" under" if " under" in t else " the {}")])
    return out


def train(corpus: list[str], counts: np.ndarray | None = None, lines: int = 0) -> Model:
    """Fit on variants of the templates, names of licences in and outside the list, denials and paragraphs of the corpus.

    The temperature is chosen on wordings that a first fit has not seen; the second fit, whose weights are kept, has them all.
    """
    rng = np.random.default_rng(20240401)
    texts, y, kept = _training_rows(corpus, rng)
    templates = [t for ts in TEMPLATES.values() for t in ts]
    of = np.repeat(np.arange(len(TEMPLATES)), [len(ts) for ts in TEMPLATES.values()])
    # Features: the templates' n-grams, but for single words that are common in the corpus; runs of words of unlisted names and denials.
    words, keys = _keys(*texts_of(templates))
    owner = words.texts()
    parts = [k[owner[: len(k)] == owner[n - 1 :]] for n, k in zip(ORDERS, keys, strict=True)]
    if counts is None:  # of the given paragraphs alone
        common, lines = Lookup(template_words()), len(corpus)
        counts = np.bincount(common.find(Words(*texts_of(corpus), _WORD).hashes)[1], minlength=len(common.keys))
    single = grams(template_words()[counts >= max(3, lines / COMMON)], 1)
    others = []
    for strings in (UNLISTED, _denials()):
        named, runs = _keys(*texts_of(list(strings)))
        owner = named.texts()
        others += [k[owner[: len(k)] == owner[n - 1 :]] for n, k in zip(ORDERS[1:], runs[1:], strict=True)]
    known = np.unique(np.concatenate([parts[0][~np.isin(parts[0], single)], *parts[1:], *others]))
    lookup = Lookup(known)
    which, x = _rows(lookup, *_hits(lookup, *_keys(*texts_of(texts))))
    full = np.zeros((len(texts), len(known)), np.float32)
    full[which] = x
    first = fit_logistic(full[~kept], y[~kept], ridge=0.5, rounds=150)
    z = np.hstack([full[kept], np.ones((kept.sum(), 1), np.float32)]) @ first.T
    heats = np.geomspace(0.3, 3, 25)
    loss = [-np.log(softmax(z / t)[np.arange(len(z)), y[kept]] + 1e-12).mean() for t in heats]
    weights = fit_logistic(full, y, ridge=0.5, rounds=150)
    at, covers = _rows(lookup, *_hits(lookup, *_keys(*texts_of(templates))))
    return Model(known, weights.astype(np.float32), float(heats[int(np.argmin(loss))]), [(int(of[t]), np.flatnonzero(row)) for t, row in zip(at, covers, strict=True)])


def fit(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """A model whose unknown class is trained on whole lines of a bounded sample, chosen by a hash from whole texts.

    Lines that name a licence word are left out of it: they may be notices. The words that are too common to be
    features are counted over all documents.
    """
    texts = df.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).filter("_text is not null")
    rows = sample(texts.filter("_id is not null"), "_id", SAMPLE_ROWS, "_text")
    lines = rows.select(F.explode(F.split("_text", r"[\r\n]+")).alias("_line")).filter("trim(_line) <> ''").filter(~F.col("_line").rlike(r"(?i)licen[cs]e|copyright|rights|permi|redistrib|spdx|public domain|\bcc"))
    lines = lines.distinct().orderBy(F.xxhash64("_line"), "_line").limit(SAMPLE_LINES)
    return train(sorted(r[0] for r in lines.collect()), *word_counts(texts.select("_text")))


FOUND = "array<struct<family:string,probability:double,cover:double,confirmed:boolean,start_byte:long,end_byte:long>>"


def _notices(model: Model, runs: Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]], edges: np.ndarray, of: np.ndarray) -> dict[int, list[dict]]:
    """Confirmed predictions of each text over several lines, the best covered and then the last begun ahead."""
    out: dict[int, list[dict]] = {}
    for first, last, x in runs:
        family, prob, cover = model.predict(x)
        good = np.flatnonzero((family != len(FAMILIES) - 1) & (prob >= LEAST_PROBABILITY) & (cover >= LEAST_COVER))
        for k in good.tolist():
            out.setdefault(int(of[first[k]]), []).append({"family": FAMILIES[family[k]], "probability": float(prob[k]), "cover": float(cover[k]), "confirmed": True, "start_byte": int(edges[first[k]]), "end_byte": int(edges[last[k] + 1])})
    return {t: sorted(fs, key=lambda f: (-f["cover"], -f["start_byte"])) for t, fs in out.items()}


def _scan(shared):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        lookup = Lookup(model.keys)
        for batch in batches:
            for first, last, data, offsets in blocks(batch.column("text")):
                edges, of = paragraphs(data, offsets)
                words, keys = _keys(data, edges)
                which, x = _rows(lookup, *_hits(lookup, words, keys))
                found: list[list[dict]] = [[] for _ in range(last - first)]
                if len(which):
                    for p, family, prob, cover in zip(which.tolist(), *(v.tolist() for v in model.predict(x)), strict=True):
                        if FAMILIES[family] != UNKNOWN and prob >= LEAST_PROBABILITY:
                            t = int(of[p])
                            found[t].append({"family": FAMILIES[family], "probability": prob, "cover": cover, "confirmed": cover >= LEAST_COVER, "start_byte": int(edges[p] - offsets[t]), "end_byte": int(edges[p + 1] - offsets[t])})
                for t, notices in _notices(model, wrapped(lookup, words, keys, data, edges, of), edges, of).items():
                    begin = offsets[t]
                    held = [(f["family"], f["start_byte"], f["end_byte"]) for f in found[t] if f["confirmed"]]
                    for f in notices:
                        i, j = int(f["start_byte"] - begin), int(f["end_byte"] - begin)
                        if not any(name == f["family"] and a < j and i < b for name, a, b in held):
                            held.append((f["family"], i, j))
                            found[t].append(f | {"start_byte": i, "end_byte": j})
                kind = pa.list_(pa.struct([("family", pa.string()), ("probability", pa.float64()), ("cover", pa.float64()), ("confirmed", pa.bool_()), ("start_byte", pa.int64()), ("end_byte", pa.int64())]))
                best = [max((f for f in fs if f["confirmed"]), key=lambda f: (f["probability"], -f["start_byte"]), default=None) for fs in found]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id")[first:last],
                        pa.array([b["family"] if b else UNKNOWN for b in best], pa.string()),
                        pa.array([b["probability"] if b else None for b in best], pa.float64()),
                        pa.array([b["cover"] if b else None for b in best], pa.float64()),
                        pa.array([sorted({f["family"] for f in fs if f["confirmed"]}) for fs in found], pa.list_(pa.string())),
                        pa.array(found, kind),
                    ],
                    names=["doc_id", "license", "probability", "cover", "licenses", "paragraphs"],
                )

    return scan


def scan(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, license, probability, cover, licenses, paragraphs) of each row.

    ``license`` is the family of the likeliest confirmed paragraph, ``unknown`` where there is none; ``licenses``
    are all confirmed families, ``paragraphs`` all predictions on lines with their byte ranges, then the confirmed ones on
    several lines that hold no confirmed line of their family. Null and empty texts are
    unknown. Repeated rows and null ids keep their rows; other columns are left out. An empty table gives no rows.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return docs.mapInArrow(_scan(shared), f"doc_id long, license string, probability double, cover double, licenses array<string>, paragraphs {FOUND}")
