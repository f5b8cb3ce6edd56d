"""Licence notices in texts: a trained classifier of paragraphs, confirmed by comparison with templates.

Every line of a text is a paragraph, and so is every run of lines without a blank one, in which windows of words
are judged as well. The word n-grams of up to three words of each go through a sparse logistic regression over licence
families and ``unknown``. It is trained in numpy on the driver: on sentences of the templates with words dropped, changed and
joined to others, against pieces of corpus lines, notices of licences outside the families and sentences that
speak of licences without granting one. Probabilities are calibrated by a temperature on held-out lines, and by
a threshold that no held-out unknown line with a licence's name passes. A prediction counts if the paragraph also
holds enough of a template of its family, with the words by which that licence differs from all others (its key) in
full and in order, and is no denial ("not licensed under ..."). So shared phrases never give a family by themselves.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from payrisk.llm.common import Batches, as_bytes, as_records, chunks_of, over_batches, with_record

UNKNOWN = "unknown"

# What notices of each family say; in brackets the words that no other licence says.
SENTENCES = {
    "mit": (
        "This project is licensed under the terms of the [MIT license].",
        "Permission is hereby granted, free of charge, to any [person obtaining a copy of this software] and associated documentation files",
        "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, [merge, publish, distribute, sublicense]",
    ),
    "apache": (
        "Licensed under the [Apache License], Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
        "You may obtain a copy of the License at http://www.[apache.org/licenses/LICENSE-2.0]",
        "distributed under the [License is distributed on an \"AS IS\" BASIS], WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    ),
    "gpl": (
        "This work is licensed under the [GNU General Public License], version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the [GNU General Public License] as published by the Free Software Foundation",
        "You should have received a copy of the [GNU General Public License] along with this program.",
    ),
    "lgpl": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the [GNU Lesser General Public License]",
        "You should have received a copy of the [GNU Lesser General Public License] along with this library.",
    ),
    "agpl": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the [GNU Affero General Public License]",
        "You should have received a copy of the [GNU Affero General Public License] along with this program.",
    ),
    "bsd": (
        "[Redistribution and use in source and binary forms], with or without modification, are permitted provided that the following conditions are met",
        "[Redistributions of source code must retain the above copyright notice], this list of conditions and the following disclaimer.",
        "Use of this source code is governed by a [BSD-style license] that can be found in the LICENSE file.",
    ),
    "mpl": ("This Source Code Form is subject to the terms of the [Mozilla Public License], v. 2.0.",),
    "epl": ("This program and the accompanying materials are made available under the terms of the [Eclipse Public License] 2.0",),
    "isc": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "[granted, provided that the above copyright notice and this permission notice appear] in all copies.",
    ),
    "boost": ("Distributed under the [Boost Software License], Version 1.0.",),
    "unlicense": ("This is free and [unencumbered software released into the public domain].",),
    "cc0": (
        "To the extent possible under law, the author has [waived all copyright and related rights] to this work.",
        "Dedicated to the public domain under [CC0 1.0 Universal].",
    ),
    "proprietary": (
        "[All rights reserved]. No part of this publication may be reproduced without prior written permission.",
        "Copyright 2020. [All rights reserved].",
        "[All rights reserved].",
    ),
}
# Names of each family, as they follow "licensed under"; the word "under" is part of their keys.
NAMES = {
    "mit": ("the [MIT License]",),
    "apache": ("the [Apache License], Version 2.0", "the [Apache License] 2.0"),
    "gpl": ("the [GNU General Public License]", "the [GPL]", "the [GPLv2]", "the [GPLv3]"),
    "lgpl": ("the [GNU Lesser General Public License], version 2.1", "the [LGPL]", "the [LGPLv2]", "the [LGPLv3]"),
    "agpl": ("the [GNU Affero General Public License]", "the [AGPL]", "the [AGPLv3]"),
    "bsd": ("the [BSD 3-Clause License]", "the [BSD 2-Clause License]", "the [3-Clause BSD License]", "the [BSD license]"),
    "mpl": ("the [Mozilla Public License] 2.0",),
    "epl": ("the [Eclipse Public License] 2.0",),
    "isc": ("the [ISC License]",),
    "boost": ("the [Boost Software License], Version 1.0",),
    "unlicense": ("the [Unlicense]",),
    "cc0": ("[CC0] 1.0",),
}
# What files and package lists write for each family.
IDENTIFIERS = {
    "mit": ("MIT",),
    "apache": ("Apache-2.0",),
    "gpl": ("GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only", "GPL-3.0-or-later", "GPLv2", "GPLv3"),
    "lgpl": ("LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0-only", "LGPL-3.0-or-later"),
    "agpl": ("AGPL-3.0-only", "AGPL-3.0-or-later"),
    "bsd": ("BSD-2-Clause", "BSD-3-Clause"),
    "mpl": ("MPL-1.1", "MPL-2.0"),
    "epl": ("EPL-1.0", "EPL-2.0"),
    "isc": ("ISC",),
    "boost": ("BSL-1.0",),
    "unlicense": ("Unlicense",),
    "cc0": ("CC0-1.0",),
}
# The six Creative Commons licences, by their short and long names, and their versions in use.
CREATIVE_COMMONS = {
    "BY": "Attribution", "BY-SA": "Attribution-ShareAlike", "BY-NC": "Attribution-NonCommercial", "BY-ND": "Attribution-NoDerivatives",
    "BY-NC-SA": "Attribution-NonCommercial-ShareAlike", "BY-NC-ND": "Attribution-NonCommercial-NoDerivatives",
}
CC_VERSIONS = ("3.0", "4.0")


def _templates() -> dict[str, tuple[str, ...]]:
    """All sentences of each family: whole ones, and those that follow from its names and identifiers."""
    out = {}
    for family, sentences in SENTENCES.items():
        named = [f"{verb} [under {name.replace('[', '')}." for name in NAMES.get(family, ()) for verb in ("Licensed", "Released")]
        tagged = [t for x in IDENTIFIERS.get(family, ()) for t in (f"SPDX-License-Identifier: [{x}]", f"[License: {x}]")]
        out[family] = (*sentences, *named, *tagged)
    for short, long in CREATIVE_COMMONS.items():
        texts = [f"Text is available under the Creative Commons [{long} License]."]
        for version in CC_VERSIONS:
            texts.append(f"This work is licensed under a Creative Commons [{long} {version}] International License.")
            texts += [f"{verb} [under CC {short} {version}]." for verb in ("Licensed", "Released")]
            texts += [f"SPDX-License-Identifier: [CC-{short}-{version}]", f"[License: CC-{short}-{version}]"]
        out[f"cc-{short.lower()}"] = tuple(texts)
    return out


TEMPLATES = _templates()
# Sentences that speak of such things and grant nothing, or grant by a licence of no family.
OTHERS = (
    "He renewed his driving license last week.", "The license plate of the car was covered in mud.",
    "You need permission from your parents to go.", "The software was released in the spring of last year.",
    "A new version of the program is available.", "The general public was not allowed into the building.",
    "The bakery lost its liquor license under the new terms.", "She works for a free software company.",
    "They were granted a license to fish in the lake.", "Copyright law differs from country to country.",
    "The public library is open on Sunday.", "All rights of way must be kept clear.",
    "The source of the river is in the mountains.", "Attribution of the painting remains uncertain.",
    "Terms and conditions may apply to this offer.", "The Apache helicopter landed at the base.",
    "Work under the bridge will go on until May.", "He studied at MIT and at Berkeley.",
    "Licensed under the Artistic License 2.0.", "Licensed under the zlib License.", "Licensed under the European Union Public Licence.",
    "Released under the Microsoft Public License.", "Licensed under the PHP License, version 3.01.", "Released under the Open Font License.",
    "Licensed under the Common Development and Distribution License, Version 1.0.", "SPDX-License-Identifier: Zlib",
    "SPDX-License-Identifier: OFL-1.1", "SPDX-License-Identifier: CDDL-1.0", "License: Artistic-2.0", "License: proprietary or unknown",
)

KEY = re.compile(r"\[(.*?)\]")
# A denial: a word that negates shortly before what would grant. Words as in ``words_of``.
DENIAL = re.compile(
    rb"\b(?:not|never|neither|nor|no longer|isn t|aren t|wasn t|weren t)(?: [a-z0-9]+){0,2} "
    rb"(?:licensed|released|distributed|available|dedicated|governed|covered|subject|under)\b"
)

WORD = re.compile(rb"[a-z0-9]+")
# Any year is one and the same word.
YEAR, A_YEAR = re.compile(rb"(?:19|20)[0-9]{2}(?![a-z0-9])(?<![a-z0-9][0-9]{4})"), b"1900"
LONGEST_GRAM, EMBEDDED, COPIES, MIXED_FROM = 3, 12, 12, 6
# Bounds on the corpus lines that training sees as unknown, and on what it sees of each.
MAX_LINES, LINE_CHARS, HASH_PARTS = 4_000, 300, 1 << 30
EPOCHS, RATE, DECAY = 60, 0.5, 1e-4
MIN_PROBABILITY, MIN_OVERLAP = 0.5, 0.6
# Windows are sought across the ends of lines, and within lines of more words than this.
LONG_LINE = 64

SCHEMA = "families array<string>, n_notices bigint, score double, spans array<bigint>"
TYPES = [pa.list_(pa.string()), pa.int64(), pa.float64(), pa.list_(pa.int64())]


def words_of(line: bytes) -> list[bytes]:
    return WORD.findall(YEAR.sub(A_YEAR, line.lower()))


def grams(words: list[bytes], longest: int = LONGEST_GRAM) -> set[bytes]:
    return {b" ".join(words[k : k + n]) for n in range(1, longest + 1) for k in range(len(words) - n + 1)}


class Template:
    """What windows of a paragraph are compared with: the grams of a template, and its key."""

    def __init__(self, text: str):
        self.grams = frozenset(grams(words_of(text.encode())))
        self.key = words_of(KEY.search(text).group(1).encode())
        # No paragraph without this word holds the key.
        self.anchor = max(self.key, key=lambda w: (len(w), w))
        self.spaced_key = b" %b " % b" ".join(self.key)
        parts = [tuple(g.split()) for g in self.grams]
        self.words = frozenset(p[0] for p in parts if len(p) == 1)
        self.pairs = frozenset(p for p in parts if len(p) == 2)
        self.triples = [(p[:2], p[1:]) for p in parts if len(p) == 3]
        self.need = next(k for k in range(1, len(self.grams) + 1) if k / len(self.grams) >= MIN_OVERLAP)
        # Words of a window: some may be added to the template's.
        self.size = len(self.pairs) + 1 + len(self.pairs) // 2 + 4

    def possible(self, words: set[bytes], pairs: set[tuple[bytes, bytes]]) -> bool:
        """Whether a paragraph of these words and pairs may hold enough of the grams; an upper bound."""
        own = self.pairs & pairs
        if not own:
            return len(self.words & words) >= self.need
        if len(self.words) + len(own) + len(self.triples) < self.need:
            return False
        return len(self.words & words) + len(own) + sum(a in own and b in own for a, b in self.triples) >= self.need

    def windows(self, words: list[bytes]) -> Iterator[tuple[int, int]]:
        """Windows (first word, end) that hold enough of the grams: each the best of its place, without needless words at its ends."""
        ends: list[list[tuple[int, bytes]]] = []
        for k, word in enumerate(words):
            here, gram = [], word
            for n in range(LONGEST_GRAM):
                if n:
                    if k < n or words[k - n] not in self.words:
                        break
                    gram = words[k - n] + b" " + gram
                elif word not in self.words:
                    break
                if gram in self.grams:
                    here.append((k - n, gram))
            ends.append(here)
        start, at = 0, 0
        held: Counter[bytes] = Counter()
        while at < len(words):
            held.update(g for a, g in ends[at] if a >= start)
            while at + 1 - start > self.size:
                self._drop(held, ends, start, at)
                start += 1
            at += 1
            if len(held) < self.need:
                continue
            best, end = len(held), at
            more = set(held)
            for k in range(at, min(start + self.size, len(words))):
                more.update(g for a, g in ends[k] if a >= start)
                if len(more) > best:
                    best, end = len(more), k + 1
            for k in range(at, end):
                held.update(g for a, g in ends[k] if a >= start)
            while all(held[g] > 1 for g in self._begins(ends, start, end - 1)):
                self._drop(held, ends, start, end - 1)
                start += 1
            yield start, end
            self._drop(held, ends, start, end - 1)
            start, at = start + 1, end

    @staticmethod
    def _begins(ends: list[list[tuple[int, bytes]]], start: int, last: int) -> list[bytes]:
        return [g for k in range(start, min(start + LONGEST_GRAM, last + 1)) for a, g in ends[k] if a == start]

    def _drop(self, held: Counter[bytes], ends: list[list[tuple[int, bytes]]], start: int, last: int) -> None:
        for g in self._begins(ends, start, last):
            held[g] -= 1
            if not held[g]:
                del held[g]


@dataclass
class Classifier:
    families: list[str]  # the last one is UNKNOWN
    features: dict[bytes, int]
    weights: np.ndarray  # features, families
    bias: np.ndarray
    temperature: float
    threshold: float
    templates: dict[str, list[Template]]

    def __post_init__(self):
        self.sought = [(f, t) for f, own in self.templates.items() for t in own]
        self.pairs = frozenset().union(*(t.pairs for _, t in self.sought))
        self.anchors = frozenset(t.anchor for _, t in self.sought)

    def logits(self, words: list[bytes]) -> np.ndarray | None:
        """Scores of the families; none if the paragraph has no feature at all."""
        own = [self.features[g] for g in grams(words) if g in self.features]
        return self.bias + self.weights[own].sum(axis=0) / np.sqrt(len(own)) if own else None

    def judge(self, line: bytes) -> tuple[str, float] | None:
        """Family and calibrated probability of a notice that a template confirms."""
        return self.judge_words(words_of(line))

    def judge_words(self, words: list[bytes]) -> tuple[str, float] | None:
        if self.anchors.isdisjoint(words):  # no template can confirm it
            return None
        logits = self.logits(words)
        if logits is None:
            return None
        p = softmax(logits[None] / self.temperature)[0]
        best = int(p.argmax())
        family = self.families[best]
        if family == UNKNOWN or p[best] < self.threshold:
            return None
        return (family, float(p[best])) if self.confirmed(words, family) else None

    def confirmed(self, words: list[bytes], family: str) -> bool:
        """Whether a template of the family is there, with its key in full, and nothing denies it."""
        own, spaced = grams(words), b" %b " % b" ".join(words)
        held = any(t.spaced_key in spaced and len(t.grams & own) >= t.need for t in self.templates[family])
        return held and not DENIAL.search(spaced)

    def judge_windows(self, lines: list[list[bytes]], alone: list[str | None]) -> list[tuple[int, int, str, float]]:
        """Notices (first word, end, family, probability) in a paragraph that no line of it shows by itself.

        ``alone`` has the family of each line judged by itself. Of windows that share words the one with most of a template counts.
        """
        words = [w for line in lines for w in line]
        anchors = self.anchors.intersection(words)
        if not anchors:
            return []
        pairs = self.pairs.intersection(zip(words, words[1:]))
        if not pairs:
            return []
        own, found = set(words), []
        line_of = [k for k, line in enumerate(lines) for _ in line]
        for family, template in self.sought:
            if template.anchor not in anchors or not template.possible(own, pairs):
                continue
            done = 0
            for a, b in template.windows(words):
                if a < done:
                    continue
                first, last = line_of[a], line_of[b - 1]
                if first == last and len(lines[first]) <= LONG_LINE:
                    continue
                if family in alone[first : last + 1]:
                    continue
                judged = self.judge_words(words[a:b])
                if judged and judged[0] not in alone[first : last + 1]:
                    found.append((len(template.grams & grams(words[a:b])), a, b, *judged))
                    done = b
        kept: list[tuple[int, int, str, float]] = []
        for _, a, b, family, p in sorted(found, key=lambda f: (-f[0], f[1], f[2])):
            if all(b <= c or d <= a for c, d, _, _ in kept):
                kept.append((a, b, family, p))
        return sorted(kept)


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def examples(lines: list[bytes], templates: dict[str, tuple[str, ...]], seed: int = 1) -> list[tuple[list[bytes], str]]:
    """Varied template sentences, and lines that are no notices: of the corpus, made up, and templates' words mixed up."""
    draw, out = np.random.default_rng(seed), []
    corpus = [w for w in map(words_of, lines) if w]
    others = [words_of(t.encode()) for t in OTHERS]
    plain = corpus + others
    for family, texts in templates.items():
        for text in texts:
            whole = words_of(text.encode())
            for copy in range(COPIES):
                words = [w for w in whole if copy == 0 or len(whole) < MIXED_FROM or draw.random() > 0.1]
                if copy % 3 == 1:  # a notice inside of another sentence
                    around = plain[draw.integers(len(plain))]
                    cut = int(draw.integers(min(len(around), EMBEDDED) + 1))
                    words = around[:cut] + words + around[cut:EMBEDDED]
                out.append((words, family))
            for _ in range(COPIES // 4 if len(whole) >= MIXED_FROM else 0):
                mixed = [whole[k] for k in draw.permutation(len(whole))]
                out.append((mixed[: len(mixed) // 2], UNKNOWN))
    out += [(w, UNKNOWN) for w in corpus]
    out += [(w, UNKNOWN) for w in others for _ in range(COPIES)]
    return out


def train(lines: list[bytes], seed: int = 1, texts: dict[str, tuple[str, ...]] = TEMPLATES) -> Classifier:
    """Multinomial logistic regression with weight decay; every fifth example calibrates it.

    ``texts`` has the template sentences of each family, keys in brackets.
    """
    rows = examples(lines, texts, seed)
    templates = {f: [Template(t) for t in own] for f, own in texts.items()}
    features = {g: k for k, g in enumerate(sorted(set().union(*(t.grams for own in templates.values() for t in own))))}
    families = [*sorted(texts), UNKNOWN]
    held = np.arange(len(rows)) % 5 == 4
    used = [sorted(features[g] for g in grams(w) if g in features) for w, _ in rows]
    wanted = np.array([families.index(f) for _, f in rows])
    # Rows without a feature say nothing about the weights.
    known = np.array([bool(u) for u in used])
    model = Classifier(families, features, np.zeros((len(features), len(families))), np.zeros(len(families)), 1.0, MIN_PROBABILITY, templates)

    def sparse(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        own = np.flatnonzero(mask & known)
        sizes = np.array([len(used[k]) for k in own])
        columns = np.concatenate([used[k] for k in own]).astype(int)
        return own, sizes, columns, wanted[own]

    def scores(sizes: np.ndarray, column: np.ndarray) -> np.ndarray:
        sums = np.add.reduceat(model.weights[column], np.cumsum(sizes) - sizes, axis=0)
        return sums / np.sqrt(sizes)[:, None] + model.bias

    _, sizes, column, target = sparse(~held)
    by_column, row = np.argsort(column, kind="stable"), np.repeat(np.arange(len(sizes)), sizes)
    present, begins = np.unique(column[by_column], return_index=True)
    owners = row[by_column]
    spread = np.zeros_like(model.weights) + 1e-6
    for _ in range(EPOCHS):  # adaptive steps on all examples
        error = softmax(scores(sizes, column))
        error[np.arange(len(target)), target] -= 1
        gradient = DECAY * len(target) * model.weights
        gradient[present] += np.add.reduceat((error / np.sqrt(sizes)[:, None])[owners], begins, axis=0)
        spread += gradient**2
        model.weights -= RATE * gradient / np.sqrt(spread)
        model.bias -= RATE * error.mean(axis=0)
    own, sizes, column, target = sparse(held)
    raw = scores(sizes, column)
    losses = {t: -np.log(softmax(raw / t)[np.arange(len(target)), target] + 1e-12).mean() for t in (0.25, 0.5, 0.7, 1.0, 1.4, 2.0, 4.0)}
    model.temperature = min(losses, key=losses.get)
    p = softmax(raw / model.temperature)
    best = p[:, :-1].argmax(axis=1)
    named = [k for k in np.flatnonzero(target == len(families) - 1) if model.confirmed(rows[own[k]][0], families[best[k]])]
    model.threshold = float(min(0.95, max(MIN_PROBABILITY, p[named, best[named]].max(initial=0.0) + 1e-6)))
    return model


def corpus_lines(docs: DataFrame, max_lines: int = MAX_LINES) -> list[bytes]:
    """Pieces of at most LINE_CHARS characters of at most ``max_lines`` lines without any word of licensing, for training.

    Lines from anywhere in the texts are chosen by a hash of what they say (equal lines count once), and so is the piece of a long line.
    """
    lines = docs.select(F.split(F.col("text").cast("string"), "\n").alias("lines"))
    n_lines = lines.agg(F.sum(F.size("lines"))).first()[0] or 0
    rows = lines.select(F.explode("lines").alias("line")).withColumn("hash", F.xxhash64("line"))
    # Some more than wanted, so that the cut to the number is by the hash as well.
    share = int(HASH_PARTS * min(1.0, 4 * max_lines / max(1, n_lines)))
    rows = rows.where(F.pmod("hash", F.lit(HASH_PARTS)) < share)
    rows = rows.where("trim(line) != '' and not lower(line) rlike 'licen|copyright|permission|rights reserved'")
    start = F.pmod("hash", F.greatest(F.length("line") - LINE_CHARS, F.lit(1))).cast("int")
    pieces = rows.select("hash", F.substring(F.col("line"), start + 1, F.lit(LINE_CHARS)).alias("piece")).distinct()
    return [r["piece"].encode() for r in pieces.orderBy("hash", "piece").limit(max_lines).collect()]


def scan(docs: DataFrame, model: Classifier) -> DataFrame:
    """Every row of ``docs`` as ``doc``, with the licence families of its text.

    families (sorted), n_notices, score (the least sure of the notices, 0 without any) and spans (bytes from, to, ... of lines
    with a notice, and of windows of words with one that no line shows by itself, by where they begin). A null or empty text has
    none. Every line of every text is judged, and every run of lines without a blank one; a very long text is judged whole, in one
    task. Repeated rows are judged each, an empty table gives none.
    """

    def step(batches: Batches) -> Batches:
        for whole in batches:
            for rows in chunks_of(whole.num_rows, 2048):
                batch = whole.slice(rows.start, rows.stop - rows.start)
                found = [_scanned(text or b"", model) for text in as_bytes(batch.column(1))]
                arrays = [pa.array(c, t) for c, t in zip(zip(*found), TYPES)]
                names = ["doc", *[f.split()[0] for f in SCHEMA.split(", ")]]
                yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], names=names)

    return over_batches(as_records(docs), step, with_record(docs, SCHEMA))


def _scanned(text: bytes, model: Classifier) -> tuple[list[str], int, float, list[int]]:
    found: list[tuple[int, int, str, float]] = []
    lines: list[list[bytes]] = []  # of a paragraph, and the families of those with a notice
    alone: list[str | None] = []
    at = begin = 0
    for line in text.split(b"\n"):
        words = words_of(line)
        judged = model.judge_words(words) if words else None
        if judged:
            found.append((at, at + len(line), *judged))
        if line.strip():
            lines.append(words)
            alone.append(judged and judged[0])
        else:
            found += _windows(text, begin, at, lines, alone, model)
            lines, alone, begin = [], [], at + len(line) + 1
        at += len(line) + 1
    found += _windows(text, begin, len(text), lines, alone, model)
    found.sort(key=lambda f: f[:2])
    return sorted({f for _, _, f, _ in found}), len(found), min((p for *_, p in found), default=0.0), [x for a, b, _, _ in found for x in (a, b)]


def _windows(text: bytes, begin: int, end: int, lines: list[list[bytes]], alone: list[str | None], model: Classifier) -> list[tuple[int, int, str, float]]:
    """Notices of ``judge_windows`` in ``text[begin:end]``, with bytes from and to."""
    notices = model.judge_windows(lines, alone)
    if not notices:
        return []
    places = [m.span() for m in WORD.finditer(text[begin:end].lower())]
    return [(begin + places[a][0], begin + places[b - 1][1], family, p) for a, b, family, p in notices]
