"""License scans by an exact set-similarity join of text blocks with license templates.

A template and a block are sets of words. Words are ordered by how many documents hold them, rarest
first, over the whole corpus. A block that holds a share ``threshold`` of a template's words must
hold one of the template's first words in that order (prefix filter), enough words at all (length
filter), and, from the first word they share on, enough words in either (positional filter); the
blocks left are verified on the full sets. All templates that pass are found: the filters drop none.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import repeat

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .divergence import pieces

#: Digits, ASCII letters (lower-cased) and all bytes of other characters stay; the rest parts words.
_WORD_BYTES = bytes((b | 32) if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))

#: Phrases whose places count.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: The words of public license notices, with their labels.
TEMPLATES = [
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software"),
    ("apache", "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation"),
    ("agpl", "under the terms of the gnu affero general public license as published by the free software foundation"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("cc-by", "licensed under cc by 4 0"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-nd", "licensed under cc by nd 4 0"),
    ("cc-by-nc-sa", "licensed under cc by nc sa 4 0"),
    ("cc-by-nc-nd", "licensed under cc by nc nd 4 0"),
    ("cc-by", "creative commons attribution 4 0 international license"),
    ("cc-by-sa", "creative commons attribution sharealike 4 0 international license"),
    ("cc-by-nc", "creative commons attribution noncommercial 4 0 international license"),
    ("cc-by-nc-sa", "creative commons attribution noncommercial sharealike 4 0 international license"),
    ("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work"),
]

SCANNED = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, matches array<struct<label: string, template: int, first: long, last: long, containment: double>>"


def needed(size: int, threshold: float) -> int:
    """How many of a template's ``size`` words a block must hold."""
    return math.ceil(threshold * size - 1e-9)


def step(words: int) -> int:
    """Blocks that a template of so many words meets start every ``step`` words and are twice as long: the
    power of two from 16 on that holds it, so a passage as long as the template lies in one block whole."""
    return max(16, 1 << (words - 1).bit_length())


def vocabulary_words(text: bytes, ids: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray, int]:
    """Positions and ids of a text's words that ``ids`` knows, and its number of words."""
    at, which, n = [], [], 0
    for words in pieces(text, _WORD_BYTES):
        words = [w for w in words if w]
        own = np.fromiter(map(ids.get, words, repeat(-1)), np.int64, len(words))
        hit = np.flatnonzero(own >= 0)
        at.append(hit + n)
        which.append(own[hit])
        n += len(words)
    return (np.concatenate(at), np.concatenate(which), n) if at else (np.zeros(0, np.int64), np.zeros(0, np.int64), 0)


def document_frequencies(docs: DataFrame, vocabulary: list[bytes]) -> dict[bytes, int]:
    """How many documents hold each of the given words: one number a word comes back."""
    ids = {w: i for i, w in enumerate(vocabulary)}

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        total = np.zeros(len(ids), np.int64)
        for batch in batches:
            for text in batch.column(0).to_pylist():
                total[np.unique(vocabulary_words(text, ids)[1])] += 1
        yield pa.RecordBatch.from_arrays([pa.array(range(len(ids)), pa.int64()), pa.array(total)], ["word", "docs"])

    sums = docs.select(F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text")).mapInArrow(run, "word long, docs long").groupBy("word").agg(F.sum("docs").alias("docs")).collect()
    found = {r["word"]: r["docs"] for r in sums}
    return {w: found.get(i, 0) for w, i in ids.items()}


class TemplateIndex:
    """Templates as sorted word ids in global order, and the words of their prefixes."""

    def __init__(self, templates: list[tuple[str, str]], frequency: dict[bytes, int], threshold: float):
        order = sorted(frequency, key=lambda w: (frequency[w], w))
        self.ids = {w: i for i, w in enumerate(order)}
        self.labels = [label for label, _ in templates]
        self.words = [sorted({self.ids[w] for w in t.encode().split()}) for _, t in templates]
        self.need = [needed(len(t), threshold) for t in self.words]
        self.steps = sorted({step(len(t.split())) for _, t in templates})
        self.inside = [{j for j, other in enumerate(self.words) if set(t) < set(other)} for t in self.words]
        # By step and prefix word: the templates that start with it so far on, and where.
        self.prefix: dict[int, dict[int, list[tuple[int, int]]]] = {s: {} for s in self.steps}
        for k, ((_, text), t) in enumerate(zip(templates, self.words, strict=True)):
            for i, w in enumerate(t[:len(t) - self.need[k] + 1]):
                self.prefix[step(len(text.split()))].setdefault(w, []).append((k, i))
        self.rare = {s: np.isin(np.arange(len(order)), list(p)) for s, p in self.prefix.items()}

    def block(self, own: list[int], s: int) -> list[tuple[int, float]]:
        """(template, containment) of the templates that a block's sorted distinct words meet; a template
        whose words are part of those of another one met there is left out."""
        met, seen, words = {}, set(), set(own)
        for j, w in enumerate(own):
            for k, i in self.prefix[s].get(w, ()):
                if k not in seen:
                    seen.add(k)
                    t = self.words[k]
                    if len(own) >= self.need[k] and 1 + min(len(t) - i - 1, len(own) - j - 1) >= self.need[k]:
                        common = len(words.intersection(t))
                        if common >= self.need[k]:
                            met[k] = common / len(t)
        return [(k, c) for k, c in sorted(met.items()) if not self.inside[k] & met.keys()]

    def scan(self, at: np.ndarray, which: np.ndarray, n: int) -> list[dict]:
        """Every block of a text that meets a template."""
        out = []
        for s in self.steps:
            near = np.unique(at[self.rare[s][which]] // s)
            for b in np.unique(np.concatenate([near - 1, near])):
                if b >= 0:
                    lo, hi = np.searchsorted(at, (b * s, (b + 2) * s))
                    for k, c in self.block(sorted(set(which[lo:hi].tolist())), s):
                        out.append({"label": self.labels[k], "template": k, "first": int(b * s), "last": int(min((b + 2) * s, n)) - 1, "containment": c})
        return out


def scan_licenses(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, phrases: dict[str, str] = PHRASES, threshold: float = 0.9) -> DataFrame:
    """``doc_id`` with the columns of :data:`SCANNED`.

    ``n_base``, ``first_word``, ``last_word`` and ``base_labels`` tell the places of the phrases' words,
    one after the other; ``matches`` the blocks that hold at least ``threshold`` of a template's
    distinct words (templates of under ten words: all of them), in blocks of twice :func:`step` words;
    ``labels`` those of both. ``score`` is 1 where a phrase stands, else the largest containment met, else 0.
    In a block, a template whose words are part of another one's that is met there is left out.

    Templates and phrases are arguments, so what each task holds of them is bounded by the call. Texts
    are read twice, once to order the templates' words by document frequency; nothing is shuffled but
    one number for each such word and task.

    Defined cases: null texts count as empty: no words, empty labels, null places, score 0; a text of
    any length is read in pieces of about 1 MB; each row, repeated or of null doc_id, gives its own
    row; ties of frequency go by the word's bytes and change no result; an empty table gives an empty
    result; other columns don't pass through.
    """
    said = [(tuple(p.encode().split()), label) for p, label in phrases.items()]
    vocabulary = sorted({w for _, t in templates for w in t.encode().split()} | {w for p, _ in said for w in p})
    index = TemplateIndex(templates, document_frequencies(docs, vocabulary), threshold)
    wanted = [([index.ids[w] for w in p], label) for p, label in said]

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), pa.list_(pa.struct([("label", pa.string()), ("template", pa.int32()), ("first", pa.int64()), ("last", pa.int64()), ("containment", pa.float64())]))]
        names = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "matches"]
        for batch in batches:
            rows = []
            for text in batch.column(1).to_pylist():
                at, which, n = vocabulary_words(text, index.ids)
                starts, base = [], set()
                for ids, label in wanted:
                    here = np.arange(max(0, len(at) - len(ids) + 1))
                    for j, w in enumerate(ids):
                        here = here[(which[here + j] == w) & (at[here + j] == at[here] + j)]
                    starts.extend(at[here].tolist())
                    base |= {label} if len(here) else set()
                met = index.scan(at, which, n)
                rows.append((n, len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(base | {m["label"] for m in met})), 1.0 if base else max((m["containment"] for m in met), default=0.0), met))
            cols = list(zip(*rows, strict=True)) if rows else [()] * 8
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]], names)

    text = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text")
    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", text).mapInArrow(run, f"doc_id {kind}, {SCANNED}")
